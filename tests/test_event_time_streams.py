"""T3 in event-time order whatever the files and triggers; T2 over the event table with the state carried."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from capshift import schemas
from capshift.operators import decide
from capshift.params import RunParams
from capshift.plans.balance import BalanceRun, Inventory, Traced
from capshift.sources.events import read_capacity_event_stream
from capshift.sources.runs import RunStore
from capshift.streaming.balance import balance_each_batch, balance_stream
from capshift.streaming.hysteresis import OUTPUT, drain_hysteresis, stream_hysteresis

from world import DATASETS, REPORT_HOME, WORKSPACES, event

T0 = dt.datetime(2024, 1, 22, 12, 0)
MOVE, RECOVER = 0.5, 0.25


def changes_of(samples, until):
    """Plain state changes of (time, capacity, ratio) samples up to a time."""
    out, state = [], {}
    for t, cap, u in sorted(samples, key=lambda s: (s[0], s[2])):
        now = 1 if u > MOVE else 0 if u < RECOVER else state.get(cap, 0)
        if t <= until and now != state.get(cap, 0):
            out.append((cap, t, now))
        if t <= until:
            state[cap] = now
    return sorted(out)


def write_files(spark, folder, files):
    for k, samples in enumerate(files):
        rows = [event(cap, u, when=t) for t, cap, u in samples]
        spark.createDataFrame(rows, schemas.CAPACITY_EVENTS).coalesce(1).write.parquet(f"{folder}/part={k}")


def rows_of(df):
    return sorted((r.capacity_id, r.time, r.state) for r in df.collect())


@pytest.mark.parametrize("cap", [1, 2, 256])
def test_files_that_overlap_in_time_give_the_same_changes(spark, tmp_dir, cap):
    rng = random.Random(6)
    samples = [(T0 + dt.timedelta(seconds=7 * i), f"c{rng.randrange(3)}", rng.choice([k / 16 for k in range(17)])) for i in range(1200)]
    # four arrivals; samples come up to 8 minutes late, so neighbouring files overlap by as much
    files = [[] for _ in range(4)]
    for t, c, u in samples:
        arrival = t + dt.timedelta(seconds=rng.randrange(480))
        files[min(3, int((arrival - T0).total_seconds() // 2100))].append((t, c, u))
    write_files(spark, f"{tmp_dir}/in", files)
    stream = read_capacity_event_stream(spark, f"{tmp_dir}/in/*", max_files_per_trigger=cap, glob="*.parquet")
    done = drain_hysteresis(spark, stream, MOVE, RECOVER)
    until = samples[-1][0] - dt.timedelta(minutes=10)
    assert done.late_rows == 0
    assert rows_of(spark.read.schema(OUTPUT).parquet(done.path)) == changes_of(samples, until)


def test_files_that_each_span_everything_need_a_delay_as_long(spark, tmp_dir):
    rng = random.Random(7)
    samples = [(T0 + dt.timedelta(seconds=20 * i), "c", rng.choice([0.1, 0.3, 0.9])) for i in range(400)]
    close = (T0 + dt.timedelta(days=3), "other", 0.9)  # a late arrival that moves the watermark past the rest
    write_files(spark, f"{tmp_dir}/in", [samples[k::4] for k in range(4)] + [[close]])
    for cap in (1, 256):
        stream = read_capacity_event_stream(spark, f"{tmp_dir}/in/*", max_files_per_trigger=cap, glob="*.parquet")
        got = stream_hysteresis(spark, stream, MOVE, RECOVER, delay="3 hours")
        assert rows_of(got) == changes_of(samples, T0 + dt.timedelta(days=2))


def test_samples_beyond_the_delay_are_counted(spark, tmp_dir):
    first = [(T0, "c", 0.9), (T0 + dt.timedelta(hours=1), "c", 0.1)]
    second = [(T0 + dt.timedelta(minutes=20), "c", 0.1), (T0 + dt.timedelta(minutes=30), "c", 0.9),
              (T0 + dt.timedelta(hours=2), "c", 0.9)]
    third = [(T0 + dt.timedelta(hours=4), "d", 0.9), (T0 + dt.timedelta(minutes=40), "c", 0.1),
             (T0 + dt.timedelta(minutes=1), "d", 0.9), (T0 + dt.timedelta(minutes=1), "d", 0.3)]
    write_files(spark, f"{tmp_dir}/in", [first, second, third])
    stream = read_capacity_event_stream(spark, f"{tmp_dir}/in/*", max_files_per_trigger=1, glob="*.parquet")
    done = drain_hysteresis(spark, stream, MOVE, RECOVER)
    # The second file's old samples come while the watermark of the first is only being set: they are in time.
    # The third's are older than what has been applied; the one between the thresholds is filtered before that.
    assert done.late_rows == 2
    minutes = [0, 20, 30, 60, 120]
    assert rows_of(spark.read.schema(OUTPUT).parquet(done.path)) == [
        ("c", T0 + dt.timedelta(minutes=m), (k + 1) % 2) for k, m in enumerate(minutes)]


def test_a_drained_query_goes_on_from_its_checkpoint(spark, tmp_dir):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    samples = [(T0, "c", 0.9), (T0 + dt.timedelta(minutes=5), "c", 0.1), (T0 + dt.timedelta(hours=1), "c", 0.3)]
    write_files(spark, f"{tmp_dir}/in", [samples])

    def run():
        stream = read_capacity_event_stream(spark, f"{tmp_dir}/in/*", glob="*.parquet")
        return drain_hysteresis(spark, stream, MOVE, RECOVER, base=f"{tmp_dir}/query")

    assert len(rows_of(spark.read.schema(OUTPUT).parquet(run().path))) == 2
    more = [(T0 + dt.timedelta(hours=1, minutes=1), "c", 0.8), (T0 + dt.timedelta(hours=3), "c", 0.3)]
    spark.createDataFrame([event(c, u, when=t) for t, c, u in more], schemas.CAPACITY_EVENTS).write.parquet(f"{tmp_dir}/in/part=9")
    assert [r[2] for r in rows_of(spark.read.schema(OUTPUT).parquet(run().path))] == [1, 0, 1]
    assert spark.conf.get(provider, None) == before


def inventory(spark):
    return Inventory(spark.createDataFrame(WORKSPACES, schemas.WORKSPACES), spark.createDataFrame(DATASETS, schemas.DATASETS),
                     spark.createDataFrame(REPORT_HOME, schemas.REPORTS))


def maker(spark):
    policies = spark.createDataFrame([("P", "", "", "wsB", MOVE, RECOVER, 0.8)], schemas.POLICIES)
    watched = spark.createDataFrame([("P", "r1")], schemas.WATCHED)
    return lambda params, state, events: BalanceRun(params, policies, watched, state, inventory(spark), events)


def test_a_capacity_silent_in_a_batch_keeps_its_look_back_and_the_state_is_carried(spark, tmp_dir):
    minutes = dt.timedelta(minutes=1)
    arrivals = [[(T0, "A", 0.9), (T0, "B", 0.1)],          # A is over the threshold: the report moves
                [(T0 + 3 * minutes, "B", 0.2)],            # A is silent, its 0.9 is still in the look-back
                [(T0 + 6 * minutes, "B", 0.1)]]            # 0.9 is out of the look-back: home again, by the carried state
    for k, samples in enumerate(arrivals):
        write_files(spark, f"{tmp_dir}/in{k}", [samples])
        stream = read_capacity_event_stream(spark, f"{tmp_dir}/in[0-{k}]/*", glob="*.parquet")
        store = balance_stream(spark, stream, f"{tmp_dir}/t2", maker(spark), 5 * minutes)
    runs = {r.run_number: (r.report_id, r.decision) for r in store.table("decisions").collect()}
    assert runs == {1: ("r1", "MOVE"), 2: ("r1", "MOVE"), 3: ("r1", "RECOVER")}
    assert [r["as_of"] for r in store.commits().orderBy("number").collect()] == [T0, T0 + 3 * minutes, T0 + 6 * minutes]
    assert store.state().count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_dir):
    store = RunStore(spark, f"{tmp_dir}/runs")
    step = balance_each_batch(spark, store, f"{tmp_dir}/events", maker(spark), dt.timedelta(minutes=5))
    batch = spark.createDataFrame([event("A", 0.9, when=T0), event("B", 0.1, when=T0)], schemas.CAPACITY_EVENTS)
    empty = batch.where("false")
    for batch_id, df in ((0, batch), (0, batch), (1, empty)):
        step(df, batch_id)
    assert store.commits().count() == 1 and spark.read.parquet(f"{tmp_dir}/events").count() == 2
    # a batch whose run died before its commit is added and run again, once
    assert RunParams(as_of=T0).run_id == "run-0"
    assert [r.initial_dataset_id for r in store.state().collect()] == ["dsA"]


def test_runs_of_a_stream_share_what_no_event_touches(spark, tmp_dir, monkeypatch):
    minutes = dt.timedelta(minutes=1)
    calls = []
    for step in ("traced_reports", "placed_datasets", "tick_table"):
        monkeypatch.setattr(decide, step, lambda *a, _step=getattr(decide, step), _name=step: calls.append(_name) or _step(*a))
    policies = spark.createDataFrame([("P", "", "", "wsB", MOVE, RECOVER, 0.8)], schemas.POLICIES)
    watched = spark.createDataFrame([("P", "r1"), ("P", "r1"), ("P", "ghost"), (None, "r1")], schemas.WATCHED)
    inv = inventory(spark)
    traced = Traced(watched, inv)

    def drained(at, **shared):
        store = RunStore(spark, f"{tmp_dir}/{at}/runs")
        step = balance_each_batch(spark, store, f"{tmp_dir}/{at}/events",
                                  lambda params, state, events: BalanceRun(params, policies, watched, state, inv, events, **shared),
                                  5 * minutes)
        for k, (a, b) in enumerate(((0.9, 0.1), (0.9, 0.1), (0.1, 0.1))):
            step(spark.createDataFrame([event(c, u, when=T0 + 6 * k * minutes) for c, u in (("A", a), ("B", b))],
                                       schemas.CAPACITY_EVENTS), k)
        return {name: sorted(map(str, store.table(name).collect())) for name in
                ("decisions", "report_repoints", "actions", "work_plan", "copies", "decision_log", "alerts")}

    shared = drained("shared", traced=traced)
    assert sorted(calls) == ["placed_datasets", "traced_reports"]  # once for three runs
    assert shared == drained("alone") and calls.count("tick_table") == 3
    assert len(traced._paths) == 2
    traced.release()
    assert traced._paths == []


def test_rows_of_runs_are_told_apart_without_looking_at_every_path(spark, tmp_dir):
    for root, names, by_path in ((f"{tmp_dir}/plain", ("007", "7", "2024-01-22 00+a"), False),
                                 (f"{tmp_dir}/odd", ("7", "a%20b", "a b"), True)):
        store = RunStore(spark, root)
        for k, name in enumerate(names):
            path = f"{root}/decisions/run_id={name}"
            spark.range(k + 1).selectExpr("id", "'other' AS run_id").write.parquet(path)
            record = {"number": k + 1, "run_id": name, "as_of": T0.isoformat(), "tables": {"decisions": path}}
            store._place(f"{k + 1:012d}.json", json.dumps(record))
        rows = store.table("decisions")
        assert sorted((r.run_number, r.run_id, r.id) for r in rows.collect()) == [
            (k + 1, name, i) for k, name in enumerate(names) for i in range(k + 1)]
        assert ("file_path" in rows._jdf.queryExecution().optimizedPlan().toString()) == by_path
