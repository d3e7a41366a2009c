"""History (W1, W2) and streams (T1-T3) against brute force on the smallest fixture."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from capshift.catalog import QUERIES
from capshift.operators import peaks, replay
from capshift.sources.events import parse_events, with_metrics
from capshift.sources.fixtures import Fixture

SF = "/root/testdata/sf0.001"


def events_pdf(spark, sf=SF):
    fx = Fixture(spark, sf)
    pdf = with_metrics(parse_events(fx.capacity_events)).select("time", "capacity_id", "utilization").toPandas()
    return pdf.dropna(subset=["time", "capacity_id"])


def test_rolling_peak_brute_force(spark):
    look = dt.timedelta(hours=12)
    got = peaks.rolling_peak(parse_events(Fixture(spark, SF).capacity_events), look).toPandas()
    ev = events_pdf(spark)
    exp = []
    for cap, g in ev.groupby("capacity_id"):
        for t in g["time"]:
            w = g[(g["time"] >= t - look) & (g["time"] <= t)]["utilization"].dropna()
            exp.append((cap, t, max(0.0, w.max()) if len(w) else 0.0))
    e = pd.DataFrame(exp, columns=["capacity_id", "time", "p"]).sort_values(["capacity_id", "time", "p"])
    g2 = got.sort_values(["capacity_id", "time", "rolling_peak"])
    assert len(e) == len(g2)
    assert np.allclose(e["p"].to_numpy(), g2["rolling_peak"].to_numpy())


def test_rolling_peak_bucket_edges(spark):
    # events straddling slice and look-back boundaries must see each other
    from capshift import schemas
    look = dt.timedelta(minutes=5)
    b = dt.datetime(1970, 1, 1) + dt.timedelta(minutes=20) * (int(dt.datetime(2024, 1, 1).timestamp()) // 1200 + 1)
    rows = [(b - dt.timedelta(minutes=3), '{"capacityId":"A","capacityUnitMs":27000,"baseCapacityUnits":1}'),
            (b, '{"capacityId":"A","capacityUnitMs":3000,"baseCapacityUnits":1}'),
            (b + dt.timedelta(minutes=2), '{"capacityId":"A","capacityUnitMs":6000,"baseCapacityUnits":1}'),
            (b + dt.timedelta(minutes=6), '{"capacityId":"A","capacityUnitMs":3000,"baseCapacityUnits":1}')]
    df = spark.createDataFrame(rows, schemas.CAPACITY_EVENTS)
    got = [r["rolling_peak"] for r in peaks.rolling_peak(parse_events(df), look).orderBy("time").collect()]
    assert got == [0.9, 0.9, 0.9, 0.2]


def exchanged_rows(plan) -> int:
    """Rows written to shuffles by the plan that ran, exchanges that are read twice counted once."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return exchanged_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return exchanged_rows(plan.plan())
    if name == "ReusedExchangeExec":
        return 0
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(exchanged_rows(children.apply(i)) for i in range(children.size()))


def test_rolling_peak_shuffles_an_event_once(spark):
    df = peaks.rolling_peak(parse_events(Fixture(spark, "/root/testdata/sf0.01").capacity_events), dt.timedelta(hours=12))
    events = len(df.collect())
    assert events <= exchanged_rows(df._jdf.queryExecution().executedPlan()) <= 1.5 * events


def test_replay_scans_the_events_once(spark):
    got = QUERIES["hysteresis_replay"](spark, SF)
    assert "events.parquet" not in got._jdf.queryExecution().executedPlan().toString()
    rules = replay.Rules("0", 0.5, 0.3, 0.8, dt.timedelta(hours=12))
    assert replay.tick_peaks(parse_events(Fixture(spark, SF).capacity_events), rules.lookback, rules.step) \
        ._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_report_runs_expand_to_the_tick_table(spark):
    """Every report's runs, expanded, are its home's states at every tick; runs of one report neither overlap nor touch."""
    ticks = {(r.capacity_id, r.tick): r.state for r in QUERIES["hysteresis_replay"](spark, SF).collect()}
    count = len({t for _, t in ticks})
    seen = {}
    for r in QUERIES["report_replay"](spark, SF).collect():
        t = r.from_tick
        while t <= r.to_tick:
            assert (r.report_id, t) not in seen and ticks[r.capacity_id, t] == r.state
            seen[r.report_id, t] = r.state
            t += dt.timedelta(hours=6)
    assert len(seen) == count * len({i for i, _ in seen})


@pytest.mark.parametrize("look,step", [(dt.timedelta(hours=12), dt.timedelta(hours=6)),
                                       (dt.timedelta(minutes=72), dt.timedelta(hours=6)),
                                       (dt.timedelta(hours=2), dt.timedelta(minutes=50))])
def test_hysteresis_replay_brute_force(spark, look, step):
    T, R, H, target = 0.5, 0.3, 0.8, "0"
    got = replay.hysteresis_replay(parse_events(Fixture(spark, SF).capacity_events), target, T, R, H, look, step)
    got = got.toPandas().set_index(["capacity_id", "tick"]).sort_index()
    ev = events_pdf(spark)
    step_ns = int(step.total_seconds() * 1e9)
    t0 = pd.Timestamp(-(-ev["time"].min().value // step_ns) * step_ns)
    t1 = pd.Timestamp((ev["time"].max() + look).value // step_ns * step_ns)
    ticks = pd.date_range(t0, t1, freq=step)

    def peak(cap, t):
        g = ev[(ev["capacity_id"] == cap) & (ev["time"] >= t - look) & (ev["time"] <= t)]
        u = g["utilization"].dropna()
        return (max(0.0, u.max()) if len(u) else 0.0), len(g)

    exp = {}
    for cap in sorted(set(ev["capacity_id"]) - {target}):
        state = 0
        for t in ticks:
            p, n = peak(cap, t)
            tp, _ = peak(target, t)
            if p > T and tp <= H * T:
                state = 1
            elif p < R:
                state = 0
            exp[(cap, t)] = state
    assert len(exp) == len(got)
    for key, st in exp.items():
        assert got.loc[key, "state"] == st, key


def test_stream_peak_equals_closed_batch_windows(spark):
    got = QUERIES["stream_peak"](spark, SF).toPandas()
    ev = events_pdf(spark)
    limit = ev["time"].max() - pd.Timedelta(minutes=10)
    exp = {}
    for _, r in ev.iterrows():
        m = r["time"].floor("min")
        for j in range(5):
            start = m - pd.Timedelta(minutes=j)
            if start + pd.Timedelta(minutes=5) <= limit:
                key = (start, r["capacity_id"])
                u = 0.0 if pd.isna(r["utilization"]) else r["utilization"]
                exp[key] = max(exp.get(key, 0.0), u)
    got_map = {(r.window_start, r.capacity_id): r.peak_utilization for r in got.itertuples()}
    assert got_map.keys() == exp.keys()
    assert all(abs(got_map[k] - v) < 1e-12 for k, v in exp.items())


def test_stream_hysteresis_emits_changes_only(spark):
    got = QUERIES["stream_hysteresis"](spark, SF).toPandas()
    ev = events_pdf(spark).sort_values(["time", "utilization"], na_position="last", kind="mergesort")
    closed = ev["time"].max().floor("ms") - pd.Timedelta(minutes=10)
    exp = []
    for cap, g in ev[ev["time"] <= closed].groupby("capacity_id", sort=True):
        state = 0
        for r in g.itertuples():
            new = 1 if r.utilization > 0.5 else 0 if r.utilization < 0.3 else state
            if new != state:
                exp.append((cap, r.time, new))
            state = new
    assert sorted(exp) == sorted((r.capacity_id, r.time, r.state) for r in got.itertuples())
