"""One scheduled balancing run as a batch job (``spark-submit capshift/job.py ...``).

The scheduled run of the reference, with its parameters as arguments: inputs
are table paths, ``--as-of`` defaults to the current time, ``--lookback-minutes``
to 5. Outputs go under ``--out`` in folders owned by ``--run-id`` and are published
together by a commit record; the next run starts from the state that the newest record
names, unless a state is given. A run that died half way is invisible, and a retried
run rewrites the same files; one that was published is not run again.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from capshift import schemas
from capshift.params import DEFAULT_LOOKBACK, RunParams
from capshift.plans.balance import BalanceRun, Inventory
from capshift.sources.events import read_capacity_events, read_typed_events
from capshift.sources.runs import RunStore
from capshift.sources.tables import TABLES, ensure_tables, latest_snapshot, write_run_partition


def _read(spark: SparkSession, path: str | None, schema=None) -> DataFrame | None:
    if not path:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def build_run(spark: SparkSession, args: argparse.Namespace) -> BalanceRun:
    as_of = dt.datetime.fromisoformat(args.as_of) if args.as_of else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    lookback = dt.timedelta(minutes=args.lookback_minutes) if args.lookback_minutes else DEFAULT_LOOKBACK
    params = RunParams(as_of=as_of, lookback=lookback, run_id=args.run_id or as_of.strftime("%Y%m%dT%H%M%S"))
    if args.events_format == "typed":
        events = read_typed_events(spark, args.events)
    else:
        events = read_capacity_events(spark, args.events, fmt=args.events_format)
    if args.state_table:
        state = latest_snapshot(spark, args.state_table)
    elif args.state:
        state = _read(spark, args.state, schemas.REPORT_REPOINTS)
    else:
        state = RunStore(spark, args.out).state()
    inventory = Inventory(_read(spark, args.workspaces, schemas.WORKSPACES), _read(spark, args.datasets, schemas.DATASETS),
                          _read(spark, args.reports, schemas.REPORTS), _read(spark, args.datasources, schemas.DATASOURCES),
                          _read(spark, args.connections, schemas.CONNECTIONS),
                          _read(spark, args.refresh_schedules, schemas.REFRESH_SCHEDULES))
    policies = _read(spark, args.policies)
    if args.watch_lists:
        return BalanceRun.from_watch_lists(params, policies, _read(spark, args.watch_lists, schemas.WATCH_LISTS),
                                           state, inventory, events)
    return BalanceRun(params, policies, _read(spark, args.watched), state, inventory, events)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Run one capacity-balancing tick over all policies and reports.")
    p.add_argument("--events", required=True)
    p.add_argument("--events-format", choices=["parquet", "json", "typed"], default="parquet")
    p.add_argument("--policies", required=True)
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--watched", help="(policy_id, report_id[, workspace_id]) table")
    g.add_argument("--watch-lists", help="(policy_id, report_ids) comma-list table")
    p.add_argument("--state", help="repoint state snapshot (Parquet) instead of the one the newest run left")
    p.add_argument("--state-table", help="catalog state table; its newest run_id partition is used")
    p.add_argument("--catalog", help="database whose state, log and alert tables get the run's rows as well")
    for name in ("workspaces", "datasets", "reports"):
        p.add_argument(f"--{name}", required=True)
    for name in ("datasources", "connections", "refresh-schedules"):
        p.add_argument(f"--{name}")
    p.add_argument("--out", required=True)
    p.add_argument("--as-of")
    p.add_argument("--lookback-minutes", type=float)
    p.add_argument("--run-id")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("capshift-balance").getOrCreate()
    done = RunStore(spark, args.out).publish(build_run(spark, args))
    if args.catalog:
        ensure_tables(spark, args.catalog)
        for name, path in done["tables"].items():
            if name in TABLES:
                write_run_partition(spark.read.parquet(path), f"{args.catalog}.{name}", done["run_id"])
    return done["tables"]


if __name__ == "__main__":
    main()
