"""The batch job entry: inputs from paths, one run, outputs per run id."""

from __future__ import annotations

from capshift import job
from capshift.catalog import fixture_run

SF = "/root/testdata/sf0.001"


def test_job_run_matches_the_fixture_run(spark, tmp_dir):
    run = fixture_run(spark, SF)
    fx = run._source
    paths = {}
    for name in ("capacity_events", "policies", "watch_lists", "state", "workspaces", "datasets", "reports",
                 "datasources", "connections", "refresh_schedules"):
        paths[name] = f"{tmp_dir}/in/{name}"
        getattr(fx, name).write.parquet(paths[name])
    argv = ["--events", paths["capacity_events"], "--policies", paths["policies"],
            "--watch-lists", paths["watch_lists"], "--state", paths["state"],
            "--workspaces", paths["workspaces"], "--datasets", paths["datasets"], "--reports", paths["reports"],
            "--datasources", paths["datasources"], "--connections", paths["connections"],
            "--refresh-schedules", paths["refresh_schedules"], "--out", f"{tmp_dir}/out",
            "--as-of", fx.params.as_of.isoformat(), "--lookback-minutes", str(fx.params.lookback.total_seconds() / 60),
            "--run-id", "r1"]
    out = job.main(argv, spark)
    key = ["policy_id", "report_id"]
    got = spark.read.parquet(out["decisions"]).orderBy(key).collect()
    assert got == run.decisions.orderBy(key).collect()
    assert spark.read.parquet(out["report_repoints"]).count() == run.next_state.count()
    assert spark.read.parquet(out["decision_log"]).count() == run.log.count()
