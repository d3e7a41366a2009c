"""The ordered plan of a run: references to what is yet to come, statuses, and what is remembered when."""

from __future__ import annotations

import json

from capshift import schemas
from capshift.plans import workplan
from capshift.plans.balance import Inventory

from world import DATASETS, REPORT_HOME, WORKSPACES, build, event

CREATE = [("P", "fresh", "B", "", 0.5, 0.25, 0.8)]


def run_of(spark, policies=None, datasets=DATASETS):
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=datasets, reports=REPORT_HOME,
                watched=[("P", "r1")], policies=policies, materialize=True)
    sources = spark.createDataFrame([("dsA", "s1")], schemas.DATASOURCES)
    links = spark.createDataFrame([("s1", "Cloud", None, ("path", "SQL"))], schemas.CONNECTIONS)
    times = spark.createDataFrame([("dsA", ["Monday"], ["01:00"], "UTC", False)], schemas.REFRESH_SCHEDULES)
    run.inv = Inventory(run.inv.workspaces, run.inv.datasets, run.inv.reports, sources, links, times)
    return run


def test_a_workspace_to_create_comes_first_and_all_else_refers_to_it(spark):
    run = run_of(spark, CREATE)
    plan = run.work_plan.orderBy("step").collect()
    assert [r.request for r in plan] == list(workplan.STEPS)
    assert [r.status for r in plan] == ["READY"] + ["PENDING"] * 5
    body = [json.loads(r.payload) for r in plan]
    copy = "${dataset:${workspace:fresh}/sales_LB}"
    assert body[0] == {"name": "fresh"}
    assert body[1] == {"capacityMigrationAssignments": [{"targetCapacityObjectId": "B", "workspacesToAssign": ["${workspace:fresh}"]}]}
    assert body[2] == {"sourceWorkspaceId": "wsA", "sourceDatasetId": "dsA", "targetWorkspaceId": "${workspace:fresh}",
                       "targetName": "sales_LB"}
    assert body[3]["datasetId"] == copy and json.loads(body[3]["body"])["connectionBinding"]["id"] == "s1"
    assert body[4]["datasetId"] == copy and json.loads(body[4]["body"])["value"]["enabled"] is True
    assert body[5] == {"workspaceId": "wsA", "reportId": "r1", "datasetId": copy}
    assert plan[2].makes == plan[3].waits_for == plan[4].waits_for == plan[5].waits_for
    assert plan[0].makes == plan[1].waits_for == plan[2].waits_for == "workspace:fresh"
    assert run.next_state.count() == 0  # nothing is remembered before the copy has an id
    kinds = {r.kind for r in run.log.collect()}
    assert {"DEPLOYING_WORKSPACE", "CONNECTION"} <= kinds


def test_a_copy_that_exists_makes_everything_ready(spark):
    run = run_of(spark)
    plan = run.work_plan.orderBy("step").collect()
    assert [r.request for r in plan] == list(workplan.STEPS[2:]) and {r.status for r in plan} == {"READY"}
    assert json.loads(plan[-1].payload)["datasetId"] == "dsA_copy"
    assert [r.target_dataset_id for r in run.next_state.collect()] == ["dsA_copy"]


def test_a_copy_to_come_is_pending_with_a_body(spark):
    run = run_of(spark, datasets=DATASETS[:1])
    action = run.action_requests.first()
    assert (action.status, json.loads(action.payload)) == ("PENDING", {"datasetId": "${dataset:wsB/sales_LB}"})
    assert run.next_state.count() == 0
    # the copy has appeared by the next run: the same report is decided again and remembered
    assert run_of(spark).next_state.count() == 1


def test_one_request_for_a_workspace_that_several_policies_name(spark):
    policies = spark.createDataFrame([("Q", *CREATE[0][1:]), CREATE[0]], schemas.POLICIES)
    made = workplan.new_workspaces(policies, spark.createDataFrame(WORKSPACES, schemas.WORKSPACES)).collect()
    assert [tuple(r) for r in made] == [("P", "fresh", "B")]
