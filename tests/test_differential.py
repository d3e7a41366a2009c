"""Set-based tick vs a plain-Python restatement of the reference's two loops, on random worlds."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from world import AS_OF, build, event


def reference_loop(world):
    """Per-report loop semantics: recover pass, then gate + move pass (one gate per tick)."""
    ws_cap = {w: c for w, _, c in world["workspaces"]}
    ds_ws = {d: w for d, _, w in world["datasets"]}
    rep = {r: (w, d) for r, w, d in world["reports"]}
    peaks = {}
    for _, cap, util in world["samples"]:
        peaks[cap] = max(peaks.get(cap, 0.0), util)
    state = {s[2]: s for s in world["state"]}
    T, R, target_ws = world["T"], world["R"], world["target"]
    target_cap = ws_cap[target_ws]
    out = {}
    for _, report in world["watched"]:
        row = state.get(report)
        if row is None:
            continue
        home_ws = ds_ws.get(row[0])
        home_cap = ws_cap.get(home_ws) if home_ws else None
        if home_cap is not None and peaks.get(home_cap, 0.0) < R:
            out[report] = "RECOVER"
    remaining = [r for _, r in world["watched"] if r not in out]
    overloaded = peaks.get(target_cap, 0.0) > 0.8 * T
    for report in remaining:
        if overloaded:
            out[report] = "TARGET_OVERLOADED"
            continue
        w_d = rep.get(report)
        cap = ws_cap.get(ds_ws.get(w_d[1])) if w_d and ds_ws.get(w_d[1]) else None
        if cap is None:
            out[report] = "UNRESOLVED"
        elif cap == target_cap:
            out[report] = "SAME_CAPACITY"
        elif peaks.get(cap, 0.0) > T:
            out[report] = "MOVE"
        else:
            out[report] = "LOW_UTILIZATION"
    return out


def random_world(seed):
    rnd = random.Random(seed)
    caps = [f"c{i}" for i in range(5)]
    workspaces = [(f"w{i}", f"name{i}", rnd.choice(caps)) for i in range(8)]
    datasets = [(f"d{i}", f"m{i}", rnd.choice(workspaces)[0]) for i in range(10)]
    reports = [(f"r{i}", rnd.choice(workspaces)[0], rnd.choice(datasets)[0] if rnd.random() > 0.1 else "dX")
               for i in range(20)]
    watched = [("P", r[0]) for r in reports if rnd.random() < 0.7] + [("P", "ghost")]
    state = [(rnd.choice(datasets)[0] if rnd.random() > 0.1 else "dGone", r[1], r[0], r[2], "w0")
             for r in reports if rnd.random() < 0.4]
    # utilisations on a 1/64 grid, so that equality with the thresholds happens and is exact
    grid = [k / 64 for k in range(0, 65)]
    samples = [(AS_OF - dt.timedelta(seconds=rnd.randint(1, 299)), c, rnd.choice(grid))
               for c in caps[:-1] for _ in range(rnd.randint(0, 3))]
    T = rnd.choice([k / 16 for k in range(4, 16)])
    R = rnd.choice([k / 16 for k in range(1, 16) if k / 16 < T])
    target = rnd.choice(workspaces)[0]
    return dict(workspaces=workspaces, datasets=datasets, reports=reports, watched=watched, state=state,
                samples=samples, T=T, R=R, target=target)


@pytest.mark.parametrize("seed", range(6))
def test_set_based_tick_matches_loop(spark, seed):
    w = random_world(seed)
    run = build(spark, events=[event(c, u, when=t) for t, c, u in w["samples"]], workspaces=w["workspaces"],
                datasets=w["datasets"], reports=w["reports"], watched=w["watched"], state=w["state"],
                target_ws=w["target"], move=w["T"], recover=w["R"])
    got = {r["report_id"]: r["decision"] for r in run.decisions.collect()}
    assert got == reference_loop(w)
