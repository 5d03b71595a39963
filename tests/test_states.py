"""Changes kept run by run equal those computed from the whole log, late runs included."""

import datetime as dt
import os
import random

import pytest

from dqspark import operators as op
from dqspark.sources import append_runs, read_metrics, read_runs, read_states, save_metrics, save_state

METRICS = "run_id string, metric_key string, metric_label string, value_pct double"


def log(spark, root, runs):
    """Log runs: {run_id: (day, {metric: value})}."""
    stamped = [(r, dt.datetime(2026, 1, 1) + dt.timedelta(days=day), None) for r, (day, _) in runs.items()]
    append_runs(spark.createDataFrame(stamped, "run_id string, run_ts timestamp, release_label string"), root)
    rows = [(r, k, k, v) for r, (_, values) in runs.items() for k, v in values.items()]
    save_metrics(spark.createDataFrame(rows, METRICS), root, run_ids=list(runs))


def full(spark, root, runs):
    out = op.release_change(read_runs(spark, root), read_metrics(spark, root)).collect()
    return sorted(map(repr, map(tuple, out)))


def kept(spark, root):
    return sorted(map(repr, map(tuple, op.change_of_states(read_runs(spark, root), read_states(spark, root)).collect())))


def files(root):
    base = f"{root}/email_dq_states"
    return {d: sorted(f for f in os.listdir(f"{base}/{d}") if f.endswith(".parquet")) for d in os.listdir(base) if d.startswith("run_id=")}


def random_runs(seed, count):
    chance = random.Random(seed)
    keys = ["a", "b", "c", "d"]
    return {
        f"r{k}": (k // 2 if k % 5 == 0 else k, {m: chance.choice([None, float(chance.randrange(100))]) for m in keys if chance.random() < 0.6} or {"a": 1.0})
        for k in range(count)
    }


@pytest.mark.parametrize("seed, shuffled", [(1, False), (2, True)])
def test_states_equal_the_full_computation_in_any_order(spark, tmp_path, seed, shuffled):
    root, runs = str(tmp_path), random_runs(seed, 6)
    log(spark, root, runs)
    order = list(runs)
    if shuffled:
        random.Random(seed).shuffle(order)
    for run in order:
        assert save_state(spark, root, run)[0] == run
    assert kept(spark, root) == full(spark, root, runs)


def test_a_new_run_reads_and_writes_two_runs_only(spark, tmp_path):
    root, runs = str(tmp_path), {f"r{k}": (k, {"a": float(k), "b": 2.0 * k}) for k in range(4)}
    log(spark, root, runs)
    for run in list(runs)[:3]:
        save_state(spark, root, run)
    before = files(root)
    assert save_state(spark, root, "r3") == ["r3"]
    after = files(root)
    assert {d for d in after if after[d] != before.get(d)} == {"run_id=r3"}
    plan = read_states(spark, root, ["r2"])._jdf.queryExecution().executedPlan().toString()
    assert "r2" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_late_run_renews_only_what_follows_from_it(spark, tmp_path):
    root = str(tmp_path)
    runs = {"r0": (0, {"a": 1.0, "b": 5.0}), "r2": (2, {"a": 3.0}), "r3": (3, {"a": 4.0, "b": 6.0}), "r4": (4, {"a": 5.0, "b": 7.0})}
    log(spark, root, runs)
    for run in runs:
        save_state(spark, root, run)
    late = {"r1": (1, {"a": 2.0, "b": 5.5})}
    log(spark, root, late)
    # r2 has another value before its own for a and carries b on; r3 has another one before its b; r4 stays.
    assert save_state(spark, root, "r1") == ["r1", "r2", "r3"]
    assert kept(spark, root) == full(spark, root, runs | late)


def test_a_run_saved_again_and_an_unknown_run(spark, tmp_path):
    root, runs = str(tmp_path), {"r0": (0, {"a": 1.0}), "r1": (1, {"a": 2.0})}
    log(spark, root, runs)
    save_state(spark, root, "r0")
    save_state(spark, root, "r1")
    save_metrics(spark.createDataFrame([("r0", "a", "a", 9.0)], METRICS), root, run_ids=["r0"])
    assert save_state(spark, root, "r0") == ["r0", "r1"]
    assert kept(spark, root) == full(spark, root, runs)
    with pytest.raises(ValueError, match="not in the run log"):
        save_state(spark, root, "r9")


def test_latest_change_is_that_of_the_newest_run(spark, tmp_path):
    root, runs = str(tmp_path), random_runs(3, 7)
    log(spark, root, runs)
    frames = read_runs(spark, root), read_metrics(spark, root)
    newest = max(r["run_ts"] for r in frames[0].collect())
    want = [repr(tuple(r)) for r in op.release_change(*frames).collect() if r["run_ts"] == newest]
    assert sorted(repr(tuple(r)) for r in op.latest_release_change(*frames).collect()) == sorted(want) and want
    empty = op.latest_release_change(frames[0].limit(0), frames[1].limit(0)).collect()
    assert empty == []
