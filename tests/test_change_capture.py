import random
from datetime import datetime, timedelta

import pytest

from quillgraph.operators.change_capture import changed_files, changes, file_capture, plan_batches, reports, successful_runs

DIFF = "diff_id bigint, workspace_id string, repo_name string, observed_at timestamp_ntz, arrived_at timestamp_ntz, changed_paths array<string>, deleted_paths array<string>, new_hashes map<string,string>"
RUN = "run_id bigint, workspace_id string, repo_name string, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
T0 = datetime(2025, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def d(i, seen, arrived, changed=None, deleted=None, repo="r", ws="w", hashes=True):
    return (i, ws, repo, at(seen), at(arrived), changed and list(changed), deleted, dict(changed) if changed and hashes else None)


def r(i, start, status="ok", repo="r", ws="w"):
    return (i, ws, repo, at(start), None, status)


def brute(diffs, runs):
    out, ok = set(), sorted({x for x in runs if x[5] == "ok" and x[3]}, key=lambda x: (x[3], x[0]))
    for key in {(x[1], x[2]) for x in ok}:
        state = {}
        for run in [x for x in ok if (x[1], x[2]) == key]:
            now = {}
            for e in sorted([x for x in diffs if (x[1], x[2]) == key and x[3] and x[4] and x[4] <= run[3]], key=lambda x: (x[3], x[0])):
                for p in e[5] or []:
                    if p is not None:
                        now[p] = (e[7] or {}).get(p, "")
                for p in e[6] or []:
                    now[p] = None
            for p in set(now) | set(state):
                if now.get(p) != state.get(p):
                    out.add((run[0], p, "deleted" if now.get(p) is None else "changed"))
            state = now
    return out


CASES = {
    "plain": ([d(1, 0, 1, {"a": "1", "b": "1"}), d(2, 2, 3, {"a": "2"}, ["b"])], [r(1, 1), r(2, 4)]),
    "late and out of order": ([d(2, 5, 6, {"a": "2"}), d(1, 1, 30, {"a": "1", "c": "1"})], [r(1, 7), r(2, 40)]),
    "failed runs leave their range": ([d(1, 0, 1, {"a": "1"}), d(2, 3, 4, {"a": "2"})], [r(1, 2), r(2, 5, "failed"), r(3, 6, None), r(4, 900)]),
    "redelivered": ([d(1, 0, 1, {"a": "1"}), d(1, 0, 50, {"a": "1"})], [r(1, 2), r(1, 2), r(2, 60)]),
    "back to the old state": ([d(1, 0, 1, {"a": "1"}), d(2, 3, 4, {"a": "2"}), d(3, 5, 6, {"a": "1"})], [r(1, 2), r(2, 7)]),
    "far buckets and ties": ([d(1, 0, 1, {"a": "1"}), d(2, 0, 1, {"a": "9"}), d(3, 1, 5000, None, ["a"])], [r(1, 4000), r(2, 6000)]),
    "nulls": ([d(1, 0, 1, {"a": "1"}, hashes=False), (2, None, "r", at(0), at(1), ["x"], None, None), (3, "w", "r", None, at(1), ["x"], [], {}), (4, "w", "r", at(1), at(2), [None, "z"], [None], None)], [r(1, 9), (2, "w", None, at(3), None, "ok"), (3, "w", "r", None, None, "ok")]),
    "other repositories": ([d(1, 0, 1, {"a": "1"}, repo="x"), d(2, 0, 1, {"a": "1"}, ws="v")], [r(1, 2), r(2, 3, repo="x")]),
    "empty": ([], []),
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    diffs, runs = CASES[case]
    got = changed_files(spark.createDataFrame(diffs, DIFF), spark.createDataFrame(runs, RUN)).collect()
    found = {tuple(x) for x in got}
    assert len(got) == len(found)
    named = [x for x in runs if x[1] and x[2]]
    assert found == brute([x for x in diffs if x[1] and x[2]], named)


def test_plan_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    diffs, runs = CASES["failed runs leave their range"]
    a, b = spark.createDataFrame(diffs, DIFF), spark.createDataFrame(runs, RUN)
    for c in ("_bucket", "_run", "run", "path", "hash"):
        a, b = a.withColumn(c, F.lit(1)), b.withColumn(c, F.lit("x"))
    assert {tuple(x) for x in changed_files(a, b).collect()} == brute(diffs, runs)
    plan = {x["run_id"]: (x["after"], x["upto"], x["reports"]) for x in plan_batches(a, b).collect()}
    assert plan == {1: (None, at(2), 1), 4: (at(2), at(900), 1)}


class Lost(Exception):
    pass


def lose(at_point):
    def reached(point, n):
        if point == at_point:
            raise Lost

    return reached


def result(capture):
    rows = [tuple(x) for x in changes(capture).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def inputs(spark, diffs, runs):
    return reports(spark.createDataFrame(diffs, DIFF)), successful_runs(spark.createDataFrame(runs, RUN))


@pytest.mark.parametrize("point", ["plan", "sink"])
def test_a_lost_batch_is_replayed_with_its_old_ranges(spark, tmp_path, point):
    diffs = [d(1, 0, 1, {"a": "1", "b": "1"}), d(2, 2, 3, {"a": "2"}, ["b"]), d(3, 5, 6, {"c": "1"})]
    runs = [r(1, 1), r(2, 4), r(3, 7)]
    capture = file_capture(spark, f"file://{tmp_path}/state")
    assert capture.advance(*inputs(spark, diffs[:1], runs[:1])) == [0]
    with pytest.raises(Lost):
        capture.advance(*inputs(spark, diffs[:2], runs[:2]), lose(point))
    assert '"pending": [1]' in capture.status()
    assert result(capture) == brute(diffs, runs[:1])
    # more has come since: the pending batch keeps its range, the rest is a batch of its own
    assert capture.advance(*inputs(spark, diffs, runs)) == [1, 2]
    assert result(capture) == brute(diffs, runs)
    assert capture.advance(*inputs(spark, diffs, runs)) == []
    assert result(capture) == brute(diffs, runs)


def test_delivered_again_and_late_rows(spark, tmp_path):
    diffs = [d(1, 0, 1, {"a": "1"}), d(2, 2, 3, {"b": "1"})]
    runs = [r(1, 1), r(2, 4), r(3, 2000), r(4, 3000)]
    capture = file_capture(spark, f"file://{tmp_path}/state")
    capture.advance(*inputs(spark, diffs, runs[:2]))
    # 1 comes again; 3 was missed: it claims to have come before run 2, but appears only now
    late = [d(1, 0, 900, {"a": "1"}), d(3, 1, 2, {"c": "1"}), d(4, 1, 2, {"b": "0"})]
    capture.advance(*inputs(spark, diffs + late, runs[:3]))
    assert result(capture) == {(1, "a", "changed"), (2, "b", "changed"), (3, "c", "changed")}
    capture.compact()
    capture.advance(*inputs(spark, diffs + late + [d(5, 2500, 2500, None, ["a"])], runs))
    assert result(capture) == {(1, "a", "changed"), (2, "b", "changed"), (3, "c", "changed"), (4, "a", "deleted")}


def test_a_batch_reads_only_its_own_parts_and_range(spark, tmp_path):
    diffs = [d(1, 0, 1, {"a": "1"}), d(2, 0, 1, {"a": "1"}, repo="x"), d(3, 4000, 4001, {"b": "1"})]
    capture = file_capture(spark, f"file://{tmp_path}/state")
    capture.advance(*inputs(spark, diffs[:2], [r(1, 1), r(2, 1, repo="x")]))
    capture.advance(*inputs(spark, diffs, [r(1, 1), r(2, 1, repo="x"), r(3, 4002)]))
    plan = spark.read.parquet(f"file://{tmp_path}/state/plans/1/ranges").collect()
    assert [(x["run_id"], x["after"], x["low"]) for x in plan] == [(3, at(1), at(1))]
    assert len(list((tmp_path / "state/sink/batch=1").glob("part=*"))) == 1


def test_increments_equal_the_whole(spark, tmp_path):
    rng = random.Random(5)
    diffs = [d(i, s := rng.randrange(3000), s + rng.choice([0, 1, 400]), {p: rng.choice("123") for p in rng.sample("abcdef", 2)}, rng.sample("abcdef", 1), repo=rng.choice("rrq")) for i in range(120)]
    runs = [r(i, 30 * i, rng.choice(["ok", "ok", "failed", None]), repo=rng.choice("rq")) for i in range(110)]
    capture = file_capture(spark, f"file://{tmp_path}/state")
    for h in (900, 2100, 9000):
        capture.advance(*inputs(spark, [x for x in diffs if x[4] <= at(h)], [x for x in runs if x[3] <= at(h)]))
    assert result(capture) == brute(diffs, runs)
