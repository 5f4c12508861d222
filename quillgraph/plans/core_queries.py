"""Registered queries of the core's change capture and reference checks, with their SQL."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from quillgraph.operators import change_capture, orphan_refs
from quillgraph.session import shared_folder
from quillgraph.sources.tables import table


def p1_found(spark, folder):
    return change_capture.changed_files(table(spark, folder, "file_diff"), table(spark, folder, "index_run"))


def p1_replayed(spark, folder):
    """p1_found in three increments, with failures: the first is lost after its plan, the second before its commit,
    the third is given again, and every third report is delivered twice."""
    diffs, runs = table(spark, folder, "file_diff"), table(spark, folder, "index_run")
    twice = diffs.where("diff_id % 3 = 0").withColumn("arrived_at", F.expr("arrived_at + INTERVAL 5 DAYS"))
    log, ok = change_capture.reports(diffs.unionByName(twice)), change_capture.successful_runs(runs)
    capture = change_capture.file_capture(spark, f"{shared_folder(spark)}/stage/replayed-{uuid.uuid4().hex}")
    cuts = ok.agg(F.expr("percentile_approx(started_at, array(0.4D, 0.7D))")).first()[0] or []
    for cut, lost in zip([*cuts, None], ["plan", "sink", ""], strict=False):
        known = (log, ok) if cut is None else (log.where(F.col("arrived_at") <= F.lit(cut)), ok.where(F.col("started_at") <= F.lit(cut)))

        def fail(point, n, lost=lost):
            if point == lost:
                raise InterruptedError(lost)

        with contextlib.suppress(InterruptedError):
            capture.advance(*known, fail)
        capture.advance(*known)
    return change_capture.changes(capture)


def p1_plan(spark, folder):
    return change_capture.plan_batches(table(spark, folder, "file_diff"), table(spark, folder, "index_run"))


def _refs(spark, folder):
    return orphan_refs.references(*[table(spark, folder, t) for t in ("resolved_call", "import_ref", "http_flow_edge")])


def p5_found(spark, folder):
    found = orphan_refs.orphans(_refs(spark, folder), table(spark, folder, "symbol_def"))
    return found.select("ref_table", "ref_id", "reason")


def p5_rates(spark, folder):
    refs = _refs(spark, folder)
    return orphan_refs.orphan_rates(refs, orphan_refs.orphans(refs, table(spark, folder, "symbol_def")))


_ENTRIES = """
ok AS (SELECT DISTINCT run_id, workspace_id, repo_name, started_at FROM index_run WHERE status = 'ok'),
d AS (SELECT diff_id, any_value(workspace_id) AS workspace_id, any_value(repo_name) AS repo_name, any_value(observed_at) AS observed_at,
  min(arrived_at) AS arrived_at, any_value(changed_paths) AS changed_paths, any_value(deleted_paths) AS deleted_paths, any_value(new_hashes) AS new_hashes
  FROM file_diff GROUP BY diff_id)"""

SQL = {
    "p1_found": f"""
WITH {_ENTRIES},
e AS (SELECT workspace_id, repo_name, observed_at, arrived_at, diff_id, p AS path, coalesce(new_hashes[p], '') AS hash FROM (SELECT *, unnest(changed_paths) AS p FROM d)
  UNION ALL SELECT workspace_id, repo_name, observed_at, arrived_at, diff_id, unnest(deleted_paths) AS path, NULL AS hash FROM d),
v AS (SELECT e.*, ok.run_id, ok.started_at FROM e ASOF JOIN ok ON e.workspace_id = ok.workspace_id AND e.repo_name = ok.repo_name AND e.arrived_at <= ok.started_at),
s AS (SELECT workspace_id, repo_name, path, run_id, started_at, max({{'o': observed_at, 'd': diff_id, 'h': hash}}) AS st FROM v GROUP BY ALL),
w AS (SELECT *, max(st) OVER (PARTITION BY workspace_id, repo_name, path ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS now,
  max(st) OVER (PARTITION BY workspace_id, repo_name, path ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s)
SELECT run_id, path AS repo_relative_path, CASE WHEN now.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM w WHERE now.h IS DISTINCT FROM was.h""",
    "p1_plan": f"""
WITH {_ENTRIES},
n AS (SELECT ok.run_id, count(*) AS reports FROM d ASOF JOIN ok ON d.workspace_id = ok.workspace_id AND d.repo_name = ok.repo_name AND d.arrived_at <= ok.started_at GROUP BY 1)
SELECT ok.run_id, workspace_id, repo_name, lag(started_at) OVER (PARTITION BY workspace_id, repo_name ORDER BY started_at, run_id) AS after,
  started_at AS upto, coalesce(reports, 0) AS reports FROM ok LEFT JOIN n USING (run_id)""",
}
SQL["p1_replayed"] = SQL["p1_found"]
_P5 = """
WITH refs AS (
  SELECT DISTINCT 'resolved_call' AS ref_table, call_id AS ref_id, workspace_id, callee_repo AS repo, callee_fqn AS fqn, seen_at FROM resolved_call
  UNION ALL SELECT DISTINCT 'import_ref', import_id, workspace_id, NULL, resolved_fqn, seen_at FROM import_ref
  UNION ALL SELECT DISTINCT 'http_flow_edge', flow_id, workspace_id, route_repo, route_handler_fqn, seen_at FROM http_flow_edge),
r AS (SELECT * FROM refs WHERE fqn IS NOT NULL AND fqn <> '' AND NOT regexp_matches(fqn, '^<[^<>]*>')),
j AS (SELECT r.ref_table, r.ref_id, r.seen_at, count(s.fqn) AS n,
  count(CASE WHEN s.indexed_at <= r.seen_at AND (s.deleted_at IS NULL OR s.deleted_at > r.seen_at) THEN 1 END) AS alive,
  count(CASE WHEN s.indexed_at <= r.seen_at THEN 1 END) AS before
  FROM r LEFT JOIN symbol_def s ON s.workspace_id = r.workspace_id AND s.fqn = r.fqn AND (r.ref_table = 'import_ref' OR s.repo = r.repo) GROUP BY ALL),
f AS (SELECT ref_table, ref_id, seen_at, CASE WHEN n = 0 THEN 'missing' WHEN before > 0 THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE alive = 0)"""
SQL["p5_found"] = _P5 + " SELECT ref_table, ref_id, reason FROM f"
SQL["p5_rates"] = (
    _P5
    + """, b AS (SELECT ref_table, date_trunc('month', seen_at)::DATE AS period, count(*) AS refs FROM r GROUP BY ALL),
o AS (SELECT ref_table, date_trunc('month', seen_at)::DATE AS period, count(CASE WHEN reason = 'missing' THEN 1 END) AS missing,
  count(CASE WHEN reason = 'deleted' THEN 1 END) AS deleted, count(CASE WHEN reason = 'late' THEN 1 END) AS late FROM f GROUP BY ALL)
SELECT ref_table, period, refs, coalesce(missing, 0) AS missing, coalesce(deleted, 0) AS deleted, coalesce(late, 0) AS late FROM b LEFT JOIN o USING (ref_table, period)"""
)
QUERIES = {"p1_found": p1_found, "p1_replayed": p1_replayed, "p1_plan": p1_plan, "p5_found": p5_found, "p5_rates": p5_rates}
