"""Bounded traversal of the call graph.

`trails` follows edges at most once per path, as a graph database does for variable-length patterns, and
reports hops and the least confidence; `reach` is a breadth-first closure for results that need neither.
Both are loops of at most MOST_HOPS joins over the edges of the targets' workspaces, keyed by node; each hop's
front is written, so that no hop is computed again by the next, and an empty front ends the loop. Results
are rows, never arrays that grow with a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.flows import DYNAMIC
from quillgraph.session import staged

MOST_HOPS = 5
NODE = ["workspace_id", "repo", "fqn"]


def _ends(edges: DataFrame, upstream: bool) -> DataFrame:
    """edge_id, confidence, from (NODE), to (NODE) in the direction of travel."""
    near, far = ("callee", "caller") if upstream else ("caller", "callee")
    return edges.select("edge_id", "confidence", "workspace_id", F.col(f"{near}_repo").alias("repo"), F.col(f"{near}_fqn").alias("fqn"), F.col(f"{far}_repo").alias("far_repo"), F.col(f"{far}_fqn").alias("far_fqn"))


def _within(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges of the targets' workspaces."""
    return edges.join(targets.select("workspace_id").distinct(), "workspace_id", "left_semi")


def trails(edges: DataFrame, targets: DataFrame, depth: int, upstream: bool) -> DataFrame:
    """target_repo, target_fqn, workspace_id, repo, fqn, hops, min_confidence; a null confidence is ignored.

    edges: operators.resolve.call_edges; targets: NODE. Nodes may repeat, also the target, edges may not.
    """
    if not 1 <= depth <= MOST_HOPS:
        raise ValueError(f"depth must be 1 to {MOST_HOPS}")
    hop = staged(_ends(_within(edges, targets), upstream), "trail-edges")
    front = targets.select(*NODE).distinct().select(F.col("repo").alias("target_repo"), F.col("fqn").alias("target_fqn"), *NODE, F.lit(1.0).alias("min_confidence"), F.array().cast("array<bigint>").alias("path"))
    out = None
    for n in range(1, depth + 1):
        step = front.join(hop, NODE).where(~F.array_contains("path", F.col("edge_id")))
        # once two trails differ in nothing that is still to come, one is enough; after the last hop nothing is
        path = F.array_sort(F.concat("path", F.array("edge_id"))) if n < depth else F.array().cast("array<bigint>")
        front = step.select("target_repo", "target_fqn", "workspace_id", F.col("far_repo").alias("repo"), F.col("far_fqn").alias("fqn"), F.least("min_confidence", F.coalesce("confidence", F.lit(1.0))).alias("min_confidence"), path.alias("path")).distinct()
        front = staged(front, "trail-front")
        found = front.select("target_repo", "target_fqn", *NODE, F.lit(n).alias("hops"), "min_confidence").distinct()
        out = found if out is None else out.unionByName(found)
        if front.isEmpty():
            break
    return out


def _closure(edges: DataFrame, targets: DataFrame, depth: int, upstream: bool) -> DataFrame:
    """target_repo, target_fqn, NODE, hops: hop 0 is the target itself; through a cycle it is found once more."""
    hop = staged(_ends(edges, upstream).select(*NODE, "far_repo", "far_fqn").distinct(), "reach-edges")
    front = staged(targets.select(*NODE).distinct().select(F.col("repo").alias("target_repo"), F.col("fqn").alias("target_fqn"), *NODE, F.lit(0).alias("hops")), "reach-front")
    out, seen = front, None
    for n in range(1, depth + 1):
        front = front.join(hop, NODE).select("target_repo", "target_fqn", "workspace_id", F.col("far_repo").alias("repo"), F.col("far_fqn").alias("fqn"), F.lit(n).alias("hops")).distinct()
        if seen is not None:  # nodes seen before lead nowhere new
            front = front.join(seen, ["target_repo", "target_fqn", *NODE], "left_anti")
        front = staged(front.select(out.columns), "reach-front")
        if front.isEmpty():
            break
        out = out.unionByName(front)
        new = front.drop("hops")
        seen = new if seen is None else seen.unionByName(new)
    return out


def reach(edges: DataFrame, targets: DataFrame, depth: int, upstream: bool, start: bool = False) -> DataFrame:
    """target_repo, target_fqn, NODE: what a target reaches in 1 (or, with start, 0) to depth hops."""
    found = _closure(_within(edges, targets), targets, depth, upstream)
    return found.drop("hops").distinct() if start else found.where("hops > 0").drop("hops")


def impact(edges: DataFrame, http_flows: DataFrame, targets: DataFrame, depth: int = MOST_HOPS, producers: DataFrame | None = None) -> DataFrame:
    """workspace_id, target_repo, target_fqn, kind, repo, fqn, detail: callers, handled routes, inbound HTTP clients and message
    producers (workspace_id, repo, caller_fqn, topic_name) of the targets."""
    within = staged(_within(edges, targets), "impact-edges")
    up = staged(_closure(within, targets, depth, True), "impact-up")
    columns = ["workspace_id", "target_repo", "target_fqn"]
    row = lambda df, kind, repo, fqn, detail: df.select(*columns, F.lit(kind).alias("kind"), F.col(repo).alias("repo"), F.col(fqn).alias("fqn"), detail.alias("detail"))
    callers = row(up.where("hops > 0"), "upstream_symbol", "repo", "fqn", F.lit(""))
    route = F.concat_ws(" ", "method", "path_template")
    flows = http_flows.where(F.col("route_handler_fqn").isNotNull()).select("workspace_id", F.col("route_repo").alias("repo"), F.col("route_handler_fqn").alias("fqn"), "client_repo", "client_caller_fqn", route.alias("route"))
    down = _closure(within, targets, 3, False).drop("hops").distinct()
    handled = row(down.join(flows.select(*NODE, "route").distinct(), NODE), "handled_route", "repo", "fqn", F.col("route"))
    # a handler whose calls reach the target is upstream of it
    sources = up.drop("hops").distinct()
    inbound = row(sources.join(flows.distinct(), NODE), "http_inbound", "client_repo", "client_caller_fqn", F.col("route"))
    out = callers.unionByName(handled).unionByName(inbound)
    if producers is not None:
        writes = producers.select("workspace_id", "repo", F.col("caller_fqn").alias("fqn"), "topic_name").where("fqn IS NOT NULL AND topic_name IS NOT NULL").distinct()
        out = out.unionByName(row(sources.join(writes, NODE), "kafka_inbound", "repo", "fqn", F.col("topic_name")))
    return out.distinct()


def trace_http(http_flows: DataFrame, edges: DataFrame, depth: int = 3, workspace: str | None = None, method: str | None = None, path: str | None = None) -> DataFrame:
    """workspace_id, route_repo, method, path_template, role (handler, caller or downstream), repo, fqn, match_score (of callers).

    Of all routes, or of a workspace's with the path and a method that meets theirs: equal, or * on either side.
    Roles are found by themselves, so that they don't multiply. A route without any of them has one row of nulls.
    """
    key = ["workspace_id", "route_repo", "method", "path_template"]
    if workspace is not None:
        http_flows = http_flows.where(F.col("workspace_id") == workspace)
    if path is not None:
        http_flows = http_flows.where(F.col("path_template") == path)
    if method is not None and method != "*":
        http_flows = http_flows.where(F.col("method").isin(method.upper(), "*"))
    row = lambda df, role, repo, fqn, score: df.select(*key, F.lit(role).alias("role"), F.col(repo).alias("repo"), F.col(fqn).alias("fqn"), score.cast("double").alias("match_score"))
    none = F.lit(None)
    handlers = http_flows.where(F.col("route_handler_fqn").isNotNull() & (F.col("route_handler_fqn") != "")).select(*key, F.col("route_handler_fqn").alias("handler")).distinct()
    callers = http_flows.where(F.col("client_caller_fqn").isNotNull()).groupBy(*key, "client_repo", "client_caller_fqn").agg(F.max("match_score").alias("score"))
    starts = handlers.select("workspace_id", F.col("route_repo").alias("repo"), F.col("handler").alias("fqn")).distinct()
    down = reach(edges, starts, depth, False).select("workspace_id", F.col("target_repo").alias("route_repo"), F.col("target_fqn").alias("handler"), "repo", "fqn")
    down = handlers.join(down, ["workspace_id", "route_repo", "handler"])
    found = row(handlers, "handler", "route_repo", "handler", none).unionByName(row(callers, "caller", "client_repo", "client_caller_fqn", F.col("score"))).unionByName(row(down, "downstream", "repo", "fqn", none).distinct())
    return http_flows.select(*key).distinct().join(found, key, "left")


def trace_topic(producers: DataFrame, consumers: DataFrame, workspace: str | None = None, topic: str | None = None) -> DataFrame:
    """workspace_id, topic_name, role (producer or consumer), repo, caller_fqn: who writes and who reads each known topic."""
    out = []
    for role, df in (("producer", producers), ("consumer", consumers)):
        known = df.where(F.col("topic_name").isNotNull() & (F.col("topic_name") != DYNAMIC))
        if workspace is not None:
            known = known.where(F.col("workspace_id") == workspace)
        if topic is not None:
            known = known.where(F.col("topic_name") == topic)
        out.append(known.select("workspace_id", "topic_name", F.lit(role).alias("role"), "repo", "caller_fqn").distinct())
    return out[0].unionByName(out[1])
