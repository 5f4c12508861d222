"""The engine's questions with their arguments: each takes the stored tables and a workspace and returns a dict.

Single facts are values; what can be large is a DataFrame under its name, so nothing is collected but the
candidates of a lookup (at most MOST_CANDIDATES). Arguments are checked first and refused with ValueError.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_path
from quillgraph.operators import adhoc, catalog, search, traverse

MODES, DIRECTIONS = ("exact", "suffix", "fuzzy", "auto"), ("callers", "callees", "both")


def _candidates(symbols: DataFrame, workspace: str, name: str, mode: str, limit: int) -> tuple[list[dict], str | None]:
    """The symbols that a name may mean, best first, and the mode that found them."""
    adhoc.safe_workspace(workspace)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    (adhoc.safe_identifier if mode in ("exact", "suffix") else adhoc.safe_search_text)(name)
    rows = [r.asDict() for r in search.find_symbols(symbols, name, mode, limit, workspace).collect()]
    return rows, rows[0]["match_mode"] if rows else None


def _node(symbols: DataFrame, row: dict) -> DataFrame:
    return symbols.sparkSession.createDataFrame([tuple(row[c] for c in traverse.NODE)], "workspace_id string, repo string, fqn string")


def call_graph(edges: DataFrame, symbols: DataFrame, workspace: str, name: str, depth: int = 2, direction: str = "both", mode: str = "exact", max_candidates: int = 10) -> dict:
    """target, callers, callees (rows of traverse.trails), candidates, match_mode_used. The best candidate is the target."""
    if direction not in DIRECTIONS or not 1 <= depth <= traverse.MOST_HOPS:
        raise ValueError("direction or depth isn't allowed")
    rows, used = _candidates(symbols, workspace, name, mode, max_candidates)
    out = {"target": rows[0] if rows else None, "callers": None, "callees": None, "candidates": rows, "match_mode_used": used}
    for side, upstream in (("callers", True), ("callees", False)):
        if rows and direction in (side, "both"):
            out[side] = traverse.trails(edges, _node(symbols, rows[0]), depth, upstream)
    return out


def impact_analysis(edges: DataFrame, symbols: DataFrame, http_flows: DataFrame, producers: DataFrame | None, workspace: str, name: str, mode: str = "exact", max_candidates: int = 10) -> dict:
    """target, impact (rows of traverse.impact), candidates, match_mode_used."""
    rows, used = _candidates(symbols, workspace, name, mode, max_candidates)
    found = traverse.impact(edges, http_flows, _node(symbols, rows[0]), producers=producers) if rows else None
    return {"target": rows[0] if rows else None, "impact": found, "candidates": rows, "match_mode_used": used}


def trace_http_flow(http_flows: DataFrame, edges: DataFrame, workspace: str, method: str, path: str) -> dict:
    """method and path as they are looked for, and flows (rows of traverse.trace_http)."""
    adhoc.safe_workspace(workspace)
    if not method or not method.strip():
        raise ValueError("a method is needed")
    wanted = http_flows.sparkSession.range(1).select(normalize_path(F.lit(path)).alias("p")).first()["p"]
    adhoc.safe_identifier(wanted)
    return {"method": method.strip().upper(), "path": wanted, "flows": traverse.trace_http(http_flows, edges, 3, workspace, method.strip().upper(), wanted)}


def trace_topic_flow(producers: DataFrame, consumers: DataFrame, workspace: str, topic: str) -> dict:
    adhoc.safe_workspace(workspace)
    adhoc.safe_identifier(topic)
    return {"topic": topic, "flows": traverse.trace_topic(producers, consumers, workspace, topic)}


def semantic_code_search(index: search.LexicalIndex, symbols: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], workspace: str, query: str, limit: int = 10, lexical_k: int = 30, vector_k: int = 30) -> dict:
    """hits (rows of search.code_search, None for a blank query), lexical_k, vector_k."""
    adhoc.safe_workspace(workspace)
    hits = None
    if query and query.strip():
        asked = symbols.sparkSession.createDataFrame([(0, workspace, query)], "query_id int, workspace_id string, text string")
        hits = search.code_search(index, symbols, chunks, asked, embed, limit, lexical_k, vector_k).orderBy(F.col("rrf_score").desc())
    return {"hits": hits, "lexical_k": lexical_k, "vector_k": vector_k}


def workspace_manage(tables: dict[str, tuple[DataFrame, list[str]]], files: DataFrame, action: str, workspace: str | None = None, cache: catalog.CountCache | None = None) -> dict:
    """list: workspaces with their repositories. stats: counts per label of one workspace; a workspace that isn't there has none."""
    if action == "list":
        return {"workspaces": catalog.workspaces(files)}
    if action != "stats" or not workspace:
        raise ValueError("action is list, or stats with a workspace")
    adhoc.safe_workspace(workspace)
    repos = files.where(F.col("workspace_id") == workspace).select("repo").distinct().count()
    if not repos:
        return {"workspace": None, "stats": {}}
    cache = cache or catalog.CountCache()
    count = lambda label: cache.get(workspace, "node", label, True, lambda: catalog.counts({label: tables[label]}, workspace).first()["n"])[0]
    return {"workspace": workspace, "stats": {"repos": repos} | {label: count(label) for label in tables}}
