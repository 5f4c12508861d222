"""Schema catalog, counts and workspace statistics."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Node labels and their unique keys: constraint name -> (label, key).
CONSTRAINTS = {
    "workspace_key": ("workspace", ["workspace_id"]),
    "repository_key": ("repository", ["workspace_id", "repo"]),
    "commit_key": ("commit", ["workspace_id", "repo", "commit_sha"]),
    "file_key": ("file", ["workspace_id", "repo", "file_path"]),
    "module_key": ("module", ["workspace_id", "repo", "fqn"]),
    "symbol_key": ("symbol", ["workspace_id", "repo", "fqn"]),
    "chunk_key": ("chunk", ["chunk_id"]),
    "topic_key": ("topic", ["workspace_id", "topic_name"]),
    "route_key": ("route", ["route_id"]),
    "http_client_key": ("http_client_call", ["call_id"]),
    "producer_key": ("producer", ["producer_id"]),
    "consumer_key": ("consumer", ["consumer_id"]),
}
#: What is organised for lookups: name -> (kind, label, properties). Tables are sorted or partitioned so, or have an index of their own.
INDEXES = {
    "symbol_name": ("range", "symbol", ["name"]),
    "file_language": ("range", "file", ["lang"]),
    "route_method_path": ("range", "route", ["method", "path"]),
    "chunk_workspace": ("partition", "chunk", ["workspace_id"]),
    "producer_workspace": ("partition", "producer", ["workspace_id", "repo"]),
    "consumer_workspace": ("partition", "consumer", ["workspace_id", "repo"]),
    "symbol_text": ("lexical", "symbol", ["name", "signature", "docstring"]),
    "chunk_embedding": ("vector", "chunk", ["embedding"]),
}
#: Node tables of a data folder and their keys.
NODES = {"file": ["workspace_id", "repo", "repo_relative_path"], "symbol": ["workspace_id", "repo", "fqn"], "chunk": ["chunk_id"]}
#: All types of edges.
EDGES = ["CALLS", "CONSUMES", "CONTAINS", "DEFINES", "DEFINES_MODULE", "ENCLOSES", "HANDLES", "HAS_CHUNK", "HAS_COMMIT", "HTTP_FLOW", "IMPORTS", "INVOKES", "KAFKA_FLOW", "PRODUCES", "READS_FROM", "WRITES_TO"]
_TYPES = {"string": "String", "bigint": "Long", "int": "Long", "double": "Double", "boolean": "Boolean", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "array<float>": "DoubleArray", "array<string>": "StringArray"}


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def property_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """label, property, types, mandatory: mandatory where no row of the label lacks it. One aggregate per table."""
    out = []
    for label, df in tables.items():
        held = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"p{i}") for i, c in enumerate(df.columns)])
        rows = F.array(*[F.struct(F.lit(c).alias("property"), F.array(F.lit(_TYPES.get(t, t))).alias("types"), ((F.col("n") > 0) & (F.col(f"p{i}") == F.col("n"))).alias("mandatory")) for i, (c, t) in enumerate(df.dtypes)])
        out.append(held.select(F.lit(label).alias("label"), F.explode(rows).alias("p")).select("label", "p.*"))
    return fold_properties(union(out))


def fold_properties(rows: DataFrame) -> DataFrame:
    """label, property, types (sorted union), mandatory (of all): for rows of label, property, types, mandatory."""
    return rows.groupBy("label", "property").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.bool_and("mandatory").alias("mandatory"))


def edge_catalog(edges: list[tuple[str, str, str, DataFrame]], workspace: str | None = None) -> DataFrame:
    """rel, start, end, n of the edge types and ends that occur, in one workspace or all.

    edges: type, label of the start, label of the end, and a DataFrame of them with the start's workspace_id.
    """
    out = []
    for rel, start, end, df in edges:
        scoped = df if workspace is None else df.where(F.col("workspace_id") == workspace)
        out.append(scoped.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rel).alias("rel"), F.lit(start).alias("start"), F.lit(end).alias("end"), "n"))
    return union(out).where("n > 0")


def edge_types(catalogued: DataFrame) -> DataFrame:
    """rel, ends (sorted), n: every type that there can be, and every one that occurs; n is null where none does."""
    spark = catalogued.sparkSession
    known = spark.createDataFrame([(x,) for x in EDGES], "rel string")
    found = catalogued.groupBy("rel").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(">", "start", "end"))), ",").alias("ends"), F.sum("n").alias("n"))
    return known.join(found, "rel", "full").select("rel", F.coalesce("ends", F.lit("")).alias("ends"), "n")


def constraints(spark) -> DataFrame:
    """name, label, properties of the unique keys."""
    return spark.createDataFrame([(n, label, key) for n, (label, key) in CONSTRAINTS.items()], "name string, label string, properties array<string>")


def indexes(spark) -> DataFrame:
    """name, kind, label, properties."""
    return spark.createDataFrame([(n, *x) for n, x in INDEXES.items()], "name string, kind string, label string, properties array<string>")


def graph_schema(nodes: dict[str, tuple[DataFrame, list[str]]], edges: list[tuple[str, str, str, DataFrame]], workspace: str | None = None, include_counts: bool = True) -> dict[str, DataFrame | str | None]:
    """node_properties, node_counts, edge_ends, edge_types, constraints, indexes (DataFrames) and counts_scope."""
    spark = next(iter(nodes.values()))[0].sparkSession
    ends = edge_catalog(edges, workspace)
    types = edge_types(ends)
    scope = "disabled" if not include_counts else "global" if workspace is None else "workspace"
    return {"node_properties": property_catalog({label: df for label, (df, _) in nodes.items()}), "node_counts": counts(nodes, workspace) if include_counts else None, "edge_ends": ends if include_counts else ends.drop("n"), "edge_types": types if include_counts else types.drop("n"), "constraints": constraints(spark), "indexes": indexes(spark), "counts_scope": scope}


def counts(tables: dict[str, tuple[DataFrame, list[str]]], workspace: str | None = None) -> DataFrame:
    """label, n: rows per label by its key, of one workspace or of all; a label without workspace counts globally."""
    out = []
    for label, (df, key) in tables.items():
        scoped = df.where(F.col("workspace_id") == workspace) if workspace is not None and "workspace_id" in df.columns else df
        out.append(scoped.select(*key).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n"))
    return union(out)


def counts_by_workspace(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """label, workspace_id, n: rows per label and workspace by its key; labels without workspace are left out."""
    out = []
    for label, (df, key) in tables.items():
        if "workspace_id" in df.columns:
            per = df.select("workspace_id", *[k for k in key if k != "workspace_id"]).distinct().groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))
            out.append(per.select(F.lit(label).alias("label"), "workspace_id", "n"))
    return union(out)


def workspaces(files: DataFrame) -> DataFrame:
    """workspace_id with the sorted names of its repositories."""
    return files.where(F.col("workspace_id").isNotNull()).groupBy("workspace_id").agg(F.array_join(F.sort_array(F.collect_set("repo")), ",").alias("repos"))


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """label, duplicates: keys that more than one row has, for the uniqueness constraints."""
    out = []
    for label, (df, key) in tables.items():
        many = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(many.agg(F.count(F.lit(1)).alias("duplicates")).select(F.lit(label).alias("label"), "duplicates"))
    return union(out)


class CountCache:
    """Counts by (workspace, kind, name, scoped) for ttl seconds; ttl 0 keeps nothing, failures are not kept."""

    def __init__(self, ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self._clock, self._kept, self._lock = ttl, clock, {}, threading.RLock()

    def get(self, workspace: str | None, kind: str, name: str, scoped: bool, compute: Callable[[], int], refresh: bool = False) -> tuple[int, bool]:
        """(count, whether it was cached)."""
        key = (workspace if scoped else None, kind, name, scoped)
        with self._lock:
            kept = self._kept.get(key)
            if kept and not refresh and self.ttl > 0 and self._clock() - kept[1] < self.ttl:
                return kept[0], True
        value = compute()
        if self.ttl > 0:
            with self._lock:
                self._kept[key] = (value, self._clock())
        return value, False

    def invalidate(self, workspace: str) -> int:
        """Drops a workspace's counts and the global ones; returns how many."""
        with self._lock:
            gone = [k for k in self._kept if k[0] in (workspace, None)]
            for k in gone:
                del self._kept[k]
            return len(gone)

    def __len__(self) -> int:
        return len(self._kept)
