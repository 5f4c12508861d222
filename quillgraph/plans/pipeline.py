"""Indexing: from source files to the stored tables, in full or by what has changed.

Facts are extracted once per (changed) file. Calls and flows are derived again from the stored facts of the whole
workspace, so an increment gives the same tables as a full run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import stable_id
from quillgraph.operators import chunking, flows, incremental, resolve
from quillgraph.operators.extract import extract, facts_of
from quillgraph.operators.incremental import Store
from quillgraph.session import staged
from quillgraph.operators.catalog import CountCache
from quillgraph.sources import checkout, schema
from quillgraph.sources.manifest import Manifest
from quillgraph.sources.tree import SourceTree

FACT_TABLES = ["file", "module", "symbol", "import", "call_site", "route", "http_client_call", "producer", "consumer", "chunk"]


@dataclass
class Report:
    """Rows per table, the same per repository (with its known topics), and the files that were read, left as they were, and
    deleted."""

    tables: dict[str, int] = field(default_factory=dict)
    repositories: dict[str, dict[str, int]] = field(default_factory=dict)
    changed: int = 0
    unchanged: int = 0
    deleted: int = 0


def scan(spark: SparkSession, manifest: Manifest, workspace: str, only: str | None = None, checkouts: str | None = None) -> DataFrame:
    """workspace_id, repo, file_path, lang, size_bytes, line_count, text, hash of a workspace's repositories.

    checkouts: a folder that all executors share, for the repositories that have a url; without it they are refused.
    """
    spark.dataSource.register(SourceTree)
    parts = []
    for r in manifest.workspace(workspace).repositories:
        if only is not None and r.name != only:
            continue
        if r.path is None and checkouts is None:
            raise ValueError(f"{r.name} has no local path, and there is no folder for checkouts")
        options = {"path": r.path or checkout.checkout(checkouts, workspace, r).path} | ({"languages": ",".join(r.languages)} if r.languages else {})
        tree = spark.read.format("source_tree").options(**options).load()
        parts.append(tree.select(F.lit(workspace).alias("workspace_id"), F.lit(r.name).alias("repo"), "*", F.sha2("text", 256).alias("hash")))
    if not parts:
        raise KeyError(only)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fact_tables(files: DataFrame, provider: str | None = None) -> dict[str, DataFrame]:
    """The fact tables of the given files."""
    numbered = files.withColumn("file_id", F.xxhash64("workspace_id", "repo", "file_path"))
    facts = staged(extract(numbered), "pipeline-facts")
    place = [F.col(c) for c in ("workspace_id", "repo", "file_path", "start_line")]
    kind = lambda name: facts_of(facts, name)
    symbols = resolve.last_of_each(kind("symbol").withColumnRenamed("symbol_kind", "kind"), ["workspace_id", "repo", "fqn"], ["file_path", "seq"])
    chunks = chunking.chunk_files(numbered.withColumnRenamed("file_path", "repo_relative_path"), numbered, symbols)
    if provider:
        chunks = chunking.embed(chunks, provider=provider, check=True)
    with_id = lambda df, name, prefix, *more: df.withColumn(name, stable_id(prefix, *place, F.col("seq"), *[F.col(m) for m in more]))
    tables = {
        "file": files,
        "module": kind("module").withColumnRenamed("symbol_kind", "kind"),
        "symbol": symbols,
        "import": kind("import"),
        "call_site": with_id(kind("call"), "call_id", "call"),
        "route": with_id(kind("route"), "route_id", "route", "method", "path"),
        "http_client_call": with_id(kind("client"), "call_id", "httpc", "method", "path"),
        "producer": with_id(kind("producer"), "producer_id", "kp", "topic_name"),
        "consumer": with_id(kind("consumer"), "consumer_id", "kc", "topic_name"),
        "chunk": chunks,
    }
    return {name: schema.conform(df, name) for name, df in tables.items()}


def derive(store: Store, workspace: str) -> dict[str, DataFrame]:
    """calls, http_flow and topic_flow of a workspace from its stored facts."""
    of = lambda name: store.read(name).where(F.col("workspace_id") == workspace)
    sites, symbols = of("call_site"), of("symbol")
    found = resolve.resolve(sites, of("import"), symbols)
    calls = found.join(sites, "call_id").withColumnsRenamed({"repo": "caller_repo"})
    known = symbols.select(F.col("repo").alias("caller_repo"), F.col("fqn").alias("caller_fqn")).distinct()
    calls = calls.join(known, ["caller_repo", "caller_fqn"], "left_semi")  # a module's own calls have no symbol to come from
    http = flows.http_flows(of("http_client_call"), of("route")).withColumn("workspace_id", F.lit(workspace))
    topics = flows.topic_flows(of("producer"), of("consumer")).withColumn("workspace_id", F.lit(workspace))
    return {"calls": schema.conform(calls, "calls"), "http_flow": schema.conform(http, "http_flow"), "topic_flow": schema.conform(topics, "topic_flow")}


def _derive_all(store: Store, workspace: str, report: Report) -> None:
    for name, df in derive(store, workspace).items():
        store.clear(name, {"workspace_id": workspace})
        store.refresh(name, df, ("workspace_id",))


def _count(store: Store, workspace: str, report: Report, cache: CountCache | None = None) -> Report:
    """All counts in one job; what was cached of the workspace is out of date now."""
    out = None
    of = lambda name: store.read(name).where(F.col("workspace_id") == workspace)
    for name in [*FACT_TABLES, "calls", "http_flow", "topic_flow"]:
        df = of(name)
        repo = F.col("repo") if "repo" in df.columns else F.col("caller_repo") if "caller_repo" in df.columns else F.lit(None).cast("string")
        one = df.select(F.lit(name).alias("name"), repo.cast("string").alias("repo")).groupBy("name", "repo").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    topics = flows.topic_counts(of("producer"), of("consumer")).select(F.lit("topic").alias("name"), F.col("repo").cast("string").alias("repo"), F.col("topics").alias("n"))
    for r in out.unionByName(topics).collect():  # tables times the manifest's repositories
        if r["name"] != "topic":
            report.tables[r["name"]] = report.tables.get(r["name"], 0) + r["n"]
        if r["repo"] is not None:
            report.repositories.setdefault(r["repo"], {})[r["name"]] = r["n"]
    for name in [*FACT_TABLES, "calls", "http_flow", "topic_flow"]:
        report.tables.setdefault(name, 0)
    if cache is not None:
        cache.invalidate(workspace)
    return report


def index_full(spark: SparkSession, store: Store, files: DataFrame, workspace: str, provider: str | None = None, cache: CountCache | None = None) -> Report:
    """Replaces the given files' repositories in all tables, and the workspace's calls and flows."""
    files = staged(files, "pipeline-files")
    repos = [r["repo"] for r in files.select("repo").distinct().collect()]  # the manifest's, so few
    for name, df in fact_tables(files, provider).items():
        for repo in repos:
            store.clear(name, {"workspace_id": workspace, "repo": repo})
        store.refresh(name, df)
    report = Report(changed=files.count())
    _derive_all(store, workspace, report)
    return _count(store, workspace, report, cache)


def index_incremental(spark: SparkSession, store: Store, files: DataFrame, workspace: str, provider: str | None = None, cache: CountCache | None = None) -> Report:
    """Reads only files whose hash differs from the stored one; what they held before goes, deleted files too."""
    files = staged(files, "pipeline-files")
    key = ["workspace_id", "repo", "file_path"]
    repos = files.select("workspace_id", "repo").distinct()
    stored = store.read("file").join(repos, ["workspace_id", "repo"], "left_semi")
    diff = staged(incremental.file_diff(stored, files, key, "hash"), "pipeline-diff")
    states = {r["state"]: r["n"] for r in diff.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = Report(changed=states.get("changed", 0), unchanged=states.get("unchanged", 0), deleted=states.get("deleted", 0))
    touched = diff.where("state <> 'unchanged'")
    if report.changed + report.deleted:
        fresh = fact_tables(files.join(diff.where("state = 'changed'"), key, "left_semi"), provider)
        for name, df in fresh.items():
            store.merge(name, df, touched, key)
        _derive_all(store, workspace, report)
    return _count(store, workspace, report, cache)
