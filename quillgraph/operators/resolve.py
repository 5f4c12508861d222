"""Resolving call sites to symbols: five ranked strategies, the first that hits decides.

All strategies are equi joins made in one go: the candidates of a call by full name (same module, import)
are looked up together, those by simple name through counts, first name parts and name suffixes, so that
no call meets all symbols that share its simple name. Hits in the caller's repository come first, then
the smallest repository and name; the defining repository is reported.

Null call texts or callers resolve to nothing; duplicate symbols count once; empty tables give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import last_part, module_of, prefixes

# Strategies and their confidences, in order.
CONFIDENCE = {"same-module": 0.95, "import-suffix": 0.90, "unique-global": 0.85, "suffix-distance": 0.75, "syntactic-fallback": 0.55}


def symbol_index(symbols: DataFrame) -> DataFrame:
    """One row per (workspace_id, repo, fqn) with its simple name."""
    return symbols.dropna(subset=["workspace_id", "repo", "fqn"]).groupBy("workspace_id", "repo", "fqn").agg(F.min("name").alias("name"))


def import_map(imports: DataFrame) -> DataFrame:
    """(workspace_id, repo, file_path, local_name) -> target_fqn; the last import of a file wins; wildcards bind nothing."""
    named = imports.where(F.col("local_name").isNotNull() & ~F.col("local_name").isin("", "*"))
    return named.groupBy("workspace_id", "repo", "file_path", "local_name").agg(F.max_by("target_fqn", F.struct("seq", "target_fqn")).alias("target_fqn"))


def resolve(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, callee_repo, callee_fqn, strategy, confidence of the calls that resolve.

    calls: call_id, workspace_id, repo, file_path, caller_fqn, call_text.
    """
    index = symbol_index(symbols)
    text = F.col("call_text")
    chain = calls.where(text.isNotNull() & F.col("caller_fqn").isNotNull()).withColumn("simple", last_part(text)).withColumn("head", F.substring_index(text, ".", 1))
    bound = import_map(imports).withColumnRenamed("local_name", "head")
    chain = chain.join(bound, ["workspace_id", "repo", "file_path", "head"], "left")
    bare = F.instr(text, ".") == 0
    module = module_of(F.col("caller_fqn"))
    rest = F.expr("substring(call_text, instr(call_text, '.') + 1)")
    by_name = F.array_compact(
        F.array(
            F.when(bare & (module != ""), F.struct(F.lit("same-module").alias("strategy"), F.concat(module, F.lit("."), text).alias("fqn"))),
            F.when(F.col("target_fqn").isNotNull(), F.struct(F.lit("import-suffix").alias("strategy"), F.when(bare, F.col("target_fqn")).otherwise(F.concat("target_fqn", F.lit("."), rest)).alias("fqn"))),
        )
    )
    full = chain.select("call_id", "workspace_id", F.col("repo").alias("own"), F.explode(by_name).alias("c")).select("call_id", "workspace_id", "own", "c.*").join(index.drop("name"), ["workspace_id", "fqn"])
    rank = F.when(F.col("strategy") == "same-module", 1).otherwise(2)
    hits = full.select("call_id", F.struct(rank.alias("rank"), (F.col("repo") != F.col("own")).alias("away"), "repo", "fqn", "strategy").alias("hit"))

    named = index.groupBy("workspace_id", F.col("name").alias("simple")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("repo", "fqn")).alias("only"))
    counted = chain.select("call_id", "workspace_id", "caller_fqn", "simple", "call_text").join(named, ["workspace_id", "simple"])
    unique = counted.where("n = 1").select("call_id", F.struct(F.lit(3).alias("rank"), F.lit(False).alias("away"), F.col("only.repo").alias("repo"), F.col("only.fqn").alias("fqn"), F.lit("unique-global").alias("strategy")).alias("hit"))
    # the best symbol of every prefix of a name is kept, and a caller takes that of its longest prefix that has one: no
    # caller meets all symbols of a hot name. Equal callers are compared once
    near = counted.where("n > 1").select("workspace_id", "caller_fqn", "simple").distinct()
    pool = index.select("workspace_id", F.col("name").alias("simple"), F.struct(F.size(F.split("fqn", r"\.")).alias("b"), "repo", "fqn").alias("own"), F.explode(prefixes(F.col("fqn"))).alias("prefix"))
    pool = pool.groupBy("workspace_id", "simple", "prefix").agg(F.min("own").alias("best"))
    met = near.withColumn("prefix", F.explode(prefixes(F.col("caller_fqn")))).join(pool, ["workspace_id", "simple", "prefix"])
    best = met.groupBy("workspace_id", "caller_fqn", "simple").agg(F.max_by("best", F.length("prefix")).alias("best"))
    distance = counted.where("n > 1").join(best, ["workspace_id", "caller_fqn", "simple"]).select("call_id", F.struct(F.lit(4).alias("rank"), F.lit(False).alias("away"), F.col("best.repo").alias("repo"), F.col("best.fqn").alias("fqn"), F.lit("suffix-distance").alias("strategy")).alias("hit"))
    # a symbol is found by each of its dotted suffixes that end in its simple name
    names = F.split("fqn", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    ends = index.where(last_part(F.col("fqn")) == F.col("name")).select("workspace_id", "repo", "fqn", F.explode(suffixes).alias("call_text"))
    ends = ends.groupBy("workspace_id", "call_text").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("repo", "fqn")).alias("only")).where("n = 1")
    fallback = chain.where(~bare).select("call_id", "workspace_id", "call_text").join(ends, ["workspace_id", "call_text"]).select("call_id", F.struct(F.lit(5).alias("rank"), F.lit(False).alias("away"), F.col("only.repo").alias("repo"), F.col("only.fqn").alias("fqn"), F.lit("syntactic-fallback").alias("strategy")).alias("hit"))
    first = hits.unionByName(unique).unionByName(distance).unionByName(fallback).groupBy("call_id").agg(F.min("hit").alias("hit"))
    confidence = F.coalesce(*[F.when(F.col("hit.strategy") == s, F.lit(c)) for s, c in CONFIDENCE.items()])
    return first.select("call_id", F.col("hit.repo").alias("callee_repo"), F.col("hit.fqn").alias("callee_fqn"), F.col("hit.strategy").alias("strategy"), confidence.alias("confidence"))


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """import_id, resolved_repo, resolved_fqn (null if the target is no symbol): own repository first, then the smallest."""
    index = symbol_index(symbols).select("workspace_id", F.col("repo").alias("found"), F.col("fqn").alias("target_fqn"))
    joined = imports.join(index, ["workspace_id", "target_fqn"], "left")
    best = F.min(F.when(F.col("found").isNotNull(), F.struct((F.col("found") != F.col("repo")).alias("away"), "found", "target_fqn")))
    return joined.groupBy("import_id").agg(best.alias("b")).select("import_id", F.col("b.found").alias("resolved_repo"), F.col("b.target_fqn").alias("resolved_fqn"))


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The CALLS multigraph: edges between existing symbols, one per (caller, callee, file, line); the last arrival's values win."""
    key = ["workspace_id", "caller_repo", "caller_fqn", "callee_repo", "callee_fqn", "file_path", "call_site_line"]
    index = symbol_index(symbols).drop("name")
    known = calls.where(F.col("callee_fqn").isNotNull() & (F.col("callee_fqn") != ""))
    for side in ("caller", "callee"):
        known = known.join(index.select("workspace_id", F.col("repo").alias(f"{side}_repo"), F.col("fqn").alias(f"{side}_fqn")), ["workspace_id", f"{side}_repo", f"{side}_fqn"], "left_semi")
    last = F.max_by(F.struct("confidence", "strategy"), F.struct("arrived_at", "call_id"))
    return known.groupBy(*key).agg(last.alias("v"), F.min("call_id").alias("edge_id")).select("edge_id", *key, "v.confidence", "v.strategy")


def last_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert semantics: one row per key, the last by order."""
    last = W.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
