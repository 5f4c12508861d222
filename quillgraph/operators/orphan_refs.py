"""References to records that do not exist.

Keys (workspace, scope, name) are dictionary-encoded as integers, dense within key ranges. For each key
range and period one bitmap holds the keys that are referenced, one the keys of which a single record
lives through the whole period. reference AND NOT parent leaves the keys that may be orphans in that
period; only their references are decoded and checked exactly against the records' lifetimes.

Defined results: a null or empty name is no reference, nor is one that begins with <...>; a null workspace or repository finds no
record (`missing`); re-delivered rows count once; a null seen_at lives in no record's time, so it gives
`late` or `missing`; records without indexed_at never live; columns not named here are dropped; empty
tables give an empty result, or `missing` for all where only the records are empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import staged

KEY = ["workspace_id", "scope", "fqn"]
#: A scope that is any repository of the workspace.
ANYWHERE = "*"
#: A name that begins so stands for something without a name of its own, as <dynamic> or <inline>@file:line.
SENTINEL = "^<[^<>]*>"
#: Ids of one key range: the range's number is above these bits, the rank within the range below.
RANGE_BITS = 40


def references(calls: DataFrame, imports: DataFrame, flows: DataFrame) -> DataFrame:
    """ref_table, ref_id, KEY, seen_at; rows may be re-delivered. Scope is '=' and the repository, or ANYWHERE."""
    parts = [("resolved_call", calls, "call_id", "callee_repo", "callee_fqn"), ("import_ref", imports, "import_id", None, "resolved_fqn"), ("http_flow_edge", flows, "flow_id", "route_repo", "route_handler_fqn")]
    out = None
    for name, df, key, repo, fqn in parts:
        scope = F.concat(F.lit("="), F.col(repo)) if repo else F.lit(ANYWHERE)
        # a null key part becomes a value that no record has
        one = df.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), F.coalesce("workspace_id", F.lit("\0")).alias("workspace_id"), F.coalesce(scope, F.lit("\0")).alias("scope"), F.col(fqn).alias("fqn"), "seen_at")
        one = one.where(F.col("fqn").isNotNull() & (F.col("fqn") != "") & ~F.col("fqn").rlike(SENTINEL))
        out = one if out is None else out.unionByName(one)
    return out


def lifetimes(symbols: DataFrame) -> DataFrame:
    """KEY, born, gone (null: lives on), once for the repository's scope and once for ANYWHERE."""
    rows = symbols.dropna(subset=["workspace_id", "repo", "fqn"]).select("workspace_id", F.explode(F.array(F.concat(F.lit("="), F.col("repo")), F.lit(ANYWHERE))).alias("scope"), "fqn", F.col("indexed_at").alias("born"), F.col("deleted_at").alias("gone"))
    return rows.distinct()


def _surviving(pairs: pd.DataFrame) -> pd.Series:
    import numpy as np

    def bits(x) -> list[int]:
        own = np.frombuffer(x.refs, dtype=np.uint8)
        if x.parents is not None:
            own = own & ~np.frombuffer(x.parents, dtype=np.uint8)
        return np.flatnonzero(np.unpackbits(own, bitorder="little")).tolist()

    return pd.Series([bits(x) for x in pairs.itertuples()], dtype=object)


def _period(at: str):
    """Months since year 0; a null time has the period -1."""
    return F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(-1))


def orphans(refs: DataFrame, symbols: DataFrame, key_ranges: int | None = None) -> DataFrame:
    """ref_table, ref_id, reason (missing, deleted or late), seen_at.

    key_ranges: how many ranges the dictionary has; a range is ranked by one task, so its number follows
    the number of shuffle partitions unless given.
    """
    spark = refs.sparkSession
    ranges = key_ranges or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    surviving = F.pandas_udf(_surviving, "array<int>")
    parents = lifetimes(symbols)
    used = staged(refs.groupBy(*KEY, _period("seen_at").alias("period")).agg(F.lit(1).alias("one")).drop("one"), "orphan-used")
    ends = used.agg(F.max("period")).first()[0]
    if ends is None:
        return refs.select("ref_table", "ref_id", F.lit("missing").alias("reason"), "seen_at")
    keys = used.select(*KEY).distinct().withColumn("range", F.pmod(F.xxhash64(*KEY), F.lit(ranges)).cast("bigint"))
    rank = F.row_number().over(W.partitionBy("range").orderBy(*KEY))
    dictionary = staged(keys.withColumn("id", F.shiftleft(F.col("range"), RANGE_BITS) + rank).drop("range"), "orphan-keys")

    def bitmaps(ids: DataFrame, name: str) -> DataFrame:
        return ids.groupBy(F.expr("bitmap_bucket_number(id)").alias("part"), "period").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias(name))

    referenced = bitmaps(used.join(dictionary, KEY).select("id", "period"), "refs")
    whole_from = F.when(F.col("born") == F.date_trunc("month", "born"), _period("born")).otherwise(_period("born") + 1)
    whole_upto = F.coalesce(F.year("gone") * 12 + F.month("gone") - 2, F.lit(ends))
    spans = parents.where(F.col("born").isNotNull()).withColumn("a", F.greatest(whole_from, F.lit(0))).withColumn("b", F.least(whole_upto, F.lit(ends))).where("a <= b")
    first = used.agg(F.min(F.when(F.col("period") >= 0, F.col("period")))).first()[0] or 0
    spans = spans.withColumn("a", F.greatest("a", F.lit(first))).where("a <= b")
    held = bitmaps(spans.join(dictionary, KEY).select("id", F.explode(F.sequence("a", "b")).alias("period")), "parents")
    left = referenced.join(held, ["part", "period"], "left").select("part", "period", F.explode(surviving(F.struct("refs", "parents"))).alias("bit"))
    # Spark's bitmaps count ids from 1, and their parts too
    suspects = left.select("period", ((F.col("part") - 1) * 32_768 + F.col("bit") + 1).alias("id")).join(dictionary, "id").select(*KEY, "period")
    # a suspect's references, once each, with every lifetime of its key
    rows = refs.withColumn("period", _period("seen_at")).join(suspects, [*KEY, "period"], "left_semi").drop("period")
    alive = (F.col("born") <= F.col("seen_at")) & (F.col("gone").isNull() | (F.col("gone") > F.col("seen_at")))
    known = rows.join(parents.withColumn("there", F.lit(True)), KEY, "left")
    verdict = known.groupBy("ref_table", "ref_id", "seen_at").agg(
        F.max(F.coalesce(alive, F.lit(False))).alias("alive"),
        F.max(F.coalesce("there", F.lit(False))).alias("there"),
        F.max(F.coalesce(F.col("born") <= F.col("seen_at"), F.lit(False))).alias("before"),
    )
    reason = F.when(~F.col("there"), "missing").when(F.col("before"), "deleted").otherwise("late").alias("reason")
    return verdict.where(~F.col("alive")).select("ref_table", "ref_id", reason, "seen_at")


def orphan_rates(refs: DataFrame, orphaned: DataFrame) -> DataFrame:
    """Per table and month: references, and orphans by reason."""
    month = F.date_trunc("month", "seen_at").cast("date").alias("period")
    total = refs.groupBy("ref_table", "ref_id").agg(F.min("seen_at").alias("seen_at")).groupBy("ref_table", month).agg(F.count(F.lit(1)).alias("refs"))
    count = lambda what: F.count(F.when(F.col("reason") == what, 1)).alias(what)
    bad = orphaned.groupBy("ref_table", month).agg(count("missing"), count("deleted"), count("late"))
    filled = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("missing", "deleted", "late")]
    return total.join(bad, ["ref_table", "period"], "left").select("ref_table", "period", "refs", *filled)
