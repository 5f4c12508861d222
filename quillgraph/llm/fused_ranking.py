"""One ranking from several differently-scaled scores.

Within its query each score becomes its empirical percentile with averaged ties, (rank - 1/2) / hits,
where a null counts as lower than any value; percentiles go through the inverse of the normal
distribution; hits are ordered by the weighted mean of these, then by id.

Ranks come from counts per distinct value in two levels (a monotone bucket of the value, then the value
within its bucket), so no task has to hold or sort one query's hits, however many they are.

Defined results: hits without query or id are left out; re-delivered hits count once, of differing rows
with one id the smallest values; NaN counts as null; a query with one hit has that hit first; a score
that is null for the whole query has no say; empty tables give an empty ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import staged
from quillgraph.sources.tables import table

SCORES = {"lexical_score": 1.0, "vector_score": 1.0, "rrf_score": 1.0}
#: Scores are compared after rounding to so many digits, so that the order of additions can't decide.
DIGITS = 9

# Coefficients of P. J. Acklam's rational approximation of the normal quantile.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _horner(coefficients: list[float], x):
    out = None
    for c in coefficients:
        out = F.lit(c) if out is None else out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution for 0 < p < 1 (relative error below 1.2e-9)."""
    q = p - 0.5
    r = q * q
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    middle = _horner(_A, r) * q / _horner(_B, r)
    tail = lambda t: _horner(_C, t) / _horner(_D, t)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)


def _bucket(value: Column) -> Column:
    """A coarse monotone function of any double; null is lowest."""
    fine = F.signum(value) * F.log1p(F.abs(value) * 1e6)
    return F.coalesce(F.floor(F.least(F.greatest(fine, F.lit(-1e6)), F.lit(1e6)) * 64), F.lit(-(2**40)))


def percentiles(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, p: the percentile of each distinct value of a group, ties averaged, null lowest."""
    counts = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", _bucket(F.col(value)))
    buckets = counts.groupBy(*group, "bucket").agg(F.sum("n").alias("in_bucket"))
    up = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select(*group, "bucket", F.coalesce(F.sum("in_bucket").over(up), F.lit(0)).alias("start"), F.sum("in_bucket").over(W.partitionBy(*group)).alias("total"))
    inside = W.partitionBy(*group, "bucket").orderBy(F.col(value).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, [*group, "bucket"])
    # (average rank - 1/2) / total
    return ranked.select(*group, value, ((F.col("start") + F.col("before") + F.col("n") / 2.0) / F.col("total")).alias("p"))


def fused(hits: DataFrame, weights: dict[str, float] = SCORES) -> DataFrame:
    """query_id, hit_id, fused_score."""
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in weights]
    rows = hits.where(F.col("query_id").isNotNull() & F.col("hit_id").isNotNull()).select("query_id", "hit_id", *clean)
    rows = rows.groupBy("query_id", "hit_id").agg(*[F.min(c).alias(c) for c in weights])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.lit(float(w)).alias("weight"), F.col(c).alias("value")) for c, w in weights.items()]))
    long = staged(rows.select("query_id", "hit_id", each.alias("s")).select("query_id", "hit_id", "s.*"), "fused-scores")
    p = percentiles(long, ["query_id", "score"], "value").withColumnsRenamed({"query_id": "q", "score": "s", "value": "v"})
    with_p = long.join(p, (F.col("query_id") == F.col("q")) & (F.col("score") == F.col("s")) & F.col("value").eqNullSafe(F.col("v")))
    z = F.col("weight") * normal_quantile(F.col("p"))
    mean = F.sum(z) / F.sum("weight")
    return with_p.groupBy("query_id", "hit_id").agg((F.round(mean, DIGITS) + 0.0).alias("fused_score"))


def first_hits(scored: DataFrame) -> DataFrame:
    """query_id, hit_id of each query's first hit."""
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("fused_score")).alias("down"), "hit_id")).alias("best"))
    return best.select("query_id", F.col("best.hit_id").alias("hit_id"))


def positions(scored: DataFrame) -> DataFrame:
    """scored with `position` from 1 within its query, in two levels like the percentiles."""
    rows = scored.withColumn("down", -F.col("fused_score")).withColumn("bucket", F.struct(_bucket(F.col("down")).alias("value"), F.shiftright("hit_id", 12).alias("ids")))
    # rows of one value bucket are split further by value, so that the id part only breaks ties
    rows = rows.withColumn("bucket", F.struct(F.col("bucket.value").alias("value"), "down", F.col("bucket.ids").alias("ids")))
    sizes = rows.groupBy("query_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    coarse = sizes.groupBy("query_id", F.col("bucket.value").alias("value")).agg(F.sum("n").alias("m"))
    up = W.partitionBy("query_id").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select("query_id", "value", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("outer"))
    inner = W.partitionBy("query_id", "bucket.value").orderBy("bucket.down", "bucket.ids").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("query_id", "bucket", F.col("bucket.value").alias("value"), F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inner"))
    starts = starts.join(coarse, ["query_id", "value"]).select("query_id", "bucket", (F.col("outer") + F.col("inner")).alias("start"))
    own = W.partitionBy("query_id", "bucket").orderBy("hit_id")
    out = rows.withColumn("r", F.row_number().over(own)).join(starts, ["query_id", "bucket"])
    return out.select("query_id", "hit_id", "fused_score", (F.col("start") + F.col("r")).alias("position"))


def p7_found(spark, folder):
    return first_hits(fused(table(spark, folder, "search_hit")))


def p7_ranking(spark, folder):
    return positions(fused(table(spark, folder, "search_hit")))


def _sql_horner(coefficients: list[float], x: str) -> str:
    out = ""
    for c in coefficients:
        out = f"(({out}) * {x} + ({c!r}::DOUBLE))" if out else f"{c!r}::DOUBLE"
    return out


def _sql_quantile(p: str) -> str:
    low, high, q = f"sqrt(-2.0::DOUBLE * ln({p}))", f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {p}))", f"({p} - 0.5::DOUBLE)"
    tail = lambda t: f"({_sql_horner(_C, t)}) / ({_sql_horner(_D, t)})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -({tail(high)}) ELSE ({_sql_horner(_A, f'({q}*{q})')}) * {q} / ({_sql_horner(_B, f'({q}*{q})')}) END"


_SQL = f"""
WITH h AS (SELECT DISTINCT query_id, hit_id, lexical_score, vector_score, rrf_score FROM search_hit WHERE query_id IS NOT NULL AND hit_id IS NOT NULL),
l AS (SELECT query_id, hit_id, 'l' AS score, coalesce(lexical_score, '-inf'::DOUBLE) AS v FROM h UNION ALL SELECT query_id, hit_id, 'v', coalesce(vector_score, '-inf'::DOUBLE) FROM h
  UNION ALL SELECT query_id, hit_id, 'r', coalesce(rrf_score, '-inf'::DOUBLE) FROM h),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, score ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY query_id, score, v) AS ties, count(*) OVER (PARTITION BY query_id, score) AS total FROM l),
p AS (SELECT query_id, hit_id, (below + ties / 2.0::DOUBLE) / total AS p FROM r),
f AS (SELECT query_id, hit_id, round(sum({_sql_quantile('p')}) / 3.0::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS fused_score FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, hit_id) AS position FROM f)
"""
SQL = {"p7_found": _SQL + "SELECT query_id, hit_id FROM n WHERE position = 1", "p7_ranking": _SQL + "SELECT query_id, hit_id, fused_score, position FROM n"}
QUERIES = {"p7_found": p7_found, "p7_ranking": p7_ranking}
