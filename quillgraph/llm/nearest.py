"""Most similar vectors for every vector.

Exact copies are one point. A vantage-point tree over a bounded sample splits space into shards; each
shard's points get a vantage-point tree of their own. A point has to look into a part of space only if
the triangle inequality can't rule it out: the bound on the distance is compared with `relax` times the
search radius. relax=1 is exact; less visits fewer parts and may miss neighbours that lie across a
border. Distances are chords between unit vectors, scores cosines in double precision.

`within` searches a fixed radius (a least score); `top` has no radius: a first pass over the own shard
gives each point the distance of its k-th neighbour there, the second pass looks elsewhere within that.

The sample is bounded (about SAMPLE rows, or SAMPLE_PER_SHARD a shard, up to MOST_SAMPLE; chosen by hash),
shards take about SHARD_ROWS points (by the sample's medians, so dense regions are split too). A shard of more
than twice as many, as there are beyond MOST_SAMPLE / SAMPLE_PER_SHARD shards (half a billion points), is cut
into parts by hash, each with a tree of its own, that all its visitors look into; these come in blocks of
BLOCK_ROWS. So no task holds more than about 2 SHARD_ROWS points and BLOCK_ROWS visitors. Every point is
indexed, whatever the sample.

Defined results: vectors that are null, of other length, with nulls, NaN or infinities, or all zero are
not part of the collection, nor are null ids; of an id's differing vectors the smallest counts; equal
scores (to DIGITS digits) are ordered by id; a collection of one vector has no neighbours; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import staged
from quillgraph.sources.tables import table

DIM = 64
K = 5
SAMPLE, MOST_SAMPLE, SAMPLE_PER_SHARD = 16_384, 524_288, 64
SHARD_ROWS = 65_536
BLOCK_ROWS = 131_072
LEAF_ROWS = 256
DIGITS = 9
#: Measured recall against brute force at these factors: see the README.
RELAX_WITHIN = 0.18
RELAX_TOP = 0.3


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _chords(units: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ point)))


def build_tree(units: np.ndarray, leaf_rows: int, seed: int = 7) -> tuple[list, int]:
    """A vantage-point tree as nested [vantage, median, near, far] with leaves [number, rows]; and its leaf count."""
    rng, leaves = np.random.default_rng(seed), [0]

    def split(rows: np.ndarray):
        best = None
        if len(rows) > leaf_rows:
            probe = rows if len(rows) <= 512 else rng.choice(rows, 512, replace=False)
            for v in rng.choice(rows, min(6, len(rows)), replace=False):
                spread = _chords(units[probe], units[v]).std()
                if best is None or spread > best[0]:
                    best = (spread, v)
            d = _chords(units[rows], units[best[1]])
            median = float(np.median(d))
            near, far = rows[d < median], rows[d >= median]
            if len(near) and len(far):
                return [units[best[1]].copy(), median, split(near), split(far)]
        leaves[0] += 1
        return [leaves[0] - 1, rows]

    return split(np.arange(len(units))), leaves[0]


def visits(tree: list, units: np.ndarray, margins: np.ndarray, found) -> None:
    """Calls found(leaf number, leaf rows, indexes of the units that have to look into the leaf)."""

    def go(node, rows):
        if not len(rows):
            return
        if len(node) == 2:
            found(node[0], node[1], rows)
            return
        d = _chords(units[rows], node[0]) - node[1]
        go(node[2], rows[d < margins[rows]])
        go(node[3], rows[d >= -margins[rows]])

    go(tree, np.arange(len(units)))


def search(points: np.ndarray, queries: np.ndarray, same: np.ndarray, k: int, relax: float, radius: np.ndarray | None, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of up to k points other than `same` (-1: none) within each query's radius.

    radius None: each query's radius is first set to its k-th best in the leaf where it lies.
    """
    deep, wide = _unit(points), _unit(queries)
    flat, ask = deep.astype(np.float32), wide.astype(np.float32)
    tree, _ = build_tree(flat, leaf_rows)
    if radius is None:
        radius = np.full(len(ask), 2.0)

        def home(_, rows, who):
            s = ask[who] @ flat[rows].T
            s[same[who][:, None] == rows[None, :]] = -2
            if len(rows) > k:
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                radius[who] = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(kth, -1.0)))

        visits(tree, ask, np.zeros(len(ask)), home)
    hits = []
    floor = (1 - radius**2 / 2 - 1e-6).astype(np.float32)

    def look(_, rows, who):
        s = ask[who] @ flat[rows].T
        good = s >= floor[who][:, None]
        crowded = np.flatnonzero(good.sum(1) > 4 * k)
        if len(crowded):
            kth = -np.partition(-s[crowded], k, axis=1)[:, k]  # k others, and the query itself
            good[crowded] &= s[crowded] >= kth[:, None] - 1e-6
        q, p = np.nonzero(good)
        hits.append((who[q], rows[p]))

    visits(tree, ask, relax * radius, look)
    q = np.concatenate([h[0] for h in hits]) if hits else np.empty(0, int)
    p = np.concatenate([h[1] for h in hits]) if hits else np.empty(0, int)
    other = p != same[q]
    q, p = q[other], p[other]
    score = np.empty(len(q))
    for a in range(0, len(q), 200_000):
        score[a : a + 200_000] = np.einsum("ij,ij->i", wide[q[a : a + 200_000]], deep[p[a : a + 200_000]])
    return q, p, score.round(DIGITS)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each query's k best, by score and id."""
    order = np.lexsort((ids, -score, q))
    sorted_q = q[order]
    starts = np.flatnonzero(np.r_[True, sorted_q[1:] != sorted_q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def collection(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """id, vec (bytes of float32): the usable vectors, one per id."""
    v = F.col(vector).cast("array<float>")
    usable = F.col(key).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": [np.asarray(x, dtype=np.float32).tobytes() for x in b["v"]]})

    packed = df.where(usable).select(F.col(key).cast("string").alias("id"), v.alias("v")).mapInPandas(pack, "id string, vec binary")
    return packed.groupBy("id").agg(F.min("vec").alias("vec"))


def points_of(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(points: id, vec, ids; members: point, id). Exact copies are one point, named by its smallest id;
    ids are its `keep` smallest. Copies are found by digest, so only the points' own vectors are moved;
    a point with very many copies is first cut down by salt."""
    digests = vectors.select("id", F.md5("vec").alias("digest"))
    salted = digests.withColumn("r", F.row_number().over(W.partitionBy("digest", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("r") <= keep)
    few = salted.withColumn("r", F.row_number().over(W.partitionBy("digest").orderBy("id"))).where(F.col("r") <= keep)
    classes = few.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("point"), "digest", "ids")
    points = vectors.join(classes.select(F.col("point").alias("id"), "ids"), "id")
    return points, digests.join(classes.select("point", "digest"), "digest").select("point", "id")


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), -1)


def neighbours(points: DataFrame, k: int = K, relax: float = RELAX_TOP, least_score: float | None = None) -> DataFrame:
    """a, b, score: for each point its k most similar others with at least least_score. points: id, vec, staged."""
    spark = points.sparkSession
    n = points.count()
    shards = min(MOST_SAMPLE // SAMPLE_PER_SHARD, 2 ** max(0, math.ceil(math.log2(max(n, 1) / SHARD_ROWS))))
    size = min(MOST_SAMPLE, max(SAMPLE, SAMPLE_PER_SHARD * shards))
    share = min(1.0, size / max(n, 1))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = points.where(chosen).select("vec").limit(2 * size).toPandas() if shards > 1 else None
    if sample is not None:
        tree, shards = build_tree(_unit(_stack(sample["vec"])).astype(np.float32), math.ceil(len(sample) / shards))
        router = spark.sparkContext.broadcast(tree)
    out_schema = "a string, b string, score double"

    def route(margin: float | None):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                if sample is None:
                    yield b.assign(shard=np.int32(0))[[*b.columns, "shard"]]
                    continue
                units = _unit(_stack(b["vec"])).astype(np.float32)
                own = np.zeros(len(b)) if margin is None else np.full(len(b), margin) if margin >= 0 else b["radius"].to_numpy() * relax
                at = []
                visits(router.value, units, own, lambda leaf, _, who: at.append((np.full(len(who), leaf, np.int32), who)))
                shard, who = np.concatenate([x[0] for x in at]), np.concatenate([x[1] for x in at])
                yield b.iloc[who].assign(shard=shard)

        return each

    stored = points.select("id", "vec").mapInPandas(route(None), "id string, vec binary, shard int")
    # the tables of blocks and parts have as many rows as shards, which are bounded
    parts = stored.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD_ROWS)).cast("int").alias("parts"))
    cut = stored.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")).drop("parts")

    def passes(asking: DataFrame, radius: float | None) -> DataFrame:
        counts = asking.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        left = asking.join(F.broadcast(counts), "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        left = left.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = cut.join(F.broadcast(counts), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def look(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(data):
                return pd.DataFrame({"a": [], "b": [], "score": []})
            data = data.sort_values("id", ignore_index=True)
            where = pd.Series(np.arange(len(data)), index=data["id"])
            same = where.reindex(queries["id"]).fillna(-1).to_numpy().astype(int)
            r = np.full(len(queries), radius) if radius is not None else queries["radius"].to_numpy() if "radius" in queries else None
            q, p, s = search(_stack(data["vec"]), _stack(queries["vec"]), same, k, relax, r)
            if least_score is not None:
                good = s >= least_score
                q, p, s = q[good], p[good], s[good]
            best = _best(q, p, s, k)  # rows are in the order of their ids
            return pd.DataFrame({"a": queries["id"].to_numpy()[q[best]], "b": data["id"].to_numpy()[p[best]], "score": s[best]})

        return left.groupBy("shard", "part", "block").cogroup(right.groupBy("shard", "part", "block")).applyInPandas(look, out_schema)

    if least_score is not None:
        radius = math.sqrt(max(0.0, 2 - 2 * least_score)) + 1e-9
        asking = points.select("id", "vec").mapInPandas(route(relax * radius), "id string, vec binary, shard int")
        found = passes(asking, radius)
    else:
        home = staged(passes(stored.toDF(*stored.columns), None), "nearest-home")
        # each part of a home shard gives k: the k-th best of all is the radius
        place = F.row_number().over(W.partitionBy("a").orderBy(F.col("score").desc(), "b"))
        worst = home.withColumn("place", place).where(F.col("place") <= k).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        radius = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("low")))).otherwise(F.lit(2.0))
        with_radius = points.select("id", "vec").join(worst.select(F.col("a").alias("id"), radius.alias("radius")), "id", "left").fillna(2.0, ["radius"])
        asking = with_radius.select("id", "vec", "radius").mapInPandas(route(-1.0), "id string, vec binary, radius double, shard int")
        found = passes(asking, None)
    # a pair is known to both sides, whichever of them found it
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).distinct()
    best = W.partitionBy("a").orderBy(F.col("score").desc(), "b")
    return both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def top(df: DataFrame, key: str, vector: str, k: int = K, relax: float = RELAX_TOP, least_score: float | None = None) -> DataFrame:
    """id, other, score, rank: the k most similar others of every id, by score and id."""
    vectors = staged(collection(df, key, vector), "nearest-vectors")
    points, members = points_of(vectors, k + 1)
    points = staged(points, "nearest-points")
    near = neighbours(points, k, relax, least_score)
    ids = points.select(F.col("id").alias("p"), "ids")
    spread = near.join(ids, near.b == ids.p).select(F.col("a").alias("point"), "score", F.explode(F.slice("ids", 1, k)).alias("other"))
    own = points.where(F.size("ids") > 1).select(F.col("id").alias("point"), F.lit(1.0).alias("score"), F.explode("ids").alias("other"))
    best = W.partitionBy("point").orderBy(F.col("score").desc(), "other")
    few = spread.unionByName(own).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = few.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("r", "score", "other"))).alias("list"))
    others = F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)
    each = members.join(lists, "point").select("id", F.posexplode(others).alias("rank", "x"))
    return each.select("id", F.col("x.other").alias("other"), F.col("x.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(df: DataFrame, key: str, vector: str, least_score: float, k: int = K, relax: float = RELAX_WITHIN) -> DataFrame:
    """a < b, score: pairs of at least least_score of which one is among the other's k most similar."""
    near = top(df, key, vector, k, relax, least_score)
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "score").distinct()


def p2_found(spark, folder):
    pairs = similar_pairs(table(spark, folder, "chunk"), "chunk_id", "embedding", 0.9)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p2_top(spark, folder):
    near = top(table(spark, folder, "chunk"), "chunk_id", "embedding")
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "score", "rank")


def p2_exact(spark, folder):
    """The five nearest of every chunk by exact search: factor 1."""
    near = top(table(spark, folder, "chunk"), "chunk_id", "embedding", relax=1.0)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


SQL = {
    "p2_found": """
WITH v AS (SELECT chunk_id, min(embedding)::DOUBLE[] AS e FROM chunk WHERE len(embedding) = 64 AND chunk_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.chunk_id <> b.chunk_id),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM n WHERE r <= 5 AND score >= 0.9"""
}
SQL["p2_exact"] = SQL["p2_found"].split("SELECT DISTINCT")[0] + "SELECT a AS chunk_id, b AS neighbour_id, round(score, 6) AS score, r AS rank FROM n WHERE r <= 5"
QUERIES = {"p2_found": p2_found, "p2_top": p2_top, "p2_exact": p2_exact}
