"""Symbol lookup, lexical (BM25), vector and fused search. All of them answer sets of queries at once.

Lexical search reads stored postings: `LexicalIndex.build` writes them once, partitioned by a hash of the term,
and a query reads only its terms' partitions. Corpus statistics are those of the whole index, as in a full-text
index over all workspaces; a query's workspace (null: any) then filters the hits. Vector search multiplies blocks
of queries with shards of vectors; every list is cut to its best k before it is moved.

Defined results: null texts have no words, queries without words find nothing; vectors that are null or of another
length than the query's, or all zero, are not found; equal scores are ordered by key; empty tables give nothing.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.text import tokens
from quillgraph.session import shared_folder, staged

K1, B, RRF_K = 1.2, 0.75, 60
MOST_CANDIDATES, LEAST_TAIL = 50, 3
SYMBOL = ["workspace_id", "repo", "fqn"]
#: Partitions of the postings; vectors of a shard, queries of a block.
BUCKETS, SHARD_ROWS, BLOCK_ROWS = 64, 32_768, 2_048


def clamp(n: int) -> int:
    return max(1, min(MOST_CANDIDATES, n))


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: term, key, tf, doc_length."""
    words = documents.select(key, tokens(F.col(text)).alias("words")).withColumn("doc_length", F.size("words"))
    return words.select(key, "doc_length", F.explode("words").alias("term")).groupBy("term", key, "doc_length").agg(F.count(F.lit(1)).alias("tf"))


def best(df: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each group; the limit is applied before and after the exchange."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= limit).drop("_r")


def _null_safe(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """A join on key in which nulls are equal."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in key})
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in key]
    return left.join(other, on, how).drop(*[f"_{k}" for k in key])


class LexicalIndex:
    """BM25 over a folder: documents (key, workspace_id, words, length), postings by bucket, terms by bucket, stats."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    @classmethod
    def build(cls, documents: DataFrame, key: list[str], text: Column, folder: str, workspace: str | None = None) -> LexicalIndex:
        """Writes the index of one text per key. workspace: the column that a query's workspace filters by."""
        spark, folder = documents.sparkSession, folder.rstrip("/")
        ws = F.col(workspace) if workspace else F.lit(None).cast("string")
        words = documents.select(*key, ws.alias("_ws"), tokens(F.coalesce(text, F.lit(""))).alias("words"))
        words.withColumn("n", F.size("words")).write.mode("overwrite").parquet(f"{folder}/documents")
        docs = spark.read.parquet(f"{folder}/documents")
        docs.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("length")).write.mode("overwrite").parquet(f"{folder}/stats")
        # a document's words are counted in place: no exchange but the one by bucket
        counted = F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).alias("tf")))
        rows = docs.select(*key, "_ws", "n", F.explode(counted).alias("t")).select(*key, "_ws", "n", "t.term", "t.tf")
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
        rows.select("*", bucket).repartition("bucket", F.pmod(F.xxhash64(*key), F.lit(16))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        index = cls(spark, folder, key)
        index._stored("postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
        return index

    def _stored(self, what: str) -> DataFrame:
        """postings or terms; an index without words has no files that would tell their columns."""
        kinds = {f.name: f for f in self.spark.read.parquet(f"{self.folder}/documents").schema}
        long, text, number = T.LongType(), T.StringType(), T.IntegerType()
        own = [kinds[k] for k in [*self.key, "_ws", "n"]] + [T.StructField("term", text), T.StructField("tf", number)] if what == "postings" else [T.StructField("term", text), T.StructField("df", long)]
        return self.spark.read.schema(T.StructType([*own, T.StructField("bucket", number)])).parquet(f"{self.folder}/{what}")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """query_id, _in (the workspace), term, times, df, idf of the queries' terms that the index has; and their buckets."""
        words = queries.select("query_id", F.col("workspace_id").alias("_in"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "_in", "term").agg(F.count(F.lit(1)).alias("times"))
        words = staged(words.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), "search-terms")
        buckets = [r["bucket"] for r in words.select("bucket").distinct().collect()]  # at most BUCKETS
        known = self._read("terms", buckets).drop("bucket")
        return words.drop("bucket").join(known, "term").withColumn("idf", F.log(1.0 + (F.lit(self._stats["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))), buckets

    def _read(self, what: str, buckets: list[int]) -> DataFrame:
        return self._stored(what).where(F.col("bucket").isin(buckets))

    @functools.cached_property
    def _stats(self):
        return self.spark.read.parquet(f"{self.folder}/stats").first()

    def _damped(self, tf: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(self._stats["length"] or 1.0)))

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """query_id, key, score of the best documents. queries: query_id, workspace_id, text."""
        asked, buckets = self._asked(queries)
        hits = self._read("postings", buckets).drop("bucket").join(asked, "term").where(F.col("_in").isNull() | F.col("_in").eqNullSafe(F.col("_ws")))
        found = hits.groupBy("query_id", *self.key).agg(F.round(F.sum(F.col("idf") * self._damped(F.col("tf").cast("double"))), 6).alias("score")).where("score > 0")
        return best(found, ["query_id"], [F.col("score").desc(), *self.key], limit)

    def phrases(self, queries: DataFrame, limit: int) -> DataFrame:
        """As search, for documents that hold the query's words one after another: only those with its rarest word are read."""
        asked, buckets = self._asked(queries)
        wanted = queries.select("query_id", F.col("workspace_id").alias("_in"), tokens(F.col("text")).alias("phrase")).where(F.size("phrase") > 0)
        terms = asked.groupBy("query_id").agg(F.sum(F.col("idf") * F.col("times")).alias("idf"), F.count(F.lit(1)).alias("known"), F.min(F.struct("df", "term")).alias("rarest"))
        terms = wanted.join(terms, "query_id").where(F.col("known") == F.size(F.array_distinct("phrase"))).withColumn("term", F.col("rarest.term"))
        where = self._read("postings", buckets).select("term", *self.key).join(terms.select("term", "query_id", "_in", "phrase", "idf"), "term")
        docs = self.spark.read.parquet(f"{self.folder}/documents")
        read = _null_safe(where, docs, self.key).where(F.col("_in").isNull() | F.col("_in").eqNullSafe(F.col("_ws")))
        hits = read.withColumn("tf", _occurrences(F.col("words"), F.col("phrase")).cast("double")).where("tf > 0")
        found = hits.select("query_id", *self.key, F.round(F.col("idf") * self._damped(F.col("tf")), 4).alias("score"))
        return best(found, ["query_id"], [F.col("score").desc(), *self.key], limit)


def _occurrences(words: Column, phrase: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - F.size(phrase) + 1, F.lit(1)))
    return F.size(F.filter(at, lambda i: F.slice(words, i, F.size(phrase)) == phrase))


def kept_index(spark: SparkSession, source: str, name: str, key: list[str], build: Callable[[str], LexicalIndex]) -> LexicalIndex:
    """The index of a stored table, built if the shared folder has none of this state of the table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path)
    state = f"{source}|{size.getLength()}|{size.getFileCount()}|{fs.getFileStatus(path).getModificationTime()}"
    folder = f"{shared_folder(spark)}/index/{name}-{uuid.uuid5(uuid.NAMESPACE_URL, state).hex}"
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        build(folder)
        fs.mkdirs(done)
    return LexicalIndex(spark, folder, key)


def bm25(documents: DataFrame, key: str, text: Column, query: str, limit: int) -> DataFrame:
    """key, score of the best documents for one query over a table without index."""
    spark = documents.sparkSession
    index = LexicalIndex.build(documents, [key], text, f"{shared_folder(spark)}/stage/bm25-{uuid.uuid4().hex}")
    asked = spark.createDataFrame([(0, None, query)], "query_id int, workspace_id string, text string")
    return index.search(asked, limit).select(key, "score").orderBy(F.col("score").desc(), key)


def vector_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, limit: int, scope: str | None = None) -> DataFrame:
    """query_id, key, score = (1 + cosine) / 2 of the most similar vectors, exact. queries: query_id, vector (and scope:
    a column of both whose values have to be equal)."""
    groups = [scope] if scope else []
    asked, held = queries.where(F.col("vector").isNotNull()), vectors.where(F.col(vector).isNotNull())
    blocks, shards = (max(1, math.ceil(df.count() / rows)) for df, rows in ((asked, BLOCK_ROWS), (held, SHARD_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", F.col("vector").alias("v"), *groups, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", every(shards))
    right = held.select(F.col(key).alias("key"), F.col(vector).alias("v"), *groups, F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")).withColumn("block", every(blocks))
    names = {f.name: f.dataType for f in left.schema} | {"key": right.schema["key"].dataType}

    def look(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "key": [], "score": []}
        d = d.sort_values("key", ignore_index=True)
        for width, part in q.groupby(q["v"].map(len)):
            of = d[d["v"].map(len) == width]
            if not len(of) or not width:
                continue
            a, b = (np.array(x["v"].tolist(), dtype=np.float64) for x in (part, of))
            na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.round((1 + (a @ b.T) / (na[:, None] * nb[None, :])) / 2, 6)
            score[~np.isfinite(score)] = -1
            first = np.argsort(-score, axis=1, kind="stable")[:, :limit]  # equal scores stay in the order of the keys
            for i, row in enumerate(first):
                row = row[score[i, row] >= 0]
                out["query_id"] += [part["query_id"].iloc[i]] * len(row)
                out["key"] += of["key"].iloc[row].tolist()
                out["score"] += score[i, row].tolist()
        # plain objects: a frame of pandas' own strings isn't taken back here
        return pd.DataFrame({"query_id": pd.Series(out["query_id"], dtype=object), "key": pd.Series(out["key"], dtype=object), "score": pd.Series(out["score"], dtype=float)})

    schema = T.StructType([T.StructField("query_id", names["query_id"]), T.StructField("key", names["key"]), T.StructField("score", T.DoubleType())])
    by = [*groups, "shard", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(look, schema)
    return best(found, ["query_id"], [F.col("score").desc(), "key"], limit).withColumnRenamed("key", key)


def fuse(lists: dict[str, DataFrame], key: str, limit: int, k: int = RRF_K, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Reciprocal rank fusion: by, key, rrf_score, sources. lists: name -> by, key, score; each is a short top-k list."""
    ranked = None
    for name, df in lists.items():
        r = F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), key))
        one = df.select(*by, F.col(key), r.alias("rank"), F.lit(name).alias("source"))
        ranked = one if ranked is None else ranked.unionByName(one)
    fused = ranked.groupBy(*by, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("rrf_score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    order = [F.col("rrf_score").desc(), key]
    return best(fused, by, order, limit) if by else fused.orderBy(*order).limit(limit)


# ---- symbols ------------------------------------------------------------------------------------


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """One row per (workspace_id, repo, fqn): name, signature, docstring, kind, file_path, start_line, end_line of the row that
    was given first (least symbol_id); columns that are missing are null."""
    kinds = {"symbol_id": "bigint", "workspace_id": "string", "name": "string", "signature": "string", "docstring": "string", "kind": "string", "file_path": "string", "start_line": "int", "end_line": "int"}
    full = symbols.select("repo", "fqn", *[(F.col(c) if c in symbols.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).where("fqn IS NOT NULL")
    rest = [c for c in kinds if c not in SYMBOL]
    return full.groupBy(*SYMBOL).agg(F.min(F.struct(*rest)).alias("s")).select(*SYMBOL, *[f"s.{c}" for c in rest if c != "symbol_id"])


def symbol_text() -> Column:
    """What full-text search reads of a symbol."""
    return F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("signature", F.lit("")), F.coalesce("docstring", F.lit("")))


def symbol_index(symbols: DataFrame, folder: str) -> LexicalIndex:
    return LexicalIndex.build(symbol_rows(symbols), SYMBOL, symbol_text(), folder, "workspace_id")


def lookup(symbols: DataFrame, wanted: DataFrame, mode: str = "auto", limit: int = 10, index: LexicalIndex | None = None) -> DataFrame:
    """lookup_id, SYMBOL, file_path, start_line, end_line, kind, score, match_mode: symbols by full name (exact), by a plain end
    of at least LEAST_TAIL characters, shortest names first (suffix), by a phrase of name, signature or documentation
    (fuzzy), or by the first of them that finds anything (auto).

    wanted: lookup_id, workspace_id (null: any), name. The order is total.
    """
    if mode not in ("exact", "suffix", "fuzzy", "auto"):
        raise ValueError(f"unknown mode {mode}")
    limit, rows = clamp(limit), symbol_rows(symbols)
    there = ["file_path", "start_line", "end_line", "kind"]
    inside = F.col("_in").isNull() | F.col("_in").eqNullSafe(F.col("workspace_id"))
    asked = wanted.select("lookup_id", F.col("workspace_id").alias("_in"), "name").where("name <> ''")
    found_by = lambda df, how: df.select("lookup_id", *SYMBOL, *there, F.col("score").cast("double").alias("score"), F.lit(how).alias("match_mode"))

    def exact(asked: DataFrame) -> DataFrame:
        hits = rows.drop("name").join(asked.withColumnRenamed("name", "fqn"), "fqn").where(inside).withColumn("score", F.lit(1.0))
        return found_by(best(hits, ["lookup_id"], ["repo", "workspace_id"], limit), "exact")

    def suffix(asked: DataFrame) -> DataFrame:
        tails = asked.where(F.length("name") >= LEAST_TAIL).withColumnRenamed("name", "tail")
        # an end is an equal key once names are cut to the lengths asked for; an identifier has at most 512 characters
        lengths = sorted(r[0] for r in tails.select(F.length("tail")).distinct().limit(MOST_LENGTHS).collect())
        if not lengths:
            return found_by(asked.limit(0).join(rows.drop("name"), F.lit(False)).withColumn("score", F.lit(1.0)), "suffix")
        ends = rows.drop("name").withColumn("l", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.length("fqn") >= F.col("l")).withColumn("tail", F.expr("right(fqn, l)"))
        hits = ends.join(tails, "tail").where(inside).withColumn("score", F.lit(1.0))
        return found_by(best(hits, ["lookup_id"], [F.length("fqn"), "fqn", "repo", "workspace_id"], limit), "suffix")

    def fuzzy(asked: DataFrame) -> DataFrame:
        nonlocal index
        spark = symbols.sparkSession
        index = index or symbol_index(symbols, f"{shared_folder(spark)}/stage/symbols-{uuid.uuid4().hex}")
        hits = index.phrases(asked.select(F.col("lookup_id").alias("query_id"), F.col("_in").alias("workspace_id"), F.col("name").alias("text")), limit)
        return found_by(_null_safe(hits.withColumnRenamed("query_id", "lookup_id"), rows, SYMBOL), "fuzzy")

    if mode != "auto":
        return {"exact": exact, "suffix": suffix, "fuzzy": fuzzy}[mode](asked)
    out = staged(exact(asked), "lookup-exact")
    for step in (suffix, fuzzy):
        left = asked.join(out.select("lookup_id").distinct(), "lookup_id", "left_anti")
        if left.isEmpty():
            break
        out = out.unionByName(staged(step(left), "lookup-next"))
    return out


#: Lengths that the ends asked for in one lookup may have.
MOST_LENGTHS = 512


def find_symbols(symbols: DataFrame, name: str, mode: str = "auto", limit: int = 10, workspace: str | None = None) -> DataFrame:
    """fqn, repo, score, match_mode and where it is, best first, for one name. See lookup."""
    wanted = symbols.sparkSession.createDataFrame([(0, workspace, name)], "lookup_id int, workspace_id string, name string")
    found = lookup(symbols, wanted, mode, limit).drop("lookup_id")
    return found.orderBy(F.col("score").desc(), F.length("fqn"), "fqn", "repo", "workspace_id")


# ---- code ---------------------------------------------------------------------------------------


def code_search(index: LexicalIndex, symbols: DataFrame, chunks: DataFrame, queries: DataFrame, embed: Callable[[DataFrame], DataFrame], limit: int = 10, lexical_k: int = 30, vector_k: int = 30) -> DataFrame:
    """query_id, kind (Symbol or Chunk), SYMBOL or chunk_id, file_path, start_line, end_line, rrf_score, sources: symbols by their
    text and chunks by their embedding, fused, within each query's workspace.

    index: of symbol_index. queries: query_id, workspace_id, text. embed adds `vector` to the queries, as the chunks' provider
    makes it.
    """
    if not 1 <= limit <= 100 or lexical_k < 0 or vector_k < 0 or lexical_k + vector_k == 0:
        raise ValueError("limit must be 1 to 100, lexical_k and vector_k not negative and not both 0")
    asked = queries.where(F.trim("text") != "")
    one = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min(F.struct("workspace_id", "repo", "file_path", "start_line", "end_line", "embedding")).alias("c")).select("chunk_id", "c.*")
    lists = {}
    if lexical_k:
        lists["lexical"] = index.search(asked, lexical_k).select("query_id", F.concat_ws("\x1f", F.lit("Symbol"), *SYMBOL).alias("key"), "score")
    if vector_k:
        near = vector_topk(one, "chunk_id", "embedding", embed(asked).select("query_id", "workspace_id", "vector"), vector_k, "workspace_id")
        lists["vector"] = near.select("query_id", F.concat_ws("\x1f", F.lit("Chunk"), "chunk_id").alias("key"), "score")
    parts = F.split("key", "\x1f")
    fused = fuse(lists, "key", limit, by=["query_id"]).withColumn("kind", parts[0])
    hit = fused.where("kind = 'Symbol'").select("query_id", "kind", parts[1].alias("workspace_id"), parts[2].alias("repo"), parts[3].alias("fqn"), "rrf_score", "sources")
    there = ["file_path", "start_line", "end_line"]
    hit = hit.join(symbol_rows(symbols).select(*SYMBOL, *there), SYMBOL, "left").withColumn("chunk_id", F.lit(None).cast("string"))
    cut = fused.where("kind = 'Chunk'").select("query_id", "kind", parts[1].alias("chunk_id"), "rrf_score", "sources").join(one.select("chunk_id", "workspace_id", "repo", *there), "chunk_id").withColumn("fqn", F.lit(None).cast("string"))
    return hit.unionByName(cut).select("query_id", "kind", *SYMBOL, "chunk_id", *there, "rrf_score", "sources")
