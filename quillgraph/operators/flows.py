"""Linking clients to routes and producers to consumers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import path_segments, path_similarity

LEAST_SIMILARITY = 0.7
DYNAMIC = "<dynamic>"


#: Stand for a free position of a client's and of a route's path (or for their method *) in the keys by which they meet.
_CLIENT_FREE, _ROUTE_FREE = "\x01", "\x02"


def _options(part: Column, free: str, client: bool) -> Column:
    """Keys of one position: a client and a route share one just if their parts are equal or one of them is free."""
    own, other = (F.array(F.lit(_CLIENT_FREE), F.lit(_ROUTE_FREE)), F.lit(_ROUTE_FREE)) if client else (F.array(F.lit(_ROUTE_FREE)), F.lit(_CLIENT_FREE))
    return F.when(part == free, own).otherwise(F.array(part, other))


def _keys(path: Column, method: Column, least: float, client: bool) -> Column:
    """The keys of a path: so many positions may differ, hence cut into one more group, one group agrees whole."""
    parts = path_segments(path)
    groups = F.floor(F.size(parts) * F.lit(1 - least) + 1e-9).cast("int") + 1
    numbered = F.transform(parts, lambda x, i: F.struct((i % groups).alias("g"), x.alias("x")))

    def one(g: Column) -> Column:
        own = F.filter(numbered, lambda p: p["g"] == g)
        start = F.transform(_options(method, "*", client), lambda m: F.concat(g.cast("string"), F.lit("/"), m))
        return F.aggregate(own, start, lambda acc, p: F.flatten(F.transform(acc, lambda a: F.transform(_options(p["x"], "{}", client), lambda o: F.concat(a, F.lit("/"), o)))))

    return F.flatten(F.transform(F.sequence(F.lit(0), groups - 1), one))


def http_flows(clients: DataFrame, routes: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """call_id, route_id, match_score: every route that ties for a client's best score.

    clients: call_id, workspace_id, method, path; routes: route_id, workspace_id, method, path (normalised).
    Paths of different length never match. At `least`, only few positions may differ, so a client is compared only with
    routes that agree with it in one group of positions; * stands for all methods. Equal (method, path) pairs are
    compared once, however many calls and routes have them.
    """
    size = F.size(path_segments(F.col("path"))).alias("segments")
    asks = clients.select("workspace_id", F.upper("method").alias("method"), "path", size).dropna().distinct()
    has = routes.select("workspace_id", F.upper("method").alias("r_method"), F.col("path").alias("r_path"), size).dropna().distinct()
    left = asks.withColumn("key", F.explode(_keys(F.col("path"), F.col("method"), least, True)))
    right = has.withColumn("key", F.explode(_keys(F.col("r_path"), F.col("r_method"), least, False)))
    met = left.join(right, ["workspace_id", "segments", "key"]).drop("key", "segments").distinct()
    scored = met.withColumn("score", path_similarity(F.col("path"), F.col("r_path"))).where(F.col("score") >= least)
    best = scored.groupBy("workspace_id", "method", "path").agg(F.max("score").alias("best"))
    kept = scored.join(best, ["workspace_id", "method", "path"]).where("score = best")
    calls = clients.select("call_id", "workspace_id", F.upper("method").alias("method"), "path")
    ids = routes.select("route_id", "workspace_id", F.upper("method").alias("r_method"), F.col("path").alias("r_path"))
    return calls.join(kept, ["workspace_id", "method", "path"]).join(ids, ["workspace_id", "r_method", "r_path"]).select("call_id", "route_id", F.round("score", 4).alias("match_score"))


def topic_flows(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """producer_id, consumer_id, topic_name: equal topics of one workspace, unknown ones left out."""
    known = lambda df: df.where(F.col("topic_name").isNotNull() & (F.col("topic_name") != DYNAMIC))
    return known(producers).select("workspace_id", "topic_name", "producer_id").distinct().join(known(consumers).select("workspace_id", "topic_name", "consumer_id").distinct(), ["workspace_id", "topic_name"]).select("producer_id", "consumer_id", "topic_name")


def topic_counts(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """repo, topics: different known topics that a repository writes or reads."""
    both = producers.select("repo", "topic_name").unionByName(consumers.select("repo", "topic_name"))
    return both.groupBy("repo").agg(F.countDistinct(F.when(F.col("topic_name") != DYNAMIC, F.col("topic_name"))).alias("topics"))
