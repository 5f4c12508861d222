"""Mixing sources to target weights.

A tree domain - language - source gets the total budget of tokens from its root. A node's budget goes to
its children by weight; what a child can't take (its documents times its repeats) goes to its siblings
first, and only what the whole node can't take goes up to the node's own siblings. A leaf takes its
budget from seeded epochs: whole passes over its documents, then a prefix of one more pass in an order
given by a seeded hash, up to the document whose middle passes the budget.

Sizes are tokens of a public tokenizer, counted over whole texts.

Defined results: documents whose source has no target, or none at all, are not drawn; a null language is
a language of its own; null or empty texts and those without tokens are not drawn; documents are taken
by id, re-delivered ids once (the smallest text); a target without documents gives its weight away; a
null share counts as 0, a null max_repeats as 1; shares are divided by their sum; if all are 0 nothing is drawn;
empty tables give an empty mixture and a report of zeros; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import staged
from quillgraph.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public byte-level BPE's pattern of pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Domains of the sources; a source without one is in OTHER.
DOMAINS = {"issue": "discussion", "review": "discussion", "chat": "discussion", "transcript": "discussion", "commit": "history", "changelog": "history", "apidoc": "documentation", "readme": "documentation", "runbook": "documentation", "designnote": "documentation"}
OTHER, NO_LANGUAGE = "other", "und"
SEED = 42
#: The targets and the leaves (sources with target times languages) are planned on the driver: at most so many.
MOST_LEAVES = 200_000
#: A leaf's epoch is cut into so many slices by hash; only the slice in which its budget ends is sorted.
SLICES = 4096


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """The number of tokens of the whole text."""
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, tokens: one row per document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(tokens=[count_tokens(t, tokenizer) for t in b["text"]])

    kept = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("text").isNotNull())
    rows = kept.select("doc_id", "source", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    once = rows.mapInPandas(count, "doc_id bigint, source string, lang string, tokens bigint")
    return once.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "tokens")).alias("d")).select("doc_id", "d.*")


def divide(amount: float, weights: list[float], capacities: list[float]) -> list[float]:
    """amount by weights within the capacities; what one can't take goes to the others by their weights."""
    given, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if capacities[i] > 0]
    left = amount
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        share = {i: left * (weights[i] / total if total else 1 / len(open_)) for i in open_}
        full = [i for i in open_ if given[i] + share[i] >= capacities[i] - 1e-9]
        if not full:
            for i in open_:
                given[i] += share[i]
            return given
        for i in full:
            left -= capacities[i] - given[i]
            given[i] = capacities[i]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def plan(leaves: list[dict], targets: dict[str, tuple[float, int]], total: float | None, domains: dict[str, str]) -> list[dict]:
    """leaves: source, lang, tokens. Returns them with budget; total None: see mixture."""
    shares = sum(t[0] for t in targets.values())
    if not shares:
        return [leaf | {"budget": 0.0} for leaf in leaves]
    available = {s: sum(leaf["tokens"] for leaf in leaves if leaf["source"] == s) for s in targets}
    limits = [available[s] * repeats / (share / shares) for s, (share, repeats) in targets.items() if share and available[s] * repeats]
    if total is None:
        total = min(limits, default=0.0)
    nodes: dict[str, dict[str, list[dict]]] = {}
    for leaf in leaves:
        share, repeats = targets[leaf["source"]]
        weight = share / shares * leaf["tokens"] / available[leaf["source"]]
        nodes.setdefault(domains.get(leaf["source"], OTHER), {}).setdefault(leaf["lang"], []).append(leaf | {"weight": weight, "cap": float(leaf["tokens"] * repeats)})
    for s, (share, _) in targets.items():
        if not available[s]:  # its weight counts in its domain, where it leaves a shortage
            nodes.setdefault(domains.get(s, OTHER), {}).setdefault(NO_LANGUAGE, []).append({"source": s, "lang": NO_LANGUAGE, "tokens": 0, "weight": share / shares, "cap": 0.0})

    def down(children, amount: float) -> list[dict]:
        if isinstance(children, list):
            got = divide(amount, [c["weight"] for c in children], [c["cap"] for c in children])
            return [c | {"budget": g} for c, g in zip(children, got, strict=True)]
        parts = [children[k] for k in sorted(children)]
        flat = [_flat(p) for p in parts]
        got = divide(amount, [sum(x["weight"] for x in f) for f in flat], [sum(x["cap"] for x in f) for f in flat])
        return [leaf for p, g in zip(parts, got, strict=True) for leaf in down(p, g)]

    return [leaf for leaf in down(nodes, total) if leaf["tokens"]]


def _flat(node) -> list[dict]:
    return node if isinstance(node, list) else [leaf for child in node.values() for leaf in _flat(child)]


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    once = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = once.limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError("too many targets to plan on the driver")
    return {r["source"]: (max(r["share"] or 0.0, 0.0), max(1 if r["repeats"] is None else r["repeats"], 0)) for r in rows}


def mixture(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, domains: dict[str, str] = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). drawn: doc_id, source, lang, tokens, copies. report: per source its target and actual share.

    total: tokens of the mixture. None: the largest total at which no source with documents falls short; "available":
    all tokens of the sources that have a target, so that small sources fall short and others take their part.
    """
    spark = documents.sparkSession
    sized = staged(with_tokens(documents, tokenizer), "mixing-tokens")
    wanted = _targets(targets)
    named = targets.where(F.col("source").isNotNull()).select("source").distinct()
    of = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").join(named, "source", "left_semi")
    rows = [r.asDict() for r in of.limit(MOST_LEAVES + 1).collect()]
    if len(rows) > MOST_LEAVES:
        raise ValueError("too many leaves to plan on the driver")
    if total == "available":
        total = float(sum(r["tokens"] for r in rows))
    planned = plan(sorted(rows, key=lambda r: (r["source"], r["lang"])), wanted, total, domains)
    epochs = [(x["source"], x["lang"], e := min(wanted[x["source"]][1], math.floor(x["budget"] / x["tokens"] + 1e-9)), max(0.0, x["budget"] - e * x["tokens"]) if e < wanted[x["source"]][1] else 0.0) for x in planned]
    budgets = spark.createDataFrame(epochs, "source string, lang string, whole int, rest double")
    key = F.xxhash64(F.lit(seed), F.col("whole"), "doc_id")
    docs = sized.where(F.col("tokens") > 0).join(F.broadcast(budgets), ["source", "lang"])  # at most MOST_LEAVES rows
    docs = docs.withColumn("key", key).withColumn("slice", F.pmod("key", F.lit(SLICES)))
    slices = docs.groupBy("source", "lang", "slice", "rest").agg(F.sum("tokens").alias("t"))
    up = W.partitionBy("source", "lang").orderBy("slice").rowsBetween(W.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum("t").over(up))
    last = slices.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
    ends = last.select("source", "lang", F.col("slice").alias("last"), (F.col("upto") - F.col("t")).alias("before"))  # one row per leaf
    docs = docs.join(F.broadcast(ends), ["source", "lang"], "left")
    # the slice in which the budget ends; of the others whole documents are in or out
    within = W.partitionBy("source", "lang").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    cut = docs.where(F.col("slice") == F.col("last")).withColumn("cum", F.col("before") + F.sum("tokens").over(within))
    cut = cut.withColumn("extra", (F.col("cum") - F.col("tokens") / 2 <= F.col("rest")).cast("int")).drop("cum")
    others = docs.where(F.col("last").isNull() | (F.col("slice") != F.col("last"))).withColumn("extra", ((F.col("rest") > 0) & (F.col("last").isNull() | (F.col("slice") < F.col("last")))).cast("int"))
    drawn = cut.unionByName(others).withColumn("copies", F.col("whole") + F.col("extra")).where(F.col("copies") > 0)
    drawn = drawn.select("doc_id", "source", "lang", "tokens", "copies")
    planned_sources = {}
    for x in planned:
        planned_sources[x["source"]] = planned_sources.get(x["source"], 0.0) + x["budget"]
    shares = sum(t[0] for t in wanted.values()) or 1.0
    asked = spark.createDataFrame([(s, share / shares, repeats, planned_sources.get(s, 0.0)) for s, (share, repeats) in sorted(wanted.items())], "source string, target_share double, max_repeats int, budget_tokens double")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    report = asked.join(have, "source", "full").join(got, "source", "left")
    zero = {"target_share": 0.0, "max_repeats": 0, "budget_tokens": 0.0, "available_tokens": 0, "drawn_tokens": 0, "most_copies": 0}
    report = report.fillna(zero)
    total_drawn = F.sum("drawn_tokens").over(W.partitionBy())  # one row per source
    return drawn, report.withColumn("actual_share", F.when(total_drawn > 0, F.col("drawn_tokens") / total_drawn).otherwise(0.0))


def p9_mixture(spark, folder):
    return mixture(table(spark, folder, "documents"), table(spark, folder, "source_target"))[0]


def p9_shares(spark, folder):
    return mixture(table(spark, folder, "documents"), table(spark, folder, "source_target"))[1]


def p9_all_tokens(spark, folder):
    """The shares of a mixture as large as the corpus: sources that fall short give their part to siblings, then ancestors."""
    return mixture(table(spark, folder, "documents"), table(spark, folder, "source_target"), "available")[1]


SQL = {}
QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_all_tokens": p9_all_tokens}
