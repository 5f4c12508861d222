import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fused_ranking as fr

HIT = "query_id bigint, hit_id bigint, lexical_score double, vector_score double, rrf_score double"


def brute(rows):
    out = {}
    rows = sorted({r for r in rows if r[0] is not None and r[1] is not None}, key=str)
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        total = dict.fromkeys((r[1] for r in own), 0.0)
        for c in (2, 3, 4):
            values = [float("-inf") if r[c] is None or r[c] != r[c] else r[c] for r in own]
            for r, v in zip(own, values, strict=True):
                p = (sum(x < v for x in values) + values.count(v) / 2) / len(values)
                total[r[1]] += NormalDist().inv_cdf(p) / 3
        out[q] = sorted(((round(s, 9) + 0.0, h) for h, s in total.items()), key=lambda x: (-x[0], x[1]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    value = lambda scale: rng.choice([None, rng.randrange(5) * scale, rng.random() * scale, -rng.random() * scale])
    rows = [(rng.randrange(6), i, value(1e6), value(1.0), value(1e-6)) for i in range(200)]
    rows += [(7, 500 + i, None, float(i), None) for i in range(5)] + [(8, 600, 1.0, None, None)] + [(9, 700 + i, None, None, None) for i in range(3)]
    rows += rows[:30] + [(None, 1, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    scored = fr.fused(spark.createDataFrame(rows, HIT).withColumn("value", F.lit(1)).withColumn("score", F.lit("x")))
    want = brute(rows)
    first = {x["query_id"]: x["hit_id"] for x in fr.first_hits(scored).collect()}
    assert first == {q: hits[0][1] for q, hits in want.items()}
    order = {}
    for x in fr.positions(scored).collect():
        order.setdefault(x["query_id"], {})[x["position"]] = (x["hit_id"], x["fused_score"])
    for q, hits in want.items():
        assert [order[q][n + 1][0] for n in range(len(hits))] == [h for _, h in hits]
        assert [order[q][n + 1][1] for n in range(len(hits))] == pytest.approx([s for s, _ in hits], abs=2e-9)


def test_scale_has_no_say(spark):
    rows = [(1, 1, 1e9, 0.1, 0.1), (1, 2, 5.0, 0.9, 0.9), (1, 3, 4.0, 0.5, 0.5)]
    assert fr.first_hits(fr.fused(spark.createDataFrame(rows, HIT))).first()["hit_id"] == 2


def test_empty_and_nan(spark):
    assert fr.fused(spark.createDataFrame([], HIT)).count() == 0
    rows = [(1, 1, float("nan"), None, None), (1, 2, 0.0, None, None)]
    assert fr.first_hits(fr.fused(spark.createDataFrame(rows, HIT))).first()["hit_id"] == 2


def test_quantile(spark):
    for p in (1e-6, 0.01, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6):
        got = spark.range(1).select(fr.normal_quantile(F.lit(p)).alias("z")).first()["z"]
        assert got == pytest.approx(NormalDist().inv_cdf(p), rel=3e-9, abs=1e-9)
