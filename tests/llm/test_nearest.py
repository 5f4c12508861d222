import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import nearest


def brute(vectors, k, least=-2.0):
    ids = sorted(vectors)
    u = nearest._unit(np.array([vectors[i] for i in ids], dtype=np.float32))
    s = (u @ u.T).round(nearest.DIGITS)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ids[b]))[:k]
        out[i] = [(ids[b], s[a, b]) for b in order]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "key string, v array<float>")


@pytest.fixture
def clusters():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    rows = [c + rng.standard_normal(64) * 0.15 for c in centres for _ in range(5)]
    rows += [rows[0] * 3.0] * 3 + [rows[7]] * 9  # copies, one longer than its kin
    return {f"c{n:04d}": np.float32(v) for n, v in enumerate(rows)}


def test_exact_search_is_brute_force(spark, clusters, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 64)  # several shards
    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)
    got = {}
    for x in nearest.top(frame(spark, clusters), "key", "v", 5, relax=1.0).collect():
        got.setdefault(x["id"], {})[x["rank"]] = (x["other"], x["score"])
    want = brute(clusters, 5)
    assert set(got) == set(want)
    for i, ranks in got.items():
        found = [ranks[r] for r in sorted(ranks)]
        assert [s for _, s in found] == pytest.approx([s for _, s in want[i]], abs=2e-7)
        assert len({o for o, _ in found} & {o for o, _ in want[i]}) >= 4  # scores of scaled copies tie up to rounding


def test_relaxed_recall(spark, clusters, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 64)
    want = {tuple(sorted((i, o))) for i, near in brute(clusters, 5, 0.9).items() for o, _ in near}
    got = {(x["a"], x["b"]) for x in nearest.similar_pairs(frame(spark, clusters), "key", "v", 0.9).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_search_radius_and_self():
    rng = np.random.default_rng(2)
    p = rng.standard_normal((200, 8)).astype(np.float32)
    q, found, score = nearest.search(p, p, np.arange(200), 3, 1.0, None, 16)
    u = nearest._unit(p)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = nearest._best(q, found, score, 3)
    for a in range(200):
        assert sorted(score[best][q[best] == a]) == pytest.approx(sorted(s[a])[-3:], abs=1e-8)


def test_unusable_and_clashing(spark):
    good = [1.0] + [0.0] * 63
    rows = [("a", good), ("b", good), ("b", good), ("c", None), ("d", [1.0] * 3), ("e", [0.0] * 64), ("f", [float("nan")] + [1.0] * 63), ("g", [float("inf")] + [1.0] * 63), (None, good), ("h", [None] + [1.0] * 63), ("i", [0.0, 1.0] + [0.0] * 62)]
    df = spark.createDataFrame(rows, "key string, v array<float>").withColumn("id", F.lit(1)).withColumn("vec", F.lit(b"x")).withColumn("point", F.lit("p"))
    assert {(x["a"], x["b"], x["score"]) for x in nearest.similar_pairs(df, "key", "v", 0.9).collect()} == {("a", "b", 1.0)}
    assert nearest.top(df.limit(0), "key", "v").count() == 0
    assert nearest.top(df.where("key = 'a'"), "key", "v").count() == 0


def test_many_copies(spark):
    good = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(f"k{n:03d}", good) for n in range(150)], "key string, v array<float>")
    got = {(x["a"], x["b"]) for x in nearest.similar_pairs(df, "key", "v", 0.9).collect()}
    want = {tuple(sorted((f"k{n:03d}", f"k{o:03d}"))) for n in range(150) for o in [m for m in range(6) if m != n][:5]}
    assert got == want


def test_large_shards_are_cut_into_parts(spark, clusters, monkeypatch):
    """Where the router can have no more shards, a shard's points come in parts: the result is the same."""
    monkeypatch.setattr(nearest, "SHARD_ROWS", 20)
    monkeypatch.setattr(nearest, "MOST_SAMPLE", 4 * nearest.SAMPLE_PER_SHARD)
    monkeypatch.setattr(nearest, "LEAF_ROWS", 8)
    got = {}
    for x in nearest.top(frame(spark, clusters), "key", "v", 5, relax=1.0).collect():
        got.setdefault(x["id"], []).append(x["score"])
    want = brute(clusters, 5)
    assert {i: pytest.approx(sorted(s), abs=2e-7) for i, s in got.items()} == {i: sorted(s for _, s in near) for i, near in want.items()}
