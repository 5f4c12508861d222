import random
import string

from pyspark.sql import functions as F

from quillgraph.llm import leakage


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, s in items:
            x = leakage.words(s)
            for k in range(max(1, len(x) - leakage.N + 1)) if x else ():
                g = x[k : k + leakage.N]
                if any(w[n : n + len(g)] == g for n in range(len(w) - len(g) + 1)):
                    out.add((i, d))
    return out


def test_words():
    assert leakage.words("Ｔhe c­at—it's_9") == ["the", "cat", "it", "s", "9"]
    assert leakage.words(None) == [] == leakage.words(" -- ")


def test_common_words():
    assert leakage.common_words("a b c d".split(), "x a c d y".split()) == 3
    assert leakage.common_words(["a"], []) == 0


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(300)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(text(rng.choice([3, 9, 13, 40])))) for i in range(30)] + [(90, None), (91, "..."), (92, "")]
    docs = []
    for d in range(300):
        body = text(rng.randrange(120))
        if d % 3 == 0:
            w = rng.choice(items[:30])[1].split()
            a = rng.randrange(max(1, len(w) - 12))
            piece = w[a : a + rng.choice([12, 13, 20])]
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() if rng.random() < 0.3 else x + rng.choice(["", ",", "\n", "\u00ad"]) for x in piece]
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, " "), (902, " ".join(text(60_000)) + " " + items[3][1]), docs[0]]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("words", F.lit(1)).withColumn("id", F.lit("x"))
    got = leakage.leaks(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    copies = [(x["item_id"], x["doc_id"]) for x in got if x["kind"] == "copy"]
    assert len(copies) == len(set(copies))
    assert set(copies) == brute(docs, items)


def test_paraphrase(spark):
    item = "Count the 17 gasket symbols visible to pointer once narrow tracker is loaded with overrides today"
    docs = [(1, "We had to count all the 17 gasket symbols visible to pointer once tracker is loaded with overrides"), (2, "Something else about seventeen cats and their owners in the house by the river")]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert [(x["doc_id"], x["kind"]) for x in got] == [(1, "paraphrase")]


def test_paraphrase_behind_a_better_candidate(spark):
    item = "Count the gasket symbols visible to 17 pointer once narrow tracker is loaded with overrides today"
    other = "Count the gasket symbols visible to 19 pointer once narrow tracker is loaded with overrides today"
    loose = "Count quiet gasket symbols brown visible to 17 green pointer once seven tracker is loaded"
    filler = " and then nothing more was said of it by anyone in that house near the old river bank "
    docs = [(1, other + filler + loose), (2, loose + filler + other), (3, other + filler)]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert sorted((x["doc_id"], x["kind"]) for x in got) == [(1, "paraphrase"), (2, "paraphrase")]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaks(docs, items).count() == 0
    assert leakage.leaks(docs, spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")).count() == 0
