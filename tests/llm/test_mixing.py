import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing

DOC = "doc_id bigint, text string, lang string, source string"
TARGET = "source string, target_share double, max_repeats int"


def test_divide():
    assert mixing.divide(10, [1, 1], [100, 100]) == [5, 5]
    assert mixing.divide(10, [1, 1], [2, 100]) == [2, 8]
    assert mixing.divide(10, [1, 1, 2], [1, 2, 3]) == [1, 2, 3]
    assert mixing.divide(10, [0, 1], [5, 100]) == [0, 10]
    assert mixing.divide(0, [1], [1]) == [0]


def test_shortage_goes_to_siblings_first():
    leaves = [{"source": s, "lang": "en", "tokens": n} for s, n in (("a", 10), ("b", 1000), ("c", 1000))]
    targets = {"a": (0.4, 1), "b": (0.2, 1), "c": (0.4, 1)}
    got = {x["source"]: x["budget"] for x in mixing.plan(leaves, targets, 100, {"a": "x", "b": "x", "c": "y"})}
    assert got == pytest.approx({"a": 10, "b": 50, "c": 40})


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("whole", F.lit(1)).withColumn("tokens", F.lit("x"))


def test_shares_and_repeats(spark):
    rows = [(i, f"word{i % 7} " * (5 + i % 11), ["en", None][i % 5 == 0], "big") for i in range(400)] + [(1000 + i, "alpha beta gamma " * 6, "en", "small") for i in range(10)]
    rows += [(2000, None, "en", "big"), (2001, "", "en", "small"), (2002, "x", "en", "other"), (2003, "x", "en", None), (2004, "q " * 200_000, "en", "other"), *rows[:5]]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2), ("small", None, None)], TARGET)
    drawn, report = mixing.mixture(docs(spark, rows), targets)
    got = {x["source"]: x for x in report.collect()}
    assert got["small"]["most_copies"] == 3 and got["other"]["drawn_tokens"] == 0 and got["gone"]["drawn_tokens"] == 0
    assert got["big"]["drawn_tokens"] == pytest.approx(got["big"]["budget_tokens"], abs=40)
    assert sum(x["actual_share"] for x in got.values()) == pytest.approx(1)
    copies = {x["doc_id"]: x["copies"] for x in drawn.collect()}
    assert len(copies) == drawn.count() and max(copies.values()) <= 3
    again, _ = mixing.mixture(docs(spark, rows).repartition(7), targets)
    assert {x["doc_id"]: x["copies"] for x in again.collect()} == copies
    other, _ = mixing.mixture(docs(spark, rows), targets, seed=1)
    assert {x["doc_id"]: x["copies"] for x in other.collect()} != copies


def test_total_and_empty(spark):
    rows = [(i, "one two three four", "en", "a") for i in range(100)]
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGET)
    drawn, report = mixing.mixture(docs(spark, rows), targets, total=600.0)
    assert report.first()["drawn_tokens"] == 600
    assert {x["copies"] for x in drawn.collect()} == {1, 2}
    drawn, report = mixing.mixture(docs(spark, []), targets)
    assert drawn.count() == 0 and report.first()["drawn_tokens"] == 0
    assert mixing.mixture(docs(spark, rows), targets.limit(0))[0].count() == 0


def test_tokens_of_whole_texts():
    assert mixing.count_tokens(None) == 0 and mixing.count_tokens("hello world") == 2
    assert mixing.count_tokens("hello " * 300_000) > 300_000 - 5


def test_whole_text_is_counted_at_once():
    text = "x" * 999_990 + " straddling the millionth character " + "y z" * 10
    assert mixing.count_tokens(text) == len(mixing._encoding(mixing.TOKENIZER).encode_ordinary(text))
    assert mixing.count_tokens("a" * 1_200_000) > 0


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(i, "one two three four", "en", s) for i, s in enumerate(["issue"] * 5 + ["review"] * 60 + ["readme"] * 100)]
    targets = spark.createDataFrame([("issue", 0.4, 2), ("review", 0.2, 1), ("readme", 0.4, 1)], TARGET)
    _, report = mixing.mixture(docs(spark, rows), targets, total="available")
    got = {x["source"]: x for x in report.collect()}
    # of 660 tokens the discussion's 396 are: 40 of issue's 264 (10 texts of 4), and review takes what it has
    assert got["issue"]["drawn_tokens"] == 40 and got["review"]["drawn_tokens"] == 240
    assert got["issue"]["most_copies"] == 2 and got["readme"]["drawn_tokens"] == pytest.approx(380, abs=4)
