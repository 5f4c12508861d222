import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import authorship as au

BY_HAND = 'import a\n\ndef f(x):\n    """Auto-generated stub."""\n    marker = "@generated"\n    return x\n'


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.py", "# Code generated by protokiln. DO NOT EDIT.\nx = 1", "generated"),
        ("a.ts", "// ------\n// This file was written by x 1.2; manual edits will be overwritten", "generated"),
        ("a.js", "/* @generated by x */", "generated"),
        ("a.py", "# Diese Datei wurde automatisch erzeugt (x).", "generated"),
        ("src/gen/x_stub.py", "class A: pass", "generated"),
        ("x_pb2.py", "", "generated"),
        ("vendor/a/b.js", "x", "vendored"),
        ("a.js", "/*! kit v1.2.3 | Some License */\nx", "vendored"),
        ("a.js", "/**\n * kit - v1.2.3\n * (c) kit contributors\n * @license X\n */", "vendored"),
        ("a.py", "# Copyright (c) us. All rights reserved.\nx = 1", None),
        ("static/kit-1.2.3.js", "x", "vendored"),
        ("dist/a.min.js", "x", "minified"),
        ("a.js", "!function(){" + "if(window.a)window.a.b('c',1);var d=function(e){for(var f=0;f<e.length;f++)e[f]^=9;return e};" * 12 + "}()", "minified"),
        ("a.py", "DATA = [\n" + "  1, 2, 3,\n" * 40 + "]", "data"),
        ("a.ts", 'export const D = "' + "Ab9+" * 400 + '"', "data"),
        ("a.ts", '{"a": 1, "b": 2, "c": 3}', "data"),
        ("src/a.py", BY_HAND, None),
        ("src/dist_sampler/vendor_portal/gen_x.py", BY_HAND, None),
        ("a.ts", "export const texts = {'a': '" + "some words of prose " * 60 + "'};\nfunction f(x) {\n  return x\n}", None),
        ("a.py", "", None),
    ],
)
def test_signs(path, text, want):
    assert au.signs(path, text) == want


def lines(rng, n):
    return [f"value_{rng.randrange(10**9)} = compute_{rng.randrange(10**9)}(x)" for _ in range(n)]


def test_containment(spark):
    rng = random.Random(7)
    common = lines(rng, 10)
    library = lines(rng, 40)
    texts, records = {}, []

    def add(i, repo, body, path="src/a.py"):
        texts[i] = "\n".join(body)
        records.append((i, "w", repo, path))

    for i in range(60):
        add(i, f"r{i % 7}", [*lines(rng, 30), *common])  # by hand, with lines that all have
    add(100, "r1", library)
    add(101, "r2", [*library[:30], *lines(rng, 5)])  # patched
    add(102, "r3", [*lines(rng, 3), *library[5:]])
    add(103, "r1", library[:15] + lines(rng, 40))  # took a part only
    mine = lines(rng, 30)
    add(110, "r5", mine)
    add(111, "r5", mine)  # a copy within the repository
    same = lines(rng, 20)
    add(120, "r1", same)
    add(121, "r2", ["  " + x for x in same])  # indented otherwise
    for i in range(200, 280):
        add(i, f"s{i}", library)  # many equal copies are one class
    rows = spark.createDataFrame(records, "file_id bigint, workspace_id string, repo string, repo_relative_path string").withColumn("class", F.lit(1)).withColumn("line", F.lit(2))
    got = {x["file_id"] for x in au.not_by_hand(rows, spark.createDataFrame(list(texts.items()), "file_id bigint, text string")).collect()}
    assert got == {100, 101, 102, 120, 121, *range(200, 280)}


def test_containment_of_lines_in_many_files(spark):
    rng = random.Random(9)
    library = lines(rng, 12)
    body = {i: [*library, *lines(rng, 10)] for i in range(400)} | {500: library, 501: [*library, *lines(rng, 2)]}
    records = [(i, "w", "r2" if i == 501 else "r1", "src/a.py", "python") for i in body]
    texts = spark.createDataFrame([(i, "\n".join(x)) for i, x in body.items()], "file_id bigint, text string")
    found = au.not_by_hand(spark.createDataFrame(records, "file_id bigint, workspace_id string, repo string, repo_relative_path string, lang string"), texts).collect()
    assert [(x["file_id"], x["kind"]) for x in found] == [(500, "vendored")]


def test_nulls_and_empty(spark):
    schema = "file_id bigint, workspace_id string, repo string, repo_relative_path string"
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "x = 1"), (5, "y\n" * 100_000)], "file_id bigint, text string")
    rows = spark.createDataFrame([(1, None, None, "vendor/x.js"), (2, "w", "r", None), (3, "w", "r", "a.py"), (4, "w", "r", "b.py"), (None, "w", "r", "vendor/y.js"), (1, None, None, "vendor/x.js"), (5, "w", "r", "c.py")], schema)
    assert [x["file_id"] for x in au.not_by_hand(rows, texts).collect()] == [1]
    assert au.not_by_hand(rows.limit(0), texts).count() == 0


def test_a_mark_below_a_long_licence():
    licence = "\n".join(f"// {i}: permission is granted to any person who " + "obtains a copy of it and " * 10 for i in range(60))
    assert len(licence) > 4000 and au.signs("a.js", f"{licence}\n//\n// Code generated by x. DO NOT EDIT.\nlet a = 1") == "generated"


def test_containment_decides_before_the_rules(spark):
    rng = random.Random(4)
    body = ["# Code generated by x. DO NOT EDIT.", *lines(rng, 20)]
    rest = [lines(rng, 9) for _ in range(20)]
    records = [(1, "w", "r1", "a.py"), (2, "w", "r2", "a.py"), *[(10 + i, "w", f"r{i}", "b.py") for i in range(20)]]
    texts = [(1, "\n".join(body)), (2, "\n".join(body)), *[(10 + i, "\n".join(x)) for i, x in enumerate(rest)]]
    rows = spark.createDataFrame(records, "file_id bigint, workspace_id string, repo string, repo_relative_path string")
    got = {x["file_id"]: x["kind"] for x in au.not_by_hand(rows, spark.createDataFrame(texts, "file_id bigint, text string")).collect()}
    assert got == {1: "vendored", 2: "vendored"}
