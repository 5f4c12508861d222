import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as fn
from quillgraph.operators import catalog, chunking, flows, incremental, resolve, search, traverse
from quillgraph.operators.facts import module_name, normal_path, split_url


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["/users/{id}", "/users/{id:int}", "/users/:id", "/users/[id]", "/users/<int:id>"])
def test_paths_become_equal(spark, raw):
    assert normal_path(raw) == "/users/{}"
    assert one(spark, fn.normalize_path(F.lit(raw))) == "/users/{}"


@pytest.mark.parametrize(("raw", "want"), [("users", "/users"), ("", ""), ("/", "/"), ("//a//b/", "/a/b"), ("/a?x=1", "/a?x=1")])
def test_paths(spark, raw, want):
    assert normal_path(raw) == want == one(spark, fn.normalize_path(F.lit(raw)))


@pytest.mark.parametrize(("a", "b", "want"), [("/users/{}", "/users/{}", 1.0), ("/users/{}", "/orders/{}", 0.5), ("/users", "/users/{}", 0.0), ("/", "/", 1.0)])
def test_similarity(spark, a, b, want):
    assert one(spark, fn.path_similarity(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("path", "lang", "want"), [("src/a_b/cli.py", "python", "a_b.cli"), ("lib/util.py", "python", "util"), ("a/b/__init__.py", "python", "a.b"), ("src/index.ts", "typescript", ""), ("a/index.js", "javascript", "a"), ("src/src/x.tsx", "typescript", "x")])
def test_module_names(spark, path, lang, want):
    assert module_name(path, lang) == want == one(spark, fn.module_fqn(F.lit(path), F.lit(lang)))


def test_urls(spark):
    for url, want in [("https://h.io/a", ("https://h.io", "/a")), ("https://h.io", ("https://h.io", "/")), ("/a", (None, "/a"))]:
        assert split_url(url) == want
        assert (one(spark, fn.split_url(F.lit(url))[0]), one(spark, fn.split_url(F.lit(url))[1])) == want


def test_vectors_and_ids(spark):
    assert one(spark, fn.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, fn.l2_normalized(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, fn.l2_normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, fn.stable_id("r", F.lit("a"), F.lit(None))) == one(spark, fn.stable_id("r", F.lit("a"), F.lit("None")))
    assert fn.escape_search("a+b (c)") == r"a\+b \(c\)"
    assert one(spark, fn.common_prefix(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == 2
    assert one(spark, fn.snippet(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"


CALLS = "call_id bigint, workspace_id string, repo string, file_path string, caller_fqn string, call_text string"
IMPORTS = "import_id bigint, workspace_id string, repo string, file_path string, local_name string, target_fqn string, seq bigint"
SYMBOLS = "workspace_id string, repo string, fqn string, name string"


def test_strategies(spark):
    symbols = [("w", "r", "m.a", "a"), ("w", "r", "m.b", "b"), ("w", "q", "x.only", "only"), ("w", "r", "m.K.run", "run"), ("w", "q", "z.K.run", "run"), ("w", "q", "z.J.run", "run"), ("w", "q", "lib.tool", "tool"), ("w", "r", "m.a", "a")]
    imports = [(1, "w", "r", "f", "t", "lib.tool", 1), (2, "w", "r", "f", "lib", "other", 1), (3, "w", "r", "f", "lib", "lib", 2), (4, "w", "r", "f", "*", "zz", 3)]
    calls = [(1, "w", "r", "f", "m.b", "a"), (2, "w", "r", "f", "m.b", "t"), (3, "w", "r", "f", "m.b", "lib.tool"), (4, "w", "r", "f", "m.b", "s.only"), (5, "w", "r", "f", "m.b", "self.run"), (6, "w", "r", "f", "y.b", "J.run"), (7, "w", "r", "f", "m.b", "nothing"), (8, "v", "r", "f", "m.b", "a"), (9, "w", "r", "f", None, "a"), (10, "w", "r", "f", "m.b", None)]
    got = {x["call_id"]: (x["callee_fqn"], x["strategy"], x["confidence"]) for x in resolve.resolve(spark.createDataFrame(calls, CALLS), spark.createDataFrame(imports, IMPORTS), spark.createDataFrame(symbols, SYMBOLS)).collect()}
    assert got == {1: ("m.a", "same-module", 0.95), 2: ("lib.tool", "import-suffix", 0.9), 3: ("lib.tool", "import-suffix", 0.9), 4: ("x.only", "unique-global", 0.85), 5: ("m.K.run", "suffix-distance", 0.75), 6: ("z.J.run", "syntactic-fallback", 0.55)}
    resolved = {x["import_id"]: x["resolved_fqn"] for x in resolve.resolve_imports(spark.createDataFrame(imports, IMPORTS), spark.createDataFrame(symbols, SYMBOLS)).collect()}
    assert resolved == {1: "lib.tool", 2: None, 3: None, 4: None}


def test_http_flows(spark):
    clients = spark.createDataFrame([(1, "w", "get", "/users/42"), (2, "w", "POST", "/users/42"), (3, "w", "GET", "/a/b/c"), (4, "w", "*", "/only/x"), (5, "v", "GET", "/users/42")], "call_id bigint, workspace_id string, method string, path string")
    routes = spark.createDataFrame([(10, "w", "GET", "/users/{}"), (11, "w", "*", "/users/{}"), (12, "w", "GET", "/users/42/x"), (13, "w", "GET", "/a/b/{}"), (14, "w", "GET", "/a/x/c"), (15, "w", "PUT", "/only/x")], "route_id bigint, workspace_id string, method string, path string")
    assert {tuple(x) for x in flows.http_flows(clients, routes).collect()} == {(1, 10, 1.0), (1, 11, 1.0), (2, 11, 1.0), (3, 13, 1.0), (4, 15, 1.0)}
    assert flows.http_flows(clients.limit(0), routes).count() == 0


def test_topics(spark):
    p = spark.createDataFrame([(1, "w", "a", "orders"), (2, "w", "a", "<dynamic>"), (3, "w", "a", None)], "producer_id bigint, workspace_id string, repo string, topic_name string")
    c = spark.createDataFrame([(7, "w", "b", "orders"), (8, "w", "b", "<dynamic>"), (9, "v", "b", "orders")], "consumer_id bigint, workspace_id string, repo string, topic_name string")
    assert [tuple(x) for x in flows.topic_flows(p, c).collect()] == [(1, 7, "orders")]
    assert {tuple(x) for x in flows.topic_counts(p, c).collect()} == {("a", 1), ("b", 1)}


EDGE = "edge_id bigint, workspace_id string, caller_repo string, caller_fqn string, callee_repo string, callee_fqn string, confidence double"


def test_trails_follow_cycles_and_parallel_edges(spark):
    edges = spark.createDataFrame([(1, "w", "r", "a", "r", "b", 0.9), (2, "w", "r", "b", "r", "c", None), (3, "w", "r", "c", "r", "a", 0.5), (4, "w", "r", "a", "r", "b", 0.7)], EDGE)
    start = spark.createDataFrame([("w", "r", "a")], "workspace_id string, repo string, fqn string")
    got = {(x["fqn"], x["hops"], x["min_confidence"]) for x in traverse.trails(edges, start, 4, False).collect()}
    assert got == {("b", 1, 0.9), ("b", 1, 0.7), ("c", 2, 0.9), ("c", 2, 0.7), ("a", 3, 0.5), ("b", 4, 0.5)}
    up = {x["fqn"] for x in traverse.reach(edges, start, 5, True).collect()}
    assert up == {"a", "b", "c"}
    assert {x["fqn"] for x in traverse.reach(edges, start, 1, True, start=True).collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        traverse.trails(edges, start, 6, False)


def test_search(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "cat cat cat"), (3, "dog"), (4, None), (5, "")], "id bigint, text string")
    assert [x["id"] for x in search.bm25(docs, "id", F.col("text"), "CAT", 5).collect()] == [2, 1]
    assert search.bm25(docs, "id", F.col("text"), " ?! ", 5).count() == 0
    lists = {n: spark.createDataFrame(rows, "id string, score double") for n, rows in {"lex": [("A", 3.0), ("B", 2.0), ("C", 1.0)], "vec": [("B", 3.0), ("C", 2.0), ("A", 1.0)]}.items()}
    assert [x["id"] for x in search.fuse(lists, "id", 3).collect()][0] == "B"
    symbols = spark.createDataFrame([("a.run", "r", "run", "def run()", "must hold"), ("b.rerun", "q", "rerun", None, None)], "fqn string, repo string, name string, signature string, docstring string")
    assert [x["fqn"] for x in search.find_symbols(symbols, "run", "suffix").collect()] == ["a.run", "b.rerun"]
    assert search.find_symbols(symbols, "un", "suffix").count() == 0
    assert search.find_symbols(symbols, "must hold").first()["match_mode"] == "fuzzy"
    assert search.clamp(0) == 1 and search.clamp(99) == 50
    with pytest.raises(ValueError):
        search.find_symbols(symbols, "x", "other")


def test_chunks(spark):
    lines = [f"l{i}" for i in range(1, 301)]
    got = chunking.spans(300, [(1, 250)], lines, 80, 4)
    assert got[0] == (1, 80) and got[1][0] == 77 and got[-1] == (251, 300)
    covered = {n for a, b in got for n in range(a, b + 1)}
    assert covered == set(range(1, 301))
    assert chunking.spans(3, [], ["", " ", ""], 10, 1) == []
    with pytest.raises(ValueError):
        chunking._check(5, 5)
    texts = spark.createDataFrame([(1, "a\nb\nc\n"), (2, ""), (3, None)], "id bigint, text string")
    assert [tuple(x) for x in chunking.chunk_lines(texts, "id", "text", 2, 1).orderBy("start_line").collect()] == [(1, 1, 2, "a\nb"), (1, 2, 3, "b\nc")]


def test_embedding(spark):
    v = chunking.hash_embedding("abc")
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == chunking.hash_embedding("abc") != chunking.hash_embedding("abd")
    assert chunking.hash_embedding("")[0] == 1.0

    def fails(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[1.0, 2.0] for _ in texts]

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "text string").coalesce(1)
    for threads in (1, 3):
        assert [x["embedding"] for x in chunking.embed(df, provider=fails, dim=2, batch=1, threads=threads, check=True).collect()] == [[1.0, 2.0], None, [1.0, 2.0]]
    with pytest.raises(ValueError):
        chunking.embed(df, provider=fails, dim=3, check=True)


def test_diff_and_store(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, h string")
    got = {x["path"]: x["state"] for x in incremental.file_diff(old, new, ["path"], "h").collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "d": "changed"}
    assert incremental.has_work(incremental.file_diff(old, new, ["path"], "h")) and not incremental.has_work(incremental.file_diff(new, new, ["path"], "h"))
    store = incremental.Store(spark, f"file://{tmp_path}/s")
    schema = "workspace_id string, repo string, path string, v int"
    store.refresh("t", spark.createDataFrame([("w", "r", "a", 1), ("w", "r", "b", 1), ("w", "q", "a", 1)], schema))
    touched = spark.createDataFrame([("w", "r", "a"), ("w", "q", "a")], "workspace_id string, repo string, path string")
    store.merge("t", spark.createDataFrame([("w", "r", "a", 2)], schema), touched, ["workspace_id", "repo", "path"])
    assert {(x["repo"], x["path"], x["v"]) for x in store.read("t").collect()} == {("r", "a", 2), ("r", "b", 1)}


def test_upsert_stream(spark, tmp_path):
    from quillgraph.streaming.delta import upsert_stream

    schema = "workspace_id string, repo string, path string, v int"
    store = incremental.Store(spark, f"file://{tmp_path}/s")
    source = f"file://{tmp_path}/in"
    for rows in ([("w", "r", "a", 1), ("w", "r", "a", 2), ("w", "q", "b", 1)], [("w", "r", "a", 1), ("w", "r", "c", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), store, "t", ["workspace_id", "repo", "path"], ["v"], f"file://{tmp_path}/cp").awaitTermination()
    assert {(x["repo"], x["path"], x["v"]) for x in store.read("t").collect()} == {("r", "a", 2), ("q", "b", 1), ("r", "c", 5)}


def test_count_cache():
    now = [0.0]
    cache = catalog.CountCache(10, lambda: now[0])
    assert cache.get("w", "label", "file", True, lambda: 3) == (3, False)
    assert cache.get("w", "label", "file", True, lambda: 4) == (3, True)
    assert cache.get("w", "label", "file", True, lambda: 4, refresh=True) == (4, False)
    cache.get(None, "label", "file", False, lambda: 9)
    cache.get("v", "label", "file", True, lambda: 1)
    now[0] = 11
    assert cache.get("v", "label", "file", True, lambda: 2) == (2, False)
    assert cache.invalidate("w") == 2 and len(cache) == 1
    with pytest.raises(ZeroDivisionError):
        cache.get("z", "l", "n", True, lambda: 1 // 0)
    assert len(cache) == 1
    assert catalog.CountCache(0).get("w", "a", "b", True, lambda: 1) == (1, False)


def test_graph_schema(spark):
    nodes = {"symbol": (spark.createDataFrame([("w", "r", "a"), ("w", "r", None), ("v", "r", "a")], "workspace_id string, repo string, fqn string"), ["workspace_id", "repo", "fqn"]), "chunk": (spark.createDataFrame([("c",)], "chunk_id string"), ["chunk_id"])}
    edges = [("CALLS", "symbol", "symbol", nodes["symbol"][0]), ("OTHER", "symbol", "chunk", nodes["symbol"][0]), ("CALLS", "module", "symbol", nodes["symbol"][0].limit(0))]
    got = catalog.graph_schema(nodes, edges, "w")
    assert {(x["label"], x["n"]) for x in got["node_counts"].collect()} == {("symbol", 2), ("chunk", 1)} and got["counts_scope"] == "workspace"
    assert {(x["label"], x["property"], x["mandatory"]) for x in got["node_properties"].collect()} == {("symbol", "workspace_id", True), ("symbol", "repo", True), ("symbol", "fqn", False), ("chunk", "chunk_id", True)}
    assert {tuple(x) for x in got["edge_ends"].collect()} == {("CALLS", "symbol", "symbol", 2), ("OTHER", "symbol", "chunk", 2)}
    types = {x["rel"]: (x["ends"], x["n"]) for x in got["edge_types"].collect()}
    assert set(types) == {*catalog.EDGES, "OTHER"} and types["CALLS"] == ("symbol>symbol", 2) and types["IMPORTS"] == ("", None)
    assert got["constraints"].count() == 12 and got["indexes"].where("kind = 'lexical'").first()["properties"] == ["name", "signature", "docstring"]
    off = catalog.graph_schema(nodes, edges, None, False)
    assert off["counts_scope"] == "disabled" and off["node_counts"] is None and "n" not in off["edge_types"].columns


def test_property_fold(spark):
    rows = spark.createDataFrame([("A", "x", ["Long"], True), ("A", "x", ["String", "Long"], False), ("B", "y", ["Long"], True)], "label string, property string, types array<string>, mandatory boolean")
    assert {(x[0], x[1], tuple(x[2]), x[3]) for x in catalog.fold_properties(rows).collect()} == {("A", "x", ("Long", "String"), False), ("B", "y", ("Long",), True)}


def test_extraction_of_files_without_language(spark, tmp_path):
    from quillgraph.plans.engine_queries import QUERIES

    records = [(1, "w", "r", "a.py", None), (2, "w", "r", "b.ts", None), (3, "w", "r", "c.py", "python"), (4, "w", "r", "d.md", None), (5, "w", "r", None, None)]
    spark.createDataFrame(records, "file_id bigint, workspace_id string, repo string, repo_relative_path string, lang string").write.parquet(f"{tmp_path}/file_record.parquet")
    texts = [(1, "def f(): pass\n"), (2, "function g() {}\n"), (3, "def h(): pass\n"), (4, "def i(): pass\n"), (5, "def j(): pass\n")]
    spark.createDataFrame(texts, "file_id bigint, text string").write.parquet(f"{tmp_path}/source_text.parquet")
    assert {x["file_id"] for x in QUERIES["extract_symbol"](spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_embedding_of_whole_texts(spark):
    rows = spark.createDataFrame([(1, "a " * 70_000), (2, "a " * 70_000 + "tail")], "chunk_id bigint, text string")
    first, second = (x["embedding"] for x in chunking.embed(rows).orderBy("chunk_id").collect())
    assert first != second


SYMBOL_ROWS = [(1, "w", "r", "m.cache.load_entry", "load_entry", "def load_entry(key)", "Load an entry of the cache.", "function", "m/cache.py", 1, 5), (2, "v", "r", "m.cache.load_entry", "load_entry", "def load_entry(key)", "Load an entry of the cache.", "function", "m/cache.py", 1, 5), (3, "w", "q", "m.parser.read", "read", "def read(text)", "Read the text.", "function", "m/parser.py", 1, 5), (1, "w", "r", "m.cache.load_entry", "load_entry", "def load_entry(key)", "Load an entry of the cache.", "function", "m/cache.py", 1, 5), (4, "w", "r", "m.cache.preload_entry", None, None, None, None, None, None, None)]
SYMBOL_SCHEMA = "symbol_id bigint, workspace_id string, repo string, fqn string, name string, signature string, docstring string, kind string, file_path string, start_line int, end_line int"


def test_lookup_by_workspace(spark):
    symbols = spark.createDataFrame(SYMBOL_ROWS, SYMBOL_SCHEMA)
    found = lambda *a, **k: [(x["workspace_id"], x["fqn"], x["match_mode"]) for x in search.find_symbols(symbols, *a, **k).collect()]
    assert found("m.cache.load_entry", "exact", workspace="w") == [("w", "m.cache.load_entry", "exact")]
    assert len(found("m.cache.load_entry", "exact")) == 2 and found("m.cache.load_entry", "exact", workspace="x") == []
    assert found("load_entry", "suffix", workspace="w") == [("w", "m.cache.load_entry", "suffix"), ("w", "m.cache.preload_entry", "suffix")]
    assert found("entry of the CACHE", "auto", workspace="v") == [("v", "m.cache.load_entry", "fuzzy")]
    assert found("cache entry of", "fuzzy", workspace="w") == [] == found("", "auto")
    wanted = spark.createDataFrame([(1, "w", "m.parser.read"), (2, "w", "ad_entry"), (3, "w", "Read the text"), (4, "w", "no such thing"), (5, None, "m.parser.read")], "lookup_id int, workspace_id string, name string")
    got = search.lookup(symbols, wanted, "auto", 1).collect()
    assert {(x["lookup_id"], x["fqn"], x["match_mode"]) for x in got} == {(1, "m.parser.read", "exact"), (2, "m.cache.load_entry", "suffix"), (3, "m.parser.read", "fuzzy"), (5, "m.parser.read", "exact")}


def test_vectors_of_one_scope(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 3)
    monkeypatch.setattr(search, "BLOCK_ROWS", 2)
    rows = [(f"k{i}", "w" if i % 2 else "v", [float(i + 1), 1.0]) for i in range(10)] + [("z", "w", [0.0, 0.0]), ("n", "w", None), ("s", "w", [1.0])]
    vectors = spark.createDataFrame(rows, "id string, ws string, e array<double>")
    queries = spark.createDataFrame([(i, "w", [1.0, float(i)]) for i in range(5)] + [(9, "w", None)], "query_id int, ws string, vector array<double>")
    got = {}
    for x in search.vector_topk(vectors, "id", "e", queries, 3, "ws").collect():
        got.setdefault(x["query_id"], []).append((-x["score"], x["id"]))

    def cosine(a, b):
        return round((1 + (a[0] * b[0] + a[1] * b[1]) / ((a[0] ** 2 + a[1] ** 2) ** 0.5 * (b[0] ** 2 + b[1] ** 2) ** 0.5)) / 2, 6)

    want = {i: sorted((-cosine((1.0, float(i)), e), k) for k, ws, e in rows[:10] if ws == "w")[:3] for i in range(5)}
    assert {i: sorted(x) for i, x in got.items()} == want


def test_code_search(spark, tmp_path):
    symbols = spark.createDataFrame(SYMBOL_ROWS, SYMBOL_SCHEMA)
    index = search.symbol_index(symbols, f"file://{tmp_path}/index")
    texts = {"c1": "load the cache", "c2": "something else", "c3": "load the cache"}
    chunks = spark.createDataFrame([(i, "w" if i != "c3" else "v", "r", "f.py", 1, 2, [float(x) for x in chunking.hash_embedding(text, 8)]) for i, text in texts.items()], "chunk_id string, workspace_id string, repo string, file_path string, start_line int, end_line int, embedding array<float>")
    embed = lambda df: chunking.embed(df, dim=8, provider=lambda t: [chunking.hash_embedding(x, 8) for x in t]).withColumnRenamed("embedding", "vector")
    queries = spark.createDataFrame([(1, "w", "load the cache"), (2, "w", "  ")], "query_id int, workspace_id string, text string")
    got = search.code_search(index, symbols, chunks, queries, embed).collect()
    assert {x["query_id"] for x in got} == {1} and {x["workspace_id"] for x in got} == {"w"}
    ranks = {(x["kind"], x["fqn"] or x["chunk_id"]): x["rrf_score"] for x in got}
    assert ranks[("Symbol", "m.cache.load_entry")] == ranks[("Chunk", "c1")] == round(1 / 61, 6) and ("Chunk", "c3") not in ranks
    assert search.code_search(index, symbols, chunks, queries, embed, lexical_k=0).where("kind = 'Symbol'").count() == 0
    with pytest.raises(ValueError):
        search.code_search(index, symbols, chunks, queries, embed, lexical_k=0, vector_k=0)


def test_impact_and_traces(spark):
    edges = spark.createDataFrame([(1, "w", "r", "a", "r", "b", 0.9), (2, "w", "r", "b", "r", "c", None), (3, "w", "r", "c", "r", "a", 0.5), (4, "v", "r", "x", "r", "b", 0.7)], EDGE)
    http = spark.createDataFrame([("w", "r", "a", "GET", "/u/{}", "q", "k", 0.8), ("w", "r", "a", "GET", "/u/{}", "q", "k", 1.0), ("w", "r", "z", "*", "/z", None, None, 1.0)], "workspace_id string, route_repo string, route_handler_fqn string, method string, path_template string, client_repo string, client_caller_fqn string, match_score double")
    producers = spark.createDataFrame([("w", "r", "a", "orders"), ("v", "r", "a", "other"), ("w", "r", None, "none"), ("w", "r", "a", "<dynamic>")], "workspace_id string, repo string, caller_fqn string, topic_name string")
    target = spark.createDataFrame([("w", "r", "b")], "workspace_id string, repo string, fqn string")
    got = {(x["kind"], x["fqn"], x["detail"]) for x in traverse.impact(edges, http, target, producers=producers).collect()}
    assert got == {("upstream_symbol", f, "") for f in "abc"} | {("handled_route", "a", "GET /u/{}"), ("http_inbound", "k", "GET /u/{}"), ("kafka_inbound", "a", "orders"), ("kafka_inbound", "a", "<dynamic>")}
    trace = {(x["path_template"], x["role"], x["fqn"], x["match_score"]) for x in traverse.trace_http(http, edges, 2, "w", "get", "/u/{}").collect()}
    assert trace == {("/u/{}", "handler", "a", None), ("/u/{}", "caller", "k", 1.0), ("/u/{}", "downstream", "b", None), ("/u/{}", "downstream", "c", None)}
    assert traverse.trace_http(http, edges, 2, "w", "POST", "/u/{}").count() == 0 and traverse.trace_http(http, edges, 2, "w", "POST", "/z").count() == 1
    assert {(x["role"], x["caller_fqn"]) for x in traverse.trace_topic(producers, producers.limit(0), "w").collect()} == {("producer", "a"), ("producer", None)}
    assert traverse.trace_topic(producers, producers, "w", "orders").count() == 2


def test_tools(spark, tmp_path):
    from quillgraph.operators import tools

    symbols = spark.createDataFrame(SYMBOL_ROWS, SYMBOL_SCHEMA)
    edges = spark.createDataFrame([(1, "w", "q", "m.parser.read", "r", "m.cache.load_entry", 0.9)], EDGE)
    out = tools.call_graph(edges, symbols, "w", "load_entry", mode="suffix")
    assert out["target"]["fqn"] == "m.cache.load_entry" and out["match_mode_used"] == "suffix" and len(out["candidates"]) == 2
    assert [x["fqn"] for x in out["callers"].collect()] == ["m.parser.read"] and out["callees"].count() == 0
    assert tools.call_graph(edges, symbols, "w", "nothing.here")["candidates"] == []
    assert tools.call_graph(edges, symbols, "w", "m.cache.load_entry", direction="callers")["callees"] is None
    http = spark.createDataFrame([], "workspace_id string, route_repo string, route_handler_fqn string, method string, path_template string, client_repo string, client_caller_fqn string, match_score double")
    assert {x["kind"] for x in tools.impact_analysis(edges, symbols, http, None, "w", "m.cache.load_entry")["impact"].collect()} == {"upstream_symbol"}
    flows_ = tools.trace_http_flow(http, edges, "w", "get", "/users/:id/")
    assert (flows_["method"], flows_["path"], flows_["flows"].count()) == ("GET", "/users/{}", 0)
    for bad in (lambda: tools.call_graph(edges, symbols, "W!", "a.b"), lambda: tools.call_graph(edges, symbols, "w", "a b"), lambda: tools.call_graph(edges, symbols, "w", "a.b", depth=6), lambda: tools.call_graph(edges, symbols, "w", "a.b", direction="up"), lambda: tools.call_graph(edges, symbols, "w", "a.b", mode="other"), lambda: tools.trace_http_flow(http, edges, "w", " ", "/a"), lambda: tools.workspace_manage({}, symbols, "stats")):
        with pytest.raises(ValueError):
            bad()
    tables = {"symbol": (symbols, ["workspace_id", "repo", "fqn"])}
    assert tools.workspace_manage(tables, symbols, "stats", "w") == {"workspace": "w", "stats": {"repos": 2, "symbol": 3}}
    assert tools.workspace_manage(tables, symbols, "stats", "no") == {"workspace": None, "stats": {}}
    assert {x["workspace_id"] for x in tools.workspace_manage(tables, symbols, "list")["workspaces"].collect()} == {"v", "w"}
    assert tools.semantic_code_search(None, symbols, symbols, None, "w", " ")["hits"] is None


def test_a_table_that_cannot_be_read_is_not_overwritten(spark, tmp_path):
    from quillgraph.streaming.delta import upsert_stream

    schema = "workspace_id string, repo string, path string, v int"
    store = incremental.Store(spark, f"file://{tmp_path}/s")
    (tmp_path / "s/t/workspace_id=w/repo=r").mkdir(parents=True)
    (tmp_path / "s/t/workspace_id=w/repo=r/part-0.parquet").write_text("no parquet")
    spark.createDataFrame([("w", "r", "a", 1)], schema).write.parquet(f"file://{tmp_path}/in")
    with pytest.raises(Exception):  # noqa: B017
        upsert_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), store, "t", ["workspace_id", "repo", "path"], ["v"], f"file://{tmp_path}/cp").awaitTermination()
    assert (tmp_path / "s/t/workspace_id=w/repo=r/part-0.parquet").read_text() == "no parquet"


def test_vector_store(spark, tmp_path):
    store = incremental.Store(spark, f"file://{tmp_path}/s")
    schema = "workspace_id string, repo string, chunk_id string, embedding array<float>"
    store.upsert("chunk", spark.createDataFrame([("w", "r", "a", [1.0]), ("w", "r", "b", [2.0]), ("v", "r", "c", [3.0])], schema), ["chunk_id"])
    store.upsert("chunk", spark.createDataFrame([("w", "r", "b", [4.0]), ("w", "q", "d", [5.0])], schema), ["chunk_id"])
    assert {(x["chunk_id"], x["embedding"][0]) for x in store.read("chunk").collect()} == {("a", 1.0), ("b", 4.0), ("c", 3.0), ("d", 5.0)}
    store.drop_workspace("chunk", "w")
    assert {x["chunk_id"] for x in store.read("chunk").collect()} == {"c"}


def test_staging_needs_a_shared_folder_on_clusters():
    from quillgraph import session

    class Context:
        master = "spark://host:7077"

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert session.shared_folder(Session()) == "hdfs:///shared"


def test_http_flows_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    path = lambda: "/" + "/".join(rng.choice(["a", "b", "{}"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 4, 7])))
    clients = [(i, "w", rng.choice(["GET", "POST", "*"]), path()) for i in range(120)]
    routes = [(i, rng.choice(["w", "w", "v"]), rng.choice(["GET", "POST", "*"]), path()) for i in range(120)]
    want = set()
    for i, w, m, p in clients:
        scores = {}
        for j, v, n, q in routes:
            a, b = ([x for x in y.split("/") if x] for y in (p, q))
            if w == v and (m == n or "*" in (m, n)) and len(a) == len(b):
                score = 1.0 if p == q or not a else sum(x == y or "{}" in (x, y) for x, y in zip(a, b, strict=True)) / len(a)
                if score >= 0.7:
                    scores[j] = score
        want |= {(i, j) for j, s in scores.items() if s == max(scores.values())}
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, workspace_id string, method string, path string")
    assert {(x["call_id"], x["route_id"]) for x in flows.http_flows(make(clients, "call_id"), make(routes, "route_id")).collect()} == want


def test_searches_of_nothing(spark, tmp_path):
    symbols = spark.createDataFrame([], SYMBOL_SCHEMA)
    wanted = spark.createDataFrame([(1, "w", "some words")], "lookup_id int, workspace_id string, name string")
    for mode in ("exact", "suffix", "fuzzy", "auto"):
        assert search.lookup(symbols, wanted, mode).count() == 0
        assert search.lookup(spark.createDataFrame(SYMBOL_ROWS, SYMBOL_SCHEMA), wanted.limit(0), mode).count() == 0
    docs = spark.createDataFrame([(1, None), (2, " ? ")], "id bigint, text string")
    assert search.bm25(docs, "id", F.col("text"), "words", 5).count() == 0
    vectors = spark.createDataFrame([], "id bigint, e array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, vector array<float>")
    assert search.vector_topk(vectors, "id", "e", queries, 5).count() == 0
