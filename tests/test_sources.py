import pytest

from quillgraph.operators import adhoc
from quillgraph.operators.extract import extract, facts_of, file_facts
from quillgraph.sources import manifest
from quillgraph.sources.tree import SourceTree

GOOD = {"version": 1, "workspaces": [{"id": "w", "repos": [{"name": "r", "path": "/x"}]}]}


def test_manifest(spark):
    m = manifest.parse(GOOD)
    assert m.workspace("w").repositories[0].name == "r" and m.digest() == manifest.parse(GOOD).digest()
    assert m.table(spark).count() == 1
    with pytest.raises(KeyError):
        m.workspace("x")


@pytest.mark.parametrize("change", [{"version": 2}, {"extra": 1}, {"workspaces": []}, {"workspaces": [{"id": "W!", "repos": [{"name": "r", "path": "x"}]}]}, {"workspaces": GOOD["workspaces"] * 2}, {"workspaces": [{"id": "w", "repos": [{"name": "r", "path": "x", "url": "y"}]}]}, {"workspaces": [{"id": "w", "repos": [{"name": "r"}]}]}, {"workspaces": [{"id": "w", "repos": [{"name": "r", "path": "x"}] * 2}]}])
def test_manifest_refuses(change):
    with pytest.raises(manifest.ManifestError):
        manifest.parse(GOOD | change)


def test_tree(spark, tmp_path):
    for name, content in {"pkg/__init__.py": "", "pkg/calc.py": "def add(a, b):\n    return a + b\n", "big.py": "x = 1\n" * 1000, ".venv/a.py": "1", "node_modules/m.js": "1", "a.txt": "1", ".hidden.py": "y = 2"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    (tmp_path / "link.py").symlink_to(tmp_path / "big.py")
    spark.dataSource.register(SourceTree)
    read = lambda **o: {x["file_path"]: x["line_count"] for x in spark.read.format("source_tree").options(path=str(tmp_path), **o).load().collect()}
    assert read(max_bytes="4096") == {"pkg/__init__.py": 1, "pkg/calc.py": 3, ".hidden.py": 1}
    assert "big.py" in read(max_bytes="0") and read(languages="javascript") == {}


def kinds(path, source, lang):
    return [f for f in file_facts(path, source, lang)]


def test_python_facts():
    facts = kinds("lib/p/mod.py", 'import a.b, json as j\nfrom .m import n as k, o\nfrom q import *\n@wrap(f())\nclass K:\n    """D."""\n    def _x(self, y=g()):\n        h(i())\n    def __z(self): pass\n    def __init__(self): pass\ndef bad(:\n\ndef good():\n    return 1\n', "python")
    symbols = {f["fqn"]: (f["symbol_kind"], f["visibility"]) for f in facts if f["fact"] == "symbol"}
    assert symbols == {"p.mod.K": ("class", "public"), "p.mod.K._x": ("method", "protected"), "p.mod.K.__z": ("method", "private"), "p.mod.K.__init__": ("method", "public"), "p.mod.good": ("function", "public")}
    assert {(f["local_name"], f["target_fqn"]) for f in facts if f["fact"] == "import"} == {("a", "a.b"), ("j", "json"), ("k", ".m.n"), ("o", ".m.o"), ("*", "q")}
    # neither decorators nor default arguments
    assert [f["call_text"] for f in facts if f["fact"] == "call"] == ["h", "i"]


def test_python_routes_clients_topics():
    source = '@app.get("/u/{id}")\n@bp.route("/x", methods=["GET", "POST"])\ndef f(t):\n    requests.get(f"https://h.io/u/{t}")\n    db.get("/no")\n    producer.send(t)\n    consumer.subscribe(["a", "b"])\n    KafkaConsumer("c")\n@app.agent("d")\ndef g(s): pass\n'
    facts = kinds("m.py", source, "python")
    assert {(f["method"], f["path"], f["framework"]) for f in facts if f["fact"] == "route"} == {("GET", "/u/{}", "fastapi-or-flask"), ("GET", "/x", "flask"), ("POST", "/x", "flask")}
    assert [(f["method"], f["path"], f["base_url"]) for f in facts if f["fact"] == "client"] == [("GET", "/u/{}", "https://h.io")]
    assert [f["topic_name"] for f in facts if f["fact"] == "producer"] == ["<dynamic>"]
    assert {(f["topic_name"], f["client_lib"]) for f in facts if f["fact"] == "consumer"} == {("a", "kafka-python"), ("b", "kafka-python"), ("c", "kafka-python"), ("d", "faust")}


def test_script_facts():
    source = 'import axios from "axios";\nimport * as fs from "fs";\nimport { a as b } from "./m";\n/** Doc. */\nexport const add = (x: number) => sum(x);\nclass _C { run = () => { this.go(); } }\ninterface I {}\ntype T = I;\nfetch("/users", { method: "POST" });\naxios.get(`/users/${id}`);\nunfinished(('
    facts = kinds("src/x.ts", source, "typescript")
    assert {(f["local_name"], f["target_fqn"]) for f in facts if f["fact"] == "import"} == {("axios", "axios.default"), ("fs", "fs.*"), ("b", "./m.a")}
    assert {(f["fqn"], f["symbol_kind"], f["visibility"], f["docstring"]) for f in facts if f["fact"] == "symbol"} == {("x.add", "function", "public", "Doc."), ("x._C", "class", "protected", ""), ("x._C.run", "method", "public", ""), ("x.I", "interface", "public", ""), ("x.T", "type_alias", "public", "")}
    assert {(f["method"], f["path"]) for f in facts if f["fact"] == "client"} == {("POST", "/users"), ("GET", "/users/{}")}


def test_extract_table(spark):
    files = spark.createDataFrame([(1, "w", "r", "a.py", "python", "def f(): g()"), (2, "w", "r", "b.py", "python", None), (3, "w", "r", "c.rb", "ruby", "x"), (4, "w", "r", "d.js", "javascript", "")], "file_id bigint, workspace_id string, repo string, file_path string, lang string, text string")
    facts = extract(files)
    assert facts_of(facts, "symbol").first()["fqn"] == "a.f"
    assert {x["file_id"] for x in facts_of(facts, "module").collect()} == {1, 4}


DATA = "/root/testdata/sf0.001/region.parquet"
BYPASSES = [f"SELECT count(*) FROM `org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat`.`{DATA}`", f"SELECT count(*) FROM `org.apache.spark.sql.execution.datasources.v2.parquet.ParquetDataSourceV2`.`{DATA}`", "SELECT * FROM image.`/root`", f"SELECT (SELECT count(*) FROM orc.`{DATA}`) AS n", f"WITH a AS (SELECT * FROM avro.`{DATA}`) SELECT * FROM a", "SELECT * FROM missing", "SELECT * FROM default.t", "SELECT input_file_name()", "SELECT reflect('a', 'b')", "SELECT * FROM read_files('/x')", "SELECT try_reflect('a', 'b')", "SELECT current_user()", "SELECT transform(array(1), x -> java_method('a', 'b'))", "SELECT * FROM range(3) WHERE EXISTS (SELECT raise_error('x'))", "SELECT spark_catalog.default.f(1)"]


@pytest.mark.parametrize("query", ["", "x" * 10_001, "DELETE FROM t", "INSERT INTO t SELECT 1", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT * FROM t WHERE id IN (SELECT * FROM csv.`/x`)", "SELECT java_method('a', 'b')", "SET a = 1", "CACHE TABLE t", "EXPLAIN SELECT 1", "CREATE VIEW v AS SELECT 1", "SELEC", *BYPASSES])
def test_gate_refuses(spark, query):
    with pytest.raises(adhoc.Refused):
        adhoc.check(spark, query)


ALLOWED = ["SELECT id FROM t UNION ALL SELECT 1", "WITH a AS (SELECT id FROM t), b AS (SELECT * FROM a) SELECT count(*), max(id) FROM b JOIN t USING (id)", "SELECT id, row_number() OVER (ORDER BY id) FROM t ORDER BY 1 LIMIT 2", "SELECT * FROM t WHERE id IN (SELECT id FROM t WHERE id % 2 = 0) AND EXISTS (SELECT 1 FROM t)", "SELECT explode(array(1, 2)) AS x", "SELECT * FROM range(3)", "SELECT CASE WHEN id > 1 THEN upper('a') ELSE CAST(id AS STRING) END AS c FROM T LATERAL VIEW explode(array(1)) v AS y", "SELECT 'java_method(x)' AS s, 1 + 2 AS n -- reflect('a')", "VALUES (1, 2)", "SELECT filter(array(1, 2), x -> x > 1) AS f", "SELECT (SELECT max(id) FROM t) AS m"]


@pytest.mark.parametrize("query", ALLOWED)
def test_gate_lets_reads_through(spark, query):
    spark.range(10).createOrReplaceTempView("t")
    adhoc.check(spark, query)
    spark.sql(query).collect()


def test_gate_runs(spark):
    spark.range(10).createOrReplaceTempView("t")
    assert adhoc.execute(spark, "SELECT id FROM t WHERE id >= :low ORDER BY id", {"low": 8}) == {"columns": ["id"], "rows": [{"id": 8}, {"id": 9}], "truncated": False}
    assert adhoc.execute(spark, "WITH a AS (SELECT id, 'DROP TABLE; t' AS s FROM t) SELECT s, count(*) AS n FROM a GROUP BY s", limit=1)["truncated"] is False
    assert adhoc.execute(spark, "SELECT * FROM t", limit=3)["truncated"] is True
    for bad in (0, -1, 1001):
        with pytest.raises(adhoc.Refused):
            adhoc.execute(spark, "SELECT 1", limit=bad)
    for check, value in ((adhoc.safe_identifier, "a b"), (adhoc.safe_workspace, "W"), (adhoc.safe_search_text, "a\n")):
        with pytest.raises(adhoc.Refused):
            check(value)
    row = adhoc.execute(spark, "SELECT decode(unhex('41'), 'UTF-8') AS t, unhex('01FF') AS b, array(1, NULL) AS a, named_struct('x', DATE'2025-01-02') AS s, CAST(NULL AS INT) AS n, 1.50BD AS d")["rows"][0]
    assert row == {"t": "A", "b": "01FF", "a": [1, None], "s": {"x": "2025-01-02"}, "n": None, "d": 1.5}


def test_checkout(tmp_path):
    import subprocess

    from quillgraph.sources import checkout

    repo = tmp_path / "origin"
    repo.mkdir()
    (repo / "a.py").write_text("x = 1\n")
    plain = checkout.local("w", manifest.Repository("r", path=str(repo)))
    assert len(plain.commit) == 40 and plain == checkout.local("w", manifest.Repository("r", path=str(repo)))
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repo, check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", "a.py")
    run("commit", "-q", "-m", "one")
    at = checkout.local("w", manifest.Repository("r", path=str(repo)))
    far = checkout.checkout(str(tmp_path / "root"), "w", manifest.Repository("r", url=f"file://{repo}", branch="main"))
    assert far.commit == at.commit and far.path.endswith(f"w/r@{at.commit}")
    assert checkout.checkout(str(tmp_path / "root"), "w", manifest.Repository("r", url=f"file://{repo}")) == far
    for bad in (manifest.Repository("r", path=str(tmp_path / "no")), manifest.Repository("r", url=f"file://{tmp_path}/no")):
        with pytest.raises(checkout.CheckoutError):
            checkout.checkout(str(tmp_path / "root"), "w", bad)


def test_config(tmp_path):
    from quillgraph.sources import config

    f = tmp_path / "env"
    f.write_text('# c\nexport QUILLGRAPH_CHUNK_LINES="50"\nQUILLGRAPH_TOOL_TIMEOUT=2.5\n')
    s = config.load({"QUILLGRAPH_CHUNK_LINES": "7"}, (str(f),))
    assert (s.chunk_lines, s.tool_timeout, s.embedding) == (7, 2.5, "hash")
    with pytest.raises(ValueError):
        config.load({"QUILLGRAPH_CHUNK_LINES": "many"}, ())


def test_providers():
    from quillgraph.operators import providers

    asked = []

    def call(texts):
        asked.append(len(texts))
        if len(texts) > 2 or "huge" in texts:
            raise RuntimeError("request too large")
        return [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    ask = providers.guarded(call, dim=2, batch=4)
    assert ask(["a", "b", "", "c", "huge"]) == [[0.6, 0.8], [0.6, 0.8], [0.0, 0.0], [0.6, 0.8], [0.0, 0.0]]
    assert asked == [4, 2, 2, 1]
    with pytest.raises(ValueError):
        providers.guarded(lambda t: [[1.0]], dim=2)(["a"])
    for said in ("HTTP 413", "input size exceeds the limit", "The input sequence should have less than 131072 characters.", "total text input length is 9", "maximum context length is 8192 tokens", "Request Entity Too Large", "payload too large"):
        assert providers.TOO_LARGE.search(said), said
    for said in ("connection reset", "port 4130 refused", "order 413 not found", "invalid payload", "unauthorized"):
        assert not providers.TOO_LARGE.search(said), said
    with pytest.raises(KeyError):
        providers.get("no", None)
    assert providers.get("no") is providers.get("hash")


def test_metrics(spark):
    from pyspark.sql import functions as F

    from quillgraph.operators import metrics

    df, seen = metrics.observed(spark.range(5), rows=F.count(F.lit(1)), top=F.max("id"))
    df.collect()
    assert seen.get == {"rows": 5, "top": 4}
    timers = metrics.Timers()
    with timers.stage("a"):
        pass
    assert timers.rows[0][0] == "a"
    values = spark.createDataFrame([(0.04,), (0.3,), (99.0,)], "s double")
    assert [x["n"] for x in metrics.histogram(values, "s", [0.05, 1]).collect()] == [1, 2, 3]


def test_definitions_around_an_error():
    source = "class A:\n    \"\"\"Doc.\"\"\"\n\n    @wrap\n    def f(self):\n        g()\n        x = (1,\n\n    def h(self):\n        return k()\n\ndef i(:\n    pass\n\ndef j():\n   return 1\n  x = 2\n"
    facts = kinds("m.py", source, "python")
    symbols = {f["fqn"]: (f["symbol_kind"], f["start_line"], f["docstring"]) for f in facts if f["fact"] == "symbol"}
    assert symbols["m.A"] == ("class", 1, "Doc.") and symbols["m.A.f"][:2] == ("method", 5) and symbols["m.A.h"][:2] == ("method", 9) and symbols["m.j"][0] == "function" and "m.i" not in symbols
    assert {(f["caller_fqn"], f["call_text"]) for f in facts if f["fact"] == "call"} == {("m.A.f", "g"), ("m.A.h", "k")}
