import pytest
from pyspark.sql import functions as F

from quillgraph.operators.incremental import Store
from quillgraph.plans import pipeline
from quillgraph.sources import manifest, schema

SERVER = 'from fastapi import FastAPI\napp = FastAPI()\n@app.get("/users/{id}")\ndef get_user(id):\n    return load(id)\ndef load(id):\n    producer.send("orders", id)\n'
CLIENT = 'import requests\nfrom helper import tool\n\nclass Api:\n    def fetch(self, id):\n        tool()\n        return requests.get(f"https://h.io/users/{id}")\n'


@pytest.fixture
def project(tmp_path):
    for name, text in {"a/server.py": SERVER, "b/api.py": CLIENT, "b/helper.py": "def tool():\n    pass\n", "b/worker.ts": 'consumer.subscribe({ topic: "orders" });\n'}.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path, manifest.parse({"version": 1, "workspaces": [{"id": "w", "repos": [{"name": n, "path": str(tmp_path / "src" / n)} for n in ("a", "b")]}]})


def tables(store):
    out = {}
    for name in [*pipeline.FACT_TABLES, "calls", "http_flow", "topic_flow"]:
        out[name] = sorted(str(r) for r in store.read(name).select(*[c for c in schema.struct(name).names if c != "embedding"]).collect())
    return out


def test_full_then_incremental_equals_full(spark, project):
    folder, m = project
    store = Store(spark, f"file://{folder}/store")
    report = pipeline.index_full(spark, store, pipeline.scan(spark, m, "w"), "w", "hash")
    assert report.tables["file"] == 4 and report.tables["http_flow"] == 1 and report.tables["topic_flow"] == 1
    assert report.repositories["a"]["route"] == 1 and report.repositories["b"]["http_client_call"] == 1 and report.repositories["a"]["topic"] == report.repositories["b"]["topic"] == 1
    calls = {(r["caller_fqn"], r["callee_fqn"], r["strategy"]) for r in store.read("calls").collect()}
    assert ("server.get_user", "server.load", "same-module") in calls and ("api.Api.fetch", "helper.tool", "import-suffix") in calls
    assert all(len(r["embedding"]) == 384 for r in store.read("chunk").collect())
    for name in ("file", "symbol", "chunk", "route", "calls"):
        schema.assert_unique(store.read(name), name)
    assert {r["fqn"] for r in schema.encloses(store.read("symbol")).collect()} == {"api.Api.fetch"}
    assert schema.conditional_edges(store.read("route"), store.read("symbol"), "handler_fqn").count() == 1

    # a file changes, one goes, one comes: flows of the files left alone stay
    (folder / "src/b/api.py").write_text(CLIENT.replace("Api", "Caller"))
    (folder / "src/b/helper.py").unlink()
    (folder / "src/b/more.py").write_text("def more():\n    pass\n")
    report = pipeline.index_incremental(spark, store, pipeline.scan(spark, m, "w"), "w", "hash")
    assert (report.changed, report.unchanged, report.deleted) == (2, 2, 1)
    other = Store(spark, f"file://{folder}/other")
    pipeline.index_full(spark, other, pipeline.scan(spark, m, "w"), "w", "hash")
    assert tables(store) == tables(other)
    assert not [x for x in tables(store)["symbol"] if "Api" in x or "tool" in x]
    report = pipeline.index_incremental(spark, store, pipeline.scan(spark, m, "w"), "w", "hash")
    assert (report.changed, report.unchanged, report.deleted) == (0, 4, 0)


def test_unique(spark):
    df = spark.createDataFrame([("w", "r", "f"), ("w", "r", "f")], "workspace_id string, repo string, file_path string")
    with pytest.raises(ValueError):
        schema.assert_unique(df, "file")
    assert schema.conform(df.withColumn("other", F.lit(1)), "file").columns == schema.struct("file").names
