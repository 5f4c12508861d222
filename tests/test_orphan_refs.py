import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillgraph.operators.orphan_refs import orphan_rates, orphans, references

T0 = datetime(2025, 1, 1)
CALL = "call_id bigint, workspace_id string, callee_repo string, callee_fqn string, seen_at timestamp_ntz, arrived_at timestamp_ntz"
IMPORT = "import_id bigint, workspace_id string, resolved_fqn string, seen_at timestamp_ntz, arrived_at timestamp_ntz"
FLOW = "flow_id bigint, workspace_id string, route_repo string, route_handler_fqn string, seen_at timestamp_ntz, arrived_at timestamp_ntz"
SYMBOL = "workspace_id string, repo string, fqn string, indexed_at timestamp_ntz, deleted_at timestamp_ntz"


def brute(calls, imports, flows, symbols):
    out = set()
    refs = [("resolved_call", c[0], c[1], c[2], c[3], c[4], False) for c in calls] + [("import_ref", c[0], c[1], None, c[2], c[3], True) for c in imports] + [("http_flow_edge", c[0], c[1], c[2], c[3], c[4], False) for c in flows]
    for name, i, ws, repo, fqn, seen, anywhere in refs:
        if not fqn or (fqn.startswith("<") and ">" in fqn):
            continue
        own = [s for s in symbols if s[0] is not None and s[0] == ws and s[2] == fqn and s[1] is not None and (anywhere or s[1] == repo)]
        born = [s for s in own if s[3] and seen and s[3] <= seen]
        if any(s[4] is None or s[4] > seen for s in born):
            continue
        out.add((name, i, "missing" if not own else "deleted" if born else "late"))
    return out


def build(spark, calls, imports, flows, symbols):
    return references(spark.createDataFrame(calls, CALL), spark.createDataFrame(imports, IMPORT), spark.createDataFrame(flows, FLOW)), spark.createDataFrame(symbols, SYMBOL)


def test_random_tables_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: T0 + timedelta(days=rng.randrange(200), hours=rng.choice([0, 0, 7]))
    names = [f"m.f{i}" for i in range(12)] + ["", None, "<dynamic>", "<inline>@a/b.js:3"]
    symbols = []
    for _ in range(60):
        born = day()
        symbols.append((rng.choice(["w", "v", None]), rng.choice(["r", "q", None]), rng.choice(names[:12]), rng.choice([born, born, born, None]), rng.choice([None, born + timedelta(days=rng.randrange(90))])))
    symbols += symbols[:5]
    calls = [(i, rng.choice(["w", "v", None]), rng.choice(["r", "q", None]), rng.choice(names), rng.choice([day(), None]) if i % 9 == 0 else day(), None) for i in range(300)]
    calls += [(*c[:5], T0) for c in calls[:20]]
    imports = [(i, rng.choice(["w", "v"]), rng.choice(names), day(), None) for i in range(100)]
    flows = [(i, "w", rng.choice(["r", "q"]), rng.choice(names), day(), None) for i in range(100)]
    refs, table = build(spark, calls, imports, flows, symbols)
    for ranges in (1, 7):
        got = orphans(refs, table, ranges).select("ref_table", "ref_id", "reason").collect()
        assert len(got) == len({tuple(x) for x in got})
        assert {tuple(x) for x in got} == brute(calls, imports, flows, symbols)
    rates = orphan_rates(refs, orphans(refs, table)).collect()
    assert sum(x["missing"] + x["deleted"] + x["late"] for x in rates if x["period"]) > 0


def test_bounds_of_life(spark):
    symbols = [("w", "r", "f", T0, T0 + timedelta(days=59))]
    calls = [(1, "w", "r", "f", T0, None), (2, "w", "r", "f", T0 + timedelta(days=59), None), (3, "w", "r", "f", T0 - timedelta(microseconds=1), None)]
    refs, table = build(spark, calls, [], [], symbols)
    assert {tuple(x)[1:3] for x in orphans(refs, table).collect()} == {(2, "deleted"), (3, "late")}


def test_empty_and_clashing(spark):
    refs, table = build(spark, [], [], [], [])
    assert orphans(refs, table).count() == 0
    refs, table = build(spark, [(1, "w", "r", "f" * 10_000, T0, None)], [], [], [])
    refs = refs.withColumn("born", F.lit(0))
    assert [tuple(x)[:3] for x in orphans(refs.drop("born"), table.withColumn("scope", F.lit(1)).withColumn("period", F.lit(1))).collect()] == [("resolved_call", 1, "missing")]


def test_inline_handlers_are_no_references(spark):
    names = ["<inline>@a/b.js:3", "<dynamic>", "<>", "<open", "a<b>", ""]
    refs, table = build(spark, [], [], [(i, "w", "r", n, T0, None) for i, n in enumerate(names)], [])
    assert {x["ref_id"] for x in orphans(refs, table).collect()} == {3, 4}
