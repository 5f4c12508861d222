import pytest
from pyspark.sql import functions as F

from quillgraph.llm import code_docs as cd


@pytest.mark.parametrize(("doc", "want"), [("Keeps at most 5 entries per pulley.", True), ("Not safe across threads.", True), ("Sweeps the ratchet.", False), ("", False), (None, False), ("TODO: describe what this does in detail later", False), ("See the parent class for the documentation of this.", False), ("@param ratchet a long description of what it is", False), (":param x: a long description\n:returns: something else entirely here", False), ("Args:\n    x: what it is and what it does\n\nReturns:\n    None", False), ("noqa: D401 because of reasons that matter here", False), ("x = compute(a, b, c, d)", False), ("{@inheritDoc}", False), ("====================", False), ("Auto-generated method stub for the interface below.", False), ("Rounds toward zero as audits expect.\n\n:param x: y", True), ("Nur Zeilen, die bestätigt wurden.", True), ("`code only in here`", False), ("sweep ratchet sweep ratchet store", False)])
def test_informative(doc, want):
    assert cd.informative(doc, "sweep_ratchet", "def sweep_ratchet(store: int)") is want


PY = '''# Header of the file that tells what it holds.

# Waits a while for the lock and gives up.
@traced
def a(x):
    pass

# cut off by a blank line, so it says nothing of b

def b(y):
    """Falls back to the other one when missing.

    :param y: z
    """
    s = "# not a comment above c"
class K:
    # :param other: names nothing of this one, long text here
    def c(self, q):
        pass
'''


def test_python_comments():
    found = cd.from_source(PY, True, [(5, "a", "def a(x)"), (10, "b", "def b(y)"), (17, "c", "def c(self, q)"), (99, "z", ""), (0, "y", "")])
    assert found[0] == "Waits a while for the lock and gives up."
    assert found[1].startswith("Falls back")
    assert set(found) == {0, 1}


JS = '''import a from "b";
/** Keeps the order of what it was given. @param x y */
export function f(x) { const s = "/** no */"; const r = /[/*]/; }
// One line above.
// And another one.
const g = (z) => z;
/* plain block comment */ h();
class A {
  /**
   * Doc of m.
   */
  m() {}
}
'''


def test_script_comments():
    found = cd.from_source(JS, False, [(3, "f", "function f(x)"), (6, "g", "g = (z) =>"), (12, "m", "m()")])
    assert found == {0: "Keeps the order of what it was given. @param x y", 1: "One line above.\nAnd another one.", 2: "Doc of m."}


def test_assignment_is_best():
    import itertools
    import random

    rng = random.Random(6)
    for _ in range(60):
        scores = {(d, c): rng.randrange(1, 9) for d in range(4) for c in range(4) if rng.random() < 0.6}
        got = cd.assign(scores)
        assert len(set(got.values())) == len(got)
        best = max(sum(scores.get((d, c), 0) for d, c in enumerate(p)) for p in itertools.permutations(range(4)))
        assert sum(scores[d, c] for d, c in got.items()) == best


def test_table(spark):
    schema = "symbol_id bigint, file_id bigint, name string, kind string, lang string, signature string, docstring string, file_path string, start_line int, end_line int"
    rows = [(1, 1, "a", "function", "python", "def a(x)", None, "p.py", 5, 6), (1, 1, "a", "function", "python", "def a(x)", None, "p.py", 5, 6), (2, 1, "b", None, None, "def b(y)", "  ", "p.py", 10, 15), (3, 1, "X", None, "python", "X = 1", "long text that would tell something here", "p.py", 1, 1), (4, 1, "K", "class", "python", "class K", "long text that would tell something here", "p.py", 16, 18), (5, None, None, "method", None, None, "Tells a lot about what it really does.", None, None, None), (6, 7, "q", "function", "python", "def q()", None, "q.py", 1, 1), (7, 1, "a", "function", "python", "def a(x)", "", "p.py", 5, 6), (None, 1, "a", "function", "python", "def a(x)", "Tells a lot about what it really does.", "p.py", 5, 6), (8, 1, "z", "function", "python", "def z()", "x " * 300_000 + "y z w v", "p.py", 5, 6)]
    symbols = spark.createDataFrame(rows, schema).withColumn("own", F.lit(1)).withColumn("description", F.lit("d"))
    texts = spark.createDataFrame([(1, PY), (7, None)], "file_id bigint, text string").withColumn("lang", F.lit("zz"))
    got = {x["symbol_id"]: x["origin"] for x in cd.documented(symbols, texts).collect()}
    assert got == {1: "comment", 2: "comment", 5: "docstring", 7: "comment", 8: "docstring"}
    pair = {x["symbol_id"]: x["code"] for x in cd.pairs(symbols, texts).collect()}
    assert pair[1] == "def a(x):\n    pass" and set(pair) == set(got)
    assert cd.documented(symbols.limit(0), texts).count() == 0


def test_comments_compete_for_definitions():
    code = "\n".join([
        "/** Adds the given amount to a running balance. @param amount what to add */",
        "// Reads each entry from the ledger and keeps its balance",
        "// eslint-disable-next-line no-unused-vars",
        "function add(amount) {}",
        "",
        "// ---- helpers of the journal, written long ago ----",
        "// Closes whatever the caller left open before",
        "function shut(name) {}",
    ])
    got = cd.from_source(code, False, [(4, "add", "function add(amount)"), (8, "shut", "function shut(name)")])
    # two comments stand above the first, and its parameter's tag decides; a directive is no documentation
    assert got[0].startswith("Adds the given amount") and "Closes whatever" in got[1]


def test_a_directive_alone_documents_nothing():
    assert cd.from_source("// eslint-disable-next-line\nfunction f() {}", False, [(2, "f", "function f()")]) == {}
    assert cd.from_source("/* Says what it does. */\n// eslint-disable-next-line\nfunction f() {}", False, [(3, "f", "function f()")]) == {0: "Says what it does."}
