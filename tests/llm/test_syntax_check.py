import ast
import warnings

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import syntax_check as sc

PY_GOOD = ["", "\n# c\n", "x = 1", "def f(a, /, b: int = 1, *c, d, **e) -> int:\n\treturn a\n", "class A(B, m=1): pass", "match x:\n  case [1, *r] if r: pass\n  case {'a': K(b=1) | None, **z}: pass\n  case a.b as c: pass", "match = type = case = 1; match(x); type(y)", "type X[T] = list[T]", "async def f():\n  async with a as b, c: await d\n  return [x async for x in y if z]", "x = y if z else lambda *a, k=1: (yield)", "a[1:2, ::3, *b] = c, *d = e", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nelse: pass\nfinally: pass", "with (open(a) as b, c as d,):\n  pass", "from . import (a as b, c,)", "from .. import *", "@d.e(1)\n@f\nclass X: ...", "print(f'{x!r:>{w}}' 'b', rb'c')", "if x:\n    pass\n# odd comment\n  # another\nelif y: pass\nelse:\n    z = 0x1F + 1_0.5e-3j", "x = (1 +\n  2)\ny = \\\n 3", "global_ = not a in b is not c", "x: list[int] = {**a, 'b': 1}; del x, y", "while (n := n - 1): continue", "lambda: (yield)", "'''a\nb''' ; r'\\\\'", "x = {i: j for i, j in k for l in m}", "f(*a, b, k=1, **c)", "f(x for x in y)", "raise", "for x, *y in z: break", "return_ = a @ b // c ** -d", "f'{a}{b!r:>{w}.{p}}{{}}{c=}{d[\"k\"]}{x if y else z:%Y}{(lambda q: q)(1)}' + f\"{a != b}\"", "\ufeffx = 1", "x = 1\r\ny = 2\rz = 3"]
PY_BAD = ["x = (1, 'a'", "def f(:\n  pass", "<<<<<<< HEAD\nx = 1", "if x:\npass", "  x = 1", "x = 'a", '"""abc', "print 'a'", "def f()\n  pass", "x = 3ab", "x = 012", "a b", "import { a } from 'b'", "<!doctype html>", "#!/bin/sh\nset -e\nfor f in *; do\n", "x = “a”", "def f():\n    a\n  b", "return }", "x = $y", "class A:\n", "f(", "x ==", "else: pass", "try:\n  pass\nx = 1", "a = = b", "x = [1, 2", "for x in: pass", "f'{}'", "f'a}'", "f'{a'", "f'{a b}'", "f'{a:{}}'"]
JS_GOOD = ["", "// c", "import a, { b as c } from 'd';\nexport default class { #x = 1; static { } get y() { return this.#x } async *z() {} }", "export const f = async ({ a, b: [c = 1] }, ...r) => ({ ...a, b, [c]: 1, d() {}, get e() { return 1 } });", "let x = a ? b : c\nlet y = `t${`u${1}`}`\n;[1, , 2].map((x) => x)", "const r = /[/(]a\\/+/gi.test(s) / 2", "if (a) /re/.exec(b); else c = d / e / f", "for (const [k, v] of m) { continue }\nfor (;;) break\nfor (let i = 0, n = 2; i < n; i++) ;\nfor (k in o) {}", "label: while (x) { break label }", "try { throw new E } catch { } finally { }", "switch (a) { case 1: default: b() }", "a?.b?.[c]?.(d) ?? e", "x = y => { }\nz = async y => y", "export { a as b, default as c } from 'd'; export * as e from 'f'", "function* g() { yield* h(); yield }", "new A.B(1).c, new D", "do x++; while (x < 3) y()", "var of = 1, get = 2, async = 3, from = 4, type = 5; async(of)", "!function(){if(a)b.c(\"d\",1);var e=function(f){for(var i=0;i<f.length;i++)f[i]^=9;return f}}()", "a = b\n++c", "return_ = function () {}", "({ a, b } = c);[a, b] = [b, a]", "import('x').then(); import.meta.url", "a = 0x1Fn + 1_000 + .5e3 + 0b11", "export default function () {}", "await x; class A extends (B, C) { 'm'() {} 1() {} [k] = 1 }", "#!/usr/bin/env node\nx", "a >>>= b >> c >>> d > e >= f"]
JS_BAD = ["{\"a\": 1, \"b\": 2}", "function f( {", "const x = ;", "<<<<<<< a", "a\n=======\nb", "a\n>>>>>>> b\nc", "let x = 'a", "/* a", "`a", "x = “b”", "export interface P { a: b }", "function f(a: number) {}", "def f(a):\n  pass", "<!doctype html>", "a ]", "f(a, b", "if (a { }", "class { }", "class A { m( }", "let let = 1", "return }", "x = {a: 1", "for (a of b", "@@ -1,2 +1,2 @@", "const q9 = [1, \"a\";", "import a from", "a b", "const x;"]
TS_GOOD = [*JS_GOOD, "export interface P<T = A> extends Q<T>, R { readonly a?: string; b(c: number): void; [k: string]: any; new (x: T): P; (y): z }", "type A = B | null & { c: D[] } | [e: F, g?: H, ...i: J[]] | ((k: L) => void) | `m${N}`", "type A<T> = T extends (infer U)[] ? { readonly [K in keyof T]?: T[K] } : typeof x.y", "function f<T extends A>(this: B, a?: C, ...d: E[]): a is F { return <G>a as unknown as H }", "abstract class A<T> extends B<T> implements C, D { private readonly e: F = 1; constructor(public g: H, private i?: J) { super() } abstract k(): void; static l?: M; declare n: O; get p(): Q { return this.#r! } }", "enum A { B = 1, C, 'd' = 2 } const enum E {} declare module 'm' { export const x: y } namespace N.M { export type O = P }", "import type { A } from 'a'; import { type B, c } from 'b'; export type { D } from 'e'; import f = require('f')", "const f = <T,>(a: T): T => a; const g = async (h: I): Promise<J<K<L>>> => { }", "function o(a: b): c;\nfunction o(a) { }", "let a: A<B<C>> = d!, e: unique symbol; f<G>(h); new I<J>(); x satisfies Y", "try { } catch (e: unknown) { } for (const x of y as Z[]) { }", "@Dec({ a: 1 }) export class A { @Input() b: string; @Out() c = 1 }", "export default interface A { } declare function f(x: string): asserts x is y", "declare const a: B; declare global { interface Window { c: d } } export = e;", "const a = (b as C).d; if (a < b && c > d) {}"]
TS_BAD = [x for x in JS_BAD if x not in ("export interface P { a: b }", "function f(a: number) {}", "let let = 1")] + ["const x;", "interface A { b: }", "type A = ", "function f(a: ): void {}", "enum A { 1 + }", "class A { private }{"]


@pytest.mark.parametrize("text", PY_GOOD)
def test_python_valid(text):
    ast.parse(text.lstrip("\ufeff"))
    assert sc.first_error(text, "python") is None


@pytest.mark.parametrize("text", PY_BAD)
def test_python_invalid(text):
    with pytest.raises(SyntaxError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text)
    assert sc.first_error(text, "python") is not None


@pytest.mark.parametrize("text", JS_GOOD)
def test_javascript_valid(text):
    assert sc.first_error(text, "javascript") is None


@pytest.mark.parametrize("text", JS_BAD)
def test_javascript_invalid(text):
    assert sc.first_error(text, "javascript") is not None


@pytest.mark.parametrize("text", TS_GOOD)
def test_typescript_valid(text):
    assert sc.first_error(text, "typescript") is None


@pytest.mark.parametrize("text", TS_BAD)
def test_typescript_invalid(text):
    assert sc.first_error(text, "typescript") is not None


def test_first_error_line():
    assert sc.first_error("a = 1\nb = (\nc = 2", "python")[0] in (2, 3)
    assert sc.first_error("a;\nb;\n)", "javascript")[0] == 3


def test_long_text():
    assert sc.first_error("x = 1\n" * 50_000, "python") is None
    assert sc.first_error("x = [" + "1," * 100_000 + "]", "javascript") is None
    assert sc.first_error("a" * 500_000, "typescript") is None


def test_table(spark):
    records = spark.createDataFrame([(1, "w", "r", "a.py", "python"), (1, "w", "r", "a.py", "python"), (2, "w", "r", "b.ts", None), (3, "w", "r", "c.rb", None), (4, None, None, None, "javascript"), (None, "w", "r", "d.py", "python"), (5, "w", "r", "e.PY", None), (6, "w", "r", "f.py", None)], "file_id bigint, workspace_id string, repo string, repo_relative_path string, lang string").withColumn("line", F.lit(1)).withColumn("text", F.lit("("))
    texts = spark.createDataFrame([(1, "x ="), (2, "interface A { b: string }"), (3, "("), (4, "interface A {}"), (5, None), (6, "")], "file_id bigint, text string").withColumn("repo", F.lit("zz"))
    got = sc.judged(records, texts)
    assert {x["file_id"] for x in got.collect() if x["line"] is not None} == {1, 4}
    assert {(x["repo"], x["language"]): (x["files"], x["invalid"]) for x in sc.rates(got).collect()} == {("r", "python"): (3, 1), ("r", "typescript"): (1, 0), (None, "javascript"): (1, 1)}
    assert sc.judged(records.limit(0), texts).count() == 0


JSX = [
    "export default function A() { return <p>hi</p>; }",
    "const a = <A b={1} c='x' d {...e} f={<g/>}>text {x.map((y) => <li key={y}>{y}</li>)} {/* no */} <></></A>;\nf(a)",
    "const f = () => (\n  <>\n    <B.C d:e='1' />\n    {ok && <i>yes</i>}\n  </>\n);",
    "const x = a < b ? <p/> : <q></q>;",
]


@pytest.mark.parametrize("text", JSX)
def test_jsx(text):
    assert sc.first_error(text, "javascript", True) is None and sc.first_error(text, "typescript", True) is None
    assert sc.first_error(text, "javascript") is not None


@pytest.mark.parametrize("text", ["const a = <p>;", "const a = <p></q>;", "const a = <p b=1/>;", "const a = <p>{x</p>;", "const a = <p>}</p>;", "const a = <p/> <q/>;", "return <p", "const a = <p>{x y}</p>;"])
def test_invalid_jsx(text):
    assert sc.first_error(text, "javascript", True) is not None


def test_copies_and_suffixes(spark):
    rows = [(1, "w", "r", "a.jsx", None), (2, "w", "r", "a.js", None), (3, "w", "r", "b.jsx", "javascript"), (4, "w", "q", "c.py", None), (5, "w", "q", "d.py", None), (6, "w", "q", "e.txt", None)]
    texts = [(1, JSX[0]), (2, JSX[0]), (3, JSX[0]), (4, "def f(:"), (5, "def f(:"), (6, "def f(:")]
    got = sc.judged(spark.createDataFrame(rows, "file_id bigint, workspace_id string, repo string, repo_relative_path string, lang string"), spark.createDataFrame(texts, "file_id bigint, text string")).collect()
    assert {x["file_id"]: x["line"] for x in got} == {1: None, 2: 1, 3: None, 4: 1, 5: 1}
