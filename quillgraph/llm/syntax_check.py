"""Source files that do not parse.

Lexers cut a file into tokens, and table-driven recognisers built from the bundled grammars (see
grammars and glr) read the whole token stream; the first token that no parse can take is the file's
first unrecoverable error. Semicolons are inserted as the language says, only where a token can't be
taken otherwise; Python's indentation becomes tokens.

The language is `lang`, or else what the path's suffix tells. Scripts whose suffix is .jsx or .tsx may hold JSX
elements. Files of one text, language and suffix are read once.

Defined results: null or empty texts, and those of blanks and comments only, are valid; files of other
or unknown languages are not judged; records without file_id are left out, re-delivered ones count
once; null repositories count under null; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import language_of
from quillgraph.llm import grammars
from quillgraph.llm.glr import Grammar
from quillgraph.sources.tables import table


class Invalid(Exception):
    """At a line, for a reason."""

    def __init__(self, line: int, reason: str):
        super().__init__(reason)
        self.line, self.reason = line, reason


# ---- Python -------------------------------------------------------------------------------------

# The keywords of Python 3.
_PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
_PY_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?)"
_PY_TOKEN = re.compile(
    r"[ \t\f]*(?:(?P<string>(?:[rRuUbBfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:\"\"\"|'''|\"|'))"
    rf"|(?P<name>[^\W\d]\w*)|(?P<nl>\n)|(?P<number>{_PY_NUMBER})"
    r"|(?P<aug>(?:\*\*|//|>>|<<|[-+*/%@&|^])=)|(?P<cmp>==|!=|<=|>=|<(?!<)|>(?!>))|(?P<fixed>:=|->|\*\*|\.\.\.|[()\[\]{},:;.=~@])"
    r"|(?P<pm>[-+])|(?P<bar>\|)|(?P<star>\*)|(?P<slash>/(?!/))|(?P<op>//|<<|>>|[%&^])|(?P<comment>\#[^\n]*)|(?P<cont>\\\n))"
)
_PY_ENDS = {'"""': re.compile(r'(?:\\.|[^\\"]|"(?!""))*"""', re.S), "'''": re.compile(r"(?:\\.|[^\\']|'(?!''))*'''", re.S), '"': re.compile(r'(?:\\(?:.|\n)|[^\\"\n])*"'), "'": re.compile(r"(?:\\(?:.|\n)|[^\\'\n])*'")}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _check_fields(body: str, line: int) -> None:
    """The replacement fields of an f-string: balanced, and each an expression; formats are checked likewise."""
    at = 0
    while at < len(body):
        c = body[at]
        if body.startswith(("{{", "}}"), at):
            at += 2
            continue
        if c == "}":
            raise Invalid(line, "single } in an f-string")
        if c != "{":
            at += 1
            continue
        start, depth, spec = at + 1, 0, -1
        at += 1
        while at < len(body):
            c = body[at]
            if c in "'\"" and spec < 0:
                quote = c * 3 if body.startswith(c * 3, at) else c
                closing = _PY_ENDS[quote].match(body, at + len(quote))
                if closing is None:
                    raise Invalid(line, "unterminated string in an f-string")
                at = closing.end()
                continue
            if c in "([{":
                depth += 1
            elif c == "}" and depth == 0:
                break
            elif c in ")]}":
                depth -= 1
            elif depth == 0 and spec < 0 and (c == ":" or c == "!" and not body.startswith("!=", at)):
                spec = at
            at += 1
        else:
            raise Invalid(line, "a field of an f-string isn't closed")
        expression = body[start : spec if spec >= 0 else at].rstrip()
        expression = expression[:-1] if expression.endswith("=") and not expression.endswith(("==", "!=", "<=", ">=")) else expression
        if not expression.strip():
            raise Invalid(line, "an empty field in an f-string")
        try:
            _recognise(grammar("python"), python_tokens(f"({expression}\n)"), False)
        except Invalid as e:
            raise Invalid(line, f"in an f-string: {e.reason}") from None
        if spec >= 0 and ":" in body[spec:at]:
            _check_fields(body[body.index(":", spec) + 1 : at], line)
        at += 1


def python_tokens(text: str) -> Iterator[tuple[str, int]]:
    """(token, line); raises Invalid."""
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        raise Invalid(text.count("\n", 0, text.index("\0")) + 1, "null character")
    if not text.endswith("\n"):
        text += "\n"
    at, line, size = 0, 1, len(text)
    brackets: list[tuple[str, int]] = []
    indents, alternative, fresh, match = [0], [0], True, _PY_TOKEN.match
    while at < size:
        if fresh and not brackets:
            fresh = False
            column = other = 0
            while at < size and text[at] in " \t\f":
                if text[at] == "\t":
                    column, other = (column // 8 + 1) * 8, other + 1
                elif text[at] == "\f":
                    column = other = 0
                else:
                    column, other = column + 1, other + 1
                at += 1
            if at < size and text[at] not in "#\n" and not text.startswith("\\\n", at):
                if (column > indents[-1]) != (other > alternative[-1]) and column != indents[-1]:
                    raise Invalid(line, "inconsistent tabs and blanks")
                if column > indents[-1]:
                    indents.append(column)
                    alternative.append(other)
                    yield "INDENT", line
                while column < indents[-1]:
                    indents.pop()
                    alternative.pop()
                    yield "DEDENT", line
                if column != indents[-1]:
                    raise Invalid(line, "unindent matches no outer level")
            elif at < size and text[at] == "#":
                at = text.index("\n", at)
            if at < size and text[at] == "\n":
                at += 1
                line += 1
                fresh = True
                continue
        m = match(text, at)
        if m is None:
            raise Invalid(line, f"invalid character {text[at:].lstrip(" \t\f")[0]!r}")
        kind, at = m.lastgroup, m.end()
        raw = m[kind]
        if kind == "name":
            if raw in _PY_KEYWORDS:
                yield raw, line
            elif raw.isascii() or raw.isidentifier():
                yield "NAME", line
            else:
                raise Invalid(line, f"invalid name {raw!r}")
        elif kind == "nl":
            line += 1
            if not brackets:
                yield "NEWLINE", line - 1
                fresh = True
        elif kind == "fixed":
            if raw in _OPEN:
                brackets.append((_OPEN[raw], line))
            elif raw in _CLOSE:
                if not brackets or brackets.pop()[0] != raw:
                    raise Invalid(line, f"{raw} closes nothing")
            yield raw, line
        elif kind == "string":
            quote = raw.lstrip("rRuUbBfFtT")
            end = _PY_ENDS[quote].match(text, at)
            if end is None:
                raise Invalid(line, "unterminated string")
            if "f" in raw[: len(raw) - len(quote)].lower():
                _check_fields(text[at : end.end() - len(quote)], line)
            yield "STRING", line
            line += text.count("\n", at, end.end())
            at = end.end()
        elif kind == "number":
            follow = re.compile(r"[^\W\d]\w*").match(text, at)
            if follow and follow.group() not in ("and", "or", "if", "else", "in", "is", "for", "not"):
                raise Invalid(line, "invalid number")
            if re.match(r"0_?\d*[1-9]", raw) and not re.search(r"[.eEjJ]", raw):
                raise Invalid(line, "leading zeros")
            yield "NUMBER", line
        elif kind == "cont":
            line += 1
        elif kind != "comment":
            yield {"aug": "AUG", "cmp": "CMP", "pm": "PM", "bar": "OR", "star": "STAR", "slash": "/", "op": "OP"}[kind], line
    if brackets:
        raise Invalid(brackets[-1][1], "never closed")
    for _ in indents[1:]:
        yield "DEDENT", line


# ---- JavaScript and TypeScript --------------------------------------------------------------------

# The words that are tokens of their own in the scripts' grammars.
_JS_WORDS = frozenset(
    "await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static enum implements interface package private protected public "
    "async of get set from as type declare namespace module abstract readonly keyof unique infer is asserts satisfies require global override accessor out".split()
)
_JS_TOKEN = re.compile(
    r"[^\S\n\r\u2028\u2029]*(?:(?P<nl>\r\n|[\n\r\u2028\u2029])|(?P<name>(?:[^\W\d]|[$_]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$\u200c\u200d]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)|(?P<comment>//[^\n\r\u2028\u2029]*)|(?P<block>/\*)"
    r"|(?P<private>\#[^\W\d][\w$]*|\#[$_][\w$]*)|(?P<num>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?)"
    r"|(?P<str>\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n\r])*\"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n\r])*')|(?P<tick>`)"
    r"|(?P<inc>\+\+|--)|(?P<assign>(?:\*\*|<<|>>>|>>|&&|\|\||\?\?|[-+*/%&|^])=)|(?P<arrow>=>)|(?P<op>\*\*|===?|!==?|<=|>=|<<|&&|\|\||\?\?|[%^])"
    r"|(?P<dots>\.\.\.)|(?P<optdot>\?\.(?!\d))|(?P<add>[-+])|(?P<bar>\|)|(?P<amp>&)|(?P<gt>>)|(?P<slash>/)|(?P<fixed>[*<{}()\[\];,.:?=!~@])|(?P<bom>\ufeff)|(?P<end>\Z))"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\n\r\[])+/([A-Za-z]*)")
_JS_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(`|\$\{)")
#: After these a slash divides.
_OPERAND_ENDS = frozenset(["NAME", "NUM", "STR", "REGEX", "TEMPLATE", "TTAIL", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "INC", "INCNL"])


class _Elements:
    """The elements of JSX, read as array literals of what their braces hold: <a b={x}>c {y} <d/></a> is [x, y, []]."""

    def __init__(self, text: str):
        self.text, self.open, self.roots, self.modes = text, [], [], []

    def begins(self, at: int) -> bool:
        return _JSX_OPEN.match(self.text, at) is not None and _GENERIC.match(self.text, at) is None

    def start(self, at: int, line: int) -> tuple[int, list[str]]:
        """Of a root element at `<`."""
        self.roots.append(len(self.open))
        return self.go(at, "kids", line)

    def resume(self, at: int, line: int) -> tuple[int, list[str]]:
        """Behind the } of a brace."""
        at, tokens = self.go(at, self.modes.pop(), line)
        return at, [",", *tokens]

    def go(self, at: int, mode: str, line: int) -> tuple[int, list[str]]:
        """(where the script goes on, tokens): behind the root element, or behind the { of a brace, which is then the last token."""
        text, tokens = self.text, []
        while at < len(text):
            if mode == "kids":
                at = _JSX_TEXT.match(text, at).end() if len(self.open) > self.roots[-1] else at
                if m := _JSX_CLOSE.match(text, at):
                    if len(self.open) == self.roots[-1] or self.open.pop() != m.group(1):
                        raise Invalid(line, "an end tag closes nothing")
                elif m := _JSX_OPEN.match(text, at):
                    self.open.append(m.group(1))
                    tokens.append("[")
                    mode, at = "tag", m.end()
                    continue
                elif text[at : at + 1] == "{":
                    self.modes.append(mode)
                    return at + 1, [*tokens, "{"]
                else:
                    raise Invalid(line, "invalid text of an element")
            else:
                at = _JSX_SPACE.match(text, at).end()
                if m := _JSX_VALUE.match(text, at):
                    at = m.end()
                    continue
                if text[at : at + 1] == ">":
                    mode, at = "kids", at + 1
                    continue
                if text[at : at + 1] == "{":
                    self.modes.append(mode)
                    return at + 1, [*tokens, "{"]
                m = re.compile("/>").match(text, at)
                if m is None:
                    raise Invalid(line, "invalid attribute of an element")
                self.open.pop()
            at, mode = m.end(), "kids"
            if len(self.open) == self.roots[-1]:
                self.roots.pop()
                return at, [*tokens, "]"]
            tokens += ["]", ","]
        raise Invalid(line, "an element isn't closed")


_JSX_OPEN = re.compile(r"<\s*((?:[^\W\d]|[$_])[\w$.:\-]*|(?=>))")
_JSX_CLOSE = re.compile(r"<\s*/\s*([\w$.:\-]*)\s*>")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_JSX_SPACE = re.compile(r"(?:\s|/\*.*?\*/|//[^\n]*\n)*", re.S)
#: An attribute, whole or up to the brace of its value.
_JSX_VALUE = re.compile(r"(?:[^\W\d]|[$_])[\w$.:\-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=\{)))?", re.S)
_GENERIC = re.compile(r"<\s*\w+\s*(?:,|extends\b)")


def script_tokens(text: str, jsx: bool = False) -> Iterator[tuple[str, int, bool]]:
    """(token, line, whether a line break comes before it); raises Invalid."""
    elements = _Elements(text) if jsx else None
    at, line, size, match = 0, 1, len(text), _JS_TOKEN.match
    if text.startswith("#!"):
        at = len(re.match(r"[^\n\r]*", text).group())
    before, broken = "", False
    brackets: list[tuple[str, int, bool]] = []
    control = divides_after = False  # whether the last ) closed the head of if, while, for or with
    heads: list[str] = []

    def template(start: int) -> tuple[int, str]:
        m = _JS_TEMPLATE.match(text, start)
        if m is None:
            raise Invalid(line, "unterminated template")
        return m.end(), m.group(1)

    while at < size:
        m = match(text, at)
        if m is None:
            raise Invalid(line, f"invalid character or unterminated string at {text[at:].lstrip(" \t\f\v\u00a0")[:1]!r}")
        kind = m.lastgroup
        raw, start, at = m[kind], m.start(kind), m.end()
        if kind == "nl":
            line += 1
            broken = True
            continue
        if kind == "comment" or kind == "bom" or kind == "end":
            continue
        if kind == "block":
            end = text.find("*/", at)
            if end < 0:
                raise Invalid(line, "unterminated comment")
            lines = len(re.findall(r"\r\n|[\n\r\u2028\u2029]", text[at:end]))
            line, broken, at = line + lines, broken or lines > 0, end + 2
            continue
        tokens: tuple[str, ...]
        now = line
        if kind == "name":
            if before in (".", "OPTDOT"):
                tokens = ("NAME",)
            else:
                tokens = (raw if raw in _JS_WORDS else "NAME",)
        elif kind == "str":
            line += len(re.findall(r"\r\n|[\n\r]", raw)) if "\n" in raw or "\r" in raw else 0
            tokens = ("STR",)
        elif kind == "num":
            if at < size and (text[at].isalnum() or text[at] in "_$"):
                raise Invalid(line, "invalid number")
            tokens = ("NUM",)
        elif kind == "slash" or kind == "assign" and raw == "/=":
            operand = before in _OPERAND_ENDS and not (before == ")" and control) or before in _JS_CONTEXT
            if operand:
                tokens = ("/" if kind == "slash" else "ASSIGN",)
            else:
                r = _JS_REGEX.match(text, start)
                if r is None:
                    raise Invalid(line, "unterminated regular expression")
                if set(r.group(1)) - set("dgimsuvy") or len(set(r.group(1))) < len(r.group(1)):
                    raise Invalid(line, "invalid flags of a regular expression")
                at = r.end()
                tokens = ("REGEX",)
        elif kind == "tick":
            at, end = template(at)
            line += len(re.findall(r"\r\n|[\n\r]", text[start:at]))
            if end == "`":
                tokens = ("TEMPLATE",)
            else:
                brackets.append(("`", now, False))
                tokens = ("THEAD",)
        elif kind == "gt":
            tokens = ("GTA" if before in (">", "GTA") and text[start - 1] == ">" else ">",)
        elif kind == "fixed":
            tokens = (raw,)
            if jsx and (raw == "<" and not (before in _OPERAND_ENDS or before in _JS_CONTEXT) and elements.begins(start) or raw == "}" and brackets and brackets[-1][2] == "jsx"):
                if raw == "}":
                    brackets.pop()
                at, found = elements.start(start, line) if raw == "<" else elements.resume(at, line)
                if found and found[-1] == "{":
                    brackets.append(("}", line, "jsx"))
                    found.pop()
                line += len(re.findall(r"\r\n|[\n\r]", text[start:at]))
                tokens = tuple(found)
            elif raw in _OPEN:
                brackets.append((_OPEN[raw], line, before in ("if", "while", "for", "with", "await") and raw == "("))
            elif raw in _CLOSE:
                if raw == "}" and brackets and brackets[-1][0] == "`":
                    at, end = template(at)
                    line += len(re.findall(r"\r\n|[\n\r]", text[start:at]))
                    tokens = ("TMID",)
                    if end == "`":
                        brackets.pop()
                        tokens = ("TTAIL",)
                else:
                    if not brackets or brackets[-1][0] != raw:
                        raise Invalid(line, f"{raw} closes nothing")
                    control = brackets.pop()[2]
        elif kind == "inc":
            tokens = ("INCNL" if broken else "INC",)
        else:
            tokens = ({"assign": "ASSIGN", "arrow": "ARROW", "op": "OP", "dots": "...", "optdot": "OPTDOT", "add": "ADD", "bar": "BAR", "amp": "AMP", "private": "PRIVATE"}[kind],)
        if before in ("return", "break", "continue") and broken and tokens and tokens[0] not in (";", "}"):
            yield "VSEMI", now, broken
        if before == "throw" and broken:
            raise Invalid(now, "line break after throw")
        for t in tokens:
            yield t, now, broken
        before, broken = tokens[-1] if tokens else ",", False
    if brackets:
        raise Invalid(brackets[-1][1], "never closed")


# Words that are names unless the grammar says otherwise.
_JS_CONTEXT = frozenset("async of get set from as type declare namespace module abstract readonly keyof unique infer is asserts satisfies require global override accessor out let static".split())


# ---- recognisers ----------------------------------------------------------------------------------


@functools.lru_cache(maxsize=3)
def grammar(language: str) -> Grammar:
    if language == "python":
        return Grammar(grammars.PYTHON)
    fallback = {"{": "OBJ{", "function": "FUNX", "class": "CLSX"}
    text = grammars.SCRIPT
    if language == "typescript":
        text = "\n".join(x for x in text.split("\n") if not x.startswith("STRICT:")).replace(" | STRICT\n", " | implements | interface | package | private | protected | public\n") + grammars.TYPESCRIPT
    return Grammar(text, fallback)


def _recognise(g: Grammar, tokens: Iterator, script: bool) -> None:
    stacks, step, line = g.begin(), g.step, 1
    for t in tokens:
        token, line = t[0], t[1]
        after = step(stacks, token)
        if not after:
            if script and (t[2] or token == "}") and (with_end := step(stacks, "VSEMI")):
                after = step(with_end, token)
            if not after:
                raise Invalid(line, f"unexpected {token}")
        stacks = after
    if not step(stacks, "END") and not (script and (with_end := step(stacks, "VSEMI")) and step(with_end, "END")):
        raise Invalid(line, "unexpected end")


def first_error(text: str | None, language: str, jsx: bool = False) -> tuple[int, str] | None:
    """(line, reason) of the first unrecoverable error; None if the text is valid. jsx: scripts may hold elements."""
    if not text or not text.strip():
        return None
    try:
        if language == "python":
            _recognise(grammar("python"), python_tokens(text), False)
        else:
            _recognise(grammar(language), script_tokens(text), True)
    except Invalid as e:
        if jsx and language != "python":
            try:
                _recognise(grammar(language), script_tokens(text, True), True)
                return None
            except Invalid as e:
                return e.line, e.reason
        return e.line, e.reason
    return None


LANGUAGES = ("python", "typescript", "javascript")


def judged(records: DataFrame, texts: DataFrame) -> DataFrame:
    """file_id, workspace_id, repo, language, line, reason: the files of known language, line null if valid."""
    language = language_of(F.col("lang"), F.col("repo_relative_path"))
    jsx = F.coalesce(F.lower("repo_relative_path").rlike(r"\.[jt]sx$"), F.lit(False))
    one = records.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct("workspace_id", "repo", language.alias("language"), jsx.alias("jsx"))).alias("r")).select("file_id", "r.*")
    digest = F.md5(F.encode("text", "UTF-8")).alias("digest")
    files = one.where(F.col("language").isin(*LANGUAGES)).join(texts.select("file_id", digest).dropDuplicates(["file_id"]), "file_id", "left")
    asked = files.where(F.col("digest").isNotNull()).select("digest", "language", "jsx").distinct()
    # a text moves once, and copies of it are read once
    once = texts.where(F.col("text").isNotNull()).select(digest, "text").groupBy("digest").agg(F.any_value("text").alias("text")).join(asked, "digest")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = [first_error(t, x, j) for t, x, j in zip(b["text"], b["language"], b["jsx"], strict=True)]
            bad = [e is not None for e in errors]
            out = b.loc[bad, ["digest", "language", "jsx"]]
            out["line"] = [e[0] for e in errors if e]
            out["reason"] = [e[1] for e in errors if e]
            yield out

    invalid = once.mapInPandas(each, "digest string, language string, jsx boolean, line int, reason string")
    return files.join(invalid, ["digest", "language", "jsx"], "left").select("file_id", "workspace_id", "repo", "language", "line", "reason")


def rates(files: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files and their share."""
    invalid = F.count("line")
    return files.groupBy("workspace_id", "repo", "language").agg(F.count(F.lit(1)).alias("files"), invalid.alias("invalid"), F.round(invalid / F.count(F.lit(1)), 6).alias("rate"))


def p4_found(spark, folder):
    return judged(table(spark, folder, "file_record"), table(spark, folder, "source_text")).where(F.col("line").isNotNull()).select("file_id")


def p4_rates(spark, folder):
    return rates(judged(table(spark, folder, "file_record"), table(spark, folder, "source_text")))


SQL = {}
QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
