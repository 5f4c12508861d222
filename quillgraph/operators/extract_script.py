"""Facts of TypeScript and JavaScript sources, from their tokens and brackets.

Files needn't be valid: brackets that aren't closed end with the file, and what isn't understood is
passed over.
"""

from __future__ import annotations

import re

from quillgraph.operators.facts import HTTP_VERBS, Facts, normal_path, qualify, split_url

_TOKEN = re.compile(
    r"(?P<skip>\s+)|(?P<doc>/\*\*(?!/).*?(?:\*/|\Z))|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`(?:\\.|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`?)"
    r"|(?P<regex>(?<=[=(,:?&|!{};\[])\s?/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)|(?P<name>#?[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>=>|\.\.\.|\?\.|[-+*/%&|^!=<>]=+|&&|\|\||\?\?|\+\+|--|.)",
    re.S,
)
_NO_CALL = frozenset("if for while switch catch function return typeof void delete await yield new super in of instanceof class constructor import with do else case throw async".split())
_MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override get set accessor".split())
# Methods of routers and route decorators, names of HTTP clients, calls of message clients, exported handlers.
_EXPRESS = frozenset(["get", "post", "put", "patch", "delete", "head", "options", "all"])
_NEST = frozenset(["Get", "Post", "Put", "Patch", "Delete", "Head", "Options", "All"])
_CLIENTS = frozenset(["axios", "http", "api", "client", "request", "instance"])
_PRODUCE = frozenset(["send", "produce", "sendBatch"])
_CONSUME = frozenset(["subscribe", "assign"])
_VERBS = frozenset(["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"])
DYNAMIC = "<dynamic>"
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class _Token:
    __slots__ = ("kind", "text", "line", "col", "end_line", "end_col", "mate", "doc")

    def __init__(self, kind, text, line, col, end_line, end_col):
        self.kind, self.text, self.line, self.col, self.end_line, self.end_col, self.mate, self.doc = kind, text, line, col, end_line, end_col, 0, ""


def _doc(text: str) -> str:
    body = text[3:-2] if text.endswith("*/") else text[3:]
    return "\n".join(re.sub(r"^\s*\*? ?", "", x).rstrip() for x in body.split("\n")).strip()


def tokens(source: str) -> list[_Token]:
    out: list[_Token] = []
    line, start, doc, stack = 1, 0, "", []
    for m in _TOKEN.finditer(source):
        kind, raw = m.lastgroup, m.group()
        col = m.start() - start
        breaks = raw.count("\n")
        first = line
        if breaks:
            line += breaks
            start = m.start() + raw.rfind("\n") + 1
        if kind in ("skip", "comment", "doc"):
            doc = _doc(raw) if kind == "doc" else doc if kind == "skip" else ""
            continue
        t = _Token(kind, raw, first, col, line, m.end() - start)
        t.doc, doc = doc, ""
        out.append(t)
        if kind == "punct" and raw in "([{":
            stack.append(len(out) - 1)
        elif kind == "punct" and raw in ")]}":
            while stack and _PAIRS[out[stack[-1]].text] != raw:
                out[stack.pop()].mate = len(out) - 1
            if stack:
                out[stack[-1]].mate = len(out) - 1
                t.mate = stack.pop()
    for i in stack:
        out[i].mate = len(out)
    return out


def _string(t: _Token) -> str | None:
    if t.kind == "string":
        return t.text.strip("\"'")
    if t.kind == "template":
        return re.sub(r"\$\{[^}]*\}", "{}", t.text.strip("`"))
    return None


class _Walker:
    def __init__(self, path: str, source: str, facts: Facts, module: str):
        self.path, self.facts, self.module = path, facts, module
        self.source = source.split("\n")
        self.t = tokens(source)
        app = re.search(r"/app(/.*)?/route\.\w+$", "/" + path)
        self.app_route = (app.group(1) or "/") if app else None
        pages = re.search(r"/pages(/api/.*)\.\w+$", "/" + path)
        self.page = re.sub(r"/index$", "", pages.group(1)) if pages else None

    def is_(self, i: int, text: str) -> bool:
        return i < len(self.t) and self.t[i].text == text and self.t[i].kind in ("punct", "name")

    def span(self, a: int, b: int) -> tuple[int, int, int, int]:
        b = min(max(a, b), len(self.t) - 1)
        return self.t[a].line, self.t[a].col, self.t[b].end_line, self.t[b].end_col

    def after(self, i: int) -> int:
        """The index behind the token or bracket at i."""
        return self.t[i].mate + 1 if i < len(self.t) and self.t[i].text in _PAIRS and self.t[i].kind == "punct" else i + 1

    def head(self, a: int, b: int) -> str:
        first, last = self.t[a], self.t[min(b, len(self.t) - 1)]
        lines = self.source[first.line - 1 : last.line]
        if not lines:
            return ""
        lines[-1] = lines[-1][: last.col] if last.line != first.line else lines[-1][first.col : last.col]
        if last.line != first.line:
            lines[0] = lines[0][first.col :]
        return " ".join(" ".join(lines).split()).rstrip("{ ").strip()

    def symbol(self, a: int, end: int, head_end: int, name: str, parent: str, kind: str, doc: str) -> str:
        fqn = qualify(parent, name)
        self.facts.add("symbol", self.span(a, end), name=name, fqn=fqn, symbol_kind=kind, parent_fqn=parent, signature=self.head(a, head_end), docstring=doc, visibility="protected" if name.startswith("_") else "public")
        return fqn

    def run(self) -> None:
        if self.page:
            self.facts.route((1, 0, 1, 0), "*", self.next_path(self.page), "nextjs-pages", qualify(self.module, "default"))
        self.block(0, len(self.t), self.module, self.module)

    @staticmethod
    def next_path(path: str) -> str:
        return normal_path(re.sub(r"\[\.{0,3}[^\]]*\]", "{}", path))

    def handler(self, name: str, exported: bool, at: tuple, fqn: str) -> None:
        if exported and self.app_route is not None and name in _VERBS:
            self.facts.route(at, name, self.next_path(self.app_route), "nextjs-app", fqn)

    def block(self, i: int, end: int, parent: str, caller: str) -> None:
        """Statements and expressions between two indexes."""
        decorators: list[tuple[str, str | None]] = []
        while i < end:
            t = self.t[i]
            if t.text == "@" and i + 1 < end and self.t[i + 1].kind == "name":
                has = self.is_(i + 2, "(")
                first = self.t[i + 3] if has and i + 3 < end else None
                decorators.append((self.t[i + 1].text, (_string(first) or "") if first is not None else ""))
                i = self.after(i + 2) if has else i + 2
                continue
            if t.kind != "name" or (i and self.is_(i - 1, ".")):
                i += 1
                continue
            start, doc, exported = i, t.doc, False
            j = i
            while j < end and self.t[j].kind == "name" and self.t[j].text in _MODIFIERS and j + 1 < end and (self.t[j + 1].kind == "name" or self.is_(j + 1, "*")):
                exported = exported or self.t[j].text == "export"
                j += 1
            word = self.t[j].text if j < end else ""
            name = self.t[j + 1].text if j + 1 < end and self.t[j + 1].kind == "name" else ""
            if word == "import" and j == i and not self.is_(i + 1, "(") and not self.is_(i + 1, "."):
                i = self.imports(i, end)
            elif word == "function":
                k = j + 2 if self.is_(j + 1, "*") else j + 1
                name = self.t[k].text if k < end and self.t[k].kind == "name" else "default" if "default" in [x.text for x in self.t[start:j]] else ""
                body = self.find(k, end, "{")
                if not name or body >= end:
                    i = j + 1
                    continue
                fqn = self.symbol(start, self.t[body].mate, body, name, parent, "function", doc)
                self.handler(name, exported, self.span(start, body), fqn)
                self.block(body + 1, self.t[body].mate, fqn, fqn)
                i = self.after(body)
            elif word in ("class", "enum", "namespace", "module", "interface") and name:
                body = self.find(j + 1, end, "{")
                if body >= end:
                    i = j + 1
                    continue
                kind = "interface" if word == "interface" else "class"
                fqn = self.symbol(start, self.t[body].mate, body, name, parent, kind, doc)
                if word == "class":
                    prefix = next((p for n, p in decorators if n == "Controller"), None)
                    self.members(body + 1, self.t[body].mate, fqn, None if prefix is None else normal_path(prefix))
                elif word in ("namespace", "module"):
                    self.block(body + 1, self.t[body].mate, fqn, fqn)
                i = self.after(body)
                decorators = []
            elif word == "type" and name and (self.is_(j + 2, "=") or self.is_(j + 2, "<")):
                stop = j + 2
                while stop < end and self.t[stop].text != ";" and not (self.t[stop].kind == "name" and self.t[stop].text in ("export", "const", "function", "class", "interface", "type", "import", "let", "var") and self.t[stop].line > self.t[stop - 1].end_line):
                    stop = self.after(stop)
                self.symbol(start, min(stop, end) - 1, min(stop, end - 1), name, parent, "type_alias", doc)
                i = stop
            elif word in ("const", "let", "var") and name and not (i and self.is_(i - 1, "(")):
                i = self.variable(start, j, end, name, parent, caller, doc, exported)
            else:
                i = self.call(i, end, caller)

    def find(self, i: int, end: int, text: str) -> int:
        """The next token of that text outside brackets; end if a statement ends before."""
        while i < end:
            if self.is_(i, text):
                return i
            if self.is_(i, ";"):
                return end
            i = self.after(i)
        return end

    def arrow(self, i: int, end: int) -> int:
        """If a function begins at i, the index of its arrow or of its body's brace; else -1."""
        if self.is_(i, "async"):
            i += 1
        if self.is_(i, "function"):
            body = self.find(i, end, "{")
            return body if body < end else -1
        if self.is_(i, "<"):
            while i < end and not self.is_(i, "("):
                i += 1
        if i < end and self.t[i].kind == "name" and self.is_(i + 1, "=>"):
            return i + 1
        if self.is_(i, "("):
            k = self.after(i)
            if self.is_(k, ":"):
                while k < end and not self.is_(k, "=>") and self.t[k].text not in (";", "=", ","):
                    k = self.after(k)
            return k if self.is_(k, "=>") else -1
        return -1

    def variable(self, start: int, j: int, end: int, name: str, parent: str, caller: str, doc: str, exported: bool) -> int:
        k = j + 2
        while k < end and self.t[k].text not in ("=", ";", ",", "of", "in") and not (self.t[k].line > self.t[j].line + 20):
            k = self.after(k)
        if not self.is_(k, "="):
            if not (self.is_(k, "of") or self.is_(k, "in")):
                self.symbol(start, min(k, end) - 1, min(k, end - 1), name, parent, "variable", doc)
            return k
        mark = self.arrow(k + 1, end)
        if mark < 0:
            stop = self.value_end(k + 1, end)
            self.symbol(start, stop - 1, k, name, parent, "variable", doc)
            self.block(k + 1, stop, parent, caller)
            return stop
        body = mark if self.is_(mark, "{") else mark + 1
        stop = self.after(body) if self.is_(body, "{") else self.value_end(body, end)
        fqn = self.symbol(start, stop - 1, mark, name, parent, "function", doc)
        self.handler(name, exported, self.span(start, mark), fqn)
        self.block(body + 1 if self.is_(body, "{") else body, stop - 1 if self.is_(body, "{") else stop, fqn, fqn)
        return stop

    def value_end(self, i: int, end: int) -> int:
        """Behind an expression: at its semicolon, or where a new statement begins on another line."""
        start = i
        while i < end:
            t = self.t[i]
            if t.kind == "punct" and t.text in (";", ","):
                return i
            if i > start and t.line > self.t[i - 1].end_line and t.kind == "name" and self.t[i - 1].text not in ("=", "+", "(", ",", "?", ":", "&&", "||", "=>", "."):
                return i
            i = self.after(i)
        return end

    def members(self, i: int, end: int, owner: str, prefix: str | None) -> None:
        decorators: list[tuple[str, str, int]] = []
        while i < end:
            t = self.t[i]
            if t.text == "@" and i + 1 < end:
                has = self.is_(i + 2, "(")
                first = _string(self.t[i + 3]) if has and i + 3 < end else None
                decorators.append((self.t[i + 1].text, first or "", i))
                i = self.after(i + 2) if has else i + 2
                continue
            start, doc, j = i, t.doc, i
            while j + 1 < end and self.t[j].kind == "name" and self.t[j].text in _MODIFIERS and not self.t[j + 1].text in ("(", "=", ";", ":", "?", "!", "}"):
                j += 1
            if self.is_(j, "*"):
                j += 1
            if j >= end or self.t[j].kind not in ("name", "string"):
                i = self.after(i)
                continue
            name, k = self.t[j].text.strip("\"'"), j + 1
            if self.is_(k, "<"):
                while k < end and not self.is_(k, "("):
                    k += 1
            if self.is_(k, "("):
                body = k
                k = self.after(k)
                while k < end and not self.is_(k, "{") and not self.is_(k, ";") and not (self.t[k].line > self.t[k - 1].end_line and self.t[k].kind == "name" and not self.is_(k - 1, ":")):
                    k = k + 1
                if self.is_(k, "{"):
                    fqn = self.symbol(start, self.t[k].mate, k, name, owner, "method", doc)
                    if prefix is not None:
                        for d, sub, at in decorators:
                            if d in _NEST:
                                self.facts.route(self.span(at, at + 1), "*" if d == "All" else d.upper(), f"{prefix.rstrip('/')}/{sub.lstrip('/')}" if sub else prefix or "/", "nestjs", fqn)
                    self.block(body + 1, self.t[body].mate, fqn, fqn)
                    self.block(k + 1, self.t[k].mate, fqn, fqn)
                    k = self.after(k)
                i = max(k, i + 1)
            else:
                while k < end and self.t[k].text not in ("=", ";") and not (self.t[k].line > self.t[k - 1].end_line and not self.is_(k - 1, ":")):
                    k = self.after(k)
                if self.is_(k, "="):
                    stop = self.value_end(k + 1, end)
                    mark = self.arrow(k + 1, end)
                    if mark >= 0:
                        body = mark if self.is_(mark, "{") else mark + 1
                        stop = self.after(body) if self.is_(body, "{") else self.value_end(body, end)
                        fqn = self.symbol(start, stop - 1, mark, name, owner, "method", doc)
                        self.block(body + (self.is_(body, "{")), stop, fqn, fqn)
                    else:
                        self.block(k + 1, stop, owner, owner)
                    k = stop
                i = max(k, i + 1)
            decorators = []

    def imports(self, i: int, end: int) -> int:
        stop, names = i + 1, []
        while stop < end and self.t[stop].kind != "string" and not self.is_(stop, ";"):
            names.append(self.t[stop])
            stop += 1
        if stop >= end or self.t[stop].kind != "string":
            return stop
        module = self.t[stop].text.strip("\"'")
        at, raw = self.span(i, stop), self.head(i, stop + 1) if stop + 1 < len(self.t) else self.head(i, stop) + " " + self.t[stop].text
        add = lambda local, target: self.facts.add("import", at, raw=raw, local_name=local, target_fqn=target)
        if not names:
            add("", module)
        words = [x.text for x in names if x.text not in ("from", "type") or len(names) == 1]
        k = 0
        while k < len(words):
            w = words[k]
            if w == "*":
                add(words[k + 2] if k + 2 < len(words) else "*", f"{module}.*")
                k += 3
            elif w == "{":
                k += 1
                while k < len(words) and words[k] != "}":
                    if words[k] != ",":
                        name = words[k].strip("\"'")
                        if k + 2 < len(words) and words[k + 1] == "as":
                            add(words[k + 2], f"{module}.{name}")
                            k += 2
                        else:
                            add(name, f"{module}.{name}")
                    k += 1
                k += 1
            else:
                if w != ",":
                    add(w, f"{module}.default")
                k += 1
        return stop + 1

    def call(self, i: int, end: int, caller: str) -> int:
        """Reads a chain of names from i; if it is called, that is a fact. Returns where to go on."""
        chain, k = [self.t[i].text], i + 1
        while k + 1 < end and self.t[k].text in (".", "?.") and self.t[k + 1].kind == "name":
            chain.append(self.t[k + 1].text)
            k += 2
        # a chained call goes on behind its arguments, where its name follows a dot
        if not self.is_(k, "(") or chain[0] in _NO_CALL and len(chain) == 1:
            return k
        self.called(i, k, chain, caller)
        self.block(k + 1, self.t[k].mate, caller, caller)
        k, text = self.after(k), ".".join(chain) + "()"
        while k + 1 < end and self.t[k].text in (".", "?.") and self.t[k + 1].kind == "name":
            chain = [text, self.t[k + 1].text]
            if self.is_(k + 2, "("):
                self.called(i, k + 2, chain, caller)
                self.block(k + 3, self.t[k + 2].mate, caller, caller)
                text, k = f"{'.'.join(chain)}()", self.after(k + 2)
            else:
                text, k = ".".join(chain), k + 2
        return k

    def called(self, i: int, open_: int, chain: list[str], caller: str) -> None:
        close = self.t[open_].mate
        at = self.span(i, close)
        self.facts.add("call", at, caller_fqn=caller, call_text=".".join(chain))
        first = self.t[open_ + 1] if open_ + 1 < close else None
        url = _string(first) if first is not None else None
        method, receiver = chain[-1], chain[-2] if len(chain) > 1 else ""
        second = self.after(open_ + 1) + 1 if first is not None and self.is_(self.after(open_ + 1), ",") else close
        if chain == ["fetch"] and url is not None:
            verb = "GET"
            if self.is_(second, "{"):
                for k in range(second + 1, self.t[second].mate - 1):
                    if self.t[k].text.strip("\"'") == "method" and self.is_(k + 1, ":") and (v := _string(self.t[k + 2])) and v.upper() in HTTP_VERBS:
                        verb = v.upper()
            self.facts.client(at, caller, verb, *split_url(url))
            return
        if len(chain) < 2:
            return
        if method.lower() in _EXPRESS and url is not None:
            handler = ""
            if second < close and self.t[second].kind == "name" and self.arrow(second, close) < 0:
                k = second
                while k + 2 < close and self.t[k + 1].text == "." and self.t[k + 2].kind == "name":
                    k += 2
                if k + 1 >= close or self.t[k + 1].text in (",", ")"):
                    handler = "".join(x.text for x in self.t[second : k + 1])
            self.facts.route(at, "*" if method.lower() == "all" else method.upper(), url, "express", handler or f"<inline>@{self.path}:{self.t[i].line}")
        if method.upper() in HTTP_VERBS and (receiver.lower() in _CLIENTS) and url is not None:
            self.facts.client(at, caller, method.upper(), *split_url(url))
        if method in _PRODUCE or method in _CONSUME:
            topic = self.topic(open_ + 1, close) or DYNAMIC
            self.facts.add("producer" if method in _PRODUCE else "consumer", at, caller_fqn=caller, topic_name=topic, client_lib="kafkajs")

    def topic(self, i: int, close: int) -> str | None:
        """A literal topic: the first argument, its first element, or what its topic or topics says."""
        if i >= close:
            return None
        t = self.t[i]
        if t.kind == "string" or t.kind == "template" and "${" not in t.text:
            return _string(t)
        if t.text == "[":
            return self.topic(i + 1, t.mate)
        if t.text == "{":
            for k in range(i + 1, min(t.mate, len(self.t)) - 1):
                if self.t[k].text.strip("\"'") in ("topic", "topics") and self.is_(k + 1, ":"):
                    return self.topic(k + 2, t.mate)
        return None


def extract(path: str, source: str, module: str, facts: Facts) -> None:
    _Walker(path, source.replace("\r\n", "\n").replace("\r", "\n"), facts, module).run()
