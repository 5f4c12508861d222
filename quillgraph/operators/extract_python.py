"""Facts of Python sources, from the syntax tree; blocks that don't parse are left out, the others stay."""

from __future__ import annotations

import ast
import re
import warnings

from quillgraph.operators.facts import HTTP_VERBS, Facts, join_path, qualify, split_url

# Methods of route decorators, names of HTTP clients, calls of message clients.
_ROUTE_METHODS = frozenset(["get", "post", "put", "patch", "delete", "head", "options"])
_CLIENT_LIBRARIES = frozenset(["requests", "httpx"])
_CLIENT_NAMES = frozenset(["client", "session", "http", "async_client", "http_client"])
_PRODUCE = frozenset(["send", "send_and_wait", "produce"])
_CONSUME = frozenset(["subscribe", "assign"])
_CONSUMER_CLASSES = {"KafkaConsumer": "kafka-python", "AIOKafkaConsumer": "aiokafka"}
DYNAMIC = "<dynamic>"


def _parse(source: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(source)


def tree(source: str) -> ast.Module:
    """The module's tree. If it doesn't parse, that of each block that does, at its own place; of a definition that doesn't,
    its head and what can be read of its body."""
    source = source.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff").replace("\0", "")
    try:
        return _parse(source)
    except (SyntaxError, ValueError, RecursionError):
        pass
    lines = source.split("\n")
    return ast.Module(body=_recovered(lines, 0, len(lines), 0), type_ignores=[])


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _at(lines: list[str], a: int, b: int, indent: int) -> list[ast.stmt] | None:
    """The statements of the lines a to b, at their own places; None if they don't parse."""
    text = "\n".join(lines[a:b])
    try:
        if not indent:
            return _parse("\n" * a + text).body
        return _parse("\n" * (a - 1) + f"if 1:\n{text}").body[0].body
    except (SyntaxError, ValueError, RecursionError):
        return None


def _recovered(lines: list[str], a: int, b: int, indent: int) -> list[ast.stmt]:
    starts = [i for i in range(a, b) if lines[i].strip() and _indent(lines[i]) <= indent and lines[i].lstrip()[0] not in "#)]}" and not re.match(r"\s*(?:else|elif|except|finally)\b", lines[i])]
    # decorators belong to what follows them
    starts = [i for k, i in enumerate(starts) if not (k and lines[starts[k - 1]].lstrip().startswith("@") and all(not x.strip() or _indent(x) > indent for x in lines[starts[k - 1] + 1 : i]))]
    body: list[ast.stmt] = []
    for first, last in zip(starts, [*starts[1:], b], strict=True):
        found = _at(lines, first, last, indent)
        body += _definition(lines, first, last, indent) if found is None else found
    return body


def _definition(lines: list[str], a: int, b: int, indent: int) -> list[ast.stmt]:
    """A class or function whose body holds an error."""
    head = next((i for i in range(a, b) if not lines[i].lstrip().startswith("@")), b)
    if head >= b or not re.match(r"\s*(?:async\s+def|def|class)\b", lines[head]):
        return []
    for end in range(head, b):
        if lines[end].split("#")[0].rstrip().endswith(":"):
            found = _at([*lines[:end], lines[end] + " pass"], a, end + 1, indent)
            if not found:
                return []
            inner = next((_indent(x) for x in lines[end + 1 : b] if x.strip()), 0)
            if inner > indent and (rest := _recovered(lines, end + 1, b, inner)):
                found[-1].body = rest
            found[-1].end_lineno = b
            return found
    return []


def _chain(node: ast.expr) -> list[str]:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return [node.id, *reversed(parts)]
    return ["", *reversed(parts)] if parts else []


def _text(node: ast.expr | None) -> str | None:
    """A string literal's text; what an f-string fills in becomes {}."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return "".join(str(v.value) if isinstance(v, ast.Constant) else "{}" for v in node.values)
    return None


def _first_text(call: ast.Call) -> str | None:
    return _text(call.args[0]) if call.args else None


def visibility(name: str) -> str:
    if name.startswith("__") and name.endswith("__"):
        return "public"
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


class _Walker:
    def __init__(self, source: str, facts: Facts, module: str):
        self.source, self.facts, self.module = source, facts, module
        self.lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")

    def body(self, statements: list[ast.stmt], parent: str, in_class: bool) -> None:
        for s in statements:
            self.statement(s, parent, in_class)

    def statement(self, s: ast.stmt, parent: str, in_class: bool) -> None:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.definition(s, parent, in_class)
            return
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            self.imports(s)
        for field in ast.iter_child_nodes(s):
            if isinstance(field, ast.stmt):
                self.statement(field, parent, in_class)
            elif isinstance(field, (ast.ExceptHandler, ast.match_case)):
                self.body(field.body, parent, in_class)
                if isinstance(field, ast.ExceptHandler) and field.type:
                    self.calls(field.type, parent)
            else:
                self.calls(field, parent)

    def definition(self, s, parent: str, in_class: bool) -> None:
        fqn = qualify(parent, s.name)
        kind = "class" if isinstance(s, ast.ClassDef) else "method" if in_class else "function"
        head_end = s.body[0].lineno - 1 if s.body and s.body[0].lineno > s.lineno else s.lineno
        head = " ".join(" ".join(x.split()) for x in self.lines[s.lineno - 1 : head_end])
        if s.body and s.body[0].lineno == s.lineno:
            head = " ".join(self.lines[s.lineno - 1].encode()[s.col_offset : s.body[0].col_offset].decode(errors="replace").split())
        doc = ast.get_docstring(s, clean=True) or ""
        signature = re.sub(r":\s*(?:#.*)?$", "", re.split(r"\s*(?:\"\"\"|''')", head)[0]).strip()
        self.facts.add("symbol", s, name=s.name, fqn=fqn, symbol_kind=kind, parent_fqn=parent, signature=signature, docstring=doc, visibility=visibility(s.name))
        for d in s.decorator_list:
            self.decorator(d, fqn)
        self.body(s.body, fqn, isinstance(s, ast.ClassDef))

    def imports(self, s) -> None:
        raw = " ".join(ast.unparse(s).split())
        for a in s.names:
            if isinstance(s, ast.Import):
                self.facts.add("import", s, raw=raw, local_name=a.asname or a.name.split(".")[0], target_fqn=a.name)
            else:
                module = "." * s.level + (s.module or "")
                if a.name == "*":
                    self.facts.add("import", s, raw=raw, local_name="*", target_fqn=module)
                else:
                    self.facts.add("import", s, raw=raw, local_name=a.asname or a.name, target_fqn=join_path(module, a.name))

    def decorator(self, d: ast.expr, handler: str) -> None:
        if not isinstance(d, ast.Call) or not isinstance(d.func, ast.Attribute):
            return
        name = d.func.attr
        if name == "agent":
            topic = next((t for t in map(_text, d.args) if t), None) or DYNAMIC
            self.facts.add("consumer", d, caller_fqn=handler, topic_name=topic, client_lib="faust")
        path = _first_text(d)
        if path is None:
            return
        if name in _ROUTE_METHODS:
            self.facts.route(d, name.upper(), path, "fastapi-or-flask", handler)
        elif name == "route":
            listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
            methods = [m for m in map(_text, listed.elts) if m] if isinstance(listed, (ast.List, ast.Tuple, ast.Set)) else []
            for m in methods or ["GET"]:
                self.facts.route(d, m.upper(), path, "flask", handler)

    def calls(self, node: ast.AST, caller: str) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                self.call(x, caller)

    def call(self, x: ast.Call, caller: str) -> None:
        self.facts.add("call", x, caller_fqn=caller, call_text=" ".join(ast.unparse(x.func).split()))
        if isinstance(x.func, ast.Name) and x.func.id in _CONSUMER_CLASSES:
            self.facts.add("consumer", x, caller_fqn=caller, topic_name=_first_text(x) or DYNAMIC, client_lib=_CONSUMER_CLASSES[x.func.id])
        if not isinstance(x.func, ast.Attribute):
            return
        chain = _chain(x.func)
        method, receiver = chain[-1] if chain else "", chain[-2] if len(chain) > 1 else ""
        if method.upper() in HTTP_VERBS and (receiver in _CLIENT_LIBRARIES or receiver.lower() in _CLIENT_NAMES) and (url := _first_text(x)) is not None:
            self.facts.client(x, caller, method.upper(), *split_url(url))
        library = "aiokafka" if "aio" in receiver.lower() else "kafka-python"
        if method in _PRODUCE:
            self.facts.add("producer", x, caller_fqn=caller, topic_name=_first_text(x) or DYNAMIC, client_lib=library)
        elif method in _CONSUME:
            first = x.args[0] if x.args else None
            topics = [t for t in map(_text, first.elts) if t] if isinstance(first, (ast.List, ast.Tuple)) else [t for t in [_text(first)] if t]
            for topic in topics or [DYNAMIC]:
                self.facts.add("consumer", x, caller_fqn=caller, topic_name=topic, client_lib=library)


def extract(path: str, source: str, module: str, facts: Facts) -> None:
    _Walker(source, facts, module).body(tree(source).body, module, False)
