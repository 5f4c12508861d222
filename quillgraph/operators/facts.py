"""The rows that extractors yield, and the rules they share."""

from __future__ import annotations

import re

from quillgraph.functions.text import HTTP_METHODS, PARAMETERS

HTTP_VERBS = frozenset(HTTP_METHODS)
_FIELDS = "name fqn symbol_kind parent_fqn signature docstring visibility raw local_name target_fqn caller_fqn call_text method path framework handler_fqn base_url topic_name client_lib".split()
SCHEMA = "file_id bigint, workspace_id string, repo string, file_path string, lang string, fact string, seq int, start_line int, start_col int, end_line int, end_col int, " + ", ".join(f"{f} string" for f in _FIELDS) + ", error string"
#: The columns that each kind of fact fills.
COLUMNS = {
    "module": ["fqn", "symbol_kind"],
    "symbol": ["name", "fqn", "symbol_kind", "parent_fqn", "signature", "docstring", "visibility", "end_line", "start_col", "end_col"],
    "import": ["raw", "local_name", "target_fqn"],
    "call": ["caller_fqn", "call_text"],
    "route": ["method", "path", "framework", "handler_fqn", "end_line"],
    "client": ["caller_fqn", "method", "path", "base_url", "end_line"],
    "producer": ["caller_fqn", "topic_name", "client_lib", "end_line"],
    "consumer": ["caller_fqn", "topic_name", "client_lib", "end_line"],
    "error": ["error"],
}


def qualify(parent: str, name: str) -> str:
    return f"{parent}.{name}" if parent else name


def join_path(module: str, name: str) -> str:
    return module + name if module.endswith(".") else f"{module}.{name}"


def normal_path(path: str) -> str:
    """The same rule as functions.text.normalize_path."""
    if not path:
        return path
    for pattern in PARAMETERS:
        path = re.sub(pattern, "{}", path)
    path = re.sub("/+", "/", "/" + path)
    return path if path == "/" else path.removesuffix("/")


def split_url(url: str) -> tuple[str | None, str]:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)(.*)$", url, re.S)
    return (m.group(1), m.group(2) or "/") if m else (None, url)


def module_name(path: str, lang: str) -> str:
    """The same rule as functions.text.module_fqn."""
    path = re.sub(r"^(?:(?:src|lib)/)+", "", path)
    if lang == "python":
        path = re.sub(r"(?:^|/)__init__$", "", re.sub(r"\.pyi?$", "", path))
    else:
        path = re.sub(r"(?:^|/)index$", "", re.sub(r"\.(?:tsx?|mts|cts|jsx?|mjs|cjs)$", "", path))
    return path.replace("/", ".")


class Facts:
    """Collects the facts of one file in order."""

    def __init__(self, path: str):
        self.path, self.rows = path, []

    def add(self, fact: str, at, **values) -> None:
        """at: a syntax node, or (start_line, start_col, end_line, end_col)."""
        span = at if isinstance(at, tuple) else (at.lineno, at.col_offset, at.end_lineno, at.end_col_offset)
        self.rows.append({"fact": fact, "seq": len(self.rows), "start_line": span[0], "start_col": span[1], "end_line": span[2], "end_col": span[3], **values})

    def route(self, at, method: str, path: str, framework: str, handler: str) -> None:
        self.add("route", at, method=method, path=normal_path(path), framework=framework, handler_fqn=handler)

    def client(self, at, caller: str, method: str, base: str | None, path: str) -> None:
        self.add("client", at, caller_fqn=caller, method=method, path=normal_path(path), base_url=base)
