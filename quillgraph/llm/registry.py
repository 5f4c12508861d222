"""QUERIES and SQL of this subpackage's modules."""

from __future__ import annotations

import importlib
import importlib.util

NAMES = ["nearest", "code_docs", "syntax_check", "authorship", "fused_ranking", "leakage", "mixing", "residue"]
_MODULES = [importlib.import_module(f"quillgraph.llm.{n}") for n in NAMES if importlib.util.find_spec(f"quillgraph.llm.{n}")]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
