"""The stored tables: their columns, keys and edges, fixed here and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMON = "workspace_id string, repo string"
TABLES: dict[str, str] = {
    "file": f"{_COMMON}, file_path string, lang string, hash string, size_bytes bigint, line_count int",
    "module": f"{_COMMON}, file_path string, fqn string, kind string",
    "symbol": f"{_COMMON}, file_path string, fqn string, name string, kind string, parent_fqn string, signature string, docstring string, visibility string, start_line int, start_col int, end_line int, end_col int, seq int",
    "import": f"{_COMMON}, file_path string, raw string, local_name string, target_fqn string, seq int",
    "call_site": f"{_COMMON}, file_path string, call_id string, caller_fqn string, call_text string, start_line int",
    "route": f"{_COMMON}, file_path string, route_id string, method string, path string, framework string, handler_fqn string, start_line int, end_line int",
    "http_client_call": f"{_COMMON}, file_path string, call_id string, caller_fqn string, method string, path string, base_url string, start_line int, end_line int",
    "producer": f"{_COMMON}, file_path string, producer_id string, caller_fqn string, topic_name string, client_lib string, start_line int, end_line int",
    "consumer": f"{_COMMON}, file_path string, consumer_id string, caller_fqn string, topic_name string, client_lib string, start_line int, end_line int",
    "chunk": f"{_COMMON}, file_path string, chunk_id string, start_line int, end_line int, text string, embedding array<float>",
    "calls": "workspace_id string, call_id string, caller_repo string, caller_fqn string, callee_repo string, callee_fqn string, file_path string, start_line int, confidence double, strategy string",
    "http_flow": "workspace_id string, call_id string, route_id string, match_score double",
    "topic_flow": "workspace_id string, producer_id string, consumer_id string, topic_name string",
}
KEYS: dict[str, list[str]] = {
    "file": ["workspace_id", "repo", "file_path"],
    "module": ["workspace_id", "repo", "fqn"],
    "symbol": ["workspace_id", "repo", "fqn"],
    "route": ["route_id"],
    "http_client_call": ["call_id"],
    "producer": ["producer_id"],
    "consumer": ["consumer_id"],
    "chunk": ["chunk_id"],
    "calls": ["call_id"],
}
#: Edges that follow from the tables: type -> (table, columns of the start, columns of the end).
DERIVED = {
    "DEFINES": ("symbol", ["workspace_id", "repo", "file_path"], ["workspace_id", "repo", "fqn"]),
    "DEFINES_MODULE": ("module", ["workspace_id", "repo", "file_path"], ["workspace_id", "repo", "fqn"]),
    "HAS_CHUNK": ("chunk", ["workspace_id", "repo", "file_path"], ["chunk_id"]),
}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with just the table's columns, in its types; what df lacks is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(name)])


def assert_unique(df: DataFrame, name: str) -> None:
    """Raises ValueError if two rows have one key."""
    twice = df.groupBy(*KEYS[name]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name} has a key twice: {twice[0].asDict()}")


def conditional_edges(facts: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Edges from symbols to facts by the facts' `name` (a full name): only where the symbol exists in their repository."""
    nodes = symbols.select("workspace_id", "repo", F.col("fqn").alias(name)).distinct()
    return facts.join(nodes, ["workspace_id", "repo", name], "left_semi")


def encloses(symbols: DataFrame) -> DataFrame:
    """parent symbol -> symbol; a parent that is a module is no symbol and gives no edge."""
    return conditional_edges(symbols.where(F.col("parent_fqn").isNotNull()), symbols, "parent_fqn").select("workspace_id", "repo", "parent_fqn", "fqn")
