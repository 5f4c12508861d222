"""Guarded read-only SQL over the registered views.

A query is parsed, not run. Every node of its plan (subqueries included) has to be of a kind that only reads,
every table a registered view or a name that the query itself defines, and every function one of a list. All
else is refused: commands, writes, files or tables named by path or by more than one part, and functions that
reach outside.
"""

from __future__ import annotations

import json
import re
import threading
import time

from pyspark.sql import DataFrame, SparkSession

MOST_CHARS, MOST_ROWS, DEFAULT_ROWS, TIMEOUT = 10_000, 1000, 100, 30.0
# What identifiers and workspace ids may hold.
_IDENTIFIER, _WORKSPACE = re.compile(r"[A-Za-z0-9_.\-:/@*{}]{1,512}"), re.compile(r"[a-z0-9][a-z0-9_\-]*")
# Kinds of parsed plan nodes that only read.
_READS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except Join SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable OneRowRelation WithCTE UnresolvedWith CTERelationDef CTERelationRef "
    "LateralJoin Generate Window WithWindowDefinition Pivot Unpivot Sample Tail UnresolvedTableValuedFunction View LocalRelation Range Expand ResolvedInlineTable UnionLoop UnionLoopRef RepartitionByExpression Repartition UnresolvedTVFAliases AsOfJoin UnresolvedHint PipeExpression NameParameterizedQuery PosParameterizedQuery".split()
)
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Functions of a query beyond the operators: they compute from their arguments alone.
FUNCTIONS = _TABLE_FUNCTIONS | frozenset(
    "abs acos any any_value approx_count_distinct approx_percentile array array_agg array_append array_compact array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_prepend array_remove array_repeat array_size array_sort array_union arrays_overlap arrays_zip ascii asin atan atan2 avg "
    "bigint bin bit_and bit_count bit_length bit_or bit_xor bitmap_and_agg bitmap_construct_agg bitmap_count bitmap_or_agg bool_and bool_or boolean bround btrim cardinality cast cbrt ceil ceiling char char_length character_length chr coalesce collect_list collect_set concat concat_ws contains conv corr cos cosh cot count count_if "
    "covar_pop covar_samp crc32 cume_dist date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc dateadd datediff day dayofmonth dayofweek dayofyear decimal decode degrees dense_rank double e element_at elt encode endswith equal_null every exists exp explode explode_outer extract factorial filter find_in_set "
    "first first_value flatten float floor forall format_number format_string from_json from_unixtime get get_json_object greatest grouping grouping_id hash hex hour hypot if ifnull ilike in inline inline_outer initcap instr int isnan isnotnull isnull json_array_length json_object_keys kurtosis lag last last_day last_value lcase lead least left len "
    "length levenshtein like listagg ln locate log log10 log1p log2 lower lpad ltrim make_date make_timestamp map map_concat map_contains_key map_entries map_filter map_from_arrays map_from_entries map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct nanvl negative not nth_value ntile nullif "
    "nullifzero nvl nvl2 octet_length or overlay percent_rank percentile percentile_approx percentile_cont percentile_disc pi pmod position positive posexplode posexplode_outer pow power quarter radians rank reduce aggregate regexp regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace regexp_substr repeat replace reverse right rint rlike "
    "round row_number rpad rtrim second sequence sha sha1 sha2 shiftleft shiftright sign signum sin sinh size skewness slice smallint some sort_array soundex split split_part sqrt stack startswith std stddev stddev_pop stddev_samp string string_agg struct substr substring substring_index sum tan tanh timestamp timestamp_micros timestamp_millis timestamp_seconds timestampadd "
    "timestampdiff tinyint to_date to_json to_timestamp transform transform_keys transform_values translate trim trunc try_add try_avg try_cast try_divide try_element_at try_multiply try_subtract try_sum try_to_number try_to_timestamp typeof ucase unbase64 base64 unhex unix_date unix_micros unix_millis unix_seconds unix_timestamp upper var_pop var_samp variance weekday weekofyear "
    "width_bucket window xxhash64 year zeroifnull zip_with and".split()
)


class Refused(ValueError):
    """Why a query isn't run."""


def safe_identifier(value: str) -> str:
    if not isinstance(value, str) or not _IDENTIFIER.fullmatch(value):
        raise Refused("not a safe identifier")
    return value


def safe_workspace(value: str) -> str:
    if not isinstance(value, str) or not _WORKSPACE.fullmatch(value):
        raise Refused("not a safe workspace id")
    return value


def safe_search_text(value: str) -> str:
    if not isinstance(value, str) or len(value) > 256 or any(ord(c) < 32 or ord(c) == 127 for c in value):
        raise Refused("not a safe search text")
    return value


def _children(node):
    for group in (node.children(), node.innerChildren(), node.subqueries()):
        for i in range(group.length()):
            yield group.apply(i)


def _listed(items) -> list:
    return [items.apply(i) for i in range(items.length())]


def _names(node, found: list, defined: set[str]) -> None:
    """Adds the functions that a node's expressions call; subqueries are given back by _children."""
    todo = _listed(node.expressions())
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            found.append([str(x).lower() for x in _listed(e.nameParts())])
        todo.extend(_listed(e.children()))


def check(spark: SparkSession, query: str) -> None:
    """Raises Refused unless the query is one statement that only reads registered views."""
    if not isinstance(query, str) or not query.strip():
        raise Refused("empty query")
    if len(query) > MOST_CHARS:
        raise Refused(f"a query has at most {MOST_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise Refused(f"the query doesn't parse: {str(e).splitlines()[0][:200]}") from None
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    defined: set[str] = set()
    tables: list[list[str]] = []
    functions: list[list[str]] = []
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        kind = node.getClass().getSimpleName()
        is_plan = "logical" in name or kind in _READS or "catalyst.analysis" in name or "execution" in name or "commands" in name
        if is_plan and kind not in _READS:
            raise Refused(f"{kind} isn't a read")
        if kind == "UnresolvedRelation":
            tables.append([str(x) for x in _listed(node.multipartIdentifier())])
        if kind == "UnresolvedWith":
            defined |= {str(r._1()).lower() for r in _listed(node.cteRelations())}
        if kind == "UnresolvedTableValuedFunction":
            functions.append([str(x).lower() for x in _listed(node.name())])
        _names(node, functions, defined)
        todo.extend(_children(node))
    for parts in tables:
        if len(parts) != 1 or parts[0].lower() not in views | defined:
            raise Refused(f"{'.'.join(parts)[:100]} is no registered view")
    for parts in functions:
        if len(parts) != 1 or parts[0] not in FUNCTIONS:
            raise Refused(f"the function {'.'.join(parts)[:100]} isn't allowed")


def as_json(df: DataFrame) -> DataFrame:
    """One column of JSON objects, by Spark's own conversion: binary as hexadecimal text, nulls kept."""
    from pyspark.sql import functions as F

    shown = [F.hex(F.col(f"`{n}`")).alias(n) if kind == "binary" else F.col(f"`{n}`").cast("string").alias(n) if "interval" in kind or kind == "variant" else F.col(f"`{n}`") for n, kind in df.dtypes]
    return df.select(*shown).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def execute(spark: SparkSession, query: str, parameters: dict | None = None, limit: int = DEFAULT_ROWS, timeout: float = TIMEOUT) -> dict:
    """columns, rows, truncated; one row more than the limit is asked for, to know whether there are more."""
    if not 1 <= limit <= MOST_ROWS:
        raise Refused(f"limit must be 1 to {MOST_ROWS}")
    if parameters is not None and (not isinstance(parameters, dict) or not all(isinstance(k, str) and k.isidentifier() for k in parameters)):
        raise Refused("parameters must be a mapping of names")
    check(spark, query)
    df: DataFrame = spark.sql(query, args=parameters or {})
    if len(set(df.columns)) < len(df.columns):
        raise Refused("columns need different names")
    rows = with_timeout(spark, lambda: as_json(df.limit(limit + 1)).collect(), timeout)
    return {"columns": df.columns, "rows": [json.loads(r["row"]) for r in rows[:limit]], "truncated": len(rows) > limit}


def with_timeout(spark: SparkSession, run, seconds: float):
    """run(), whose Spark jobs are cancelled after so many seconds (0: never)."""
    tag = f"adhoc-{threading.get_ident()}-{time.monotonic_ns()}"
    done = threading.Event()

    def cancel() -> None:
        if not done.wait(seconds):
            spark.interruptTag(tag)

    if seconds > 0:
        threading.Thread(target=cancel, daemon=True).start()
    spark.addTag(tag)
    try:
        return run()
    finally:
        done.set()
        spark.removeTag(tag)
