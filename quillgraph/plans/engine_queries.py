"""Registered queries of the engine's operators over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as fn
from quillgraph.operators import catalog, chunking, flows, incremental, resolve, search, traverse
from quillgraph.session import staged
from quillgraph.sources.tables import table as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# ---- scalars ------------------------------------------------------------------------------------

_NORM = r"""regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\{{[^/{{}}]+\}}', '{{}}', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{{}}', 'g'), '\[[^/\[\]]+\]', '{{}}', 'g'), '<[^/<>]+>', '{{}}', 'g'), '/+', '/', 'g'), '(.)/$', '\1')"""


@query("path_normalize", f"SELECT DISTINCT path_template, {_NORM.format('path_template')} AS normalized, {_NORM.format("replace(path_template, '{}', ':id') || '/'")} AS from_colon FROM http_flow_edge")
def path_normalize(spark, d):
    raw = F.concat(F.regexp_replace("path_template", r"\{\}", ":id"), F.lit("/"))
    return t(spark, d, "http_flow_edge").select("path_template", fn.normalize_path(F.col("path_template")).alias("normalized"), fn.normalize_path(raw).alias("from_colon")).distinct()


@query(
    "module_fqn",
    r"""SELECT DISTINCT repo_relative_path, replace(regexp_replace(regexp_replace(regexp_replace(repo_relative_path, '^(?:(?:src|lib)/)+', ''), '\.(?:pyi?|tsx?|mts|cts|jsx?|mjs|cjs)$', ''), CASE WHEN l = 'python' THEN '(?:^|/)__init__$' ELSE '(?:^|/)index$' END, ''), '/', '.') AS fqn FROM (SELECT repo_relative_path, coalesce(lang, CASE WHEN regexp_matches(repo_relative_path, '\.pyi?$') THEN 'python' WHEN regexp_matches(repo_relative_path, '\.[cm]?[jt]sx?$') THEN 'script' END) AS l FROM file_record) WHERE l IS NOT NULL""",
)
def module_fqn(spark, d):
    lang = fn.language_of(F.col("lang"), F.col("repo_relative_path"))
    return t(spark, d, "file_record").where(lang.isNotNull()).select("repo_relative_path", fn.module_fqn(F.col("repo_relative_path"), lang).alias("fqn")).distinct()


@query("stable_id", "SELECT flow_id, 'httpc_' || substr(sha256(workspace_id || chr(31) || coalesce(client_repo, 'None') || chr(31) || coalesce(client_caller_fqn, 'None') || chr(31) || coalesce(path_template, 'None')), 1, 24) AS id FROM (SELECT DISTINCT flow_id, workspace_id, client_repo, client_caller_fqn, path_template FROM http_flow_edge)")
def stable_id(spark, d):
    rows = t(spark, d, "http_flow_edge").select("flow_id", "workspace_id", "client_repo", "client_caller_fqn", "path_template").distinct()
    return rows.select("flow_id", fn.stable_id("httpc", *[F.col(c) for c in rows.columns[1:]]).alias("id"))


@query("file_hash", "SELECT file_id, sha256(text) AS hash, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM source_text")
def file_hash(spark, d):
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return t(spark, d, "source_text").select("file_id", F.sha2("text", 256).alias("hash"), lines.cast("bigint").alias("lines"))


_SYMBOL_ONCE = "(SELECT symbol_id, any_value(file_id) AS file_id, any_value(start_line) AS a, any_value(end_line) AS b FROM symbol_def WHERE start_line IS NOT NULL AND end_line IS NOT NULL GROUP BY 1)"


@query("snippet", f"SELECT symbol_id, array_to_string(list_slice(string_split_regex(text, '\\r\\n|\\r|\\n'), a, b), chr(10)) AS code FROM {_SYMBOL_ONCE} JOIN source_text USING (file_id)")
def snippet(spark, d):
    spans = t(spark, d, "symbol_def").where("start_line IS NOT NULL AND end_line IS NOT NULL").groupBy("symbol_id").agg(F.min(F.struct("file_id", "start_line", "end_line")).alias("s")).select("symbol_id", "s.*")
    return spans.join(t(spark, d, "source_text"), "file_id").select("symbol_id", fn.snippet(F.col("text"), F.col("start_line"), F.col("end_line")).alias("code"))


# ---- resolution ---------------------------------------------------------------------------------


def _call_sites(spark, d):
    """Call sites with the text that led to a resolved call: its simple name, or with the part before it."""
    calls = t(spark, d, "resolved_call").select("call_id", "workspace_id", F.col("caller_repo").alias("repo"), "file_path", "caller_fqn", "callee_fqn", "call_site_line").distinct()
    callee = F.when(F.coalesce("callee_fqn", F.lit("")) == "", F.concat(F.lit("unknown_"), F.col("call_id"))).otherwise(F.col("callee_fqn"))
    return calls.withColumn("call_text", F.when(F.col("call_site_line") % 3 == 0, F.substring_index(callee, ".", -2)).otherwise(F.substring_index(callee, ".", -1)))


_RESOLVE = r"""
c0 AS (SELECT DISTINCT call_id, workspace_id, caller_repo AS repo, file_path, caller_fqn, call_site_line, CASE WHEN coalesce(callee_fqn, '') = '' THEN 'unknown_' || call_id ELSE callee_fqn END AS callee FROM resolved_call),
c1 AS (SELECT *, CASE WHEN call_site_line % 3 = 0 THEN regexp_extract(callee, '([^.]+\.)?[^.]*$') ELSE regexp_extract(callee, '[^.]*$') END AS call_text FROM c0 WHERE caller_fqn IS NOT NULL),
c AS (SELECT *, regexp_extract(call_text, '[^.]*$') AS simple, split_part(call_text, '.', 1) AS head, contains(call_text, '.') AS dotted FROM c1),
s AS (SELECT workspace_id, repo, fqn, min(name) AS name FROM symbol_def WHERE workspace_id IS NOT NULL AND repo IS NOT NULL AND fqn IS NOT NULL GROUP BY ALL),
m AS (SELECT workspace_id, repo, file_path, local_name, arg_max(target_fqn, {'a': seq, 'b': target_fqn}) AS target FROM import_ref WHERE local_name IS NOT NULL AND local_name NOT IN ('', '*') GROUP BY ALL),
h1 AS (SELECT call_id, 1 AS rank, s.repo <> c.repo AS away, s.repo, s.fqn, 'same-module' AS strategy FROM c JOIN s ON s.workspace_id = c.workspace_id AND s.fqn = regexp_replace(caller_fqn, '\.[^.]*$', '') || '.' || call_text WHERE NOT dotted AND contains(caller_fqn, '.')),
h2 AS (SELECT call_id, 2, s.repo <> c.repo, s.repo, s.fqn, 'import-suffix' FROM c JOIN m ON m.workspace_id = c.workspace_id AND m.repo = c.repo AND m.file_path = c.file_path AND m.local_name = c.head
  JOIN s ON s.workspace_id = c.workspace_id AND s.fqn = CASE WHEN dotted THEN target || '.' || substr(call_text, instr(call_text, '.') + 1) ELSE target END),
n AS (SELECT workspace_id, name, count(*) AS n, min({'r': repo, 'f': fqn}) AS o FROM s GROUP BY ALL),
h3 AS (SELECT call_id, 3, false, o.r, o.f, 'unique-global' FROM c JOIN n ON n.workspace_id = c.workspace_id AND n.name = c.simple WHERE n.n = 1),
d AS (SELECT DISTINCT c.workspace_id, caller_fqn, simple FROM c JOIN n ON n.workspace_id = c.workspace_id AND n.name = c.simple WHERE n.n > 1 ),
p AS (SELECT d.*, s.repo, s.fqn, string_split(s.fqn, '.') AS a, string_split(caller_fqn, '.') AS b FROM d JOIN s ON s.workspace_id = d.workspace_id AND s.name = d.simple AND split_part(s.fqn, '.', 1) = split_part(caller_fqn, '.', 1)),
q AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS shared FROM p),
r AS (SELECT workspace_id, caller_fqn, simple, min({'x': -shared, 'y': len(a), 'r': repo, 'f': fqn}) AS o FROM q GROUP BY ALL),
h4 AS (SELECT call_id, 4, false, o.r, o.f, 'suffix-distance' FROM c JOIN r ON r.workspace_id = c.workspace_id AND r.caller_fqn = c.caller_fqn AND r.simple = c.simple),
e AS (SELECT DISTINCT c.workspace_id, call_text, s.repo, s.fqn FROM c JOIN s ON s.workspace_id = c.workspace_id AND s.name = c.simple AND (s.fqn = call_text OR s.fqn LIKE '%.' || call_text) WHERE dotted),
u AS (SELECT workspace_id, call_text, min({'r': repo, 'f': fqn}) AS o FROM e GROUP BY ALL HAVING count(*) = 1),
h5 AS (SELECT call_id, 5, false, o.r, o.f, 'syntactic-fallback' FROM c JOIN u ON u.workspace_id = c.workspace_id AND u.call_text = c.call_text),
h AS (SELECT call_id, min({'rank': rank, 'away': away, 'repo': repo, 'fqn': fqn, 'strategy': strategy}) AS h FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4 UNION ALL SELECT * FROM h5) GROUP BY call_id),
resolved AS (SELECT call_id, h.repo AS callee_repo, h.fqn AS callee_fqn, h.strategy AS strategy, CASE h.rank WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.85::DOUBLE WHEN 4 THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM h)"""


def _resolved(spark, d):
    return resolve.resolve(_call_sites(spark, d), t(spark, d, "import_ref"), t(spark, d, "symbol_def"))


@query("resolve_cascade", f"WITH {_RESOLVE} SELECT * FROM resolved")
def resolve_cascade(spark, d):
    return _resolved(spark, d)


@query("strategy_counter", f"WITH {_RESOLVE} SELECT coalesce(strategy, 'unresolved') AS strategy, count(*) AS n FROM c LEFT JOIN resolved USING (call_id) GROUP BY 1")
def strategy_counter(spark, d):
    sites = _call_sites(spark, d).where("caller_fqn IS NOT NULL").select("call_id")
    joined = sites.join(_resolved(spark, d).select("call_id", "strategy"), "call_id", "left")
    return joined.groupBy(F.coalesce("strategy", F.lit("unresolved")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "resolve_imports",
    """WITH s AS (SELECT DISTINCT workspace_id, repo, fqn FROM symbol_def WHERE fqn IS NOT NULL AND repo IS NOT NULL), i AS (SELECT DISTINCT import_id, workspace_id, repo, target_fqn FROM import_ref),
j AS (SELECT import_id, min(CASE WHEN s.fqn IS NOT NULL THEN {'away': s.repo <> i.repo, 'r': s.repo, 'f': s.fqn} END) AS b FROM i LEFT JOIN s ON s.workspace_id = i.workspace_id AND s.fqn = i.target_fqn GROUP BY 1)
SELECT import_id, b.r AS resolved_repo, b.f AS resolved_fqn FROM j""",
)
def resolve_imports(spark, d):
    return resolve.resolve_imports(t(spark, d, "import_ref"), t(spark, d, "symbol_def"))


_EDGES = """s AS (SELECT DISTINCT workspace_id, repo, fqn FROM symbol_def WHERE fqn IS NOT NULL AND repo IS NOT NULL AND workspace_id IS NOT NULL),
e AS (SELECT workspace_id, caller_repo, caller_fqn, callee_repo, callee_fqn, file_path, call_site_line, min(call_id) AS edge_id,
  arg_max({'c': confidence, 's': strategy}, {'a': arrived_at, 'i': call_id}) AS v FROM resolved_call WHERE callee_fqn IS NOT NULL AND callee_fqn <> ''
  AND (workspace_id, caller_repo, caller_fqn) IN (SELECT (workspace_id, repo, fqn) FROM s) AND (workspace_id, callee_repo, callee_fqn) IN (SELECT (workspace_id, repo, fqn) FROM s)
  GROUP BY ALL),
edges AS (SELECT edge_id, workspace_id, caller_repo, caller_fqn, callee_repo, callee_fqn, file_path, call_site_line, v.c AS confidence, v.s AS strategy FROM e)"""


def _edges(spark, d):
    return resolve.call_edges(t(spark, d, "resolved_call"), t(spark, d, "symbol_def"))


@query("call_edges", f"WITH {_EDGES} SELECT * FROM edges")
def call_edges(spark, d):
    return _edges(spark, d)


def _targets(spark, d, edges, side):
    """Every symbol whose id is divisible by 50, and the one with most edges on that side."""
    every = t(spark, d, "symbol_def").where("symbol_id % 50 = 0").select(*traverse.NODE).dropna()
    node = [F.col(c).alias(n) for c, n in zip(("workspace_id", f"{side}_repo", f"{side}_fqn"), traverse.NODE, strict=True)]
    hot = edges.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *traverse.NODE).limit(1)
    return staged(every.unionByName(hot.select(*traverse.NODE)).distinct(), "targets")


def _tg(side: str) -> str:
    return f"""tg AS (SELECT DISTINCT workspace_id, repo, fqn FROM symbol_def WHERE symbol_id % 50 = 0 AND workspace_id IS NOT NULL AND repo IS NOT NULL AND fqn IS NOT NULL
  UNION SELECT * EXCLUDE (n) FROM (SELECT workspace_id, {side}_repo AS repo, {side}_fqn AS fqn, count(*) AS n FROM edges GROUP BY ALL ORDER BY n DESC, workspace_id, repo, fqn LIMIT 1))"""


def _trail_sql(near: str, far: str) -> str:
    return f"""WITH {_EDGES}, {_tg(near)},
a AS (SELECT tg.repo AS target_repo, tg.fqn AS target_fqn, e.workspace_id, e.{far}_repo AS repo, e.{far}_fqn AS fqn, 1 AS hops, least(1.0, coalesce(confidence, 1.0))::DOUBLE AS min_confidence, edge_id AS e1
  FROM tg JOIN edges e ON e.workspace_id = tg.workspace_id AND e.{near}_repo = tg.repo AND e.{near}_fqn = tg.fqn),
b AS (SELECT a.target_repo, a.target_fqn, e.workspace_id, e.{far}_repo AS repo, e.{far}_fqn AS fqn, 2 AS hops, least(a.min_confidence, coalesce(confidence, 1.0))::DOUBLE AS min_confidence, e1, edge_id AS e2
  FROM a JOIN edges e ON e.workspace_id = a.workspace_id AND e.{near}_repo = a.repo AND e.{near}_fqn = a.fqn WHERE edge_id <> e1),
g AS (SELECT b.target_repo, b.target_fqn, e.workspace_id, e.{far}_repo AS repo, e.{far}_fqn AS fqn, 3 AS hops, least(b.min_confidence, coalesce(confidence, 1.0))::DOUBLE AS min_confidence
  FROM b JOIN edges e ON e.workspace_id = b.workspace_id AND e.{near}_repo = b.repo AND e.{near}_fqn = b.fqn WHERE edge_id <> e1 AND edge_id <> e2)
SELECT DISTINCT * EXCLUDE (e1) FROM a UNION SELECT DISTINCT * EXCLUDE (e1, e2) FROM b UNION SELECT DISTINCT * FROM g"""


@query("call_graph_callers", _trail_sql("callee", "caller"))
def call_graph_callers(spark, d):
    edges = staged(_edges(spark, d), "edges")
    return traverse.trails(edges, _targets(spark, d, edges, "callee"), 3, upstream=True)


@query("call_graph_callees", _trail_sql("caller", "callee"))
def call_graph_callees(spark, d):
    edges = staged(_edges(spark, d), "edges")
    return traverse.trails(edges, _targets(spark, d, edges, "caller"), 3, upstream=False)


def _messages(spark, d):
    """Producers and consumers: functions that publish or dispatch something, and those that drain or claim it."""
    rows = t(spark, d, "symbol_def").where("workspace_id IS NOT NULL AND repo IS NOT NULL AND fqn IS NOT NULL")
    rows = rows.select("symbol_id", "workspace_id", "repo", F.col("fqn").alias("caller_fqn"), "name", F.lower(F.regexp_extract("name", "([A-Z]?[a-z]+)$", 1)).alias("topic_name")).where("topic_name <> ''").distinct()
    return rows.where(F.col("name").rlike("^(?:publish|dispatch)")).withColumnRenamed("symbol_id", "producer_id"), rows.where(F.col("name").rlike("^(?:drain|claim)")).withColumnRenamed("symbol_id", "consumer_id")


_MESSAGES = """ms AS (SELECT DISTINCT symbol_id, workspace_id, repo, fqn AS caller_fqn, name, lower(regexp_extract(name, '([A-Z]?[a-z]+)$', 1)) AS topic_name FROM symbol_def WHERE workspace_id IS NOT NULL AND repo IS NOT NULL AND fqn IS NOT NULL AND regexp_matches(name, '[a-z]$')),
mp AS (SELECT * FROM ms WHERE regexp_matches(name, '^(?:publish|dispatch)')), mc AS (SELECT * FROM ms WHERE regexp_matches(name, '^(?:drain|claim)'))"""
_HTTP = "http AS (SELECT workspace_id, client_caller_fqn, client_repo, route_handler_fqn, route_repo, method, path_template, max(match_score) AS match_score FROM http_flow_edge GROUP BY ALL)"


@query(
    "impact_analysis",
    f"""WITH RECURSIVE {_EDGES}, {_HTTP}, {_MESSAGES}, {_tg("callee")},
t0 AS (SELECT workspace_id, repo AS target_repo, fqn AS target_fqn FROM tg),
up AS (SELECT *, target_repo AS repo, target_fqn AS fqn, 0 AS n FROM t0 UNION SELECT up.workspace_id, target_repo, target_fqn, e.caller_repo, e.caller_fqn, n + 1 FROM up JOIN edges e ON e.workspace_id = up.workspace_id AND e.callee_repo = up.repo AND e.callee_fqn = up.fqn WHERE n < 5),
down AS (SELECT *, target_repo AS repo, target_fqn AS fqn, 0 AS n FROM t0 UNION SELECT down.workspace_id, target_repo, target_fqn, e.callee_repo, e.callee_fqn, n + 1 FROM down JOIN edges e ON e.workspace_id = down.workspace_id AND e.caller_repo = down.repo AND e.caller_fqn = down.fqn WHERE n < 3)
SELECT workspace_id, target_repo, target_fqn, 'upstream_symbol' AS kind, repo, fqn, '' AS detail FROM up WHERE n > 0
UNION SELECT down.workspace_id, target_repo, target_fqn, 'handled_route', down.repo, down.fqn, concat_ws(' ', method, path_template) FROM down JOIN http ON http.workspace_id = down.workspace_id AND http.route_repo = down.repo AND http.route_handler_fqn = down.fqn
UNION SELECT up.workspace_id, target_repo, target_fqn, 'http_inbound', client_repo, client_caller_fqn, concat_ws(' ', method, path_template) FROM up JOIN http ON http.workspace_id = up.workspace_id AND http.route_repo = up.repo AND http.route_handler_fqn = up.fqn
UNION SELECT up.workspace_id, target_repo, target_fqn, 'kafka_inbound', mp.repo, mp.caller_fqn, mp.topic_name FROM up JOIN mp ON mp.workspace_id = up.workspace_id AND mp.repo = up.repo AND mp.caller_fqn = up.fqn""",
)
def impact_analysis(spark, d):
    edges = staged(_edges(spark, d), "edges")
    return traverse.impact(edges, t(spark, d, "http_flow_edge"), _targets(spark, d, edges, "callee"), producers=_messages(spark, d)[0])


def _trace_sql(where: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, {_HTTP},
ht AS (SELECT * FROM http WHERE workspace_id IS NOT NULL AND route_repo IS NOT NULL AND method IS NOT NULL AND path_template IS NOT NULL {where}),
h AS (SELECT DISTINCT workspace_id, route_repo, method, path_template, route_handler_fqn AS handler FROM ht WHERE route_handler_fqn IS NOT NULL AND route_handler_fqn <> ''),
st AS (SELECT DISTINCT workspace_id, route_repo AS target_repo, handler AS target_fqn FROM h),
down AS (SELECT workspace_id, target_repo, target_fqn, target_repo AS repo, target_fqn AS fqn, 0 AS n FROM st
  UNION SELECT e.workspace_id, target_repo, target_fqn, e.callee_repo, e.callee_fqn, n + 1 FROM down JOIN edges e ON e.workspace_id = down.workspace_id AND e.caller_repo = down.repo AND e.caller_fqn = down.fqn WHERE n < 3),
x AS (SELECT workspace_id, route_repo, method, path_template, 'handler' AS role, route_repo AS repo, handler AS fqn, NULL::DOUBLE AS match_score FROM h
  UNION ALL SELECT workspace_id, route_repo, method, path_template, 'caller', client_repo, client_caller_fqn, max(match_score) FROM ht WHERE client_caller_fqn IS NOT NULL GROUP BY ALL
  UNION ALL SELECT DISTINCT h.workspace_id, h.route_repo, h.method, h.path_template, 'downstream', down.repo, down.fqn, NULL::DOUBLE FROM h JOIN down ON down.workspace_id = h.workspace_id AND down.target_repo = h.route_repo AND down.target_fqn = h.handler WHERE n > 0),
k AS (SELECT DISTINCT workspace_id, route_repo, method, path_template FROM ht)
SELECT k.*, role, repo, fqn, match_score FROM k LEFT JOIN x USING (workspace_id, route_repo, method, path_template)"""


def _routes(spark, d):
    return t(spark, d, "http_flow_edge").where("workspace_id IS NOT NULL AND route_repo IS NOT NULL AND method IS NOT NULL AND path_template IS NOT NULL")


@query("trace_http_flow", _trace_sql(""))
def trace_http_flow(spark, d):
    return traverse.trace_http(_routes(spark, d), staged(_edges(spark, d), "edges"))


_ROUTE = "SELECT workspace_id, path_template, count(*) AS n FROM http_flow_edge WHERE workspace_id IS NOT NULL AND route_repo IS NOT NULL AND method IS NOT NULL GROUP BY ALL ORDER BY n DESC, workspace_id, path_template LIMIT 1"


@query("trace_http_route", _trace_sql(f"AND method IN ('GET', '*') AND (workspace_id, path_template) = (SELECT (workspace_id, path_template) FROM ({_ROUTE}))"))
def trace_http_route(spark, d):
    """The flows of one route, by GET: the one with most flows."""
    routes = _routes(spark, d)
    hot = routes.groupBy("workspace_id", "path_template").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "workspace_id", "path_template").first()
    workspace, path = (hot["workspace_id"], hot["path_template"]) if hot else ("", "")
    return traverse.trace_http(routes, staged(_edges(spark, d), "edges"), 3, workspace, "GET", path)


@query("trace_topic", f"WITH {_MESSAGES} SELECT workspace_id, topic_name, 'producer' AS role, repo, caller_fqn FROM mp UNION SELECT workspace_id, topic_name, 'consumer', repo, caller_fqn FROM mc")
def trace_topic(spark, d):
    return traverse.trace_topic(*_messages(spark, d))


# ---- flows --------------------------------------------------------------------------------------


@query(
    "http_flow_match",
    """WITH c AS (SELECT DISTINCT flow_id AS call_id, workspace_id, CASE WHEN method = '*' THEN 'GET' ELSE method END AS method, replace(path_template, '{}', (flow_id % 7)::VARCHAR) AS path FROM http_flow_edge),
r AS (SELECT workspace_id, method, path_template AS path, min(flow_id) AS route_id FROM http_flow_edge GROUP BY ALL),
j AS (SELECT call_id, route_id, list_filter(string_split(c.path, '/'), lambda s: s <> '') AS a, list_filter(string_split(r.path, '/'), lambda s: s <> '') AS b, c.path = r.path AS same
  FROM c JOIN r ON c.workspace_id = r.workspace_id AND (c.method = r.method OR r.method = '*' OR c.method = '*')),
k AS (SELECT call_id, route_id, CASE WHEN same OR len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i] OR a[i] = '{}' OR b[i] = '{}'))::DOUBLE / len(a) END AS score FROM j WHERE len(a) = len(b)),
m AS (SELECT *, max(score) OVER (PARTITION BY call_id) AS best FROM k WHERE score >= 0.7)
SELECT call_id, route_id, round(score, 4) AS match_score FROM m WHERE score = best""",
)
def http_flow_match(spark, d):
    edges = t(spark, d, "http_flow_edge")
    method = F.when(F.col("method") == "*", "GET").otherwise(F.col("method"))
    path = F.regexp_replace("path_template", r"\{\}", (F.col("flow_id") % 7).cast("string"))
    clients = edges.select(F.col("flow_id").alias("call_id"), "workspace_id", method.alias("method"), path.alias("path")).distinct()
    routes = edges.groupBy("workspace_id", "method", F.col("path_template").alias("path")).agg(F.min("flow_id").alias("route_id"))
    return flows.http_flows(clients, routes)


@query("topic_flow_match", f"WITH {_MESSAGES} SELECT DISTINCT mp.symbol_id AS producer_id, mc.symbol_id AS consumer_id, topic_name FROM mp JOIN mc USING (workspace_id, topic_name)")
def topic_flow_match(spark, d):
    return flows.topic_flows(*_messages(spark, d))


@query("topic_counts", f"WITH {_MESSAGES} SELECT repo, count(DISTINCT topic_name) AS topics FROM (SELECT repo, topic_name FROM mp UNION ALL SELECT repo, topic_name FROM mc) GROUP BY 1")
def topic_counts(spark, d):
    return flows.topic_counts(*_messages(spark, d))


# ---- search -------------------------------------------------------------------------------------

_WORDS = r"'[\p{L}\p{N}_]+'"
_SR = "sr AS (SELECT workspace_id, repo, fqn, min({'i': symbol_id, 'n': name, 's': signature, 'd': docstring}) AS s, min({'i': symbol_id, 'p': file_path, 'a': start_line, 'e': end_line, 'k': kind}) AS p FROM symbol_def WHERE fqn IS NOT NULL GROUP BY ALL)"
_WANTED = f"""wt AS (SELECT symbol_id AS lookup_id, min({{'w': workspace_id, 'f': fqn, 'n': name, 'd': docstring}}) AS s FROM symbol_def WHERE symbol_id % 50 = 0 AND workspace_id IS NOT NULL GROUP BY 1),
wd AS (SELECT lookup_id, s.w AS w, s.f AS f, s.n AS n, array_to_string(list_slice(regexp_extract_all(lower(coalesce(s.d, '')), {_WORDS}), 1, 3), ' ') AS d FROM wt)"""
_PLACE = "workspace_id, repo, fqn, p.p AS file_path, p.a AS start_line, p.e AS end_line, p.k AS kind"


def _mode_sql(mode: str, wanted: str) -> str:
    """The lookups of one mode as the table `mode`, for the names in `wanted` (lookup_id, w, name)."""
    if mode == "exact":
        hits = f"SELECT lookup_id, {_PLACE}, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY lookup_id ORDER BY repo, workspace_id) AS r FROM {wanted} q JOIN sr ON sr.workspace_id = q.w AND sr.fqn = q.name WHERE name <> ''"
    elif mode == "suffix":
        hits = f"SELECT lookup_id, {_PLACE}, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY lookup_id ORDER BY length(fqn), fqn, repo, workspace_id) AS r FROM {wanted} q JOIN sr ON sr.workspace_id = q.w AND ends_with(sr.fqn, q.name) WHERE length(name) >= 3"
    else:
        return f"""sd AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', coalesce(s.n, ''), coalesce(s.s, ''), coalesce(s.d, ''))), {_WORDS}) AS words FROM sr),
sst AS (SELECT count(*) AS docs, avg(len(words)) AS length FROM sd),
sdf AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM sd) GROUP BY 1),
ph AS (SELECT lookup_id, w, regexp_extract_all(lower(name), {_WORDS}) AS ps FROM {wanted} WHERE name <> ''),
pi AS (SELECT lookup_id, sum(ln(1e0 + (docs - df + 0.5e0) / (df + 0.5e0))) AS idf FROM (SELECT lookup_id, unnest(ps) AS term FROM ph) JOIN sdf USING (term), sst GROUP BY 1),
fz AS (SELECT lookup_id, {_PLACE}, len(words) AS n, len(list_filter(range(1, len(words) - len(ps) + 2), lambda i: words[i:i + len(ps) - 1] = ps)) AS tf FROM ph JOIN sd ON sd.workspace_id = ph.w WHERE len(ps) > 0),
fs AS (SELECT fz.* EXCLUDE (n, tf), round(idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n / length)), 4) AS score FROM fz JOIN pi USING (lookup_id), sst WHERE tf > 0),
fuzzy AS (SELECT * EXCLUDE (r), 'fuzzy' AS match_mode FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY score DESC, workspace_id, repo, fqn) AS r FROM fs) WHERE r <= 10)"""
    return f"{mode} AS (SELECT * EXCLUDE (r), '{mode}' AS match_mode FROM ({hits}) WHERE r <= 10)"


def _wanted(spark, d, name: str):
    """Lookups from every symbol whose id is divisible by 50: by its full name, its simple name, or the first three words of its
    documentation; `mixed` takes turns."""
    rows = t(spark, d, "symbol_def").where("symbol_id % 50 = 0 AND workspace_id IS NOT NULL").groupBy(F.col("symbol_id").alias("lookup_id")).agg(F.min(F.struct("workspace_id", "fqn", "name", "docstring")).alias("s"))
    words = F.array_join(F.slice(fn.tokens(F.coalesce("s.docstring", F.lit(""))), 1, 3), " ")
    turn = F.when(F.col("lookup_id") % 150 == 0, F.col("s.fqn")).when(F.col("lookup_id") % 150 == 50, F.col("s.name")).otherwise(words)
    return rows.select("lookup_id", "s.workspace_id", {"full": F.col("s.fqn"), "simple": F.col("s.name"), "words": words, "mixed": turn}[name].alias("name"))


def _symbol_index(spark, d):
    return search.kept_index(spark, f"{d}/symbol_def.parquet", "symbols", search.SYMBOL, lambda folder: search.symbol_index(t(spark, d, "symbol_def"), folder))


def _lookup(mode: str, name: str):
    def run(spark, d):
        index = _symbol_index(spark, d) if mode in ("fuzzy", "auto") else None
        return search.lookup(t(spark, d, "symbol_def"), _wanted(spark, d, name), mode, 10, index)

    return run


for _mode, _name, _column in (("exact", "full", "f"), ("suffix", "simple", "n"), ("fuzzy", "words", "d")):
    QUERIES[f"symbol_{_mode}"] = _lookup(_mode, _name)
    SQL[f"symbol_{_mode}"] = f"WITH {_SR}, {_WANTED}, q0 AS (SELECT lookup_id, w, {_column} AS name FROM wd), {_mode_sql(_mode, 'q0')} SELECT * FROM {_mode}"
QUERIES["symbol_auto"] = _lookup("auto", "mixed")
SQL["symbol_auto"] = f"""WITH {_SR}, {_WANTED}, q0 AS (SELECT lookup_id, w, CASE lookup_id % 150 WHEN 0 THEN f WHEN 50 THEN n ELSE d END AS name FROM wd), {_mode_sql("exact", "q0")},
q1 AS (SELECT * FROM q0 WHERE lookup_id NOT IN (SELECT lookup_id FROM exact)), {_mode_sql("suffix", "q1")},
q2 AS (SELECT * FROM q1 WHERE lookup_id NOT IN (SELECT lookup_id FROM suffix)), {_mode_sql("fuzzy", "q2")}
SELECT * FROM exact UNION ALL SELECT * FROM suffix UNION ALL SELECT * FROM fuzzy"""

_BM25 = rf"""
qs AS (SELECT query_id, min(workspace_id) AS w, min(query_text) AS t FROM search_hit WHERE query_id % 50 = 0 GROUP BY 1),
n AS (SELECT doc_id, workspace_id, regexp_extract_all(lower(coalesce(text, '')), {_WORDS}) AS words, len(regexp_extract_all(lower(coalesce(text, '')), {_WORDS})) AS n FROM documents), st AS (SELECT count(*) AS docs, avg(n) AS length FROM n),
tm AS (SELECT DISTINCT query_id, w, unnest(regexp_extract_all(lower(t), {_WORDS})) AS term FROM qs),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM n) GROUP BY 1),
tf AS (SELECT query_id, doc_id, n, term, len(list_filter(words, lambda x: x = term)) AS tf FROM tm JOIN n ON n.workspace_id = tm.w OR tm.w IS NULL),
sc AS (SELECT query_id, doc_id, round(sum(ln(1e0 + (docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n / length))), 6) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY 1, 2),
lex AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 30)"""
_VEC = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, vec_id AS doc_id, round((1 + list_dot_product(embedding::DOUBLE[], e) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e, e)))) / 2, 6) AS score FROM embeddings, q),
vec AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM vs) WHERE r <= 30)"""


def _asked(spark, d):
    return t(spark, d, "search_hit").where("query_id % 50 = 0").groupBy("query_id").agg(F.min("workspace_id").alias("workspace_id"), F.min("query_text").alias("text"))


def _lexical(spark, d):
    def build(folder):
        return search.LexicalIndex.build(t(spark, d, "documents"), ["doc_id"], F.col("text"), folder, "workspace_id")

    return search.kept_index(spark, f"{d}/documents.parquet", "documents", ["doc_id"], build).search(_asked(spark, d), 30)


def _vector(spark, d):
    vectors = t(spark, d, "embeddings")
    wanted = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_topk(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", wanted, 30)


@query("lexical_bm25", f"WITH {_BM25} SELECT * FROM lex")
def lexical_bm25(spark, d):
    return _lexical(spark, d)


@query("vector_topk", f"WITH {_VEC} SELECT * FROM vec")
def vector_topk(spark, d):
    return _vector(spark, d)


@query(
    "hybrid_rrf",
    f"""WITH {_BM25}, {_VEC},
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, 'lexical' AS source FROM lex UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id), 'vector' FROM vec),
f AS (SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 6) AS rrf_score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r GROUP BY 1, 2)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS r FROM f) WHERE r <= 10""",
)
def hybrid_rrf(spark, d):
    return search.fuse({"lexical": _lexical(spark, d), "vector": _vector(spark, d)}, "doc_id", 10, by=["query_id"])


@query("code_search")
def code_search(spark, d):
    """Symbols and chunks for every query whose id is divisible by 50; its vector comes from the provider."""
    embed = lambda df: chunking.embed(df, "text", dim=64, provider=lambda texts: [chunking.hash_embedding(x, 64) for x in texts]).withColumnRenamed("embedding", "vector")
    return search.code_search(_symbol_index(spark, d), t(spark, d, "symbol_def"), t(spark, d, "chunk"), _asked(spark, d), embed)


@query("postings", r"SELECT term, symbol_id, count(*) AS tf, any_value(n) AS doc_length FROM (SELECT symbol_id, unnest(words) AS term, len(words) AS n FROM (SELECT symbol_id, regexp_extract_all(lower(any_value(docstring)), '[\p{L}\p{N}_]+') AS words FROM symbol_def WHERE docstring IS NOT NULL GROUP BY symbol_id)) GROUP BY 1, 2")
def postings(spark, d):
    docs = t(spark, d, "symbol_def").where("docstring IS NOT NULL").groupBy("symbol_id").agg(F.min("docstring").alias("docstring"))
    return search.postings(docs, "symbol_id", "docstring")


# ---- chunks, diffs, upserts -----------------------------------------------------------------------


@query(
    "chunk_lines",
    """WITH l AS (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS lines FROM documents WHERE text <> ''),
s AS (SELECT doc_id, lines, len(lines) AS n, unnest(range(1, greatest(len(lines) - 2, 1) + 1, 8)) AS a FROM l)
SELECT doc_id, a AS start_line, least(a + 9, n) AS end_line, array_to_string(lines[a:least(a + 9, n)], chr(10)) AS text FROM s""",
)
def chunk_lines(spark, d):
    return chunking.chunk_lines(t(spark, d, "documents"), "doc_id", "text", 10, 2)


@query("chunk_files")
def chunk_files(spark, d):
    return chunking.chunk_files(t(spark, d, "file_record"), t(spark, d, "source_text"), t(spark, d, "symbol_def"))


@query("embed_chunks")
def embed_chunks(spark, d):
    return chunking.embed(t(spark, d, "chunk").select("chunk_id", "text").dropDuplicates(["chunk_id"]))


_STATES = """
old AS (SELECT workspace_id, repo, repo_relative_path AS path, arg_max(hash_blake3, indexed_at) AS hash FROM file_record WHERE workspace_id IS NOT NULL AND repo IS NOT NULL AND repo_relative_path IS NOT NULL GROUP BY ALL),
en AS (SELECT workspace_id, repo_name AS repo, p AS path, observed_at, diff_id, new_hashes[p] AS hash FROM (SELECT *, unnest(changed_paths) AS p FROM file_diff) UNION ALL SELECT workspace_id, repo_name, unnest(deleted_paths), observed_at, diff_id, NULL FROM file_diff),
la AS (SELECT workspace_id, repo, path, max({'o': observed_at, 'd': diff_id, 'h': hash}) AS st FROM en GROUP BY ALL),
new AS (SELECT workspace_id, repo, path, st.h AS hash FROM la WHERE st.h IS NOT NULL)"""


def _states(spark, d):
    from quillgraph.operators import change_capture

    old = t(spark, d, "file_record").dropna(subset=["workspace_id", "repo", "repo_relative_path"]).groupBy("workspace_id", "repo", F.col("repo_relative_path").alias("path")).agg(F.max_by("hash_blake3", "indexed_at").alias("hash"))
    entries = change_capture.log_entries(t(spark, d, "file_diff").dropna(subset=["workspace_id", "repo_name", "observed_at"]))
    last = entries.groupBy("workspace_id", F.col("repo_name").alias("repo"), "path").agg(F.max(F.struct("offset", "hash")).alias("s"))
    return old, last.select("workspace_id", "repo", "path", F.col("s.hash").alias("hash")).where("hash IS NOT NULL")


@query("file_diff", f"WITH {_STATES} SELECT workspace_id, repo, path, CASE WHEN new.hash IS NULL THEN 'deleted' WHEN coalesce(old.hash, '') = '' OR old.hash <> new.hash THEN 'changed' ELSE 'unchanged' END AS state FROM old FULL JOIN new USING (workspace_id, repo, path)")
def file_diff(spark, d):
    old, new = _states(spark, d)
    return incremental.file_diff(old, new, ["workspace_id", "repo", "path"], "hash")


@query(
    "delta_merge",
    f"""WITH {_STATES}, df AS (SELECT workspace_id, repo, path, CASE WHEN new.hash IS NULL THEN 'deleted' WHEN coalesce(old.hash, '') = '' OR old.hash <> new.hash THEN 'changed' ELSE 'unchanged' END AS state FROM old FULL JOIN new USING (workspace_id, repo, path))
SELECT workspace_id, repo, path, hash FROM old JOIN df USING (workspace_id, repo, path) WHERE state = 'unchanged' UNION ALL SELECT workspace_id, repo, path, hash FROM new JOIN df USING (workspace_id, repo, path) WHERE state = 'changed'""",
)
def delta_merge(spark, d):
    old, new = _states(spark, d)
    key = ["workspace_id", "repo", "path"]
    touched = incremental.file_diff(old, new, key, "hash").where("state <> 'unchanged'")
    return incremental.delta_merge(old, new.join(touched.where("state = 'changed'"), key, "left_semi"), touched, key)


@query("upsert_symbols", "SELECT workspace_id, repo, fqn, symbol_id, signature FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, repo, fqn ORDER BY indexed_at DESC NULLS LAST, symbol_id DESC) AS r FROM (SELECT DISTINCT workspace_id, repo, fqn, symbol_id, signature, indexed_at FROM symbol_def)) WHERE r = 1")
def upsert_symbols(spark, d):
    rows = t(spark, d, "symbol_def").select("workspace_id", "repo", "fqn", "symbol_id", "signature", "indexed_at").distinct()
    return resolve.last_of_each(rows, ["workspace_id", "repo", "fqn"], ["indexed_at", "symbol_id"]).drop("indexed_at")


# ---- catalog ------------------------------------------------------------------------------------


@query("workspace_list", "SELECT workspace_id, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM file_record WHERE workspace_id IS NOT NULL GROUP BY 1")
def workspace_list(spark, d):
    return catalog.workspaces(t(spark, d, "file_record"))


def _labels(spark, d):
    """label -> (rows, key) of what a data folder holds."""
    files, flows_ = t(spark, d, "file_record"), t(spark, d, "http_flow_edge")
    producers, consumers = _messages(spark, d)
    topics = producers.select("workspace_id", "topic_name").union(consumers.select("workspace_id", "topic_name")).distinct()
    return {
        "repository": (files.select("workspace_id", "repo").distinct(), ["workspace_id", "repo"]),
        "commit": (files.where("commit_sha IS NOT NULL").select("workspace_id", "repo", "commit_sha").distinct(), ["workspace_id", "repo", "commit_sha"]),
        "file": (files, catalog.NODES["file"]),
        "symbol": (t(spark, d, "symbol_def"), catalog.NODES["symbol"]),
        "chunk": (t(spark, d, "chunk"), catalog.NODES["chunk"]),
        "route": (flows_.select("workspace_id", "route_repo", "method", "path_template"), ["workspace_id", "route_repo", "method", "path_template"]),
        "http_client_call": (flows_.select("workspace_id", "client_repo", "client_caller_fqn", "method", "path_template"), ["workspace_id", "client_repo", "client_caller_fqn", "method", "path_template"]),
        "topic": (topics, ["workspace_id", "topic_name"]),
    }


_LABELS = f"""WITH {_MESSAGES}, lb AS (
  SELECT DISTINCT 'repository' AS label, workspace_id, concat_ws(chr(31), repo) AS k FROM file_record
  UNION ALL SELECT DISTINCT 'commit', workspace_id, concat_ws(chr(31), repo, commit_sha) FROM file_record WHERE commit_sha IS NOT NULL
  UNION ALL SELECT DISTINCT 'file', workspace_id, concat_ws(chr(31), repo, repo_relative_path) FROM file_record
  UNION ALL SELECT DISTINCT 'symbol', workspace_id, concat_ws(chr(31), repo, fqn) FROM symbol_def
  UNION ALL SELECT DISTINCT 'chunk', workspace_id, chunk_id FROM chunk
  UNION ALL SELECT 'route', workspace_id, concat_ws(chr(31), coalesce(route_repo, '?'), coalesce(method, '?'), coalesce(path_template, '?')) FROM (SELECT DISTINCT workspace_id, route_repo, method, path_template FROM http_flow_edge)
  UNION ALL SELECT 'http_client_call', workspace_id, concat_ws(chr(31), coalesce(client_repo, '?'), coalesce(client_caller_fqn, '?'), coalesce(method, '?'), coalesce(path_template, '?')) FROM (SELECT DISTINCT workspace_id, client_repo, client_caller_fqn, method, path_template FROM http_flow_edge)
  UNION ALL SELECT DISTINCT 'topic', workspace_id, topic_name FROM (SELECT workspace_id, topic_name FROM mp UNION SELECT workspace_id, topic_name FROM mc))"""


@query("label_counts", f"{_LABELS} SELECT label, count(*) AS n FROM lb GROUP BY 1")
def label_counts(spark, d):
    return catalog.counts(_labels(spark, d))


@query("workspace_stats", f"{_LABELS} SELECT label, workspace_id, count(*) AS n FROM lb GROUP BY 1, 2")
def workspace_stats(spark, d):
    return catalog.counts_by_workspace(_labels(spark, d))


@query(
    "duplicate_keys",
    """SELECT 'file' AS label, count(*) AS duplicates FROM (SELECT 1 FROM file_record GROUP BY workspace_id, repo, repo_relative_path HAVING count(*) > 1) UNION ALL SELECT 'symbol', count(*) FROM (SELECT 1 FROM symbol_def GROUP BY workspace_id, repo, fqn HAVING count(*) > 1) UNION ALL SELECT 'chunk', count(*) FROM (SELECT 1 FROM chunk GROUP BY chunk_id HAVING count(*) > 1)
UNION ALL SELECT 'route', count(*) FROM (SELECT 1 FROM http_flow_edge GROUP BY workspace_id, route_repo, method, path_template HAVING count(*) > 1) UNION ALL SELECT 'http_client_call', count(*) FROM (SELECT 1 FROM http_flow_edge GROUP BY workspace_id, client_repo, client_caller_fqn, method, path_template HAVING count(*) > 1)
UNION ALL SELECT unnest(['repository', 'commit', 'topic']), 0""",
)
def duplicate_keys(spark, d):
    return catalog.duplicate_keys(_labels(spark, d))


_KINDS = "CASE column_type WHEN 'VARCHAR' THEN 'String' WHEN 'BIGINT' THEN 'Long' WHEN 'INTEGER' THEN 'Long' WHEN 'DOUBLE' THEN 'Double' WHEN 'TIMESTAMP' THEN 'DateTime' WHEN 'FLOAT[]' THEN 'DoubleArray' ELSE column_type END"
_HELD = " UNION ALL ".join(f"SELECT '{label}' AS label, property, {_KINDS} AS types, n = (SELECT count(*) FROM {name}) AND n > 0 AS mandatory FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {name}) ON * INTO NAME property VALUE n) JOIN (SELECT column_name AS property, column_type FROM (DESCRIBE {name})) USING (property)" for label, name in (("file", "file_record"), ("symbol", "symbol_def"), ("chunk", "chunk")))


@query("property_catalog", _HELD)
def property_catalog(spark, d):
    found = catalog.property_catalog({label: t(spark, d, name) for label, name in (("file", "file_record"), ("symbol", "symbol_def"), ("chunk", "chunk"))})
    return found.withColumn("types", F.array_join("types", ","))


def _edge_tables(spark, d):
    """The edges that a data folder's tables hold, each once."""
    files, symbols, http = t(spark, d, "file_record"), t(spark, d, "symbol_def"), t(spark, d, "http_flow_edge")
    node = symbols.select("workspace_id", "repo", "fqn").dropna().distinct()
    anywhere = node.select("workspace_id", F.col("fqn").alias("resolved_fqn")).distinct()
    ends = lambda df, repo, fqn: df.join(node.select("workspace_id", F.col("repo").alias(repo), F.col("fqn").alias(fqn)), ["workspace_id", repo, fqn], "left_semi").distinct()
    producers, consumers = _messages(spark, d)
    return [
        ("CONTAINS", "workspace", "repository", files.select("workspace_id", "repo").dropna().distinct()),
        ("CONTAINS", "repository", "file", files.select("workspace_id", "repo", "repo_relative_path").dropna().distinct()),
        ("HAS_COMMIT", "repository", "commit", files.select("workspace_id", "repo", "commit_sha").dropna().distinct()),
        ("DEFINES", "file", "symbol", symbols.select("workspace_id", "repo", "file_path", "fqn").dropna().distinct()),
        ("ENCLOSES", "symbol", "symbol", ends(symbols.select("workspace_id", "repo", "parent_fqn", "fqn").dropna(), "repo", "parent_fqn")),
        ("HAS_CHUNK", "file", "chunk", t(spark, d, "chunk").select("workspace_id", "repo", "file_path", "chunk_id").dropna().distinct()),
        ("IMPORTS", "file", "symbol", t(spark, d, "import_ref").select("workspace_id", "repo", "file_path", "resolved_fqn").dropna().join(anywhere, ["workspace_id", "resolved_fqn"], "left_semi").distinct()),
        ("HANDLES", "symbol", "route", ends(http.select("workspace_id", "route_repo", "route_handler_fqn", "method", "path_template").dropna(), "route_repo", "route_handler_fqn")),
        ("INVOKES", "symbol", "http_client_call", ends(http.select("workspace_id", "client_repo", "client_caller_fqn", "method", "path_template").dropna(), "client_repo", "client_caller_fqn")),
        ("HTTP_FLOW", "http_client_call", "route", http.select("workspace_id", "client_repo", "client_caller_fqn", "route_repo", "method", "path_template").dropna().distinct()),
        ("PRODUCES", "symbol", "producer", producers.select("workspace_id", "producer_id").distinct()),
        ("CONSUMES", "symbol", "consumer", consumers.select("workspace_id", "consumer_id").distinct()),
        ("WRITES_TO", "producer", "topic", producers.select("workspace_id", "producer_id", "topic_name").distinct()),
        ("READS_FROM", "consumer", "topic", consumers.select("workspace_id", "consumer_id", "topic_name").distinct()),
        ("CALLS", "symbol", "symbol", _edges(spark, d).select("workspace_id", "edge_id")),
    ]


_ENDS = f"""WITH {_EDGES}, {_MESSAGES}, hf AS (SELECT * FROM http_flow_edge WHERE workspace_id IS NOT NULL AND method IS NOT NULL AND path_template IS NOT NULL),
ec AS (SELECT 'CONTAINS' AS rel, 'workspace' AS start, 'repository' AS "end", count(*) AS n FROM (SELECT DISTINCT workspace_id, repo FROM file_record WHERE workspace_id IS NOT NULL AND repo IS NOT NULL)
  UNION ALL SELECT 'CONTAINS', 'repository', 'file', count(*) FROM (SELECT DISTINCT workspace_id, repo, repo_relative_path FROM file_record WHERE workspace_id IS NOT NULL AND repo IS NOT NULL AND repo_relative_path IS NOT NULL)
  UNION ALL SELECT 'HAS_COMMIT', 'repository', 'commit', count(*) FROM (SELECT DISTINCT workspace_id, repo, commit_sha FROM file_record WHERE workspace_id IS NOT NULL AND repo IS NOT NULL AND commit_sha IS NOT NULL)
  UNION ALL SELECT 'DEFINES', 'file', 'symbol', count(*) FROM (SELECT DISTINCT workspace_id, repo, file_path, fqn FROM symbol_def WHERE workspace_id IS NOT NULL AND repo IS NOT NULL AND file_path IS NOT NULL AND fqn IS NOT NULL)
  UNION ALL SELECT 'ENCLOSES', 'symbol', 'symbol', count(*) FROM (SELECT DISTINCT workspace_id, repo, parent_fqn, fqn FROM symbol_def WHERE fqn IS NOT NULL AND (workspace_id, repo, parent_fqn) IN (SELECT (workspace_id, repo, fqn) FROM s))
  UNION ALL SELECT 'HAS_CHUNK', 'file', 'chunk', count(*) FROM (SELECT DISTINCT workspace_id, repo, file_path, chunk_id FROM chunk WHERE workspace_id IS NOT NULL AND repo IS NOT NULL AND file_path IS NOT NULL AND chunk_id IS NOT NULL)
  UNION ALL SELECT 'IMPORTS', 'file', 'symbol', count(*) FROM (SELECT DISTINCT workspace_id, repo, file_path, resolved_fqn FROM import_ref WHERE repo IS NOT NULL AND file_path IS NOT NULL AND (workspace_id, resolved_fqn) IN (SELECT (workspace_id, fqn) FROM s))
  UNION ALL SELECT 'HANDLES', 'symbol', 'route', count(*) FROM (SELECT DISTINCT workspace_id, route_repo, route_handler_fqn, method, path_template FROM hf WHERE (workspace_id, route_repo, route_handler_fqn) IN (SELECT (workspace_id, repo, fqn) FROM s))
  UNION ALL SELECT 'INVOKES', 'symbol', 'http_client_call', count(*) FROM (SELECT DISTINCT workspace_id, client_repo, client_caller_fqn, method, path_template FROM hf WHERE (workspace_id, client_repo, client_caller_fqn) IN (SELECT (workspace_id, repo, fqn) FROM s))
  UNION ALL SELECT 'HTTP_FLOW', 'http_client_call', 'route', count(*) FROM (SELECT DISTINCT workspace_id, client_repo, client_caller_fqn, route_repo, method, path_template FROM hf WHERE client_repo IS NOT NULL AND client_caller_fqn IS NOT NULL AND route_repo IS NOT NULL)
  UNION ALL SELECT 'PRODUCES', 'symbol', 'producer', count(DISTINCT symbol_id) FROM mp UNION ALL SELECT 'CONSUMES', 'symbol', 'consumer', count(DISTINCT symbol_id) FROM mc
  UNION ALL SELECT 'WRITES_TO', 'producer', 'topic', count(DISTINCT symbol_id) FROM mp UNION ALL SELECT 'READS_FROM', 'consumer', 'topic', count(DISTINCT symbol_id) FROM mc
  UNION ALL SELECT 'CALLS', 'symbol', 'symbol', count(*) FROM edges)"""


@query("endpoint_catalog", f"{_ENDS} SELECT * FROM ec WHERE n > 0")
def endpoint_catalog(spark, d):
    return catalog.edge_catalog(_edge_tables(spark, d))


@query("edge_types", f"""{_ENDS} SELECT rel, coalesce(string_agg(start || '>' || "end", ',' ORDER BY start || '>' || "end"), '') AS ends, CASE WHEN sum(n) > 0 THEN sum(n)::BIGINT END AS n FROM (SELECT * FROM ec WHERE n > 0 UNION ALL SELECT unnest(['DEFINES_MODULE', 'KAFKA_FLOW']), NULL, NULL, 0) GROUP BY 1""")
def edge_types(spark, d):
    return catalog.edge_types(catalog.edge_catalog(_edge_tables(spark, d)))


@query("files_by_language", "SELECT repo, lang, count(*) AS files FROM (SELECT DISTINCT workspace_id, repo, lang, file_id FROM file_record) GROUP BY ALL")
def files_by_language(spark, d):
    return t(spark, d, "file_record").select("workspace_id", "repo", "lang", "file_id").distinct().groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("files"))


@query("symbols_by_kind", "SELECT repo, kind, count(DISTINCT symbol_id) AS symbols FROM symbol_def GROUP BY ALL")
def symbols_by_kind(spark, d):
    return t(spark, d, "symbol_def").groupBy("repo", "kind").agg(F.countDistinct("symbol_id").alias("symbols"))


# ---- extraction -----------------------------------------------------------------------------------


def _sources(spark, d, kind: str):
    lang = fn.language_of(F.col("lang"), F.col("repo_relative_path"))
    one = t(spark, d, "file_record").withColumn("lang", lang).where("file_id IS NOT NULL AND lang IS NOT NULL").groupBy("file_id").agg(F.min(F.struct("workspace_id", "repo", F.col("repo_relative_path").alias("file_path"), "lang")).alias("f")).select("file_id", "f.*")
    return one.join(t(spark, d, "source_text"), "file_id")


def _extracted(kind: str):
    def run(spark, d):
        from quillgraph.operators import extract

        return extract.facts_of(extract.extract(_sources(spark, d, kind)), kind)

    return run


for _kind in ("symbol", "import", "call", "route", "client", "producer", "consumer", "module"):
    QUERIES[f"extract_{_kind}"] = _extracted(_kind)

@query("extract_known", "SELECT DISTINCT file_id, name, start_line, kind FROM symbol_def WHERE kind IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL AND NOT (kind = 'variable' AND regexp_matches(file_path, '\\.pyi?$'))")
def extract_known(spark, d):
    """The extracted symbols that the given table of symbols has too (variables of Python modules are no symbols here)."""
    from quillgraph.operators import extract

    known = t(spark, d, "symbol_def").where("kind IS NOT NULL").select("file_id", "name", "start_line").distinct()
    found = extract.facts_of(extract.extract(_sources(spark, d, "symbol")), "symbol")
    return found.join(known, ["file_id", "name", "start_line"], "left_semi").select("file_id", "name", "start_line", F.col("symbol_kind").alias("kind")).distinct()


SQL["extract_module"] = r"""SELECT file_id, workspace_id, repo, path AS file_path, 0 AS seq, 1 AS start_line,
  replace(regexp_replace(regexp_replace(regexp_replace(path, '^(?:(?:src|lib)/)+', ''), '\.(?:pyi?|tsx?|mts|cts|jsx?|mjs|cjs)$', ''), CASE WHEN lang = 'python' THEN '(?:^|/)__init__$' ELSE '(?:^|/)index$' END, ''), '/', '.') AS fqn,
  CASE WHEN regexp_matches(path, '(^|/)__init__\.pyi?$') THEN 'package' ELSE 'module' END AS symbol_kind
FROM (SELECT DISTINCT file_id, workspace_id, repo, repo_relative_path AS path, coalesce(lang, CASE WHEN regexp_matches(repo_relative_path, '\.pyi?$') THEN 'python' ELSE 'script' END) AS lang FROM file_record WHERE lang IS NOT NULL OR regexp_matches(repo_relative_path, '\.(?:pyi?|[cm]?[jt]sx?)$')) JOIN source_text USING (file_id) WHERE text IS NOT NULL"""
