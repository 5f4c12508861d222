"""Scalar functions as column expressions: paths, qualified names, ids, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The methods of HTTP.
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE", "CONNECT"]
# The spellings of a path parameter, applied in this order.
PARAMETERS = [r"\{[^/{}]+\}", r":[A-Za-z_][A-Za-z0-9_]*", r"\[[^/\[\]]+\]", r"<[^/<>]+>"]


def normalize_path(path: Column) -> Column:
    """Parameters become {}, one leading slash, no doubled and no trailing one; empty stays empty."""
    out = reduce(lambda p, pattern: F.regexp_replace(p, pattern, "{}"), PARAMETERS, path)
    out = F.regexp_replace(F.concat(F.lit("/"), out), "/+", "/")
    return F.when(path == "", path).when(out == "/", out).otherwise(F.regexp_replace(out, "/$", ""))


def language_of(lang: Column, path: Column) -> Column:
    """The language as given; where it is null, that of the path's suffix."""
    suffix = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z]+)$", 1))
    by_suffix = F.when(suffix.isin("py", "pyi"), "python").when(suffix.isin("ts", "tsx", "mts", "cts"), "typescript").when(suffix.isin("js", "jsx", "mjs", "cjs"), "javascript")
    return F.coalesce(lang, by_suffix)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions of two normalised paths of equal length, {} equal to anything; else 0."""
    x, y = path_segments(a), path_segments(b)
    same = F.zip_with(x, y, lambda p, q: ((p == q) | (p == "{}") | (q == "{}")).cast("int"))
    matched = F.aggregate(same, F.lit(0), lambda n, m: n + m)
    return F.when(a == b, 1.0).when(F.size(x) != F.size(y), 0.0).when(F.size(x) == 0, 1.0).otherwise(matched / F.size(x))


def split_url(url: Column) -> tuple[Column, Column]:
    """(scheme and host or null, path)."""
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(.*)$", 1)
    return F.when(base != "", base), F.when(base == "", url).when(rest == "", "/").otherwise(rest)


def is_method(method: Column) -> Column:
    return F.upper(method).isin(HTTP_METHODS)


def module_fqn(path: Column, lang: Column) -> Column:
    """A file's module: python without leading src/ or lib/, a package's __init__ is the package; scripts likewise with index."""
    inner = F.regexp_replace(path, r"^(?:(?:src|lib)/)+", "")
    python = F.regexp_replace(F.regexp_replace(inner, r"\.pyi?$", ""), r"(?:^|/)__init__$", "")
    script = F.regexp_replace(F.regexp_replace(inner, r"\.(?:tsx?|mts|cts|jsx?|mjs|cjs)$", ""), r"(?:^|/)index$", "")
    return F.translate(F.when(lang == "python", python).otherwise(script), "/", ".")


def qualify(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("."), name))


def module_of(fqn: Column) -> Column:
    """The name without its last part; '' where there is one part."""
    return F.when(F.instr(fqn, ".") == 0, F.lit("")).otherwise(F.regexp_replace(fqn, r"\.[^.]*$", ""))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def prefixes(name: Column) -> Column:
    """The name's leading parts: a.b.c has a, a.b and a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading parts two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    return F.when(n == 0, 0).when(F.size(differs) == 0, n).otherwise(F.try_element_at(differs, F.lit(1)) - 1)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the parts' SHA-256; a null part counts as the text None."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 24))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a vector is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def escape_search(text: str) -> str:
    """Backslashes before the characters that a full-text query gives a meaning."""
    return "".join("\\" + c if c in '+-&|!(){}[]^"~*?:\\/' else c for c in text)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, both included; end is cut at the text's end."""
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")
