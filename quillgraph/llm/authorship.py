"""Generated, minified or vendored source files, and data saved as code.

An inverted index of line hashes finds files of one repository that are contained in a file of another
(vendored copies, patched ones too): containment is exact, weighted by how rare a line is, so that
lines everyone writes count little. Candidates come by prefix filter: a file that is contained to the
share CONTAINED must share one of its rarest lines, so only these are looked up; a file whose own lines
already weigh more than the rest can't be contained and is dropped. Exact copies are one class. Of the files
that remain, headers, paths and token composition (literals, blanks, line lengths) tell what nobody wrote by hand.

Defined results: null or empty texts are judged by path alone; null paths, repositories and languages
are empty ones; records without file_id are left out, re-delivered ones count once; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import staged
from quillgraph.sources.tables import table

#: The weighted share of a file's lines that another repository's file has to hold.
CONTAINED = 0.7
#: Files of fewer different lines are too small to tell a copy from a coincidence: idioms of a few lines stand in many
#: repositories. The rules judge them all the same.
LEAST_LINES = 8
#: A line's files are compared with those that have it among their rarest in blocks of about so many, so
#: that a line of many files is spread over tasks; copies that are equal line by line are one of them.
BLOCK = 50
_GENERATED = re.compile(
    r"(?i)\bcode generated by\b|^\W*@generated\b|@generated by|<auto-?generated>|\bauto-?generated (?:file|by|from|code|-)|\bautomatically (?:generated|created|produced|written)\b|\bproduced by \S+ from\b|\bgenerated (?:by|from|with|using) \S+|\bthis file (?:was|is|has been) (?:auto\w*[ -])?(?:generated|written by|produced|created by|built)\b"
    r"|\bdo not (?:edit|modify|change)\b(?! (?:the|this) (?:order|list|value))|\b(?:manual|hand) (?:edits|changes) will be (?:lost|overwritten)|\bchanges will be (?:lost|overwritten)|\bautomatisch (?:erzeugt|generiert|erstellt)|\bgénéré automatiquement|\bgenerado automáticamente"
)
_STUB = re.compile(r"(?i)\b(?:method|function|class) stub\b|\bstub\.?\s*\W*$")
_VENDORED = re.compile(r"(?i)\bvendored (?:copy|from)\b|\bthird[- ]party code\b|\bupstream release\b|\bsee upstream\b|^\W*/\*!\s*\S+ v?\d+\.\d+|\bbundled copy of\b")
_BANNER = re.compile(r"(?i)^\W*[\w.@/\-]+(?:\s+-|,)?\s+(?:v|version\s+)?\d+\.\d+(?:\.\d+)?\b")
_RIGHTS = re.compile(r"(?i)\(c\)|copyright|@license|licen[sc]e")
_GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:generated|__generated__|gen|autogen|codegen)/|_pb2(?:_grpc)?\.pyi?$|\.(?:pb|g|gen|generated|designer)\.\w+$|_(?:generated|autogen)\.\w+$")
_VENDORED_PATH = re.compile(r"(?i)(?:^|/)(?:vendor|_vendor|vendored|third[_-]?party|3rdparty|extern|externals?|node_modules|bower_(?:components|parts)|site-packages|jspm_packages)/|(?:^|/)(?:[a-z]+\d*)-\d+\.\d+\.\d+\.\w+$|(?:^|/)[\w\-]+-\d+\.\d+\.\d+/")
_MINIFIED_PATH = re.compile(r"(?i)\.min\.(?:m?js|cjs|css)$|\.bundle\.(?:m?js|cjs)$|(?:^|/)chunk-[0-9a-f]{4,}\.\w+$|[.-]min\.js$")
_TOKEN = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(0[xX][0-9a-fA-F]+|\d[\d._]*(?:[eE][-+]?\d+)?)|([^\W\d][\w$]*|\$[\w$]*)|(//[^\n]*|\#[^\n]*|/\*.*?\*/)|(\s+)|(.)""", re.S)
_BLOB = re.compile(r"[A-Za-z0-9+/=_\-\\x,]{200,}")
_LINES = re.compile(r"\r\n|\r|\n")
_LINE = re.compile(r"[^\r\n]+")


def header(text: str) -> list[str]:
    """The comment lines at the file's top, all of them."""
    out, block = [], False
    for m in _LINE.finditer(text):
        s = m.group().strip().lstrip("\ufeff")
        if not s:
            continue
        if block:
            out.append(s)
            block = "*/" not in s
        elif s.startswith(("//", "#")):
            out.append(s)
        elif s.startswith("/*"):
            out.append(s)
            block = "*/" not in s
        else:
            break
    return out


def _composition(text: str) -> str | None:
    """minified or data, by the tokens of the whole text."""
    strings = numbers = names = literal_chars = blanks = comments = longest = blob = 0
    for m in _TOKEN.finditer(text):
        kind, size = m.lastindex, m.end() - m.start()
        if kind == 1:
            strings += 1
            literal_chars += size
            if size > 400 and " " not in (s := m.group()) and _BLOB.match(s[1:-1]):
                blob += size
        elif kind == 2:
            numbers += 1
            literal_chars += size
        elif kind == 3:
            names += 1
        elif kind == 4:
            comments += size
        elif kind == 5:
            blanks += size
    lines = [x for x in _LINES.split(text) if x.strip()]
    longest = max(map(len, lines), default=0)
    literals = strings + numbers
    if (literals >= 40 and literals >= 6 * names) or blob > 0.6 * len(text) or (literals >= 3 and not names and text.lstrip()[:1] in "{["):
        return "data"
    code = len(text) - comments - blanks
    if code > 400 and longest > 250 and blanks < 0.1 * (code + blanks) and names > 40 and code / max(1, len(lines)) > 150:
        return "minified"
    return None


def signs(path: str, text: str) -> str | None:
    """generated, vendored, minified or data by the file alone; None: no sign."""
    top = header(text)
    if any(_GENERATED.search(x) and not _STUB.search(x) for x in top):
        return "generated"
    if any(_VENDORED.search(x) for x in top) or any(_BANNER.search(x) for x in top[:3]) and any(_RIGHTS.search(x) for x in top):
        return "vendored"
    if _VENDORED_PATH.search(path):
        return "vendored"
    if _GENERATED_PATH.search(path):
        return "generated"
    if _MINIFIED_PATH.search(path):
        return "minified"
    return _composition(text)


def _line_hashes(text: str) -> list[int]:
    """Hashes of the different lines that have something to tell, whatever their indentation."""
    kept = {" ".join(x.split()) for x in _LINES.split(text)}
    return sorted(xxhash.xxh64_intdigest(x) - (1 << 63) for x in kept if sum(map(str.isalnum, x)) >= 4)


def files(records: DataFrame, texts: DataFrame) -> DataFrame:
    """file_id, repo (workspace and name), sign, lines, class (digest of the lines): one row per file."""
    key = F.concat_ws("\x1f", F.coalesce("workspace_id", F.lit("")), F.coalesce("repo", F.lit(""))).alias("repo")
    one = records.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct(key, F.coalesce("repo_relative_path", F.lit("")).alias("path"))).alias("r"))
    text = texts.select("file_id", "text").dropDuplicates(["file_id"])
    joined = one.join(text, "file_id", "left").select("file_id", "r.repo", "r.path", F.coalesce("text", F.lit("")).alias("text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [signs(p, t) for p, t in zip(b["path"], b["text"], strict=True)]
            lines = [_line_hashes(t) for t in b["text"]]
            digest = [xxhash.xxh3_128_digest(b",".join(b"%d" % x for x in own)) if own else None for own in lines]
            yield pd.DataFrame({"file_id": b["file_id"], "repo": b["repo"], "sign": found, "lines": lines, "class": digest})

    return joined.mapInPandas(each, "file_id bigint, repo string, sign string, lines array<bigint>, class binary")


def contained(of: DataFrame, share: float = CONTAINED, least_lines: int = LEAST_LINES, block: int = BLOCK) -> DataFrame:
    """class, share: the classes of which a file of another repository holds at least `share`. of: files, staged.

    Lines that only one class has can't be shared: they are counted, never moved.
    """
    lines = of.where(F.size("lines") > 0).groupBy("class").agg(F.any_value("lines").alias("lines"), F.min("repo").alias("low"), F.max("repo").alias("high"))
    n = max(2, of.select("class").distinct().count())
    whole = float(math.log(n + 1))  # what a line of one class weighs
    posting = lines.select("class", F.size("lines").alias("size"), F.explode("lines").alias("line"))
    df = posting.groupBy("line").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = staged(posting.join(df, "line").withColumn("w", F.log(F.lit(float(n + 1)) / F.col("df"))), "authorship-lines")
    sums = common.groupBy("class").agg(F.sum("w").alias("most"), F.count(F.lit(1)).alias("common"))
    classes = lines.select("class", "low", "high", F.size("lines").alias("size")).join(sums, "class", "left").fillna(0, ["most", "common"])
    alone = (F.col("size") - F.col("common")) * whole
    # most: what a class can hold of others, its lines that others have
    classes = staged(classes.select("class", "low", "high", "most", alone.alias("alone"), (alone + F.col("most")).alias("total")).where(F.col("size") >= least_lines), "authorship-classes")
    copies = classes.where(F.col("low") != F.col("high")).select("class", F.lit(1.0).alias("share"))
    # a class whose own lines weigh more than the rest can't be contained
    asking = classes.where(F.col("alone") <= (1 - share) * F.col("total") + 1e-9)
    rarest = W.partitionBy("class").orderBy("df", "line").rowsBetween(W.unboundedPreceding, -1)
    ranked = common.join(asking.select("class", "low", "high", "alone", "total"), "class").withColumn("ahead", F.col("alone") + F.coalesce(F.sum("w").over(rarest), F.lit(0.0)))
    # beyond (1 - share) of the weight every contained file has shared a line already
    prefix = ranked.where(F.col("ahead") <= (1 - share) * F.col("total") + 1e-9).select("class", "low", "high", "line", "df", "total")
    blocks = F.ceil(F.col("df") / F.lit(block)).cast("bigint")
    partners = common.join(prefix.select("line").distinct(), "line", "left_semi").select("class", "line", F.pmod(F.xxhash64("class"), blocks).alias("block"))
    partners = partners.join(classes.select("class", "low", "high", "most"), "class").select("line", "block", F.col("class").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"), "most")
    looked = prefix.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    pairs = looked.join(partners, ["line", "block"]).where((F.col("class") != F.col("other")) & (F.col("most") >= share * F.col("total") - 1e-6))
    # there must be a file of each in different repositories
    pairs = pairs.where((F.col("low") != F.col("other_low")) | (F.col("high") != F.col("other_high")) | (F.col("low") != F.col("high"))).select("class", "other", "total").distinct()
    mine = pairs.join(common.select("class", "line", "w"), "class")
    both = mine.join(common.select(F.col("class").alias("other"), "line"), ["other", "line"])
    held = both.groupBy("class", "other", "total").agg((F.sum("w") / F.col("total")).alias("share")).where(F.col("share") >= share)
    return held.select("class", "share").unionByName(copies).groupBy("class").agg(F.max("share").alias("share"))


def not_by_hand(records: DataFrame, texts: DataFrame) -> DataFrame:
    """file_id, kind (generated, minified, vendored or data), share (held by another repository)."""
    of = staged(files(records, texts), "authorship-files")
    held = contained(of)
    joined = of.select("file_id", "sign", "class").join(held, "class", "left")
    # containment decides; the rules are for what remains
    kind = F.coalesce(F.when(F.col("share").isNotNull(), "vendored"), "sign")
    return joined.select("file_id", kind.alias("kind"), "share").where(F.col("kind").isNotNull())


def p6_found(spark, folder):
    return not_by_hand(table(spark, folder, "file_record"), table(spark, folder, "source_text")).select("file_id")


def p6_kinds(spark, folder):
    found = not_by_hand(table(spark, folder, "file_record"), table(spark, folder, "source_text"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


SQL = {}
QUERIES = {"p6_found": p6_found, "p6_kinds": p6_kinds}
