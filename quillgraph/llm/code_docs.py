"""Functions paired with their documentation.

A definition's documentation is its docstring or, where that is blank, a comment of its file: all the
file's comment blocks and docstrings are candidates, linked to definitions by distance, by the
parameters their tags name and by the names they mention, and given out by a bipartite assignment of
greatest total score. Links below LEAST_LINK are implausible: comments that are cut off by a blank line
and say nothing of this definition, or whose tags name only other parameters.

A description is informative with LEAST_WORDS different words of prose that occur neither in the name
nor in the signature. Tags with what follows them, tool directives, code, rules, and notes that stand in
for documentation or point elsewhere are no prose.

Defined results: without kind the signature tells whether it is a function; null names and signatures
are empty; a null or impossible start_line finds no comment; symbols without id are left out, re-delivered
ones count once, definitions on one line share the comment; files without text have no comments; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.tables import table

LEAST_WORDS, LEAST_LINK, MOST_GAP = 4, 1.0, 3
_FUNCTION = r"(?s)^\s*(?:(?:export|default|public|private|protected|static|abstract|override|readonly)\s+)*(?:(?:async\s+)?(?:def|function)\b|(?:async\s+)?\*?\s*[#\w$]+\s*(?:<[^>]*>)?\s*\(|(?:const|let|var)?\s*[\w$]+\s*=\s*(?:async\s*)?(?:\(|[\w$]+\s*=>|function\b))"
_NOT_FUNCTION = r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|type|enum|namespace)\b"

_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:noqa|type:\s*ignore|pylint|flake8|mypy|pyright|ruff|isort|fmt:|yapf|pragma|nosec|eslint|tslint|jshint|jslint|prettier|istanbul|c8 ignore|v8 ignore|@?ts-(?:ignore|expect|nocheck|check)|global\s|region\b|endregion\b|#?-\*-|coding[:=]|vim:|sourceMappingURL|biome-ignore|deno-|webpackChunkName|@__PURE__)"
)
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z]\w*|:(?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raises?|except|exception|yields?|ytype|ivar|cvar|var|meta|see|deprecated)\b[^:]*:)")
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|other parameters|keyword args|keyword arguments|returns?|yields?|raises|throws|attributes|examples?|see also|todo|notes?|references|warnings?|usage)\s*:\s*$")
_UNDERLINE = re.compile(r"^\s*[-=~^]{3,}\s*$")
_NOTE = re.compile(r"(?i)\b(?:todo|fixme|xxx|tbd|wip|hack)\b.*", re.S)
_STAND_IN = re.compile(
    r"(?ix)^\W*(?:see\b(?!n)|cf\.?\s|refer\s+to\b|(?:please\s+)?(?:look|check)\s+(?:at|in)\b|as\s+(?:above|below|in)\b|same\s+as\b|like\s+(?:the\s+)?(?:base|parent|super)|inherit|inherited\b|overrid(?:es|den)\b|implements\s+the\s+(?:base|parent|interface)|copied\s+from\b|documented\s+(?:in|at|elsewhere)|docs?\s+(?:are|is|in|at)\b"
    r"|(?:doc(?:umentation|string|s)?|description|summary|comment|text)\s+(?:goes|comes|belongs|to\s+(?:be|come|follow)|here|missing|follows|pending|needed)|(?:a\s+)?(?:doc(?:umentation|string)?|description|summary)\W*$|no\s+(?:doc|description|comment|summary)|undocumented\b|not\s+(?:yet\s+)?documented|(?:add|write|put|insert|fill\s+in|enter)\s+(?:a\s+|an\s+|the\s+|your\s+|some\s+|proper\s+)*(?:doc|description|comment|summary|text)|to\s+be\s+(?:done|documented|written|added|filled)"
    r"|missing\s+(?:doc|description)|placeholder\b|(?:auto[-\s]?)?generated\b.*\b(?:stub|method|code|docs?|documentation)\b|(?:method|function|class)\s+stub|stub\b|siehe\b|voir\b|véase\b|ver\s+(?:la|el)\b|lorem\s+ipsum)"
)
_CODE = re.compile(
    r"^\s*(?:[\w.$\[\]'\"]+\s*(?:[-+*/|&%]?=(?!=)\s*\S|\([^)]*\)\s*;?\s*$|\[[^\]]*\]\s*;?\s*$)|(?:return|await|raise|throw|yield|del|assert|print)\b.*[();\[\]{}=]|(?:if|for|while|elif|else|try|except|with|switch|catch)\b.*[:{]\s*$|(?:const|let|var|import|from|def|class|function|export|async|public|private)\s+[\w$*{].*[;:(){}='\"]|[})\];]+\s*;?\s*$|.*[;{}]\s*$|>>>|\$ )"
)


def split_words(text: str) -> list[str]:
    """Words in lower case; identifiers are split at case and underscores."""
    return [w.lower() for w in _SPLIT.findall(text)]


def prose(doc: str | None) -> str:
    """The sentences of a docstring that tell something in words."""
    if not doc:
        return ""
    kept, section, fenced = [], None, False
    lines = doc.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    for k, line in enumerate(lines):
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced:
            continue
        if _TAG.match(line):
            if not re.match(r"\s*@?\{", line):
                break  # a block tag and all that follows it
            continue
        underlined = k + 1 < len(lines) and bool(_UNDERLINE.match(lines[k + 1])) and 0 < len(s) < 40 and bool(re.match(r"(?i)(?:parameters|returns|yields|raises|attributes|notes|examples|see also|other parameters)$", s))
        if _SECTION.match(line) or underlined:
            section = len(line) - len(line.lstrip())
            continue
        if section is not None:
            if not s or len(line) - len(line.lstrip()) > section or _UNDERLINE.match(line):
                continue
            section = None
        if _DIRECTIVE.match(s) or _CODE.match(s) and not re.search(r"\w[.!?]$", s):
            continue
        kept.append(s)
    text = re.sub(r"\{@\w+[^}]*\}", " ", "\n".join(kept))
    text = re.sub(r"`[^`\n]*`", " ", text)
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        for sentence in re.split(r"(?<=[.!?])\s+|\n(?=[-*] )", " ".join(paragraph.split())):
            sentence = _NOTE.sub("", sentence)
            if sentence.strip() and not _STAND_IN.match(sentence) and not re.fullmatch(r"[\w.$]+\([^)]*\)\W*", sentence.strip()):
                out.append(sentence.strip())
    return " ".join(out)


def informative(doc: str | None, name: str | None, signature: str | None, least: int = LEAST_WORDS) -> bool:
    known = set(split_words(name or "")) | set(split_words(signature or ""))
    return len({w for w in split_words(prose(doc)) if w not in known}) >= least


_PY_TOKEN = re.compile(r"#[^\n]*|(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S)
_JS_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:?&|!{};\[])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/", re.S)


def _clean_block(text: str) -> str:
    body = text[2:-2] if text.endswith("*/") else text[2:]
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in body.lstrip("*!").split("\n")).strip()


def comments(text: str, python: bool) -> list[tuple[int, int, str, bool]]:
    """(first line, last line, text, whether it is a string) of full-line comments and, in Python, strings that begin a line."""
    out: list[tuple[int, int, str, bool]] = []
    line, at = 1, 0
    for m in (_PY_TOKEN if python else _JS_TOKEN).finditer(text):
        raw = m.group()
        line += text.count("\n", at, m.start())
        at = m.start()
        before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if before.strip():
            continue
        last = line + raw.count("\n")
        if raw.startswith("#") or raw.startswith("//"):
            body = re.sub(r"^(?:#+!?|///?!?) ?", "", raw).rstrip()
            if out and not out[-1][3] and out[-1][1] == line - 1 and not text.split("\n", line)[line - 2].strip().endswith("*/"):
                first, _, old, _ = out.pop()
                out.append((first, line, f"{old}\n{body}", False))
            else:
                out.append((line, line, body, False))
        elif raw.startswith("/*"):
            out.append((line, last, _clean_block(raw), False))
        elif python and raw[0] in "rRuU\"'":
            quote = re.match(r"[rRuU]?(\"\"\"|'''|\"|')", raw)
            if quote:
                out.append((line, last, raw[quote.end() : -len(quote.group(1))], True))
    return out


def _body_line(lines: list[str], start: int) -> int:
    """The line on which a Python definition's body begins, if its head ends with a line."""
    depth = 0
    for k in range(start - 1, len(lines)):
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[k]).split("#")[0]
        depth += sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
        if depth <= 0 and code.rstrip().endswith(":"):
            k += 1
            while k < len(lines) and not lines[k].strip():
                k += 1
            return k + 1
        if depth <= 0 and ":" in code and not code.rstrip().endswith(","):
            return 0
    return 0


def _tagged(comment: str) -> set[str]:
    return set(re.findall(r"(?:@param|@arg|@argument)\s+(?:\{[^}]*\}\s*)?\[?([\w$]+)", comment)) | set(re.findall(r":param\s+(?:[\w\[\], ]+\s)?([\w$]+)\s*:", comment))


def _directive(text: str) -> bool:
    """Whether a comment speaks to tools alone."""
    return all(_DIRECTIVE.match(x) for x in text.split("\n") if x.strip())


def link(comment: tuple[int, int, str, bool], top: int, body: int, name: str, signature: str, lines: list[str], others: dict[int, bool] | None = None) -> float:
    """How well a comment fits a definition whose first line (decorators included) is top; 0: not at all.

    others: lines of the file's comments, and whether they are directives. Comments that stand between count as distance,
    blank lines more so; directives don't count, and are no documentation themselves.
    """
    first, last, text, string = comment
    if string:
        return 3.0 if first == body else 0.0
    between, others = range(last + 1, top), others or {}
    blank = sum(not lines[n - 1].strip() for n in between)
    if last >= top or blank > MOST_GAP or any(lines[n - 1].strip() and n not in others for n in between) or _directive(text):
        return 0.0
    score = 1.0 / (1 + blank + 0.25 * sum(n in others and not others[n] for n in between))
    if tags := _tagged(text):
        fitting = len(tags & set(re.findall(r"[\w$]+", signature))) / len(tags)
        score += fitting if fitting else -1.0
    words = set(split_words(text))
    own = set(split_words(name))
    return score + (0.5 * len(own & words) / len(own) if own else 0.0)


def assign(scores: dict[tuple[int, int], float]) -> dict[int, int]:
    """definition -> comment of greatest total score (successive best augmenting paths per component)."""
    left: dict[int, dict[int, float]] = {}
    for (d, c), s in scores.items():
        left.setdefault(d, {})[c] = s
    of_comment: dict[int, int] = {}
    result: dict[int, int] = {}
    for start in left:
        # Bellman-Ford over alternating paths from an unmatched definition
        gain, came = {start: 0.0}, {}
        changed = True
        best: tuple[float, int] | None = None
        ends: dict[int, float] = {}
        while changed:
            changed = False
            for d in list(gain):
                for c, s in left[d].items():
                    if result.get(d) == c:
                        continue
                    g = gain[d] + s
                    if g > ends.get(c, -1e18) + 1e-12:
                        ends[c], came[c] = g, d
                        if c in of_comment:
                            other = of_comment[c]
                            g2 = g - left[other][c]
                            if other != start and g2 > gain.get(other, -1e18) + 1e-12:
                                gain[other] = g2
                                changed = True
        for c, g in ends.items():
            if c not in of_comment and (best is None or g > best[0]):
                best = (g, c)
        # a definition may also be left without its comment for another's sake
        for d, g in gain.items():
            if d != start and g > 0 and (best is None or g > best[0]):
                best = (g, -1 - d)
        if best is None or best[0] <= 0:
            continue
        c = best[1]
        if c < 0:
            d = -1 - c
            c = result.pop(d)
            del of_comment[c]
        while True:
            d = came[c]
            old = result.get(d)
            result[d], of_comment[c] = c, d
            if d == start or old is None:
                break
            c = old
    return result


def from_source(text: str | None, python: bool, definitions: list[tuple[int, str, str]]) -> dict[int, str]:
    """definition's index -> the comment that documents it. definitions: start line, name, signature."""
    if not text:
        return {}
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines, found = text.split("\n"), comments(text, python)
    by_end: dict[int, list[int]] = {}
    by_start = {}
    of_comments: dict[int, bool] = {}
    for k, c in enumerate(found):
        by_end.setdefault(c[1], []).append(k)
        by_start[c[0]] = k
        if not c[3]:
            of_comments |= dict.fromkeys(range(c[0], c[1] + 1), _directive(c[2]))
    scores: dict[tuple[int, int], float] = {}
    for d, (start, name, signature) in enumerate(definitions):
        if not 1 <= start <= len(lines):
            continue
        top = start
        while top > 1 and lines[top - 2].lstrip().startswith("@"):
            top -= 1
        body = _body_line(lines, start) if python else 0
        near, end, blank = [by_start[body]] if body in by_start else [], top - 1, 0
        while end >= 1 and blank <= MOST_GAP and (not lines[end - 1].strip() or end in of_comments):
            near += by_end.get(end, ())
            blank += not lines[end - 1].strip()
            end -= 1
        for k in near:
            if found[k][2].strip() and (s := link(found[k], top, body, name, signature, lines, of_comments)) >= LEAST_LINK:
                scores[d, k] = s
    return {d: found[c][2] for d, c in assign(scores).items()}


def _functions(symbols: DataFrame) -> DataFrame:
    signature = F.coalesce("signature", F.lit(""))
    is_function = F.col("kind").isin("function", "method") | (F.col("kind").isNull() & signature.rlike(_FUNCTION) & ~signature.rlike(_NOT_FUNCTION))
    rows = symbols.where(F.col("symbol_id").isNotNull() & is_function)
    return rows.select("symbol_id", "file_id", F.coalesce("name", F.lit("")).alias("name"), signature.alias("signature"), "docstring", "lang", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("start_line", F.lit(0)).alias("start_line"))


def documented(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """symbol_id, description, origin (docstring or comment): the functions with informative documentation."""
    functions = _functions(symbols)
    blank = F.col("docstring").isNull() | F.col("docstring").rlike(r"^\s*$")
    schema = "symbol_id bigint, description string, origin string"

    def from_docstrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [informative(d, n, s) for d, n, s in zip(b["docstring"], b["name"], b["signature"], strict=True)]
            some = b[good]
            yield pd.DataFrame({"symbol_id": some["symbol_id"], "description": [prose(d) for d in some["docstring"]], "origin": "docstring"})

    def from_comments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, own in zip(b["text"], b["own"], strict=True):
                at: dict[tuple, list[int]] = {}
                for x in own:
                    at.setdefault((x["start_line"], x["name"], x["signature"]), []).append(x["symbol_id"])
                keys = list(at)
                first = own[0]
                python = first["lang"] == "python" or (not first["lang"] and first["file_path"].endswith((".py", ".pyi")))
                for d, doc in from_source(text, python, keys).items():
                    if informative(doc, keys[d][1], keys[d][2]):
                        out += [(i, prose(doc), "comment") for i in at[keys[d]]]
            yield pd.DataFrame(out, columns=["symbol_id", "description", "origin"])

    told = functions.where(~blank).select("symbol_id", "name", "signature", "docstring").mapInPandas(from_docstrings, schema)
    silent = functions.where(blank & F.col("file_id").isNotNull()).drop("docstring")
    per_file = silent.groupBy("file_id").agg(F.collect_set(F.struct("start_line", "symbol_id", "name", "signature", "lang", "file_path")).alias("own"))
    with_text = per_file.join(texts.where(F.col("file_id").isNotNull()).select("file_id", "text"), "file_id").dropDuplicates(["file_id"])
    read = with_text.select("text", "own").mapInPandas(from_comments, schema)
    return told.unionByName(read).groupBy("symbol_id").agg(F.min(F.struct("description", "origin")).alias("d")).select("symbol_id", "d.*")


def pairs(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """symbol_id, signature, description, origin, code: the code-description pairs."""
    described = documented(symbols, texts)
    spans = symbols.where(F.col("symbol_id").isNotNull()).groupBy("symbol_id").agg(F.min(F.struct("file_id", "start_line", "end_line", "signature")).alias("s")).select("symbol_id", "s.*")
    lines = F.split(F.regexp_replace("text", r"\r\n|\r", "\n"), "\n")
    start = F.greatest(F.col("start_line"), F.lit(1))
    code = F.when(F.col("end_line") >= start, F.array_join(F.slice(lines, start, F.col("end_line") - start + 1), "\n"))
    placed = described.join(spans, "symbol_id").join(texts.dropDuplicates(["file_id"]).select("file_id", "text"), "file_id", "left")
    return placed.select("symbol_id", "signature", "description", "origin", code.alias("code"))


def p3_found(spark, folder):
    return documented(table(spark, folder, "symbol_def"), table(spark, folder, "source_text")).select("symbol_id")


def p3_pairs(spark, folder):
    return pairs(table(spark, folder, "symbol_def"), table(spark, folder, "source_text"))


SQL = {}
QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}
