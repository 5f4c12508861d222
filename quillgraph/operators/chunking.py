"""Cutting files into chunks of lines, and embedding them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import stable_id

MAX_LINES, OVERLAP = 200, 5
DIM, BATCH = 384, 64


def _check(max_lines: int, overlap: int) -> None:
    if max_lines < 1 or not 0 <= overlap < max_lines:
        raise ValueError("overlap must be smaller than max_lines, or chunks never end")


def chunk_lines(texts: DataFrame, key: str, text: str, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """key, start_line, end_line, text: overlapping runs of lines of a whole text; empty texts give none."""
    _check(max_lines, overlap)
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    n = F.size("lines")
    starts = F.sequence(F.lit(1), F.greatest(n - overlap, F.lit(1)), F.lit(max_lines - overlap))
    cut = texts.where(F.col(text) != "").select(key, lines.alias("lines")).select(key, "lines", n.alias("n"), F.explode(starts).alias("start_line"))
    end = F.least(F.col("start_line") + max_lines - 1, F.col("n"))
    return cut.select(key, "start_line", end.alias("end_line"), F.array_join(F.slice("lines", F.col("start_line"), end - F.col("start_line") + 1), "\n").alias("text"))


def spans(line_count: int, symbols: list[tuple[int, int]], lines: list[str], max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Line ranges of a file's chunks: its top-level symbols by start, cut with overlap; then the gaps that hold text."""
    out, covered = [], set()
    for start, end in sorted(symbols):
        end = min(end, line_count)
        while start <= end:
            last = min(start + max_lines - 1, end)
            out.append((start, last))
            covered.update(range(start, last + 1))
            if last >= end:
                break
            start = last - overlap + 1
    gap: list[int] = []
    for n in range(1, line_count + 2):
        if n <= line_count and n not in covered and len(gap) < max_lines:
            gap.append(n)
            continue
        if gap and any(lines[k - 1].strip() for k in gap):
            out.append((gap[0], gap[-1]))
        gap = [n] if n <= line_count and n not in covered else []
    return out


def chunk_files(files: DataFrame, texts: DataFrame, symbols: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, workspace_id, repo, file_path, start_line, end_line, text of every file with text."""
    _check(max_lines, overlap)
    one = files.groupBy("file_id").agg(F.min(F.struct("workspace_id", "repo", F.col("repo_relative_path").alias("file_path"))).alias("f")).select("file_id", "f.*")
    inner = symbols.select("workspace_id", "repo", F.col("fqn").alias("parent_fqn")).distinct().withColumn("nested", F.lit(True))
    # a symbol is top-level if its parent is no symbol, but the module
    top = symbols.join(inner, ["workspace_id", "repo", "parent_fqn"], "left").where(F.col("nested").isNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
    per_file = top.groupBy("file_id").agg(F.collect_set(F.struct("start_line", "end_line")).alias("symbols"))
    joined = one.join(texts.select("file_id", "text"), "file_id").join(per_file, "file_id", "left").where(F.col("text") != "")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.itertuples():
                # the lines that the extractors count: a form feed or another separator doesn't end one
                lines = x.text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
                own = [(max(1, s["start_line"]), s["end_line"]) for s in x.symbols] if x.symbols is not None else []
                rows += [(x.workspace_id, x.repo, x.file_path, a, z, "\n".join(lines[a - 1 : z])) for a, z in spans(len(lines), own, lines, max_lines, overlap)]
            yield pd.DataFrame(rows, columns=["workspace_id", "repo", "file_path", "start_line", "end_line", "text"])

    out = joined.mapInPandas(each, "workspace_id string, repo string, file_path string, start_line int, end_line int, text string")
    return out.select(stable_id("ck", F.col("workspace_id"), F.col("repo"), F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("chunk_id"), "*")


def hash_embedding(text: str | None, dim: int = DIM) -> list[float]:
    """A deterministic unit vector of a text, for tests and as a fallback; the empty text is the first axis."""
    if not text:
        return [1.0] + [0.0] * (dim - 1)
    raw = b""
    while len(raw) < dim:
        seed = str((len(raw) + 63) // 64).encode()
        raw += hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=min(64, dim - len(raw)), person=seed.ljust(16, b"\0")).digest()
    centred = [(x - 127.5) / 127.5 for x in raw]
    norm = math.sqrt(sum(x * x for x in centred))
    return [x / norm for x in centred]


#: Providers by name: texts -> vectors.
PROVIDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {"hash": lambda texts: [hash_embedding(t) for t in texts]}


def embed(chunks: DataFrame, text: str = "text", provider: str | Callable = "hash", dim: int = DIM, batch: int = BATCH, most_chars: int = 0, threads: int = 1, check: bool = False) -> DataFrame:
    """chunks with `embedding`: by batches; a batch that fails, or vectors of wrong length, give null. most_chars 0: whole texts.

    threads: calls that a task has under way at once, for providers that wait for a network. check: ask for one vector first
    and raise ValueError if it has the wrong length, before anything is computed.
    """
    call = PROVIDERS[provider] if isinstance(provider, str) else provider
    if check and len(call(["dimension"])[0]) != dim:
        raise ValueError(f"the provider's vectors don't have {dim} numbers")

    def one(texts: list[str]) -> list:
        try:
            vectors = call([t[:most_chars] if most_chars > 0 else t for t in texts])
            return [list(v) if len(v) == dim else None for v in vectors] if len(vectors) == len(texts) else [None] * len(texts)
        except Exception:  # noqa: BLE001 - a provider's failure costs its batch only
            return [None] * len(texts)

    @F.pandas_udf("array<float>")
    def vectors(column: pd.Series) -> pd.Series:
        texts = column.fillna("").tolist()
        slices = [texts[a : a + batch] for a in range(0, len(texts), batch)]
        if threads <= 1:
            return pd.Series([v for s in slices for v in one(s)], dtype=object)
        with ThreadPoolExecutor(threads) as pool:
            return pd.Series([v for found in pool.map(one, slices) for v in found], dtype=object)

    return chunks.withColumn("embedding", vectors(F.col(text)))
