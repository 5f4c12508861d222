"""Evaluation texts leaking into training text, by latent semantic retrieval.

Words are hashed into BINS columns and weighted by inverse document frequency over all documents. A
distributed randomised SVD of the TF-IDF passages (corpus passages, and the items' own at equal energy,
so that the latent space spans what is searched for) gives a basis of RANK columns: two passes, each
adding up one BINS x RANK matrix per partition, in groups of at most FAN. The items' windows are kept in
inverted lists around the centres of a clustering; every window of every document looks into the PROBES
lists whose centres are nearest and takes the item windows of at least LEAST_COSINE as candidates. Windows
overlap so that any N consecutive words of a document lie whole in one of its windows. A candidate passes
with a long common subsequence; then N consecutive words of the item in the document are a copy, and else
all the item's numbers and most of its telling words in the passage a paraphrase. All candidate windows of a
document and an item are checked, by falling cosine until one passes.

Short items have windows of about their own length (GROUPS), also in the documents, so that what surrounds
them can't outweigh them.

Defined results: null or wordless texts match nothing; an item of fewer than N words has to occur whole;
null ids are left out; re-delivered documents or items count once (rows are distinct); extra columns are
ignored; empty tables give an empty result. Items are a fixed, small set: at most MOST_ITEM_WORDS words.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import staged
from quillgraph.sources.tables import table

N = 13
#: Items' windows are N words, or the whole item if it is shorter; documents' are STRIDE - 1 words longer.
STRIDE = 4
WINDOW = N + STRIDE - 1
BINS, RANK, OVERSAMPLE = 1 << 15, 64, 8
#: The least cosine of a document's window with an item's. See the README for the recall measured.
LEAST_COSINE = 0.45
#: A paraphrase shares a common subsequence of this part of the item window's words.
LEAST_COMMON = 0.75
MOST_ITEM_WORDS = 2_000_000
#: Lists looked into, of twice the root of the number of item windows; so few windows need no lists.
PROBES, FEW_WINDOWS = 8, 256
#: Lengths of items that share the length of their windows.
GROUPS = (3, 6, 9, 12, N)
#: Matrices that one task adds up.
FAN = 32
#: Words of documents that a task holds in latent form at once; a multiple of WINDOW, so that pieces of long texts
#: tile into the same passages.
WORDS_AT_ONCE = 20_000
_WORD = re.compile(r"[^\W_]+")
# Invisible characters that are not of the category Cf.
_INVISIBLE = re.compile("[\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\ufe00-\ufe0f\uffa0\U000e0100-\U000e01ef]")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without regard to case, compatibility forms and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.casefold()
    return _WORD.findall(text)


class Bins(dict):
    """Word -> column, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BINS
        return b


def prepared(texts: DataFrame, key: str) -> DataFrame:
    """id, words (joined by blanks), bins (bytes of int32): the normalised texts that have words."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = Bins()
        for b in batches:
            split = [words(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "words": [" ".join(w) for w in split], "bins": [np.fromiter((bins[x] for x in w), np.int32, len(w)).tobytes() for w in split]})

    rows = texts.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias("id"), "text")
    return rows.mapInPandas(each, "id bigint, words string, bins binary").where("words <> ''")


def _summed(parts: DataFrame, partitions: int, width: int) -> np.ndarray:
    """The sum over all partitions of a BINS x width matrix that each yields as rows of 1024 bins."""

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1024 * width)
        for x in b["data"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"at": b["at"].iloc[:1], "salt": b["salt"].iloc[:1] // FAN, "data": [total.astype(np.float32).tobytes()]})

    # a tree, so that a task adds up at most FAN blocks however many partitions there are
    some = parts
    while True:
        some = some.groupBy("at", "salt").applyInPandas(add, "at int, salt int, data binary")
        if (partitions := math.ceil(partitions / FAN)) <= 1:
            break
    rows = some.toPandas().sort_values("at")  # BINS / 1024 rows
    if not len(rows):
        return np.zeros((BINS, width))
    return np.concatenate([np.frombuffer(x, np.float32) for x in rows["data"]]).astype(np.float64).reshape(BINS, width)


def _blocks(matrix: np.ndarray) -> pd.DataFrame:
    from pyspark import TaskContext

    context = TaskContext.get()
    salt = (context.partitionId() if context else 0) // FAN
    narrow = matrix.astype(np.float32)
    return pd.DataFrame({"at": np.arange(BINS // 1024, dtype=np.int32), "salt": np.int32(salt), "data": [narrow[a : a + 1024].tobytes() for a in range(0, BINS, 1024)]})


def _document_frequencies(docs: DataFrame) -> np.ndarray:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BINS, 1))
        for b in batches:
            for x in b["bins"]:
                total[np.unique(np.frombuffer(x, np.int32)), 0] += 1
        yield _blocks(total)

    return _summed(docs.select("bins").mapInPandas(each, "at int, salt int, data binary"), docs.rdd.getNumPartitions(), 1)[:, 0]


def _gram_times(arrays: list[np.ndarray], idf: np.ndarray, weighted: np.ndarray, into: np.ndarray) -> None:
    """into += A^T (A basis), where A's rows are the texts' passages of WINDOW words, weighted by idf.

    weighted: the basis with its rows times idf. A word's row gets the sum of its passages' images.
    """
    flat = np.concatenate(arrays)
    starts = np.concatenate([off + np.arange(0, len(a), WINDOW) for a, off in zip(arrays, np.cumsum([0, *map(len, arrays)])[:-1], strict=True)])
    passages = np.add.reduceat(weighted[flat], starts, axis=0)
    passage_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(flat)]))
    order = np.argsort(flat, kind="stable")
    bins, at = np.unique(flat[order], return_index=True)
    into[bins] += np.add.reduceat(passages[passage_of[order]], at, axis=0) * idf[bins][:, None]


def _gram(docs: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast((idf, (idf[:, None] * basis).astype(np.float32)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, columns = shared.value
        total = np.zeros((BINS, columns.shape[1]))
        for b in batches:
            for some in _pieces(b["bins"].tolist(), 0):
                _gram_times([x for _, _, x in some], weights, columns, total)
        yield _blocks(total)

    return _summed(docs.select("bins").mapInPandas(each, "at int, salt int, data binary"), docs.rdd.getNumPartitions(), basis.shape[1])


def _pieces(bins: list[bytes], overlap: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of about WORDS_AT_ONCE words of (text's index, offset, words); longer texts come in pieces that overlap."""
    some, size = [], 0
    for i, x in enumerate(bins):
        array = np.frombuffer(x, np.int32)
        for at in range(0, max(1, len(array) - overlap), WORDS_AT_ONCE):
            piece = array[at : at + WORDS_AT_ONCE + overlap]
            some.append((i, at, piece))
            size += len(piece)
            if size >= WORDS_AT_ONCE:
                yield some
                some, size = [], 0
    if some:
        yield some


def latent_space(docs: DataFrame, items: list[bytes], rank: int = RANK, seed: int = 11) -> np.ndarray:
    """BINS x rank: each word's weighted place in the latent space."""
    frequency = _document_frequencies(docs)
    n = max(1.0, docs.count())
    idf = (np.log((n + 1) / (frequency + 1)) + 0.1).astype(np.float32)

    def gram(basis: np.ndarray, scale: float | None) -> tuple[np.ndarray, float]:
        own = np.zeros_like(basis)
        for some in _pieces(items, 0):
            _gram_times([x for _, _, x in some], idf, basis, own)
        corpus = _gram(docs, idf, basis)
        if scale is None:  # equal energy, as the random basis sees it
            scale = float(np.linalg.norm(corpus) / max(np.linalg.norm(own), 1e-12))
        return corpus + scale * own, scale

    q = np.random.default_rng(seed).standard_normal((BINS, rank + OVERSAMPLE))
    z, scale = gram(q, None)
    q = np.linalg.qr(z)[0]
    z, _ = gram(q, scale)
    values, vectors = np.linalg.eigh(q.T @ z)
    keep = np.argsort(-values)[:rank]
    return (idf[:, None] * (q @ vectors[:, keep])).astype(np.float32)


def _windows(n: int, size: int, stride: int) -> np.ndarray:
    """Starts of windows that hold every run of size - stride + 1 words."""
    if n <= size:
        return np.zeros(1, dtype=np.int64)
    return np.r_[np.arange(0, n - size, stride), n - size]


class _Sums:
    """Running sums of the texts' words in the latent space: any window is a difference of two of them."""

    def __init__(self, space: np.ndarray, arrays: list[np.ndarray]):
        flat = np.concatenate(arrays)
        self.lengths = [len(a) for a in arrays]
        self.sums = np.zeros((len(flat) + 1, space.shape[1]), dtype=np.float32)
        np.cumsum(space[flat], axis=0, out=self.sums[1:])

    def windows(self, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit vectors of the windows, their text's index, their start)."""
        starts = [_windows(n, size, stride) for n in self.lengths]
        counts = [len(s) for s in starts]
        of, start = np.repeat(np.arange(len(starts)), counts), np.concatenate(starts)
        offset = np.cumsum([0, *self.lengths])[of]
        last = np.minimum(start + size, np.array(self.lengths)[of])
        v = self.sums[offset + last] - self.sums[offset + start]
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), of, start


class Lists:
    """Item windows in inverted lists around the centres of a spherical clustering."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        n = len(vectors)
        self.vectors = vectors
        if n <= FEW_WINDOWS:
            self.centres, self.members = None, [np.arange(n)]
            return
        rng = np.random.default_rng(seed)
        centres = vectors[rng.choice(n, 2 * math.ceil(math.sqrt(n)), replace=False)]
        for _ in range(8):
            nearest = np.concatenate([(vectors[a : a + 8192] @ centres.T).argmax(1) for a in range(0, n, 8192)])
            total = np.zeros_like(centres)
            np.add.at(total, nearest, vectors)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(norm > 0, total / np.maximum(norm, 1e-9), centres)
        self.centres = centres
        self.members = [np.flatnonzero(nearest == c) for c in range(len(centres))]

    def close(self, places: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, window, cosine) of at least `least` in the PROBES lists nearest to each place."""
        hits = []
        for a in range(0, len(places), 4096):
            some = places[a : a + 4096]
            if self.centres is None:
                s = some @ self.vectors.T
                w, q = np.nonzero(s >= least)
                hits.append((w + a, q, s[w, q]))
                continue
            lists = np.argpartition(some @ -self.centres.T, PROBES - 1, axis=1)[:, :PROBES].ravel()
            order = np.argsort(lists, kind="stable")
            ends = np.searchsorted(lists[order], np.arange(len(self.members) + 1))
            for c, own in enumerate(self.members):
                who = order[ends[c] : ends[c + 1]] // PROBES
                if len(who) and len(own):
                    s = some[who] @ self.vectors[own].T
                    w, q = np.nonzero(s >= least)
                    hits.append((who[w] + a, own[q], s[w, q]))
        return tuple(np.concatenate([h[k] for h in hits]) if hits else np.empty(0, (np.int64, np.int64, np.float32)[k]) for k in range(3))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _rare_words(texts: list[list[str]]) -> set[str]:
    """Words of at most an eighth of the items, or of one: what tells an item from the others."""
    count: dict[str, int] = {}
    for t in texts:
        for w in set(t):
            count[w] = count.get(w, 0) + 1
    return {w for w, n in count.items() if n <= max(1, len(texts) / 8)}


def _masks(arrays: list[np.ndarray], text: np.ndarray, at: np.ndarray, wide: int) -> np.ndarray:
    """A bit of 64 for every word of each window (its text's index and start)."""
    none = np.zeros(wide, dtype=np.uint64)
    flat = np.concatenate([y for x in arrays for y in (np.uint64(1) << (x & 63).astype(np.uint64), none)])
    begin = np.cumsum([0, *(len(x) + wide for x in arrays)])[text] + at
    out = flat[begin]
    for k in range(1, wide):
        out |= flat[begin + k]
    return out


def _close(some: list[tuple[int, int, np.ndarray]], text: np.ndarray, at: np.ndarray, wide: int, items: list[np.ndarray], item: np.ndarray, start: np.ndarray, lengths: np.ndarray, least: float) -> np.ndarray:
    """Whether at least this part of an item window's words is among a text window's: a bound of their common subsequence."""
    narrow = int(lengths.max()) if len(lengths) else 0
    flat = np.concatenate([np.r_[x, np.full(wide, -1, dtype=np.int32)] for _, _, x in some])
    asked = np.concatenate([np.r_[x, np.full(narrow, -2, dtype=np.int32)] for x in items])
    begin = np.cumsum([0, *(len(x) + wide for _, _, x in some)])[text] + at
    of = np.cumsum([0, *(len(x) + narrow for x in items)])[item] + start
    out = np.zeros(len(at), dtype=bool)
    for a in range(0, len(at), 65_536):
        there = flat[begin[a : a + 65_536, None] + np.arange(wide)]
        words_of = asked[of[a : a + 65_536, None] + np.arange(narrow)]
        shared = np.zeros(len(there), dtype=np.int32)
        for k in range(narrow):
            shared += (there == words_of[:, k : k + 1]).any(axis=1)
        out[a : a + 65_536] = shared >= least * lengths[a : a + 65_536]
    return out


def leaks(documents: DataFrame, items: DataFrame, rank: int = RANK, least_cosine: float = LEAST_COSINE, least_common: float = LEAST_COMMON) -> DataFrame:
    """item_id, doc_id, kind (copy or paraphrase), score (best cosine), common (longest common subsequence in words)."""
    spark = documents.sparkSession
    size = items.where("text IS NOT NULL").agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 40 * MOST_ITEM_WORDS:  # before anything of them comes to the driver
        raise ValueError("the items are too many to hold in one task: pass them in parts")
    docs = staged(prepared(documents, "doc_id"), "leakage-words")
    own = prepared(items, "item_id").distinct().toPandas().sort_values(["id", "words"], ignore_index=True)
    schema = "item_id bigint, doc_id bigint, kind string, score double, common int"
    if not len(own):
        return spark.createDataFrame([], schema)
    if own["bins"].map(len).sum() / 4 > MOST_ITEM_WORDS:
        raise ValueError("the items are too many to hold in one task: pass them in parts")
    space = latent_space(docs, list(own["bins"]), rank)
    arrays = [np.frombuffer(x, np.int32) for x in own["bins"]]
    vectors, of, start = _Sums(space, arrays).windows(N, STRIDE)
    lengths = np.minimum(N, np.array([len(a) for a in arrays])[of])
    # windows of a document are a little longer than the items', so that they hold all their words
    group = np.array(GROUPS)[np.searchsorted(GROUPS, lengths)]
    by_group = [(int(g), Lists(vectors[group == g]), of[group == g], start[group == g], lengths[group == g]) for g in np.unique(group)]
    ids, texts = own["id"].to_numpy(), [w.split(" ") for w in own["words"]]
    shared = spark.sparkContext.broadcast((space, by_group, ids, texts))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, by_group, ids, texts = shared.value
        rare = _rare_words(texts)
        grams = [{f" {' '.join(t[i : i + N])} " for i in range(max(1, len(t) - N + 1))} for t in texts]
        bins = Bins()
        own = [np.array([bins[w] for w in t], dtype=np.int32) for t in texts]
        masks = {m: _masks(own, of, start, m) for m, _, of, start, _ in by_group}
        asked: dict[tuple[int, int], tuple[list[str], list[str], set[str]]] = {}
        for b in batches:
            out = []
            texts_of, keys, all_bins = b["words"].tolist(), b["id"].tolist(), b["bins"].tolist()
            for some in _pieces(all_bins, WINDOW):
                sums = _Sums(space, [x for _, _, x in some])
                split: dict[int, list[str]] = {}
                whole: dict[int, str] = {}
                for m, lists, of, start, lengths in by_group:
                    wide = m + STRIDE - 1
                    places, text_of, at = sums.windows(wide, STRIDE)
                    w, q, score = lists.close(places, least_cosine)
                    # a bit that the text's window lacks is a word that it lacks: most candidates go by this alone
                    lacks = np.bitwise_count(masks[m][q] & ~_masks([x for _, _, x in some], text_of, at, wide)[w])
                    few = lacks <= (1 - least_common) * lengths[q] + 1e-9
                    w, q, score = w[few], q[few], score[few]
                    near = _close(some, text_of[w], at[w], wide, own, of[q], start[q], lengths[q], least_common)
                    w, q, score = w[near], q[near], score[near]
                    # a pair's candidates by falling cosine: the first that passes is its best
                    for x in np.lexsort((-score, of[q], text_of[w])):
                        i, item = some[text_of[w[x]]][0], int(of[q[x]])
                        if out and out[-1][:2] == (ids[item], keys[i]) and (out[-1][2] == "copy" or out[-1][5] is some):
                            continue
                        if i not in split:
                            split, whole = {i: texts_of[i].split(" ")}, {i: f" {texts_of[i]} "}  # pairs come text by text
                        window, begin = (item, int(start[q[x]])), some[text_of[w[x]]][1] + at[w[x]]
                        if window not in asked:
                            query = texts[item][window[1] : window[1] + N]
                            asked[window] = query, [y for y in query if y[0].isdigit()], {y for y in query if y in rare}
                        query, numbers, telling = asked[window]
                        passage = split[i][begin : begin + wide]
                        if (common := common_words(query, passage)) < least_common * len(query):
                            continue
                        if any(g in whole[i] for g in grams[item]):
                            out.append((ids[item], keys[i], "copy", float(score[x]), min(N, len(texts[item])), some))
                        elif len(query) == N and len(telling) >= 3 and all(y in passage for y in numbers) and 3 * len(telling & set(passage)) >= 2 * len(telling):
                            out.append((ids[item], keys[i], "paraphrase", float(score[x]), common, some))
            yield pd.DataFrame([x[:5] for x in out], columns=["item_id", "doc_id", "kind", "score", "common"])

    found = docs.mapInPandas(each, schema)
    best = F.max(F.struct(F.col("kind") == "copy", "score", "common", "kind")).alias("b")
    return found.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "b.kind", "b.score", "b.common")


def p8_found(spark, folder):
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).where("kind = 'copy'").select("item_id", "doc_id")


def p8_items(spark, folder):
    """Which items leaked, into how many documents."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return found.groupBy("item_id").agg(count("copy").alias("copies"), count("paraphrase").alias("paraphrases"))


SQL = {}
QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
