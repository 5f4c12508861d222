"""Embedding providers over a remote call, with the care such calls need."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from quillgraph.operators.chunking import DIM, PROVIDERS

#: What messages say when a request was too large: it is, or an input's or the context's size is beyond a limit.
TOO_LARGE = re.compile(r"(?i)\btoo (?:large|long|big|many tokens)\b|\b(?:http|status|code|error)\W{1,3}413\b|^413\b|\b(?:max\w*|limit\w*|exceed\w*)\b.{0,40}\b(?:tokens?|context|input|length|payload|size|sequence)\b|\b(?:tokens?|context|input|payload|sequence|text)\b.{0,40}\b(?:exceed\w*|limit|length|less than|shorter than|at most)\b")


def normalised(v: list[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm > 0 else list(v)


def guarded(call: Callable[[list[str]], list[list[float]]], dim: int = DIM, max_chars: int = 120_000, batch: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """call, by batches of texts cut to max_chars (0: whole); a batch that is too large is halved, a single text
    that is too large gets the zero vector; vectors of wrong length are an error; the others have length one."""

    def ask(texts: list[str]) -> list[list[float]]:
        try:
            vectors = call(texts)
        except Exception as e:
            if not TOO_LARGE.search(str(e)):
                raise
            if len(texts) == 1:
                return [[0.0] * dim]
            half = len(texts) // 2
            return ask(texts[:half]) + ask(texts[half:])
        if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
            raise ValueError("the provider's answer has the wrong size")
        return [normalised(list(v)) for v in vectors]

    def provider(texts: list[str]) -> list[list[float]]:
        cut = [t[:max_chars] if max_chars > 0 else t for t in texts]
        return [v for a in range(0, len(cut), batch) for v in ask(cut[a : a + batch])]

    return provider


def get(name: str, fallback: str | None = "hash") -> Callable[[list[str]], list[list[float]]]:
    """A registered provider, or the fallback; None as fallback makes an unknown name an error."""
    if name in PROVIDERS:
        return PROVIDERS[name]
    if fallback is None:
        raise KeyError(name)
    return PROVIDERS[fallback]


def register(name: str, provider: Callable[[list[str]], list[list[float]]]) -> None:
    PROVIDERS[name] = provider
