"""Extraction: a table function from source files to facts.

One row per fact in one wide table; `facts_of` gives each kind its own columns. A file that can't be
read yields an `error` fact and costs only itself. Null texts and unknown languages yield nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import extract_python, extract_script
from quillgraph.operators.facts import COLUMNS, SCHEMA, Facts, module_name

#: language -> extractor(path, source, module, facts). Register others here.
ADAPTERS: dict[str, Callable[[str, str, str, Facts], None]] = {"python": extract_python.extract, "typescript": extract_script.extract, "javascript": extract_script.extract}
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def file_facts(path: str, source: str, lang: str) -> list[dict]:
    facts = Facts(path)
    module = module_name(path, lang)
    package = path.rsplit("/", 1)[-1] in ("__init__.py", "__init__.pyi")
    facts.add("module", (1, 0, 1, 0), fqn=module, symbol_kind="package" if package else "module")
    try:
        ADAPTERS[lang](path, source, module, facts)
    except Exception as e:  # noqa: BLE001 - one file's failure is a fact of its own
        facts.add("error", (0, 0, 0, 0), error=f"{type(e).__name__}: {e}"[:500])
    return facts.rows


def extract(files: DataFrame) -> DataFrame:
    """files: file_id, workspace_id, repo, file_path, lang, text."""
    adapters = list(ADAPTERS)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.itertuples():
                own = {"file_id": x.file_id, "workspace_id": x.workspace_id, "repo": x.repo, "file_path": x.file_path, "lang": x.lang}
                rows += [own | f for f in file_facts(x.file_path, x.text, x.lang)]
            yield pd.DataFrame(rows, columns=_NAMES, dtype=object)

    usable = files.where(F.col("text").isNotNull() & F.col("file_path").isNotNull() & F.col("lang").isin(adapters))
    return usable.select("file_id", "workspace_id", "repo", "file_path", "lang", "text").mapInPandas(each, SCHEMA)


def facts_of(facts: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind with their columns."""
    return facts.where(F.col("fact") == kind).select("file_id", "workspace_id", "repo", "file_path", "seq", "start_line", *COLUMNS[kind])
