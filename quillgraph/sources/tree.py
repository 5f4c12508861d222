"""Source trees as a table, by a Python data source.

spark.dataSource.register(SourceTree); spark.read.format("source_tree").option("path", folder).load()

Unlike binaryFile it keeps names that begin with _ or . and doesn't enter ignored folders. The driver looks into
folders only until it has enough to share out; tasks list and read the files. Links and what can't be read are skipped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are not entered unless the option `ignored` names others: version control, environments, caches, output.
IGNORED = frozenset([".git", ".hg", ".svn", ".tox", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "target", ".next", ".nuxt", ".turbo", ".cache", "coverage", ".idea", ".vscode", "site-packages"])
# The languages of suffixes.
SUFFIXES = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
MAX_BYTES = 1_048_576
#: About so many folders are shared out to tasks; so many that are listed by the driver go into one.
PARTITIONS, FOLDERS_PER_PARTITION = 256, 32


def language(path: str) -> str | None:
    return SUFFIXES.get(os.path.splitext(path)[1].lower())


def listed(root: str, max_bytes: int = MAX_BYTES, languages: frozenset[str] | None = None, ignored: frozenset[str] = IGNORED, only: str = "") -> Iterator[tuple[str, str, int]]:
    """(relative path, language, size) in the order of names, of the whole tree or of the folder `only`. max_bytes 0: no limit; a file of just max_bytes is kept."""
    todo = [os.path.join(root, only) if only else root]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if e.name not in ignored:
                        todo.append(e.path)
                    continue
                lang, size = language(e.name), e.stat().st_size
            except OSError:
                continue
            if lang and (languages is None or lang in languages) and (max_bytes <= 0 or size <= max_bytes):
                yield os.path.relpath(e.path, root).replace(os.sep, "/"), lang, size


@dataclass
class _Folders(InputPartition):
    """Folders to list and read, with all below them or just the files in them."""

    folders: list[tuple[str, bool]]


class _Reader(DataSourceReader):
    def __init__(self, root: str, max_bytes: int, languages: frozenset[str] | None, ignored: frozenset[str]):
        self.root, self.max_bytes, self.languages, self.ignored = root, max_bytes, languages, ignored

    def _folders(self, folder: str) -> list[str]:
        try:
            return sorted(e.name for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False) and e.name not in self.ignored)
        except OSError:
            return []

    def partitions(self) -> list[_Folders]:
        """The driver looks into few folders only, until there are enough of them to share out; the tasks list the rest."""
        whole, partly = [""], []
        while whole and len(whole) < PARTITIONS and len(partly) < PARTITIONS:
            folder = whole.pop(0)
            below = self._folders(folder)
            partly.append(folder)
            whole += [os.path.join(folder, x) for x in below]
        return [_Folders([(x, True)]) for x in whole] + [_Folders([(x, False) for x in partly[a : a + FOLDERS_PER_PARTITION]]) for a in range(0, len(partly), FOLDERS_PER_PARTITION)]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        for folder, deep in partition.folders:
            here = folder.replace(os.sep, "/")
            for path, lang, size in listed(self.root, self.max_bytes, self.languages, self.ignored, folder) if deep else self._here(here):
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                yield path, lang, size, content.count(b"\n") + 1, content.decode("utf-8", errors="replace")

    def _here(self, folder: str) -> Iterator[tuple[str, str, int]]:
        """The files of a folder alone."""
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                lang, plain, size = language(e.name), e.is_file(follow_symlinks=False), e.stat(follow_symlinks=False).st_size
            except OSError:
                continue
            if plain and lang and (self.languages is None or lang in self.languages) and (self.max_bytes <= 0 or size <= self.max_bytes):
                yield f"{folder}/{e.name}" if folder else e.name, lang, size


class SourceTree(DataSource):
    """Options: path, max_bytes (default MAX_BYTES, 0 for none), languages and ignored folders (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file_path string, lang string, size_bytes bigint, line_count int, text string"

    def reader(self, schema) -> _Reader:
        names = lambda option, default: frozenset(self.options[option].split(",")) if self.options.get(option) else default
        return _Reader(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)), names("languages", None), names("ignored", IGNORED))
