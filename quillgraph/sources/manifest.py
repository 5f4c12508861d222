"""The manifest of workspaces and repositories: read, checked, and as a table."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_ID = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")
SCHEMA = "workspace_id string, workspace_name string, repo string, url string, path string, branch string, languages array<string>"


class ManifestError(ValueError):
    """What is wrong with a manifest."""


def _only(given: dict, allowed: set[str], where: str) -> None:
    if not isinstance(given, dict):
        raise ManifestError(f"{where} must be a mapping")
    if extra := set(given) - allowed:
        raise ManifestError(f"{where} has unknown fields: {', '.join(sorted(map(str, extra)))}")


@dataclass(frozen=True)
class Repository:
    name: str
    url: str | None = None
    path: str | None = None
    branch: str | None = None
    languages: tuple[str, ...] = ()


@dataclass(frozen=True)
class Workspace:
    id: str
    name: str | None
    repositories: tuple[Repository, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    workspaces: tuple[Workspace, ...]
    raw: dict = field(repr=False, default_factory=dict, compare=False)

    def workspace(self, wanted: str) -> Workspace:
        for w in self.workspaces:
            if w.id == wanted:
                return w
        raise KeyError(wanted)

    def digest(self) -> str:
        """SHA-256 of the manifest's canonical JSON."""
        return hashlib.sha256(json.dumps(self.raw, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(w.id, w.name, r.name, r.url, r.path, r.branch, list(r.languages)) for w in self.workspaces for r in w.repositories]
        return spark.createDataFrame(rows, SCHEMA)


def parse(given: dict) -> Manifest:
    _only(given, {"version", "workspaces"}, "the manifest")
    if given.get("version") != 1:
        raise ManifestError("version must be 1")
    listed = given.get("workspaces")
    if not isinstance(listed, list) or not listed:
        raise ManifestError("workspaces must be a list that isn't empty")
    out = []
    for w in listed:
        _only(w, {"id", "name", "repos"}, "a workspace")
        if not isinstance(w.get("id"), str) or not _ID.fullmatch(w["id"]):
            raise ManifestError(f"invalid workspace id {w.get('id')!r}")
        repos = w.get("repos")
        if not isinstance(repos, list) or not repos:
            raise ManifestError(f"workspace {w['id']} has no repositories")
        own = []
        for r in repos:
            _only(r, {"name", "url", "path", "branch", "languages"}, "a repository")
            name = r.get("name")
            if not isinstance(name, str) or not 1 <= len(name) <= 128:
                raise ManifestError("a repository's name must have 1 to 128 characters")
            if bool(r.get("url")) == bool(r.get("path")):
                raise ManifestError(f"repository {name} needs either url or path")
            own.append(Repository(name, r.get("url"), r.get("path"), r.get("branch"), tuple(r.get("languages") or ())))
        if len({r.name for r in own}) < len(own):
            raise ManifestError(f"workspace {w['id']} names a repository twice")
        out.append(Workspace(w["id"], w.get("name"), tuple(own)))
    if len({w.id for w in out}) < len(out):
        raise ManifestError("a workspace id occurs twice")
    return Manifest(1, tuple(out), given)


def load(path: str) -> Manifest:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))
