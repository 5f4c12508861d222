"""Checkouts of repositories: a local folder as it is, or a remote one cloned once per commit."""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
from dataclasses import dataclass

from quillgraph.sources.manifest import Repository


@dataclass(frozen=True)
class Checkout:
    path: str
    commit: str


class CheckoutError(RuntimeError):
    """Why there is no checkout."""


def _git(*args: str, cwd: str | None = None, timeout: int = 600) -> str:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError) as e:
        raise CheckoutError(f"git {args[0]} failed: {getattr(e, 'stderr', '') or e}") from None
    return done.stdout.strip()


def local(workspace: str, repository: Repository) -> Checkout:
    """The folder with its head commit; a folder that is no repository gets an id from its name and time of change."""
    path = os.path.abspath(os.path.expanduser(repository.path))
    if not os.path.isdir(path):
        raise CheckoutError(f"{path} is no folder")
    try:
        return Checkout(path, _git("rev-parse", "HEAD", cwd=path))
    except CheckoutError:
        stamp = f"{workspace}:{repository.name}:{os.stat(path).st_mtime_ns}"
        return Checkout(path, hashlib.sha1(stamp.encode(), usedforsecurity=False).hexdigest())


def remote(root: str, workspace: str, repository: Repository) -> Checkout:
    """root/workspace/name@commit; one that is there already is used again, a broken one is removed."""
    listed = _git("ls-remote", repository.url, repository.branch or "HEAD")
    if not listed:
        raise CheckoutError(f"{repository.url} has no {repository.branch or 'HEAD'}")
    commit = listed.split()[0]
    target = os.path.join(root, workspace, f"{repository.name}@{commit}")
    if os.path.isdir(os.path.join(target, ".git")):
        return Checkout(target, commit)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        branch = ["--branch", repository.branch] if repository.branch else []
        _git("clone", "--filter=blob:none", *branch, repository.url, target)
    except CheckoutError:
        shutil.rmtree(target, ignore_errors=True)
        raise
    return Checkout(target, _git("rev-parse", "HEAD", cwd=target))


def checkout(root: str, workspace: str, repository: Repository) -> Checkout:
    return local(workspace, repository) if repository.path else remote(root, workspace, repository)
