"""Git checkouts, read by the driver through the git command."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Worktree:
    root: str
    head: str
    branch: str | None
    bare: bool = False
    prunable: bool = False


def _git(cwd: str, *args: str, check: bool = True) -> str:
    return subprocess.run(["git", "-C", cwd, *args], capture_output=True, text=True, check=check, timeout=60).stdout


def parse_worktrees(porcelain: str) -> list[Worktree]:
    """Entries of `git worktree list --porcelain -z`."""
    out = []
    for block in porcelain.split("\0\0"):
        fields = dict((x.split(" ", 1) + [""])[:2] for x in block.split("\0") if x)
        if "worktree" in fields:
            out.append(Worktree(fields["worktree"], fields.get("HEAD", ""), fields.get("branch"), "bare" in fields, "prunable" in fields))
    return out


def worktrees(cwd: str) -> list[Worktree]:
    return parse_worktrees(_git(cwd, "worktree", "list", "--porcelain", "-z"))


@dataclass(frozen=True)
class Checkout:
    root: str
    git_dir: str
    common_dir: str


def discover(cwd: str) -> Checkout | None:
    """The checkout that a directory lies in, None outside of any."""
    try:
        root, git_dir, common = _git(cwd, "rev-parse", "--path-format=absolute", "--show-toplevel", "--absolute-git-dir", "--git-common-dir").splitlines()
    except (subprocess.CalledProcessError, ValueError, FileNotFoundError):
        return None
    return Checkout(root, git_dir, common)


def operation_state(checkout: Checkout) -> set[str]:
    """merge, rebase_merge, rebase_apply and unmerged, as far as they hold; markers that move meanwhile count."""
    markers = {"merge": "MERGE_HEAD", "rebase_merge": "rebase-merge", "rebase_apply": "rebase-apply"}
    read = lambda: {k for k, v in markers.items() if (Path(checkout.git_dir) / v).exists()}
    before = read()
    unmerged = {"unmerged"} if _git(checkout.root, "ls-files", "--unmerged").strip() else set()
    return before | unmerged | read()


def stamp(checkout: Checkout) -> str:
    """The commit at HEAD, empty before the first; an error while an operation is under way."""
    if state := operation_state(checkout):
        raise RuntimeError(f"blocked: {', '.join(sorted(state))}")
    return _git(checkout.root, "rev-parse", "--verify", "-q", "HEAD", check=False).strip()
