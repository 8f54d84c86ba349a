"""Indexed roots: how a further folder relates to them, and which of them a path belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from lodestone.functions.paths import covers, most_specific, same_path


@dataclass(frozen=True)
class RootPlan:
    """kind: existing, subtree (of a root), merge (of roots below it) or independent."""

    kind: str
    root: str
    subtree: str | None = None
    children: tuple[str, ...] = ()


def plan_root(roots: list[str], path: str) -> RootPlan:
    for root in roots:
        if same_path(root, path):
            return RootPlan("existing", root)
    if parent := most_specific(roots, path):
        return RootPlan("subtree", parent, path)
    children = tuple(r for r in roots if covers(path, r, strictly=True))
    return RootPlan("merge" if children else "independent", path, None, children)


def resolve_scope(roots: list[str], ignore_scopes: list[tuple[str, str]], history: dict[str, str], path: str) -> tuple[str, str | None]:
    """(root, subtree) that a path stands for: a root itself, a base that was merged into one, a folder below a root, or a former root. Raises LookupError."""
    for root in roots:
        if same_path(root, path):
            return root, None
    for root, base in ignore_scopes:
        if same_path(base, path):
            return root, base
    if root := most_specific(roots, path):
        return root, path
    seen, at = set(), path
    while at in history and at not in seen:
        seen.add(at)
        at = history[at]
        if at in roots:
            return at, path
    raise LookupError(f"{path} isn't indexed")


def ownership_base(root: str, ignore_bases: list[str], path: str) -> str:
    """Whose ignore rules hold for a document: the root that covers it, or else the first base that does."""
    return root if covers(root, path) else next((b for b in ignore_bases if covers(b, path)), root)
