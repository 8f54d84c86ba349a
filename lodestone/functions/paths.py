"""Paths: volumes and parts, cover by component, names and extensions, ignore rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are never listed, and those that aren't at the root of a Windows volume.
BUILTIN_NAMES = (".git", "node_modules", ".lodestone")
BUILTIN_PREFIX = "~$"
VOLUME_NAMES = ("$recycle.bin", "system volume information")


@dataclass(frozen=True)
class ParsedPath:
    """A path as a volume ("" for POSIX, "d:" for a drive, "\\\\host\\share" for a share) and parts; Windows compares without case."""

    windows: bool
    volume: str
    parts: tuple[str, ...]

    @property
    def key(self) -> tuple[str, tuple[str, ...]]:
        return (self.volume.lower(), tuple(p.lower() for p in self.parts)) if self.windows else (self.volume, self.parts)


_DRIVE = re.compile(r"([A-Za-z]:)[\\/]*(.*)", re.S)
_SHARE = re.compile(r"[\\/]{2}([^\\/]+)[\\/]+([^\\/]+)[\\/]*(.*)", re.S)


def parse_path(path: str) -> ParsedPath:
    """Raises ValueError for paths that aren't absolute."""

    def parts(rest: str, separators: str) -> tuple[str, ...]:
        out: list[str] = []
        for p in re.split(f"[{separators}]+", rest):
            if p == "..":
                out[-1:] = []
            elif p not in ("", "."):
                out.append(p)
        return tuple(out)

    if found := _DRIVE.fullmatch(path):
        return ParsedPath(True, found[1], parts(found[2], r"\\/"))
    if path.startswith("\\\\") and (found := _SHARE.fullmatch(path)):
        return ParsedPath(True, f"\\\\{found[1]}\\{found[2]}", parts(found[3], r"\\/"))
    if path.startswith("/"):
        return ParsedPath(False, "", parts(path, "/"))
    raise ValueError(f"not an absolute path: {path!r}")


def same_path(a: str, b: str) -> bool:
    x, y = parse_path(a), parse_path(b)
    return x.windows == y.windows and x.key == y.key


def covers(parent: str, child: str, strictly: bool = False) -> bool:
    """Whether ``child`` is ``parent`` (unless strictly) or lies below it, by whole components."""
    x, y = parse_path(parent), parse_path(child)
    if x.windows != y.windows or x.key[0] != y.key[0]:
        return False
    deep = len(x.parts)
    return y.key[1][:deep] == x.key[1] and (not strictly or len(y.parts) > deep)


def most_specific(roots: list[str], path: str) -> str | None:
    """The covering root with the most components."""
    found = [r for r in roots if covers(r, path)]
    return max(found, key=lambda r: len(parse_path(r).parts), default=None)


# Columns --------------------------------------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; '' for names without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]*)$", 1))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def ancestors(path: Column) -> Column:
    """The path and all folders above it, without the root folder."""
    steps = parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))


def path_key(path: Column) -> Column:
    """A path of any kind as one string that is equal for the same path and begins with the key of each folder above it: ``d:/x/y`` for drives and ``//host/share/x`` for shares, both in lower case, as
    Windows compares without it, and ``/x/y`` for POSIX. Empty parts and ``.`` go, ``..`` takes the part before it. Null for paths that aren't absolute."""
    drive, share = path.rlike(r"^[A-Za-z]:"), path.rlike(r"^\\\\[^\\/]+[\\/]+[^\\/]+")
    host = F.regexp_extract(path, r"^\\\\([^\\/]+)[\\/]+([^\\/]+)", 1)
    folder = F.regexp_extract(path, r"^\\\\([^\\/]+)[\\/]+([^\\/]+)", 2)
    volume = F.when(drive, F.lower(F.substring(path, 1, 2))).when(share, F.lower(F.concat(F.lit("//"), host, F.lit("/"), folder))).when(path.startswith("/"), F.lit(""))
    rest = F.when(drive, F.regexp_replace(path, r"^[A-Za-z]:", "")).when(share, F.regexp_replace(path, r"^\\\\[^\\/]+[\\/]+[^\\/]+", "")).otherwise(path)
    steps = F.when(drive | share, F.split(F.lower(rest), r"[\\/]+")).otherwise(F.split(rest, "/"))
    steps = F.filter(steps, lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    steps = F.when(F.array_contains(steps, ".."), walked).otherwise(steps)
    return F.when(volume.isNotNull(), F.concat(volume, F.lit("/"), F.array_join(steps, "/")))


def key_ancestors(key: Column) -> Column:
    """A key of path_key() and the keys of all folders above it, down to its volume's."""
    head = F.regexp_extract(key, r"^(//[^/]+/[^/]+/|[a-z]:/|/)", 1)
    steps = F.filter(F.split(F.regexp_replace(key, r"^(//[^/]+/[^/]+/|[a-z]:/|/)", ""), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.concat(head, F.array_join(F.slice(steps, 1, n), "/")))


def below(path: Column, folder: Column | str) -> Column:
    """Whether path is the folder or lies in it. Windows folders are compared without case."""
    if isinstance(folder, str) and not folder.startswith("/"):
        return F.array_contains(key_ancestors(path_key(path)), path_key(F.lit(folder)))
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return (path == folder) | path.startswith(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))


def utf16_order(text: Column) -> Column:
    """Sorts as UTF-16 code units do."""
    return F.encode(text, "UTF-16BE")


# Ignore rules ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class IgnoreRule:
    """A compiled line of an ignore file; patterns are matched without case against paths relative to the file's folder."""

    pattern: str
    folders_only: bool

    def matches(self, relative: str, is_folder: bool) -> bool:
        return (is_folder or not self.folders_only) and re.search(self.pattern, relative, re.I) is not None


def _glob(text: str) -> str:
    out, at = [], 0
    while at < len(text):
        if text.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif text.startswith("**", at):
            out.append(".*")
            at += 2
        else:
            c = text[at]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            at += 1
    return "".join(out)


def ignore_rules(content: str) -> list[IgnoreRule]:
    """Rules of an ignore file. A slash at the start or inside anchors a rule to the folder; others match any component. Raises ValueError for negations."""
    rules = []
    for raw in re.split(r"\r\n|\n|\r", content):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("!"):
            raise ValueError(f"negated rules aren't supported: {line!r}")
        line = line.replace("\\", "/")
        while line.startswith("./"):
            line = line[2:]
        folders_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if line:
            rules.append(IgnoreRule(f"^{_glob(line)}$" if anchored else f"(?:^|/){_glob(line)}$", folders_only))
    return rules


def ignored(path: Column, is_folder: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the relative path itself or any folder above it is excluded by a rule or by a built-in name."""
    steps = F.filter(F.split(path, "/"), lambda p: p != "")
    lower = F.transform(steps, F.lower)
    out = F.exists(lower, lambda p: p.isin(*BUILTIN_NAMES)) | F.exists(steps, lambda p: p.startswith(BUILTIN_PREFIX))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, 1, n), "/").alias("p"), ((n < F.size(steps)) | is_folder).alias("folder")))
    for rule in rules:
        out = out | _any(prefixes, rule)
    return out


def _any(prefixes: Column, rule: IgnoreRule) -> Column:
    if rule.folders_only:
        return F.exists(prefixes, lambda x: x["folder"] & x["p"].rlike(f"(?i){rule.pattern}"))
    return F.exists(prefixes, lambda x: x["p"].rlike(f"(?i){rule.pattern}"))
