"""Path globs as regular expressions that every SQL engine takes.

``*`` and ``?`` stay in a segment, ``**`` as a segment spans any number of
them, ``{a,b}`` are alternatives, ``[a-z]`` and ``[!a-z]`` classes; dot files
match; ``(...)`` groups are refused. A leading ``!`` excludes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _piece(pattern: str) -> str:
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern[i:] == "/**":  # the folder itself, too
            out.append("(?:/.*)?")
            break
        if pattern[i:] == "**" and i == 0:
            out.append(".*")
            break
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{" and "}" in pattern[i:]:
            depth += 1
            out.append("(?:")
        elif c == "," and depth:
            out.append("|")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def regex_of(pattern: str) -> str:
    """The whole-path regular expression of a glob (without its ``!``)."""
    return f"^{_piece(pattern.removeprefix('!').removeprefix('./'))}$"


def problems(patterns: list[str]) -> list[str]:
    found = [] if any(not p.startswith("!") for p in patterns) else ["at least one positive pattern is needed"]
    for p in patterns:
        body = p.removeprefix("!")
        if not body.strip():
            found.append("empty pattern")
        if re.search(r"[?*+@!]\(", body):
            found.append(f"extended glob: {p}")
        if body.count("[") > body.count("]"):
            found.append(f"open bracket: {p}")
    return found


def matches(path: Column, patterns: list[str]) -> Column:
    """Some positive pattern fits and no negated one."""
    yes = [path.rlike(regex_of(p)) for p in patterns if not p.startswith("!")]
    no = [path.rlike(regex_of(p)) for p in patterns if p.startswith("!")]
    if not yes:
        return F.lit(False)
    hit = reduce(lambda a, b: a | b, yes)
    return hit & ~reduce(lambda a, b: a | b, no) if no else hit


def explained(files: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """(path, pattern, negated, matched): a row for each file and pattern, the patterns being the program's own."""
    each = [F.struct(F.lit(p).alias("pattern"), F.lit(p.startswith("!")).alias("negated"), F.col(path).rlike(regex_of(p)).alias("matched")) for p in patterns]
    return files.select(path, F.inline(F.array(*each)))


def in_every_scope(path: Column, scopes: list[list[str]]) -> Column:
    """Whether a path fits every one of several groups of globs."""
    return reduce(lambda a, b: a & b, [matches(path, s) for s in scopes], F.lit(True))


def under(name: Column, path: str) -> Column:
    """Whether a name belongs to a path: begins with ``path#``, taken literally."""
    return name.startswith(path + "#")


# What sources end in, and folders that are never watched.
SOURCES = ("ts", "tsx", "js", "jsx", "svelte", "py")
UNWATCHED = (".git", "node_modules", "dist", "build", "coverage")


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(?:" + "|".join(SOURCES) + ")$")


def default_patterns(workspaces: list[str]) -> list[str]:
    """What belongs to a project whose workspaces have these roots."""
    sources = "{" + ",".join(SOURCES) + "}"
    roots = [f"src/**/*.{sources}", f"tests/**/*.{sources}", "docs/**/*.{md,markdown}", "*.{md,markdown}", "package.json", "tsconfig*.json"]
    return list(dict.fromkeys([*roots, *(f"{w}/{end}" for w in workspaces for end in (f"**/*.{sources}", "package.json", "tsconfig*.json"))]))


def watched(path: Column, ignored: list[str] | None = None) -> Column:
    """Whether changes of a path count: it is in no built-in folder and fits no ignored pattern."""
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, UNWATCHED)))
    return ~inside & ~matches(path, ignored) if ignored else ~inside
