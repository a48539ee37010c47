"""URL filters: a trie over reversed host labels and path segments.

The walk goes down the labels of the host from the last to the first, and at
every label that ends a rule's host, down the segments of the path. A rule's
last path piece need not be a whole segment: it fits a segment that starts
with it. The longest rule decides; of allow and block entries for one and the
same place, block does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Rules in one broadcast trie. A longer list goes to several tries, walked one after the other.
TRIE_RULES = 200_000

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest.translate(_UPPER), "") if slash < 0 else (rest[:slash].translate(_UPPER), rest[slash:])


class Node:
    """A host label or a path segment. ``paths``: the root of the paths of a
    host that ends here; ``heads``: rules whose last path piece starts here;
    ``lengths``: the different lengths of these pieces."""

    __slots__ = ("heads", "lengths", "next", "paths")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.paths: Node | None = None
        self.heads: dict[str, tuple[int, str, str]] = {}
        self.lengths: set[int] = set()


def build_trie(rules: Iterable[Rule]) -> Node:
    root = Node()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node.next.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *whole, head = path.split("/")
        for segment in whole:
            node = node.next.setdefault(segment, Node())
        entry = (len(host) + len(path), host + path, verdict)
        node.lengths.add(len(head))
        if head not in node.heads or verdict == "block":
            node.heads[head] = entry
    return root


def match(root: Node, host: str, path: str) -> tuple[int, str, str] | None:
    """The longest rule that fits: (length, rule, verdict)."""
    best: tuple[int, str, str] | None = None
    if not host:
        return None
    segments = path.split("/")
    node: Node | None = root
    for label in reversed(host.split(".")):
        node = node.next.get(label)
        if node is None:
            break
        if (at := node.paths) is None:
            continue
        for segment in segments:
            # Heads are found by their lengths, not one by one.
            for n in at.lengths:
                e = at.heads.get(segment[:n]) if n <= len(segment) else None
                if e and (best is None or (e[0], e[2] == "block") > (best[0], best[2] == "block")):
                    best = e
            at = at.next.get(segment)
            if at is None:
                break
    return best


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """host, path, the deciding rule and the verdict of each row's url.

    Urls that no rule fits, null ones included, get a null rule and
    ``default``. Repeated rows are judged alike; no row is lost.
    """
    sc = pages.sparkSession.sparkContext
    tries = [sc.broadcast(build_trie(rules[k : k + TRIE_RULES])) for k in range(0, max(1, len(rules)), TRIE_RULES)]
    df = pages.select(pages[id_col].alias(id_col), pages[url_col].cast("string").alias("url"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = [t.value for t in tries]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [max((m for t in roots if (m := match(t, h, p))), key=lambda m: (m[0], m[2] == "block"), default=None) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([m and m[1] for m in found], pa.string()), pa.array([m[2] if m else default for m in found], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = dict(df.dtypes)[id_col]
    return df.mapInArrow(judged, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
