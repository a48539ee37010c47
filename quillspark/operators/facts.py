"""Facts of Python sources: a small syntax walk in Arrow batches, tables from there on."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = "path string, fact string, name string, kind string, line int, column int, detail string, exported boolean"


def _facts(source: str) -> Iterator[tuple[str, str, str, int, int, str | None]]:
    """(fact, name, kind, line, column, detail) of one source."""
    depth: list[tuple[ast.AST, int]] = [(ast.parse(source), 0)]
    while depth:
        node, classes = depth.pop()
        inner = classes + isinstance(node, ast.ClassDef)
        depth += [(child, inner) for child in ast.iter_child_nodes(node)]
        at = (getattr(node, "lineno", 0), getattr(node, "col_offset", 0) + 1)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "symbol", node.name, "method" if classes else "function", *at, ",".join(a.arg for a in node.args.args)
        elif isinstance(node, ast.ClassDef):
            yield "symbol", node.name, "class", *at, None
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.asname or a.name, "module", *at, a.name
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield "import", a.asname or a.name, "name", *at, "." * node.level + (node.module or "")
        elif isinstance(node, ast.Call):
            target = node.func
            name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
            if name:
                yield "call", name, "call", *at, ast.unparse(target)[:200]
        elif isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float)) and not isinstance(node.value, bool):
            yield "literal", str(node.value), "string" if isinstance(node.value, str) else "number", *at, None


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, text); a source that can't be parsed gives one diagnostic."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["text"]):
                try:
                    rows += [(path, f, n, k, line, col, d, f == "symbol" and not n.startswith("_")) for f, n, k, line, col, d in _facts(body or "")]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "diagnostic", type(e).__name__, "error", getattr(e, "lineno", None) or 1, 1, str(e)[:200], False))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(walk, SCHEMA)


def comments(files: DataFrame, mark: str = "#") -> DataFrame:
    """Line comments of files of any language: (file, line, text)."""
    rows = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "code"))
    return rows.where(F.col("code").rlike(rf"^\s*{mark}")).select("file", (F.col("n") + 1).alias("line"), F.trim(F.regexp_replace("code", rf"^\s*{mark}+", "")).alias("text"))


def reference_facts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Words of a file that are exported names of other files: one pass over
    the words and an equality join."""
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    names = symbols.where("exported").select("name", F.col("path").alias("defined_in")).distinct()
    return words.join(names, "name").where("path <> defined_in")


def tag_facts(found: DataFrame) -> DataFrame:
    """A row for each annotation tag of a comment (file, line, text)."""
    return found.select("file", "line", F.explode(text.annotation_tags(F.col("text"))).alias("tag"))
