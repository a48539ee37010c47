"""File, JSON, log and report sources, and versioned tables as sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import globs, text

SARIF = "runs array<struct<tool: struct<driver: struct<name: string>>, results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int>>>>>>>>"


def discovered(spark: SparkSession, root: str, patterns: list[str], most_kb: int = 512, most_files: int = 20_000) -> DataFrame:
    """Files under ``root`` that the globs admit: path, size, content. Larger
    ones than ``most_kb`` are left out; too many are an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^\\Q" + root.rstrip("/") + "/\\E", "")
    rows = raw.select(rel.alias("path"), F.col("length").alias("size"), "content").where(globs.matches(F.col("path"), patterns) & (F.col("size") <= most_kb * 1024))
    if rows.select("path").limit(most_files + 1).count() > most_files:
        raise ValueError(f"over {most_files} files")
    return rows


def snapshot(files: DataFrame) -> DataFrame:
    """Path, SHA-256, bytes and text; what is no UTF-8 is left out."""
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), "size", body.alias("text"), text.language_of(F.col("path")).alias("language")).where("text is not null")


def loose_json(rows: DataFrame, body: str, schema: str) -> DataFrame:
    """JSON with comments and trailing commas in ``parsed`` (null if it is none)."""
    bare = F.regexp_replace(body, r'("(?:\\.|[^"\\])*")|/\*[\s\S]*?\*/|//[^\n]*', "$1")
    bare = F.regexp_replace(bare, r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', "$1")
    return rows.withColumn("parsed", F.from_json(bare, schema))


def strict_json(rows: DataFrame, body: str, schema: str) -> DataFrame:
    """JSON in ``parsed``, with ``broken`` where it is none."""
    return rows.withColumn("parsed", F.from_json(body, schema + ", _corrupt_record string", {"mode": "PERMISSIVE"})).withColumn("broken", F.col("parsed._corrupt_record").isNotNull())


def commits(rows: DataFrame, line: str = "value") -> DataFrame:
    """Log lines of short hash, hash, time, date, author and subject, parted by tabs."""
    f = F.split(line, "\t", 6)
    return rows.where(F.size(f) == 6).select(f[0].alias("short"), f[1].alias("hash"), f[2].try_cast("long").alias("committed_at"), f[3].alias("date"), f[4].alias("author"), f[5].alias("subject"))


def file_history(rows: DataFrame, line: str = "value", path: str = "path", order: str = "ordinal", most: int = 5) -> DataFrame:
    """The newest ``most`` commits of each file: lines of short hash, hash,
    date, author and subject, parted by tabs; a subject may hold tabs.
    ``order``: the place of a line in the file's log, newest first."""
    f = F.split(line, "\t", 5)
    good = rows.where(F.size(f) == 5).withColumn("__n", F.row_number().over(W.partitionBy(path).orderBy(order))).where(F.col("__n") <= most)
    return good.select(path, *[f[i].alias(n) for i, n in enumerate(("short", "hash", "date", "author", "subject"))])


def sarif(rows: DataFrame, body: str) -> DataFrame:
    """Findings of SARIF reports, a row for each location."""
    runs = rows.select(F.explode(F.from_json(body, SARIF)["runs"]).alias("run"))
    results = runs.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    at = results.select("tool", "r.ruleId", "r.level", F.col("r.message.text").alias("message"), F.explode_outer("r.locations").alias("l"))
    return at.select("tool", F.col("ruleId").alias("rule_id"), F.coalesce("level", F.lit("warning")).alias("severity"), "message", F.col("l.physicalLocation.artifactLocation.uri").alias("file"), F.col("l.physicalLocation.region.startLine").alias("line"), F.col("l.physicalLocation.region.startColumn").alias("column"))


_DIAGNOSTIC = "file string, line int, column int, message string, severity string, code string"


def diagnostics_json(rows: DataFrame, body: str) -> DataFrame:
    """Findings (file, line, column, message, severity, code) of tools that
    print JSON: an array, an object with the array in ``diagnostics``, or a
    line of JSON for each. What has no message is left out; no severity is a warning."""
    text = F.trim(F.col(body))
    nested = F.from_json(F.when(text.startswith("{") & ~F.contains(text, F.lit("\n")), text), f"diagnostics array<struct<{', '.join(x.replace(' ', ':') for x in _DIAGNOSTIC.split(', ')) }>>")["diagnostics"]
    listed = F.from_json(F.when(text.startswith("["), text), f"array<struct<{', '.join(x.replace(' ', ':') for x in _DIAGNOSTIC.split(', ')) }>>")
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, _DIAGNOSTIC))
    each = rows.select(F.explode(F.when(text.startswith("["), listed).when(nested.isNotNull(), nested).otherwise(lines)).alias("d")).select("d.*")
    return each.where("message is not null").withColumn("severity", F.coalesce("severity", F.lit("warning")))


def definition_files(rows: DataFrame, path: str, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The entries of definition files (path, body: a JSON array) as rows of
    ``schema`` behind their path, and (path, problem) of files that hold none."""
    entries = F.from_json(F.when(F.trim(body).startswith("["), F.col(body)), f"array<struct<{schema}>>")
    good = rows.select(path, F.explode(entries).alias("e")).select(path, "e.*")
    problem = F.when(F.try_parse_json(body).isNull(), "could not be parsed").when(~F.trim(body).startswith("["), "must contain an array")
    return good, rows.select(path, problem.alias("problem")).where("problem is not null")


def diagnostic_lines(rows: DataFrame, line: str, pattern: str, fields: list[str]) -> DataFrame:
    """Fields of a regular expression's groups, of the lines that it fits."""
    return rows.where(F.col(line).rlike(pattern)).select(*[F.regexp_extract(line, pattern, i + 1).alias(f) for i, f in enumerate(fields)])


def changed_paths(*lists: DataFrame) -> DataFrame:
    """Different paths of all lists, in order."""
    out = lists[0].select("path")
    for df in lists[1:]:
        out = out.union(df.select("path"))
    return out.distinct().orderBy("path")


def generated(spark: SparkSession, n: int, kb: int = 1) -> DataFrame:
    """n source files of about ``kb`` KiB for benchmarks."""
    body = F.concat(F.format_string("# module %d\n", "id"), F.repeat(F.format_string("def f_%d(x):\n    return x + %d\n", "id", "id"), kb * 24))
    return spark.range(n).select(F.format_string("src/pkg_%d/mod_%d.py", F.col("id") % 100, "id").alias("path"), body.alias("text"))


class VersionedTable:
    """Parquet versions of a table behind a pointer that is written last; so a
    reader sees the old or the new version, and a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def revision(self) -> tuple[int, str] | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_pointer")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        row = self.spark.read.json(f"{self.root}/_pointer", schema="revision long, version string").orderBy(F.desc("revision")).first()
        return (row["revision"], row["version"]) if row else None

    def read(self) -> DataFrame:
        found = self.revision()
        if not found:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/{found[1]}")

    def publish(self, df: DataFrame, revision: int, expected_rows: int | None = None) -> None:
        """Revisions must increase; a count other than expected is refused."""
        now = self.revision()
        if now and revision <= now[0]:
            raise ValueError(f"revision {revision} is not after {now[0]}")
        version = f"rev-{revision}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{version}")
        if expected_rows is not None and self.spark.read.parquet(f"{self.root}/{version}").count() != expected_rows:
            raise ValueError("the number of rows is not as expected")
        self.spark.createDataFrame([(revision, version)], "revision long, version string").coalesce(1).write.mode("append").json(f"{self.root}/_pointer")
