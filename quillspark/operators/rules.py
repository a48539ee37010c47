"""Rules over fact tables. A rule is a function of a context of DataFrames and
gives findings of one schema."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import globs, text
from .cuts import cut

COLUMNS = ("rule_id", "severity", "file", "line", "column", "message")
# What counts as a comment that switches a check off, and as a reason.
BYPASS = (
    r"\beslint-disable(?:-next-line|-line)?\b",
    r"\bbiome-ignore\b",
    r"\boxlint-disable\b",
    r"@ts-(?:ignore|expect-error|nocheck)\b",
    r"\bnoqa\b",
    r"\btype:\s*ignore\b",
    r"\bpylint:\s*disable\b",
    r"\bno-verify\b",
    r"\bpragma:\s*no\s+cover\b",
)
BYPASS_REASON = r"(?i)\b(?:reason|because|ticket|issue|approved|expires|owner)\b.{3,}"

Rule = Callable[["Context"], DataFrame]


@dataclass
class Context:
    """The tables that rules read: files (path, text), literals (file, line,
    column, name, value, value_kind), symbols (file, line, name, kind,
    exported, params), imports (file, line, source, resolved, specifiers),
    comments (file, line, text), calls (file, line, name), edges (source, target)."""

    tables: dict[str, DataFrame]
    targets: list[str] = field(default_factory=lambda: ["**"])

    def __getattr__(self, name: str) -> DataFrame:
        try:
            df = self.tables[name]
        except KeyError:
            raise AttributeError(name) from None
        path = "path" if "path" in df.columns else "file"
        return df if self.targets == ["**"] or path not in df.columns else df.where(globs.matches(F.col(path), self.targets))


def findings(df: DataFrame, rule_id: str, message: Column, severity: Column | str = "error", file: str = "file") -> DataFrame:
    at = lambda c: F.col(c).cast("int") if c in df.columns else F.lit(None).cast("int")
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(rule_id).alias("rule_id"), level.alias("severity"), F.col(file).alias("file"), at("line").alias("line"), at("column").alias("column"), message.alias("message"))


def file_names(allowed: str) -> Rule:
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return lambda c: findings(c.files.where(~name.rlike(allowed)), "file-names", F.concat(F.lit("name not allowed: "), name), file="path")


def required_param(param: str, place: str = "any") -> Rule:
    params = F.col("params")
    fits = {"any": F.array_contains(params, param), "first": F.try_element_at(params, F.lit(1)) == param, "last": F.try_element_at(params, F.lit(-1)) == param}[place]
    return lambda c: findings(c.symbols.where((F.col("kind") == "function") & ~F.coalesce(fits, F.lit(False))), "required-param", F.concat(F.col("name"), F.lit(f" lacks the parameter {param}")))


def required_sibling(template: str) -> Rule:
    def rule(c: Context) -> DataFrame:
        want = c.files.select("path", text.sibling(F.col("path"), template).alias("want"))
        gone = want.join(c.tables["files"].select(F.col("path").alias("want")).distinct(), "want", "left_anti")
        return findings(gone, "required-sibling", F.concat(F.lit("missing "), F.col("want")), file="path")

    return rule


def required_export(pattern: str) -> Rule:
    def rule(c: Context) -> DataFrame:
        good = c.symbols.where(F.col("exported") & F.col("name").rlike(pattern)).select(F.col("file").alias("path")).distinct()
        return findings(c.files.join(good, "path", "left_anti"), "required-export", F.lit(f"no export like {pattern}"), file="path")

    return rule


def unused_exports(c: Context) -> DataFrame:
    used = c.tables["edges"].select(F.col("target").alias("id")).distinct()
    return findings(c.symbols.where("exported").join(used, "id", "left_anti"), "unused-exports", F.concat(F.lit("never used: "), F.col("name")), "warning")


def native_enums(c: Context) -> DataFrame:
    return findings(c.symbols.where("kind = 'enum'"), "native-enums", F.concat(F.lit("enum "), F.col("name")))


def repeated_literals(least: int = 3, least_files: int = 1) -> Rule:
    def rule(c: Context) -> DataFrame:
        from .rollups import repeated

        agg = repeated(c.literals, ["value_kind", "value"], "file", ["file", "line", "column"], least, least_files)
        return findings(agg.select("value", "n", "first.*"), "repeated-literals", F.concat_ws(" ", F.lit("repeated"), "n", F.lit("times:"), text.truncated(F.col("value"), 60)), "warning")

    return rule


def secret_literals(c: Context) -> DataFrame:
    hit = c.literals.where((F.col("value_kind") == "string") & text.secret_like(F.col("name"), F.col("value")))
    return findings(hit, "secret-literals", F.concat(F.lit("secret-like value for "), F.coalesce("name", F.lit("a literal"))))


def config_literals(c: Context) -> DataFrame:
    kind = text.config_kind(F.col("value"))
    return findings(c.literals.where((F.col("value_kind") == "string") & kind.isNotNull()), "config-literals", F.concat(F.lit("hard-coded "), kind), "warning")


def restricted_symbols(names: list[str]) -> Rule:
    def rule(c: Context) -> DataFrame:
        each = c.imports.withColumn("name", F.explode("specifiers")).withColumn("name", text.imported_name(F.col("name")))
        return findings(each.where(F.col("name").isin(*names)).distinct(), "restricted-symbols", F.concat(F.lit("restricted: "), F.col("name")))

    return rule


def import_boundary(from_globs: list[str], deny: list[str], allow: list[str] | None = None) -> Rule:
    to = F.coalesce("resolved", "source")
    bad = globs.matches(F.col("file"), from_globs) & globs.matches(to, deny)
    if allow:
        bad &= ~globs.matches(to, allow)
    return lambda c: findings(c.imports.where(bad), "import-boundary", F.concat(F.lit("must not import "), to))


def deep_imports(most: int) -> Rule:
    return lambda c: findings(c.imports.where(text.relative_depth(F.col("source")) > most), "deep-imports", F.concat(F.lit("too deep: "), F.col("source")))


def barrel_imports(c: Context) -> DataFrame:
    folder = lambda x: F.regexp_extract(F.col(x), "^(.*/)?[^/]*$", 1)
    return findings(c.imports.where(text.is_barrel(F.col("resolved")) & (folder("file") != folder("resolved"))), "barrel-imports", F.concat(F.lit("through a barrel: "), F.col("resolved")))


def forbidden_calls(pattern: str) -> Rule:
    return lambda c: findings(c.calls.where(F.col("name").rlike(pattern)), "forbidden-calls", F.concat(F.lit("forbidden call: "), F.col("name")))


def comment_matches(pattern: str) -> Rule:
    return lambda c: findings(c.comments.where(F.col("text").rlike(pattern)), "comment-matches", F.lit("comment not allowed"))


def bypass_comments(c: Context) -> DataFrame:
    return findings(c.comments.where(text.any_match(F.col("text"), BYPASS) & ~F.col("text").rlike(BYPASS_REASON)), "bypass-comments", F.lit("check switched off without a reason"))


def header_comments(most: int = 12) -> Rule:
    def rule(c: Context) -> DataFrame:
        lines = c.files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line_text"))
        code = lines.where(~F.col("line_text").rlike(r"^\s*($|//|#|/\*|\*)")).groupBy("path").agg(F.min("n").alias("code"))
        early = c.comments.join(code.select(F.col("path").alias("file"), "code"), "file", "left").where((F.col("line") <= most) & (F.col("line") - 1 < F.coalesce("code", F.lit(1 << 30))))
        return findings(early, "header-comments", F.lit("comment before the first code"))

    return rule


def shim_files(c: Context) -> DataFrame:
    return findings(c.files.where(F.col("path").rlike(r"(?i)(^|[/._-])(shims?|compat|legacy)([/._-]|$)")), "shim-files", F.lit("shim file"), file="path")


def required_tags(when: str, need: list[str]) -> Rule:
    def rule(c: Context) -> DataFrame:
        tags = c.comments.select("file", "line", F.explode(text.annotation_tags(F.col("text"))).alias("tag")).groupBy("file", "line").agg(F.collect_set("tag").alias("tags"))
        lack = F.array_except(F.array(*[F.lit(t) for t in need]), "tags")
        return findings(tags.where(F.array_contains("tags", when) & (F.size(lack) > 0)), "required-tags", F.concat(F.lit("missing tags: "), F.array_join(F.sort_array(lack), ", ")))

    return rule


def folder_names(banned: list[str]) -> Rule:
    return lambda c: findings(c.files.where(F.arrays_overlap(F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/"), F.array(*[F.lit(b) for b in banned]))), "folder-names", F.lit("folder name not allowed"), file="path")


def bare_except(c: Context) -> DataFrame:
    lines = c.files.where(F.col("path").endswith(".py")).select("path", F.posexplode(F.split("text", "\n")).alias("n", "code"))
    return findings(lines.where(F.col("code").rlike(r"^\s*except\s*:")).withColumn("line", F.col("n") + 1), "bare-except", F.lit("bare except"), file="path")


def migration_references(pattern: str, baseline: DataFrame) -> Rule:
    """Known places (in ``baseline``: file, line) are warnings, new ones errors."""

    def rule(c: Context) -> DataFrame:
        lines = c.files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "code")).where(F.col("code").rlike(pattern)).withColumn("line", F.col("n") + 1)
        known = lines.join(baseline.select("file", "line").distinct().withColumn("known", F.lit(True)), ["file", "line"], "left")
        return findings(known, "migration-references", F.lit("old reference"), F.when(F.col("known"), "warning").otherwise("error"))

    return rule


REGISTRY: dict[str, Rule] = {
    "unused-exports": unused_exports,
    "native-enums": native_enums,
    "repeated-literals": repeated_literals(),
    "secret-literals": secret_literals,
    "config-literals": config_literals,
    "bypass-comments": bypass_comments,
    "barrel-imports": barrel_imports,
    "shim-files": shim_files,
    "bare-except": bare_except,
}


def run(context: Context, rules: dict[str, Rule] | None = None) -> DataFrame:
    """All findings of all rules, in their fixed order. A rule that can't be
    planned gives one finding of its own name and error, and stops no other."""
    rules = REGISTRY if rules is None else rules
    spark = next(iter(context.tables.values())).sparkSession

    def made(name: str, rule: Rule) -> DataFrame:
        try:
            found = rule(context)
            found.schema  # noqa: B018  the plan is checked here
            return found
        except Exception as error:
            head = spark.range(1).withColumn("file", F.lit(None).cast("string"))
            return findings(head, name, F.lit(f"the rule failed: {str(error).splitlines()[0]}"))

    return in_order(reduce(DataFrame.unionByName, [made(name, rule) for name, rule in rules.items()]))


OUTCOMES = "rule_id string, outcome string, n_findings long, seconds double, error string"


def run_apart(context: Context, rules: dict[str, Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """All findings of all rules, and a row for each rule on how it went:
    ``passed``, ``findings`` or ``error``, with its findings, seconds and error.

    Each rule is a job of its own whose findings are written before the next
    rule runs. One that fails on the way, in a task too, leaves no findings
    but an error, and stops no other. Outcomes come by rule.
    """
    rules = REGISTRY if rules is None else rules
    spark = next(iter(context.tables.values())).sparkSession
    written, outcomes = [], []
    for name, rule in rules.items():
        began = time.monotonic()
        try:
            found = cut(rule(context).select(*COLUMNS))
            n = found.count()
            written.append(found)
            outcomes.append((name, "findings" if n else "passed", n, time.monotonic() - began, None))
        except Exception as error:  # noqa: BLE001  whatever a rule does is its own
            said = next((x for x in str(error).splitlines() if x.strip()), type(error).__name__)
            outcomes.append((name, "error", 0, time.monotonic() - began, said))
    none = spark.createDataFrame([], "rule_id string, severity string, file string, line int, column int, message string")
    return reduce(DataFrame.unionByName, written, none), spark.createDataFrame(outcomes, OUTCOMES).orderBy("rule_id")


def in_order(found: DataFrame) -> DataFrame:
    """Findings by file, line, column, rule and message; no line or column counts as 0."""
    return found.orderBy("file", F.coalesce("line", F.lit(0)), F.coalesce("column", F.lit(0)), "rule_id", "message")


def finding_key() -> Column:
    return F.concat_ws("\0", "rule_id", "file", F.coalesce(F.col("line").cast("string"), F.lit("")), "message")


def write_baseline(found: DataFrame, target: str) -> None:
    """All current findings with their keys, as lines of JSON under ``target``;
    what was there is replaced. ``known_findings`` reads it."""
    found.select(finding_key().alias("key"), "rule_id", "file", "line", "message").write.mode("overwrite").json(target)


def known_findings(spark: SparkSession, target: str) -> DataFrame:
    """The findings (key) of a baseline; lines without a key count for nothing."""
    return spark.read.schema("key string, rule_id string, file string, line int, message string").json(target).where("key is not null")


def with_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """``found`` with ``known``: whether its key is in ``baseline`` (key)."""
    return found.withColumn("key", finding_key()).join(baseline.select("key", F.lit(True).alias("known")).distinct(), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.withColumn("key", finding_key()).join(seen.select("key").distinct(), "key", "left_anti")


def overlapping_fixes(edits: DataFrame) -> DataFrame:
    """Edits (file, start, end) that begin before an earlier one ends."""
    before = F.max("end").over(W.partitionBy("file").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    return edits.withColumn("overlaps", F.coalesce(before > F.col("start"), F.lit(False)))


def gates(found: DataFrame, approvals: DataFrame, key: list[str]) -> DataFrame:
    """Gates with ``approved``: an approval of the same key exists (null-safe)."""
    ok = approvals.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct().withColumn("__ok", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return found.join(ok, on, "left").withColumn("approved", F.coalesce("__ok", F.lit(False))).drop("__ok", *[f"__{k}" for k in key])


def selected(validators: DataFrame, ids: list[str] | None = None, topics: list[str] | None = None, conventions: list[str] | None = None) -> DataFrame:
    """Validators (id, topics, conventions) named by id, by a topic or by a convention; all, if nothing is asked for."""
    tests = []
    if ids:
        tests.append(F.col("id").isin(*ids))
    for column, wanted in (("topics", topics), ("conventions", conventions)):
        if wanted:
            tests.append(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted])))
    return validators.where(reduce(lambda a, b: a | b, tests)) if tests else validators


def widened(files: DataFrame, targets: DataFrame, analysis: list[str]) -> DataFrame:
    """The target files (path) and all that the analysis globs fit."""
    return targets.select("path").union(files.where(globs.matches(F.col("path"), analysis)).select("path")).distinct()


def boundary_literals(least: int = 3, least_files: int = 1, ignore: tuple[str, ...] = ()) -> Rule:
    """String values with a letter or digit that occur often in the targets."""

    def rule(c: Context) -> DataFrame:
        from .literals import ignored
        from .rollups import repeated

        rows = c.literals.where((F.col("value_kind") == "string") & F.col("value").rlike("[A-Za-z0-9]") & ~ignored(F.col("value"), list(ignore)))
        agg = repeated(rows, ["value"], "file", ["file", "line", "column"], least, least_files)
        return findings(agg.select("value", "n", "n_files", "first.*"), "boundary-literals", F.concat(F.lit("appears "), "n", F.lit(" times in "), "n_files", F.lit(" files")), "warning")

    return rule


def sensitive_changes(surfaces: dict[str, list[str]], require: dict[str, list[str]], need: str) -> Rule:
    """For each surface that asks for ``need`` (approval, tests or docs) and
    that changed files (table ``changed``: path) touch, a finding at the first of them."""

    def rule(c: Context) -> DataFrame:
        from .joins import glob_join

        asking = {k: v for k, v in surfaces.items() if need in require.get(k, [])}
        if not asking:
            return findings(c.tables["changed"].where("false"), "sensitive-changes", F.lit(""), file="path")
        first = glob_join(c.tables["changed"].select("path").distinct(), "path", asking, "surface").groupBy("surface").agg(F.min("path").alias("file"))
        return findings(first.withColumn("line", F.lit(1)), "sensitive-changes", F.concat(F.lit("surface "), "surface", F.lit(f" requires {need}")))

    return rule


def folder_structure(root: str, allowed: list[str]) -> Rule:
    """Folders right under ``root`` that aren't allowed."""
    pattern = f"^\\Q{root.rstrip('/')}/\\E([^/]+)/"

    def rule(c: Context) -> DataFrame:
        rows = c.files.where(F.col("path").rlike(pattern)).withColumn("folder", F.regexp_extract("path", pattern, 1))
        bad = rows.where(~F.col("folder").isin(*allowed)).groupBy("folder").agg(F.min("path").alias("path"))
        return findings(bad, "folder-structure", F.concat(F.lit("folder not allowed: "), "folder"), file="path")

    return rule


def restricted_text(words: list[str]) -> Rule:
    """Restricted names anywhere in a text, as whole words."""
    pattern = r"\b(" + "|".join(rf"\Q{w}\E" for w in words) + r")\b"

    def rule(c: Context) -> DataFrame:
        lines = c.files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "code")).where(F.col("code").rlike(pattern))
        each = lines.select("file", (F.col("n") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)))).alias("name"))
        return findings(each, "restricted-text", F.concat(F.lit("restricted: "), "name"))

    return rule


def malformed(found: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Findings with ``problems``: what is wrong with their shape; those without any are left out."""
    tests = {
        "unknown rule": ~F.coalesce(F.col("rule_id").isin(*rule_ids), F.lit(False)),
        "invalid severity": ~F.coalesce(F.col("severity").isin("error", "warning"), F.lit(False)),
        "missing file": F.coalesce(F.col("file"), F.lit("")) == "",
        "invalid line": F.coalesce(F.col("line"), F.lit(0)) < 1,
        "missing message": F.coalesce(F.col("message"), F.lit("")) == "",
    }
    problems = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return found.withColumn("problems", problems).where(F.size("problems") > 0)


def fixed_texts(files: DataFrame, edits: DataFrame, safety: tuple[str, ...] = ("safe",)) -> DataFrame:
    """(path, text, n_edits) of the files that edits (file, start, end,
    replacement, safety) change. Files with edits that overlap are left as they
    are. Edits apply from the last to the first, so that offsets hold."""
    wanted = overlapping_fixes(edits.where(F.col("safety").isin(*safety)))
    lists = wanted.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement")), asc=False).alias("edits"), F.max("overlaps").alias("bad")).where("not bad")
    apply = lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["replacement"], F.substring(t, e["end"] + 1, F.length(t)))
    return files.join(lists, "path").select("path", F.aggregate("edits", F.col("text"), apply).alias("text"), F.size("edits").alias("n_edits"))
