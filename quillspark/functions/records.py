"""Identities, positions and payloads as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brackets nested deeper than this mark a text that no parser should get.
MOST_DEPTH = 1000


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON with keys in order; nulls count."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_hash(fields: Mapping[str, Column]) -> Column:
    return F.sha2(canonical_json(fields).cast("binary"), 256)


def finding_id(rule: Column, fields: Mapping[str, Column]) -> Column:
    """The rule's name and 16 hex digits of the finding's fields, in the given order."""
    body = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})
    return F.concat_ws(":", rule, F.left(F.sha2(body.cast("binary"), 256), F.lit(16)))


def fingerprint(rule: Column, severity: Column, file: Column, line: Column, column: Column, message: Column) -> Column:
    """What tells findings apart for feedback; no column counts as 0."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\0", text(rule), text(severity), text(file), text(line), text(F.coalesce(column, F.lit(0))), text(message)).cast("binary"), 256)


def naming_idiom(language: Column, role: Column, idioms: Mapping[tuple[str, str], str]) -> Column:
    """The naming style of a role in a language, null where none is set."""
    return F.coalesce(*[F.when((language == a) & (role == b), F.lit(style)) for (a, b), style in idioms.items()], F.lit(None).cast("string"))


def matches_with_columns(line: Column, pattern: str) -> Column:
    """All matches of a pattern in a line with the columns (from 1) at which
    they begin; the column is carried along in one pass."""
    found, between = F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.split(line, pattern)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<column:int,match:string>>").alias("out"))
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match")))
    step = lambda s, p: F.struct((s["at"] + p["gap"] + F.length(p["match"])).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + p["gap"]).alias("column"), p["match"].alias("match")))).alias("out"))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """The offset from 0 of a line and column (from 1); null outside the text."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line - 1, F.lit(0))), F.lit(0), lambda s, x: s + F.length(x) + 1)
    inside = (line >= 1) & (column >= 1) & (line <= F.size(lines)) & (column <= F.length(F.get(lines, F.greatest(line - 1, F.lit(0)))) + 1)
    return F.when(inside, before + column - 1)


def bracket_depth(text: Column) -> Column:
    """How deep brackets are nested at most; closing ones without an opening one don't count below 0."""
    marks = F.split(F.regexp_replace(text, r"[^(\[{)\]}]+", ""), "")
    step = lambda s, c: F.struct(
        F.when(c.rlike(r"[(\[{]"), s["now"] + 1).when(c.rlike(r"[)\]}]"), F.greatest(s["now"] - 1, F.lit(0))).otherwise(s["now"]).alias("now"),
        F.greatest(s["most"], F.when(c.rlike(r"[(\[{]"), s["now"] + 1).otherwise(s["now"])).alias("most"),
    )
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def too_deep(text: Column) -> Column:
    return bracket_depth(text) > MOST_DEPTH


def ordinal_of(payload: Column) -> Column:
    return F.get_json_object(payload, "$.ordinal").try_cast("int")


def json_items(payload: Column) -> Column:
    """The strings of a JSON array; none for what is no array."""
    return F.coalesce(F.from_json(payload, "array<string>"), F.array().cast("array<string>"))


def iso_before(a: Column, b: Column) -> Column:
    """Order of times in one ISO form (UTC, fixed digits): that of their characters."""
    return a < b


def is_hex_id(value: Column, digits: int) -> Column:
    """Lower-case hex of so many digits, not all 0: a trace (32) or span (16) id."""
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{digits}}}$") & ~value.rlike("^0+$"), F.lit(False))


def traceparent(trace: Column, span: Column, sampled: Column) -> Column:
    """The header of a trace, null where an id is bad."""
    return F.when(is_hex_id(trace, 32) & is_hex_id(span, 16), F.concat_ws("-", F.lit("00"), trace, span, F.when(sampled, "01").otherwise("00")))


def utf8_head(text: Column, most: int) -> Column:
    """The first ``most`` bytes, without a character that is cut."""
    raw = F.encode(text, "UTF-8")
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(most, 3) + 1)])


def utf8_tail(text: Column, most: int) -> Column:
    """The last ``most`` bytes, without a character that is cut."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    pieces = [F.try_validate_utf8(F.substring(raw, F.greatest(size - (most - k), F.lit(0)) + 1, F.lit(most)).cast("string")) for k in range(min(most, 3) + 1)]
    return F.coalesce(*pieces)
