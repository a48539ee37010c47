"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which rows match and so are stated as they must be.
STOP_WORDS = ("a", "an", "and", "are", "as", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "where", "with")
VERB_WORDS = ("get", "set", "load", "fetch", "read", "write", "create", "update", "delete", "remove", "handle", "process", "do")
SECRET_PATTERNS = (
    r"^(?:sk|pk|rk|ghp|gho|github_pat|xox[baprs])_[A-Za-z0-9_-]{16,}$",
    r"^AKIA[0-9A-Z]{16}$",
    r"^AIza[0-9A-Za-z_-]{20,}$",
    r"^-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"^[A-Za-z0-9+/]{40,}={0,2}$",
    r"(?i)^[0-9a-f]{48,}$",
)
SECRET_NAME = r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd|private[_-]?key|client[_-]?secret|access[_-]?key|session[_-]?secret|jwt)\b"
PLACEHOLDER = r"(?i)^(?:<[^>]+>|\{\{[^}]+\}\}|example|sample|test|dummy|placeholder|redacted|changeme|your[-_a-z0-9]*|[a-z-]*token)$"
NAMING_STYLES = (
    ("pascal", r"^[A-Z][A-Za-z0-9]*$"),
    ("camel", r"^[a-z][A-Za-z0-9]*$"),
    ("kebab", r"^[a-z0-9]+(?:-[a-z0-9]+)*$"),
    ("snake", r"^[a-z0-9]+(?:_[a-z0-9]+)*$"),
    ("screaming", r"^[A-Z0-9]+(?:_[A-Z0-9]+)*$"),
)
LANGUAGES = {"tsx": "tsx", "jsx": "jsx", "py": "python", "svelte": "svelte", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "md": "markdown", "json": "json"}


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stable_hash(*fields: Column) -> Column:
    """Of a record: null fields count, in the given order."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def preview(text: Column, most: int = 240) -> Column:
    """One line of at most ``most`` characters."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("..."))).otherwise(line)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def rank_text(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def rank_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def rank_terms(text: Column) -> Column:
    """Words of three characters and more that are no stop words."""
    return F.filter(F.split(rank_text(text), " "), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def pair_slugs(terms: Column) -> Column:
    """Every two neighbouring terms as one."""
    return F.when(F.size(terms) > 1, F.transform(F.sequence(F.lit(0), F.size(terms) - 2), lambda i: F.concat(F.get(terms, i), F.get(terms, i + 1)))).otherwise(F.array().cast("array<string>"))


def identifier_words(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def identifier_key(name: Column) -> Column:
    """A name without case, separators and common verbs."""
    spaced = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.regexp_replace(F.regexp_replace(spaced, rf"\b(?:{'|'.join(VERB_WORDS)})\b", ""), "[^a-z0-9]+", "")


def key_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 0 where one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, base 2; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


# What is a local address and so no secret, and the least length of a secret known by its name.
LOCALHOST = r"^(?:localhost|127\.0\.0\.1)$|^http://(?:127\.0\.0\.1|localhost)"
NAMED_CHARS = 8


def secret_like(name: Column, value: Column) -> Column:
    """By the words of its name, by a known pattern, or long, mixed and of high
    entropy; placeholders are none. A name counts for values of NAMED_CHARS
    characters and more that are no local address."""
    named = identifier_words(name).rlike(SECRET_NAME) & (F.length(value) >= NAMED_CHARS) & ~value.rlike(LOCALHOST)
    mixed = (F.length(value) >= 32) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(r"\s") & (entropy(value) >= 3.5)
    return ~value.rlike(PLACEHOLDER) & (F.coalesce(named, F.lit(False)) | any_match(value, SECRET_PATTERNS) | mixed)


def config_kind(value: Column) -> Column:
    """url, host, port, path or null, the first that fits."""
    port = F.when(value.rlike(r"^\d{4,5}$"), value.try_cast("int"))
    path = (F.length(value) >= 4) & (value.rlike(r"^(?:\.{0,2}/|~/|/)[A-Za-z0-9._/-]+$") | (value.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._/-]+$") & ~value.startswith("docs/")))
    return (
        F.when(value.rlike("(?i)^https?://[^\\s\"'`]+$"), "url")
        .when(value.rlike(r"^(?:localhost|127(?:\.\d{1,3}){3}|0\.0\.0\.0|::1)$"), "host")
        .when(port.between(1024, 65535), "port")
        .when(path, "path")
    )


def naming_styles(name: Column) -> Column:
    """All styles that a name has."""
    return F.filter(F.array(*[F.when(name.rlike(p), F.lit(k)) for k, p in NAMING_STYLES]), lambda x: x.isNotNull())


def language_of(path: Column) -> Column:
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.coalesce(*[F.when(ending == k, F.lit(v)) for k, v in LANGUAGES.items()], F.when(ending.isin("ts", "mts", "cts"), F.lit("typescript")), F.lit("text"))


def annotation_tags(text: Column) -> Column:
    """All ``@tag`` names, lower-cased, other characters as hyphens."""
    tags = F.regexp_extract_all(text, F.lit(r"@([A-Za-z][\w-]*)"), F.lit(1))
    return F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-|-$", ""))


def imported_name(specifier: Column) -> Column:
    return F.trim(F.get(F.split(F.regexp_replace(specifier, r"^type\s+", ""), r"\s+as\s+"), F.lit(0)))


def sibling(path: Column, template: str) -> Column:
    """A file beside ``path``: {name}, {stem} and {ext} stand for its parts."""
    folder, name = F.regexp_extract(path, "^(.*/)?[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".\.([^.]*)$", 1)
    out = F.lit(template)
    for mark, part in (("{name}", name), ("{stem}", stem), ("{ext}", ext)):
        out = F.replace(out, F.lit(mark), part)
    return F.concat(F.coalesce(folder, F.lit("")), out)


def is_barrel(path: Column) -> Column:
    return path.rlike(r"(^|/)index\.(ts|tsx|js|jsx|svelte)$")


def fuzzy_score(query: str, *fields: Column) -> Column:
    """100 equal, 80 prefix, 60 inside, at least 10 as a subsequence; best of the fields."""
    needle = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    if not needle:
        return F.lit(1)
    # Each letter's first place behind the one before; a regular expression that never goes back.
    scattered = "^" + "".join(f"[^{c}]*{c}" for c in needle)

    def one(field: Column) -> Column:
        v = rank_slug(field)
        return F.coalesce(F.when(v == needle, 100).when(v.startswith(needle), 80).when(v.contains(needle), 60).when(v.rlike(scattered), F.greatest(F.lit(10), 40 - (F.length(v) - len(needle)))), F.lit(0))

    scores = [one(f) for f in fields]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def relative_depth(source: Column) -> Column:
    """Steps upward in a relative import."""
    return F.when(source.startswith("."), F.size(F.filter(F.split(source, "/"), lambda x: x == ".."))).otherwise(0)


def normal_path(path: Column) -> Column:
    """A path without ``.`` and with ``..`` taken back."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when((F.size(acc) == 0) | (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) == ".."), F.concat(acc, F.array(x))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
    return F.array_join(kept, "/")


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def trace_sampled(trace_id: Column, ratio: float) -> Column:
    """Whether the low 56 bits of a trace id are below ratio times their range."""
    return F.conv(F.right(trace_id, F.lit(14)), 16, 10).cast("decimal(20,0)") < int(ratio * (1 << 56))
