"""Module resolution and the import graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .joins import longest_prefix, small

# What may stand behind an import's base path, in order of preference.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".svelte", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.svelte")
PYTHON_ENDINGS = (".py", "/__init__.py")
#: The conditions of a package's export, in order of preference.
CONDITIONS = ("import", "default", "svelte", "types")


@dataclass(frozen=True)
class Alias:
    """An import pattern with at most one ``*``, what it stands for, and the
    folder whose files may use it (``""``: all)."""

    pattern: str
    targets: tuple[str, ...]
    base: str = ""
    root: str = ""


def alias_match(pattern: str, source: Column) -> Column:
    """What ``*`` stands for in ``source``: empty for an equal pattern without
    one, null where the pattern doesn't fit. Prefix and suffix don't overlap."""
    if "*" not in pattern:
        return F.when(source == pattern, F.lit(""))
    head, tail = pattern.split("*", 1)
    fits = source.startswith(head) & source.endswith(tail) & (F.length(source) >= len(head) + len(tail))
    return F.when(fits, F.substring(source, F.lit(len(head) + 1), F.length(source) - len(head) - len(tail)))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _joined(*parts: Column) -> Column:
    return text.normal_path(F.concat_ws("/", *parts))


def package_exports(manifests: DataFrame) -> DataFrame:
    """(package, subpath, export): what packages (name, manifest: JSON) offer under
    which subpath. ``exports`` is a path, which stands for the package itself,
    or an object of paths or of conditions with paths, of which the first in
    CONDITIONS counts. Anything else offers nothing."""
    text_ = F.from_json("manifest", "exports string")["exports"]
    entries = F.from_json(F.when(text_.startswith("{"), text_), "map<string,string>")
    either = lambda v: F.when(v.rlike(r"^[\[{]"), F.lit(None).cast("string")).otherwise(v)
    inner = F.from_json(F.when(F.col("value").startswith("{"), F.col("value")), "map<string,string>")
    path = F.coalesce(either(F.col("value")), *[either(inner[c]) for c in CONDITIONS])
    alone = manifests.where(~text_.rlike(r"^[\[{]")).select(F.col("name").alias("package"), F.lit("").alias("subpath"), text_.alias("export"))
    each = manifests.select("name", F.explode(entries)).where((F.col("key") == ".") | F.col("key").startswith("./"))
    each = each.select(F.col("name").alias("package"), F.regexp_replace("key", r"^\./?", "").alias("subpath"), path.alias("export"))
    return alone.unionByName(each).where("export is not null")


def python_resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (path, source) with ``target``, the file of the module.

    Leading dots count folders upward from the importing file, the first one
    its own. Without dots the module is looked up from the project's root and
    from the parent of each folder above the file that has an ``__init__``,
    the shortest such root first. A module is a file or a package's ``__init__``.
    """
    known = files.select("path").distinct()
    pairs = imports.select("path", "source").where("path is not null and source is not null").distinct()
    dots = F.length("source") - F.length(F.ltrim(F.col("source"), F.lit(".")))
    rest = F.translate(F.substring("source", F.col("dots") + 1, F.length("source")), ".", "/")
    pairs = pairs.withColumn("dots", dots).withColumn("module", rest)
    above = F.split(folder_of(F.col("path")), "/")
    kept = F.slice(above, 1, F.greatest(F.size(above) - F.col("dots") + 1, F.lit(0)))
    own = pairs.where("dots > 0").select("path", "source", F.lit(0).alias("step"), _joined(F.array_join(kept, "/"), F.col("module")).alias("base"))
    free = pairs.where("dots = 0")
    folders = free.select("path").distinct().select("path", F.explode(text.ancestors(F.col("path"))).alias("folder"))
    begun = folders.join(known.where(F.col("path").endswith("/__init__.py")).select(folder_of(F.col("path")).alias("folder")), "folder")
    roots = begun.select("path", folder_of(F.concat(F.lit("/"), "folder")).alias("root")).select("path", F.ltrim(F.col("root"), F.lit("/")).alias("root"))
    roots = roots.unionByName(free.select("path", F.lit("").alias("root"))).distinct()
    there = free.join(roots, "path").select("path", "source", F.length("root").alias("step"), _joined(F.col("root"), F.col("module")).alias("base"))
    each = own.unionByName(there).where("base <> ''").select("path", "source", "step", "base", F.posexplode(F.array(*[F.lit(e) for e in PYTHON_ENDINGS])).alias("place", "ending"))
    each = each.select("path", "source", "step", "place", F.concat("base", "ending").alias("target"))
    hit = each.join(known.select(F.col("path").alias("target")), "target").groupBy("path", "source").agg(F.min_by("target", F.struct("step", "place")).alias("target"))
    return imports.join(hit, ["path", "source"], "left")


def resolved(imports: DataFrame, files: DataFrame, packages: DataFrame, aliases: tuple[Alias, ...] = (), endings: tuple[str, ...] = ENDINGS, exports: DataFrame | None = None) -> DataFrame:
    """``imports`` (path, source) with ``resolution`` (relative, alias,
    workspace, external or unresolved), ``target`` and ``package``.

    Relative sources are looked up beside their file. Others try the aliases
    of the nearest root, then the package (name, root) of the longest name:
    its export (``exports``, of package_exports), path, ``src`` folder and
    index; what fits none is external, and what a Python file asks for, which
    ``python_resolved`` finds, unresolved. Every base path tries the endings in order. The different pairs
    are resolved once, by one join of their candidates with the files.
    """
    pairs = imports.select("path", "source").where("path is not null and source is not null").distinct()
    pairs = longest_prefix(pairs, packages.where("name <> ''"), "source", "name", out="package").join(small(packages.select(F.col("name").alias("package"), F.col("root").alias("__root"))), "package", "left")
    source, path = F.col("source"), F.col("path")
    relative, python = source.startswith("."), path.endswith(".py")
    bases, step = [F.when(relative, F.struct(F.lit(0).alias("step"), _joined(folder_of(path), source).alias("base")))], 0
    for alias in sorted(aliases, key=lambda a: -len(a.root)):
        mine = F.lit(True) if not alias.root else (path == alias.root) | path.startswith(alias.root + "/")
        star = alias_match(alias.pattern, source)
        for target in alias.targets:
            step += 1
            bases.append(F.when(~relative & mine & star.isNotNull(), F.struct(F.lit(step).alias("step"), _joined(F.lit(alias.base), F.replace(F.lit(target), F.lit("*"), star)).alias("base"))))
    first_package = step + 1
    rest = F.substring(source, F.length("package") + 2, F.length(source))
    if exports is not None:
        step += 1
        pairs = pairs.withColumn("subpath", rest).join(exports.select("package", "subpath", F.col("export").alias("__export")), ["package", "subpath"], "left")
        bases.append(F.when(~relative & F.col("__export").isNotNull(), F.struct(F.lit(step).alias("step"), _joined(F.col("__root"), F.col("__export")).alias("base"))))
    for inner, index in (("", "src/index"), ("src", "index")):
        step += 1
        place = F.when(rest == "", _joined(F.col("__root"), F.lit(index))).otherwise(_joined(F.col("__root"), F.lit(inner), rest))
        bases.append(F.when(~relative & F.col("package").isNotNull(), F.struct(F.lit(step).alias("step"), place.alias("base"))))
    each = pairs.where(~python).select("path", "source", F.explode(F.filter(F.array(*bases), lambda b: b.isNotNull())).alias("b"))
    ends = F.array(*[F.lit(e) for e in endings])
    each = each.select("path", "source", "b.step", "b.base", F.posexplode(ends).alias("place", "ending"))
    each = each.select("path", "source", "step", "place", F.concat("base", "ending").alias("target"))
    hit = each.join(files.select(F.col("path").alias("target")).distinct(), "target").groupBy("path", "source").agg(F.min_by(F.struct("step", "target"), F.struct("step", "place")).alias("hit"))
    known = pairs.join(hit, ["path", "source"], "left")
    step_, owner = F.col("hit.step"), F.col("package")
    how = F.when(python, "unresolved").when(relative, F.when(step_.isNotNull(), "relative").otherwise("unresolved")).when(step_ < first_package, "alias").when(owner.isNotNull(), "workspace").otherwise("external")
    known = known.select("path", "source", how.alias("resolution"), F.col("hit.target").alias("target"), F.when(how == "workspace", owner).alias("package"))
    return imports.join(known, ["path", "source"], "left")


def import_graph(imports: DataFrame, files: DataFrame, packages: DataFrame, aliases: tuple[Alias, ...] = (), exports: DataFrame | None = None) -> DataFrame:
    """Resolved imports with the packages of both ends and the relative depth.
    A file's package is the one of the longest root above it."""
    roots = packages.select(F.col("root").alias("__owner"), F.col("name").alias("__name"))
    known = resolved(imports, files, packages, aliases, exports=exports)

    def owned(df: DataFrame, path: str, out: str) -> DataFrame:
        owners = longest_prefix(df.select(path).where(F.col(path).isNotNull()).distinct(), packages, path, "root", out="__owner").join(small(roots), "__owner", "left")
        return df.join(owners.select(path, F.col("__name").alias(out)), path, "left")

    df = owned(owned(known, "path", "from_package"), "target", "__to")
    return df.withColumn("to_package", F.coalesce("package", "__to")).withColumn("depth", text.relative_depth(F.col("source"))).drop("package", "__to")


def repo_graph(edges: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(source, relation, target, n): packages that hold files, files that
    import files and packages that import packages, from ``import_graph``.
    Built anew from its inputs, so it never holds an edge of an older state."""
    held = longest_prefix(files.select("path").distinct(), packages, "path", "root", out="__root").join(small(packages.select(F.col("root").alias("__root"), "name")), "__root")
    holds = held.select(F.concat(F.lit("package:"), "name").alias("source"), F.lit("holds").alias("relation"), F.concat(F.lit("file:"), "path").alias("target"), F.lit(1).cast("long").alias("n"))
    pair = lambda kind, a, b: edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).groupBy(F.concat(F.lit(kind), a).alias("source"), F.concat(F.lit(kind), b).alias("target")).agg(F.count(F.lit(1)).alias("n")).select("source", F.lit("imports").alias("relation"), "target", "n")
    return holds.unionByName(pair("file:", "path", "target")).unionByName(pair("package:", "from_package", "to_package"))
