"""Code graphs as three tables: nodes, references, edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuts import cut

DIRECTIONS = ("incoming", "outgoing", "both")


def edges_of(edges: DataFrame, node: Column, direction: str, limit: int | None = None) -> DataFrame:
    """Edges (source, target) into, out of, or at ``node``, an id; the first ``limit`` (1 to 1000) in order."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction: one of {', '.join(DIRECTIONS)}")
    into, out = F.col("target") == node, F.col("source") == node
    rows = edges.where({"incoming": into, "outgoing": out, "both": into | out}[direction])
    return rows if limit is None else rows.orderBy("source", "target").limit(max(1, min(limit, 1000)))


def described(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names and paths of both ends (inner joins on id)."""
    side = lambda p: nodes.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.col("path").alias(f"{p}_path"))
    return edges.join(side("source"), "source").join(side("target"), "target")


def resolve(references: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, target, how): the one node of the name in the reference's own
    file, else the one it imports, else the one of the whole project. Several
    nodes at one step are as none.

    ``references``: ref, path, name. ``nodes``: id, path, name, exported.
    ``imports``: path, name, target_path.
    """
    once = lambda df, by: df.groupBy(*by).agg(F.count("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    own = once(nodes, ["path", "name"]).withColumnRenamed("id", "own")
    # Nodes of a name in a file are counted before imports meet them, so that no import brings a row for each.
    exported = nodes.where("exported").groupBy(F.col("path").alias("target_path"), "name").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    met = imports.join(exported, ["target_path", "name"]).groupBy("path", "name").agg(F.sum("n").alias("n"), F.min("id").alias("via"))
    via = met.where("n = 1").drop("n")
    any_ = once(nodes, ["name"]).withColumnRenamed("id", "any")
    df = references.join(own, ["path", "name"], "left").join(via, ["path", "name"], "left").join(any_, "name", "left")
    how = F.when(F.col("own").isNotNull(), "same-file").when(F.col("via").isNotNull(), "import").when(F.col("any").isNotNull(), "project")
    return df.select("ref", F.coalesce("own", "via", "any").alias("target"), how.alias("how"))


def resolve_all(references: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, target, how) of references that may name the module they come from.

    A Python reference with a source has the one exported node of its name in
    the module, or for a whole module its only exported node, and nothing else
    is tried. Others have the one node of the name in their file, else the one
    target of the file's imports of that name, else the one of the project. A
    named import leads to the exported nodes of that name, a default one to the
    exported ``default`` or else the only exported node, others nowhere.

    ``references``: ref, path, name, kind, language, source, source_path (the
    module's file or null). ``nodes``: id, path, name, exported. ``imports``:
    path, name, kind, target_path.
    """
    once = lambda df, by: df.groupBy(*by).agg(F.count("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    offered = nodes.where("exported").select(F.col("path").alias("target_path"), "name", "id")
    sole = once(offered, ["target_path"])
    terminal = (F.col("language") == "python") & F.col("source").isNotNull()
    sourced = references.where(terminal).withColumn("target_path", F.col("source_path"))
    sourced = sourced.join(once(offered, ["target_path", "name"]).withColumnRenamed("id", "named"), ["target_path", "name"], "left").join(sole.withColumnRenamed("id", "sole"), "target_path", "left")
    module = sourced.select("ref", F.coalesce("named", F.when(F.col("kind") == "import-module", F.col("sole"))).alias("target")).withColumn("how", F.when(F.col("target").isNotNull(), "module"))
    default = offered.where("name = 'default'").select("target_path", "id")
    default = default.union(sole.join(default.select("target_path").distinct(), "target_path", "left_anti").select("target_path", "id"))
    named = imports.where("kind = 'import-named'").join(offered, ["target_path", "name"]).select("path", "name", "id")
    whole = imports.where("kind = 'import-default'").join(default, "target_path").select("path", "name", "id")
    via = once(named.union(whole), ["path", "name"]).withColumnRenamed("id", "via")
    own = once(nodes, ["path", "name"]).withColumnRenamed("id", "own")
    any_ = once(nodes, ["name"]).withColumnRenamed("id", "any")
    rest = references.where(~F.coalesce(terminal, F.lit(False))).join(own, ["path", "name"], "left").join(via, ["path", "name"], "left").join(any_, "name", "left")
    how = F.when(F.col("own").isNotNull(), "same-file").when(F.col("via").isNotNull(), "import").when(F.col("any").isNotNull(), "project")
    return module.union(rest.select("ref", F.coalesce("own", "via", "any").alias("target"), how.alias("how")))


def emitted(references: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the node around each resolved call or identifier to its
    target, without loops: the node of the same file that begins last before it."""
    from .joins import nearest

    inside = nodes.select("path", F.col("start_byte"), F.struct("start_byte", "ordinal", "id").alias("node"))
    used = references.where(F.col("kind").isin("call", "identifier")).join(resolved.where("target is not null"), "ref")
    found = nearest(used, inside, "path", "start_byte", "node", out="around")
    return found.where("around is not null and around.id <> target").select(F.col("around.id").alias("source"), "target", "kind").distinct()


def callers_without(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported nodes that nothing refers to."""
    return nodes.where("exported").join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def reach(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """Nodes within ``rounds`` steps of ``start`` (node), with the least number
    of steps. Each round joins what the last one found first."""
    seen = cut(start.select("node", F.lit(0).alias("steps")).distinct())
    for k in range(1, rounds + 1):
        step = seen.where(F.col("steps") == k - 1).join(edges.select(F.col("source").alias("node"), F.col("target").alias("next")), "node").select(F.col("next").alias("node")).distinct()
        seen = cut(seen.union(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("steps"))))
    return seen


@dataclass(frozen=True)
class Compressed:
    """A graph whose chains are single edges.

    ``edges``: source, target, n (steps), first (the node after the source) and
    tail (the last node inside a chain, null for an edge as it was). ``chains``:
    each node inside a chain with the chain's tail and the steps left to its
    end. ``rings``: the nodes of cycles that nothing else touches, with the
    least node of each.
    """

    edges: DataFrame
    chains: DataFrame
    rings: DataFrame


def compressed(edges: DataFrame, pinned: DataFrame | None = None) -> Compressed:
    """Chains of nodes with one edge in and one out, as far as they aren't
    ``pinned`` (node), become edges. Pointers along them double their reach in
    each round, so a chain takes as many rounds as its length has binary digits."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("target").alias("n_out"), F.min("target").alias("to"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("source").alias("n_in"))
    inner = out.join(into, "node").where("n_in = 1 and n_out = 1 and node <> to")
    if pinned is not None:
        inner = inner.join(pinned.select("node"), "node", "left_anti")
    inner = cut(inner.select("node", "to"))
    there = inner.select(F.col("node").alias("to"), F.lit(True).alias("more"))
    now = cut(inner.join(there, "to", "left").select("node", "to", F.lit(1).cast("long").alias("n"), F.col("node").alias("tail"), F.col("node").alias("low"), F.coalesce("more", F.lit(False)).alias("more")))
    before = None
    while True:
        state = now.agg(F.count_if("more"), F.sum(F.when(F.col("more"), F.xxhash64("node", "low").cast("decimal(38,0)")))).first()
        if not state[0] or state == before:
            break
        before = state
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("tail").alias("tail2"), F.col("low").alias("low2"), F.col("more").alias("more2"))
        now = now.where("not more").union(now.where("more").join(ahead, "to").select("node", F.col("to2").alias("to"), F.col("n") + F.col("n2"), F.col("tail2"), F.least("low", "low2"), F.col("more2")))
        now = cut(now)
    ends = now.where("not more")
    rest = edges.join(inner.select(F.col("node").alias("source")), "source", "left_anti")
    met = rest.join(ends.select(F.col("node").alias("target"), "to", "n", "tail"), "target", "left")
    short = met.select("source", F.coalesce("to", "target").alias("target"), (F.coalesce("n", F.lit(0)) + 1).alias("n"), F.col("target").alias("first"), "tail")
    return Compressed(cut(short), ends.select("node", "tail", F.col("n").alias("left")), now.where("more").select("node", F.col("low").alias("cycle")))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that are on a cycle or between two. Chains are
    compressed and loose ends taken away in turn, so that neither a long chain
    nor a tree takes many rounds; what is left is spread out again."""
    levels, now = [], edges
    while True:
        level = compressed(now)
        short = level.edges.select("source", "target").distinct()
        kept = short.join(short.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = cut(kept.join(kept.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        levels.append((now, level))
        n = kept.count()
        if n == now.count():
            break
        now = kept
        if not n:
            break
    for under, level in reversed(levels):
        alive = level.edges.join(now, ["source", "target"], "left_semi")
        inside = level.chains.join(alive.select("tail").where("tail is not null"), "tail", "left_semi").select("node").union(level.rings.select("node"))
        first = alive.select("source", F.col("first").alias("target"))
        now = cut(first.union(under.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").select("source", "target")).distinct())
    return now


def _spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """The least mark (node, mark) that reaches each node along the edges; rounds until none changes."""
    now, before = marks, None
    while True:
        sent = edges.join(now.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), "mark")
        now = cut(now.union(sent).groupBy("node").agg(F.min("mark").alias("mark")))
        state = now.agg(F.count("node"), F.sum(F.xxhash64("node", "mark").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): the nodes that lie on a directed cycle, with the least
    node of their strongly connected component.

    On the compressed graph, the least node that reaches a node is its mark;
    the nodes of one mark that reach the marking node again are its component.
    These are taken away and the rest is marked anew, until no edge is left;
    nothing is capped. A chain inside a component belongs to it.
    """
    loops = edges.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("cycle")).distinct()
    core = _trimmed(cut(edges.select("source", "target").where("source <> target").distinct()))
    short = compressed(core)
    now = short.edges.where("source <> target").select("source", "target").distinct()
    found = short.rings.union(short.edges.where("source = target").select("source", "source").distinct())
    while not now.isEmpty():
        nodes = now.select(F.col("source").alias("node")).union(now.select("target")).distinct()
        marks = _spread(now, nodes.withColumn("mark", F.col("node")))
        mark = lambda side: marks.select(F.col("node").alias(side), F.col("mark").alias(f"{side}_mark"))
        inside = cut(now.join(mark("source"), "source").join(mark("target"), "target").where("source_mark = target_mark").select("source", "target"))
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        roots = marks.where("node = mark")
        hit = _spread(back, roots).join(marks.withColumnRenamed("mark", "own"), "node").where("mark = own").select("node", F.col("mark").alias("cycle"))
        hit = cut(hit)
        # A node that nothing else marks and that doesn't come back to itself is no cycle.
        some = hit.groupBy("cycle").agg(F.count("node").alias("n")).where("n > 1").select("cycle")
        found = found.union(hit.join(some, "cycle", "left_semi").select("node", "cycle"))
        gone = hit.select("node")
        now = now.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        now = _trimmed(cut(now.select("source", "target")))
    found = cut(found.groupBy("node").agg(F.min("cycle").alias("cycle")))
    at = lambda side: found.select(F.col("node").alias(side), F.col("cycle").alias(f"{side}_cycle"))
    tails = short.edges.where("tail is not null").join(at("source"), "source").join(at("target"), "target").where("source_cycle = target_cycle").select("tail", F.col("source_cycle").alias("cycle")).distinct()
    whole = found.union(short.chains.join(tails, "tail").select("node", "cycle"))
    whole = cut(whole.union(loops.join(whole.select("node"), "node", "left_anti")))
    least = whole.groupBy("cycle").agg(F.min("node").alias("least"))
    return whole.join(least, "cycle").select("node", F.col("least").alias("cycle"))


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(cycle, position, node): for the least node of each strongly connected
    component with a cycle the shortest way back to it, from position 0 on; of
    several the one whose nodes come first.

    Ways back are relaxed over the component's edges with its chains
    compressed. The nodes on the way follow from pointers to the next one that
    double their reach each round.
    """
    own = cut(cycles(edges))
    at = lambda side: own.select(F.col("node").alias(side), F.col("cycle").alias(f"{side}_cycle"))
    inside = edges.select("source", "target").distinct().join(at("source"), "source").join(at("target"), "target").where("source_cycle = target_cycle")
    inside = cut(inside.select("source", "target"))
    heads = own.select(F.col("cycle").alias("node")).distinct()
    short = compressed(inside, heads)
    far = cut(heads.select("node", F.lit(0).cast("long").alias("left")))
    before = None
    while True:  # the least steps from each node to the head
        onward = short.edges.join(far.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node"), (F.col("n") + F.col("left")).alias("left"))
        far = cut(far.union(onward).groupBy("node").agg(F.min("left").alias("left")))
        state = far.agg(F.count("node"), F.sum("left")).first()
        if state == before:
            break
        before = state
    best = short.edges.join(far.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.min(F.struct((F.col("n") + F.col("left")).alias("all"), "first", "target", "n", "tail")).alias("e"))
    best = cut(best.select("node", "e.*"))
    jump = cut(best.join(heads, "node", "left_anti").select("node", F.col("target").alias("to")))
    total = best.join(heads, "node").select(F.col("node").alias("cycle"), F.col("all").alias("total"), F.col("target").alias("node"))
    on, before = cut(total.select("cycle", "node")), None
    while True:
        on = cut(on.union(on.join(jump, "node").select("cycle", F.col("to").alias("node"))).distinct())
        jump = cut(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to")))
        n = on.count()
        if n == before:
            break
        before = n
    placed = on.where("node <> cycle").join(far, "node").join(total.drop("node"), "cycle").select("cycle", (F.col("total") - F.col("left")).alias("position"), "node")
    placed = cut(placed.union(heads.select("node", F.lit(0).cast("long"), "node")))
    between = placed.join(best.where("tail is not null"), "node").select("cycle", "position", "n", "tail").join(short.chains, "tail").select("cycle", (F.col("position") + F.col("n") - F.col("left")).alias("position"), "node")
    return placed.union(between)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a directed cycle."""
    return cycles(edges).select("node")
