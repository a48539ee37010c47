"""Repair of the turn structure of conversations by cheapest edits.

A conversation that is in order has the roles of ``(s?(ua)+)?``: an optional
system turn, then user and assistant in turn. Edits are Keep, Rerole, Delete
and Insert, of small integer costs, so the cheapest way from each place of a
conversation to a good end follows from Dial's bucket queue: as many buckets
as the largest cost has values, used in turn. The audit walks from the start
along arcs that lie on a cheapest way, and takes the least letter at each step.

Rows are dealt to tasks by conversation once, and sorted in them so that each
conversation passes twice: first one byte for each row, its symbol, then its
texts. So a task holds of a conversation its symbols and the distances to its
end, but never its texts, however long it is.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of what is kept so far: nothing, a system turn, ends with user, ends with assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of that initial, by the state before it; -1 where none may follow.
NEXT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: What an inserted or reroled turn is, by the state before it, and the state after it.
FILL = ("u", "u", "a", "u")
FILLED = (USER, USER, ASSISTANT, USER)
ROLES = {"u": "user", "a": "assistant"}
#: The symbol of a row that must go. All others are s, u, a, or o for any other
#: initial, in upper case if the text is truncated.
GONE = "-"


def distances(symbols: str) -> array:
    """The least cost of edits from before row i in state q to a good end, at 4 * i + q."""
    n, width = len(symbols), max(REROLE + TRUNCATED, DELETE, INSERT) + 1
    out = array("q", [-1]) * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(width)]
    buckets[0] += [4 * n + START, 4 * n + ASSISTANT]
    open_, cost = 2, 0
    while open_:
        bucket = buckets[cost % width]
        while bucket:  # arcs without cost fill the bucket in turn
            at = bucket.pop()
            open_ -= 1
            if out[at] < 0:
                out[at] = cost
                for before, more in _arcs_to(symbols, at >> 2, at & 3):
                    if out[before] < 0:
                        buckets[(cost + more) % width].append(before)
                        open_ += 1
        cost += 1
    return out


def _arcs_to(symbols: str, i: int, q: int) -> Iterator[tuple[int, int]]:
    """Nodes from which an edit leads to (i, q), and what it costs."""
    fill = [p for p in range(4) if FILLED[p] == q]
    for p in fill:
        yield 4 * i + p, INSERT
    if not i:
        return
    x, at = symbols[i - 1], 4 * i - 4
    yield at + q, DELETE
    if x != GONE:
        extra = TRUNCATED if x.isupper() else 0
        for p in fill:
            yield at + p, REROLE + extra
        for p, to in enumerate(NEXT.get(x.lower(), ())):
            if to == q:
                yield at + p, KEEP + extra


def repair(symbols: str) -> tuple[int, str]:
    """The least cost of edits, and their initials: of all cheapest ones the least string."""
    cost, n = distances(symbols), len(symbols)
    i, q, letters = 0, START, bytearray()
    while i < n or cost[4 * i + q]:
        here, x = cost[4 * i + q], symbols[i] if i < n else ""
        extra = TRUNCATED if x.isupper() else 0
        kept = NEXT.get(x.lower(), (-1,) * 4)[q]
        if x and here == DELETE + cost[4 * i + 4 + q]:
            letters += b"D"
            i += 1
        elif here == INSERT + cost[4 * i + FILLED[q]]:
            letters += b"I"
            q = FILLED[q]
        elif kept >= 0 and here == KEEP + extra + cost[4 * i + 4 + kept]:
            letters += b"K"
            i, q = i + 1, kept
        else:
            letters += b"R"
            i, q = i + 1, FILLED[q]
    return cost[START], letters.decode()


#: Conversations of up to so many rows with equal symbols share one search.
SHORT = 64
_short = lru_cache(50_000)(repair)


class Repaired:
    """The hash of the repaired conversation, whose rows are given in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.first, self.hash = audit, 0, START, True, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first, self.state = False, NEXT[role[0]][self.state]

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(ROLES[FILL[self.state]], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else ROLES[FILL[self.state]], text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage, which follows from the CRC-32
    of ``conv_id:turn``: of 20 remainders 0 drops a row, 1 empties its text, 2
    takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes it the user's.
    Nulls are read as one space. Dropped rows stay, with a null text, so that
    their conversation does."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fate == 0, F.lit(None).cast("string")).when(fate == 1, "").when(fate == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1)).alias("__n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("__n").alias("__n")).drop("__n")


BLANK = " \t\n\x0b\x0c\r"


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the conversation (seq), their symbol (null
    for dropped rows) and first fault. One shuffle, by conversation."""
    known = F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")
    df = rows.repartition("conv_id").withColumn("key", F.when(F.col("text").isNotNull(), F.sha2(known, 256)))
    place = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    df = df.withColumn("seq", F.row_number().over(place)).withColumn("again", F.row_number().over(W.partitionBy("conv_id", "key").orderBy("seq")) > 1)
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(bare == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    initial = F.substring("role", 1, 1)
    good = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    df = df.withColumn("fault", F.when(F.col("text").isNotNull(), fault))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(good)).when(F.col("fault").isNotNull(), good)
    return df.select("conv_id", "seq", "turn", "role", "text", "fault", symbol.alias("symbol"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.symbols = conv_id, bytearray()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.initial = self.repaired = None
        self.different, self.audit = 0, ""

    def row(self, turn: int | None, initial: str, fault: str, symbol: str) -> None:
        """Rows come by turn, nulls first."""
        self.symbols += symbol.encode()
        if fault != "none":
            self.counts[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.different += turn != self.high
            self.high = turn
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial

    def text(self, role: str, text: str) -> None:
        if self.repaired is None:
            self._search()
        self.repaired.turn(role, text)

    def _search(self) -> None:
        symbols = self.symbols.decode()
        self.counts["cost"], self.audit = (_short if len(symbols) <= SHORT else repair)(symbols)
        self.repaired = Repaired(self.audit)

    def result(self) -> tuple:
        if self.repaired is None:
            self._search()
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.different
        return self.conv_id, *(self.counts[c] for c in _COUNTS), self.audit, self.repaired.digest()


def repaired(df: DataFrame) -> DataFrame:
    """One row for each conv_id of ``df`` (conv_id, turn, role, text): what is
    wrong with its rows, and the cheapest repair.

    gaps: turns missing between the least and the greatest; blank, duplicate,
    truncated: rows by their first fault; illegal: neighbours whose roles can't
    follow each other; cost and audit of the cheapest edits, and the hash of
    the repaired turns. Rows are taken by turn, nulls first; rows of one turn
    by role and text. Null roles and texts are one space, so they are blank or
    of another role; a null conv_id is a conversation. Repeated rows are
    duplicates. Without rows all is zero or empty. Other columns play no part.
    """
    rows = faults(df)
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    text = F.when(F.col("kind") == 1, F.col("text")).alias("text")
    role = F.when(F.col("kind") == 1, F.col("role")).otherwise(F.substring("role", 1, 1)).alias("role")
    twice = rows.select("*", both).where("kind = 0 or symbol is not null").select("conv_id", "kind", "seq", "turn", "fault", "symbol", role, text)
    twice = twice.sortWithinPartitions("conv_id", "kind", "seq").drop("seq")
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    kind = df.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, out_type = None, [], None

        def packed() -> pa.RecordBatch:
            types = [out_type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            out_type = batch.schema.field(0).type
            for conv_id, second, turn, fault, symbol, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                    if len(done) >= 1000:
                        yield packed()
                        done = []
                if second:
                    now.text(role, text)
                elif symbol is not None:
                    now.row(turn, role, fault, symbol)
        if now:
            done.append(now.result())
            yield packed()

    return twice.mapInArrow(walk, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
