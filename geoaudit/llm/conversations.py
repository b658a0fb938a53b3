"""Conversation structure repair by a forward Viterbi pass over a small grammar.

A conversation's roles should read ``(s?(ua)+)?``: perhaps a system turn, then user
and assistant in turn.  Four states say where a prefix stands (nothing yet, after
``s``, after ``u``, after ``a``).  Every row is a layer: it is kept, given another
role or deleted, and the layer is closed by the bounded inserts that lead on from
what it reached.  A state carries the least ``(cost, audit)`` that ends in it, where
the audit is the string of edits' initials; of equal costs the ASCII-least string
wins.  (Of two audits of equal cost that end in one state neither begins the other:
the longer one would hold the same edits and further inserts, at a higher cost.  So
the order of the strings never changes later.)

Rows are shuffled once, by conversation; Spark sorts them there (twice, spilling as
it needs), and a task reads its conversations as a stream.  What all four survivors
begin with is settled at once: those rows are emitted and forgotten, so a task holds
the rows in doubt only, however long the conversation is.  The steps of runs of rows
are remembered by their kinds, since most conversations look alike.  A digest over a
whole conversation is sequential by nature: one task streams through a conversation,
even if it holds a third of all rows.

Defined results: a null role or text is one space; rows with a null ``conv_id`` are a
conversation of their own; rows are taken by turn (nulls first), equal turns by role
and text; a row counts as duplicate if an equal role and text came earlier in that
order, deleted rows included; a role counts by its first character alone, and an
empty or unknown role can only be replaced or deleted; a row marked as dropped keeps
its conversation in the result and is otherwise ignored; an empty table gives an
empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaudit.llm._frames import col
from geoaudit.session import table

#: Costs of edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that are stepped through at once, and so remembered by their kinds.
RUN = 16
#: Rows of an output batch.
BATCH = 4096

_SPACE = " \t\n\v\f\r"
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: By state: the state and role that a row of free role leads to.
_NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
_FINAL = (0, 3)

State = tuple[int, str] | None


def damaged(df: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, dropped)`` as a careless export would have left them.

    ``crc32("conv_id:turn") % 20`` (nulls: one space) decides: 0 drops the row, 1 empties
    its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = df.select(col("conv_id").alias("conv_id"), col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") == 0).alias("dropped"), times.alias("copy")).drop("copy")


def _closed(states: list[State]) -> list[State]:
    """Inserts lead on from every state; two in a row reach all that can be reached.

    Survivors that cannot win any more are dropped.
    """
    for _ in range(2):
        new = list(states)
        for q, s in enumerate(states):
            if s is not None:
                to = _NEXT[q][0]
                step = (s[0] + INSERT, s[1] + "I")
                if new[to] is None or step < new[to]:
                    new[to] = step
        states = new
    # what follows on nothing or on s can follow on a as well, at the cost of deleting one s at most
    if states[3] is not None:
        for q, more in ((0, DELETE), (1, 0)):
            if states[q] is not None and states[3][0] + more < states[q][0]:
                states[q] = None
    return states


@lru_cache(maxsize=1 << 16)
def advanced(states: tuple[State, ...], kinds: str) -> tuple[State, ...]:
    """The four survivors after rows of these kinds.

    A kind is ``x`` (must go) or the role's initial (``o``: any other), in upper case
    if the row is truncated.
    """
    for kind in kinds:
        new: list[State] = [None] * 4
        for q, s in enumerate(states):
            if s is None:
                continue
            ways = [(q, DELETE, "D")]
            if kind != "x":
                more = TRUNCATED if kind.isupper() else 0
                ways.append((_NEXT[q][0], REROLE + more, "R"))
                if (q, kind.lower()) in _STEP:
                    ways.append((_STEP[q, kind.lower()], more, "K"))
            for to, cost, edit in ways:
                step = (s[0] + cost, s[1] + edit)
                if new[to] is None or step < new[to]:
                    new[to] = step
        states = tuple(_closed(new))
    return states


class Conversation:
    """One conversation, row by row; edits come out as soon as no survivor differs on them."""

    def __init__(self) -> None:
        self.states = tuple(_closed([(0, ""), None, None, None]))
        self.kinds = ""
        self.rows: deque[tuple[str, str]] = deque()
        self.at = 0  # state after the edits that came out
        self.cost = 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.turn = None
        self.turns = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> Iterator[tuple[str, str, str]]:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.turn = turn
        bare = text.rstrip(_SPACE)
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not bare:
            self.counts["blank"] += 1
            kind = "x"
        elif again:
            self.counts["duplicate"] += 1
            kind = "x"
        elif bare[-1] not in ".!?":
            self.counts["truncated"] += 1
            kind = kind.upper()
        if self.before is not None:
            self.counts["illegal"] += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.rows.append((role, text))
        self.kinds += kind
        return self.settle() if len(self.kinds) >= RUN else iter(())

    def settle(self) -> Iterator[tuple[str, str, str]]:
        self.states = advanced(self.states, self.kinds)
        self.kinds = ""
        known = os.path.commonprefix([s[1] for s in self.states if s is not None])
        least = min(s[0] for s in self.states if s is not None)
        self.cost += least
        self.states = tuple(None if s is None else (s[0] - least, s[1][len(known) :]) for s in self.states)
        return self.edits(known)

    def end(self) -> Iterator[tuple[str, str, str]]:
        if self.kinds:
            yield from self.settle()
        cost, audit = min(s for q, s in enumerate(self.states) if q in _FINAL and s is not None)
        self.cost += cost
        yield from self.edits(audit)

    def edits(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of each letter of an audit; the states are determined by it."""
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.rows.popleft()
            if edit == "K":
                self.at = _STEP[self.at, role[0]]
            elif edit != "D":
                self.at, role = _NEXT[self.at]
            yield edit, role, text

    @property
    def gaps(self) -> int:
        return self.turn - self.low + 1 - self.turns if self.turns else 0


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation and place, each with whether an equal one came before: one shuffle, two local sorts."""
    turn = F.col("turn").asc_nulls_first()
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(turn))
    plain = rows.select(col("conv_id").alias("conv_id"), col("turn").cast("long").alias("turn"), F.coalesce(col("role"), F.lit(" ")).alias("role"), F.coalesce(col("text"), F.lit(" ")).alias("text"), (col("dropped") if "dropped" in rows.columns else F.lit(False)).alias("dropped"))
    return plain.repartition("conv_id").withColumn("nth", nth).sortWithinPartitions("conv_id", turn, "role", "text", "nth")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation, Iterator[tuple[str, str, str]], bool]]:
    """``(conv_id, conversation, edits, ended)`` over sorted rows; every edit must be taken before the next step."""
    now, at = None, object()
    for b in batches:
        for key, turn, role, text, dropped, nth in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "nth")), strict=True):
            if now is None or key != at:
                if now is not None:
                    yield at, now, now.end(), True
                now, at = Conversation(), key
            if not dropped:
                yield at, now, now.add(turn, role, text, nth > 1), False
    if now is not None:
        yield at, now, now.end(), True


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: every edit of every conversation in order, places from 0.

    ``edit`` is K (kept), R (given this role), D (deleted) or I (inserted); the rows
    but the deleted ones are the repaired conversation.
    """
    ordered = _ordered(rows)
    shape = T.StructType([ordered.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    key = ordered.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(key), pa.int64(), pa.string(), pa.string(), pa.string()]
        out: list[tuple] = []
        place = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=shape.names)

        for conv, _, edits, ended in _conversations(batches):
            for edit in edits:
                out.append((conv, place, *edit))
                place += 1
            if ended:
                place = 0
            if len(out) >= BATCH:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return ordered.mapInArrow(run, shape)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, what the cheapest repair costs, its audit and the digest of the repaired text.

    ``rows`` has ``conv_id, turn, role, text`` and perhaps ``dropped``.
    """
    ordered = _ordered(rows)
    shape = T.StructType([ordered.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    key = ordered.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(key), *(pa.int64() for _ in _COUNTS), pa.string(), pa.string()]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=shape.names)

        audit, digest, empty = [], hashlib.sha256(), True
        for conv, c, edits, ended in _conversations(batches):
            for edit, role, text in edits:
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if ended:
                out.append((conv, c.gaps, *c.counts.values(), c.cost, "".join(audit), digest.hexdigest()))
                audit, digest, empty = [], hashlib.sha256(), True
            if len(out) >= BATCH:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return ordered.mapInArrow(run, shape)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired."""
    return repair(damaged(table(spark, sf_dir, "conversations")))
