"""Repair of a conversation's structure: the cheapest edits that make its roles a chat, by a checkpointed DP.

A chat's role initials are nothing, or ``s?(ua)+``. Rows are taken in order of turn (nulls first), then role, then
text. A row's first fault counts: blank, duplicate (its role and text came earlier), truncated (it doesn't end a
sentence). Keep costs nothing, Rerole 1, Delete 2 (the only edit of blank and duplicate rows), Insert of an empty turn
5, and a truncated row that stays 5 more. Of equally cheap edits the ones whose initials are least in ASCII count.

The DP goes backward over the rows with a cost for each of four states (nothing yet, after s, after u, after a). Its
vectors are kept at every sqrt(n)-th row only; the walk forward works the vectors of one block out again and emits the
first tight edit in the order D, I, K, R. What is held of a conversation is one byte a row, its audit (one letter an edit,
a value of the result anyhow) and about 2 * sqrt(n) vectors; texts pass in a stream. Rows are numbered by a window that
spills, duplicates are found by grouping digests before any join, and every join is by keys that are unique; so one
conversation with a third of all rows takes one task long, in the memory stated.

Null roles and texts are one space; a role other than s..., u... or a... (an empty one too) can't be kept. All rows with
a null conversation id are one conversation. Repeated rows are duplicates. An empty table gives empty tables; other columns
are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import PART, field, to_arrow, written

BLANKS = " \t\n\x0b\x0c\r"
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED = 5  # for a truncated row that stays
#: States: nothing yet, after s, after u, after a. The state that a user or assistant turn leads to, and who that is.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_KINDS = ("s", "u", "a", "")
_FREE, _DELETE, _CUT = range(3)  # a row's fault: none, one that must go, truncated


def kept_state(kind: str, state: int) -> int | None:
    """The state after a kept row whose role begins with kind; None where it may not stand."""
    return _KEEP[kind][state] if kind in _KEEP else None


def with_inserts(v: list) -> tuple:
    """The costs when empty turns may be inserted first."""
    after_u, after_a = min(v[2], 5 + v[3]), min(v[3], 5 + v[2])
    return min(v[0], 5 + after_u), min(v[1], 5 + after_u), after_u, after_a


_END = with_inserts([0, math.inf, math.inf, 0])


def before(code: int, after: tuple) -> tuple:
    """The states' costs before a row of this code, from those after it."""
    fault, kind = divmod(code, 4)
    v = [2 + c for c in after]
    if fault != _DELETE:
        extra = TRUNCATED if fault == _CUT else 0
        for q in range(4):
            v[q] = min(v[q], 1 + extra + after[_NEXT[q]])
            to = kept_state(_KINDS[kind], q)
            if to is not None:
                v[q] = min(v[q], extra + after[to])
    return with_inserts(v)


def cheapest(codes: bytes | bytearray) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of rows of these codes (4 * fault + kind of role)."""
    n = len(codes)
    block = max(1, math.isqrt(n))
    marks, v = {n: _END}, _END
    for i in range(n - 1, -1, -1):
        v = before(codes[i], v)
        if i % block == 0:
            marks[i] = v
    cost, state, audit = v[0], 0, bytearray()
    for start in range(0, n, block):
        end = min(start + block, n)
        vectors = [marks[end]]
        for i in range(end - 1, start - 1, -1):
            vectors.append(before(codes[i], vectors[-1]))
        for i in range(start, end):
            here, after = vectors[end - i], vectors[end - i - 1]
            fault, kind = divmod(codes[i], 4)
            while 2 + after[state] != here[state] and 5 + here[_NEXT[state]] == here[state]:
                audit += b"I"
                state = _NEXT[state]
            extra, to = TRUNCATED if fault == _CUT else 0, kept_state(_KINDS[kind], state)
            if 2 + after[state] == here[state]:
                audit += b"D"
            elif to is not None and extra + after[to] == here[state]:
                audit += b"K"
                state = to
            else:
                audit += b"R"
                state = _NEXT[state]
    while _END[state]:
        audit += b"I"
        state = _NEXT[state]
    return cost, audit.decode()


def damaged(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): of 20 rows, by checksum, one is dropped, one emptied, one loses its sentence ends, one is repeated, one becomes the user's."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.filter(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def ordered(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with `row`, their number in the conversation from 1 on; written once."""
    space = F.lit(" ")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return written(rows.withColumn("row", F.row_number().over(order).cast("long")), "turns")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & a[k].eqNullSafe(b[k])
    return found


REPORT = [field("conv_id", "long"), *[field(n, "long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], field("audit", "string")]


def reports(turns: DataFrame) -> DataFrame:
    """A row a conversation of ordered(): its faults, the cost of the cheapest edits, and their initials in order."""
    kept = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(kept == "", 1).when(F.right(kept, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    first = F.left("role", F.lit(1))
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    light = turns.select("conv_id", "row", "turn", kind.alias("kind"), fault.alias("fault"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = turns.groupBy("conv_id", said.alias("said")).agg(F.min("row").alias("row")).select("conv_id", "row")
    rows = light.join(firsts, same(light, firsts, ["conv_id", "row"]), "left").select(light["*"], firsts["row"].isNull().alias("again"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "row")
    arrow = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, now, sums = bytearray(), run, {}

        def report() -> dict:
            cost, audit = cheapest(codes)
            gaps = sums["high"] - sums["low"] + 1 - sums["turns"] if sums["turns"] else 0
            return {"conv_id": now, "gaps": gaps, "cost": cost, "audit": audit} | {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}

        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                for conv, turn, kind, fault, again in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "fault", "again"))):
                    if conv != now or not codes:
                        if codes:
                            done.append(report())
                        codes, now = bytearray(), conv
                        sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"low": None, "high": None}
                    elif (codes[-1] % 4, kind) not in ((0, 1), (1, 2), (2, 1)):
                        sums["illegal"] += 1
                    if turn is not None and turn != sums["high"]:
                        sums["turns"] += 1
                        sums["low"], sums["high"] = turn if sums["low"] is None else sums["low"], turn
                    name = "blank" if fault == 1 else "duplicate" if again else "truncated" if fault == 2 else None
                    if name:
                        sums[name] += 1
                    codes.append(4 * (_FREE if name is None else _CUT if name == "truncated" else _DELETE) + kind)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if codes:
            yield pa.RecordBatch.from_pylist([report()], schema=arrow)

    return dealt.mapInArrow(run, T.StructType(REPORT))


def _dealt(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    none = F.lit(None).cast("string")
    audits = found.select("conv_id", F.lit(0).cast("long").alias("row"), none.alias("role"), F.col("audit").alias("text"))
    return turns.select("conv_id", "row", "role", "text").unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "row")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (conv_id, edit, role, text) of rows as _dealt() brings them: the repaired turns, and the deleted ones."""
    audit, at, state, conv = "", 0, 0, None

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, _NEXT[state]
            yield conv, "I", _ROLE[state], ""

    for batch in batches:
        for start in range(0, batch.num_rows, PART):
            out = []
            for row in batch.slice(start, PART).to_pylist():
                if row["row"] == 0:
                    out += inserts()  # those at the end of the conversation before
                    audit, at, state, conv = row["text"], 0, 0, row["conv_id"]
                    continue
                out += inserts()
                edit, role, at = audit[at], row["role"], at + 1
                if edit == "R":
                    state = _NEXT[state]
                    role = _ROLE[state]
                elif edit == "K":
                    state = kept_state(role[:1], state)
                out.append((conv, edit, role, row["text"]))
            yield out
    yield list(inserts())


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns of repaired conversations in order, from ordered() and reports()."""
    fields = [field("conv_id", "long"), field("position", "long"), field("edit", "string"), field("role", "string"), field("text", "string")]
    arrow = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position = run, 0
        for part in _edited(batches):
            out = []
            for conv, edit, role, text in part:
                if conv != now:
                    now, position = conv, 0
                if edit != "D":
                    out.append({"conv_id": conv, "position": position, "edit": edit, "role": role, "text": text})
                    position += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _dealt(turns, found).mapInArrow(run, T.StructType(fields))


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digests of the repaired turns as role:text, joined by newlines, taken as they pass."""
    fields = [field("conv_id", "long"), field("repaired_sha256", "string")]
    arrow = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, any_yet = run, None, False
        for part in _edited(batches):
            done = []
            for conv, edit, role, text in part:
                if conv != now:
                    if digest:
                        done.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                    now, digest, any_yet = conv, hashlib.sha256(), False
                if edit != "D":
                    digest.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
                    any_yet = True
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if digest:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], schema=arrow)

    return _dealt(turns, found).mapInArrow(run, T.StructType(fields))
