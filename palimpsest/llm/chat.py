"""Chat formatting of typed content parts, with a loss mask, and the way back.

A message is a list of parts: text, image, audio or document. A visitor flattens them into one
text in which every attachment is a numbered placeholder, keeps the attachments' references in
order, and counts the tokens that each one stands for. Turns are marked by control strings; such
strings inside texts and roles are escaped and come back unchanged.

The output is a row a turn, in order: a conversation's formatted text is its segments put
together, so a conversation of any length is never held whole. Null roles, texts and parts are
empty; all rows with a null conversation id are one conversation; turns with equal numbers are ordered
by role, then content, and repeated rows are turns of their own. A conversation's turns are numbered in one
pass, so a very long one takes one task long, in constant memory. An empty table gives an empty one; other columns
are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, to_arrow

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn:(.*?)\|>\n(.*)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visits the parts of a conversation's messages in order."""

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.seen = 0

    def message(self, parts: list[dict]) -> tuple[str, list[dict]]:
        """The escaped text with placeholders, and the attachments it refers to."""
        self.attachments: list[dict] = []
        text = "".join(getattr(self, f"visit_{p['kind']}", self.visit_text)(p) for p in parts or [] if p)
        return text, self.attachments

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        return self.placeholder(part, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def visit_audio(self, part: dict) -> str:
        return self.placeholder(part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> str:
        return self.placeholder(part, (part["pages"] or 0) * self.page_tokens)

    def placeholder(self, part: dict, tokens: int) -> str:
        mark = f"<|{part['kind']}:{self.seen}|>"
        self.seen += 1
        self.attachments.append({"placeholder": mark, "kind": part["kind"], "ref": part["ref"], "tokens": max(1, tokens)})
        return mark


SEGMENTS = [field("conv_id", "long"), field("turn_index", "long"), field("segment", "string"), field("loss_start", "long"), field("loss_end", "long"),
            field("attachments", [{"placeholder": "string", "kind": "string", "ref": "string", "tokens": "long"}])]


def text_parts(text: F.Column) -> F.Column:
    """A plain text as a list of one text part."""
    none = {"kind": "string", "text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    values = {"kind": F.lit("text"), "text": F.coalesce(text.cast("string"), F.lit(""))}
    return F.array(F.struct(*[values.get(n, F.lit(None).cast(t)).alias(n) for n, t in none.items()]))


def format_turns(messages: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Segments of messages(conv_id, turn, role, parts), where parts is of the type PARTS.

    loss_start and loss_end enclose, in code points of the segment, what the roles in learn_from
    have said; they are null in other turns.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.col("parts").cast(PARTS).alias("parts"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    arrow = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in SEGMENTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    now, turn, visitor = row["conv_id"], 0, Flatten()
                head = f"<|turn:{escape(row['role'])}|>\n"
                text, attachments = visitor.message(row["parts"])
                learned = row["role"] in learn_from
                out.append({"conv_id": now, "turn_index": turn, "segment": f"{head}{text}<|end|>\n", "loss_start": len(head) if learned else None,
                            "loss_end": len(head) + len(text) if learned else None, "attachments": attachments})
                turn += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, T.StructType(SEGMENTS))


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders stay as they are."""
    m = _TURN.fullmatch(segment)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def read_back(segments: DataFrame) -> DataFrame:
    """A row a conversation, from the segments alone: turns, digests of them and of the text under the loss mask.

    Digests run over the sorted turns as they pass, in constant memory.
    """
    dealt = segments.select("conv_id", "turn_index", "segment", "loss_start", "loss_end", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("tokens"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn_index")
    fields = [field("conv_id", "long"), field("n_turns", "long"), field("turns_sha256", "string"), field("loss_chars", "long"), field("loss_sha256", "string"),
              field("formatted_chars", "long"), field("attachment_tokens", "long")]
    arrow = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = run, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    if sums:
                        done.append(sums)
                    now = row["conv_id"]
                    sums = {"conv_id": now, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "attachment_tokens": 0}
                role, text = parse_segment(row["segment"])
                sums["n_turns"] += 1
                sums["turns_sha256"].update(f"{role}\n{text}\n".encode())
                if row["loss_start"] is not None:
                    learned = unescape(row["segment"][row["loss_start"] : row["loss_end"]])
                    sums["loss_chars"] += len(learned)
                    sums["loss_sha256"].update(learned.encode())
                sums["formatted_chars"] += len(row["segment"])
                sums["attachment_tokens"] += row["tokens"] or 0
            yield pa.RecordBatch.from_pylist([digested(s) for s in done], schema=arrow)
        if sums:
            yield pa.RecordBatch.from_pylist([digested(sums)], schema=arrow)

    def digested(sums: dict) -> dict:
        return sums | {k: sums[k].hexdigest() for k in ("turns_sha256", "loss_sha256")}

    return dealt.mapInArrow(run, T.StructType(fields))
