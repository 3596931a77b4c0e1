"""Table functions for SQL, for use in LATERAL: one raw text in, its messages or chunks out.

``register(spark)`` makes them known: ``select c.id, t.* from chats c, lateral chat_turns(c.raw) t``. They say of one text what
sources.transcripts and operators.knowledge say of a table of them, whose windows and groupings a lateral row doesn't need.
``analyze`` checks the arguments when a query is planned. A null text has no messages, and one empty chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.patterns import ROLES
from ..operators.knowledge import chunk_bounds
from .transcripts import _INLINE, _KEYS, _MARKER, _ROLE_TITLE, _TITLE

#: White space as Unicode names it, and what ends a line.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDS = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+$")
_LINE = re.compile("\r\n|[\n-\r\x85\u2028\u2029]")
_KINDS = {name: re.compile(p, re.ASCII) for name, p in (("marker", _MARKER), ("inline", _INLINE), ("title", _TITLE), ("role_title", _ROLE_TITLE))}
TURNS = StructType().add("msg_index", IntegerType()).add("role", StringType()).add("content", StringType())
CHUNKS = StructType().add("chunk", IntegerType()).add("start", IntegerType()).add("text", StringType())


def _stripped(text: str) -> str:
    return _ENDS.sub("", text)


def _role(word: str | None) -> str:
    return ROLES.get((word or "").lower(), "unknown")


def _numbered(said: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    kept = [(role, body) for role, content in said if (body := _stripped(content or ""))]
    return [(k, *m) for k, m in enumerate(kept)]


def transcript_turns(raw: str) -> list[tuple[int, str, str]]:
    """What transcripts.parse_text says of one text."""
    said: list[list] = [["user", None]]
    for line in _LINE.split(_stripped(raw)):
        bare = _stripped(line)
        marker, inline = _KINDS["marker"].search(bare), _KINDS["inline"].search(bare)
        if _KINDS["title"].search(bare) and not _KINDS["role_title"].search(bare):
            said.append([said[-1][0], None])
        elif marker:
            said.append([_role(marker[1]), None])
        elif inline:
            said.append([_role(inline[1]), inline[2]])
        else:
            said[-1][1] = line if said[-1][1] is None else said[-1][1] + "\n" + line
    return _numbered([(role, text) for role, text in said])


def _text(value: object) -> str | None:
    """A JSON value as text."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _first(item: object, *keys: str) -> str | None:
    found = [_text(item.get(k)) for k in keys] if isinstance(item, dict) else []
    return next((f for f in found if f is not None), None)


def _parsed(raw: str) -> object:
    try:
        return json.loads(raw)
    except ValueError:
        return None


def json_turns(raw: str) -> list[tuple[int, str, str]] | None:
    """What transcripts.parse_json says of one text; None if it has no list of messages."""
    data = _parsed(raw)
    lists = [data] if isinstance(data, list) else [data.get(k) for k in _KEYS] if isinstance(data, dict) else []
    items = next((x for x in lists if isinstance(x, list)), None)
    if items is None:
        return None
    said = []
    for item in items:
        content = item.get("content") if isinstance(item, dict) else None
        parts = content.get("parts") if isinstance(content, dict) else None
        joined = " ".join(t for p in parts if (t := _text(p)) is not None) if isinstance(parts, list) else None
        said.append((_role(_first(item, "role", "author")), joined if joined is not None else _first(item, "content", "text", "message") or ""))
    return _numbered(said)


def tree_turns(raw: str) -> list[tuple[int, str, str]]:
    """What transcripts.parse_tree says of one text."""
    data = _parsed(raw)
    nodes = data.get("mapping") if isinstance(data, dict) else None
    said = []
    for pos, node in enumerate(nodes.values() if isinstance(nodes, dict) else []):
        message = node.get("message") if isinstance(node, dict) else None
        if isinstance(message, dict) and (role := (message.get("author") or {}).get("role")) in ROLES:
            parts = (message.get("content") or {}).get("parts") or []
            said.append((float(node.get("create_time") or 0), pos, ROLES[role], " ".join(t for p in parts if (t := _text(p)) is not None)))
    return _numbered([(role, content) for _, _, role, content in sorted(said)])


def turns(raw: str) -> list[tuple[int, str, str]]:
    """What transcripts.parse says of one text, whatever form it has."""
    found = json_turns(raw)
    if found:
        return found
    data = _parsed(raw)
    if found is None and isinstance(data, dict) and isinstance(data.get("mapping"), dict):
        return tree_turns(raw)
    return transcript_turns(raw)


def _checked(schema: StructType, name: str, text: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
    if not isinstance(text.dataType, StringType):
        raise ValueError(f"{name} takes a text, not {text.dataType.simpleString()}")
    if size is not None and (not size.isConstantExpression or not isinstance(size.value, int) or size.value <= 100):
        raise ValueError(f"{name} takes a constant size above 100")
    return AnalyzeResult(schema)


def _turn_function(name: str, parse):
    class Turns:
        @staticmethod
        def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
            return _checked(TURNS, name, raw)

        def eval(self, raw: str) -> Iterator[tuple]:
            yield from (parse(raw) or []) if raw is not None else []

    return udtf(Turns)


class _Chunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        return _checked(CHUNKS, "text_chunks", text, size)

    def eval(self, text: str, size: int) -> Iterator[tuple]:
        for k, (start, end) in enumerate(chunk_bounds(text or "", size)):
            yield k, start, (text or "")[start:end]


def register(spark: SparkSession) -> None:
    """chat_turns(raw) for any form, transcript_turns, json_turns and tree_turns for one; text_chunks(text, size)."""
    for name, parse in (("chat_turns", turns), ("transcript_turns", transcript_turns), ("json_turns", json_turns), ("tree_turns", tree_turns)):
        spark.udtf.register(name, _turn_function(name, parse))
    spark.udtf.register("text_chunks", udtf(_Chunks))
