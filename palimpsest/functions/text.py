"""Column functions: normalized text, hashes, token estimates, keywords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import STOP_WORDS

#: Counts the tokens of a text column; any function of this form can stand for the default estimate.
TokenCounter = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def normalized(text: Column) -> Column:
    """Lower case, one space where there was white space."""
    return F.regexp_replace(stripped(F.lower(text)), r"(?U)\s+", " ")


def content_key(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least; none for an empty text."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def keywords(text: Column) -> Column:
    """Words of a letter and more letters, digits, _ + # . that are long enough and say something; they may repeat."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z][a-zA-Z0-9_+#.]{1,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2))


def stem_variants(word: Column) -> Column:
    """The word, and its likely singulars or its plural."""
    n = F.length(word)
    singular = F.when(word.endswith("es"), F.array(word, F.substring(word, F.lit(1), n - 1), F.substring(word, F.lit(1), n - 2))).otherwise(F.array(word, F.substring(word, F.lit(1), n - 1)))
    return F.when(word.endswith("s") & (n > 3), singular).otherwise(F.array(word, F.concat(word, F.lit("s"))))


def memory_id(project_id: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(project_id, F.lit(":"), content), 256), 1, 16)


def conversation_id(raw: Column) -> Column:
    """The default id of a conversation: the start of its raw text's hash."""
    return F.substring(F.sha2(raw, 256), 1, 12)


def provenance(conversation: Column, index: Column) -> Column:
    return F.concat(F.lit("Conversation "), conversation, F.lit(", Message #"), index.cast("string"))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words is part of the text."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def reduction_percent(original: Column, prepared: Column, digits: int = 2) -> Column:
    return F.when(original > 0, F.round((original - prepared) / original * 100, digits)).otherwise(0.0)


def reduction_message(original: Column, prepared: Column) -> Column:
    """Claims no saving where there is none."""
    saved = F.format_string("Estimated context reduction: %.1f%%", F.bround((original - prepared) / original * 100, 1))
    return F.when(prepared >= original, "This input is already compact.").otherwise(saved)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _utf16(char: Column) -> Column:
    """\\uxxxx for each UTF-16 unit of a character."""
    return F.regexp_replace(F.lower(F.hex(F.encode(char, "UTF-16BE"))), "(.{4})", r"\\u$1")


_SHORT = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _escaped(text: Column, plain: str, short: dict[str, str], other: Callable[[Column], Column]) -> Column:
    """text with its characters outside the class `plain` escaped: the short ones as they say, all others by `other`."""

    def one(char: Column) -> Column:
        out = F
        for found, written in short.items():
            out = out.when(char == found, written)
        return out.when(char.rlike(f"^[{plain}]$"), char).otherwise(other(char))

    return F.when(text.rlike(rf"""(?s)[^{plain}]|[\\"']"""), F.array_join(F.transform(_characters(text), one), "")).otherwise(text)


def json_string(text: Column) -> Column:
    """text as a JSON string of ASCII characters only."""
    body = _escaped(text, " -~", _SHORT | {'"': '\\"', "\b": "\\b", "\f": "\\f"}, _utf16)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_strings(items: Column) -> Column:
    """A list of texts as a JSON list, with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, json_string), ", "), F.lit("]"))


def quoted_strings(items: Column) -> Column:
    """A list of texts as source code would show it: in single quotes, or in double ones around a single quote; what can't be printed is escaped."""

    def code(char: Column) -> Column:
        number = F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("long")
        return F.when(number < 256, F.format_string("\\x%02x", number)).when(number < 65536, F.format_string("\\u%04x", number)).otherwise(F.format_string("\\U%08x", number))

    def one(text: Column) -> Column:
        double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
        body = _escaped(text, r" \P{C}&&[\P{Z} ]", _SHORT, code)
        return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))
