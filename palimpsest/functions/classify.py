"""Message classification by ordered patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CATEGORIES, CHATTER, HINTS, REJECTED, STEMS
from .text import holds_any, let, stripped

_FLAGS = "(?idm)"  # any case; only a line feed ends a line


def first_match(text: Column, low: Column, patterns: list[str], stems: list[str]) -> Column:
    """What the first pattern with a long enough match says: its group, or all of the match. Null if none does. low: the text in lower case; stems: what any match needs of it."""
    out = []
    for pattern in patterns:
        whole = stripped(F.regexp_extract(text, _FLAGS + pattern, 0))
        if re.compile(pattern).groups:
            group = F.regexp_extract(text, _FLAGS + pattern, 1)
            whole = F.when(group != "", stripped(group)).otherwise(whole)
        out.append(F.when(F.length(whole) >= 8, F.left(whole, F.lit(400))))
    # a look for the stems, and one at the alternatives, tell most messages apart from the few that need each pattern
    return F.when(holds_any(low, stems) & text.rlike(_FLAGS + "|".join(patterns)), F.coalesce(*out))


def has_hint(text: Column) -> Column:
    return text.rlike(_FLAGS + HINTS)


def is_chatter(text: Column) -> Column:
    """A short message that says nothing."""
    said = F.lit(False)
    for pattern in CHATTER:
        said = said | text.rlike("(?id)" + pattern)
    return (F.length(text) < 120) & ~has_hint(text) & said


def findings(text: Column) -> Column:
    """array<struct<class_order,category,content,confidence,importance,status>> of one message's text."""
    # the text is stripped and lower-cased once, not again for each rule
    return let(stripped(text), lambda t: let(F.lower(t), lambda low: _findings(t, low)))


def _findings(text: Column, low: Column) -> Column:
    def finding(order: int, category: str, content: Column, confidence: float, importance: float, status: Column) -> Column:
        return F.struct(F.lit(order).alias("class_order"), F.lit(category).alias("category"), content.alias("content"),
                        F.lit(confidence).alias("confidence"), F.lit(importance).alias("importance"), status.alias("status"))

    found = []
    for order, (category, patterns, confidence, importance, status, _) in enumerate(CATEGORIES, 1):
        rejected = holds_any(low, STEMS["rejected"]) & text.rlike(_FLAGS + REJECTED)
        state = F.when(rejected, "rejected").otherwise(status) if category == "decision" else F.lit(status)
        found.append(finding(order, category, first_match(text, low, patterns, STEMS[category]), confidence, importance, state))
    chatter = F.array(finding(0, "irrelevant", text, 0.9, 0.05, F.lit("active")))
    return F.when(is_chatter(text), chatter).otherwise(F.filter(F.array(*found), lambda f: f["content"].isNotNull()))
