"""Which texts may hold which strings: an inverted index of letter groups instead of every pair.

A text's postings are its distinct groups of n letters; of a string's groups the one that fewest texts of the project
have leads to its candidates, so what is looked at follows the hits. Candidates are a superset: the caller checks them.
An index can be kept as a table (project_id, gram, key) and given again; postings are narrowed to the asked groups
before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """The distinct groups of n letters in a text, one at each place; none if it is shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def postings(texts: DataFrame, n: int) -> DataFrame:
    """(project_id, gram, key) of texts(project_id, key, text)."""
    return texts.select("project_id", "key", F.explode(grams(F.col("text"), n)).alias("gram"))


def candidates(needles: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(project_id, needle, key): the texts of an index that have the rarest group of needles(project_id, needle, parts).

    parts: strings that a text must hold to hold the needle; a needle whose parts are all shorter than n has no candidates here.
    """
    wanted = needles.select("project_id", "needle", F.explode(F.array_distinct(F.flatten(F.transform("parts", lambda p: grams(p, n))))).alias("gram"))
    asked = index.join(wanted.select("project_id", "gram").distinct(), ["project_id", "gram"], "left_semi")
    counts = asked.groupBy("project_id", "gram").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    rarest = wanted.join(counts, ["project_id", "gram"], "left").groupBy("project_id", "needle").agg(F.min(rarity).alias("r")).filter("r.n > 0")
    return rarest.select("project_id", "needle", F.col("r.gram").alias("gram")).join(asked, ["project_id", "gram"]).select("project_id", "needle", "key")
