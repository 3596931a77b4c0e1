"""Near-duplicate documents by HyperMinHash: banded registers, corrected estimate, full check.

A document's set is its distinct 5-word shingles (lower-cased; with fewer words the whole sequence
is one shingle). Its HyperMinHash sketch keeps, for each of 256 buckets of the shingles' hashes, the
least hash's leading-zero count and the ten bits after its first one. Registers of empty buckets
are filled from others in an order that depends on the bucket alone, so that small sets sketch alike
too. 32 bands of eight registers make candidates (a pair at the threshold is missed once in 25,000);
the share of equal registers, less chance collisions, estimates the similarity; what remains is checked
on the full sets. A filled register of a small set is a draw from its shingles too, so the estimate's
deviation is at most some 0.03 at every size.

Sets that are equal form classes first, and only a class's smallest id goes on. In a band's bucket
the members are paired with one of them, the hub (the set with most equal copies), so a bucket of m
documents makes m - 1 pairs, and the links among these join documents into components.

A hub whose members are still in several components may hide links between members. Such a pair
y, z has symmetric differences Dy, Dz from the hub, and |Dy| + |Dz| - 2 |Dy and Dz's common part| is
its own difference, which a link bounds by c (|y| + |z|), c = 15/185. So linked members have a large
common part of their differences, and by the prefix principle share one of the first entries of
both, in one order for all (what the hub lacks first, as edits seldom agree). Members that share
such an entry and lie in different components are the pairs left to check; a member that is linked
with the hub needs fewer entries than one that is not, since a partner must lie in another component.
Buckets are joined and grouped by keys alone: no bucket, class or component is ever collected in one
place. Under such an entry's key the join still compares m members' parity bits with one another, m * m
comparisons of eight numbers (of which no more can differ than shingles do); few pairs that are no link come
out of it. A key of many members is split in parts of some thousands, each of which meets all members of the
key in a join of its own, so no task compares more than a part with a key; other keys are joined where they lie.

Null and empty texts have no shingles and link with nothing; a null id is its own component or that
of an equal text. Rows are taken one by one: repeated rows share a class, and so do equal sets of different
order. Several texts under one id are one node: its links are those of the text of least hash, and they share
its component. Texts are read in blocks of fixed size, a word that lies across two counts once. An empty table gives an
empty one. Columns besides doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, field, map_columns, written

BUCKETS, MANTISSA, BANDS, ROWS = 256, 10, 32, 8
BLOCK = 1 << 18
#: Estimates below this are no link, whatever the sets' sizes: over six deviations below the threshold.
LEAST_ESTIMATE = 0.65

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLANKS = b" \t\n\r\v\f"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash (XXH3) of each word, in order; words are parted by ASCII white space.

    The text is read in blocks of a fixed size, and a word that goes on in the next one is hashed on from where it was cut.
    """
    out, held = [], None
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK].lower()
        words = block.split()
        if held is not None:
            if words and block[0] not in _BLANKS:
                held.update(words.pop(0))
            if words or block[-1] in _BLANKS:
                out.append(np.array([held.intdigest()], "uint64"))
                held = None
        if words and at + BLOCK < len(text) and block[-1] not in _BLANKS:
            held = xxhash.xxh3_64(words.pop())
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words)))
    if held is not None:
        out.append(np.array([held.intdigest()], "uint64"))
    return np.concatenate(out) if out else np.zeros(0, "uint64")


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    w = word_hashes(text)
    n = min(words, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, "uint64")
    for k in range(n):
        h *= _Q
        h += w[k : len(w) - n + 1 + k]
    h = mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


@functools.cache
def fill_order() -> np.ndarray:
    """For each bucket, the order in which others fill it when it is empty."""
    rng = np.random.default_rng(7)
    return np.stack([np.concatenate([[b], rng.permutation(np.delete(np.arange(BUCKETS), b))]) for b in range(BUCKETS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """BUCKETS registers of 16 bits of sorted distinct hashes (at least one)."""
    bucket = (hashes >> np.uint64(56)).astype("int64")
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = hashes[first] << np.uint64(8)  # sorted: the first of a bucket is its least
    zeros = np.where(rest > 0, 64 - np.frexp(np.maximum(rest, np.uint64(1)).astype("float64"))[1], 63).clip(0, 62).astype("uint64")
    bits = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(BUCKETS, "uint16")
    have = np.zeros(BUCKETS, bool)
    have[bucket[first]] = True
    out[bucket[first]] = (zeros << np.uint64(MANTISSA) | bits).astype("uint16")
    if len(first) < BUCKETS:
        empty, order = np.flatnonzero(~have), fill_order()
        for at in range(1, BUCKETS, 16):  # most find one early in their order
            tried = order[empty, at : at + 16]
            full = have[tried]
            found, place = full.any(axis=1), full.argmax(axis=1)
            out[empty[found]] = out[tried[found, place[found]]]
            empty = empty[~found]
            if not len(empty):
                break
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band's registers."""
    pairs = np.ascontiguousarray(sketch).view("uint64").reshape(BANDS, ROWS // 4)
    h = np.arange(1, BANDS + 1, dtype="uint64") * _P
    for k in range(ROWS // 4):
        h = mixed(h * _Q + pairs[:, k])
    return h.view("int64")


def chance(n_a: int, n_b: int) -> float:
    """The share of registers that sets of these sizes with nothing in common have equal."""
    level = np.arange(56)
    p, q = (np.exp(-n / BUCKETS * 2.0 ** -(level + 1)) - np.exp(-n / BUCKETS * 2.0**-level) for n in (n_a, n_b))
    return float((p * q).sum() / 2**MANTISSA)


def estimate(a: bytes, b: bytes, n_a: int, n_b: int) -> float:
    """The Jaccard similarity by two sketches, chance collisions taken off."""
    equal = float((np.frombuffer(a, "uint16") == np.frombuffer(b, "uint16")).mean())
    c = chance(n_a, n_b)
    return max(0.0, (equal - c) / (1 - c))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch); h1 and h2 tell the set, and are null for an empty one."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n_shingles": [], "h1": [], "h2": [], "sketch": []}
            for text in batch["text"]:
                s = shingles(text)
                out["n_shingles"].append(len(s))
                out["h1"].append(int(mixed(s).sum(dtype="uint64").astype("int64")) if len(s) else None)
                out["h2"].append(int(mixed(s * _Q + _P).sum(dtype="uint64").astype("int64")) if len(s) else None)
                out["sketch"].append(registers(s).tobytes() if len(s) else None)
            yield out

    fields = [field("doc_id", "long"), field("n_shingles", "long"), field("h1", "long"), field("h2", "long"), field("sketch", "binary")]
    return map_columns(docs, _inputs(), fields, run)


def _inputs() -> dict:
    return {"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}


def band_rows(reps: DataFrame) -> DataFrame:
    """(key, node, n, copies): a row for each band of each representative."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"node": batch["node"], "n": batch["n"], "copies": batch["copies"], "keys": [band_keys(np.frombuffer(s, "uint16")).tolist() for s in batch["sketch"]]}

    fields = [field("node", "long"), field("n", "long"), field("copies", "long"), field("keys", ["long"])]
    found = map_columns(reps, {c: F.col(c) for c in ("node", "n", "copies", "sketch")}, fields, run)
    return found.select(F.explode("keys").alias("key"), "node", "n", "copies")


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches' estimate doesn't rule out."""
    side = {c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            kept = [
                k for k, (n_a, n_b) in enumerate(zip(batch["n_a"], batch["n_b"]))
                if estimate(batch["sketch_a"][k], batch["sketch_b"][k], n_a, n_b) >= LEAST_ESTIMATE
            ]
            yield {c: [batch[c][k] for k in kept] for c in "ab"}

    return map_columns(both, {c: F.col(c) for c in both.columns}, [field("a", "long"), field("b", "long")], run)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of nodes(node, h1, h2): the sets of these documents only."""
    rows = docs.select(*[c.alias(n) for n, c in _inputs().items()]).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield {"node": batch["doc_id"], "h1": [int(mixed(s).sum(dtype="uint64").astype("int64")) for s in sets], "hashes": [s.tobytes() for s in sets]}

    sets = map_columns(rows, {"doc_id": F.col("doc_id"), "text": F.col("text")}, [field("node", "long"), field("h1", "long"), field("hashes", "binary")], run)
    one = nodes.groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("h")).select("node", F.col("h.h1").alias("h1"))
    return sets.join(one, ["node", "h1"]).dropDuplicates(["node"]).select("node", "hashes")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch["set_a"], batch["set_b"])):
                x, y = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(k)
            yield {c: [batch[c][k] for k in kept] for c in "ab"}

    return map_columns(both, {c: F.col(c) for c in both.columns}, [field("a", "long"), field("b", "long")], run)


WORDS = 8


def odd_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS places, whether an odd number of hashes falls there, as WORDS numbers.

    A hash that only one of two sets has changes one place, so no more places differ than hashes do.
    """
    counts = np.bincount((hashes >> np.uint64(64 - 9)).astype("int64"), minlength=64 * WORDS)
    return np.packbits((counts & 1).astype("uint8")).view("int64")


def prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, label, role) for members(hub, node, n, label, n_low, n_high): the first entries of each one's difference from the hub.

    n_low and n_high bound the sizes of the hub's members. role 0: an unlinked member for others like
    it; 2: an unlinked one for linked ones; 1: a linked one.
    """
    side = {c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}")) for c in ("node", "hub")}
    both = members.join(side["node"], "node").join(side["hub"], "hub")
    c = (100 - percent) / (100 + percent)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            keys, rest = [], {k: [] for k in ("node", "n", "label", "role", *[f"odd{i}" for i in range(WORDS)])}
            for hub, node, n, label, x, y, low, high in zip(*[batch[k] for k in ("hub", "node", "n", "label", "set_hub", "set_node", "n_low", "n_high")]):
                x, y = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
                extra, missing = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                apart = len(extra) + len(missing)
                high = min(high, 100 * len(y) / percent)  # a partner's largest size
                allowed = c * (len(y) + high)
                order = np.concatenate([extra, missing ^ _P])
                odd = odd_bits(y)
                far = c * (len(x) + max(low, percent * len(y) / 100))  # what an unlinked partner differs from the hub by, at least
                linked = apart <= c * (len(y) + len(x)) + 1e-9
                near = max(0.0, apart - allowed)  # what any partner does
                # unlinked members meet each other under one set of keys, and linked ones under another
                for role, other in ((1, far),) if linked else ((0, far), (2, near)):
                    t = max(1, int(np.ceil((apart + other - allowed) / 2 - 1e-6)))
                    salt = mixed(np.array([hub], "int64").view("uint64") * _Q + np.uint64(role > 0))
                    own = mixed(order[: max(0, apart - t + 1)] ^ salt).view("int64")
                    keys.append(own)
                    for name, value in zip(rest, (node, n, label, role, *odd)):
                        rest[name].append(np.full(len(own), value, "int64"))
            none = [np.zeros(0, "int64")]
            yield {"key": np.concatenate(none + keys)} | {k: np.concatenate(none + v) for k, v in rest.items()}

    fields = [field(name, "long") for name in ("key", "node", "n", "label", "role", *[f"odd{i}" for i in range(WORDS)])]
    return map_columns(both, {name: F.col(name) for name in both.columns}, fields, run)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of links(a, b): label is the least node reachable. Least labels spread along links and along labels, so rounds grow with the log of a chain."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), "label")
        goal = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = written(spread.join(goal, "next").select("node", F.least("next", "far").alias("next"), "label"), "labels")
        moved = after.filter(F.col("next") != F.col("label")).limit(1).count()
        drop_written(labels)
        labels = after.select("node", F.col("next").alias("label"))
        if not moved:
            drop_written(edges)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85, part: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    part: members of a hot key that meet all others of the key in one go.
    """
    scratch: list[DataFrame] = []

    def kept_for_now(df: DataFrame, name: str) -> DataFrame:
        scratch.append(written(df, name))
        return scratch[-1]

    sketched = written(sketches(docs), "sketches")
    classes = kept_for_now(sketched.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    reps = sketched.withColumnRenamed("doc_id", "node").join(classes, ["h1", "h2", "node"])
    reps = kept_for_now(reps.select("node", F.col("n_shingles").alias("n"), "copies", "h1", "h2", "sketch"), "reps")

    bands = band_rows(reps)
    buckets = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    shared = kept_for_now(bands.join(buckets, "key"), "buckets")
    alike = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent  # else the sizes alone rule a link out

    hub = F.min(F.struct((-F.col("copies")).alias("c"), F.xxhash64("node").alias("h"), F.col("node").alias("hub"), F.col("n").alias("n2"))).alias("hub")
    hubs = shared.groupBy("key").agg(hub).select("key", "hub.hub", "hub.n2")
    star = kept_for_now(shared.join(hubs, "key").filter("node <> hub").select("hub", "n2", "node", "n").distinct(), "star")
    nodes = star.select(F.col("hub").alias("node")).unionByName(star.select("node")).distinct().join(reps.select("node", "h1", "h2"), "node")
    sets = kept_for_now(full_sets(docs, nodes), "sets")
    first = star.filter(alike).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = kept_for_now(checked(likely(first, reps), sets, percent), "links")

    labels = components(links)
    members = star.select("hub", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = kept_for_now(members, "members")
    several = members.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("n_low"), F.max("n").alias("n_high")).filter("low < high").drop("low", "high")
    entries = kept_for_now(prefixes(members.join(several, "hub"), sets, percent), "entries")
    several = entries.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / part).cast("long").alias("parts")).filter("low < high").select("key", "parts")
    several = kept_for_now(several, "several")
    # most keys meet as they lie; a hot one's members are dealt to its parts, each of which gets the whole key
    cold = entries.join(several.filter("parts = 1"), "key").drop("parts")
    hot = entries.join(several.filter("parts > 1"), "key")
    dealt = hot.filter("role <> 1").withColumn("part", F.pmod(F.xxhash64("node", "role"), F.col("parts"))).drop("parts")
    whole = hot.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).drop("parts")

    def across_of(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.filter("role < 2").select(*on, F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("label").alias("label2"), F.col("role").alias("role2"), *[F.col(f"odd{i}").alias(f"other{i}") for i in range(WORDS)])
        differ = sum((F.bit_count(F.col(f"odd{i}").bitwiseXOR(F.col(f"other{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("odd0").bitwiseXOR(F.col("other0"))))
        near = differ * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)  # else they differ by more than a link allows
        meet = ((F.col("role") == 0) & (F.col("label") < F.col("label2"))) | ((F.col("role") == 2) & (F.col("role2") == 1) & (F.col("label") != F.col("label2")))
        found = left.join(right, on).filter(meet & alike & near)
        return found.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))

    across = across_of(cold.filter("role <> 1"), cold, ["key"]).unionByName(across_of(dealt, whole, ["key", "part"]))
    across = kept_for_now(across.distinct(), "across")
    more = kept_for_now(checked(likely(across, reps), sets, percent), "links")

    labels = components(links.unionByName(more))
    of_class = written(classes.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("component")), "components")
    for table in scratch:
        drop_written(table)
    rows = sketched.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
