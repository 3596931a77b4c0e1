"""Secret scan in DataFrame functions only: fixed patterns, and a battery of randomness tests.

Base spans come from three patterns. The method adds spans of kind ``random``: tokens whose
characters pass for random. A token's encoding is inferred from its characters (hex, base32, base62,
base64); within that alphabet it takes a chi-squared test of uniform use, a runs test about the
alphabet's middle and a lag-one serial correlation test, and Fisher's sum joins their p-values.

How small that sum is by chance is told by decoys: every document's own letters in windows that don't
overlap, at every token length and spelled in every alphabet. Among the tokens of one
encoding and length class a token's p-value is the share of decoys that look as random as it does,
and Benjamini-Hochberg over the whole table holds the share of false discoveries below ``rate`` in
each class, so short tokens face the stricter test that their length calls for. A token whose
randomness the battery itself rejects at a thousandth is never one, whatever the decoys say. The classes and
score bins are few and fixed, so the histogram that gives the limits never grows.

Null texts are empty; empty texts have no spans. Spans are code points, end exclusive. Repeated rows are scanned one
by one and give equal rows; tokens of one score share their fate. An empty table gives an empty one. A text's
spans are worked out where the text lies; n of them take n log n steps. scan() returns its
own columns alone; redact() passes all other columns through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run holds no longer one, so the least length can be part of the pattern
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_\-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LENGTHS = [20, 24, 32, 48, 64]
#: Fisher's sum of a random token passes this in one case of a thousand (chi-squared, six degrees of freedom).
REJECTED = 22.46
BINS = 240  # of Fisher's sum, in steps of a quarter; the last one takes all beyond


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for each row however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def apart(value: Column) -> Column:
    """value, by way of a lambda: Spark then cuts the code of the projection that holds it into methods small enough for the JVM to compile.

    Without it, the long sums below become one method of over 8000 bytes, which the JVM only interprets, fifty times slower.
    """
    return let(value, lambda v: v)


def ends_of(lengths: Column) -> Column:
    """The running sums of an array of numbers, by doubling: after k steps each one adds up 2 ** k numbers before it."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(lengths))), F.lit(0)).cast("int"))
    return F.aggregate(steps, lengths, lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>> of the leftmost non-overlapping matches.

    What stands between matches and the matches themselves, in turn, give the places: n matches take n log n steps.
    """
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    # the last gap has no match after it
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, f: F.struct(F.length(b).alias("between"), f.alias("found")))
    pairs = F.filter(pairs, lambda p: p["found"].isNotNull())

    def placed(found: Column) -> Column:
        ends = ends_of(F.transform(found, lambda p: p["between"] + F.length(p["found"])))
        return F.zip_with(found, ends, lambda p, end: F.struct((end - F.length(p["found"])).alias("start"), end.alias("end"), p["found"].alias("found")))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(none)


def of_kind(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start,rank,end>> of the three patterns, by start, then kind."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 12)
    return F.array_sort(F.concat(of_kind(assign, "assign"), of_kind(matches(text, ACCESS), "access"), of_kind(matches(text, HEX), "hex")))


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic fit that is within 2e-4."""
    x = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return F.greatest(1 / (1 + F.exp(1.5976 * x + 0.070565992 * x * x * x)), F.lit(1e-12))


def joined(f: Column | dict, k: Column) -> Column:
    """Fisher's sum from a token's facts, a struct or a dict of columns, under an alphabet of k characters."""
    df, zero = k - 1, F.lit(0.0)
    n = f["n"]
    chi = f["squares"] * k / n - n
    p_uniform = normal_tail((F.cbrt(F.greatest(chi, zero) / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    both = 2 * f["ones"] * (n - f["ones"])
    spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
    p_runs = F.when(both == 0, F.lit(1e-12)).otherwise(F.least(2 * normal_tail(F.abs(f["runs"] - both / n - 1) / spread), F.lit(1.0)))
    p = f["places"]
    mean = p["sum"] / n
    power = p["squares"] - n * mean * mean
    lagged = p["lagged"] - mean * (2 * p["sum"] - f["first"] - p["last"]) + (n - 1) * mean * mean
    p_serial = F.when(power <= 1e-9, F.lit(1e-12)).otherwise(F.least(2 * normal_tail(F.abs((lagged / power + 1 / n) * F.sqrt(n))), F.lit(1.0)))
    return -2 * F.log(p_uniform * p_runs * p_serial)  # each is 1e-12 at least


def fisher_sum(token: Column, alphabet: str) -> Column:
    """-2 times the sum of the logs of the three tests' p-values; small for a random token."""
    k = len(alphabet)
    letters = F.array(*map(F.lit, alphabet))
    zero = F.lit(0.0)

    def walk(s: Column, c: Column) -> Column:
        return let(F.instr(F.lit(alphabet), c).cast("double"), lambda x: F.struct(x.alias("last"), (s["sum"] + x).alias("sum"), (s["squares"] + x * x).alias("squares"), (s["lagged"] + s["last"] * x).alias("lagged")))

    start = F.struct(zero.alias("last"), zero.alias("sum"), zero.alias("squares"), zero.alias("lagged"))
    halves = F.translate(token, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    counts = F.aggregate(letters, zero, lambda a, c: a + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    facts = F.struct(
        F.length(token).cast("double").alias("n"), counts.alias("squares"),
        F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double").alias("ones"),
        F.length(F.regexp_replace(halves, "0+|1+", "x")).cast("double").alias("runs"),
        F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, walk).alias("places"),
        F.instr(F.lit(alphabet), F.substring(token, 1, 1)).cast("double").alias("first"),
    )

    return let(facts, lambda f: joined(f, F.lit(float(k))))


def encoding_of(token: Column) -> Column:
    """The number of the smallest alphabet that holds the token; null for words, numbers and paths."""
    bare = F.rtrim(token, F.lit("="))
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")
    return (
        F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & mixed, 0)
        .when(bare.rlike("^[A-Z2-7]+$") & mixed, 1)
        .when(bare.rlike("^[A-Za-z0-9]+$") & mixed, 2)
        .when(bare.rlike("^[A-Za-z0-9+/_\\-]+$") & mixed & bare.rlike("[a-z]") & bare.rlike("[A-Z]"), 3)
    )


def spelled(token: Column, encoding: Column) -> Column:
    """The token in its alphabet's own characters."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    return F.when(encoding == 0, F.lower(bare)).otherwise(bare)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, k).otherwise(out)
    return out


def scored(token: Column, encoding: Column) -> Column:
    """The bin of Fisher's sum under the token's encoding."""
    total = F.lit(None).cast("double")
    for k, alphabet in enumerate(ALPHABETS.values()):
        total = F.when(encoding == k, fisher_sum(token, alphabet)).otherwise(total)
    return binned(total)


def binned(total: Column) -> Column:
    return F.least(F.floor(total * 4), F.lit(BINS - 1)).cast("int")


def tokens(text: Column) -> Column:
    """array<struct<start,end,encoding,word>> of what may be encoded."""
    def encoded(m: Column) -> Column:
        return let(encoding_of(m["found"]), lambda e: F.struct(m["start"].alias("start"), m["end"].alias("end"), e.alias("encoding"), spelled(m["found"], e).alias("word")))

    return F.filter(F.transform(matches(text, TOKEN), encoded), lambda t: t["encoding"].isNotNull())


def histogram(docs: DataFrame) -> DataFrame:
    """(encoding, length_class, bin, n_tokens, n_decoys) over the whole table: some thousand rows at most."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(text.alias("text")).filter(F.col("text").rlike(TOKEN)).select(F.explode(tokens(F.col("text"))).alias("t"))
    of_tokens = found.select(F.col("t.encoding").alias("encoding"), F.col("t.word").alias("word"))
    rows = of_tokens.select("encoding", length_class(F.length("word")).alias("length_class"), scored(F.col("word"), F.col("encoding")).alias("bin"))
    counted = rows.groupBy("encoding", "length_class", "bin").agg(F.count("*").alias("n_tokens")).withColumn("n_decoys", F.lit(0).cast("long"))
    return counted.unionByName(decoys(docs)).groupBy("encoding", "length_class", "bin").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_decoys").alias("n_decoys"))


#: A block of letters is a whole number of windows of every length; these are its windows.
BLOCK = math.lcm(*LENGTHS)
WINDOWS = [(n, at) for n in LENGTHS for at in range(0, BLOCK, n)]


def decoys(docs: DataFrame) -> DataFrame:
    """(encoding, length_class, bin, n_tokens 0, n_decoys) of every window of the texts' letters, for all encodings and lengths.

    Texts are cut into blocks first, so the work follows their length.
    """
    letters = F.lower(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[^A-Za-z]+", ""))
    blocks = docs.select(F.explode(F.regexp_extract_all(letters, F.lit(f"[a-z]{{1,{BLOCK}}}"), F.lit(0))).alias("block"))
    places = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(at).alias("at")) for n, at in WINDOWS])
    rows = blocks.select(eights(F.col("block")).alias("eights"), F.length("block").alias("size"), places.alias("places"))
    rows = rows.select("eights", "size", F.explode("places").alias("w")).select("eights", "size", "w.n", "w.at").filter("at + n <= size")
    return decoy_bins(planes(rows)).groupBy("encoding", "length_class", "bin").agg(F.lit(0).cast("long").alias("n_tokens"), F.count("*").alias("n_decoys"))


def eights(block: Column) -> Column:
    """array<long>: eight small letters at a time as their numbers 0 to 25, of which byte k holds bit k of each, the first letter's on top.

    A number of eight letters is a matrix of eight times eight bits, transposed in three steps.
    """
    letters = F.rpad(F.hex(F.encode(block, "utf-8")), F.ceil(F.length(block) / 8).cast("int") * 16, "61")
    numbers = F.transform(F.regexp_extract_all(letters, F.lit("[0-9A-F]{16}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long") - 0x0101010101010101)

    def swaps(step: int, mask: int):
        return lambda x: let(x.bitwiseXOR(F.shiftrightunsigned(x, step)).bitwiseAND(F.lit(mask)), lambda t: x.bitwiseXOR(t).bitwiseXOR(F.shiftleft(t, step)))

    for step, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        numbers = F.transform(numbers, swaps(step, mask))
    return numbers


def planes(windows: DataFrame) -> DataFrame:
    """(n, b0..b4) of windows(n, at, eights): letters at + 1 to at + n, bk holding bit k of each, the first letter's on top. at is a multiple of 4."""
    places = range(0, max(LENGTHS), 8)
    rows = windows.select("n", (F.col("at") % 8).alias("off"), F.shiftright("at", 3).alias("from"), "eights")
    rows = rows.select("n", "off", *[F.coalesce(F.get("eights", F.col("from") + k), F.lit(0).cast("long")).alias(f"x{at}") for k, at in enumerate(places)])

    def plane(k: int) -> Column:
        whole = F.lit(0).cast("long")
        for at in places:
            whole = whole.bitwiseOR(F.shiftleft(F.shiftrightunsigned(f"x{at}", 8 * k).bitwiseAND(F.lit(255).cast("long")), 56 - at))
        return whole

    rows = rows.select(apart(F.col("n")).alias("n"), "off", *[plane(k).alias(f"w{k}") for k in range(5)])
    return rows.select("n", *[F.expr(f"shiftrightunsigned(shiftleft(w{k}, off), 64 - n)").alias(f"b{k}") for k in range(5)])


def decoy_bins(planes: DataFrame) -> DataFrame:
    """(encoding, length_class, bin) of windows (n, b0..b4) as planes() makes them, for every encoding.

    The bins are scored()'s for the window spelled in hex as the numbers modulo 16, in base32 by capitals,
    and in base62 and base64 by small letters. A shift of all places leaves the serial correlation as it is.
    """
    # doubles hold these small whole numbers exactly, and their arithmetic needs no check for overflow
    n, b, zero = F.col("n"), [F.col(f"b{k}") for k in range(5)], F.lit(0.0)
    bits = [f"b{k}" for k in range(5)]
    full = F.when(n >= 64, F.lit(-1).cast("long")).otherwise(F.expr("shiftleft(1L, n) - 1"))
    rows = planes.select(apart(n).alias("n"), full.alias("full"), *bits)
    out = [F.bitwise_not(x).bitwiseAND(F.col("full")) for x in b]

    def held(letter: int) -> Column:
        found = b[0] if letter & 1 else out[0]
        for k in range(1, 5):
            found = found.bitwiseAND(b[k] if letter >> k & 1 else out[k])
        return F.bit_count(found).cast("double")

    rows = rows.select(apart(n).alias("n"), "full", *bits, *[held(i).alias(f"c{i}") for i in range(26)])
    c = [F.col(f"c{i}") for i in range(26)]
    counts = {"hex": [c[i] + c[i + 16] if i < 10 else c[i] for i in range(16)], "all": c}

    def facts(kind: str) -> dict[str, Column]:
        most = 4 if kind == "hex" else 5
        lagged = sum((F.bit_count(b[i].bitwiseAND(F.shiftrightunsigned(b[j], 1))).cast("double") * float(1 << i + j) for i in range(most) for j in range(most)), zero)
        # the number of the first letter (the top bit) and of the last one
        first, last = (sum((F.expr(f"shiftrightunsigned(b{k}, {at})").bitwiseAND(F.lit(1).cast("long")).cast("double") * float(1 << k) for k in range(most)), zero) for at in ("n - 1", "0"))
        made = {"squares": lambda i, x: x * x, "sum": lambda i, x: x * float(i), "power": lambda i, x: x * float(i * i)}
        return {k: sum((f(i, x) for i, x in enumerate(counts[kind])), zero) for k, f in made.items()} | {"lagged": lagged, "first": first, "last": last}

    beyond = b[4].bitwiseOR(b[3])
    halves = [b[3], b[4], beyond.bitwiseOR(b[2].bitwiseAND(b[1].bitwiseOR(b[0]))), beyond.bitwiseOR(b[2].bitwiseAND(b[1]))]
    kinds = {kind: facts(kind) for kind in counts}
    rows = rows.select(apart(n).alias("n"), "full", *[h.alias(f"half{e}") for e, h in enumerate(halves)], *[v.cast("double").alias(f"{kind}_{k}") for kind, own in kinds.items() for k, v in own.items()])

    def runs(e: int) -> Column:
        return F.bit_count(F.col(f"half{e}").bitwiseXOR(F.shiftrightunsigned(f"half{e}", 1)).bitwiseAND(F.shiftrightunsigned("full", 1))).cast("double") + 1.0

    known = [f"{kind}_{k}" for kind, own in kinds.items() for k in own]
    rows = rows.select(apart(n.cast("double")).alias("n"), length_class(n).alias("length_class"), *known, *[x.cast("double").alias(f"{name}{e}") for e in range(len(halves)) for name, x in (("ones", F.bit_count(f"half{e}")), ("runs", runs(e)))])

    def bin_of(e: int, alphabet: str) -> Column:
        own = {k: F.col(f"{'all' if e else 'hex'}_{k}") for k in ("squares", "sum", "power", "lagged", "first", "last")}
        places = {"sum": own["sum"], "squares": own["power"], "lagged": own["lagged"], "last": own["last"]}
        return binned(joined({"n": F.col("n"), "squares": own["squares"], "ones": F.col(f"ones{e}"), "runs": F.col(f"runs{e}"), "first": own["first"], "places": places}, F.lit(float(len(alphabet)))))

    rows = rows.select(apart(F.col("length_class")).alias("length_class"), *[bin_of(e, a).alias(f"bin{e}") for e, a in enumerate(ALPHABETS.values())])
    return rows.select("length_class", F.posexplode(F.array(*[f"bin{e}" for e in range(len(halves))])).alias("encoding", "bin"))


def limits(counts: DataFrame, rate: float = 0.05) -> dict[tuple[int, int], int]:
    """For each (encoding, length class): the last bin whose tokens are discoveries. counts: rows of histogram()."""
    by: dict[tuple[int, int], list] = {}
    for r in counts.collect():
        by.setdefault((r["encoding"], r["length_class"]), []).append((r["bin"], r["n_tokens"], r["n_decoys"]))
    out = {}
    for kind, bins in by.items():
        all_tokens, all_decoys = sum(b[1] for b in bins), sum(b[2] for b in bins)
        seen = decoys = 0
        for bin_, n, d in sorted(bins):
            seen, decoys = seen + n, decoys + d
            if bin_ < REJECTED * 4 and seen and (decoys + 1) / (all_decoys + 1) * all_tokens / seen <= rate:
                out[kind] = bin_
    return out


def spans(text: Column, limit: dict[tuple[int, int], int]) -> tuple[Column, Column]:
    """The base spans, and those with the random tokens added."""
    base = base_spans(text)
    table = F.create_map(*[F.lit(x) for (e, c), b in sorted(limit.items()) for x in (e * 16 + c, b)]) if limit else None
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    if table is None:
        return base, base
    random = F.filter(tokens(text), lambda t: scored(t["word"], t["encoding"]) <= F.try_element_at(table, t["encoding"] * 16 + length_class(F.length(t["word"]))))
    added = F.when(text.rlike(TOKEN), F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))).otherwise(none)
    return base, F.array_sort(F.concat(base, added))


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, base, spans) of docs(doc_id, text): arrays of struct<start,rank,end>, rank the place in KINDS."""
    limit = limits(histogram(docs), rate)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base, found = spans(F.col("text"), limit)
    return rows.select("doc_id", base.alias("base"), found.alias("spans"))


def redact(docs: DataFrame, rate: float = 0.05, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by mark; spans that touch or overlap are one. Null texts stay null."""
    limit = limits(histogram(docs), rate)
    _, found = spans(F.col("text"), limit)

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] > state["at"]
        between = F.substring(state["text"], state["at"] + 1, span["start"] - state["at"])
        out = F.when(apart | (state["at"] == 0), F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"), state["text"].alias("text"))

    text = F.col("text")
    cleaned = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), text.alias("text")), step,
                          lambda s: F.concat(s["out"], F.substring(s["text"], s["at"] + 1, F.length(s["text"]))))
    return docs.withColumn("text", F.when(F.size(found) > 0, cleaned).otherwise(text))
