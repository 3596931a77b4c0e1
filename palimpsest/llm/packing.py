"""Best-fit packing: documents into as few token sequences as possible, bettered by swaps.

``token_pieces`` turns documents into pieces of at most ``length`` tokens, ``pack`` places pieces
into sequences, ``assemble`` makes the token rows of the sequences. Packing runs in groups of
about the same size, dealt out by a hash of the row's number in the written table, whatever the rows
hold, so no task holds more than its group; a group may waste a sequence more than a single packing of
all pieces would.

Null and empty texts are one piece that holds the end token alone; a null doc_id is an id like any other.
Repeated rows are documents of their own, and pieces of equal length are placed by (doc_id, piece, crc). Texts
are read in blocks cut at white space, so memory follows the longest run without white space, not the text. A piece
is never split further and never dropped. An empty table gives no sequences. Columns besides doc_id and text are
neither read nor returned.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import BoundedCache, field, map_columns, text_blocks, written

#: Runs of these characters are cut and lower-cased here; the library does all others.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]*")
#: The vocabulary's pattern, for those characters in lower case.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")

_encoders: dict[str, BoundedCache] = {}


def chunk_encoder(path: str) -> BoundedCache:
    """Maps a run of bytes without white space to its ids (uint32 bytes), by the tokenizers library.

    The vocabulary's pattern never joins across white space and its normalizer composes nothing
    across it, so a text's ids are its runs' ids in order. A plain run's words go to the library's
    model one by one, as most of them occur in other runs too; runs and words share one cache, since most runs are a word.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        symbols = byte_symbols()
        tokenize = tokenizer.model.tokenize
        id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(tokenizer.get_vocab().values()))]

        def word_ids(word: str) -> bytes:
            mapped = word if word.isascii() else "".join(symbols[b] for b in word.encode())
            return b"".join([id_bytes[t.id] for t in tokenize(mapped)])

        def encode(chunk: bytes) -> bytes:
            if chunk.isalpha():  # of a-z and A-Z alone: one word
                return b"".join([id_bytes[t.id] for t in tokenize(chunk.lower().decode())])
            if chunk[:-1].isalpha() and b"!" <= chunk[-1:] <= b"~":  # a word and a digit or sign after it
                return cache[chunk[:-1]] + cache[chunk[-1:]]
            text = chunk.decode()
            if "<|" not in text and _PLAIN.fullmatch(text):
                words = _CUT.findall(text.lower())
                return word_ids(words[0]) if len(words) == 1 else b"".join([cache[w.encode()] for w in words])
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        cache = _encoders[path] = BoundedCache(encode, 80 << 20)
    return _encoders[path]


def block_ids(text: bytes, encode, end: bytes) -> Iterator[bytes]:
    """The ids of text as uint32 bytes, a block of it at a time, and the end token's."""
    for block in text_blocks(text, anywhere=False):
        runs = block.split() if b"<|" in block else block.lower().split()  # the vocabulary's normalizer lower-cases too
        yield b"".join(map(encode, runs))
    yield end


def cut(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The parts' bytes in pieces of size; the last one may be shorter."""
    held = b""
    for part in parts:
        held = held + part if held else part
        whole = len(held) - len(held) % size
        for at in range(0, whole, size):
            yield held[at : at + size]
        held = held[whole:]
    if held:
        yield held


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text).

    tokenizer: path of a vocabulary file whose pattern drops white space.
    """

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        encode = chunk_encoder(tokenizer).__getitem__
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for k, part in enumerate(cut(block_ids(text, encode, end), 4 * length)):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(k * length)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").tolist())
            yield out

    fields = [field("doc_id", "long"), field("piece", "int"), field("start", "long"), field("length", "long"), field("ids_crc32", "long")]
    if keep_ids:
        fields.append(field("ids", ["long"]))
    inputs = {"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}
    return map_columns(docs, inputs, fields, pieces)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = {}  # by room left
    rooms: list[int] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            bins.append([item])
            room, b = capacity, len(bins) - 1
        else:
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            bins[b].append(item)
        left = room - need
        if left:
            if left not in open_bins:
                open_bins[left] = []
                insort(rooms, left)
            open_bins[left].append(b)
    return bins


def room_for_smallest(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths, one bin after another: the longest item left, then always the longest that still leaves
    room for a shortest one, else the longest that fits. Better than best fit where few items of like lengths fill a bin."""
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stock.setdefault(n, []).append(i)
    below = [n if n in stock else n - 1 for n in range(capacity + 1)]  # the way to the longest item of at most n
    below[0] = 0

    def longest(n: int) -> int:
        seen = []
        while below[n] != n:
            seen.append(n)
            n = below[n]
        for k in seen:
            below[k] = n
        return n

    def take(n: int) -> int:
        i = stock[n].pop()
        if not stock[n]:
            below[n] = n - 1
        return i

    bins, sizes, at = [], sorted(stock), 0
    while top := longest(capacity):
        room, items = capacity - top, [take(top)]
        while True:
            while at < len(sizes) and not stock[sizes[at]]:
                at += 1
            if at == len(sizes) or room < sizes[at]:
                break
            n = longest(room - sizes[at]) or longest(room)
            items.append(take(n))
            room -= n
        bins.append(items)
    return bins


class Shelf:
    """The underfull bins by what they can take: by room, by the lengths in them, and by the sums of two lengths in them.

    ends[1][l] is the largest l + room of the bins that hold an item of length l, ends[2][s] the same of two items of
    lengths that sum to s: what can come in for them. A search is one pass over an array of capacity + 1 numbers.
    """

    def __init__(self, capacity: int):
        self.by_room: dict[int, set[int]] = {}
        self.rooms = np.zeros(capacity + 1, bool)
        self.holders: dict[int, dict[int, dict[int, set[int]]]] = {1: {}, 2: {}}
        self.ends = {n: np.full(capacity + 1, -1) for n in (1, 2)}

    def change(self, b: int, room: int, held: list[int], put: bool) -> None:
        """Puts bin b with these lengths on the shelf, or takes it off."""
        counts = Counter(held)
        own = sorted(counts)
        pairs = {x + y for k, x in enumerate(own) for y in own[k:] if x != y or counts[x] > 1}
        self.rooms[room] = _keep(self.by_room, room, b, put)
        for n, keys in ((1, own), (2, pairs)):
            for key in keys:
                rooms = self.holders[n].setdefault(key, {})
                _keep(rooms, room, b, put)
                self.ends[n][key] = key + max(rooms) if rooms else -1

    def taker(self, need: int) -> int | None:
        """A bin with room for need, and none to spare that a fuller one lacks."""
        at = int(self.rooms[need:].argmax()) + need
        return next(iter(self.by_room[at])) if self.rooms[at] else None

    def exchange(self, need: int, n: int) -> tuple[int, int] | None:
        """(bin, length): a bin that takes need for n items of that length together, the shortest such length; the fullest of such bins."""
        fits = self.ends[n][:need] >= need
        length = int(fits.argmax()) if need else 0
        if not need or not fits[length]:
            return None
        rooms = self.holders[n][length]
        return next(iter(rooms[min(r for r in rooms if length + r >= need)])), length


def _keep(sets: dict[int, set[int]], key: int, b: int, put: bool) -> bool:
    """Puts b into the set of key, or takes it out; whether there is still such a set."""
    if put:
        sets.setdefault(key, set()).add(b)
        return True
    sets[key].discard(b)
    if not sets[key]:
        del sets[key]
    return key in sets


def swap_search(bins: list[list[int]], lengths: list[int], capacity: int, fruitless: int = 4) -> list[list[int]]:
    """Moves and exchanges (one for one, one for two, two for one) that bring d tokens from a donor bin into a target.

    A step is taken only if the target ends fuller than the donor was. Squared fills then change by
    (t + d)^2 + (s - d)^2 - t^2 - s^2 = 2 d (t + d - s) > 0, for fills t and s of target and donor: their sum grows with
    each step and is bounded, so the search ends. Donors come emptiest first; one that can give no more goes back on the
    shelf with the room that it has gained, as a target for those after it. Passes over the bins go on until `fruitless`
    of them in a row have emptied none, or the bins are down to the lower bound.
    """
    bins = [list(b) for b in bins if b]
    fill = [sum(lengths[i] for i in b) for b in bins]
    shelf, left, bound = Shelf(capacity), len(bins), -(-sum(fill) // capacity)

    def change(b: int, put: bool) -> None:
        if 0 < fill[b] < capacity:
            shelf.change(b, capacity - fill[b], [lengths[i] for i in bins[b]], put)

    for b in range(len(bins)):
        change(b, True)
    vain = 0
    while left > bound and vain < fruitless:
        before = left
        queue = [(f, b) for b, f in enumerate(fill) if 0 < f < capacity]
        heapq.heapify(queue)
        while queue and left > bound:
            known, donor = heapq.heappop(queue)
            if known != fill[donor]:
                continue  # another fill by now, and in the queue as such
            change(donor, False)
            while bins[donor] and (step := _step(bins[donor], lengths, shelf, fill[donor], fill)):
                target, give, take = step
                change(target, False)
                back = _matching(bins[target], lengths, *take)
                out = [_matching(bins[donor], lengths, 1, n)[0] for n in give[:1]]
                out += [next(i for i in bins[donor] if lengths[i] == n and i not in out) for n in give[1:]]
                bins[donor] = [i for i in bins[donor] if i not in out] + back
                bins[target] = [i for i in bins[target] if i not in back] + out
                for b in (donor, target):
                    fill[b] = sum(lengths[i] for i in bins[b])
                change(target, True)
                if fill[target] < capacity:
                    heapq.heappush(queue, (fill[target], target))
            left -= not bins[donor]
            change(donor, True)
        vain = vain + 1 if left == before else 0
    return [b for b in bins if b]


def _matching(items: list[int], lengths: list[int], n: int, total: int) -> list[int]:
    """n (0 to 2) of the items whose lengths sum to total."""
    by: dict[int, int] = {}
    for i in items:
        if n == 1 and lengths[i] == total:
            return [i]
        if n == 2 and (j := by.get(total - lengths[i])) is not None:
            return [j, i]
        by[lengths[i]] = i
    return []


def _step(items: list[int], lengths: list[int], shelf: Shelf, given: int, fill: list[int]) -> tuple[int, list[int], tuple[int, int]] | None:
    """The target bin, the lengths that the donor of this fill gives, and how many of which total length it takes back; moves come first.

    Only steps after which the target is fuller than the donor was.
    """
    for target, give, take in _steps(items, lengths, shelf):
        if fill[target] + sum(give) - take[1] > given:
            return target, give, take
    return None


def _steps(items: list[int], lengths: list[int], shelf: Shelf) -> Iterator[tuple[int, list[int], tuple[int, int]]]:
    counts = Counter(lengths[i] for i in items)
    own = sorted(counts, reverse=True)
    for need in own:
        if (b := shelf.taker(need)) is not None:
            yield b, [need], (0, 0)
    for n in (1, 2):
        for need in own:
            if found := shelf.exchange(need, n):
                yield found[0], [need], (n, found[1])
    for k, need in enumerate(own):
        for other in own[k:]:
            if (need != other or counts[need] > 1) and (found := shelf.exchange(need + other, 1)):
                yield found[0], [need, other], (1, found[1])


def pack(pieces: DataFrame, length: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """pieces(doc_id, piece, start, length, ...) with sequence_id and offset.

    pieces is read more than once: give a written table, whose rows then have the same numbers whenever a task
    runs again. Full pieces are a sequence each and stay out of the groups.
    """
    short = pieces.filter(F.col("length") < length)
    groups = max(1, -(-short.count() // group_rows))
    columns = pieces.columns
    dealt = short.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(columns).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_pylist()
        start = min(best_fit(lengths, length), room_for_smallest(lengths, length), key=len)
        bins = swap_search(start, lengths, length)
        sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = (key[0].as_py() << 32) + b, at
                at += lengths[i]
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    placed = dealt.groupBy("grp").applyInArrow(packed, schema)
    whole = pieces.filter(F.col("length") >= length)
    whole = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def assemble(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, doc_ids): the tokens of each sequence in order; a sequence holds at most its length."""
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )


def packed_documents(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """token_pieces, written once, then pack."""
    return pack(written(token_pieces(docs, tokenizer, length), "pieces"), length)
