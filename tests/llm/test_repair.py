import hashlib
import heapq
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import registry, repair

GOOD = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    """(cost, audit, repaired) by a search over whole edit scripts, least (cost, audit) first. rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, initials = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, initials
        tail = initials[-1:]
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        for c in set(legal) & {"u", "a"}:
            heapq.heappush(heap, (cost + 5, audit + "I", i, initials + c))
        if i < len(rows):
            role, _, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] and role[0] in legal:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initials + role[0]))
                for c in set(legal) & {"u", "a"}:
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, initials + c))
    raise AssertionError


def expected(rows):
    """What op11 reports of one conversation's damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, initials = brute(marked)
    out, i, made = [], 0, 0
    for edit in audit:
        name = {"u": "user", "a": "assistant"}.get(initials[made : made + 1])
        if edit == "I":
            out.append(f"{name}:")
        elif edit != "D":
            out.append(f"{marked[i][0] if edit == 'K' else name}:{marked[i][1]}")
        made += edit != "D"
        i += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    pairs = ["".join(x) for x in zip([r[1][:1] for r in rows], [r[1][:1] for r in rows[1:]])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "cost": cost, "audit": audit, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            **{k: sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")}, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        for _ in range(0 if fate == 0 else 2 if fate == 3 else 1):
            yield conv, turn, "user" if fate == 4 else role, text


def check(found, given):
    by_conv = {c: [] for c, *_ in given}
    for conv, *row in damage(given):
        by_conv[conv].append(tuple(row))
    assert {r.conv_id for r in found} == set(by_conv) and len(found) == len(by_conv)
    for r in found:
        assert {k: v for k, v in r.asDict().items() if k != "conv_id"} == expected(by_conv[r.conv_id]), (r, by_conv[r.conv_id])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([None, "truncated", "blank"])), max_size=9))
def test_edits_are_the_cheapest(rows):
    marked = [(role, "", fault) for role, fault in rows]
    codes = bytes(4 * {None: 0, "blank": 1, "truncated": 2}[f] + ("sua".index(r) if r else 3) if r != "t" else 4 * {None: 0, "blank": 1, "truncated": 2}[f] + 3 for r, f in rows)
    assert repair.cheapest(codes) == brute(marked)[:2]


def test_long_conversation():
    codes = bytes((k * k // 3 + k) % 12 for k in range(50_000))
    cost, audit = repair.cheapest(codes)
    assert cost == sum(repair.COSTS[e] for e in audit) + repair.TRUNCATED * sum(code // 4 == 2 and e != "D" for code, e in zip(codes, audit.replace("I", "")))
    assert len(audit.replace("I", "")) == len(codes)


def test_query(spark):
    found = registry.op11_conversation_repair(spark, "/root/testdata/sf0.01").collect()
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(found, given)


def test_odd_rows(spark, tmp_path):
    rows = [(k, t, r, x) for k in range(12) for t, r, x in [(None, "user", "Hello."), (0, "system", "Be so. "), (0, "user", "a tie?"), (0, "assistant", "a tie?"), (3, None, None), (4, "tool", "x" * 50_000 + "!"), (4, "tool", "x" * 50_000 + "!"), (5, "", "cut off \n"), (9, "assistant", "é.\u3000")]]
    rows += [(None, None, None, None), (None, None, None, None), (None, 2, "user", "Of no one."), (None, 3, "assistant", "So.")]
    rows += [(77, t, "user" if t % 2 else "assistant", f"Said {t}.") for t in range(3000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(1)).withColumn("audit", F.lit("x")).repartition(3)
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    check(registry.op11_conversation_repair(spark, str(tmp_path)).collect(), rows)
    turns = repair.ordered(docs)
    kept = repair.repaired_turns(turns, repair.reports(turns)).collect()
    for conv in {r.conv_id for r in kept}:
        own = sorted((r for r in kept if r.conv_id == conv), key=lambda r: r.position)
        assert GOOD.fullmatch("".join(r.role[0] for r in own)) and [r.position for r in own] == list(range(len(own)))
    docs.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert registry.op11_conversation_repair(spark, f"{tmp_path}/none").count() == 0
