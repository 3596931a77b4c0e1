import hashlib
import re
from urllib.parse import urlsplit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import fim, registry, url_filter

SF = "/root/testdata/sf0.01"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def by_slices(text, name):
    """The contract with list slices."""
    tokens = TOKEN.findall(text)
    n, digest = len(tokens), hashlib.sha256(f"42:{name}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab<>PSM \n\x1f\x85\u00e9\u3000\U0001f600"), st.integers(0, 300))
def test_blocks_are_rotated_and_back(text, name):
    *numbers, form, prefix, middle, output = (lambda r: (r[0], r[1], r[2], r[3], r[4]))(fim.transformed(text.encode(), f"42:{name}"))
    assert (numbers[0], form, prefix, middle, output.decode()) == by_slices(text, name)
    assert fim.restored(output, form).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.data())
def test_rotation(data, draw):
    a, b, c = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    turned = bytearray(data)
    fim.rotate(turned, a, b, c)
    assert turned == data[:a] + data[b:c] + data[a:b] + data[c:]
    fim.rotate(turned, a, a + c - b, c)
    assert turned == data


def test_long_text_is_rotated_in_blocks():
    text = ("wörd " * 200_000 + "\n end").encode()
    for name in range(12):
        n, form, prefix, middle, output = fim.transformed(text, f"42:{name}")
        assert (n, form, prefix, middle, output.decode()) == by_slices(text.decode(), name)
        assert fim.restored(output, form) == text


def test_fim_of_odd_rows(spark):
    rows = [(1, "one two three"), (1, "one two three"), (None, "no id here at all"), (2, None), (3, ""), (4, "has <M> in it"), (5, " \t\n"), (6, "x" * 3_000_000 + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N", F.lit(7)).withColumn("output", F.lit("mine")).withColumn("extra", F.lit(1))
    made = fim.with_fim(docs)
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = made.withColumn("back", fim.restored_text(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_slices(r.text or "", "" if r.doc_id is None else r.doc_id) and r.back == (r.text or "")
    assert fim.with_fim(docs.limit(0)).count() == 0


def test_fim_rates(spark):
    forms = [r.form for r in registry.op12_fill_in_middle(spark, SF).collect()]
    assert 0.4 < forms.count("plain") / len(forms) < 0.6 and forms.count("spm") > 2 * forms.count("psm") > 0


def judged(url):
    """The contract's rules by plain Python."""
    _, found, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0] if found else ""
    path = re.split("[?#]", rest[len(host) :])[0] if found else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in registry.URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


ODD = [None, "", "no url", "http://", "://net/", "HTTP://A.NET", "http://A.NET/", "http://x.Example.net/en/1?q=http://b.de/", "http://example.net/en", "http://notexample.com/de/", "http://www.example.com/de/#a", "http://org/fr/",
       "http://a.org/FR/", "http://u:p@a.net:80/x", "http://a.net:80/", "http://..net/", "a://b://net/", "http://ÄÉ.net/ü", "http://example.com/de/" + "x" * 2_000_000, "http://net?x/", "http://a.net#/"]


def test_url_rules_on_odd_rows(spark):
    rows = [(k, u) for k, u in enumerate(ODD)] + [(None, "http://a.net/"), (0, "http://a.net/"), (0, "http://a.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("Host", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("extra", F.lit(1))
    model = url_filter.fit(url_filter.labelled_urls(spark))
    made = url_filter.judge(pages, model, registry.URL_RULES)
    assert made.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict", "score"]
    found = made.collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule, verdict = judged(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
        if r.url is None:
            assert (r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow")
    assert url_filter.judge(pages.limit(0), model, []).count() == 0


def test_url_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = registry.op13_url_filter(spark, SF).collect()
    assert sorted(r.page_id for r in found) == sorted(urls)
    for r in found:
        host, path, rule, verdict = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    odd = [r for r in found if r.rule is None and "-" in r.host]
    plain = [r for r in found if r.rule is None and "-" not in r.host]
    assert sum(r.verdict == "block" for r in odd) >= 0.9 * len(odd) > 0
    assert sum(r.verdict == "block" for r in plain) <= 0.02 * len(plain)


def test_url_model_on_words_of_its_table_in_new_hosts():
    """Every seventh url of the table is kept back from training; hosts of the given pages are not in it."""
    table = [(urlsplit(u).netloc.encode(), urlsplit(u).path.encode(), bad) for u, bad in url_filter.labelled_table()]
    assert not {b"cheap-pills", b"spam-farm", b"adult-x", b"free-bets", b"ads-track", b"casino-win"} & {p for h, _, _ in table for p in h.split(b".")}
    seen, kept = [t for k, t in enumerate(table) if k % 7], table[::7]
    model = url_filter.train([t[:2] for t in seen], np.array([t[2] for t in seen]))
    right = [(model.score(h, p) >= 0.5) == bad for h, p, bad in kept]
    assert np.mean(right) > 0.9
    none = url_filter.train([(b"a.b", b"/")], np.array([True]))
    assert none.score(b"a.b", b"/") < 0.5


def test_labelled_rows_with_nulls_and_repeats(spark):
    rows = [("http://pills.example.com/", True), ("http://pills.example.com/", True), (None, True), ("http://a.example.com/", None), ("http://garden.example.com/", False)]
    model = url_filter.fit(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert model.score(b"pills.example.com", b"/") > model.score(b"garden.example.com", b"/")
    with pytest.raises(ValueError, match="bytes of rules"):
        url_filter.Rules.of([("block", "x" * (url_filter.MOST_RULE_BYTES + 1))])
