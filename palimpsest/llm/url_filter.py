"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule is a host with a path (``example.net/en/``) and a verdict; it fits its host and all subdomains if the url's path
starts with the rule's, and the longest one that fits wins. What no rule fits is judged by a model that is trained in
numpy from a small table of labelled urls: the n-grams of 3 to 5 characters of the host (with marks at its ends and a
mark for each dot) and of the path are hashed into one table of weights, and the score is the sigmoid of the host's share and
the path's share. Both are means over the n-grams' square-rooted number, so length alone says nothing.

Each row is judged by itself in one pass without a shuffle, so neither a hot host nor repeated rows matter; a host's
share is kept in a cache bounded in bytes. Model and rules are sent to the executors: 2 ** bits floats, and rules of
MOST_RULE_BYTES at most (more is an error). A null url, or one without ``://``, has an empty host and path: no rule fits,
and the bias alone judges it. Urls of any length are read whole. An empty table gives an empty one. Other columns pass through;
those that have the results' names give way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field as made_by

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BoundedCache, as_bytes, field, released

MOST_RULE_BYTES = 32 << 20

#: Words of hosts to keep away, words that stand beside either kind, words of hosts to let through, and letter groups that
#: invented names of the latter are made of. labelled_table() makes the small table of labelled urls from them by a rule.
BLOCKED = """pills viagra pharma meds rx casino poker slots jackpot roulette bets betting gamble odds lottery adult porn xxx sexy nude
camgirls escort spam linkspam spammer clickbait ads adserver popup banner tracker pixel malware warez crack keygen phish torrent replica
cheap cheapest freebie prize winner cash loans""".split()
BESIDE = "online site best free win hot x farm track net get big live top my click shop store world hub".split()
ALLOWED = """library museum garden news university docs weather recipes history physics cityhall hiking music school football market opendata
theatre freedom windows education hospital railway painter station edition relation action motion nation reading housing farmers results
address shadow roads beads thread wincher tracks trackside clicker bestow shopper getting online storey hotel topic network""".split()
GROUPS = "the th tion er in an re nd on ing ed he ha ou sh ch ly ble and ment wh ight or en es st".split()
_FORMS = ("/en/{}", "/de/{}.html", "/{}/", "/fr/{}", "/es/{}/", "")
_SIDES = ("", "www.", "blog.", "m.")
_ENDS = ("example.com", "example.org", "example.net")


def labelled_table() -> list[tuple[str, bool]]:
    """(url, blocked): five hosts of each word to keep away, three of each to let through, and a name of each neighbouring two or three letter groups;
    sides, ends and paths take turns."""
    names = []
    for k, word in enumerate(BLOCKED):
        other = [BESIDE[(k + step) % len(BESIDE)] for step in (0, 5, 9, 13, 17)]
        names += [(f"{word}-{other[0]}", True), (f"{other[1]}-{word}", True), (f"{other[2]}{word}", True), (f"{word}{other[3]}", True), (f"{word}-{other[4]}", True)]
    for k, word in enumerate(ALLOWED):
        names += [(word, False), (f"{word}-{ALLOWED[(k + 9) % len(ALLOWED)]}", False), (f"{word}-{BESIDE[k % len(BESIDE)]}", False)]
    for k, group in enumerate(GROUPS):
        for step in (1, 3, 5, 8, 11):
            two = GROUPS[(k + step) % len(GROUPS)]
            names += [(f"th{group}{two}", False), (f"{group}{two}", False)]
    return [(f"http://{_SIDES[k // 2 % 4]}{name}.{_ENDS[k % 3]}{_FORMS[k // 3 % 6].format(37 * k % 9973)}", bad) for k, (name, bad) in enumerate(names)]


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, in lower case (A-Z only); empty if there is none."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash; empty if there is none."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def grams(text: bytes, salt: int, bits: int, shortest: int = 3, longest: int = 5) -> np.ndarray:
    """Rows of the n-grams of text; salt tells hosts from paths."""
    codes = np.frombuffer(text, "u1").astype("uint32") + np.uint32(1)
    out, h = [], codes + np.uint32(salt << 9)
    for n in range(2, longest + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(16777619) + codes[n - 1 :]
        if n >= shortest:
            out.append((h ^ h >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, "uint32")


_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def parts(host: bytes, path: bytes) -> tuple[bytes, bytes]:
    """Host and path as their n-grams are taken: with marks at the ends, digits of the path alike, nothing for nothing."""
    return b"." + host + b"." if host else b"", path.translate(_DIGITS) + b"$" if path else b""


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int
    hosts: BoundedCache | None = made_by(default=None, compare=False)

    def share(self, text: bytes, salt: int) -> float:
        rows = grams(text, salt, self.bits)
        return float(self.weights[rows].sum()) / len(rows) ** 0.5 if len(rows) else 0.0

    def score(self, host: bytes, path: bytes) -> float:
        """The probability that the url is one to keep away."""
        if self.hosts is None:
            self.hosts = BoundedCache(lambda h: np.array([self.share(h, 1)]), 16 << 20)
        host, path = parts(host, path)
        x = float(self.hosts[host][0]) + self.share(path, 2) + self.bias
        return 1 / (1 + float(np.exp(-max(-60.0, min(60.0, x)))))


def train(urls: list[tuple[bytes, bytes]], blocked: np.ndarray, bits: int = 14, steps: int = 400, rate: float = 0.5, decay: float = 0.002) -> Model:
    """Gradient descent on the cross entropy, both classes weighted alike; weights start at nothing and decay. The bias
    starts at clean and follows the data; without both classes everything is allowed."""
    size = 1 << bits
    if len(set(blocked.tolist())) < 2:
        return Model(np.zeros(size, "float32"), -2.0, bits)
    rows, cols, values = [], [], []
    for k, (host, path) in enumerate(urls):
        for text, salt in zip(parts(host, path), (1, 2)):
            found = grams(text, salt, bits)
            rows.append(np.full(len(found), k))
            cols.append(found.astype("int64"))
            values.append(np.full(len(found), 1 / max(1, len(found)) ** 0.5))
    rows, cols, values = (np.concatenate(x) for x in (rows, cols, values))
    each = np.where(blocked, 0.5 / blocked.sum(), 0.5 / (~blocked).sum())
    w, bias = np.zeros(size), -2.0
    for _ in range(steps):
        x = np.bincount(rows, w[cols] * values, len(urls)) + bias
        gap = each * (1 / (1 + np.exp(-np.clip(x, -60, 60))) - blocked)
        w -= rate * len(urls) * (np.bincount(cols, gap[rows] * values, size) / len(urls) ** 0.5 + decay * w / len(urls))
        bias -= rate * 0.2 * gap.sum()
    return Model(w.astype("float32"), float(bias), bits)


def labelled_urls(spark) -> DataFrame:
    """(url, blocked): the small labelled table."""
    return spark.createDataFrame(labelled_table(), "url string, blocked boolean")


def fit(labelled: DataFrame, most: int = 10_000, bits: int = 14) -> Model:
    """A model from labelled(url, blocked): the `most` of least hash are used. Nulls are left out, repeated rows count once."""
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("boolean").alias("blocked"))
    rows = rows.dropna().distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(most).collect()
    return train([(r.host.encode(), r.path.encode()) for r in rows], np.array([r.blocked for r in rows], bool), bits)


@dataclass
class Rules:
    """Verdicts by host; of a host's rules the one with the longest path first."""

    by_host: dict[bytes, list[tuple[bytes, str, str]]]

    @classmethod
    def of(cls, rules: list[tuple[str, str]]) -> Rules:
        """rules(verdict, host/path). Of a rule given twice the stricter verdict holds."""
        if sum(len(r) + len(v) for v, r in rules) > MOST_RULE_BYTES:
            raise ValueError(f"more than {MOST_RULE_BYTES} bytes of rules")
        by_host: dict[bytes, dict[bytes, tuple[bytes, str, str]]] = {}
        for verdict, rule in sorted(rules):  # allow before block
            host, _, path = rule.partition("/")
            by_host.setdefault(host.lower().encode(), {})[path] = (b"/" + path.encode(), rule, verdict)
        return cls({h: sorted(own.values(), key=lambda r: -len(r[0])) for h, own in by_host.items()})

    def match(self, host: bytes, path: bytes) -> tuple[str | None, str | None]:
        """Rule and verdict of the longest rule that fits, host and path counted together."""
        best, length = (None, None), -1
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start):
                    if len(host) + len(start) > length:
                        best, length = (rule, verdict), len(host) + len(start)
                    break
            host = host.partition(b".")[2]
        return best


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]], threshold: float = 0.5, url: str = "url") -> DataFrame:
    """pages with host, path, rule (null where none fits), verdict (block or allow) and score (the model's)."""
    names = ["host", "path", "rule", "verdict", "score"]
    kind = T.StructType([field("rule", "string"), field("verdict", "string"), field("score", "double")])
    sent = pages.sparkSession.sparkContext.broadcast((model, Rules.of(rules)))

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model, ruled = sent.value
        try:
            for hosts, paths in batches:
                rows = []
                for host, path in zip(as_bytes(hosts), as_bytes(paths)):
                    host, path = host.as_py(), path.as_py()
                    rule, verdict = ruled.match(host, path)
                    score = model.score(host, path)
                    rows.append((rule, verdict or ("block" if score >= threshold else "allow"), score))
                columns = list(zip(*rows)) or [()] * 3
                yield pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["rule", "verdict", "score"])
        finally:
            released()

    of.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    own = [f"_{n}_{uuid.uuid4().hex}" for n in ("host", "path", "judged")]
    out = pages.withColumns({own[0]: host_of(F.col(f"`{url}`")), own[1]: path_of(F.col(f"`{url}`"))})
    out = out.withColumn(own[2], F.arrow_udf(of, kind)(F.col(own[0]), F.col(own[1])))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    return out.select(*kept, F.col(own[0]).alias("host"), F.col(own[1]).alias("path"), *[F.col(f"`{own[2]}`.{n}").alias(n) for n in names[2:]])
