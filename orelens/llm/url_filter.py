"""URL filters: explicit rules, and association rules mined from labels.

Explicit rules name a host and a path; the longest that fits decides. Where none fits, the method does: Spark's
FP-growth mines combinations of URL tokens (labels of the host, words of the path and the query) of labelled pages
together with the label itself; combinations that imply the bad label with enough support and confidence become
rules, of which those that a shorter rule already covers as surely are pruned. A page is blocked if all tokens of a
rule are among its own. Rules are matched through an inverted index from each rule's rarest token.

Training takes at most SAMPLE_ROWS labelled pages (those with the smallest hashes of their id). Growth is bounded
before it starts, without losing a combination of up to MOST_TOKENS tokens: a token on too few bad pages can be in no
rule and is left out; tokens that stand on just the same pages are one item, which any of them stands for; and where a
page still has more than MOST_ITEMS items, the items are dealt to blocks, and each page is mined once for every one,
two and three of its blocks with those blocks' items alone. A combination is read where its blocks are just those. So
FP-growth never meets more than MOST_ITEMS items together. Support bounds the tokens and so the rules, which go to the
executors as one dictionary.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; null labels
teach nothing; without bad pages there are no mined rules; urls may be of any length and repeat; a page with several labels is bad if one is; repeated
rows get the same verdict; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: (verdict, host, path); each also holds for subdomains and for paths that go on.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SAMPLE_ROWS = 100_000
#: A rule's share of the labelled pages, and the pages it needs at the least, as a share of few pages says nothing.
SUPPORT, LEAST_PAGES = 0.005, 5
CONFIDENCE, LIFT = 0.6, 1.5
MOST_TOKENS = 3
#: Items that FP-growth meets together; it may look at all their subsets.
MOST_ITEMS = 12
BAD = "=bad"
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): the host lower-cased in A-Z, the path up to a query or fragment."""
    _, cut, rest = (url or "").partition("://")
    if not cut:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens(url: str | None) -> list[str]:
    """Distinct tokens: h: labels of the host, p: words of the path (numbers by their length), q: query words."""
    host, path = parts(url)
    tail = (url or "").partition("://")[2][len(host) + len(path) :].translate(_UPPER)
    out = {f"h:{x}" for x in host.split(".") if x}
    out |= {f"p:{x}" if not x.isdigit() else f"p:#{len(x)}" for x in _TOKEN.findall(path.translate(_UPPER))}
    out |= {f"q:{x}" for x in _TOKEN.findall(tail) if not x.isdigit()}
    return sorted(out)


class Index:
    """Explicit rules by host and mined rules by their rarest token."""

    def __init__(self, explicit, mined: list[tuple[list[str], float]], rarity: dict[str, int], same: dict[str, str] | None = None):
        self.same = same or {}
        self.explicit: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in explicit:
            self.explicit.setdefault(host, []).append((path, verdict))
        self.mined: dict[str, list[frozenset[str]]] = {}
        for rule, _ in mined:
            self.mined.setdefault(min(rule, key=lambda t: (rarity.get(t, 0), t)), []).append(frozenset(rule))

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest explicit rule that fits, host and path together."""
        labels, best = host.split("."), None
        for k in range(len(labels)):
            own = ".".join(labels[k:])
            for p, v in self.explicit.get(own, ()):
                if path.startswith(p) and (best is None or len(own) + len(p) > len(best[0])):
                    best = (own + p, v)
        return best

    def bad(self, found: list[str]) -> bool:
        own = {self.same.get(t, t) for t in found}
        return any(rule <= own for t in own for rule in self.mined.get(t, ()))


def _items(baskets: DataFrame, least: float) -> tuple[dict[str, int], dict[str, str]]:
    """(pages of each item, the item of each token) for the tokens on at least so many bad pages.

    Tokens on the same pages, as two hashes over these tell, are one item: the first of them by name.
    """
    pages = baskets.select("bad", F.xxhash64("rid").alias("x"), F.xxhash64("rid", F.lit(1)).alias("y"), F.explode("items").alias("t"))
    found = pages.groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("bad") == 1).alias("nb"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where(F.col("nb") >= least)
    count, same, first = {}, {}, {}
    for r in sorted(found.collect(), key=lambda r: r.t):  # at most (mean tokens of a page) / support rows
        same[r.t] = first.setdefault((r.n, r.x, r.y), r.t)
        count[same[r.t]] = r.n
    return count, same


def _short(baskets: DataFrame, same: dict[str, str]) -> DataFrame:
    """(items, bad) with the items of each page in place of its tokens."""
    shared = baskets.sparkSession.sparkContext.broadcast(same)

    def run(batches):
        own = shared.value
        for batch in batches:
            items = [sorted({own[t] for t in found if t in own}) for found in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string())), batch.column(1)], ["items", "bad"])

    return settle(baskets.select("items", "bad").mapInArrow(run, "items array<string>, bad int"))


def _blocks(short: DataFrame, items: list[str]) -> dict[str, int]:
    """The block of each item, of as few blocks as leave no page with more than MOST_ITEMS items in MOST_TOKENS of them."""
    place = {t: i for i, t in enumerate(items)}
    counts = [1 << k for k in range(max(1, len(items)).bit_length() + 1)]

    def run(batches):
        most = [0] * len(counts)
        for batch in batches:
            for found in {tuple(x) for x in batch.column(0).to_pylist()}:
                for k, n in enumerate(counts):
                    held: dict[int, int] = {}
                    for t in found:
                        held[place[t] % n] = held.get(place[t] % n, 0) + 1
                    most[k] = max(most[k], sum(sorted(held.values())[-MOST_TOKENS:]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(most, pa.int32())], ["k", "most"])

    held = {r.k: r.most for r in short.select("items").mapInArrow(run, "k int, most int").groupBy("k").agg(F.max("most").alias("most")).collect()}
    n = next((c for k, c in enumerate(counts) if held.get(k, 0) <= MOST_ITEMS), counts[-1])
    return {t: i % n for t, i in place.items()}


def frequent(short: DataFrame, items: list[str], least: float) -> dict[frozenset[str], int]:
    """Pages with all of each combination of up to MOST_TOKENS items and BAD, if there are at least so many of them."""
    block = _blocks(short, items)
    shared = short.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own = shared.value
        for batch in batches:
            out = []
            for found, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for some in (c for n in range(1, MOST_TOKENS + 1) for c in combinations(sorted({own[t] for t in found}), n)):
                    name = "-".join(map(str, some)) + "|"
                    out.append([name + t for t in found if own[t] in some] + [name + BAD] * bool(bad))
            for a in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(out[a : a + 10_000], pa.list_(pa.string()))], ["items"])

    dealt = settle(short.mapInArrow(run, "items array<string>"))
    total = dealt.count()
    if not total:
        return {}
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(least) - 0.5) / total)).fit(dealt)
    out = {}
    for r in model.freqItemsets.where(F.size("items") <= MOST_TOKENS + 1).collect():
        name = r["items"][0].partition("|")[0]
        found = frozenset(t[len(name) + 1 :] for t in r["items"])
        if len(found - {BAD}) <= MOST_TOKENS and "-".join(map(str, sorted({block[t] for t in found if t != BAD}))) == name:
            out[found] = r.freq
    return out


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sample_rows: int = SAMPLE_ROWS) -> tuple[list, dict, dict]:
    """(rules of items with their confidence, pages by item, item by token) from pages (page_id, url) and labels
    (page_id, bad)."""
    known = labels.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    chosen = known.join(pages.select("page_id").distinct(), "page_id", "left_semi").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows)
    rows = pages.select("page_id", "url").join(F.broadcast(settle(chosen)), "page_id")

    def items(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens(u) for u in batch.column(0).to_pylist()], pa.list_(pa.string())), batch.column(1)], ["items", "bad"])

    baskets = settle(rows.select("url", F.col("bad").cast("int")).mapInArrow(items, "items array<string>, bad int").withColumn("rid", F.monotonically_increasing_id()))
    total, bad = baskets.agg(F.count("*"), F.count_if(F.col("bad") == 1)).first()
    least = max(support * total, LEAST_PAGES)
    if bad < least:
        return [], {}, {}
    rarity, same = _items(baskets, least)
    found = frequent(_short(baskets, same), sorted(rarity), least)
    rules: dict[frozenset[str], float] = {}
    for both in sorted((x for x in found if BAD in x and len(x) > 1), key=lambda x: (len(x), sorted(x))):
        left = both - {BAD}
        sure = found[both] / found[left]
        covered = any(rules.get(frozenset(c), -1.0) >= sure for n in range(1, len(left)) for c in combinations(left, n))
        if sure >= confidence and sure >= LIFT * bad / total and not covered:
            rules[left] = sure
    return [(sorted(r), sure) for r, sure in rules.items()], rarity, same


def judge(pages: DataFrame, index: Index) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url)."""
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                fits = own.rule(host, path)
                rows.append((host, path, *(fits or (None, "block" if own.mined and own.bad(tokens(url)) else "allow"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in range(4))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def filter_urls(pages: DataFrame, labels: DataFrame, explicit=RULES) -> DataFrame:
    return judge(pages, Index(explicit, *mine(pages, labels)))


def labels_of(labels: DataFrame) -> DataFrame:
    """A page is bad if the document of its id is of poor quality or toxic."""
    bad: Column = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = "list_transform({0}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'p:#' || length(x) ELSE 'p:' || x END)"
ORACLE = f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT rid, page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), {_A_TO_Z}) AS host, regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*[^?#]*(.*)$', 1) AS tail FROM u),
t AS (
  SELECT rid, page_id, unnest(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    {_WORDS.format(f"regexp_extract_all(translate(path, {_A_TO_Z}), '[a-z0-9]+')")},
    list_transform(list_filter(regexp_extract_all(translate(tail, {_A_TO_Z}), '[a-z0-9]+'), lambda x: NOT regexp_matches(x, '^[0-9]+$')), lambda x: 'q:' || x)))) AS tok FROM h),
l AS (SELECT doc_id AS page_id, max(CAST(quality = 0 OR toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY 1),
b AS (SELECT rid, bad FROM h JOIN l USING (page_id)),
g AS (SELECT greatest({SUPPORT} * count(*), {LEAST_PAGES}) AS least, avg(bad) AS base FROM b),
f AS (SELECT t.rid, tok, bad FROM t JOIN b USING (rid)),
s AS (
  SELECT [tok] AS r, count(*) AS n, sum(bad) AS nb FROM f GROUP BY ALL
  UNION ALL SELECT [x.tok, y.tok], count(*), sum(x.bad) FROM f x JOIN f y ON x.rid = y.rid AND x.tok < y.tok GROUP BY ALL
  UNION ALL SELECT [x.tok, y.tok, z.tok], count(*), sum(x.bad) FROM f x JOIN f y ON x.rid = y.rid AND x.tok < y.tok JOIN f z ON x.rid = z.rid AND y.tok < z.tok GROUP BY ALL),
c AS (SELECT r, nb / n AS sure FROM s, g WHERE nb >= least AND nb / n >= {CONFIDENCE} AND nb / n >= {LIFT} * base),
-- a rule that a kept shorter one covers as surely goes; whatever covers the shorter one covers it too
m AS (SELECT r FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE len(d.r) < len(c.r) AND d.sure >= c.sure AND list_has_all(c.r, d.r))),
o AS (SELECT rid, list(tok) AS own FROM t GROUP BY rid),
k AS (SELECT DISTINCT rid FROM o, m WHERE list_has_all(own, r)),
e AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{d}', '{q}')" for v, d, q in RULES)}) v(verdict, rh, rp)),
w AS (SELECT rid, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC) AS n FROM h, e WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN k.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN w ON w.rid = h.rid AND w.n = 1 LEFT JOIN k ON k.rid = h.rid
"""
