"""Toxic passages as maximum-scoring segments.

Training: the documents of a bounded sample of labelled rows give, for each word, how many toxic and clean
documents hold it. A word's log-odds come from its toxic share under a Dirichlet prior, whose mean is the share
among the distinct words with the same first letters (five, then four, then all): inflected forms that were never
seen inherit their stem's odds, and rare words stay near the prior. Scoring: the log-odds less a drift are a walk
over the words; the linear-time scan of Ruzzo and Tompa finds all its maximal segments. A segment's expected
number of equals in clean text of that length, K n exp(-lambda S), calibrates it; lambda solves the Karlin-Altschul
equation for clean words and K comes from the segments of clean training documents. A logistic curve over the
significant segments' summed log-expectations gives the score.

Defined cases: null or empty texts have no segments and get the curve's value at 0; a null doc_id can't be held out
and is never trained on; rows that repeat a doc_id count once in training, with the smallest of their texts; without labelled rows of both kinds every score is the toxic share (0 without rows); rows
that repeat are scored alike; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle

#: Labelled rows used for training: those with the smallest hashes of their id.
SAMPLE_ROWS = 20_000
STEMS = (5, 4)
#: Rows that are scanned and handed on at once.
SLICE_ROWS = 1000
#: Weight of the priors: in documents for a word, in sure words for a stem.
PRIOR, STEM_PRIOR = 2.0, 1.0
DRIFT = 0.75
THRESHOLD = 0.3
#: Log-odds of no more than this are noise and count as the drift alone.
LEAST_ODDS = 1.5
#: Share of clean training documents with the highest segments that the null model leaves out, as labels err.
MISLABELLED = 0.01
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def segments(positions: list[int], odds: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a walk that falls by `drift` at each word and
    rises by odds[i] at positions[i]; after Ruzzo and Tompa (1999), linear in the rises.

    Each segment points to the nearest one before it that begins lower. Looking for such a one for a new segment follows
    these pointers, and whatever it passes over stands behind the new segment's own pointer ever after.
    """
    done: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the nearest that begins lower
    total, last = 0.0, -1
    for at, rise in zip(positions, odds):
        total -= drift * (at - last - 1)
        before, total, last = total, total + rise - drift, at
        if total <= before:
            continue
        first, j = at, len(done) - 1
        while j >= 0 and done[j][2] >= before:
            j = done[j][4]
        while j >= 0 and done[j][3] < total:
            first, _, before, _, lower = done[j]
            del done[j:]
            j = lower
        done.append((first, at, before, total, j))
    return [(a, b, r - l) for a, b, l, r, _ in done]


class Model:
    """Positive log-odds by word and stem, and the calibration; of fixed size for a bounded sample."""

    def __init__(self, words=None, stems=None, lam=1.0, k=1.0, curve=(-20.0, 0.0), drift=DRIFT):
        self.words, self.stems, self.lam, self.k, self.curve, self.drift = words or {}, stems or {}, lam, k, curve, drift

    def odds(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            found = next((s for n in STEMS if len(word) > n and (s := self.stems.get(word[:n])) is not None), 0.0)
        return found

    def _may(self, word: str) -> bool:
        return word in self.words or word[:4] in self.stems or word[:5] in self.stems

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]], list]:
        """(number of words, segments by word numbers, the words' matches if there are segments)."""
        low = text.lower()
        if len(low) != len(text):  # some capitals have longer small forms; places must stay those of the text
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        words = _WORD.findall(low)
        rising = {w: o for w in set(words) if self._may(w) and (o := self.odds(w)) > self.drift}
        if not rising:
            return len(words), [], []
        at = [i for i, w in enumerate(words) if w in rising]
        found = segments(at, [rising[words[i]] for i in at], self.drift)
        return len(words), found, list(_WORD.finditer(low))

    def expect(self, score: float, n: int) -> float:
        """Natural log of the expected number of such segments in n clean words."""
        return math.log(self.k * max(n, 1)) - self.lam * score

    def evidence(self, n: int, found: list) -> float:
        return sum(max(0.0, -self.expect(s, n)) for _, _, s in found)

    def score(self, evidence: float) -> float:
        x = self.curve[0] + self.curve[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, x))))


def _count(batches):
    for batch in batches:
        rows: dict[tuple[str, int], int] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in set(_WORD.findall((text or "").lower())):
                rows[w, toxic] = rows.get((w, toxic), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()), pa.array(list(rows.values()), pa.int64())], ["word", "toxic", "n"])


def _odds(counts: DataFrame, n1: int, n0: int) -> tuple[dict[str, float], dict[str, float]]:
    """Positive log-odds of words and of stems from counts (word, c1, c0); what reaches the driver are toxic stems, the
    words that have one, and toxic words."""
    # Shares are taken as if both kinds were as frequent, so that log-odds don't hold the sample's balance.
    toxic, clean = F.col("c1") / n1, F.col("c0") / n0
    n = F.col("c1") + F.col("c0")
    words = settle(counts.withColumns({"share": toxic / (toxic + clean), "sure": n / (n + 1)}))  # a word seen once says little about its stem
    logit = lambda theta: F.log(theta / (1 - theta))
    known: dict[str, float] = {}
    prior = F.lit(0.5)
    for size in reversed(STEMS):
        stem = F.substring("word", 1, size)
        sums = words.where(F.length("word") > size).groupBy(stem.alias(f"stem{size}")).agg(F.sum(F.col("share") * F.col("sure")).alias("s"), F.sum("sure").alias("n"))
        shorter = {k: v for k, v in known.items() if len(k) < size}
        up = F.lit(0.5)
        if shorter:  # a stem goes by its own stem where that one is toxic
            shares = F.create_map(*[F.lit(x) for k, v in shorter.items() for x in (k, 1 / (1 + math.exp(-v)))])
            up = F.coalesce(F.element_at(shares, F.substring(f"stem{size}", 1, len(next(iter(shorter))))), up)
        theta = settle(sums.select(f"stem{size}", ((F.col("s") + STEM_PRIOR * up) / (F.col("n") + STEM_PRIOR)).alias(f"theta{size}")))
        known |= {r[0]: r[1] for r in theta.select(f"stem{size}", logit(F.col(f"theta{size}")).alias("x")).where(F.col("x") > LEAST_ODDS).collect()}
        words = words.withColumn(f"stem{size}", F.when(F.length("word") > size, stem)).join(theta, f"stem{size}", "left")
        prior = F.coalesce(f"theta{size}", prior)
    base = (n1 + 1) / (n1 + n0 + 2)
    one, zero = 0.5 / base, 0.5 / (1 - base)
    held = PRIOR * max(one, zero)  # the prior is worth PRIOR documents of the rarer kind
    theta = (F.col("c1") * one + held * prior) / (F.col("c1") * one + F.col("c0") * zero + held)
    judged = words.withColumn("x", logit(theta))
    toxic_stem = F.lit(False)
    for size in STEMS:
        mine = [k for k in known if len(k) == size]
        toxic_stem = toxic_stem | (F.substring("word", 1, size).isin(mine) if mine else F.lit(False))
    rows = judged.where((F.col("x") > LEAST_ODDS) | toxic_stem).select("word", "x").collect()
    return {r.word: r.x if r.x > LEAST_ODDS else 0.0 for r in rows}, known


def _scanner(model, text_at: int, keep: list[str] | None, prefix: str = ""):
    """Segments' raw scores of each row for the fit (keep None); else the columns to keep and the score."""

    def scan(batches):
        m = model.value
        for batch in (part.slice(a, SLICE_ROWS) for part in batches for a in range(0, part.num_rows, SLICE_ROWS)):
            rows = [m.scan(t or "") for t in batch.column(text_at).to_pylist()]
            if keep is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([[s for _, _, s in f] for _, f, _ in rows], pa.list_(pa.float64()))], ["toxic", "n", "scores"])
                continue
            passages = []
            for n, found, places in rows:
                passages.append([{"start": places[a].start(), "end": places[b].end(), "log_expect": m.expect(s, n)} for a, b, s in found if m.expect(s, n) < 0] if places else [])
            evidence = [m.evidence(n, f) for n, f, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array([m.score(e) for e in evidence]), pa.array(evidence, pa.float64()), pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("log_expect", pa.float64())])))],
                [*keep, *(prefix + c for c in ("score", "evidence", "passages"))],
            )

    return scan


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the documents of at most sample_rows labelled rows outside the held-out quarter."""
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(settle(chosen)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = settle(known.select("text", "toxic").repartition(spark.sparkContext.defaultParallelism))
    n1, n0 = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return Model(curve=((50.0 if n1 else -50.0), 0.0))
    counts = map_arrow(sample, _count, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0"))
    model = Model(*_odds(counts, n1, n0))
    shared = spark.sparkContext.broadcast(model)
    scan = _scanner(shared, 1, None)
    rows = settle(map_arrow(sample.select("toxic", "text"), scan, "toxic int, n long, scores array<double>").withColumn("top", F.coalesce(F.array_max("scores"), F.lit(0.0))))
    tops = np.array([r[0] for r in rows.where("toxic = 0").select("top").collect()])  # a number for each row of the bounded sample
    clean = rows.where((F.col("toxic") == 0) & (F.col("top") <= float(np.quantile(tops, 1 - MISLABELLED))))
    total = clean.agg(F.sum("n")).first()[0]
    steps = {r.s: r.n for r in clean.select(F.explode("scores").alias("s")).groupBy(F.round("s", 3).alias("s")).agg(F.count("*").alias("n")).collect()}
    model.lam = _lambda(steps, total, model.drift)
    found = sum(c * math.exp(model.lam * s) for s, c in steps.items())
    model.k = max(found, 1.0) / max(total, 1) if steps else 1.0 / max(total, 1)
    least = F.log(F.lit(model.k) * F.greatest("n", F.lit(1)))
    evidence = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), model.lam * s - least))
    judged = rows.select("toxic", evidence.alias("e")).toPandas()
    model.curve = _logistic(np.log1p(judged.e.to_numpy(float)), judged.toxic.to_numpy(float))
    return model


def _lambda(steps: dict[float, int], total: int, drift: float) -> float:
    """The positive root of the mean of exp(lambda * step) = 1 over clean words: segments stand for their words."""
    rises = sum(steps.values())
    if not rises or not total:
        return 1.0
    lo, hi = 1e-6, 1.0
    mean = lambda x: (sum(c * math.exp(min(700.0, x * s)) for s, c in steps.items()) + max(0, total - rises) * math.exp(-x * drift)) / total
    while mean(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return max(lo, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    a = np.column_stack([np.ones_like(x), x])
    b = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * b
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b - np.clip(step, -5, 5)
    return float(b[0]), max(0.0, float(b[1]))


def score(docs: DataFrame, model: Model, *keep: str, prefix: str = "") -> DataFrame:
    """The columns `keep` of each row of docs, and score, evidence and passages (code points), their names prefixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(*keep, *["text"] * ("text" not in keep))
    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep)
    scan = _scanner(shared, read.columns.index("text"), list(keep), prefix)
    return map_arrow(read, scan, f"{kinds}, {prefix}score double, {prefix}evidence double, {prefix}passages array<struct<start:int,end:int,log_expect:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "passages")


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score THRESHOLD or more."""
    scored = score(docs, fit(docs, labels), *docs.columns, prefix="_found_")
    return scored.where(F.col("_found_score") < THRESHOLD).select(*docs.columns)
