import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np

from orelens.llm import toxicity as T


WORD = re.compile(r"[^\W\d_]+")


def logit(p):
    return math.log(p / (1 - p))


def all_maximal(values):
    """Every maximal segment of a list of scores by its definition: the best segment, then left and right of it."""
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += values[b]
                if total > 0 and (top is None or total > top[2] + 1e-9):
                    top = (a, b, total)
        return [] if top is None else [*best(lo, top[0]), top, *best(top[1] + 1, hi)]

    return best(0, len(values))


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 25)
        at = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        rises = [rng.choice([1.7, 2.3, 3.1, 4.9]) + rng.random() for _ in at]
        values = [-0.75] * n
        for i, r in zip(at, rises):
            values[i] = r - 0.75
        got = T.segments(at, rises, 0.75)
        want = all_maximal(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_segments_take_time_that_grows_with_the_rises():
    """A walk that falls on and on, where a look back over all earlier segments is quadratic."""
    def seconds(n):
        began = time.perf_counter()
        assert len(T.segments(list(range(0, 4 * n, 4)), [2.0] * n, 0.75)) == n
        return time.perf_counter() - began

    assert seconds(400_000) < 20 * max(seconds(40_000), 0.02)


def brute_model(docs, labels):
    """The fit by plain loops: (odds of a word, lambda, K, curve)."""
    tox = {d: y for d, y in labels if y is not None and d is not None and zlib.crc32(str(d).encode()) % 4 != 2}
    sample = [(t or "", tox[d]) for d, t in docs if d in tox]
    n1 = sum(y for _, y in sample)
    n0 = len(sample) - n1
    c1, c0 = Counter(), Counter()
    for t, y in sample:
        (c1 if y else c0).update(set(WORD.findall(t.lower())))
    share = {w: (c1[w] / n1) / (c1[w] / n1 + c0[w] / n0) for w in {*c1, *c0}}
    sure = {w: (c1[w] + c0[w]) / (c1[w] + c0[w] + 1) for w in share}
    theta = {}
    for size in (4, 5):
        for stem in {w[:size] for w in share if len(w) > size}:
            own = [w for w in share if len(w) > size and w[:size] == stem]
            up = theta.get(stem[:4], 0.5) if size == 5 and logit(theta.get(stem[:4], 0.5)) > T.LEAST_ODDS else 0.5
            theta[stem] = (sum(share[w] * sure[w] for w in own) + T.STEM_PRIOR * up) / (sum(sure[w] for w in own) + T.STEM_PRIOR)
    stems = {k: logit(v) for k, v in theta.items() if logit(v) > T.LEAST_ODDS}
    base = (n1 + 1) / (n1 + n0 + 2)
    one, zero = 0.5 / base, 0.5 / (1 - base)
    held = T.PRIOR * max(one, zero)

    def odds(w):
        by_stem = next((stems[w[:n]] for n in (5, 4) if len(w) > n and w[:n] in stems), 0.0)
        if w not in share:
            return by_stem
        prior = theta[w[:5]] if len(w) > 5 else theta[w[:4]] if len(w) > 4 else 0.5
        x = logit((c1[w] * one + held * prior) / (c1[w] * one + c0[w] * zero + held))
        if x > T.LEAST_ODDS:
            return x
        return 0.0 if by_stem or any(w[:n] in stems for n in (4, 5)) else by_stem

    def scores(t):
        words = WORD.findall(t.lower())
        return len(words), [s for _, _, s in all_maximal([(o if o > T.DRIFT else 0.0) - T.DRIFT for o in map(odds, words)])]

    scanned = [(*scores(t), y) for t, y in sample]
    tops = [max(s, default=0.0) for _, s, y in scanned if not y]
    clean = [(n, s) for n, s, y in scanned if not y and max(s, default=0.0) <= np.quantile(tops, 1 - T.MISLABELLED)]
    total = sum(n for n, _ in clean)
    steps = [round(x, 3) for _, s in clean for x in s]
    mean = lambda lam: (sum(math.exp(min(700.0, lam * s)) for s in steps) + (total - len(steps)) * math.exp(-lam * T.DRIFT)) / total
    lo, hi = 1e-6, 64.0
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if mean((lo + hi) / 2) < 1 else (lo, (lo + hi) / 2)
    lam = max(lo, 0.05) if steps else 1.0
    k = max(sum(math.exp(lam * s) for s in steps), 1.0) / total

    def evidence(n, s):
        return math.log1p(sum(max(0.0, lam * x - math.log(k * max(n, 1))) for x in s))

    x = np.array([[1.0, evidence(n, s)] for n, s, _ in scanned])
    y = np.array([y for *_, y in scanned], float)
    b = np.zeros(2)
    for _ in range(3000):  # steps so short that they need no second thought
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * b
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), g).clip(-0.1, 0.1)
    return lambda t: 1 / (1 + math.exp(-(b[0] + max(0.0, b[1]) * evidence(*scores(t)))))


def test_query_equals_brute_force(spark):
    docs, labels = labelled(160)
    docs = [(i, " ".join(t.split()[:40])) for i, t in docs] + [(500, "grumble wordaly snarlish"), (501, None), (502, "GRUMBLE, snarlology; worda")]
    score = brute_model(docs, labels)
    out = T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    for r in out:
        want = score(dict(docs)[r.doc_id] or "")
        assert abs(r.score - want) < 1e-6 and r.predicted == (want >= T.THRESHOLD), (r, want)
    assert {r.predicted for r in out} == {0, 1}


def test_very_long_text(spark):
    docs, labels = labelled(300)
    docs += [(900, "worda wordbly " * 500_000 + "grumble snarlish grumble snarlful"), (901, "worda grumble wordb wordc wordd worde " * 100_000)]
    out = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert out[900].passages[0].start == 14 * 500_000
    assert out[901].passages == []  # a word now and then is what as long a clean text would hold


def labelled(n=600):
    rng = random.Random(1)
    clean, bad = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"], ["grumble", "snarlish", "snarlic", "snarlful", "snarlment"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) + rng.choice(["", "ly", "s"]) for _ in range(rng.choice([5, 30, 200]))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_stems(spark):
    docs, labels = labelled()
    docs += [(10_001, None), (10_002, ""), (10_003, "worda Snarlology wordb SNARLING wordc"), (None, "worda")]
    out = T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    held = [(by[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    assert sum(p == y for p, y in held) >= 0.98 * len(held)
    assert by[10_003].predicted == 1 and by[10_003].score > by[10_002].score
    assert by[10_001].predicted == by[10_002].predicted == by[None].predicted == 0 and not by[None].held_out
    p = by[10_003].passages
    assert p and all(0 <= x.start < x.end <= 40 for x in p)


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in T.toxicity(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert a == b


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in T.toxicity(frame, none).collect()} == {0}
    assert T.toxicity(frame.limit(0), none).count() == 0


def test_stage_keeps_columns_and_clean_rows(spark):
    docs, labels = labelled(300)
    frame = spark.createDataFrame([(i, t, "en", 1.5) for i, t in docs], "doc_id long, text string, score string, evidence double")
    out = T.stage(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.columns == frame.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i, y in labels if not y}
