import random
import re
from collections import Counter

from pyspark.sql import functions as F

from orelens.llm import mixing as M


def targets(sizes):
    weights, left, out = {}, set(sizes), {}
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        weights[s] = (5, 2, 1)[i % 3]
    rest = 1.5 * sum(sizes.values())
    while left:
        level = rest / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weights[s] * level for s in left}
        for s in over:
            out[s] = 2 * sizes[s]
            rest -= out[s]
        left -= over
    return out


def docs(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["hot"] * 8 + ["a", "b", "ä", "z", None, ""])
        out.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), source))
    return out + [(n, None, "a"), (n + 1, "\x0b \t", "a"), (n + 2, None, "empty source"), (None, "a b c", "b")]


def test_targets_sizes_and_budgets(spark):
    rows = docs(1500)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(frame).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want, taken, biggest = targets(dict(size)), Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-9, s
    assert sorted(map(str, got)) == sorted(map(str, M.mix(frame.repartition(7)).collect()))


def test_rows_of_one_hash_are_split_at_the_target(spark, monkeypatch):
    """Null ids, repeated ids and rows that repeat whole: each source comes within a document of its target."""
    rows = [(None, "a b c d e", "null ids")] * 1000 + [(1, f"a b c {i}", "one id") for i in range(300)] + [(i, "a b", "t") for i in range(2, 60)]
    rows += [(7, "x y z", None)] * 50
    for tied in (M.TIED, 9):
        monkeypatch.setattr(M, "TIED", tied)
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = M.mix(frame).collect()
        assert len(got) == len(rows)
        taken, target, biggest = Counter(), {}, Counter()
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.target
            biggest[r.source] = max(biggest[r.source], r.size)
        assert set(target) == {"null ids", "one id", "t", None}
        assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-9 for s in target)
        again = M.mix(frame.repartition(5)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        staged = Counter(r.source for r in M.stage(frame).collect())
        assert staged == Counter({s: n for s in target if (n := sum(r.times for r in got if r.source == s))})


def test_stage_repeats_documents(spark):
    rows = [(i, t, s, 1, 2, 3, 4) for i, t, s in docs(400, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _times int, c1 int, target int")
    mixed = M.mix(frame).where("times > 0").groupBy("doc_id").agg(F.sum("times").alias("n"))
    want = {r.doc_id: r.n for r in mixed.collect()}
    out = M.stage(frame)
    assert out.columns == frame.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0 and M.stage(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in M.mix(blank).collect()] == [(0.0, 0)] * 2
