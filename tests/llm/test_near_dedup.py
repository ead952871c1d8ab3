import random
import re

import numpy as np

from orelens.llm import near_dedup as N

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)], least[root(i)] == d) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Été", "ÇA", "x y"]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if docs and kind < 0.5:
            base = list(rng.choice(docs))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.3:
                base = base + [rng.choice(words)] * rng.choice([1, 3])
            docs.append(base)
        else:
            docs.append([rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 20, 60, 150, 300]))])
    rows = [(i * 7 % 1009, rng.choice([" ", "\n", "\t \x0b"]).join(d)) for i, d in enumerate(docs)]
    return [*rows, (5001, None), (5002, ""), (5003, " \n"), (5004, None)]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
        assert got == brute(rows)


def test_links_between_documents_that_miss_the_first_centre(spark):
    """A passage shared by texts that are otherwise different puts them into the same buckets."""
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = [f"o{i}x{k}" for k in range(rng.choice([8, 12, 20]))]
        rows.append((i, " ".join(shared + own)))
        rows.append((1000 + i, " ".join(shared + own[:-1] + ["z"])))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_crowd_around_a_text(spark, monkeypatch):
    """Copies with a few words changed: those with more changes are linked to none, or to a few that share them."""
    monkeypatch.setattr(N, "STAR", 7)  # so that the centre goes to several tasks
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 5])):
            own[rng.randrange(150)] = f"n{rng.randrange(50)}"
        rows.append((i * 37 % 401, " ".join(own)))
        if i % 40 == 0:
            more = list(own)
            more[rng.randrange(150)] = "extra"
            rows.append((1000 + i, " ".join(more)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def family(pairs):
    """Texts on one template, similar by 0.845; each has a partner with one more shingle in common, which makes 0.853."""
    base = [f"t{i}" for i in range(200)]
    texts = [" ".join(base + [f"o{i}x{k}" for k in range(13)] + [f"p{i // 2}x{k}" for k in range(5)]) for i in range(2 * pairs)]
    return [(i * 7919 % 100_003, t) for i, t in enumerate(texts)]


def test_a_crowd_that_no_bucket_tells_apart(spark):
    """All share crowded buckets at every level, and a linked pair needn't hold the centre of one."""
    rows = family(120)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rarest_shingles_find_every_link(spark):
    """The exact join alone, without any bucket, gives every component."""
    for rows in (corpus(5), family(30)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        pairs = N._rarest(docs, docs.select("doc_id"), spark.createDataFrame([], "id long, label long"))
        labels = dict(map(tuple, N.components(N.confirm(pairs, docs).where("ok")).collect()))
        assert {d: labels.get(d, d) for d, _ in rows} == {d: x[1] for d, x in brute(rows).items()}


def test_edge_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C d e f"), (3, "q " * 5000), (None, None)]
    out = [tuple(r) for r in N.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")).collect()]
    assert sorted(out, key=str) == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (None, 0, None, True)], key=str)
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "s"), (2, "a b c d e f g", "t"), (3, None, None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, N.keep_first_of_each(docs).collect())) == [(1, "a b c d e f g", "s"), (3, None, None)]


def test_long_words_and_runs():
    texts = ["x" * 3_000_000 + " a b c d e", "a b c d e", "é " * 700_000]
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    assert [len(s) for s in N.shingle_sets(data, at)] == [len(shingles(t)) for t in texts]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    got = dict(map(tuple, N.components(links).collect()))
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
