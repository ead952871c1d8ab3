import random
from collections import Counter

import corpus_pipeline as P
from orelens.llm import mixing, sentencepieces
from orelens.llm.queries import QUERIES, tokenizer_path

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_groups
from .test_near_dedup import shingles


def corpus(folder, spark):
    rng = random.Random(12)
    words = ["and", "the", "reason", "Ort", "mañana", "été", "stone", "river", "light", "field", "under", "seven"]
    docs, labels = [], []
    for i in range(360):
        body = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([3, 30, 90]))]
        toxic = i % 9 == 0
        if toxic:
            for w in ("vilest", "vilely", "grubber"):
                body.insert(rng.randrange(len(body)), w)
        text = " ".join(body) + "\n" + rng.choice(["cookie notice", "own line " + str(i)])
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
        if i % 10 == 1 and len(body) > 25 and not toxic:
            docs.append((1000 + i, text, "en", f"s{i % 4}", len(text)))
    docs += [(5000, None, None, None, None), (5001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, {i for i, _, t in labels if t}


def test_stages_equal_brute_force(spark, tmp_path):
    docs, toxic = corpus(str(tmp_path), spark)
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    frame, seen = P.table(spark, str(tmp_path), "documents"), []
    columns = frame.columns
    for name, stage in P.STAGES:
        frame = P.settle(stage(spark, frame, str(tmp_path)))
        seen.append(frame)
        assert name == "encode" or frame.columns == columns
    clean = [(d[0], d[3], d[1]) for d in docs if d[0] not in toxic]
    assert sorted(r.doc_id for r in seen[0].collect()) == sorted(d[0] for d in clean)
    lines = {d: t for d, t, _, _ in brute_lines(clean)}
    assert {r.doc_id: r.text for r in seen[1].collect()} == lines
    kept = {d for d, x in brute_groups(list(lines.items())).items() if x[2]}
    assert {r.doc_id for r in seen[2].collect()} == kept
    times = {r.doc_id: r.times for r in mixing.mix(seen[2]).collect()}
    assert Counter(r.doc_id for r in seen[3].collect()) == Counter({d: n for d, n in times.items() if n})
    out = seen[4].collect()
    assert len(out) == sum(times.values())
    back = {r.doc_id: r.text for r in sentencepieces.decode(seen[4], tokenizer_path(), ["doc_id"]).collect()}
    assert back == {d: lines[d] for d, n in times.items() if n}
    again = P.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_near_copies_from_a_similarity_of_80_percent(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = [f"d{i}w{k}" for k in range(100)]
        rows.append((i, " ".join(words)))
        for at in ((20, 70), (20, 50, 80))[i % 2]:
            words[at + rng.randrange(5)] = "changed"
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in rows}
    alike = {i: 100 * len(sets[i] & sets[100 + i]) / len(sets[i] | sets[100 + i]) for i in range(40)}
    assert any(80 <= x < 85 for x in alike.values()) and any(x < 80 for x in alike.values())
    got = {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()}
    assert got == set(range(40)) | {100 + i for i, x in alike.items() if x < 80}


def test_empty_documents(spark, tmp_path):
    corpus(str(tmp_path / "full"), spark)
    empty = P.table(spark, str(tmp_path / "full"), "documents").limit(0)
    for _, stage in P.STAGES:
        empty = P.settle(stage(spark, empty, str(tmp_path / "full")))
    assert empty.count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))


def test_columns_without_a_type_are_settled(spark):
    from pyspark.sql import functions as F

    out = P.settle(spark.range(2).select("id", F.lit(None).alias("x y")))
    assert out.dtypes == [("id", "bigint"), ("x y", "string")] and out.count() == 2
