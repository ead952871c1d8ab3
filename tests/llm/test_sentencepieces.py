import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orelens.llm import sentencepieces as S
from orelens.llm.common import BATCH_BYTES
from orelens.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(tokenizer_path())


def brute(text, pieces, byte_ids, unknown):
    """Viterbi by its recurrence over one whole text, the earlier start winning ties."""
    data = (" " + text).encode()
    best, back = [None] * (len(data) + 1), [None] * (len(data) + 1)
    best[0] = 0.0
    for i in range(len(data)):
        if best[i] is None or data[i] & 0xC0 == 0x80:
            continue
        width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        single = False
        for j in range(i + 1, min(len(data), i + 26) + 1):
            hit = pieces.get(data[i:j])
            if hit:
                single |= j == i + width
                if best[j] is None or best[i] + hit[1] > best[j]:
                    best[j], back[j] = best[i] + hit[1], (i, hit[0])
        if not single and (best[i + width] is None or best[i] + unknown > best[i + width]):
            best[i + width], back[i + width] = best[i] + unknown, (i, None)
    out, j = [], len(data)
    while j:
        i, piece = back[j]
        out = ([piece] if piece is not None else [int(byte_ids[b]) for b in data[i:j]]) + out
        j = i
    return out


def samples():
    rng = random.Random(6)
    words = ["the", "retioning", "ouen", "Straße", "naïve", "été", "日本語", "🎉x", "x" * 70, "1234567", "a▁b", "\t", "don't", "C++", "ﬁ", "\u200b", "�"]
    out = ["a", " ", "  two  spaces ", "\n", "▁", "line\nline\n\n end", "𝒳" * 5]
    return out + [rng.choice([" ", "  ", "\n", ""]).join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(150)]


def test_equals_brute_force_and_comes_back(vocabulary):
    pieces, _ = S.read_model(tokenizer_path())
    table = {p.replace(S.MARK, " ").encode(): (i, s) for i, (p, s, k) in enumerate(pieces) if k == S.NORMAL}
    texts = samples()
    encoder = S.Encoder(vocabulary)
    for _ in range(2):  # with and without segments in memory
        ids, counts = encoder.encode(texts)
        at = np.concatenate(([0], np.cumsum(counts)))
        for t, a, b in zip(texts, at[:-1], at[1:]):
            assert ids[a:b].tolist() == brute(t, table, vocabulary.byte_ids, vocabulary.unknown), t
        data, ends = vocabulary.decode(ids, counts)
        assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == texts


def test_small_memories_change_nothing(vocabulary, monkeypatch):
    texts = samples()
    whole = S.Encoder(vocabulary).encode(texts)[0].tolist()
    for cache, chars, run in ((3, 64, 1 << 21), (50, 4, 200), (0, 64, 50)):
        monkeypatch.setattr(S, "CACHE", cache)
        monkeypatch.setattr(S, "CACHED_CHARS", chars)
        monkeypatch.setattr(S, "RUN_CHARS", run)
        assert S.Encoder(vocabulary).encode(texts)[0].tolist() == whole


def test_trie_finds_what_was_put_in():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    base, check, value = S.build_trie(keys)

    def find(key):
        node = 0
        for c in key:
            step = base[node] + c
            if check[step] != node or step == 0:
                return -1
            node = step
        return value[node]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"zz") == -1 for k in keys)


def test_frames(spark):
    rows = [(1, "hello world", "x"), (2, "", "y"), (3, None, None), (4, "z" * 300_000 + " é", "x"), (1, "hello world", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, round_trip string")
    out = S.encode(frame, tokenizer_path(), ["doc_id"], verify=True)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].ids == [] and got[3].ids is None and got[3].n_tokens == 0
    assert all(r.round_trip for r in got.values()) and got[1].n_tokens == len(got[1].ids) > 0
    back = {r.doc_id: r.text for r in S.decode(out, tokenizer_path(), ["doc_id"]).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert S.encode(frame.limit(0), tokenizer_path(), ["doc_id"]).count() == 0
    clash = S.encode(frame.withColumnRenamed("round_trip", "ids"), tokenizer_path(), ["doc_id", "ids"])
    assert clash.columns == ["doc_id", "ids", "ids_", "n_tokens"] and {r.ids for r in clash.collect()} == {"x", "y", None}


def test_ranks_become_log_scores():
    pieces, _ = S.read_model(tokenizer_path())
    scores = [s for _, s, k in pieces if k == S.NORMAL]
    assert abs(sum(np.exp(scores)) - 1) < 1e-3


def model_file(path, pieces, charsmap=b"", squeeze=True, prefix=True):
    """A unigram model's file by hand: (piece, score, type) and the normaliser's settings."""

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    part = lambda number, body: varint(number << 3 | 2) + varint(len(body)) + body
    data = b"".join(part(1, part(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in pieces)
    data += part(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + part(3, part(2, charsmap) * bool(charsmap) + b"\x18" + varint(prefix) + b"\x20" + varint(squeeze))
    path.write_bytes(data)
    return str(path)


def small_pieces():
    pieces = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL), ("<sep>", 0.0, S.USER_DEFINED)]
    pieces += [(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)]
    texts = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁b", "é", "f", "i", "fi", "1", "▁1", "e"]
    return pieces + [(t, -1.0 - (7 * k % 11) - k / 64, S.NORMAL) for k, t in enumerate(texts)]


def test_unigram_models_equal_the_library(tmp_path):
    """Normaliser maps, squeezed spaces and pieces defined by the user, against the published library."""
    sentencepiece = pytest.importorskip("sentencepiece")
    charsmap = dict(S._fields(dict(S._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]))[2]
    path = model_file(tmp_path / "m.model", small_pieces(), charsmap)
    theirs, own = sentencepiece.SentencePieceProcessor(model_file=path), S.Vocabulary(path)
    rng = random.Random(4)
    texts = ["abc ab", "  a  b ", "ﬁ é e\u0301 ①", "ab<sep>abc", "a<sep><sep><sep>b", "\tab\nc", "", "zzz 日本", "ａｂｃ", "<sep>"]
    texts += ["".join(rng.choice(["a", "b", "c", " ", "<sep>", "é", "e\u0301", "ﬁ", "1", "\n", "日"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    encoder = S.Encoder(own)
    normal = [own.normalise(t) for t in texts]
    ids, counts = encoder.encode(normal)
    at = np.concatenate(([0], np.cumsum(counts)))
    data, ends = own.decode(ids, counts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == theirs.encode(t), (t, theirs.encode(t, out_type=str))
        assert data[ends[k] : ends[k + 1]].tobytes().decode() == normal[k]


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    """Sixty texts of 200,000 characters in one partition: no batch that a worker gets holds much more than BATCH_BYTES."""

    def sizes(*_):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(n, pa.list_(pa.int32())), pa.array([batch.nbytes] * n, pa.int64())], ["doc_id", "ids", "n_tokens"])

        return run

    monkeypatch.setattr(S, "_encoder", sizes)
    docs = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 200_000).alias("text"))
    held = lambda: [r.n_tokens for r in S.encode(docs, tokenizer_path(), ["doc_id"]).collect()]
    got = held()
    assert len(got) == 60 and max(got) < BATCH_BYTES + 500_000
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(setting, "8m")  # a session's own size holds
    try:
        assert max(held()) > 2 * BATCH_BYTES
    finally:
        spark.conf.unset(setting)
