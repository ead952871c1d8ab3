import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from orelens.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(spans)


def spell(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def texts():
    rng = random.Random(5)
    parts = ["token: token: abcdefgh", "PassWord = 'hunter22'", "api_key:abc", "APIKEY=\"x/y+z==\"", "tſecret", "passwd=Key12345", "AKIA" + "A1" * 8, "AKIAAKIA" + "Q" * 12, "deadbeef" * 4, "0123456789abcdef0123456", "é", "𝒳𝒳", " ", "\n", "secret:secret:secret:xyz", "aGVsbG8gd29ybGQh/+x9Zk3LmQ72bTvYwPo1", "thisisaverylongordinarywordwithnodigits", "a" * 40 + "1"]
    out = ["", "token=abcdef"]
    for _ in range(200):
        out.append(rng.choice(["", " ", "x"]).join(rng.choice(parts) for _ in range(rng.randrange(12))))
    return out


def test_base_spans_equal_brute_force(spark):
    rows = [*enumerate(texts()), (9000, None)]
    out = S.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = base(dict(rows)[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(spell(want).encode()).hexdigest(), (dict(rows)[r.doc_id], r.spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in spell(want).split(",") if x]


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(48)) for _ in range(60)]
    keys = [k for k in keys if re.search("[0-9]", k)]
    plain = ["chapter1ofthestatementsofthetestsettings", "aaaaaaaaaaaaaaaaaaaaaaaa1", "one-two-three-four-five-six-7-eight-nine-ten", "000000000011111111112222222222x"]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(1000 + i, f"see {p} here") for i, p in enumerate(plain * 10)]
    out = {r.doc_id: r for r in S.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(out[i].spans == f"random:4:{4 + 48}" for i in range(len(keys)))
    assert found >= 0.95 * len(keys)
    assert sum(out[1000 + i].n_random for i in range(len(plain) * 10)) == 0


def test_tokens_apart_from_spans(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        cuts, more = sorted(rng.sample(range(60), 16)), sorted(rng.sample(range(60), 6))
        rows.append((list(zip(cuts[::2], cuts[1::2])), list(zip(more[::2], more[1::2]))))
    spans = spark.createDataFrame([(t, o, t) for t, o in rows], "t array<struct<start:int,end:int>>, o array<struct<start:int,end:int>>, was array<struct<start:int,end:int>>")
    for r in S.apart(spans, "t", "o").collect():
        assert r.t == [t for t in r.was if not any(a < t[1] and t[0] < b for a, b in r.o)]


def test_work_grows_with_the_matches(spark):
    """100,000 hex runs, assignments and free runs each in one text; copies that grow by one each took minutes for 10,000."""
    n, unit = 100_000, "0123456789abcdef01234567 token=abcdefg AbCdEfGhIjKlMnOpQrStUvWx1 "
    text = unit * n
    began = time.perf_counter()
    out = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).first()
    assert time.perf_counter() - began < 120
    assert out.n == 2 * n
    assert (out.last.start, out.last.end) == (len(text) - len(unit) + 25, len(text) - len(unit) + 38)


def test_empty_table_and_other_columns(spark):
    assert S.secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = S.secrets(spark.createDataFrame([(1, "x", "y"), (1, "x", "y")], "doc_id long, text string, spans string"))
    assert [(r.doc_id, r.spans, r.n_random) for r in out.collect()] == [(1, "", 0)] * 2
