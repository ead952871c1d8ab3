import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from orelens.llm import line_dedup as L


def brute(rows, keep_whole=False):
    pages, found = Counter(), defaultdict(int)
    for _, host, text in rows:
        pages[host] += 1
        for line in set((text or "").split("\n")) if text is not None else ():
            if line.strip(" "):
                found[host, line] += 1
    bad = {k for k, n in found.items() if n >= L.MIN_PAGES and n > L.RATIO * pages[k[0]]}
    out = []
    for doc, host, text in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (host, x) not in bad]
        if keep_whole and not any(x.strip(" ") for x in kept):
            kept = lines
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    out = []
    for i in range(300):
        host = rng.choice(["hot"] * 5 + ["a", "b", None])
        lines = [rng.choice(["menu", "footer", f"line {i} {k}", "", "  ", "shared"]) for k in range(rng.randrange(1, 9))]
        out.append((i, host, "\n".join(lines)))
    out += [(1000 + i, "copies", "menu\n\nthe same page\nend") for i in range(30)]
    return out + [(2000, "a", None), (2001, None, ""), (2002, "alone", "menu\nmenu"), (2003, "hot", "x" * 300_000 + "\nmenu"), (2003, "hot", "menu\nkeep")]


def test_equals_brute_force(spark):
    got = L.drop_boilerplate(spark.createDataFrame(rows(), "doc_id long, source string, text string"), "source", "text")
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows())


def test_salted_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
    got = L.drop_boilerplate(spark.createDataFrame(rows(), "doc_id long, source string, text string"), "source", "text")
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows())


def test_pages_of_boilerplate_alone(spark):
    frame = spark.createDataFrame(rows(), "doc_id long, source string, text string")
    for keep in (False, True):
        got = L.drop_boilerplate(frame, "source", "text", keep_whole_pages=keep).where("source = 'copies'").collect()
        assert {(r.text, r.n_dropped) for r in got} == ({("menu\n\nthe same page\nend", 0)} if keep else {("", 3)})


def test_clashing_columns_pass_through(spark):
    frame = spark.createDataFrame([(*r, 7, 8, 9, "x", 1) for r in rows()], "doc_id long, source string, text string, n_lines int, _drop int, _lines int, c2 string, host int")
    got = L.drop_boilerplate(frame, "source", "text")
    assert got.columns == [*frame.columns, "n_lines_", "n_dropped"]
    got = got.collect()
    assert {(r.n_lines, r._drop, r._lines, r.c2, r.host) for r in got} == {(7, 8, 9, "x", 1)}
    assert sorted(((r.doc_id, r.text, r.n_lines_, r.n_dropped) for r in got), key=str) == brute(rows())


def test_hosts_of_urls(spark):
    urls = ["http://A.Example.com/x?y#z", "x://h", "nothing", None, "a://b://c/d", "http://?q"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(L.host_of(F.col("url"))).collect()
    assert [r[0] for r in got] == ["a.example.com", "h", None, None, "b:", ""]


def test_stage_keeps_columns_rows_and_clashing_names(spark):
    frame = spark.createDataFrame([(*r, 7) for r in rows()], "doc_id long, source string, text string, n_lines int")
    out = L.stage(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    assert {r.n_lines for r in out.collect()} == {7}
    assert L.stage(frame.limit(0)).count() == 0
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [x[:2] for x in brute(rows(), keep_whole=True)]
