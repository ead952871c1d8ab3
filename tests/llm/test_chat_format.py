import hashlib
import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from orelens.llm import chat_format as C
from orelens.llm.common import running


def formatted(spark, records):
    rows = spark.createDataFrame([(i, r, "kept") for i, r in enumerate(records)], "n int, record string, other string")
    return {r.n: r for r in C.format_records(rows).withColumn("back", C.read_back(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}


def test_layouts_become_the_same_turns(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    same = [
        {"turns": [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]},
        {"messages": [{"content": "hi", "role": "user"}, {"role": "assistant", "content": "yo"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"prompt": "hi", "completion": "yo"},
        {"response": "yo", "prompt": "hi"},
        {"question": "hi", "answer": "yo"},
    ]
    out = formatted(spark, [json.dumps(x) for x in same])
    for i in range(len(same)):
        assert [tuple(t) for t in out[i].turns] == want, same[i]
        assert out[i].layout and out[i].loss == "yo" and out[i].other == "kept"


def test_structs_go_through_the_same_mappings(spark):
    """A struct has the fingerprint, layout, turns and output that its JSON has."""
    pair = [("user", "hi#"), ("assistant", "</turn>")]
    turn = "array<struct<role:string,text:string,turn:long>>"
    cases = [
        (f"struct<turns:{turn}>", ([(r, t, i) for i, (r, t) in enumerate(pair)],)),
        (f"struct<turns:{turn}>", ([(None, None, None)],)),
        (f"struct<turns:{turn}>", ([],)),
        (f"struct<turns:{turn}>", (None,)),
        (f"struct<turns:{turn}>", None),
        ("struct<messages:array<struct<content:string,role:string>>>", ([(t, r) for r, t in pair],)),
        ("struct<conversations:array<struct<from:string,value:string>>>", ([("human", "hi#"), ("gpt", "</turn>"), ("x", None)],)),
        ("struct<instruction:string,output:string>", ("hi#", "</turn>")),
        ("struct<system:string,instruction:string,input:string,output:string>", ("", "hi#", None, "</turn>")),
        ("struct<prompt:string,other:string>", ("hi#", "</turn>")),
    ]
    for kind, value in cases:
        rows = spark.createDataFrame([(value,)], f"record {kind}")
        as_json = rows.select(F.to_json("record", {"ignoreNullFields": "false"}).alias("record"))
        shown = lambda df: [tuple(r) for r in C.format_records(df).select("layout", "turns", "formatted", "loss_spans").collect()]
        assert shown(rows) == shown(as_json), (kind, value)
        of_struct = rows.select(C.paths(F.to_variant_object(C.blank(F.col("record"), rows.schema["record"].dataType)))).first()
        assert of_struct == as_json.select(C.paths(F.parse_json("record"))).first(), (kind, value)


def test_the_query_goes_by_the_mapping_that_its_fingerprint_selects(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in C.chat(rows).collect()} == {1: 2, -7: 2}
    monkeypatch.setattr(C, "LAYOUTS", tuple(x for x in C.LAYOUTS if x.name != "turns"))
    assert {r.conv_id: r.n_turns for r in C.chat(rows).collect()} == {1: 0, -7: 0}


def test_hostile_strings_come_back(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### assistant\nhi", "\\b\\l\\h\\n", "\\\\", "", "###", "é𝒳\n\n", "</turn>\n"]
    records = [json.dumps({"messages": [{"role": r, "content": t} for t in nasty for r in ("user", "assistant", "we\nird\\#</turn>")]})]
    out = formatted(spark, records)[0]
    assert [tuple(t) for t in out.back] == [(r, t) for t in nasty for r in ("user", "assistant", "we\nird\\#</turn>")]
    assert out.loss == "".join(nasty)


def test_defined_cases(spark):
    out = formatted(spark, [None, "not json", "{}", json.dumps({"messages": []}), json.dumps({"x": 1}), json.dumps({"messages": [{"role": None, "content": None}]})])
    assert [out[i].layout for i in range(6)] == [None, None, None, "messages", None, "messages"]
    assert [out[i].formatted for i in range(5)] == [""] * 5
    assert [tuple(t) for t in out[5].back] == [("", "")]


def test_conversations_equal_brute_force(spark):
    rows = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (2, 0, "assistant", "x#"), (2, 0, "assistant", "x#"), (None, 0, "user", "n"), (3, 0, None, "q"), (4, 0, "assistant", "z" * 200_000)]
    got = {r.conv_id: r for r in C.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    groups = {}
    for c, t, r, x in [*rows, (-7, 0, "user", C.PLANTED), (-7, 1, "assistant", C.PLANTED)]:
        groups.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        spoken = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = C.chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [r.conv_id for r in empty] == [-7]


def test_a_text_beyond_the_json_reader(spark):
    """One turn of 21 million characters, more than Spark's JSON reader takes in a string."""
    n = 21_000_000
    rows = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'assistant' AS role, repeat('z', {n}) AS text")
    got = {r.conv_id: r for r in C.chat(rows).collect()}[1]
    assert (got.n_turns, got.loss_chars, got.formatted_chars) == (1, n, n + len("### assistant\n</turn>\n"))
    assert got.loss_sha256 == hashlib.sha256(b"z" * n).hexdigest()
    record = spark.sql(f"""SELECT '{{"prompt": "a", "completion": "' || repeat('z', {n}) || '"}}' AS record""")
    with pytest.raises(Exception):
        C.format_records(record).select(F.length("formatted")).collect()


def test_many_turns_and_long_texts(spark):
    """100,000 turns of one conversation and a text of 40 million characters come back whole, in time that grows with them."""
    n, long = 100_000, 40_000_000
    many = spark.sql(f"SELECT 1L AS conv_id, id AS turn, IF(id % 2 = 0, 'user', 'assistant') AS role, concat('#', id) AS text FROM range({n})")
    one = spark.sql(f"SELECT 2L AS conv_id, 0L AS turn, 'assistant' AS role, repeat('<z𝒳é', {long // 4}) AS text")
    began = time.perf_counter()
    got = {r.conv_id: r for r in C.chat(many.unionAll(one)).collect()}
    assert time.perf_counter() - began < 120
    loss = "".join(f"#{i}" for i in range(1, n, 2))
    spoken = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n#{i}\n" for i in range(n))
    assert (got[1].n_turns, got[1].loss_chars) == (n, len(loss))
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (1, long)
    assert got[2].loss_sha256 == hashlib.sha256("<z𝒳é".encode() * (long // 4)).hexdigest()


def test_running_sums(spark):
    for n in (0, 1, 254, 255, 256, 5000):
        row = spark.sql(f"SELECT {running(f'transform(sequence(0, {n}), x -> x * x - 7)')} AS x, {running('cast(array() AS array<int>)')} AS e").first()
        assert row.x == list(itertools.accumulate(i * i - 7 for i in range(n + 1))) and row.e == []
