"""Chat formatting by schema fingerprints.

A record is JSON of any layout, or a struct. Its nested field paths, without the types of plain values, are hashed;
the hash selects a declarative mapping (where the turns are, which fields hold role and text, which role each field of
a prompt layout has) that turns the record into canonical turns. A struct's texts never become JSON or a Variant, which
have limits: only what it has of fields and items does, and texts are then read from its columns. The template writes
each turn as

    ### <role>\\n<text></turn>\\n

and escapes, in roles and texts, the characters that control strings are made of: backslash, < and # become \\b, \\l
and \\h (and a role's line feed \\n). None of the three stands in an escaped string, so no text can open or close
a turn, and unescaping gives every text back exactly. The loss mask covers assistant texts, as spans of the output.

Defined cases: a null text is empty; a null role is the empty role; a record that isn't JSON, is null, or has a
layout without a mapping has a null `layout`, no turns and an empty output; a record of more than READER_LIMIT bytes
that can't be parsed is an error; conversations are ordered by turn, ties
by role and text; an empty table gives an empty result; other columns pass through `format_records`. A
conversation is one document, so its turns meet in one row, however many it has; hot first turns, roles or copies
of conversations don't matter, as only conv_id groups rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import let, running

OPEN, HEAD_END, CLOSE = "### ", "\n", "</turn>\n"
#: Names that other layouts give to the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How one layout maps to turns: either a list with fields for role and text, or single fields with fixed roles.

    Each alternative is a layout meant, and gets a fingerprint of its own.
    """

    name: str
    alternatives: tuple[dict, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    rename: bool = False
    fields: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


#: Each alternative is an example of the layout: fields, and in a list one item.
LAYOUTS = (
    Layout("turns", ({"turns": [{"role": 0, "text": 0}]}, {"turns": [{"role": 0, "text": 0, "turn": 0}]}, {"turns": []}), turns="turns", text="text"),
    Layout("messages", ({"messages": [{"content": 0, "role": 0}]}, {"messages": [{"content": 0, "name": 0, "role": 0}]}, {"messages": []}), turns="messages"),
    Layout("from_value", ({"conversations": [{"from": 0, "value": 0}]}, {"conversations": [{"from": 0, "value": 0, "weight": 0}]}), turns="conversations", role="from", text="value", rename=True),
    Layout("instruction", ({"instruction": 0, "input": 0, "output": 0}, {"instruction": 0, "output": 0}, {"instruction": 0, "input": 0, "output": 0, "system": 0}), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ({"prompt": 0, "completion": 0},), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ({"prompt": 0, "response": 0}, {"prompt": 0, "response": 0, "system": 0}), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ({"question": 0, "answer": 0},), fields=(("user", ("question",)), ("assistant", ("answer",)))),
)
#: Characters that Spark's JSON reader takes in one string; a shorter record can't reach this or a Variant's 128 MiB.
READER_LIMIT = 20_000_000
#: Code points of the pieces that cut() makes.
PIECE = 1024
_PLAIN = r"(STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\(\d+,\d+\))"


def paths(record: Column) -> Column:
    """The record's nested field paths as text, such as OBJECT<messages: ARRAY<OBJECT<content, role>>>."""
    kind = F.call_function("schema_of_variant", record)
    return F.regexp_replace(F.regexp_replace(kind, ": " + _PLAIN + "(?=[,>])", ""), "ARRAY<" + _PLAIN + ">", "ARRAY<>")


def blank(value: Column, kind: DataType) -> Column:
    """A struct's or array's fields and items alone, plain values as 0 and items alike once: its size doesn't depend on texts."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[blank(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.array_distinct(F.transform(value, lambda v: blank(v, kind.elementType)))
    return F.lit(0)


def paths_of(example) -> str:
    """The same of an example, where fields are in the order that Spark gives them, by name."""
    if isinstance(example, dict):
        return "OBJECT<" + ", ".join(k if v == 0 else f"{k}: {paths_of(v)}" for k, v in sorted(example.items())) + ">"
    return f"ARRAY<{paths_of(example[0]) if example else ''}>"


def fingerprint(field_paths: Column) -> Column:
    return F.xxhash64(field_paths)


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


class _Variant:
    """Reads a Variant's fields."""

    def text(self, v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    def items(self, v: Column, name: str) -> tuple[Column, _Variant]:
        return F.try_variant_get(v, f"$.{name}", "array<variant>"), self


class _Struct:
    """Reads a struct's fields; those that its type doesn't have are NULL."""

    def __init__(self, kind: DataType):
        self.kinds = {f.name: f.dataType for f in kind.fields} if isinstance(kind, StructType) else {}

    def text(self, v: Column, name: str) -> Column:
        return v[name].cast("string") if name in self.kinds else F.lit(None).cast("string")

    def items(self, v: Column, name: str) -> tuple[Column, _Struct]:
        kind = self.kinds.get(name)
        return (v[name], _Struct(kind.elementType)) if isinstance(kind, ArrayType) else (F.array(), _Struct(DataType()))


def _mapped(layout: Layout, record: Column, read: _Variant | _Struct) -> Column:
    if layout.turns:
        items, inner = read.items(record, layout.turns)

        def one(v):
            role = inner.text(v, layout.role)
            if layout.rename:
                names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
                role = F.coalesce(F.element_at(names, role), role)
            return _turn(role, inner.text(v, layout.text))

        return F.transform(items, one)
    turns = []
    for role, names in layout.fields:
        parts = [F.when(read.text(record, n) != "", read.text(record, n)) for n in names]
        said = F.concat_ws("\n\n", *parts)
        turns.append(F.when((said != "") | F.lit(role != "system"), _turn(F.lit(role), said)))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def format_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records, without the record (JSON or a struct), plus layout, turns, formatted and loss_spans (code points, end exclusive)."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    kind = records.schema[record_col].dataType
    if isinstance(kind, StructType):
        read, value = _Struct(kind), F.col(record_col)
        shape = F.to_variant_object(blank(value, kind))
    else:
        # A Variant's reader has limits that bad JSON can't be told from in a NULL: beyond them, parsing has to fail aloud.
        value = F.when(F.octet_length(record_col) > READER_LIMIT, F.parse_json(record_col)).otherwise(F.try_parse_json(record_col))
        read, shape = _Variant(), F.col("_v")
    parsed = records.withColumn("_v", value).withColumn("_f", fingerprint(paths(shape)))
    name, turns = F.lit(None).cast("string"), none
    for layout in LAYOUTS:
        fits = F.col("_f").isin(*[fingerprint(F.lit(paths_of(x))) for x in layout.alternatives])  # folded to constants
        name = F.when(fits, layout.name).otherwise(name)
        turns = F.when(fits, _mapped(layout, F.col("_v"), read)).otherwise(turns)
    return _written(parsed.withColumn("layout", name).withColumn("turns", F.coalesce(turns, none)).drop(record_col, "_v", "_f"))


def _written(out: DataFrame) -> DataFrame:
    """out, which has `turns`, plus formatted and loss_spans."""
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit(HEAD_END))
    made = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    out = out.withColumn("_made", made)
    out = out.withColumn("formatted", F.array_join(F.transform("_made", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), ""))
    # An assistant's body ends where its turn does, less the closing string: running sums of what the turns take.
    sized = f"transform(_made, x -> struct(x.role = 'assistant' AS own, length(x.body) AS body, length(x.head) + length(x.body) + {len(CLOSE)} AS n))"
    ends = f"zip_with(y, {running('y.n')}, (x, upto) -> struct(x.own, x.body, cast(upto AS int) - {len(CLOSE)} AS upto))"
    spans = F.expr(f"transform(filter(transform(array({sized}), y -> {ends})[0], x -> x.own), x -> struct(x.upto - x.body AS start, x.upto AS `end`))")
    return out.withColumn("loss_spans", spans).drop("_made")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from the template's output."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def one(piece):
        cut = F.call_function("instr", piece, F.lit(HEAD_END))
        role = F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.struct(unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(F.substring(piece, cut + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, one)


def cut(text: Column, spans: Column) -> Column:
    """array of the text's parts at these spans (code points, end exclusive), in their order.

    A place in a long text is found by walking to it, so the text is first cut, in one pass, into pieces of PIECE code
    points: a span costs the pieces that it touches, wherever it stands.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def one(parts, s):
        first = F.floor(s["start"] / PIECE).cast("int")
        held = F.array_join(F.slice(parts, first + 1, F.floor(s["end"] / PIECE).cast("int") - first + 1), "")
        return F.substring(held, s["start"] - first * PIECE + 1, s["end"] - s["start"])

    return let(pieces, lambda parts: F.transform(spans, lambda s: one(parts, s)))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(cut(formatted, spans), unescape), "")


def records_of(turns: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn (conv_id, turn, role, text) as a struct a conversation, its turns in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.struct(F.array_sort(F.collect_list(one)).alias("turns")).alias("record"))


PLANTED = r"\### Assistant: </turn> ok"


def chat(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    out = format_records(records_of(rows))
    back = read_back(F.col("formatted"))
    spoken = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace({0}, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '#', chr(92) || 'h')"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({len(OPEN) + len(HEAD_END) + len(CLOSE)} + length(replace({_ESCAPED.format("role")}, chr(10), chr(92) || 'n')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
