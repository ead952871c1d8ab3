"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. Sizes are summed by source and the hash's next 12 bits; the
bucket in which a source's running sum crosses its budget is refined by the next 12 bits, and only that bucket, until
it holds one hash. The outcome is one threshold a source, and how many of the rows with just that hash are taken: a
document is taken once more if its hash lies below it. Nothing is sorted, and thresholds nest: a larger budget keeps
what a smaller one took.

Defined cases: a null text has size 0; a null source is a source, the last; a null doc_id hashes as an empty one; rows
with the same id and text share a hash, and if it is the threshold's, so many of them are taken as bring the source
nearest to its target; a source of size 0 has target 0; an empty table gives an empty mix; other columns pass through,
whatever their names. Texts may be of any length. Sources are one row each, numbered without a task that sorts them
all; everything else is by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, discard, numbered, positional, settle, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
LEVEL_BITS, LEVELS = 12, 5
#: Rows of one hash that are numbered in one task.
TIED = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: the same in every engine, and no order that the ids have."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources in order, targets stop at
    MOST times the source's size and the excess is shared again by weight. A round is one sum over the sources."""
    found = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_number") % len(WEIGHTS) + 1).cast("int")).cast("double")
    sources = settle(found.select("source", "source_size", weight.alias("weight")))
    cap = MOST * F.col("source_size").cast("double")
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > cap if capped >= 0 else F.lit(False)
        total, held, open_weight, n = sources.agg(F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == capped or not open_weight:
            break
        level, capped = (SHARE * total - (held or 0)) / open_weight, n
    return sources.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def thresholds(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, edge, part, tied): each document of the source is taken `whole` times, once
    more if its hash is less than `edge`, and so are `part` of the `tied` rows whose hash is `edge`.

    sizes: (source, size, h)."""
    budget = targets(sizes)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    start = {"prefix": F.lit(0).cast("long"), "cell": F.lit(0).cast("long"), "tied": F.lit(0).cast("long"), "edge": F.lit(0).cast("long")}
    state = settle(budget.withColumn("whole", whole).withColumn("rest", rest).withColumns(start))
    same = F.col("source").eqNullSafe(F.col("s"))
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        own = small(state.select(F.col("source").alias("s"), "rest", "prefix").where("rest > 0"))
        inside = sizes.join(own, same).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        cells = inside.groupBy("source", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        at = settle(cells.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))))
        at_ = small(at.select(F.col("source").alias("s"), F.col("bucket").alias("p"), (F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("c"), "rows", "lo", "hi"))
        after = [(F.col("rest") - F.coalesce("before", F.lit(0))).alias("rest"), F.coalesce("p", "prefix").alias("prefix"), F.coalesce("c", "cell").alias("cell"), F.coalesce("rows", "tied").alias("tied"), F.coalesce("lo", "edge").alias("edge")]
        after = settle(state.join(at_, same, "left").select("source", "source_size", "target", "whole", *after, F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)).alias("open")))
        more = after.where("open").limit(1).count()
        discard(state, at)
        state = after
        if not more:
            break
    # Of the rows at the border, all of one size, as many as come nearest to the budget.
    one = F.col("cell") / F.col("tied")
    full = F.floor(F.col("rest") / one)
    part = F.when((F.col("rest") > 0) & (F.col("cell") > 0), full + (2 * (F.col("rest") - full * one) > one).cast("int")).otherwise(0)
    return state.select("source", "source_size", "target", "whole", "edge", part.cast("long").alias("part"), "tied")


def _times(rows: DataFrame, own: DataFrame) -> DataFrame:
    """rows, which have _source and _h, with source_size, target and _times, from the thresholds `own`."""
    joined = rows.join(small(own.withColumnRenamed("source", "_s")), F.col("_source").eqNullSafe(F.col("_s")))
    at_edge = F.col("_h") == F.col("edge")
    times = lambda at: F.least(F.col("whole") + ((F.col("_h") < F.col("edge")) | (at_edge & at)).cast("int"), F.lit(MOST))
    out = [*rows.columns, "source_size", "target"]
    split = own.where("part > 0 and part < tied").agg(F.max("tied")).first()[0]
    if not split:
        return joined.select(*out, times(F.col("part") > 0).alias("_times"))
    # Rows alike beyond telling apart: written down once, they are numbered in parts.
    partial = at_edge & (F.col("part") > 0) & (F.col("part") < F.col("tied"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(split // TIED + 1))
    tied = settle(joined.where(partial).withColumn("_salt", salt).withColumn("_place", F.monotonically_increasing_id()))
    held = tied.groupBy("_s", "_salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_s").orderBy("_salt")) - F.col("n")
    held = small(held.select(F.col("_s").alias("_s2"), F.col("_salt").alias("_salt2"), before.alias("_before")))
    place = F.row_number().over(Window.partitionBy("_s", "_salt").orderBy("_place")) + F.col("_before")
    chosen = tied.join(held, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_salt") == F.col("_salt2"))).withColumn("_place", place)
    plain = joined.where(~partial).select(*out, times(F.col("part") > 0).alias("_times"))
    return plain.unionByName(chosen.select(*out, times(F.col("_place") <= F.col("part")).alias("_times")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken (words, repeats counted) of each row."""
    sizes = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col)).alias("h")))
    rows = sizes.select("doc_id", F.col("source").alias("_source"), "size", F.col("h").alias("_h"))
    return _times(rows, settle(thresholds(sizes))).select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", F.col("_times").alias("times"), (F.col("_times") * F.col("size")).alias("taken"))


def stage(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a document taken twice is there twice."""
    own = {n: F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text", "source")}
    rows = positional(docs).withColumn("_source", own["source"]).withColumn("_h", hash_of(own["doc_id"], own["text"]))
    sizes = settle(rows.select(F.col("_source").alias("source"), size_of(own["text"]).alias("size"), F.col("_h").alias("h")))
    taken = _times(rows, settle(thresholds(sizes))).where("_times > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*positional(docs).columns).toDF(*docs.columns)


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
-- a level k holds the k sources of the smallest size a weight at their cap; the right one is the largest of all
r AS (
  SELECT sum({MOST} * source_size) OVER w AS held, sum(weight) OVER w AS gone FROM s
  WINDOW w AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT {SHARE} * sum(source_size) AS total, sum(weight) AS weights FROM s),
level AS (
  SELECT max(level) AS level FROM (
    SELECT total / weights AS level FROM t UNION ALL SELECT (total - held) / (weights - gone) FROM r, t WHERE weights > gone)),
g AS (SELECT source, source_size, least(CAST({MOST} * source_size AS DOUBLE), weight * level) AS target FROM s, level),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({MOST}, floor(target / source_size)) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN least({MOST}, floor(target / source_size)) ELSE 0 END * source_size AS rest FROM g),
c AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS cell,
         count(*) OVER (PARTITION BY d.source, h) AS tied, row_number() OVER (PARTITION BY d.source, h) AS place
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, rest - (upto - cell) AS r, cell / tied AS one, floor((rest - (upto - cell)) / nullif(cell / tied, 0)) AS whole_rows FROM c)
SELECT doc_id, size, source_size, target,
       CAST(size * least({MOST}, whole + CASE WHEN r <= 0 THEN 0 WHEN r > cell OR place <= whole_rows + CAST(2 * (r - whole_rows * one) > one AS INTEGER) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
