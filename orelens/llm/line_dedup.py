"""Boilerplate lines by site-relative frequency.

Pages are grouped by host; a line's share is the number of the host's pages that contain it over the host's
pages, and lines above `ratio` are dropped from every page of that host. Counts are partial sums over
(host, 128 bits of line hash), so a host with a third of all rows is no hot group. A host's boilerplate lines
become one hash table, an array of buckets, in which each line of its pages is looked up at once; the table has
fewer than (mean distinct lines of the host's pages) / ratio entries, however many pages there are.

Defined cases: a null host is a host of its own; a null text stays null and counts as a page without lines; blank
lines are never boilerplate; a line needs `min_pages` pages to be boilerplate, so small sites and repeated rows of
a page or two lose nothing; a page of nothing but boilerplate keeps its blank lines alone, or all of its text with
`keep_whole_pages`; texts and lines may be of any length; an empty table gives an empty result; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, positional, settle, small

#: A line on more than one of 20 pages of a site is part of the site, not of the page: a menu or footer stands on a
#: large share of the pages, a sentence that several pages quote on a few in a thousand.
RATIO = 0.05
MIN_PAGES = 5
SALTS = 16


def host_of(url: Column) -> Column:
    """The host of a url, A-Z lower-cased; null without "://"."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, a, b): each host's boilerplate lines, by two hashes."""
    lines = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).where(~_blank(F.col("line")))
    counts = lines.select("host", _key(F.col("line")).alias("k")).groupBy("host", "k.a", "k.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = settle(pages.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("pages")))
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        common = counts.join(F.broadcast(totals), F.col("host").eqNullSafe(F.col("h")))
    else:  # a host of many lines is dealt over several tasks
        salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        common = counts.join(salted, F.col("host").eqNullSafe(F.col("h")) & (F.pmod("a", F.lit(SALTS)) == F.col("_salt")))
    return common.where(F.col("n") > ratio * F.col("pages")).select("host", "a", "b")


def tables(found: DataFrame) -> DataFrame:
    """(host, slots, table): each host's lines in as many buckets as it has lines; table[pmod(a, slots)] holds (a, b)."""
    hosts = found.groupBy("host").agg(F.count("*").alias("slots"))
    slots = hosts.select(F.col("host").alias("h"), "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    sized = found.join(small(hosts.withColumnRenamed("host", "h")), F.col("host").eqNullSafe(F.col("h"))).groupBy("host", F.pmod("a", F.col("slots")).alias("at")).agg(F.collect_list(F.struct("a", "b")).alias("lines"))
    every = slots.join(sized, F.col("h").eqNullSafe(F.col("host")) & (F.col("slot") == F.col("at")), "left").groupBy("h", "slots").agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("lines", F.array()).alias("lines")))).alias("t"))
    return every.select(F.col("h").alias("host"), "slots", F.col("t.lines").alias("table"))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True, keep_whole_pages: bool = False) -> DataFrame:
    """pages with `text` cleaned and, with `counts`, two more columns: n_lines and n_dropped (long), with underscores
    after their names where pages has such columns."""
    names = pages.columns
    rows = positional(pages)
    host, text = f"c{names.index(host)}", f"c{names.index(text)}"
    found = settle(boilerplate(rows, host, text, ratio, min_pages))
    held = settle(tables(found)).withColumnRenamed("host", "_host")
    same = F.col(host).eqNullSafe(F.col("_host"))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # of two hashes and a host each
        joined = rows.join(F.broadcast(held), same, "left")
    else:
        salted = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
        joined = rows.withColumn("_own", own).join(salted, same & (F.col("_own") == F.col("_salt")), "left")
    joined = joined.withColumn("_lines", F.split(text, "\n"))
    common = lambda x: F.array_contains(F.get("table", F.pmod(F.xxhash64(x), F.col("slots"))), _key(x))
    joined = joined.withColumn("_kept", F.when(F.col("slots").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: _blank(x) | ~common(x))))
    if keep_whole_pages:
        joined = joined.withColumn("_kept", F.when(F.exists("_kept", lambda x: ~_blank(x)), F.col("_kept")).otherwise(F.col("_lines")))
    n_lines = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_dropped = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    cleaned = [F.array_join("_kept", "\n") if c == text else F.col(c) for c in rows.columns]
    more = [free_name("n_lines", names), free_name("n_dropped", names)] if counts else []
    return joined.select(*cleaned, *[n_lines, n_dropped][: len(more)]).toDF(*names, *more)


def stage(docs: DataFrame) -> DataFrame:
    """docs without their sources' boilerplate lines. A document that is nothing else keeps its text: it is a copy of
    others, and near-duplicate removal keeps one of them, which a text without lines would prevent."""
    return drop_boilerplate(docs, "source", "text", counts=False, keep_whole_pages=True)


def oracle(table: str, key: str, host: str, text: str) -> str:
    return f"""
WITH pages AS (SELECT row_number() OVER () AS rid, {key}, {host} AS host, string_split({text}, chr(10)) AS ls, {text} AS body FROM {table}),
lines AS (SELECT rid, host, unnest(list_distinct(ls)) AS line FROM pages),
totals AS (SELECT host, count(*) AS n FROM pages GROUP BY host),
common AS (
  SELECT lines.host, line FROM lines JOIN totals ON lines.host IS NOT DISTINCT FROM totals.host
  WHERE trim(line) <> '' GROUP BY lines.host, line, totals.n HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * totals.n),
placed AS (SELECT rid, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM pages),
judged AS (
  SELECT rid, pos, placed.line, common.line IS NOT NULL AS drop FROM placed
  LEFT JOIN common ON placed.line = common.line AND placed.host IS NOT DISTINCT FROM common.host),
cleaned AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '') AS kept FROM judged GROUP BY rid)
SELECT {key}, kept AS {text}, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM pages LEFT JOIN cleaned USING (rid)
"""


ORACLE = oracle("documents", "doc_id", "source", "text")
_HOST_SQL = "CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"
ORACLE_PAGES = oracle("pages", "page_id", _HOST_SQL, "html")
