"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns give the base spans (assign, access, hex). The battery looks at every other run of 20 or more characters
of the base64 alphabets that mixes digits, capitals and small letters in some way (or is base32), infers the run's
encoding (hex, base32, base36, base62 or base64) and tests it as a draw of uniform symbols: chi-squared of the symbol
counts, runs above and below the alphabet's middle, and serial correlation. A run that one of the three rejects is no
random key. The others' statistics are then combined into one e-value against ordinary text, the product of three
likelihood ratios: equal pairs of symbols (what chi-squared counts) at the uniform rate or at that of text, and normal
scores of runs and serial correlation as random symbols spread them or TEXT_SPREAD times as wide. How much evidence a
run can give depends on its length and alphabet. The e-values go through the e-value form of Benjamini and Hochberg's
procedure (which holds under any dependence) within each stratum of encoding and length class, from a histogram of
their logarithms over all texts: short runs must be rarer among their like than long ones.

All of it is DataFrame expressions; what leaves the executors for the thresholds is one row a stratum, of which
there are at most ENCODINGS times LENGTHS.

Defined cases: a null text is empty; a text without spans has the digest of the empty string; spans are in code
points, end exclusive; a text may be as long as a string can be, the work grows in proportion to it and its
matches; rows that repeat are scanned alike (and count as often in the histogram); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, running, settle

KINDS = ("assign", "access", "hex", "random")
#: Letters in either case are spelt out, as engines differ on which letters fold.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE, ACCESS, HEX = 6, r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Two kinds of symbols, or base32; and the base spans that consist of a token's characters.
MIXED = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[A-Z].*[a-z]|[a-z].*[A-Z]|^[A-Z2-7]+$"
HELD = f"{ACCESS}|{HEX}"
ENCODINGS, LENGTHS = 5, 12
#: Chance that a random run fails one of the three tests, and the false-discovery rate.
FAIL, RATE = 0.001, 0.01
#: Collision rate of text, and how many times the uniform rate it is at least taken to be.
TEXT_COLLISIONS, TIMES_UNIFORM = 0.065, 2.0
#: How many times as wide text spreads the scores of runs and of serial correlation.
TEXT_SPREAD = 3.0
#: Histogram bins: tenths of a decade of the e-value.
BINS = 300


def matches(text: str, pattern: str) -> Column:
    """array<struct<start, end, m>> of a pattern's leftmost non-overlapping matches in a column, in code points.

    A pattern that can't match the empty string cuts the text into pieces around its matches, whose lengths add
    up to the places.
    """
    cut = f"zip_with(regexp_extract_all({text}, {quoted(pattern)}, 0), split({text}, {quoted(pattern)}, -1), (m, g) -> struct(m, length(g) + length(m) AS n))"
    sized = f"filter({cut}, x -> x.m IS NOT NULL)"
    spans = f"zip_with(y, {running('y.n')}, (x, upto) -> struct(cast(upto AS int) - length(x.m) AS start, cast(upto AS int) AS `end`, x.m AS m))"
    return F.expr(f"if({text} RLIKE {quoted(pattern)}, transform(array({sized}), y -> {spans})[0], cast(array() AS array<struct<start:int,`end`:int,m:string>>))")


def apart(rows: DataFrame, tokens: str, others: str) -> DataFrame:
    """rows with the column `tokens` less those that overlap one of `others`; both are arrays of spans in order.

    A token overlaps one if more of them begin before its end than end by its start: running counts over all ends in order.
    """
    at = lambda spans, which, kind: f"transform({spans}, x -> struct(x.`{which}` AS at, {kind} AS kind))"
    events = f"transform(array_sort(concat({at(others, 'end', 0)}, {at(tokens, 'start', 1)}, {at(tokens, 'end', 2)}, {at(others, 'start', 3)})), x -> x.kind)"
    count = lambda kind: running(f"transform(e, x -> if(x = {kind}, 1, 0))")
    pick = lambda kind, n: f"filter(zip_with(e, {n}, (kind, n) -> if(kind = {kind}, n, NULL)), x -> x IS NOT NULL)"
    overlap = f"transform(array({events}), e -> zip_with({pick(1, count(0))}, {pick(2, count(3))}, (ended, begun) -> ended <> begun))[0]"
    kept = f"transform(filter(zip_with({tokens}, {overlap}, (t, o) -> struct(t, o)), x -> NOT x.o), x -> x.t)"
    return rows.withColumn(tokens, F.expr(f"if(size({tokens}) > 0 AND size({others}) > 0, {kept}, {tokens})"))


def _encoding(token: Column) -> Column:
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0).when(token.rlike("^[A-Z2-7]+$"), 1).when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 2).when(token.rlike("^[A-Za-z0-9]+$"), 3).otherwise(4)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a published logistic approximation (error below 0.0002)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _spread_odds(z: Column) -> Column:
    """Log-likelihood ratio of a score: standard normal against one TEXT_SPREAD times as wide."""
    return F.lit(math.log(TEXT_SPREAD)) - z * z * ((1 - TEXT_SPREAD**-2) / 2)


def battery(token: Column) -> Column:
    """struct<stratum, bin, random>: the stratum of encoding and length class, the histogram bin of the three tests'
    e-value against text, and whether none of them rejects randomness."""
    encoding = _encoding(token)
    size = F.when(encoding == 0, 16.0).when(encoding == 1, 32.0).when(encoding == 2, 36.0).when(encoding == 3, 62.0).otherwise(64.0)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabet = F.when(encoding == 0, F.lit(digits + "abcdef")).when(encoding == 1, F.lit(upper + "234567")).when(encoding == 2, F.lit(digits + lower)).when(encoding == 3, F.lit(upper + lower + digits)).otherwise(F.lit(upper + lower + digits + "+/"))
    plain = F.when(encoding.isin(0, 2), F.lower(token)).when(encoding == 4, F.translate(token, "-_", "+/")).otherwise(token)
    made = F.array(F.struct(encoding.alias("e"), size.alias("k"), alphabet.alias("a"), plain.alias("t"), F.length(token).cast("double").alias("n")))

    def sums(x):
        chars = F.filter(F.split(x["t"], ""), lambda c: c != "")
        middle = (x["k"] - 1) / 2
        values = F.transform(chars, lambda c: F.call_function("instr", x["a"], c).cast("double") - 1 - middle)
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow((x["n"] - F.length(F.replace(x["t"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        return F.struct(x["e"].alias("e"), x["k"].alias("k"), x["n"].alias("n"), squares.alias("squares"), values.alias("v"))

    def walks(x):
        after = F.sequence(F.lit(1), F.size(x["v"]) - 1)
        at = lambda i: F.get(x["v"], i)
        runs = F.aggregate(after, F.lit(1.0), lambda acc, i: acc + F.when((at(i) > 0) != (at(i - 1) > 0), 1.0).otherwise(0.0))
        above = F.aggregate(x["v"], F.lit(0.0), lambda acc, v: acc + F.when(v > 0, 1.0).otherwise(0.0))
        lag = F.aggregate(after, F.lit(0.0), lambda acc, i: acc + at(i) * at(i - 1))
        return F.struct(x["e"].alias("e"), x["k"].alias("k"), x["n"].alias("n"), x["squares"].alias("squares"), runs.alias("runs"), above.alias("above"), lag.alias("lag"))

    def judge(x):
        k, n = x["k"], x["n"]
        freedom = k - 1
        chi = k / n * x["squares"] - n
        # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is near normal.
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        below = n - x["above"]
        mean = 1 + 2 * x["above"] * below / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, F.abs(x["runs"] - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(99.0)
        # Products of neighbours have mean 0 and the square of a uniform symbol's variance.
        variance = (k * k - 1) / 12
        z_lag = F.abs(x["lag"]) / (variance * F.sqrt(n - 1))
        random = (normal_tail(z_chi) >= FAIL) & (2 * normal_tail(F.least(z_runs, F.lit(9.0))) >= FAIL) & (2 * normal_tail(F.least(z_lag, F.lit(9.0))) >= FAIL)
        pairs = n * (n - 1) / 2
        of_text = F.greatest(F.lit(TEXT_COLLISIONS), TIMES_UNIFORM / k)
        equal = (x["squares"] - n) / 2
        odds = pairs * (of_text - 1 / k) - equal * F.log(k * of_text) + _spread_odds(z_runs) + _spread_odds(z_lag)
        evidence = F.floor(odds * (10 / math.log(10)))
        length_class = F.least(F.floor(F.log2(n / 20) * 2), F.lit(LENGTHS - 1))
        return F.struct((x["e"] * LENGTHS + length_class).cast("int").alias("stratum"), F.greatest(F.least(evidence, F.lit(BINS - 1)), F.lit(0)).cast("int").alias("bin"), random.alias("random"))

    return F.get(F.transform(F.transform(F.transform(made, sums), walks), judge), 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, random): base spans and the battery's, each array<struct<start, rank, end>> in order."""
    ranked = lambda rank: lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("assign", F.filter(matches("text", ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], "^" + ASSIGN, 2)) >= ASSIGN_VALUE))
    # Hex and access spans are runs of a token's own characters, so a token that overlaps one holds it whole.
    rows = rows.withColumn("tokens", F.filter(matches("text", TOKEN), lambda x: x["m"].rlike(MIXED) & ~x["m"].rlike(HELD)))
    base = F.concat(F.transform("assign", ranked(0)), F.transform(matches("text", ACCESS), ranked(1)), F.transform(matches("text", HEX), ranked(2)))
    judged = F.transform("tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["m"]).alias("j")))
    seen = settle(apart(rows, "tokens", "assign").select("doc_id", F.array_sort(base).alias("base"), judged.alias("tokens")))
    counts = seen.select(F.explode("tokens.j").alias("j")).groupBy("j.stratum", "j.bin").agg(F.count("*").alias("n"))
    limits = {r.stratum: r.least for r in discoveries(counts).collect()}  # one row a stratum
    table = F.array(*[F.lit(limits.get(i, BINS)) for i in range(ENCODINGS * LENGTHS)])
    secret = F.filter("tokens", lambda x: x["j"]["random"] & (x["j"]["bin"] >= F.get(table, x["j"]["stratum"])))
    return seen.select("doc_id", "base", F.transform(secret, ranked(3)).alias("random"))


def discoveries(counts: DataFrame) -> DataFrame:
    """(stratum, least): the lowest bin at which the procedure's bound still holds, from (stratum, bin, n).

    With N runs in the stratum and R of them in bin b or above, all with e-values of 10**(b/10) at least, it holds if
    10**(b/10) >= N / (RATE * R).
    """
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("stratum", "bin", F.sum("n").over(down).alias("found"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    held = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") <= RATE * F.col("found")
    return ranked.where(held).groupBy("stratum").agg(F.min("bin").alias("least"))


def spell(spans: Column) -> Column:
    kind = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["rank"])
    return F.array_join(F.transform(spans, lambda x: F.concat(kind(x), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan(docs, id_col, text_col)
    of = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    every = F.array_sort(F.concat("base", "random"))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(every).alias("spans"), F.size("random").cast("long").alias("n_random"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_matches(name: str, pattern: str, rank: int) -> str:
    """SQL of (rid, rank, pos, m, start, end) of a pattern's matches."""
    return f"""{name}_m AS (
  SELECT rid, unnest(regexp_extract_all(t, {_sql(pattern)})) AS m, unnest(list_slice(string_split_regex(t, {_sql(pattern)}), 1, len(regexp_extract_all(t, {_sql(pattern)})))) AS g,
         generate_subscripts(regexp_extract_all(t, {_sql(pattern)}), 1) AS pos FROM d),
{name} AS (
  SELECT rid, {rank} AS rank, pos, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY pos) - length(m) AS s, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY pos) AS e FROM {name}_m)"""


_TAIL_SQL = "(1 / (1 + exp(1.5976 * {0} + 0.07056 * {0} * {0} * {0})))"
_ODDS_SQL = f"({math.log(TEXT_SPREAD)!r}::DOUBLE - {{0}} * {{0}} * {(1 - TEXT_SPREAD**-2) / 2!r}::DOUBLE)"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_matches("assign0", ASSIGN, 0)}, {_sql_matches("access0", ACCESS, 1)}, {_sql_matches("hex0", HEX, 2)}, {_sql_matches("token0", TOKEN, 3)},
base AS (
  SELECT rid, rank, s, e FROM assign0 WHERE length(regexp_extract(m, {_sql("^" + ASSIGN)}, 2)) >= {ASSIGN_VALUE}
  UNION ALL SELECT rid, rank, s, e FROM access0 UNION ALL SELECT rid, rank, s, e FROM hex0),
tok AS (
  SELECT rid, pos, s, e, m, length(m) AS n,
         CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN 0 WHEN regexp_matches(m, '^[A-Z2-7]+$') THEN 1 WHEN regexp_matches(m, '^([a-z0-9]+|[A-Z0-9]+)$') THEN 2 WHEN regexp_matches(m, '^[A-Za-z0-9]+$') THEN 3 ELSE 4 END AS enc
  FROM token0 WHERE regexp_matches(m, '{MIXED}') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = token0.rid AND b.s < token0.e AND token0.s < b.e)),
enc AS (
  SELECT *, [16.0, 32.0, 36.0, 62.0, 64.0][enc + 1]::DOUBLE AS k, CASE WHEN enc IN (0, 2) THEN lower(m) WHEN enc = 4 THEN translate(m, '-_', '+/') ELSE m END AS plain,
         ['{_DIGITS}abcdef', '{_UPPER}234567', '{_DIGITS}{_LOWER}', '{_UPPER}{_LOWER}{_DIGITS}', '{_UPPER}{_LOWER}{_DIGITS}+/'][enc + 1] AS abc FROM tok),
ch AS (SELECT rid, pos, i, substr(plain, i, 1) AS c, strpos(abc, substr(plain, i, 1)) - 1 - (k - 1) / 2 AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM enc)),
sq AS (SELECT rid, pos, sum(q * q)::DOUBLE AS squares FROM (SELECT rid, pos, c, count(*) AS q FROM ch GROUP BY ALL) GROUP BY ALL),
wk AS (
  SELECT rid, pos, 1.0 + count(*) FILTER (was IS NOT NULL AND (v > 0) <> (was > 0)) AS runs, count(*) FILTER (v > 0)::DOUBLE AS above, coalesce(sum(v * was), 0) AS lag
  FROM (SELECT rid, pos, v, lag(v) OVER (PARTITION BY rid, pos ORDER BY i) AS was FROM ch) GROUP BY ALL),
z AS (
  SELECT *, (pow(greatest(k / n * squares - n, 0) / (k - 1), 1 / 3.0::DOUBLE) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z_chi,
         1 + 2 * above * (n - above) / n AS mean, abs(lag) / ((k * k - 1) / 12 * sqrt(n - 1)) AS z_lag, n * (n - 1) / 2.0 AS pairs, greatest({TEXT_COLLISIONS}, {TIMES_UNIFORM} / k) AS of_text, (squares - n) / 2 AS equal
  FROM enc JOIN sq USING (rid, pos) JOIN wk USING (rid, pos)),
y0 AS (
  SELECT *, (mean - 1) * (mean - 2) / (n - 1) AS spread, least(floor(log2(n / 20.0) * 2), {LENGTHS - 1}) AS cls FROM z),
y AS (SELECT *, CASE WHEN spread > 0 THEN abs(runs - mean) / sqrt(greatest(spread, 1e-9)) ELSE 99 END AS z_runs FROM y0),
x AS (
  SELECT rid, s, e, enc * {LENGTHS} + cls AS stratum,
         {_TAIL_SQL.format("z_chi")} >= {FAIL} AND 2 * {_TAIL_SQL.format("least(z_runs, 9)")} >= {FAIL} AND 2 * {_TAIL_SQL.format("least(z_lag, 9)")} >= {FAIL} AS random,
         greatest(least(floor((pairs * (of_text - 1 / k) - equal * ln(k * of_text) + {_ODDS_SQL.format("z_runs")} + {_ODDS_SQL.format("z_lag")}) * {10 / math.log(10)!r}::DOUBLE), {BINS - 1}), 0) AS bin FROM y),
bh AS (
  SELECT stratum, min(bin) AS least FROM (
    SELECT stratum, bin, sum(count(*)) OVER (PARTITION BY stratum ORDER BY bin DESC) AS found, sum(count(*)) OVER (PARTITION BY stratum) AS every FROM x GROUP BY stratum, bin)
  WHERE pow(10, -bin / 10) * every <= {RATE} * found GROUP BY stratum),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT x.rid, 3, x.s, x.e FROM x JOIN bh USING (stratum) WHERE random AND bin >= least),
told AS (SELECT rid, rank, s, e, {list(KINDS)}[rank + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM spans)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans, count(*) FILTER (rank = 3) AS n_random
FROM d LEFT JOIN told USING (rid) GROUP BY rid
"""
