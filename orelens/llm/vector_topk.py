"""Exact top-k search with vector-approximation files.

Each component becomes floor(1024 x) and then one of CELLS cells of its dimension. A scan of the cells alone bounds
every inner product: with all cells of a dimension equally wide, the bounds of a query and a vector are the product
with the cells' lower corners plus terms that depend on the query only. What can't be among the k best by these
bounds is never looked at again; exact vectors are then read in the order of the bounds, first the k best and
after that only those whose bound reaches the k-th exact score, so the result is certain.

Queries are taken in blocks of QUERY_BLOCK, each sent to the executors for one scan of all cells; the block bounds
what is sent. A task keeps, for each query of the block, the rows whose bound reaches its own k-th. What the tasks
keep isn't gathered by query: the k best bounds are (in two steps, a task's own first), and they then cut what each
task kept. Equal vectors, which no bound can tell apart, are candidates by their smallest ids, as many as can matter.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a row without
vec_id; missing last components count as 0; rows that repeat a vec_id are all candidates, of a query with that id
none is; as a query they count once, with the smallest vector; components beyond 2**53 and scores beyond 64 bits
saturate; fewer than k candidates give all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, settle, small

SCALE = 1024
CELLS = 256
QUERY_BLOCK = 4096
SCAN_ROWS = 1024
#: Candidates a task holds before it drops those that its k-th bound has overtaken.
HELD = 1 << 21
MOST = 1 << 53


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers."""
    v = F.col(vector_col)
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list array, filled up with zeros."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - offsets[:-1][row]] = values
    return out


def grid(numbers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(lowest value, cell width) of each dimension, over all vectors."""
    spread = numbers.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    total = numbers.count()
    rows = {r.d: (min(r.lo, 0), max(r.hi, 0)) if r.n < total else (r.lo, r.hi) for r in spread.collect()}  # one row a dimension
    dims = max(rows, default=-1) + 1
    low = np.array([rows[d][0] for d in range(dims)], np.int64)
    high = np.array([rows[d][1] for d in range(dims)], np.int64)
    return low, (high - low) // CELLS + 1


def approximate(numbers: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(vec_id, v, cells): one byte a dimension."""

    def run(batches):
        for batch in batches:
            cells = ((_matrix(batch.column(1), len(low)) - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in cells], pa.binary())], ["vec_id", "v", "cells"])

    return numbers.mapInArrow(run, "vec_id long, v array<long>, cells binary")


def _overtaken(found: list, best: np.ndarray, gap: np.ndarray) -> tuple:
    q, r, s = (np.concatenate(x) for x in zip(*found))
    live = s >= best[q, 0] - gap[q]
    return q[live], r[live], s[live]


def _scanner(block, low, width, k):
    """Rows (query_id, vec_id, s) that a task can't rule out; s is the product with the cell's lower corner."""

    def run(batches):
        ids, queries, slack = block.value
        if not len(ids):
            return
        by = queries.astype(np.float64)
        gap = np.abs(by) @ (width - 1.0) + slack
        best = np.full((len(ids), k), -np.inf)
        found, held = [], 0
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(low))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(own), SCAN_ROWS):
                s = by @ (low + cells[a : a + SCAN_ROWS] * width).astype(np.float64).T
                here = own[a : a + SCAN_ROWS]
                at = np.minimum(np.searchsorted(ids, here), len(ids) - 1)
                self_ = np.flatnonzero(ids[at] == here)
                s[at[self_], self_] = -np.inf
                both = np.concatenate((best, s), axis=1)
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                q, r = np.nonzero((s >= (best[:, 0] - gap)[:, None]) & (s > -np.inf))
                found.append((q, here[r], s[q, r]))
                held += len(q)
                if held > HELD:
                    found = [_overtaken(found, best, gap)]
                    held = max(len(found[0][0]), HELD // 2)
        if found:
            q, r, s = _overtaken(found, best, gap)
            for a in range(0, len(q), 1 << 16):
                b = a + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[a:b]]), pa.array(r[a:b]), pa.array(s[a:b]), pa.array(gap[q[a:b]])], ["query_id", "vec_id", "s", "gap"])

    return run


def _exact(pairs: DataFrame, numbers: DataFrame, block) -> DataFrame:
    """(query_id, vec_id, score) of the pairs, from the exact vectors."""

    def run(batches):
        ids, queries, _ = block.value
        place = {int(q): i for i, q in enumerate(ids)}
        for batch in batches:
            q = queries[[place[x] for x in batch.column(0).to_pylist()]]
            v = _matrix(batch.column(2), queries.shape[1])
            top = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(1, queries.shape[1])
            if top < 1 << 63:
                score = (q * v).sum(axis=1)
            else:
                score = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in (q.astype(object) * v.astype(object)).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    joined = pairs.select("query_id", "vec_id").join(numbers.select("vec_id", "v"), "vec_id").select("query_id", "vec_id", "v")
    return joined.mapInArrow(run, "query_id long, vec_id long, score long")


def candidates(numbers: DataFrame, k: int) -> DataFrame:
    """numbers without the rows that k others of the same vector keep out of every result.

    A row repeated whole is there k times at most, and of an equal vector's rows the 2 k with the smallest ids: a query
    leaves out those of its own id, k at most, and the k before any further one come first.
    """
    hashed = numbers.withColumn("h", F.xxhash64("v"))
    crowded = settle(hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 2 * k).select("h"))
    if not crowded.limit(1).count():
        return numbers
    few = hashed.join(small(crowded), "h", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).where(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= 2 * k)
    return settle(hashed.join(small(crowded), "h", "left_anti").select("vec_id", "v").unionByName(few.select("vec_id", "v")))


def top_k(vectors: DataFrame, k: int, query_filter: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that passes query_filter (SQL on vec_id) its k best others."""
    spark = vectors.sparkSession
    numbers = settle(integers(vectors, id_col, vector_col))
    low, width = grid(numbers)
    files = settle(approximate(candidates(numbers, k), low, width))
    queries = numbers.where(query_filter).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    queries = settle(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    parts = []
    for b in range(blocks):
        own = queries.where(F.col("block") == b).orderBy("vec_id").toArrow()
        ids = own.column("vec_id").to_numpy()
        matrix = _matrix(own.column("v").combine_chunks(), len(low)) if len(ids) else np.zeros((0, len(low)), np.int64)
        reach = max(int(np.abs(low).max(initial=0)), int(np.abs(low + width * CELLS).max(initial=0)))
        total = int(np.abs(matrix).max(initial=0)) * reach * max(1, len(low))
        slack = 0.0 if total < MOST else float(total) * 2.0**-40  # beyond 2**53 sums are rounded
        block = spark.sparkContext.broadcast((ids, matrix, slack))
        scan = files.select("vec_id", "cells").mapInArrow(_scanner(block, low, width, k), "query_id long, vec_id long, s double, gap double")
        scanned = settle(scan.where("query_id <> vec_id"))
        order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "vec_id")
        top = settle(scanned.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k))
        # These two have a row and k rows a query of the block.
        kth = F.broadcast(top.where(F.col("n") == k).select("query_id", F.col("s").alias("kth")))
        looked_at = F.broadcast(top.select("query_id", "vec_id").distinct())
        first = settle(_exact(top.select("query_id", "vec_id").distinct(), files, block))
        sure = F.broadcast(first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("sure")))
        left = scanned.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("s") >= F.col("kth") - F.col("gap")))
        rest = left.join(looked_at, ["query_id", "vec_id"], "left_anti").join(sure, "query_id", "left").where(F.col("sure").isNull() | (F.col("s") + F.col("gap") >= F.col("sure")))
        scored = first.unionByName(_exact(rest.select("query_id", "vec_id").distinct(), files, block))
        parts.append(settle(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")))
        discard(scanned, top, first)
        block.unpersist()
    return spark.read.schema(parts[0].schema).parquet(*[p._settled_at for p in parts])


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
