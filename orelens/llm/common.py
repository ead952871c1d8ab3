"""What the training-data operators share: the shared scratch folder, size-checked broadcasts, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows a side may have to be broadcast; each caller's rows are of fixed width.
BROADCAST_ROWS = 1_000_000

#: Bytes of an Arrow batch on its way to Python: it stands in the JVM, off its heap, and in the worker, in several forms each.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: White space and words as every operator here counts them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Unset, a temporary folder serves in local mode alone, where one machine does everything.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="orelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: lineage ends here and survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/orelens/{uuid.uuid4().hex}"
    # A column of nothing but NULLs may have no type, which files need.
    if any(kind == "void" for _, kind in df.dtypes):
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in df.dtypes])
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what settle() wrote for these; nothing may read them afterwards."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _give_back() -> None:
    """Memory that is free in this process goes back to the system, as workers live on after a task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by their bytes, however long texts are (unless the session sets
    a size of its own); the worker's free memory goes back when a task ends."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, BATCH_BYTES)

    def and_give_back(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(and_give_back, schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x worked out once: what a lambda names from outside is worked out again at each of its calls."""
    return F.get(F.transform(F.array(x), then), 0)


def running(values: str, width: int = 256) -> str:
    """SQL of an array<bigint>: the sums of an array's values up to and including each.

    An array that grows by one is copied each time, so only `width` sums at a time grow, and the totals of these parts
    alike: n values take about n * width / 2 + (n / width)**2 / 2 steps. SQL text, as plans of nested lambdas are slow to
    build call by call.
    """
    grown = "aggregate({}, struct(0L AS upto, cast(array() AS array<bigint>) AS out), (a, v) -> struct(a.upto + v AS upto, concat(a.out, array(a.upto + v)) AS out), a -> a.out)"
    parts = f"transform(if(size(x) > 0, sequence(0, cast(ceil(size(x) / {width}) AS int) - 1), cast(array() AS array<int>)), c -> {grown.format(f'slice(x, c * {width} + 1, {width})')})"
    sums = f"transform(array(cast({values} AS array<bigint>)), x -> {parts})"
    whole = f"flatten(zip_with(s, {grown.format('transform(s, t -> element_at(t, -1))')}, (p, upto) -> transform(p, v -> v + upto - element_at(p, -1))))"
    return f"transform({sums}, s -> {whole})[0]"


def quoted(text: str) -> str:
    """text as an SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df plus `_number`, from 0 on in this order, which has to be without ties; no task sorts all rows."""
    parts = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    held = {r[0]: r[1] for r in parts.groupBy("_part").count().collect()}  # one row a partition
    before, total = [], 0
    for p in range(max(held, default=-1) + 1):
        before.append(total)
        total += held.get(p, 0)
    start = F.get(F.array(*map(F.lit, before or [0])), F.col("_part")).cast("long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_number", start + place).drop("_part")


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it as long as a column has that name (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def positional(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names of its own can't meet a working column's; toDF(*names) gives them back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 one) over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null is an empty text."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets


def runs_of(offsets: np.ndarray, most: int):
    """(first, end) document numbers of consecutive documents of at most so many bytes together, or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, end
        first = end
