"""NumPy arrays as pixel tables and back."""

import numpy as np


def table(spark, **bands):
    first = next(iter(bands.values()))
    h, w = first.shape
    rows = [(r, c, *[None if not np.isfinite(b[r, c]) else float(b[r, c]) for b in bands.values()]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{n} double" for n in bands))


def class_table(spark, cls, **more):
    """Class -1 becomes NULL."""
    df = table(spark, cls=np.where(cls < 0, np.nan, cls), **more)
    return df.withColumn("cls", df.cls.cast("int"))


def array(df, value, shape, fill=np.nan):
    out = np.full(shape, fill, float)
    for r in df.select("row", "col", value).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out
