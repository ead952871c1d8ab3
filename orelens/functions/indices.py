"""Per-pixel projections: spectral, colour and radar indices as Column expressions.

Every ratio goes through try_divide: NULL operands and zero denominators give NULL, as no other invalid value
gets past the source.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Largest value of each pixel type, to which corrected values are clipped.
DTYPE_MAX = {"uint8": 255.0, "uint16": 65535.0, "uint32": 4294967295.0, "int16": 32767.0, "int32": 2147483647.0}


def safe_ratio(a: Column, b: Column, fill: float | None = None) -> Column:
    ratio = F.try_divide(a, b)
    return ratio if fill is None else F.coalesce(ratio, F.lit(fill))


def normalized_difference(a: Column, b: Column) -> Column:
    return safe_ratio(a - b, a + b)


def ndvi(nir, red):
    return normalized_difference(nir, red)


def ndwi(green, nir):
    return normalized_difference(green, nir)


def ndre(rededge, red):
    return normalized_difference(rededge, red)


def mndwi(green, swir):
    return normalized_difference(green, swir)


def bsi(swir, red, nir, blue):
    return normalized_difference(swir + red, nir + blue)


def vari(green, red, blue):
    return safe_ratio(green - red, green + red - blue)


def iron_oxide(red, blue):
    return safe_ratio(red, blue)


def clay_index(swir, nir):
    return safe_ratio(swir, nir)


def ferrous(nir, swir):
    return safe_ratio(nir, swir)


def exg(green, red, blue):
    return 2.0 * green - red - blue


def exr(red, green):
    return 1.4 * red - green


def brightness(red, green, blue):
    return (red + green + blue) / 3.0


def _known(*bands: Column) -> Column:
    known = bands[0].isNotNull()
    for b in bands[1:]:
        known = known & b.isNotNull()
    return known


def hue(red, green, blue):
    """HSV hue in [0, 1): sectors are tried blue first, so that a tie takes the later channel's formula; grey is 0."""
    high, low = F.greatest(red, green, blue), F.least(red, green, blue)
    spread = high - low
    sector = F.when(high == blue, 60.0 * (red - green) / spread + 240.0).when(high == green, 60.0 * (blue - red) / spread + 120.0).otherwise(60.0 * (green - blue) / spread)
    angle = F.when(spread > 1e-9, F.pmod(sector, F.lit(360.0)) / 360.0).otherwise(0.0)
    return F.when(_known(red, green, blue), angle)


def saturation(red, green, blue):
    high, low = F.greatest(red, green, blue), F.least(red, green, blue)
    return F.when(_known(red, green, blue), F.when(high > 1e-9, (high - low) / high).otherwise(0.0))


def sar_ratio(vv, vh, decibel: bool = False):
    ratio = safe_ratio(vv, vh)
    return F.when(ratio > 0, 10.0 * F.log10(ratio)) if decibel else ratio


def scale_uint8(band):
    """Bytes to [0, 1]; nodata is NULL before that, so no sentinel gets scaled."""
    return band / 255.0


def subtract_dark(value, dark, dtype: str | None = None):
    """Dark-object subtraction, clipped to [0, the type's largest value]."""
    raised = F.greatest(value - dark, F.lit(0.0))
    clipped = F.least(raised, F.lit(DTYPE_MAX[dtype])) if dtype in DTYPE_MAX else raised
    return F.when(value.isNotNull() & dark.isNotNull(), clipped)


def hectares(count, res: float):
    return count * (res * res / 10000.0)


def overlap_pct(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller box's area, in percent; boxes have left, bottom, right and top."""
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"], b["top"]) - F.greatest(a["bottom"], b["bottom"])
    area = lambda x: (x["right"] - x["left"]) * (x["top"] - x["bottom"])
    smaller = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (smaller > 0), 100.0 * w * h / smaller).otherwise(0.0)


#: name: (function, band roles in the order of its arguments)
INDICES = {
    "ndvi": (ndvi, ("nir", "red")),
    "ndwi": (ndwi, ("green", "nir")),
    "bsi": (bsi, ("swir", "red", "nir", "blue")),
    "ndre": (ndre, ("rededge", "red")),
    "vari": (vari, ("green", "red", "blue")),
    "sar_ratio": (sar_ratio, ("vv", "vh")),
    "iron_oxide": (iron_oxide, ("red", "blue")),
    "clay_index": (clay_index, ("swir", "nir")),
    "ferrous": (ferrous, ("nir", "swir")),
    "mndwi": (mndwi, ("green", "swir")),
    "exg": (exg, ("green", "red", "blue")),
    "exr": (exr, ("red", "green")),
    "brightness": (brightness, ("red", "green", "blue")),
    "hue": (hue, ("red", "green", "blue")),
    "saturation": (saturation, ("red", "green", "blue")),
}

#: The same for SQL users, as session functions; the text is Spark SQL.
SQL_FUNCTIONS = {
    "ndvi": ("nir DOUBLE, red DOUBLE", "try_divide(nir - red, nir + red)"),
    "ndwi": ("green DOUBLE, nir DOUBLE", "try_divide(green - nir, green + nir)"),
    "ndre": ("rededge DOUBLE, red DOUBLE", "try_divide(rededge - red, rededge + red)"),
    "mndwi": ("green DOUBLE, swir DOUBLE", "try_divide(green - swir, green + swir)"),
    "bsi": ("swir DOUBLE, red DOUBLE, nir DOUBLE, blue DOUBLE", "try_divide((swir + red) - (nir + blue), (swir + red) + (nir + blue))"),
    "vari": ("green DOUBLE, red DOUBLE, blue DOUBLE", "try_divide(green - red, green + red - blue)"),
    "iron_oxide": ("red DOUBLE, blue DOUBLE", "try_divide(red, blue)"),
    "clay_index": ("swir DOUBLE, nir DOUBLE", "try_divide(swir, nir)"),
    "ferrous": ("nir DOUBLE, swir DOUBLE", "try_divide(nir, swir)"),
    "exg": ("green DOUBLE, red DOUBLE, blue DOUBLE", "2.0D * green - red - blue"),
    "exr": ("red DOUBLE, green DOUBLE", "1.4D * red - green"),
    "brightness": ("red DOUBLE, green DOUBLE, blue DOUBLE", "(red + green + blue) / 3.0D"),
    "sar_ratio": ("vv DOUBLE, vh DOUBLE", "try_divide(vv, vh)"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """CREATE TEMPORARY FUNCTION for each index, so that SQL text can say ndvi(nir, red)."""
    for name, (arguments, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
