import datetime
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelens.model import Raster
from orelens.operators import sampling
from orelens.sources import audit, export, geotiff, ingest, runs, shapefile
from orelens.streaming import areas

from .grids import array, table

RNG = np.random.default_rng(3)


def described(spark, *files):
    df = spark.createDataFrame(list(files), "filename string, bands int, tags map<string,string>")
    return [(r.sensor, r.layer_type, r.date) for r in ingest.describe(df).collect()]


def test_sensors_types_and_dates(spark):
    d = datetime.date
    got = described(
        spark,
        ("S1A_IW_20240105.tif", 2, {}),
        ("x_s2b_2024-02-30_2024-03-01.tif", 4, {"DATE_ACQUIRED": "2020-01-02"}),
        ("LC09_x.tif", 7, {"SENSING_TIME": "2021-05-06T07:08:09.123456Z"}),
        ("LC07_20241301.tif", 7, {"START_TIME": "soon", "TIFFTAG_DATETIME": "20190203"}),
        ("my_DTM.tif", 1, {}),
        ("scene.tif", 3, {"a": "Height above"}),
        ("scene.tif", 3, {"a": "LANDSAT"}),
        ("scene.tif", 1, {}),
        ("scene_2024-06-07.tif", 4, {"ACQUISITION_DATE": " "}),
        ("scene.tif", 6, {}),
        ("scene.tif", 2, {}),
    )
    assert got == [
        ("Sentinel-1", "sar", d(2024, 1, 5)),
        ("Sentinel-2", "optical", d(2020, 1, 2)),
        ("Landsat 8/9", "optical", d(2021, 5, 6)),
        ("Landsat 7", "optical", d(2019, 2, 3)),
        ("DEM", "dem", None),
        ("DEM", "dem", None),
        ("Landsat (unknown)", "optical", None),
        ("Single-band (SAR or DEM)", "sar", None),
        ("Multispectral RGB/RGBN", "optical", d(2024, 6, 7)),
        ("Multispectral / Hyperspectral", "optical", None),
        ("Unknown", "unknown", None),
    ]


@pytest.mark.parametrize("dtype", ["float32", "uint8", "int16", "float64"])
def test_geotiff_round_trip(spark, tmp_path, dtype):
    geotiff.register(spark)
    a = (RNG.random((3, 70, 50)) * 100).astype(dtype)
    a[0, 3, 4] = 7
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(geotiff.encode(a, x_origin=500000.0, y_origin=5000200.0, res=10.0, epsg=32633, nodata=7, block=32, metadata={"SENSOR": "x"}))
    df = spark.read.format("geotiff").load(path)
    assert df.columns == ["row", "col", "b1", "b2", "b3"] and df.count() == 3500
    want = np.where(a[0] == 7, np.nan, a[0].astype(float))
    assert np.allclose(array(df, "b1", (70, 50)), want, equal_nan=True)
    assert df.where("row >= 40 and row <= 41").count() == 100
    meta = spark.read.format("geotiff_meta").load(path).first()
    assert (meta.crs_epsg, meta.width, meta.height, meta.bands, meta.res, meta.nodata, meta.dtype) == (32633, 50, 70, 3, 10.0, 7.0, dtype)
    assert tuple(meta.bounds) == (500000.0, 4999500.0, 500500.0, 5000200.0) and meta.tags == {"SENSOR": "x"}


def level(path, n):
    """The n-th directory's raster."""
    import io

    raw = bytearray(path.read_bytes())
    for _ in range(n):
        at = int.from_bytes(raw[4:8], "little")
        link = at + 2 + 12 * int.from_bytes(raw[at : at + 2], "little")
        raw[4:8] = raw[link : link + 4]
    f = io.BytesIO(raw)
    head = geotiff.read_header(f)
    return geotiff.read_rows(f, head, 0, head.get(geotiff.HEIGHT))[0]


def test_cog_with_overviews(spark, tmp_path):
    a = RNG.random((40, 40))
    a[0, 0] = np.nan
    raster = Raster(40, 40, 2.0, 100.0, 200.0, 32633)
    geotiff.register(spark)
    geotiff.write_cog(table(spark, v=a), str(tmp_path / "c.tif"), raster)
    back = spark.read.format("geotiff").load(str(tmp_path / "c.tif"))
    assert np.allclose(array(back, "b1", (40, 40)), a, equal_nan=True)
    assert np.allclose(level(tmp_path / "c.tif", 1), np.nanmean(a.reshape(20, 2, 20, 2), axis=(1, 3)))
    assert level(tmp_path / "c.tif", 4).shape == (3, 3)
    geotiff.write_cog(table(spark, v=np.round(a * 5)), str(tmp_path / "k.tif"), raster, classes=True)
    with open(tmp_path / "k.tif", "rb") as f:
        head = geotiff.read_header(f)
    assert head.nodata == -1 and head.dtype == np.dtype("<i2")
    assert (level(tmp_path / "k.tif", 2) == np.where(np.isnan(a), -1, np.round(a * 5))[::4, ::4]).all()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c.tif", "k.tif"]


@pytest.mark.parametrize("form", [geotiff.CLASSIC, geotiff.BIG])
def test_sink_by_tiles(spark, tmp_path, form):
    """Several tiles, ragged edges, two bands, a tile without pixels, pixels outside, and places of 8 bytes."""
    geotiff.register(spark)
    a, b = RNG.random((100, 70)), RNG.random((100, 70))
    a[:32, :32] = b[:32, :32] = np.nan
    df = table(spark, a=a, b=b).where("row >= 32 or col >= 32")
    more = spark.createDataFrame([(100, 3, 1.0, 1.0), (-1, 0, 1.0, 1.0), (5, 70, 1.0, 1.0)], "row int, col int, a double, b double")
    path = str(tmp_path / "t.tif")
    geotiff.write_raster(df.unionByName(more.select(df.columns)), path, Raster(70, 100, 1.0), "float64", factors=(2, 4), block=32, form=form)
    back = spark.read.format("geotiff").load(path)
    assert np.allclose(array(back, "b1", (100, 70)), a, equal_nan=True) and np.allclose(array(back, "b2", (100, 70)), b, equal_nan=True)
    if form is geotiff.CLASSIC:
        half = np.nanmean(a.reshape(50, 2, 35, 2), axis=(1, 3))
        assert np.allclose(level(tmp_path / "t.tif", 1), np.where(np.isnan(half), -9999.0, half))
    with pytest.raises(ValueError):
        geotiff.write_raster(df, path, Raster(70, 100, 1.0), factors=(3,), block=32)
    with pytest.raises(ValueError):
        geotiff.write_raster(df.withColumn("layer", F.lit("x")), path, Raster(70, 100, 1.0))


def test_sink_through_hadoop(spark, tmp_path):
    geotiff.register(spark)
    a = RNG.random((20, 20))
    for _ in range(2):  # the second time over the first
        geotiff.write_raster(table(spark, v=a), (tmp_path / "h.tif").as_uri(), Raster(20, 20, 1.0), "float64")
    assert np.allclose(array(spark.read.format("geotiff").load(str(tmp_path / "h.tif")), "b1", (20, 20)), a)


def test_empty_raster_is_nodata(spark, tmp_path):
    geotiff.register(spark)
    geotiff.write_raster(spark.createDataFrame([], "row int, col int, v double"), str(tmp_path / "e.tif"), Raster(40, 20, 1.0), block=16)
    assert spark.read.format("geotiff").load(str(tmp_path / "e.tif")).where("b1 is null").count() == 800


def test_ingest_files(spark, tmp_path):
    (tmp_path / "S2A_20240102.tif").write_bytes(geotiff.encode(np.zeros((4, 8, 9), "uint8")))
    row = ingest.ingest(spark, tmp_path / "S2A_20240102.tif").first()
    assert (row.sensor, row.layer_type, row.date, row.bands) == ("Sentinel-2", "optical", datetime.date(2024, 1, 2), 4)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.write(tmp_path / "S2A_20240102.tif", "deep/er/S2A_20240102.tif")
    assert ingest.ingest(spark, tmp_path / "z.zip", tmp_path / "out").first().sensor == "Sentinel-2"
    assert (tmp_path / "out" / "S2A_20240102.tif").exists()
    assert [r.name for r in ingest.unzip_tables(spark, str(tmp_path / "*.zip")).collect()] == ["S2A_20240102.tif"]
    with pytest.raises(FileNotFoundError):
        ingest.ingest(spark, tmp_path / "no.tif")
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        ingest.ingest(spark, tmp_path / "a.txt")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("readme.txt", "x")
    with pytest.raises(ValueError):
        ingest.ingest(spark, tmp_path / "e.zip")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "big.tif").write_bytes(b"x" * 100)
    assert ingest.discover(spark, str(tmp_path / "d")).endswith("big.tif")
    (tmp_path / "d" / "my_Stack.tif").write_bytes(b"x")
    assert ingest.discover(spark, str(tmp_path / "d")).endswith("my_Stack.tif")


SQUARES = [[[(0.0, 0.0), (0.0, -10.0), (5.0, -10.0), (5.0, 0.0), (0.0, 0.0)]], [[(5.0, 0.0), (5.0, -10.0), (10.0, -10.0), (10.0, 0.0), (5.0, 0.0)]]]
PRJ = 'PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984"]]'


def test_shapefiles(spark, tmp_path):
    geotiff.register(spark)
    shapefile.write_shapefile(str(tmp_path / "t.shp"), SQUARES, [1, 2], prj=PRJ)
    df = spark.read.format("shapefile").load(str(tmp_path / "t.shp"))
    assert [(r.poly_id, r.class_id, r.crs_epsg, len(r.rings[0])) for r in df.collect()] == [(0, 1, 32633, 5), (1, 2, 32633, 5)]
    assert shapefile.validate(str(tmp_path / "t.shp"), "class_id") == 32633
    f = table(spark, x=RNG.random((10, 10)))
    got = sampling.extract_from_polygons(f, df, ["x"], Raster(10, 10, 1.0, 0.0, 0.0, 32633))
    labels = f.select("row", "col", F.when(F.col("col") < 5, 1).otherwise(2).alias("label"))
    want = sampling.extract_from_labels(f, labels, ["x"])
    assert sorted(map(tuple, got.drop("poly_id").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="column"):
        shapefile.validate(str(tmp_path / "t.shp"), "other")
    shapefile.write_shapefile(str(tmp_path / "u.shp"), SQUARES, [1, 2])
    with pytest.raises(ValueError, match="reference"):
        shapefile.validate(str(tmp_path / "u.shp"), "class_id")
    shapefile.write_shapefile(str(tmp_path / "v.shp"), SQUARES, [1, 1], prj=PRJ)
    with pytest.raises(ValueError, match="classes"):
        shapefile.validate(str(tmp_path / "v.shp"), "class_id")
    with pytest.raises(FileNotFoundError):
        shapefile.validate(str(tmp_path / "w.shp"), "class_id")


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [0, 1], [1, 1], [0, 0]]
    features = [{"type": "Feature", "properties": {"class_id": 3}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"class_id": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}]
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = shapefile.read_geojson(spark, str(tmp_path / "p.json")).collect()
    assert [(r.class_id, len(r.rings)) for r in got] == [(3, 1), (None, 3)]
    assert tuple(got[0].rings[0][1]) == (0.0, 1.0)


def test_audit(spark, tmp_path):
    path = str(tmp_path / "log")
    assert audit.read(spark, path).count() == 0
    audit.log_event(spark, path, "R1", "gate", {"stage": "ingestion", "n": 1}, "passed")
    assert audit.log_config_snapshot(spark, path, "R1", {"a": 1}) and not audit.log_config_snapshot(spark, path, "R1", {"a": 2})
    assert audit.log_config_snapshot(spark, path, "R2", {})
    assert audit.read(spark, path, "R1").count() == 2
    events = json.loads(audit.export(spark, path, "R1", tmp_path / "a.json").read_text())
    assert [e["event_type"] for e in events] == ["gate", "config_snapshot"] and events[0]["decision"] == "passed"
    assert audit.read_json_log(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "bad.json").write_text("{nope")
    assert audit.read_json_log(spark, str(tmp_path / "bad.json")).count() == 0 == audit.read_json_log(spark, str(tmp_path / "none.json")).count()


def test_stac(spark):
    row = ("area.tif", 100, 200, "int16", -1.0, (500000.0, 4998200.0, 501000.0, 5000200.0))
    df = spark.createDataFrame([row], "filename string, width int, height int, dtype string, nodata double, bounds struct<left:double,bottom:double,right:double,top:double>")
    got = export.stac_items(df, "RUN", 32633, {"datetime": "x", "run_id": "no", "gate": "pass"}).first()
    item = json.loads(got.item)
    assert got.id == item["id"] == "RUN_area" and item["properties"]["run_id"] == "RUN" and item["properties"]["gate"] == "pass"
    assert item["properties"]["datetime"] != "x" and item["properties"]["acquired"] == "x"
    assert item["properties"]["proj:shape"] == [200, 100] and item["properties"]["proj:epsg"] == 32633
    ring = item["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and len(ring) == 5 and item["bbox"][0] == pytest.approx(15.0, abs=1e-6)
    plain = json.loads(export.stac_items(df, "RUN", None).first().item)
    assert plain["bbox"] == [500000.0, 4998200.0, 501000.0, 5000200.0]


def test_packages(spark, tmp_path):
    for name in ("a_cog.tif", "b.tif", "x_stac.json", "audit.json"):
        (tmp_path / name).write_bytes(name.encode() * 100)
    files = [tmp_path / n for n in ("b.tif", "a_cog.tif", "x_stac.json", "audit.json")]
    m = export.package_run("R", files, tmp_path / "out")
    assert m.cog_path.name == "a_cog.tif" and m.audit_log_path.name == "audit.json" and m.file_sizes["b.tif"] == 500
    assert sorted(zipfile.ZipFile(m.zip_path).namelist()) == sorted(f.name for f in files)
    sums = {r.filename: (r.bytes, r.sha256) for r in export.checksums(spark, str(tmp_path / "*.tif")).collect()}
    assert sums["b.tif"] == (500, m.file_checksums["b.tif"])
    with pytest.raises(ValueError):
        export.package_run("S", [*files, tmp_path / "missing"], tmp_path / "new")
    assert not (tmp_path / "new").exists() and str(export.find_artifact(files, ".pdf", "x")) == "."


def test_runs(tmp_path):
    run = runs.Run(tmp_path)
    assert len(run.run_id) == 8 and run.run_id == run.run_id.upper()
    assert run.is_unlocked("ingestion") and not run.is_unlocked("export")
    run.unlock("export")
    run.set("k", 1)
    assert run.is_unlocked("export") and run.get("k") == 1 and run.get("x", 2) == 2
    with pytest.raises(ValueError):
        run.unlock("nowhere")
    (run.folder("uploads") / "f").write_text("x")
    fresh = run.renew()
    assert fresh.run_id != run.run_id and not (tmp_path / "uploads" / run.run_id).exists()
    assert runs.Run(tmp_path / "in", run_id="..").cleanup(("x",)) == []
    said, now = [], iter([0.0, 10.0, 130.0])
    p = runs.Progress(lambda *x: said.append(x[2]), lambda: next(now))
    p(1, 4)
    p(4, 4)
    assert said == ["1/4, about 30 s left", "4/4"]


def test_streamed_areas(spark, tmp_path):
    rows = [("l", r, c, r % 2 + 1, 0.5) for r in range(4) for c in range(4)]
    schema = "layer string, row int, col int, cls int, conf double"
    for k in range(2):
        spark.createDataFrame(rows[k * 8 : k * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "tiles"))
    out = areas.running_areas(areas.read_tiles(spark, str(tmp_path / "tiles"), files_per_trigger=1), 10.0)
    q = out.writeStream.outputMode("complete").format("memory").queryName("areas_test").start()
    try:
        q.processAllAvailable()
        got = {r.class_id: (r.pixel_count, r.area_ha) for r in spark.table("areas_test").collect()}
    finally:
        q.stop()
    assert got == {1: (8, pytest.approx(0.08)), 2: (8, pytest.approx(0.08))}
