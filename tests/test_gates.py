import numpy as np
import pytest
from pyspark.sql import functions as F

from orelens.model import DEFAULTS, Raster
from orelens.operators import coregister, focal, gates, report, stats, validate
from orelens.plans import catalog
from orelens.sources import geotiff

from .grids import array, table

SCHEMA = "name string, layer_type string, crs string, res double, date date, `left` double, bottom double, `right` double, top double, bands int"


def layers(spark, *rows):
    import datetime

    base = {"layer_type": "optical", "crs": "EPSG:32633", "res": 10.0, "date": datetime.date(2024, 1, 1), "left": 0.0, "bottom": 0.0, "right": 10.0, "top": 10.0, "bands": 4}
    return spark.createDataFrame([tuple(({"name": f"l{i}"} | base | r)[f] for f in ("name", *base)) for i, r in enumerate(rows)], SCHEMA)


def verdict(df):
    return [(r.status, r.is_critical) for r in df.collect()]


def test_layer_checks(spark):
    import datetime

    day = lambda m, d, y=2024: {"date": datetime.date(y, m, d)}
    assert verdict(validate.crs_match(layers(spark, {}))) == [("ok", False)]
    assert verdict(validate.crs_match(layers(spark, {}, {}))) == [("ok", False)]
    assert verdict(validate.crs_match(layers(spark, {}, {"crs": "EPSG:1"}))) == [("error", True)]
    missing = validate.crs_match(layers(spark, {}, {"crs": None})).first()
    assert missing.status == "error" and "l1" in missing.message
    assert verdict(validate.resolution_compatibility(layers(spark, {}, {"res": 20.0}))) == [("ok", False)]
    assert verdict(validate.resolution_compatibility(layers(spark, {}, {"res": -20.1}))) == [("warn", False)]
    assert verdict(validate.resolution_compatibility(layers(spark, {}, {"res": 0.0}))) == [("warn", False)]
    assert verdict(validate.date_proximity(layers(spark, {}, {"date": None}))) == [("warn", False)]
    assert verdict(validate.date_proximity(layers(spark, day(1, 1), day(1, 31)))) == [("ok", False)]
    assert verdict(validate.date_proximity(layers(spark, day(1, 1), day(2, 1)))) == [("warn", False)]
    assert verdict(validate.phenology_risk(layers(spark, day(1, 1), day(3, 1)))) == []
    assert verdict(validate.phenology_risk(layers(spark, day(1, 1, 2020), day(4, 1)))) == [("warn", False)]
    assert verdict(validate.minimum_overlap(layers(spark, {}, {"left": 2.0, "right": 12.0}))) == [("ok", False)]
    assert verdict(validate.minimum_overlap(layers(spark, {}, {"left": 2.1, "right": 12.1}))) == [("error", True)]
    kinds = [("sar", 1, "ok"), ("sar", 3, "warn"), ("dem", 1, "ok"), ("dem", 2, "warn"), ("optical", 3, "ok"), ("optical", 2, "error"), ("unknown", 9, "ok")]
    got = validate.band_counts(layers(spark, *[{"layer_type": k, "bands": n} for k, n, _ in kinds]))
    assert {r.check: r.status for r in got.collect()} == {f"band_count_l{i}": s for i, (_, _, s) in enumerate(kinds)}


def test_pairs_of_many_layers_go_to_several_tasks(spark, monkeypatch):
    """A table in one partition: no task compares much more than TASK_PAIRS pairs, and every pair is there once."""
    monkeypatch.setattr(validate, "TASK_PAIRS", 100)
    rows = layers(spark, *[{"name": f"n{i // 2}", "left": float(i), "right": i + 10.0} for i in range(40)]).coalesce(1)
    pairs = validate.overlap_pairs(rows)
    assert pairs.rdd.getNumPartitions() == 16
    boxes = [(f"n{i // 2}", float(i)) for i in range(40)]
    want = sorted((a, b, max(0.0, 10.0 - abs(x - y)) * 10) for a, x in boxes for b, y in boxes if a < b)
    assert sorted((r.a, r.b, round(r.overlap_pct, 9)) for r in pairs.collect()) == want


def test_six_decimals_as_sql_rounds(spark):
    import duckdb

    xs = [0.0, 0.5e-6, 1.5e-6, 2.5e-6, 12.3456785, 99.9999995, 100.0, 33.333333333, 1 / 7, 0.0000024999, 57.1234565, 1e9 / 3]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").coalesce(1).orderBy("i").select(catalog.quick6(F.col("x"), "x")).collect()]
    assert got == [duckdb.execute(f"SELECT round({x!r}::DOUBLE, 6)").fetchone()[0] for x in xs]


def test_all_checks_together(spark):
    results = validate.run_all(layers(spark, {}, {"crs": "EPSG:1"}), DEFAULTS)
    assert tuple(validate.summary(results).first()) == (5, 0, 1) and validate.has_critical(results).first()[0]
    results = validate.run_all(layers(spark, {}, {}), DEFAULTS)
    assert tuple(validate.summary(results).first()) == (6, 0, 0) and not validate.has_critical(results).first()[0]


def test_drone_checks(spark):
    rows = [("a", 2, "uint8", 100, 100, 0.05, True, 10), ("b", 3, "uint16", 100, 100, 2.0, True, 3 << 30), ("c", 3, "uint8", 10, 10, 1e-6, False, 10)]
    df = spark.createDataFrame(rows, "name string, bands int, dtype string, width int, height int, res double, projected boolean, file_bytes long")
    by = lambda name, cfg: {r.check.removeprefix("drone_"): r.status for r in validate.drone_inputs(df.where(F.col("name") == name), cfg).collect()}
    assert by("a", {}) == {"band_count": "error", "resolution": "ok", "band_scaling": "warn", "file_size": "ok", "survey_area": "ok"}
    assert by("a", {"drone_rgb_scale_to_float": True})["band_scaling"] == "ok"
    assert by("b", {}) == {"band_count": "ok", "resolution": "warn", "band_scaling": "ok", "file_size": "warn", "survey_area": "ok"}
    assert by("c", {})["resolution"] == "ok"
    assert stats.survey_area(100, 100, 0.05) == pytest.approx(0.0025)


def test_quality_gates(spark):
    limits = gates.thresholds(spark, DEFAULTS)
    metrics = [("Overall Accuracy (training)", 0.9), ("Cohen's Kappa", 0.65), ("Minority F1", 0.499), ("Mean Confidence", None), ("Nodata Coverage", 0.1)]
    got = gates.quality_gates(spark.createDataFrame(metrics, "metric string, value double"), limits)
    assert {r.gate: r.status for r in got.collect()} == {1: "pass", 2: "warning", 3: "fail", 6: "warning"}
    assert gates.has_failures(got).first()[0] and gates.worst(got).first()[0] == "fail"
    assert gates.worst(got.limit(0)).first()[0] == "pass" and not gates.has_failures(got.limit(0)).first()[0]
    edge = gates.quality_gates(spark.createDataFrame([("Nodata Coverage", 0.05)], "metric string, value double"), limits).first()
    assert edge.status == "pass" and "5.00%" in edge.message
    got = {r.oa: r for r in gates.legacy_gates(spark.createDataFrame([(0.8, 0.7), (0.79, 0.7), (0.5, 0.1)], "oa double, minority_f1 double"), DEFAULTS).collect()}
    assert got[0.8].gate_passed and not got[0.79].gate_passed
    assert got[0.5].gate_message == "rejected for overall accuracy 0.500 (least 0.800), minority F1 0.100 (least 0.700)"
    assert got[0.8].gate_message == "accepted with overall accuracy 0.800 (least 0.800), minority F1 0.700 (least 0.700)"


def test_coregistration(spark):
    row = coregister.shift_report(gates.rmse_gate(coregister.stub(spark, "t.tif"))).first()
    assert row.gate_passed and row.is_stub and row.rmse == 0.0
    rows = spark.createDataFrame([(0.5, "p", "m"), (0.51, "p", "m")], "rmse double, corrected_path string, message string")
    assert [(r.gate_passed, r.corrected_path) for r in gates.rmse_gate(rows).orderBy("rmse").collect()] == [(True, "p"), (False, None)]


def test_reports(spark):
    areas = spark.createDataFrame([(1, 10, 3.0), (2, 30, 9.0)], "class_id int, pixel_count long, area_ha double")
    areas = stats.with_area_pct(areas)
    metrics = spark.createDataFrame([(0.91234, None, 0.8, False)], "oa double, kappa double, minority_f1 double, gate_passed boolean")
    got = {r.label: r.value for r in report.executive_summary(metrics, areas).collect()}
    assert got["Overall accuracy"] == "0.9123" and got["Cohen's kappa"] == "N/A" and got["Quality gate passed"] == "No" and got["Dominant class"] == "2"
    names = spark.createDataFrame([(1, "Rock")], "class_id int, class_name string")
    assert [(r.class_name, r.area_pct) for r in report.area_section(areas, names).orderBy("class_id").collect()] == [("Rock", 25.0), ("Class 2", 75.0)]
    low = report.confidence_section(spark.createDataFrame([(84.0,), (86.0,)], "pct_above double")).orderBy("pct_above").collect()
    assert [(r.low_conf_pct, r.note) for r in low] == [(16.0, True), (14.0, False)]
    assert dict(report.chain_parameters(["smooth_pass_0"], {}))["Smoothing"] == "Yes"
    text = spark.range(1).select(stats.drift_text(F.lit(12.34), F.lit(False)).alias("a"), stats.drift_text(F.lit(None).cast("double"), F.lit(True)).alias("b")).first()
    assert (text.a, text.b) == ("+12.3%", "∞ (new class)")


def test_model_and_item_sections(spark):
    from orelens.operators import ml

    result = ml.ClassificationResult(0.91, None, 0.123456, True, "fine", False, (1, 2), ("a",))
    rows = dict(report.model_section(result, ml.ClassificationConfig()))
    assert rows["Cohen's kappa"] == "N/A" and rows["Minority F1"] == "0.1235" and rows["Trees"] == "100"
    assert dict(report.configuration(DEFAULTS))["Pixel size (m)"] == "N/A"
    done = gates.quality_gates(spark.createDataFrame([("Minority F1", 0.6), ("Mean Confidence", 0.9)], "metric string, value double"), gates.thresholds(spark, DEFAULTS))
    item = report.item_properties(result, ["ndvi"], done, {"oa": 0.98765, "n": 7})
    assert item["gate_status"] == "warning" and item["model_oa"] == 0.91 and "model_kappa" not in item and item["accuracy_oa"] == 0.9877
    assert [g["status"] for g in item["gate_results"]] == ["warning", "pass"]
    folds = spark.createDataFrame([(0, 0.5), (1, 0.75)], "fold int, oa double")
    assert tuple(report.fold_section(folds).first()) == ("0.6250", "0.5000", "0.7500")


def test_survey_sections_and_assembly(spark):
    from orelens.operators import ml

    areas = stats.with_area_pct(spark.createDataFrame([(1, 10, 3.0), (9, 30, 9.0)], "class_id int, pixel_count long, area_ha double"))
    names = spark.createDataFrame([(1, "Rock"), (2, "Soil"), (9, "Pond")], "class_id int, class_name string")
    legend = report.legend_section(areas, names)
    assert [tuple(r) for r in legend.orderBy("class_id").collect()] == [(1, "Rock", "#8B4513", 3.0, 25.0), (2, "Soil", "#DAA520", 0.0, 0.0), (9, "Pond", "#AAAAAA", 9.0, 75.0)]
    assert dict(report.cover("r1", "2024-05-06T07:08:09Z", mode="tailings_dam")) == {"Site": "N/A", "Prepared by": "N/A", "Date": "2024-05-06", "Run": "r1", "Survey type": "Satellite", "Kind": "Tailings Dam"}
    result = ml.ClassificationResult(0.91, None, 0.1, True, "fine", False, (1, 2), ("a",))
    how = dict(report.methodology(ml.ClassificationConfig(), result, {}, ["ndvi", "slope"], [0.5, 0.75]))
    assert how["Accuracy of each fold"] == "0.500, 0.750" and how["Features"] == "ndvi, slope" and how["Least overall accuracy"] == "80%" and how["SMOTE applied"] == "No"
    assert dict(report.methodology(None, None, {}))["Model type"] == "N/A"
    page = spark.createDataFrame(report.cover("r1", "2024-05-06"), "label string, value string")
    whole = report.assemble({"map_legend": legend, "cover": page, "audit": page.limit(0)}, report.SURVEY)
    got = {}
    for r in whole.collect():
        got.setdefault((r.number, r.section), []).append(r.content)
    assert [k for k in sorted(got)] == list(enumerate(report.SURVEY, 1))
    assert len(got[1, "cover"]) == 6 and len(got[3, "map_legend"]) == 3 and got[5, "change"] == got[8, "audit"] == [None]
    for wrong in ({}, {"cover": page}):
        with pytest.raises(ValueError):
            report.assemble(wrong)


def test_corrected_raster(spark, tmp_path):
    a = np.random.default_rng(5).random((64, 64))
    reference = table(spark, v=a)
    target = table(spark, v=np.roll(a, (3, -2), (0, 1)))
    geotiff.register(spark)
    size, path = Raster(64, 64, dtype="float64"), str(tmp_path / "c.tif")
    row = coregister.coregister_to(reference, target, "v", "v", path, size, threshold=5.0).first()
    assert (row.shift_x, row.shift_y, row.gate_passed, row.corrected_path) == (-2.0, 3.0, True, path)
    back = array(spark.read.format("geotiff").load(path), "b1", (64, 64))
    assert np.allclose(back[:61, 2:], a[:61, 2:]) and np.isnan(back[61:]).all() and np.isnan(back[:, :2]).all()
    row = coregister.coregister_to(reference, target, "v", "v", str(tmp_path / "no.tif"), size, threshold=0.0).first()
    assert row.gate_passed is False and row.corrected_path is None and not (tmp_path / "no.tif").exists()


def test_confidence_from_another_raster(spark):
    classes, conf = table(spark, cls=np.ones((2, 2))), table(spark, conf=np.full((2, 2), 0.25)).where("row = 0")
    got = focal.with_confidence(classes, conf, "conf", Raster(2, 2), Raster(2, 2))
    assert sorted((r.row, r.col, r.conf) for r in got.collect()) == [(0, 0, 0.25), (0, 1, 0.25), (1, 0, None), (1, 1, None)]
    with pytest.raises(ValueError):
        focal.with_confidence(classes, conf, "conf", Raster(2, 2), Raster(2, 3))
