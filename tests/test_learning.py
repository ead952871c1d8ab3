import numpy as np
import pytest
from pyspark.sql import functions as F

from orelens.model import DEFAULTS, Raster
from orelens.operators import accuracy, ml, sampling, synthetic, workflow
from orelens.plans.catalog import _POLYGONS

from .grids import array, table

RNG = np.random.default_rng(7)


def pairs(spark, rows):
    return accuracy.confusion(spark.createDataFrame(rows, "t int, p int"), "t", "p")


def test_metrics(spark):
    conf = pairs(spark, [(1, 1)] * 40 + [(1, 2)] * 10 + [(2, 2)] * 30 + [(2, 1)] * 20)
    got = accuracy.overall(conf).first()
    assert got.oa == pytest.approx(0.7) and got.kappa == pytest.approx(0.4)
    per = {r.class_id: r for r in accuracy.per_class(conf).collect()}
    assert per[1].precision == pytest.approx(40 / 60) and per[1].recall == pytest.approx(0.8) and per[2].f1 == pytest.approx(2 * 30 / 90)
    assert accuracy.minority_f1(accuracy.per_class(conf)).first()[0] == pytest.approx(per[2].f1)
    assert [tuple(r) for r in accuracy.confusion_matrix(conf, [1, 2]).orderBy("true").collect()] == [(1, 40, 10), (2, 20, 30)]
    only = pairs(spark, [(1, 1)] * 3)
    assert accuracy.overall(only).first().kappa is None and accuracy.minority_f1(accuracy.per_class(only)).first()[0] == 1.0
    never = {r.class_id: r for r in accuracy.per_class(pairs(spark, [(1, 3), (1, 1)])).collect()}
    assert never[3].recall == 0.0 and never[3].support == 0


def test_points(spark):
    a = np.array([[1.0, 2.0], [np.nan, 2.0]])
    classes = table(spark, cls=a)
    rows = [("49.95", "10.05", "1"), ("49.95", "10.15", "1"), ("49.85", "10.05", "1"), ("60", "10", "1"), ("x", "10", "1"), (None, "10", "1"), ("49.95", "10.05", "1.0"), (" 49.85 ", "10.15", "2")]
    points = spark.createDataFrame(rows, "lat string, lon string, `class` string")
    found, lost = accuracy.assess_points(points, classes, "cls", Raster(2, 2, 0.1, 10.0, 50.0, 4326))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (2, 2)]
    assert {r.reason: r.n for r in lost.collect()} == {"nodata_pixel": 1, "out_of_bounds": 1, "missing_fields": 3}
    with pytest.raises(ValueError):
        accuracy.assess_points(points.limit(1), classes, "cls", Raster(2, 2, 0.1, 10.0, 50.0, 4326))


def test_stratified_sizes(spark):
    rows = [(i, 0, 1 if i < 90 else 2 if i < 99 else 3) for i in range(100)]
    df = spark.createDataFrame(rows, "row int, col int, label int")
    sizes = lambda n: {r.label: r.n for r in sampling.stratified_subsample(df, "label", n).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes(50) == {1: 45, 2: 4, 3: 1}
    assert sizes(1000) == {1: 90, 2: 9, 3: 1}
    a, b = (sorted(map(tuple, sampling.stratified_subsample(df.repartition(k), "label", 20).collect())) for k in (1, 5))
    assert a == b


def test_label_and_polygon_samples(spark):
    f = table(spark, x=RNG.random((20, 25)), y=np.where(RNG.random((20, 25)) < 0.1, np.nan, 1.0))
    labels = f.select("row", "col", F.when(F.col("row") < 10, 1).otherwise(0).alias("label"))
    got = sampling.extract_from_labels(f, labels, ["x", "y"])
    assert got.count() == f.where("row < 10 and y is not null").count()
    with pytest.raises(ValueError):
        sampling.extract_from_labels(f, labels.where("label = 0"), ["x", "y"])
    polygons = spark.createDataFrame(list(_POLYGONS), "poly_id int, class_id int, rings array<array<struct<x:double,y:double>>>")
    raster = Raster(25, 20, 1.0, 0.0, 0.0, 32633)
    got = sampling.extract_from_polygons(f, polygons, ["x"], raster)
    n = {r.poly_id: r["count"] for r in got.groupBy("poly_id").count().collect()}
    assert n[0] == 8 * 8 and n[2] == 64 - 16
    assert sampling.extract_from_polygons(f, polygons, ["x"], raster, 5).count() == 15
    meta = sampling.polygon_meta(polygons).first()
    assert (meta["left"], meta.top, meta.class_labels) == (0.0, -1.0, [1, 2, 3])


def samples(spark, n=240, apart=4.0, share=0.5):
    y = (RNG.random(n) < share).astype(int) + 1
    x = RNG.normal(size=(n, 3)) + (y[:, None] - 1) * apart
    return spark.createDataFrame([(i, 0, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "row int, col int, a double, b double, c double, label int")


@pytest.mark.parametrize("kind", ml.MODELS)
def test_models_on_separable_data(spark, kind):
    df = samples(spark)
    model = ml.fit(df, ["a", "b", "c"], ml.ClassificationConfig(kind, n_estimators=5, max_depth=3))
    got = model.transform(df)
    assert got.where("cls = label").count() >= 0.97 * df.count()
    assert got.where("conf < 0.5 or conf > 1").count() == 0
    assert sum(model.importances().values()) == pytest.approx(1.0)
    out = ml.predict(model, df.withColumn("a", F.when(F.col("row") == 3, None).otherwise(F.col("a"))))
    assert out.count() == df.count() and [r.row for r in out.where("cls is null").collect()] == [3]


def test_training_metrics_and_gate(spark):
    good = ml.train(samples(spark), ["a", "b", "c"], ml.ClassificationConfig(n_estimators=5, k_folds=3, max_depth=3), DEFAULTS)
    assert good.gate_passed and good.oa > 0.95 and good.folds.count() == 3 and good.classes == (1, 2)
    noise = ml.train(samples(spark, apart=0.0), ["a", "b", "c"], ml.ClassificationConfig(n_estimators=5, k_folds=2, max_depth=3), DEFAULTS)
    assert not noise.gate_passed and noise.gate_message.startswith("rejected for overall accuracy")
    few = ml.train(samples(spark, share=0.05), ["a", "b", "c"], ml.ClassificationConfig(n_estimators=3, k_folds=2, max_depth=3), DEFAULTS)
    assert few.smote_applied
    with pytest.raises(ValueError):
        ml.train(samples(spark).where("label = 1"), ["a"], ml.ClassificationConfig(), DEFAULTS)
    with pytest.raises(ValueError):
        ml.fit(samples(spark), ["a"], ml.ClassificationConfig("svm"))


def test_folds_and_smote(spark):
    df = samples(spark, 103, share=0.2)
    per = ml.with_folds(df, "label", 5).groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k")).collect()
    assert all(r.d <= 1 and r.k == 5 for r in per)
    out = ml.smote(df, ["a", "b", "c"])
    sizes = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes[1] == sizes[2]
    box = df.where("label = 2").agg(F.min("a"), F.max("a")).first()
    assert out.where("label = 2").where((F.col("a") < box[0]) | (F.col("a") > box[1])).count() == 0
    with pytest.raises(ValueError):
        ml.smote(spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 2)], "a double, label int"), ["a"])


def test_survey_from_pixels_to_areas(spark):
    h = w = 16
    labels = synthetic.ring_labels(spark, h, w, 3)
    grid = array(labels, "label", (h, w))
    bands = {n: grid * k + 1 + RNG.normal(size=(h, w)) * 0.05 for k, n in ((1.0, "nir"), (0.0, "red"))}
    bands["red"][0, 0] = 0.1  # else the darkest red would leave nothing
    from orelens.model import BandMap

    cfg = DEFAULTS | {"min_mapping_unit_ha": 0.02, "default_k_folds": 2}
    out = workflow.survey(table(spark, **bands), labels, BandMap.of(bands), Raster(w, h, 10.0, epsg=32633), cfg, ml.ClassificationConfig(n_estimators=5, max_depth=4))
    assert sum(r.pixel_count for r in out["areas"].collect()) == h * w
    assert out["result"].oa > 0.6 and list(out["steps"])[-1] == "sieve_filter"


def test_synthetic_sites(spark):
    pit = array(synthetic.pit_wall_labels(spark, 60, 70), "label", (60, 70))
    assert set(np.unique(pit)) == {1, 2, 3, 4, 5} and pit[0, 0] == 4
    dam = array(synthetic.tailings_labels(spark, 80, 80), "label", (80, 80))
    assert {1, 2, 4} <= set(np.unique(dam)) <= {1, 2, 3, 4, 5, 6} and dam[0, 0] == 4 and dam[36, 40] == 1
    again = array(synthetic.tailings_labels(spark, 80, 80).repartition(3), "label", (80, 80))
    assert (dam == again).all()
    far = array(synthetic._grid(spark, 30, 30).withColumn("n", synthetic.noise(F.col("row"), F.col("col"), 30, 30, 8, 1)), "n", (30, 30))
    assert far.min() >= 0 and far.max() <= 1 and np.abs(np.diff(far, axis=0)).max() < 0.6


def test_rounds_and_depth_reach_the_trees(spark, monkeypatch):
    asked = []

    class Reached(Exception):
        pass

    def record(**given):
        asked.append((given.get("maxIter", given.get("numTrees")), given["maxDepth"]))
        raise Reached

    monkeypatch.setattr(ml, "GBTClassifier", record)
    monkeypatch.setattr(ml, "RandomForestClassifier", record)
    configs = [ml.ClassificationConfig("xgboost"), ml.ClassificationConfig("xgboost", n_estimators=200, max_depth=10), ml.ClassificationConfig()]
    for config in configs:
        with pytest.raises(Reached):
            ml.fit(samples(spark), ["a", "b", "c"], config)
    assert asked == [(100, 6), (200, 10), (100, 30)]
