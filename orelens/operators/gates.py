"""Quality gates with pass, warning and fail, as a join of metrics with thresholds."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (order, metric, key of the thresholds, default pass, default fail, whether higher is better)
GATES = (
    (1, "Overall Accuracy (training)", "oa", 0.90, 0.80, True),
    (2, "Cohen's Kappa", "kappa", 0.80, 0.65, True),
    (3, "Minority F1", "f1", 0.70, 0.50, True),
    (4, "Overall Accuracy (independent)", "oa", 0.90, 0.80, True),
    (5, "Mean Confidence", "confidence", 0.75, 0.60, True),
    (6, "Nodata Coverage", "nodata", 0.05, 0.10, False),
)


def thresholds(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    rows = [(i, m, float(cfg.get(f"quality_gate_{k}_pass", p)), float(cfg.get(f"quality_gate_{k}_fail", f)), up) for i, m, k, p, f, up in GATES]
    return spark.createDataFrame(rows, "gate int, metric string, threshold_pass double, threshold_fail double, higher_is_better boolean")


def status(value: Column, passes: Column, fails: Column, higher: Column) -> Column:
    """At a threshold counts as having reached it."""
    up = F.when(value >= passes, "pass").when(value >= fails, "warning").otherwise("fail")
    down = F.when(value <= passes, "pass").when(value <= fails, "warning").otherwise("fail")
    return F.when(higher, up).otherwise(down)


def quality_gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(gate, metric, value, status, threshold_pass, threshold_fail, message) of metrics (metric, value) that have a value."""
    v, p, f = F.col("value"), F.col("threshold_pass"), F.col("threshold_fail")
    joined = metrics.where(v.isNotNull()).join(F.broadcast(limits), "metric").withColumn("status", status(v, p, f, F.col("higher_is_better")))
    number = lambda c: F.when(F.col("higher_is_better"), F.format_string("%.4f", c)).otherwise(F.format_string("%.2f%%", c * 100))
    met = F.concat_ws(" ", F.concat("metric", F.lit(":")), number(v), F.lit("against"), number(F.when(F.col("status") == "fail", f).otherwise(p)), F.concat(F.lit("("), F.upper("status"), F.lit(")")))
    return joined.select("gate", "metric", "value", "status", "threshold_pass", "threshold_fail", met.alias("message"))


def has_failures(gates: DataFrame) -> DataFrame:
    return gates.agg(F.coalesce(F.bool_or(F.col("status") == "fail"), F.lit(False)).alias("failed"))


def worst(gates: DataFrame) -> DataFrame:
    """One row: the worst status, pass if there are no gates."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warning", 1).otherwise(0)
    return gates.agg(F.get(F.array(F.lit("pass"), F.lit("warning"), F.lit("fail")), F.coalesce(F.max(rank), F.lit(0))).alias("status"))


#: (column, name, setting, least value by default) of the two-threshold gate
TWO = (("oa", "overall accuracy", "min_oa_threshold", 0.80), ("minority_f1", "minority F1", "min_minority_f1", 0.70))


def legacy_gates(metrics: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """metrics (oa, minority_f1) with gate_passed and gate_message, by two thresholds: the message tells each value that
    is too low, or both values."""
    told = [(F.col(c) >= (least := float(cfg.get(key, default))), F.format_string(f"{name} %.3f (least {least:.3f})", c)) for c, name, key, default in TWO]
    low = F.filter(F.array(*[F.when(~met, text) for met, text in told]), lambda x: x.isNotNull())
    verdict = F.when(F.size(low) > 0, F.concat(F.lit("rejected for "), F.array_join(low, ", "))).otherwise(F.concat(F.lit("accepted with "), F.concat_ws(", ", *[text for _, text in told])))
    return metrics.withColumns({"gate_passed": F.size(low) == 0, "gate_message": verdict})


def rmse_gate(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Coregistration results with gate_passed; a failed gate takes the corrected path away and says why."""
    ok = F.col("rmse") <= threshold
    return results.withColumns({"gate_passed": ok, "corrected_path": F.when(ok, F.col("corrected_path")), "message": F.when(ok, F.col("message")).otherwise(F.format_string(f"RMSE %.4f px exceeds {threshold:.4f} px: output withheld.", "rmse"))})


def report_gate(metrics: DataFrame, cfg: Mapping[str, Any], kappa_least: float = 0.60) -> DataFrame:
    """(metric, value, threshold, passed) of a row (oa, kappa, minority_f1), two-tier as in reports."""
    rows = (("Overall Accuracy", "oa", float(cfg.get("min_oa_threshold", 0.80))), ("Cohen's Kappa", "kappa", kappa_least), ("Minority F1", "minority_f1", float(cfg.get("min_minority_f1", 0.70))))
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value"), F.lit(t).alias("threshold"), (F.col(c) >= t).alias("passed")) for n, c, t in rows])
    return metrics.select(F.explode(items).alias("g")).select("g.*")
