"""An append-only audit table: (timestamp, run_id, event_type, details as JSON, decision)."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp timestamp, run_id string, event_type string, details string, decision string"


def read(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The events; a table that isn't there has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    events = spark.read.schema(SCHEMA).parquet(path)
    return events.where(F.col("run_id") == run_id) if run_id else events


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def log_event(spark: SparkSession, path: str, run_id: str, event_type: str, details: dict[str, Any], decision: str | None = None) -> None:
    """Appends one row; writers don't read or lock what is there."""
    row = (datetime.now(UTC).replace(tzinfo=None), run_id, event_type, json.dumps(details, default=str), decision)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def log_config_snapshot(spark: SparkSession, path: str, run_id: str, cfg: dict[str, Any]) -> bool:
    """At most one a run: whether it was written now."""
    if read(spark, path, run_id).where(F.col("event_type") == "config_snapshot").limit(1).count():
        return False
    log_event(spark, path, run_id, "config_snapshot", cfg)
    return True


def missing_snapshots(events: DataFrame) -> DataFrame:
    """(run_id) of runs without a snapshot."""
    return events.select("run_id").distinct().join(events.where(F.col("event_type") == "config_snapshot"), "run_id", "left_anti")


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """A log kept as one JSON array; missing or corrupt files give no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    fields = "timestamp string, run_id string, event_type string, details string, decision string, _corrupt_record string"
    rows = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").json(path).cache()
    return rows.where("_corrupt_record is null and event_type is not null").select(F.expr("try_cast(timestamp AS TIMESTAMP)").alias("timestamp"), "run_id", "event_type", "details", "decision")


def export(spark: SparkSession, path: str, run_id: str, out: str | Path) -> Path:
    """A run's events as one JSON file, from the stored table, in order."""
    rows = read(spark, path, run_id).orderBy("timestamp", "event_type").collect()  # one run's events
    events = [{"timestamp": r.timestamp.isoformat() + "+00:00", "run_id": r.run_id, "event_type": r.event_type, "details": json.loads(r.details), **({"decision": r.decision} if r.decision else {})} for r in rows]
    out = Path(out)
    out.write_text(json.dumps(events, indent=2), encoding="utf-8")
    return out
