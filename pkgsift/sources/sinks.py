"""Sinks: result CSV (K1) and metrics JSON (K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

CSV_COLUMNS = ["class_id", "class_name", "current_package", "is_misplaced", "confidence", "reasoning",
               "suggested_package", "evidence", "method_used", "analysis_time", "analysis_timestamp"]


def write_results_csv(results: DataFrame, path: str | None, columns: list[str] | None = None) -> str | None:
    """K1: results as CSV with a header; booleans written as True / False; None writes nothing."""
    if path is None:
        return None
    cols = [c for c in (columns or ["project_id"] + CSV_COLUMNS) if c in results.columns]
    out = results.select(*[
        F.when(F.col(c), F.lit("True")).otherwise(F.lit("False")).alias(c)
        if isinstance(results.schema[c].dataType, BooleanType) else F.col(c) for c in cols])
    (out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))
    return path


def write_metrics_json(metrics: DataFrame, path: str | None) -> str | None:
    """K2: the metrics record(s) as JSON lines; nothing is written without a path."""
    if path is None:
        return None
    metrics.write.mode("overwrite").json(path)
    return path
