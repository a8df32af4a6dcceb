"""Sinks (A9-A12): parquet by month, CSV tables, JSON reports, fitted models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, ts: str | None = None) -> None:
    """Overwrite; with a time column, partitioned by month so that later time slices prune folders.

    Rows are cut into ranges of about equal size by time, so a busy month takes
    several tasks and files, and short months share a task.
    """
    if ts is None:
        df.write.mode("overwrite").parquet(path)
        return
    dated = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    dated.repartitionByRange("month", ts).write.mode("overwrite").partitionBy("month").parquet(path)


def write_csv(tables: Mapping[str, DataFrame], folder: str, stamp: str) -> dict[str, str]:
    """One CSV folder per table named ``<table>_<stamp>``; nested columns as JSON text."""
    paths = {}
    for name, df in tables.items():
        flat = [F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes]
        paths[name] = f"{folder}/{name}_{stamp}"
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(paths[name])
    return paths


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_model(model: PipelineModel | Pipeline, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
