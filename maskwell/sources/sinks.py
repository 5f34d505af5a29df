"""Sinks: run records, metrics and images. Nothing is overwritten, and failed runs leave no output."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def config_json(config: dict) -> tuple[str, str]:
    """The configuration as JSON with sorted keys, and its SHA-256. NaN is refused."""
    text = json.dumps(config, sort_keys=True, allow_nan=False)
    return text, hashlib.sha256(text.encode()).hexdigest()


def no_nan(df: DataFrame) -> DataFrame:
    """The rows, with an error for a NaN in any double column at the top."""
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    for c in doubles:
        df = df.withColumn(c, F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}")).cast("double")).otherwise(F.col(c)))
    return df


def write_runs(runs: DataFrame, path: str) -> None:
    """One JSON record for each run, partitioned by it; an existing folder is an error."""
    no_nan(runs).select("run", F.to_json(F.struct(*[c for c in runs.columns if c != "run"])).alias("value")).write.mode("errorifexists").partitionBy("run").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("errorifexists").parquet(path)


def write_images(images: DataFrame, path: str) -> None:
    """Images of runs that have not failed."""
    images.where("status <> 'failed'").write.mode("errorifexists").parquet(path)
