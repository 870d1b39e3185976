"""Where results go: long metrics, partitioned by suite, with one row of run metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = (
    "model_path string, model_name string, model_type string, date string, "
    "extended_context boolean, use_prefix boolean, colbert_model boolean, runtime double"
)


def run_metadata(
    spark: SparkSession,
    model_path: str,
    model_name: str,
    model_type: str,
    extended_context: bool = False,
    use_prefix: bool = False,
    colbert_model: bool = False,
    runtime: float | None = None,
    date: str | None = None,
) -> DataFrame:
    date = date or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    row = (
        model_path,
        model_name,
        model_type,
        date,
        extended_context,
        use_prefix,
        colbert_model,
        runtime,
    )
    return spark.createDataFrame([row], METADATA_SCHEMA)


def results_path(save_dir: str, model_name: str, model_type: str) -> str:
    return f"{save_dir}/metrics_{model_name}_{model_type}.json"


def write_metrics(
    metrics: DataFrame,
    metadata: DataFrame,
    save_dir: str,
    model_name: str,
    model_type: str,
    suite: str = "main",
    fmt: str = "json",
) -> str:
    """Write one suite's metrics, replacing only that suite's earlier result.

    Suites written one after another leave partial results behind if a later one fails.
    """
    target = results_path(save_dir, model_name, model_type)
    (
        metrics.withColumn("suite", F.lit(suite))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("suite")
        .format(fmt)
        .save(f"{target}/metrics")
    )
    metadata.write.mode("overwrite").format(fmt).save(f"{target}/run")
    return target


def read_metrics(spark: SparkSession, target: str, fmt: str = "json") -> DataFrame:
    schema = "dataset string, metric string, value double, suite string"
    return spark.read.format(fmt).schema(schema).load(f"{target}/metrics")
