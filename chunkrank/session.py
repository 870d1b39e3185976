"""Session defaults for local runs, and the shared folder used for materialised tables."""

from __future__ import annotations

import contextlib
import io
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "chunkrank") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        # Vector means and hit lists keep one small buffer per key; sorting them at 128 keys
        # is slower than hashing.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a temporary folder:
    on a cluster other machines could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="chunkrank-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/chunkrank-{uuid.uuid4().hex}"


def materialised(table: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from the copy.

    Cuts the lineage where several jobs read one result. Unlike a checkpoint the copy is
    columnar and has a known size, so later scans prune and joins pick the right side.
    """
    path = shared_dir(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


_UNITS = {"B": 0, "KiB": 1, "MiB": 2, "GiB": 3, "TiB": 4, "PiB": 5, "EiB": 6}


def scan_tasks(table: DataFrame) -> int:
    """About how many tasks read the table, from the planner's sizes of its files; runs nothing."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        table.explain("cost")
    sizes = re.findall(r"Relation .*sizeInBytes=([\d.E+]+) (\w+)", shown.getvalue().split("== Physical Plan")[0])
    split = table.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m")
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", split.lower()).groups()
    each = int(number) << (10 * ("", "k", "m", "g", "t").index(unit))
    return int(sum(float(n) * 1024 ** _UNITS.get(u, 0) for n, u in sizes) // each) + 1
