"""Session set-up and tables staged in the shared folder of the cluster."""

from __future__ import annotations

import json
import re
import sys
import tempfile
import uuid

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}


def by_value(module: str) -> None:
    """Functions of ``module`` travel to the workers with their code, wherever the package lies."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(app_name: str = "shelfmark", master: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="shelfmark-")
    return _LOCAL_SHARED[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, told: Callable[[str, int], None] | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage, survives the loss of executors, and gives later stages column pruning,
    filter pushdown and real size statistics. ``told`` is called with the label and the number of
    rows, which are counted as they are written.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    if told is None:
        df.write.parquet(folder)
    else:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        told(label, seen.get["rows"])
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Remove the tables this application staged; call it when their readers are done."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def literal_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small driver-side table as a JVM-side relation.

    No Python workers are involved and Catalyst knows its size, so it decides by itself whether
    joining it by broadcast is safe.
    """
    return spark.sql(
        f"SELECT inline(from_json(:doc, 'array<struct<{ddl}>>'))", args={"doc": json.dumps(rows)}
    )
