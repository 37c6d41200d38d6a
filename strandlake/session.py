"""A session with the settings the operators are tuned for, the folder executors share, and this package's code on the executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "strandlake", master: str | None = None, **settings: str) -> SparkSession:
    """``settings``: dots written as double underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-strandlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that their workers import it.

    Functions are then sent by name. Sent by value, each task would make its own copy of their modules and of what those
    keep, and a worker that runs many tasks would keep all copies.
    """
    context, package = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, f"{package.name}/{path.relative_to(package)}")
    jvm, target = context._jvm, f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}.zip"
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a set number of partitions, for work that takes long for each row: adaptive execution merges others by their bytes, to one task for many rows of little text."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the folder all executors share and read from there, so that a lost executor repeats no earlier step."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
