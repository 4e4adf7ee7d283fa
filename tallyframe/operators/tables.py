"""Written tables: they cut lineage, outlive executors and read the same each time."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a folder of our own where all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault("dir", f"file://{tempfile.gettempdir()}/tallyframe-core-{uuid.uuid4().hex}")
    return base.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """(file system, Hadoop path)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = path_of(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, which goes with the application."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tallyframe-core/{spark.sparkContext.applicationId}"
    if _OWN.get("app") != folder:
        _OWN["app"] = folder
        atexit.register(lambda: spark.sparkContext._jsc is not None and remove(spark, folder))
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
