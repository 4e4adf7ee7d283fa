"""Loads that may be repeated: a run replaces its own part of a table and no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.tables import path_of


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, an order-free checksum)."""
    h = F.xxhash64(*[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns])
    n, s, x = df.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")), F.coalesce(F.bit_xor(h), F.lit(0).cast("long"))).first()
    return n, f"{s}:{x}"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, rows, checksum): the parts that are whole."""
    schema = "rows long, checksum string, run string"
    fs, at = path_of(spark, f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/manifest") if fs.exists(at) else spark.createDataFrame([], schema)


def load_part(df: DataFrame, path: str, run: str) -> bool:
    """Puts df in the place of run's part of the table at `path`; false if just these rows are there already.

    A dynamic overwrite of one partition: a load that fails leaves the part as it was, since files are moved into place when all tasks are
    done; one that is run again replaces what it wrote. The manifest names a part only after it is whole, so a reader of `read_parts` does
    not see one that is being loaded for the first time; an empty load empties its part."""
    spark = df.sparkSession
    rows, mark = checksum(df)
    held = manifest(spark, path).where(F.col("run") == run).collect()  # one row at most
    if held and (held[0].rows, held[0].checksum) == (rows, mark):
        return False

    def put(frame: DataFrame, to: str) -> None:
        frame.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(to)

    if rows:
        put(df, f"{path}/data")
    else:
        fs, at = path_of(spark, f"{path}/data/run={run}")
        fs.delete(at, True)
    put(spark.createDataFrame([(rows, mark)], "rows long, checksum string").coalesce(1), f"{path}/manifest")
    return True


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All whole parts, with `run`; schema without it."""
    whole = manifest(spark, path).where("rows > 0")
    fs, at = path_of(spark, f"{path}/data")
    if not fs.exists(at):
        return spark.createDataFrame([], f"{schema}, run string")
    table = spark.read.schema(f"{schema}, run string").parquet(f"{path}/data")
    return table.join(whole.select("run"), "run", "left_semi").select(table.columns)
