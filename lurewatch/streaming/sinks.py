"""Sinks of micro-batches that may come twice: each batch has a folder of its own, so a repeated batch replaces its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The batch's rows, in place of what an earlier try of the same batch wrote."""
    df.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def complete(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Numbers of the batches that were written to their end, and are older than ``before``."""
    ids = sorted(int(n.partition("=")[2]) for n in files.names(spark, path) if n.startswith("batch_id="))
    return [i for i in ids if (before is None or i < before) and files.exists(spark, f"{path}/batch_id={i}/_SUCCESS")]


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str, before: int | None = None, since: int | None = None) -> DataFrame:
    """Rows of the complete batches with their batch_id, of those older than ``before`` and newer than ``since``."""
    inner = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*(f for f in inner if f.name != "batch_id"), T.StructField("batch_id", T.LongType())])
    ids = [i for i in complete(spark, path, before) if since is None or i > since]
    if not ids:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*(f"{path}/batch_id={i}" for i in ids))


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: T.StructType | str) -> DataFrame:
    """One batch's rows; the other batches' folders are not listed."""
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}").withColumn("batch_id", F.lit(batch_id).cast("long"))
