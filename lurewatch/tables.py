"""Intermediate tables that several branches of a plan read: written once to the cluster's shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary one of its own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dirs[app]


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table: computed once, however many branches read it, and safe from lost executors.

    With ``by``, a few columns of few values, a branch that asks for one value reads its rows alone.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application wrote so far, once no result that reads them is needed any more; tells how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files.delete(spark, path)
    return len(paths)


def numbered(df: DataFrame, *by: str, name: str = "nth") -> DataFrame:
    """``df`` with row numbers from 0 on in the order ``by`` (SQL expressions, nulls first; append DESC for the reverse).

    Ranges of the order are sorted and written, each task one; a range's rows are then counted after the rows of the ranges
    before it. So no task sees more than a range, and what is sent to all tasks is one number for each of them. Rows that are
    equal in ``by`` are in input order, which also spreads many equal rows over several ranges.
    """
    order = [(e[:-5], False) if e.upper().endswith(" DESC") else (e, True) for e in by]
    rows = df.select(F.struct(*df.columns).alias("row"), *(F.expr(e).alias(f"key{i}") for i, (e, _) in enumerate(order)), F.monotonically_increasing_id().alias("at"))
    keys = [F.col(f"key{i}").asc_nulls_first() if up else F.col(f"key{i}").desc_nulls_last() for i, (_, up) in enumerate(order)]
    ranged = rows.repartitionByRange(*keys, "at").sortWithinPartitions(*keys, "at")
    held = written(ranged.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("at")), "ranges")
    counts = held.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return held.join(F.broadcast(offsets), F.col("part") == F.col("p")).select("row.*", (F.col("offset") + F.col("at")).alias(name))
