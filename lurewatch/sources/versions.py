"""Tables by source whose rows are replaced all at once: versioned folders, and one small pointer file for each source.

``root/versions/version=V/table=T/source=S`` holds the rows of a source that load V brought; ``root/current/NAME.json`` says
which version of a source counts. A load writes its version first and then swaps the pointers by rename, so a reader, and a
crash between any two steps, sees a source's old rows or its new ones, in all tables alike. Other sources are not touched, and
loads of different sources do not wait for each other. Pointers are as many as there are sources; no data goes through them.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files

_PARTS = ("version", "table", "source")


def _pointer(root: str, source: str) -> str:
    return f"{root}/current/{hashlib.sha256(source.encode()).hexdigest()[:32]}.json"


def pointers(spark: SparkSession, root: str) -> dict[str, dict]:
    """What counts now of each source: its version and its folders by table."""
    found = (json.loads(files.read(spark, f"{root}/current/{n}")) for n in files.names(spark, f"{root}/current") if n.endswith(".json"))
    return {p["source"]: p for p in found}


def replace(spark: SparkSession, root: str, tables: dict[str, DataFrame], sources: list[str], version: str | None = None) -> None:
    """Replace the rows of ``sources`` in all ``tables`` (each with a source column); a source without rows becomes empty.

    A load that is repeated with the same version name writes the same folders again.
    """
    version = version or uuid.uuid4().hex
    written: dict[str, dict[str, str]] = {s: {} for s in sources}
    for table, rows in tables.items():
        at = f"version={version}/table={table}"
        rows.where(F.col("source").isin(sources)).write.mode("overwrite").partitionBy("source").parquet(f"{root}/versions/{at}")
        named = {_folder(spark, s): s for s in sources}
        for folder in files.names(spark, f"{root}/versions/{at}"):
            if folder in named:
                written[named[folder]][table] = f"{at}/{folder}"
    for source in sources:
        _swap(spark, root, source, {"source": source, "version": version, "tables": written[source]})


def _folder(spark: SparkSession, source: str) -> str:
    """The name that Spark gives the folder of a source."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("source", source)


def _swap(spark: SparkSession, root: str, source: str, pointer: dict) -> None:
    target = _pointer(root, source)
    fresh = f"{target}.{uuid.uuid4().hex}"
    files.write(spark, fresh, json.dumps(pointer))
    files.move_over(spark, fresh, target)


def read(spark: SparkSession, root: str, table: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a table that count now, with their source."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    inner = T.StructType([f for f in fields if f.name != "source"])
    paths = [f"{root}/versions/{p['tables'][table]}" for p in pointers(spark, root).values() if table in p["tables"]]
    whole = T.StructType([*inner.fields, *(T.StructField(c, T.StringType()) for c in _PARTS)])
    if not paths:
        return spark.createDataFrame([], whole).select(*fields.names)
    return spark.read.schema(whole).option("basePath", f"{root}/versions").parquet(*paths).select(*fields.names)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete versions that no pointer names, and pointers that were never moved; call it while no load runs."""
    kept = {f"version={p['version']}" for p in pointers(spark, root).values()}
    gone = [n for n in files.names(spark, f"{root}/versions") if n not in kept]
    for n in gone:
        files.delete(spark, f"{root}/versions/{n}")
    for n in files.names(spark, f"{root}/current"):
        if not n.endswith(".json"):
            files.delete(spark, f"{root}/current/{n}")
    return gone
