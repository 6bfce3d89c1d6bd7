"""Threat indicators: normalisation, dedupe, feed state and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

KEY = ["indicator", "indicator_type", "threat_type", "source"]


def normalize_indicators(df: DataFrame) -> DataFrame:
    """Adds indicator from value by type; blank ones go."""
    by_type = F.when(F.col("indicator_type") == "url", t.normal_url(F.col("value"))).when(F.col("indicator_type") == "domain", t.normal_domain(F.col("value"))).otherwise(t.trimmed(F.col("value")))
    return df.withColumn("indicator", by_type).where("indicator != ''")


def dedupe_threats(df: DataFrame) -> DataFrame:
    """One row per key: least source_ref and first_seen, greatest last_seen, confidence and updated_at (dates as text)."""
    least = [F.min(c).alias(c) for c in ("source_ref", "first_seen") if c in df.columns]
    most = [F.max(c).alias(c) for c in ("last_seen", "confidence", "updated_at") if c in df.columns]
    return df.groupBy(*KEY).agg(*least, *most)


def threat_tags(df: DataFrame) -> DataFrame:
    """Distinct (indicator, source, tag) without empty tags."""
    return df.where("tag != ''").select("indicator", "source", "tag").distinct()


def feed_state(df: DataFrame, asof: int) -> DataFrame:
    """(source, record_count, updated_at): rows of each source before dedupe, loaded at ``asof`` (seconds)."""
    return df.groupBy("source").agg(F.count("*").alias("record_count")).withColumn("updated_at", F.lit(asof).cast("long"))


def match_threats(urls: DataFrame, threats: DataFrame) -> DataFrame:
    """Best threat per url: the url as url, or its domain as domain or ip, in one equi join on (type, key)."""
    keys = F.array(*[F.struct(F.lit(k).alias("indicator_type"), c.alias("indicator")) for k, c in (("url", t.normal_url(F.col("url"))), ("domain", t.normal_domain(F.col("url"))), ("ip", t.normal_domain(F.col("url"))))])
    asked = urls.select("url").distinct().select("url", F.explode(keys).alias("k")).select("url", "k.*")
    order = Window.partitionBy("url").orderBy(F.col("confidence").desc_nulls_last(), *([F.desc("updated_at")] if "updated_at" in threats.columns else []), "source", "threat_type", "indicator_type")
    return asked.join(threats, ["indicator_type", "indicator"]).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def due_feeds(registry: DataFrame, state: DataFrame, asof: int) -> DataFrame:
    """Feeds never loaded, or older than their interval, which is 30 minutes at least."""
    joined = registry.join(state.select("source", "updated_at"), "source", "left")
    return joined.where(F.col("updated_at").isNull() | (F.lit(asof) - F.col("updated_at") >= F.greatest(F.col("interval_minutes"), F.lit(30)) * 60)).select("source")
