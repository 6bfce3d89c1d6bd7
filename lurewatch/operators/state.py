"""State as append-only events: each function turns an event table into the current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def latest(events: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The newest row of each key; with equal seq the greatest row by all columns."""
    rest = [c for c in events.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(seq, *[F.col(c) for c in rest if c != seq])).alias("r")
    return events.groupBy(*key).agg(newest).select(*key, "r.*")


def url_state(events: DataFrame) -> DataFrame:
    """(url_hash, first_seen, last_seen, seen_count, verdict, confidence, risk) from (seq, url_hash, seen_at, verdict, confidence, risk)."""
    last = F.max_by(F.struct("verdict", "confidence", "risk"), "seq").alias("l")
    return events.groupBy("url_hash").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("seen_count"), last).select("url_hash", "first_seen", "last_seen", "seen_count", "l.*")


def sorted_tags(tags: DataFrame) -> DataFrame:
    """(url_hash, tags): distinct tags in order."""
    return tags.groupBy("url_hash").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def with_stored(urls: DataFrame, state: DataFrame, tags: DataFrame, brand_results: DataFrame) -> DataFrame:
    """Urls with their stored observation, tags and brand result, each null if unknown."""
    return urls.join(state, "url_hash", "left").join(sorted_tags(tags), "url_hash", "left").join(brand_results, "url_hash", "left")


def reputation_boost(safe_users: Column, bad_events: Column) -> Column:
    return F.when(bad_events > 0, 0).when(safe_users >= 250, 15).when(safe_users >= 75, 10).when(safe_users >= 25, 5).otherwise(0)


def domain_reputation(events: DataFrame) -> DataFrame:
    """(domain, safe_users, bad_events, first_seen, last_seen, boost) from (url, user_id, kind, seen_at): a user counts once, blank users never."""
    safe = (F.col("kind") == "safe") & (t.trimmed(F.col("user_id")) != "")
    counted = events.where(safe | (F.col("kind") == "unsafe")).withColumn("domain", t.registrable_domain(t.normal_domain(F.col("url"))))
    out = counted.groupBy("domain").agg(
        F.count_distinct(F.when(safe, F.col("user_id"))).alias("safe_users"), F.count_if(F.col("kind") == "unsafe").alias("bad_events"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )
    return out.withColumn("boost", reputation_boost(F.col("safe_users"), F.col("bad_events")))


def enqueue(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """New queue rows (url_hash, url, priority, created, status, attempts): one per url that is not pending yet."""
    first = requests.groupBy("url_hash").agg(F.min_by(F.struct("url", "priority", "created"), F.struct(F.col("created"), -F.col("priority"))).alias("r")).select("url_hash", "r.*")
    pending = queue.where("status = 'pending'").select("url_hash")
    return first.join(pending, "url_hash", "left_anti").withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n pending rows of highest priority, oldest first, as claimed: n is what one worker takes."""
    taken = queue.where("status = 'pending'").orderBy(F.desc("priority"), "created", "url_hash").limit(n)
    return taken.withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1)


def keep_newest_done(queue: DataFrame, seq: str = "updated") -> DataFrame:
    """The queue with only the newest done row of each url."""
    place = F.row_number().over(Window.partitionBy("url_hash", "status").orderBy(F.desc(seq)))
    return queue.withColumn("_place", place).where((F.col("status") != "done") | (F.col("_place") == 1)).drop("_place")


def evidence_rows(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("value_hash", F.sha2(F.col(value), 256))


def network_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence of kinds whois, dns, cert and hosting, newest first per url."""
    order = Window.partitionBy("url_hash").orderBy(F.desc("created"), "kind", "value_hash")
    return evidence.where(F.col("kind").isin("whois", "dns", "cert", "hosting")).withColumn("place", F.row_number().over(order))


def learned_brands(candidates: DataFrame, domains: DataFrame, most: int = 500) -> DataFrame:
    """(brand_key, name, domain, confidence): verified candidates with their domains, the ``most`` most certain."""
    joined = candidates.where("status = 'verified'").join(domains.select("brand_key", "domain"), "brand_key")
    return joined.select("brand_key", "name", "domain", "confidence").orderBy(F.desc("confidence"), "brand_key", "domain", "name").limit(most)


def resume(rows: DataFrame, written: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not written yet."""
    return rows.join(written.select(key).distinct(), key, "left_anti")


def private(df: DataFrame, store_raw: bool, raw: str = "raw") -> DataFrame:
    return df if store_raw else df.withColumn(raw, F.lit(None).cast("string"))
