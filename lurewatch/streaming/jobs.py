"""Structured Streaming jobs; each reuses the batch operators inside a micro-batch or as a streaming plan."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import memory as mem
from ..operators import messages as m
from ..operators import queue as q
from ..operators import state as st
from ..operators import threats as th
from ..plans.score import score_messages
from ..sources import feeds, versions
from ..tables import written
from . import sinks

log = logging.getLogger(__name__)


def throughput(events: DataFrame, ts: str, delay: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, n, mean_delay) per tumbling window, for a batch or a stream; later rows than the watermark are dropped by a stream."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.avg(delay).alias("mean_delay")).select(F.col("w.start").alias("start"), "n", "mean_delay")


def score_stream(messages: DataFrame, threats: Callable[[], DataFrame], brands: Callable[[], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Score messages batch by batch against the threats and brands as they are when the batch starts.

    ``sink`` has a folder for each batch, which a repeated batch replaces.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(score_messages(batch, threats(), brands()), sink, batch_id)

    return messages.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def safe_votes(events: DataFrame) -> DataFrame:
    """Running count of safe users per domain: one vote per (domain, user), kept as streaming state."""
    votes = events.where((F.col("kind") == "safe") & (F.trim("user_id") != "")).withColumn("domain", t.registrable_domain(t.normal_domain(F.col("url"))))
    return votes.select("domain", "user_id").dropDuplicates(["domain", "user_id"]).groupBy("domain").agg(F.count("*").alias("safe_users"))


def queue_batch(events: DataFrame, batch_id: int, log: str, per_batch: int = 20) -> None:
    """One batch of requests and outcomes (``queue.EVENTS``): its versions of queue rows, ``per_batch`` claims among them.

    It starts from the snapshot and the batches before it and writes all its versions at once, so a batch that fails and is
    repeated leaves no trace of the first try, and claims the same rows.
    """
    state = written(read_queue(events.sparkSession, log, batch_id), "queue")
    sinks.write_batch(q.queue_step(state, events, batch_id, per_batch), log, batch_id)


def queue_stream(events: DataFrame, log: str, checkpoint: str, per_batch: int = 20) -> StreamingQuery:
    """``queue_batch`` for each micro-batch; ``claims`` are what a worker takes."""
    step = lambda batch, batch_id: queue_batch(batch, batch_id, log, per_batch)
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_queue(spark: SparkSession, log: str, before: int | None = None) -> DataFrame:
    """The queue as the batches older than ``before`` left it: the newest snapshot of these and the versions since."""
    taken = sinks.complete(spark, f"{log}/_snapshots", None if before is None else before)
    since = taken[-1] if taken else None
    versions = sinks.read_batches(spark, log, q.LOG, before, since)
    if taken:
        kept = spark.read.schema(q.LOG).parquet(f"{log}/_snapshots/batch_id={since}")
        versions = kept.unionByName(versions.select(*kept.columns))
    return q.queue_state(versions)


def snapshot_queue(spark: SparkSession, log: str) -> None:
    """Fold the log so far into a snapshot, so that later batches read it and the versions since only; the log itself stays."""
    last = sinks.complete(spark, log)
    if last:
        read_queue(spark, log, last[-1] + 1).write.mode("overwrite").parquet(f"{log}/_snapshots/batch_id={last[-1]}")


def claims(spark: SparkSession, log: str, batch_id: int) -> DataFrame:
    """The rows that a batch claimed: (id, url_hash, url, attempts)."""
    return sinks.read_batch(spark, log, batch_id, q.LOG).where("status = 'processing'").select("id", "url_hash", "url", "attempts")


MEMORY = "seq long, message_hash string, simhash long, risk int, decision string, user_id string, raw string, seen_at long"


def remember_stream(messages: DataFrame, threats: Callable[[], DataFrame], brands: Callable[[], DataFrame], memory: str, sink: str, checkpoint: str, store_raw: bool = False) -> StreamingQuery:
    """Score messages (msg_id, user_id, message, seen_at) against the memory as it is when a batch starts, and remember the unsafe ones.

    ``memory`` holds events in a folder for each batch; messages of one batch do not see each other, and a repeated batch sees
    and replaces what its first try saw and wrote. Raw texts are kept only on request.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = mem.unsafe_state(sinks.read_batches(spark, memory, MEMORY, before=batch_id).drop("batch_id"))
        keyed = mem.with_simhash(mem.with_message_keys(batch))
        found = mem.memory_lookup(keyed, known).select("message_hash", F.col("exact").alias("memory_exact"), F.col("n_similar").alias("memory_similar"), "memory_adjustment")
        remembered = keyed.select("msg_id", "message_hash").join(found, "message_hash").drop("message_hash")
        scored = score_messages(batch, threats(), brands(), memory=remembered)
        sinks.write_batch(scored, sink, batch_id)
        mine = sinks.read_batch(spark, sink, batch_id, scored.schema)
        unsafe = mine.where(m.store_as_unsafe(F.col("decision"), F.col("overall_risk"), F.col("secret"), F.col("injection"))).select("msg_id", "overall_risk", "decision")
        rows = unsafe.join(keyed, "msg_id").select(
            F.col("msg_id").cast("long").alias("seq"), "message_hash", "simhash", F.col("overall_risk").cast("int").alias("risk"), "decision", F.col("user_id").cast("string").alias("user_id"), F.col("message").alias("raw"), F.col("seen_at").cast("long").alias("seen_at")
        )
        sinks.write_batch(st.private(rows, store_raw), memory, batch_id)

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


THREATS = "indicator string, indicator_type string, threat_type string, source string, source_ref string, first_seen string, last_seen string, confidence int"
TAGS = "indicator string, source string, tag string"


def refresh_stream(arrivals: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Load newly landed feed files (source, format, threat_type, default_type, path; the newest row of a source counts) and replace
    each source's threats and tags at once; a source that cannot be read is left as it was, and the others go on.

    The tables are read by ``versions.read(spark, root, "threats", THREATS)`` and ``"tags"``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for r in st.latest(batch, ["source"], "landed_at").collect():  # one row a feed
            try:
                rows = written(th.normalize_indicators(feeds.read_feed(spark, r.path, r.format, r.source, r.threat_type, r.default_type)), "feed")
                name = f"{batch_id}-{hashlib.sha256(r.source.encode()).hexdigest()[:16]}"
                versions.replace(spark, root, {"threats": th.dedupe_threats(rows), "tags": th.threat_tags(rows)}, [r.source], name)
            except Exception as e:  # noqa: BLE001 (a bad feed must not stop the others)
                log.warning("feed %s left as it was: %s", r.source, e)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
