"""Streaming jobs over the given tables, run to the end of their input; each has the batch result as its twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, with_fixtures
from ..operators import brands as b
from ..operators import queue as q
from ..operators import threats as th
from ..registry import ORACLES, QUERIES, query
from ..sources import versions
from ..streaming import jobs, reputation, sinks
from ..tables import shared_dir
from .message_queries import _KEYED, SCORED, _both
from .source_queries import _SAYS, _indicators, land_feed
from .table_queries import _ev, _events

TAKE, BATCHES = 20, 3


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _queue_twin() -> str:
    """The queue after BATCHES rounds of outcomes, requests and claims, round by round."""
    parts = ["a AS (SELECT seq % 3 AS round, url_hash, url_norm AS url, 50 + tag_no AS priority, seen_at AS created FROM ev)"]
    waiting = "SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS url_hash, NULL::VARCHAR AS url, NULL::INT AS priority, NULL::BIGINT AS created WHERE false"
    for k in range(BATCHES):
        parts += [
            f"w{k} AS ({waiting})",
            f"n{k} AS (SELECT url_hash || '-{k}' AS id, url_hash, url, priority, created FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY created, priority DESC) AS place FROM a WHERE round = {k} AND url_hash NOT IN (SELECT url_hash FROM w{k})) WHERE place = 1)",
            f"c{k} AS (SELECT * FROM (SELECT * FROM w{k} UNION ALL SELECT * FROM n{k}) ORDER BY priority DESC, created, url_hash LIMIT {TAKE})",
        ]
        waiting = f"SELECT * FROM w{k} UNION ALL SELECT * FROM n{k} EXCEPT ALL SELECT * FROM c{k}"
    ended = " UNION ALL ".join(f"SELECT *, {k + 1} AS batch_id FROM c{k}" for k in range(BATCHES - 1))
    parts += [
        f"ended AS ({ended})", f"rest AS ({waiting})",
        "done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY batch_id DESC, id DESC) AS place FROM ended WHERE url_hash < '8') WHERE place = 1)",
    ]
    return ", " + ", ".join(parts) + f""" SELECT id, url_hash, url, priority, created, 'pending' AS status, 0 AS attempts, NULL AS error FROM rest
UNION ALL SELECT id, url_hash, url, priority, created, 'processing', 1, NULL FROM c{BATCHES - 1}
UNION ALL SELECT id, url_hash, NULL, priority, created, 'done', 1, NULL FROM done
UNION ALL SELECT id, url_hash, url, priority, created, 'failed', 1, 'no answer' FROM ended WHERE url_hash >= '8'"""


@query("t3_claim_log", _ev(_queue_twin()))
def _(s: SparkSession, d: str) -> DataFrame:
    log, events = _place(s, "queue"), _events(s, d)
    columns = q.EVENTS.split(", ")
    shaped = lambda df: df.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) if c.split()[0] in df.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns))
    for k in range(BATCHES):
        asked = events.where(F.col("seq") % 3 == k).select(F.lit("request").alias("kind"), "url_hash", F.col("url_norm").alias("url"), (F.col("tag_no") + 50).alias("priority"), F.col("seen_at").alias("created"))
        batch = shaped(asked)
        if k:
            ok = F.col("url_hash") < "8"
            batch = batch.unionByName(shaped(jobs.claims(s, log, k - 1).select("id", F.when(ok, "done").otherwise("failed").alias("kind"), F.when(~ok, "no answer").alias("error"))))
        for _ in range(1 + k % 2):  # the second batch comes twice
            jobs.queue_batch(batch, k, log, TAKE)
        if k == 0:
            jobs.snapshot_queue(s, log)
    return jobs.read_queue(s, log).select("id", "url_hash", "url", "priority", "created", "status", "attempts", "error")


@query("t1_score_stream", ORACLES["score_messages"])
def _(s, d):
    out, landed = _place(s, "scores"), _place(s, "messages")
    messages = fixture(s, d, "fx_messages")
    messages.repartition(2).write.parquet(landed)
    threats = th.dedupe_threats(th.normalize_indicators(fixture(s, d, "fx_indicators")))
    stream = s.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    jobs.score_stream(stream, lambda: threats, lambda: b.default_brands(s), out, _place(s, "checkpoint")).awaitTermination()
    wanted = QUERIES["score_messages"](s, d)
    return sinks.read_batches(s, out, wanted.schema).select(wanted.columns)


@query("t5_refresh_stream", with_fixtures("SELECT DISTINCT lower(trim(value)) AS indicator, 'hosts' AS source, '' AS tag FROM fx_indicators WHERE indicator_type = 'domain' UNION ALL SELECT DISTINCT lower(trim(value)), 'block_fuzzy', 'blacklist' FROM fx_indicators WHERE indicator_type = 'domain'", "fx_indicators"))
def _(s, d):
    root, landed = _place(s, "threats"), _place(s, "arrivals")
    rows = _indicators(s, d)
    files = [(k, k, "phishing", "url", land_feed(rows.where(_SAYS[k][0]), k), 1) for k in ("hosts", "block_fuzzy")]
    columns = "source string, format string, threat_type string, default_type string, path string, landed_at long"
    s.createDataFrame(files, columns).write.parquet(landed)
    jobs.refresh_stream(s.readStream.schema(columns).parquet(landed), root, _place(s, "checkpoint")).awaitTermination()
    threats = versions.read(s, root, "threats", jobs.THREATS)
    return threats.select("indicator", "source").join(versions.read(s, root, "tags", jobs.TAGS), ["indicator", "source"], "left").select("indicator", "source", F.coalesce("tag", F.lit("")).alias("tag"))


@query("t2_reputation_stream", f"SELECT domain, least(safe_users, 250) AS safe_users, bad_events, boost FROM ({ORACLES['g4_g5_domain_reputation']})")
def _(s, d):
    events, landed, out = _events(s, d), _place(s, "events"), _place(s, "reputation")
    kind = F.when(F.col("verdict") == "good", "safe").when(F.col("verdict") == "bad", "unsafe")
    rows = events.select("url", "user_id", kind.alias("kind"))
    rows.repartition(2).write.parquet(landed)
    before = s.conf.get(reputation.STORE[0])
    s.conf.set(*reputation.STORE)
    try:
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
        reputation.reputation_stream(stream, out, _place(s, "checkpoint")).awaitTermination()
    finally:
        s.conf.set(reputation.STORE[0], before)
    return reputation.read_reputation(s, out)


@query("t4_remember_stream", _both(f"""WITH {SCORED}, k AS (SELECT msg_id, message_hash, decision IN ('block', 'warn_both') OR overall_risk >= 75 OR secret >= 85 OR injection >= 60 AS stored FROM ({_KEYED}) JOIN decided USING (msg_id))
SELECT msg_id, msg_id % 2 = 1 AND message_hash IN (SELECT message_hash FROM k WHERE stored AND msg_id % 2 = 0) AS memory_exact FROM k"""))
def _(s, d):
    """Messages in two batches: the second meets the unsafe ones of the first in memory."""
    landed, memory, out, checkpoint = (_place(s, n) for n in ("messages", "memory", "scores", "checkpoint"))
    columns = "msg_id long, user_id string, message string, seen_at long"
    messages = fixture(s, d, "fx_messages").select("msg_id", "user_id", "message", F.unix_timestamp("ts").alias("seen_at"))
    threats = th.dedupe_threats(th.normalize_indicators(fixture(s, d, "fx_indicators")))
    for k in range(2):
        messages.where(F.col("msg_id") % 2 == k).write.mode("append").parquet(landed)
        jobs.remember_stream(s.readStream.schema(columns).parquet(landed), lambda: threats, lambda: b.default_brands(s), memory, out, checkpoint).awaitTermination()
    return sinks.read_batches(s, out, "msg_id long, memory_exact boolean").select("msg_id", "memory_exact")
