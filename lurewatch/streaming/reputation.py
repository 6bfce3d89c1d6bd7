"""Running domain reputation with bounded state: what the batch query counts, as far as a boost depends on it.

The boost does not change beyond MOST distinct safe users, so a key keeps at most that many, as digests, and forgets the further
ones; without the cap the state would grow with every (domain, user) ever seen. A key is a domain and a part of its users by
hash, so a domain with a third of all events is spread over PARTS tasks; the parts' users are disjoint, so their counts add up.
With a time to live, users that were not seen for that long are forgotten too.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as t
from ..operators import state as st
from . import sinks

MOST = 250
PARTS = 16
OUT = "domain string, part int, safe_users int, bad_events long"
#: The state store that ``reputation_stream`` needs; a session has to be set to it before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Reputation(StatefulProcessor):
    """At most MOST digests of safe users, and the number of bad events, of one part of a domain."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "user string", "seen boolean", self.ttl_ms)
        self.bad = handle.getValueState("bad", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {k[0] for k in self.users.keys()}  # MOST at most
        bad = self.bad.get()[0] if self.bad.exists() else 0
        for batch in rows:
            bad += int(batch["bad"].sum())
            for user in batch["user"].dropna().unique():
                again = user in known
                if again and self.ttl_ms is not None or not again and len(known) < MOST:
                    self.users.updateValue((user,), (True,))
                    known.add(user)
        self.bad.update((bad,))
        yield pd.DataFrame({"domain": [key[0]], "part": [key[1]], "safe_users": [len(known)], "bad_events": [bad]})

    def close(self) -> None:
        pass


def reputation_updates(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream of (domain, part, safe_users, bad_events): the new counts of every part that events (url, user_id, kind) changed."""
    safe = (F.col("kind") == "safe") & (t.trimmed(F.col("user_id")) != "")
    counted = events.where(safe | (F.col("kind") == "unsafe"))
    user = F.when(safe, F.md5("user_id"))
    part = F.pmod(F.xxhash64("user_id", "url"), F.lit(PARTS))
    keyed = counted.select(
        t.registrable_domain(t.normal_domain(F.col("url"))).alias("domain"), F.when(safe, F.pmod(F.xxhash64("user_id"), F.lit(PARTS))).otherwise(part).cast("int").alias("part"), user.alias("user"), (~safe).cast("int").alias("bad")
    ).where("domain IS NOT NULL")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.groupBy("domain", "part").transformWithStateInPandas(_Reputation(ttl_ms), OUT, "Update", mode)


def reputation_stream(events: DataFrame, sink: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Write the updates of each batch to a folder of its own."""
    if events.sparkSession.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    write = lambda batch, batch_id: sinks.write_batch(batch, sink, batch_id)
    return reputation_updates(events, ttl_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_reputation(spark: SparkSession, sink: str) -> DataFrame:
    """(domain, safe_users, bad_events, boost) now: the newest counts of each part, added up; safe users up to MOST."""
    newest = sinks.read_batches(spark, sink, OUT).groupBy("domain", "part").agg(F.max_by(F.struct("safe_users", "bad_events"), "batch_id").alias("r"))
    added = newest.groupBy("domain").agg(F.least(F.sum("r.safe_users"), F.lit(MOST)).alias("safe_users"), F.sum("r.bad_events").alias("bad_events"))
    return added.withColumn("boost", st.reputation_boost(F.col("safe_users"), F.col("bad_events")))
