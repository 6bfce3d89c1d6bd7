"""The analysis queue as a log of row versions: every change of a row is a new version, the newest of each row is the queue.

A row is one accepted request of a url, named by url and batch. It is pending, then processing once a worker claims it, then
done or failed; a url may be asked for again unless it is pending. A step reads the versions of earlier batches only and gives
the versions that its batch adds, so a step that is repeated gives the same versions, and no row is ever claimed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import state as st

#: Versions of queue rows; ``step`` orders those of one batch.
LOG = "id string, url_hash string, url string, priority int, created long, status string, attempts int, error string, step int, batch_id long"
#: What a batch brings: requests (url_hash, url, priority, created) and outcomes (id, error) of claimed rows.
EVENTS = "kind string, id string, url_hash string, url string, priority int, created long, error string"
_ROW = ("id", "url_hash", "url", "priority", "created", "status", "attempts", "error")


def queue_state(log: DataFrame) -> DataFrame:
    """The newest version of each row, and of the done rows of a url only the last one; done rows keep no url."""
    newest = log.groupBy("id").agg(F.max_by(F.struct(*log.columns), F.struct("batch_id", "step")).alias("r")).select("r.*")
    order = F.struct("batch_id", "step", "id")
    last = newest.where("status = 'done'").groupBy("url_hash").agg(F.max_by("id", order).alias("id"))
    others = newest.where("status != 'done'")
    return others.unionByName(newest.join(last, ["id", "url_hash"], "left_semi").select(*newest.columns))


def queue_step(state: DataFrame, events: DataFrame, batch_id: int, workers_take: int) -> DataFrame:
    """Versions that a batch adds to the queue ``state`` of the batches before it: outcomes, then requests, then claims.

    An outcome counts for a row that is processing, the first of several if these disagree is the failure; requests of a url
    that is pending are ignored, and of several in a batch the first counts. Claims are the pending rows of highest priority,
    oldest first.
    """
    said = events.where(F.col("kind").isin("done", "failed")).groupBy("id").agg(F.max("kind").alias("kind"), F.max("error").alias("error"))
    running = state.where("status = 'processing'").select("id", "url_hash", "url", "priority", "created", "attempts")
    ended = running.join(said, "id").select(
        "id", "url_hash", F.when(F.col("kind") == "failed", F.col("url")).alias("url"), "priority", "created", F.col("kind").alias("status"), "attempts", F.when(F.col("kind") == "failed", F.col("error")).alias("error"), F.lit(0).alias("step")
    )
    asked = events.where((F.col("kind") == "request") & F.col("url").isNotNull()).select("url_hash", "url", "priority", "created")
    id_ = F.concat_ws("-", "url_hash", F.lit(batch_id))
    new = st.enqueue(state, asked).select(id_.alias("id"), "url_hash", "url", "priority", "created", "status", "attempts", F.lit(None).cast("string").alias("error"), F.lit(1).alias("step"))
    waiting = state.where("status = 'pending'").select(*_ROW).unionByName(new.select(*_ROW))
    claimed = st.claim(waiting, workers_take).withColumn("step", F.lit(2))
    columns = [c for c in (*_ROW, "step")]
    out = ended.select(*columns).unionByName(new.select(*columns)).unionByName(claimed.select(*columns))
    types = {"priority": "int", "created": "long", "attempts": "int", "step": "int"}
    return out.select(*(F.col(c).cast(types.get(c, "string")).alias(c) for c in columns), F.lit(batch_id).cast("long").alias("batch_id"))
