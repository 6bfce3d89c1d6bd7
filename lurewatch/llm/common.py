"""Shared helpers of the corpus operators: written intermediate tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a temporary one of its own only in local mode, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it has ended; otherwise they stay until the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; other DataFrames are left alone."""
    for df in written:
        path = getattr(df, "written_at", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Training rows (text, y): labelled, not held out, at most ``max_rows`` chosen by a hash of the id.

    The id list is bounded by ``max_rows``, so it is broadcast and the texts are not shuffled.
    """
    y = (
        labels.select(F.col("doc_id").alias("y_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("y_id").isNotNull() & ~held_out(F.col("y_id")))
        .groupBy("y_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("y_id"), "y_id").limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(y), F.col("doc_id") == F.col("y_id")).select("text", "y")


class Words(NamedTuple):
    """Words of a run of texts: 64-bit hashes, byte spans, and each text's first word (one entry more than texts)."""

    first: int  # index of the run's first text in its batch
    data: np.ndarray  # bytes of the run
    offsets: np.ndarray  # byte offset of each text, one more than texts
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def _class_table(split_punctuation: bool) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    inside[:33] = inside[127] = False
    if split_punctuation:
        for c in range(33, 127):
            inside[c] = chr(c).isalnum()
    return inside


_INSIDE = {s: _class_table(s) for s in (False, True)}
#: Words of every byte that is not ASCII white space.
SPACES_ONLY = ~np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int, which: str) -> np.ndarray:
    """Powers of an odd base modulo 2**64 (``up``) or of its inverse (``down``)."""
    if len(_powers[which]) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        size = 1 << (n - 1).bit_length()
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _powers[which] = np.multiply.accumulate(out)
    return _powers[which][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def runs(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) for runs of about CHUNK_BYTES; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(texts: pa.Array, lower: bool = True, split_punctuation: bool = True, inside: np.ndarray | None = None) -> Iterator[Words]:
    """Hash the words of each text: maximal runs of bytes that are not ASCII space (or ASCII punctuation), or of those in ``inside``."""
    of_word = _INSIDE[split_punctuation] if inside is None else inside
    for first, data, offsets in runs(texts, lower):
        inside = of_word[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = inside[at]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        at = offsets[1:][offsets[1:] > 0] - 1
        stops[at] = inside[at]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), "up") if len(data) else data, out=total[1:], dtype=np.uint64)
        hashes = mix64((total[ends] - total[starts]) * powers(len(data) + 1, "down")[starts])
        yield Words(first, data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; shorter by k - 1 than the input."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n]
    return mix64(out)
