"""Mixing sources to target weights by balanced sampling with the cube method.

Sources share the total size by weight; a target stops at ``most_repeats`` times its source's size and what it
cannot take is shared again by weight. A source's rate (target / size) is its documents' number of whole copies
plus one inclusion probability for a further copy. The cube method settles those probabilities: three documents
at a time move along the direction that keeps both their expected words and their expected count, until one of
them is in or out. This runs in blocks of bounded size; the two documents at most that a block leaves open go to
blocks of the next level, until two per source remain, which land by a draw with their own probabilities.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own, last in order; documents
of size 0 take part like others; repeated rows are units of their own; an empty table gives an empty result;
other columns are not read. All draws are seeded by block, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.tables import numbered

from .common import materialize

WEIGHTS = (5, 2, 1)
BLOCK_ROWS = 2048
FAN_IN = 512


def size_in_words(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """(source, ix, rows, source_size, target): one row per source; only these rows meet in one window.

    Sorted by cap per weight, a prefix of sources is capped, and the rest share what is left by weight.
    """
    totals = units.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    ix = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("ix") % len(weights) + 1)
    ranked = totals.withColumn("ix", ix).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most_repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "ix")
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # the level at which this and all later sources would share what earlier caps leave
    levelled = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the first source below its cap has the level that all from there on share
    share = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("order"), "ix", "level"))).over(every)
    return levelled.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(share.getField("level") * F.col("weight"))).select("source", "ix", "rows", "source_size", "target")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for at most two; sums of p and of p * size are kept."""
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    waiting = iter(range(len(p)))
    held: list[int] = []
    draws = iter(())
    eps = 1e-9
    while True:
        while len(held) < 3:
            i = next(waiting, None)
            if i is None:
                return np.array(p)
            if eps < p[i] < 1 - eps:
                held.append(i)
            else:
                p[i] = float(p[i] > 0.5)
        i, j, k = held
        move = (s[j] - s[k], s[k] - s[i], s[i] - s[j])
        if not any(move):
            move = (1.0, -1.0, 0.0)
        ahead = min(((1 - p[x]) / v if v > 0 else p[x] / -v) for x, v in zip(held, move, strict=True) if v)
        back = min((p[x] / v if v > 0 else (1 - p[x]) / -v) for x, v in zip(held, move, strict=True) if v)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = ahead if draw * (ahead + back) < back else -back
        for x, v in zip(held, move, strict=True):
            p[x] += step * v
            if p[x] < eps or p[x] > 1 - eps:
                p[x] = float(p[x] > 0.5)
        held = [x for x in held if 0 < p[x] < 1]


_UNIT = "doc_id long, h long, place long, source string, size long, ix int, rows long, source_size long, target double, whole long, p double"


def _settle(seed: int, level: int, last: bool):
    def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("h", "ascending"), ("size", "ascending")])
        rng = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        order = np.lexsort((rng.random(len(rows)), -rows["size"].to_numpy()))  # the long ones first, so that short ones land
        p = np.empty(len(rows))
        p[order] = flight(rows["size"].to_numpy()[order], rows["p"].to_numpy()[order], rng)
        if last:
            p = (rng.random(len(p)) < p).astype(float)
        rows = rows.drop_columns("block")
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))

    return settle


def take_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, seed: int = 1) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, copies) of every row; h is a hash of the text, copies at most ``most_repeats``."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.xxhash64(text).alias("h"), "source", size_in_words(F.col("text")).alias("size"))
    # in an order of their own that puts equal rows next to each other, so that a block of every n-th row takes its share of them
    units = materialize(numbered(plain, "source", "xxhash64(doc_id, h)", "doc_id", "h", "size", name="place"), "units")
    sources = materialize(source_targets(units, weights, most_repeats), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    s = sources.withColumnRenamed("source", "of")
    planned = (
        units.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(rate - whole, F.lit(0.0)))
        .select(*[c.split()[0] for c in _UNIT.split(", ")])
    )
    largest = sources.agg(F.max("rows")).first()[0] or 0
    blocks = lambda level: F.ceil(F.col("rows") / (BLOCK_ROWS * FAN_IN**level)).cast("long")
    block = lambda level: F.col("place") % blocks(0) % blocks(level)

    level, settled = 0, []
    while True:
        last = largest <= BLOCK_ROWS * FAN_IN**level
        done = materialize(planned.withColumn("block", block(level)).groupBy("ix", "block").applyInArrow(_settle(seed, level, last), _UNIT), "settled")
        settled.append(done.where("p = 0 or p = 1"))
        if last:
            break
        planned, level = done.where("p > 0 and p < 1"), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "h", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    taken = take_counts(docs, weights, most_repeats, seed).groupBy("doc_id", "h", "source").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("h").alias("_th"), F.col("source").alias("_of"), "_copies", "_rows")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.col("doc_id").alias("_doc"), F.col("source").alias("_source"))
    found = keyed.join(taken, (F.col("_h") == F.col("_th")) & F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_source").eqNullSafe(F.col("_of")))
    # equal rows share their copies: as evenly as whole numbers allow
    nth = F.row_number().over(Window.partitionBy("_h", "_doc", "_source").orderBy("_h"))
    own = F.expr("_copies div _rows") + (nth <= F.col("_copies") % F.col("_rows")).cast("long")
    repeated = found.withColumn("_own", own).where("_own > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own"))))
    return repeated.select("row.*")
