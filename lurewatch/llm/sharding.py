"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups of equal texts, ordered by their least id, are cut into contiguous shards so that the largest shard is as
small as possible: binary search for the smallest capacity that a greedy pass can fill in the given number of
shards. The pass runs on the driver over sums of id ranges, a bounded number of them; wherever a cut could fall
into a range, a Spark job splits that range, until every cut falls between single groups, so the result is exact.

Defined cases: null text has size 1 like empty text and is in one group with it; repeated rows stay together;
different texts under one id count as one group; a null id comes first; an empty table gives an empty result;
other columns are not read. With fewer groups than shards the later shards are empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RANGES = 8192  # id ranges that the driver holds
SPLIT_AT_ONCE = 128
SLOT_IDS = 4096  # ids numbered by one task at a time


def greedy_cuts(sums: list[int], capacity: int, parts: int) -> list[int] | None:
    """Indexes at which parts start, each filled as far as the capacity allows; None if more parts are needed."""
    ends = list(accumulate(sums))
    cuts, at, base = [], 0, 0
    for _ in range(parts):
        if at == len(sums):
            break
        to = bisect_right(ends, base + capacity)
        if to == at:
            return None
        cuts.append(at)
        at, base = to, ends[to - 1]
    return cuts if at == len(sums) else None


def smallest_capacity(sums: list[int], parts: int) -> int:
    """Smallest capacity with which ``greedy_cuts`` succeeds."""
    low, high = max([-(-sum(sums) // parts), *sums], default=0), sum(sums)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sums, middle, parts) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _open_spans(ranges: list[tuple[int, int, int]], low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Index spans of ranges into which a cut could fall for a capacity between low and high.

    A greedy cut moves forward with the capacity and with the cut before it, so following the least and the
    furthest cut bounds all; a cut never falls inside a single group (a range whose ends are one id).
    """
    ends = list(accumulate(s for _, _, s in ranges))
    total = ends[-1]
    least = furthest = 0
    spans = []
    for _ in range(parts - 1):
        at = bisect_right(ends, least + low)
        if at >= len(ranges):
            break
        least = ends[at] - ranges[at][2]
        to = bisect_right(ends, furthest + high)
        if to >= len(ranges):
            furthest, to = total, len(ranges) - 1
        else:
            furthest = ends[to] - ranges[to][2] if ranges[to][0] == ranges[to][1] else furthest + high
        spans.append((at, to))
    return spans


def minimax_starts(units: DataFrame, parts: int) -> list[int]:
    """First ids of the second and later parts, for units (first, weight) with distinct first ids."""

    def summed(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        each = max(4, RANGES // len(spans))
        cell = F
        for n, (a, b) in enumerate(spans):
            # doubles keep the order of any ids; the ends of the cells are read back, so their rounding does not matter
            own = F.col("first").between(F.lit(a), F.lit(b))
            part = F.floor((F.col("first").cast("decimal(20,0)") - F.lit(a)).cast("double") / F.lit(float(-(-(b - a + 1) // each)))) if b - a >= 2**62 else F.floor((F.col("first") - F.lit(a)) / F.lit(-(-(b - a + 1) // each)))
            cell = cell.when(own, F.least(part, F.lit(each - 1)) + F.lit(n * each))
        found = units.groupBy(cell.alias("cell")).agg(F.min("first").alias("a"), F.max("first").alias("b"), F.sum("weight").alias("s")).collect()
        return sorted((r.a, r.b, int(r.s)) for r in found if r.cell is not None)

    edge = units.agg(F.min("first").alias("a"), F.max("first").alias("b")).first()
    if edge.a is None:
        return []
    ranges = summed([(edge.a, edge.b)])
    while True:
        sums = [s for _, _, s in ranges]
        high = smallest_capacity(sums, parts)
        low = max([-(-sum(sums) // parts), *(s for a, b, s in ranges if a == b)])
        doubtful = sorted({i for a, b in _open_spans(ranges, low, high, parts) for i in range(a, b + 1) if ranges[i][0] != ranges[i][1]})
        if not doubtful:
            cuts = greedy_cuts(sums, high, parts)
            return [ranges[i][0] for i in cuts[1:]]
        # the largest first: each gets at least two parts, so this ends
        split = set(sorted(doubtful, key=lambda i: -ranges[i][2])[:SPLIT_AT_ONCE])
        fine = summed([ranges[i][:2] for i in sorted(split)])
        ranges = sorted([r for i, r in enumerate(ranges) if i not in split] + fine)


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; slots count up from 0 in each shard by id."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = materialize(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("g")), "rows")
    lowest = rows.agg(F.min("doc_id")).first()[0]
    null_id = F.lit((lowest or 0) - 1 if (lowest or 0) > -(2**63) else lowest).cast("long")
    groups = materialize(rows.groupBy("g").agg(F.coalesce(F.min("doc_id"), null_id).alias("first"), F.sum("size").alias("weight")), "groups")
    units = groups.groupBy("first").agg(F.sum("weight").alias("weight"))
    starts = minimax_starts(materialize(units, "sizes"), shards)
    shard: Column = F.lit(0)
    for s in starts:
        shard = shard + (F.col("first") >= F.lit(s)).cast("int")
    placed = rows.join(groups.select("g", shard.alias("shard")), "g").withColumn("cell", F.floor(F.coalesce("doc_id", null_id) / F.lit(SLOT_IDS)).cast("long"))
    placed = materialize(placed, "placed")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "g")) - 1
    slotted = placed.withColumn("nth", nth).join(offsets, ["shard", "cell"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
