"""Periodic runs: stretches of words that repeat with a smallest period, by maximal pairs in the tree of LCP intervals.

A maximal pair is two places of one text with the same L words whose words before and after differ. If their distance p is
at most L, the stretch from the first place over p + L words has period p, and it cannot be extended either way, just because
the pair is maximal; so these pairs are the runs, each once for every multiple of its smallest period.

A task sorts the suffixes of its texts by doubling, from ranks of 6 words on (a run of at least 12 words has a pair of at
least 6), keeps the suffixes whose nearest equal start is near enough for a run, and walks the tree of LCP intervals from its
leaves. A node merges its children's places, the smaller into the larger; per node the places are sorted and cut into blocks
of one left word, so a search skips a block of the own left word in one step and looks at a constant number of places for
every pair it reports. The runs' exponents add up to a multiple of the text's length at most, so that the whole costs
n log n, however the text repeats.

Each text is one row and is handled whole by a task, without any shuffle; about 1 MB of text is in numpy arrays at once.

Defined cases: null and empty texts have no words and no runs; words are runs of bytes that are not ASCII white space, equal
byte for byte (as 64-bit hashes); repeated rows get equal results; an empty table gives an empty result; other columns are
carried along by ``with_runs`` and never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES_ONLY, shingles, words

LEAST_LENGTH = 12
SEED = LEAST_LENGTH // 2
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _repeating_texts(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Numbers of the texts that have some SEED words in a row twice."""
    if len(hashes) < 2 * SEED:
        return np.zeros(0, dtype=np.int64)
    inside = text_of[: len(hashes) - SEED + 1] == text_of[SEED - 1 :]
    keys, owners = shingles(hashes, SEED)[inside], text_of[: len(inside)][inside]
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    return np.unique(owners[1:][(keys[1:] == keys[:-1]) & (owners[1:] == owners[:-1])])


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp): the suffixes that share SEED words or more with another one, in order; lcp[i] is of places i - 1 and i.

    ids are ranks of the words of one text. Past its end the text is padded by a least word, so only whole windows can be
    equal. Ranks of 1, 2, 4 and 6 words are of all places; from there on only suffixes that are not alone yet are ranked.
    """
    n = len(ids)
    pair = lambda a, b: _ranks(a * (n + SEED + 1) + b)
    one = np.append(ids + 1, np.zeros(SEED - 1, dtype=np.int64))
    two = pair(one[:-1], one[1:])
    four = pair(two[:-2], two[2:])
    six = pair(four[:n], two[4 : n + 4])
    # the rank of a group is the number of suffixes before it, so that a group can be split in place
    counts = np.bincount(six)
    current = (np.cumsum(counts) - counts)[six]
    live = all_live = np.flatnonzero(counts[six] > 1)
    levels, k = {SEED: current}, SEED
    while len(live):
        ahead = np.where(live + k < n, current[np.minimum(live + k, n - 1)] + 1, 0)
        keys = current[live] * (n + 2) + ahead
        at = np.argsort(keys, kind="stable")
        live, keys = live[at], keys[at]
        group, where = current[live], np.arange(len(live))
        opens = lambda x: np.append(True, x[1:] != x[:-1])
        base, own = (np.maximum.accumulate(np.where(opens(x), where, 0)) for x in (group, keys))
        current = current.copy()
        current[live] = group + own - base
        k *= 2
        levels[k] = current
        start = opens(keys)
        live = live[~(start & np.append(start[1:], True))]
    order = all_live[np.argsort(current[all_live], kind="stable")]
    return order, _lcp(order, levels, ids)


def _lcp(order: np.ndarray, levels: dict[int, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Common words of each suffix with the one before it in order, 0 where these are fewer than SEED: by halving steps."""
    n = len(ids)
    a, b = order[:-1].copy(), order[1:].copy()

    def step(rank: np.ndarray, k: int) -> None:
        same = (np.maximum(a, b) < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a[same] += k
        b[same] += k

    for k in sorted(levels, reverse=True):
        step(levels[k], k)
    for _ in range(SEED - 1):
        step(ids, 1)
    same = a - order[:-1]
    return np.append(np.zeros(min(1, len(order)), dtype=np.int64), np.where(same >= SEED, same, 0))


def _near(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only suffixes whose nearest equal start is not further away than their longest common prefix; the others are in no run's pair."""
    group = np.cumsum(lcp == 0)
    at = np.lexsort((order, group))
    place, of = order[at], group[at]
    gap = np.full(len(order) + 1, np.iinfo(np.int64).max)
    gap[1:-1] = np.where(of[1:] == of[:-1], np.diff(place), gap[1:-1])
    nearest = np.empty(len(order), dtype=np.int64)
    nearest[at] = np.minimum(gap[:-1], gap[1:])
    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    keep = np.flatnonzero(nearest <= longest)
    if len(keep) == 0:
        return order[:0], lcp[:0]
    cut = np.minimum.reduceat(lcp[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
    return order[keep], cut


class _Places:
    """Sorted places of a tree node, and those of them whose left word differs from that of the place before."""

    __slots__ = ("at", "turns")

    def __init__(self, place: int):
        self.at, self.turns = [place], [place]

    def add(self, place: int, left: list[int]) -> None:
        at = bisect_left(self.at, place)
        if at == 0 or left[self.at[at - 1]] != left[place]:
            insort(self.turns, place)
        if at < len(self.at):
            after = self.at[at]
            spot = bisect_left(self.turns, after)
            had = spot < len(self.turns) and self.turns[spot] == after
            if left[after] != left[place]:
                if not had:
                    self.turns.insert(spot, after)
            elif had:
                del self.turns[spot]
        self.at.insert(at, place)

    def others(self, place: int, reach: int, left: list[int]) -> Iterator[int]:
        """Places at most ``reach`` away with another left word."""
        own, at = left[place], bisect_left(self.at, place - reach)
        while at < len(self.at) and (there := self.at[at]) <= place + reach:
            if left[there] != own:
                yield there
                at += 1
            else:
                turn = bisect_right(self.turns, there)
                if turn == len(self.turns):
                    return
                at = bisect_left(self.at, self.turns[turn], at)


def maximal_pairs(order: list[int], lcp: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first place, distance, words) of the maximal pairs whose distance is at most their number of words."""
    stack: list[tuple[int, _Places]] = []  # (lcp of the open node, its places so far), outermost first

    def joined(a: _Places, b: _Places, depth: int) -> Iterator[tuple[int, int, int]]:
        small, large = (a, b) if len(a.at) < len(b.at) else (b, a)
        for place in small.at:
            for other in large.others(place, depth, left):
                yield min(place, other), abs(place - other), depth
        for place in small.at:
            large.add(place, left)
        merged.append(large)

    merged: list[_Places] = []
    for i in range(len(order)):
        node = _Places(order[i])
        after = lcp[i + 1] if i + 1 < len(order) else 0
        # nodes deeper than the common prefix with the next suffix are complete
        while stack and stack[-1][0] >= after:
            depth, places = stack.pop()
            yield from joined(places, node, depth)
            node = merged.pop()
        if after:
            stack.append((after, node))


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text given as ranks of its words, by start, then period."""
    if len(ids) < LEAST_LENGTH:
        return []
    order, lcp = _near(*_suffixes(ids))
    left = [-1, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}
    for start, period, words_ in maximal_pairs(order.tolist(), lcp.tolist(), left):
        length = period + words_
        if length >= LEAST_LENGTH:
            found[start, length] = min(period, found.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words outside all runs but for each run's first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _results(texts: pa.Array) -> pa.Array:
    out: list[dict] = []
    for w in words(texts, lower=False, inside=SPACES_ONLY):
        n_texts = len(w.bounds) - 1
        text_of = np.repeat(np.arange(n_texts), np.diff(w.bounds))
        repeating = set(_repeating_texts(w.hashes, text_of).tolist())
        data = w.data.tobytes()
        for t in range(n_texts):
            a, b = int(w.bounds[t]), int(w.bounds[t + 1])
            spans, runs, keep = range(a, b), [], None
            if t in repeating:
                runs = runs_of(_ranks(w.hashes[a:b]))
                if runs:
                    keep = kept_words(b - a, runs)
                    spans = (a + np.flatnonzero(keep)).tolist()
            whole = data[int(w.offsets[t]) : int(w.offsets[t + 1])].split() if keep is None else [data[w.starts[i] : w.ends[i]] for i in spans]
            out.append({"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": b" ".join(whole).decode("utf-8", "replace")})
    return pa.array(out, pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())]))


def periodic_runs(text: Column) -> Column:
    """Struct of a text's runs, by start and period, and of the text without the repeats: kept words joined by one space."""
    return F.arrow_udf(_results, RESULT)(text)


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with its runs and collapsed text."""
    both = docs.select(F.struct(*docs.columns).alias("row"), periodic_runs(F.col(text)).alias("found"))
    return both.select("row.*", F.col("found.runs").alias(runs), F.col("found.collapsed").alias(collapsed))


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then period; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.struct(best["start"].alias("start"), (-best["order"]).alias("length"), best["period"].alias("period"))
