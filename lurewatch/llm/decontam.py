"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A text contains an item if some run of its words is within floor(0.2 * n) word edits of the item's n words
(words are lower-cased runs of letters and digits). The walk of Chakraborty, Goldenberg and Koucky copies the
word under a pointer and moves the pointer on if a random bit of (step, word) says so; two texts few edits apart
get outputs of small Hamming distance. Each LSH table samples positions of one such output. Long items are looked up by
equal pieces of at most LONGEST words, of which one at least has no more than its share of the edits. Pieces (items, if
not long) are graded by length, and a window is as long as the pieces of its grade. The number of walks of a grade
follows from the recall measured on fully edited pieces of that grade inside other text, found and embedded as in
production, until the target is reached; if it cannot be, that is an error. Windows start where the text and an item share a short run of words:
with at most floor(0.2 * n) edits some run of that length has to be untouched, so no window that could pass is left
out. Candidates are verified by semi-global edit distance.

Benchmark items come to the driver in blocks of bounded size (a single item may be larger), each block is one pass
over the texts. A task holds one run of texts and embeds a bounded number of window words at a time.

Defined cases: null and empty texts and items contain and match nothing; items without words are skipped; items
without an id count like others and are reported with a null id; repeated rows each get their own result rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, shingles, words
from .neardup import match_rows

EDIT_SHARE = 0.2
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
SAMPLED = 2  # positions per table
TABLES_PER_WALK = 3
MOST_WALKS = 200
LONGEST = 160  # words of a piece
MEASURED = 300  # edited items by which a grade's recall is measured; few items are edited several times each
HELD_WORDS = 4 << 20  # words of windows embedded, and of texts kept, at a time
_FILTER_BITS = 22


def _allowed(n: int) -> int:
    return int(EDIT_SHARE * n + 1e-9)


def _run_length(n: int) -> int:
    """Words of the longest run that is surely untouched in n words with the allowed edits, at most 3."""
    k = _allowed(n)
    return min(3, -(-(n - k) // (k + 1)))


def cgk(windows: np.ndarray, keep: np.ndarray, walk: int) -> np.ndarray:
    """The words that one CGK walk over every row of ``windows`` (padded with 0) copies at the sorted steps ``keep``."""
    rows, width = windows.shape
    out = np.empty((len(keep), rows), dtype=np.uint64)
    padded = np.append(windows.ravel(), np.uint64(0))
    at = np.arange(rows) * width
    stop = at + width
    kept = 0
    for t in range(int(keep[-1]) + 1):
        word = padded[np.minimum(at, stop)] if t >= width else padded[at]
        if t >= width:
            word[at >= stop] = 0
        if t == keep[kept]:
            out[kept] = word
            kept += 1
        salt = np.uint64((0x9E3779B97F4A7C15 * (walk * 65_537 + t + 1)) & (2**64 - 1))
        at += (((word ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(at.dtype)
    return out


@dataclass
class Grade:
    """Pieces of similar length with their LSH tables."""

    items: np.ndarray  # indexes
    width: int  # words of a window: twice the least length, of which a walk of as many steps reads about half
    steps: list[np.ndarray]  # of each walk: the sorted steps that its tables sample
    places: list[np.ndarray]  # of each walk: (table, SAMPLED) places in these
    tables: list[list[tuple[np.ndarray, np.ndarray]]]  # of each walk and table: sorted keys, their pieces


@dataclass
class Items:
    """Benchmark items: words, pieces, runs by which windows are found, and grades of pieces."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    item_of: list[int]  # of each piece
    offset_of: list[int]  # of each piece in its item
    grade_of: np.ndarray  # of each piece
    grades: list[Grade]
    runs: dict[int, tuple[np.ndarray, np.ndarray]]  # run length -> sorted hashes, owner (piece, offset) as piece << 32 | offset


def _keys(embedded: np.ndarray, places: np.ndarray) -> np.ndarray:
    key = np.zeros(embedded.shape[1], dtype=np.uint64)
    for p in places:
        key = mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + embedded[p] + np.uint64(1))
    return key


def _matrix(parts: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(parts), width), dtype=np.uint64)
    for row, p in zip(out, parts, strict=True):
        row[: min(width, len(p))] = p[:width]
    return out


def _edited(tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A copy with as many random edits as are allowed."""
    out = tokens.tolist()
    for _ in range(_allowed(len(tokens))):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0:
            out[at] = int(rng.integers(1, 2**63))
        elif kind == 1:
            out.insert(at, int(rng.integers(1, 2**63)))
        elif len(out) > 1:
            out.pop(at)
    return np.array(out, dtype=np.uint64)


def _starts(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where windows for the item start in a text: a shared run's place less the run's place in the item."""
    q = _run_length(len(item))
    own = shingles(item, q)
    order = np.argsort(own, kind="stable")
    h = shingles(text, q)
    left, right = np.searchsorted(own[order], h, "left"), np.searchsorted(own[order], h, "right")
    return np.unique([max(at - int(order[k]), 0) for at in np.flatnonzero(right > left) for k in range(left[at], right[at])]).astype(np.int64)


def _grade(tokens: list[np.ndarray], own: np.ndarray, target_recall: float, rng: np.random.Generator) -> Grade:
    """Tables of one grade: walks are added until the recall on edited items inside other text reaches the target."""
    least = min(len(tokens[i]) for i in own)
    g = Grade(own, 2 * least, [], [], [])
    every = _matrix([tokens[i] for i in own], max(len(tokens[i]) for i in own))
    sample = np.resize(rng.permutation(own), MEASURED)
    planted = []
    for i in sample:
        around = [rng.integers(1, 2**63, n).astype(np.uint64) for n in (20, g.width + 20)]
        text = np.concatenate([around[0], _edited(tokens[i], rng), around[1]])
        planted.append([text[s:] for s in _starts(tokens[i], text)])
    # an item without windows had all its runs edited away, which the allowed edits cannot do
    rows, owner = [w for p in planted for w in p], np.repeat(np.arange(len(planted)), [len(p) for p in planted])
    windows, items = _matrix(rows, g.width), _matrix([tokens[i] for i in sample], every.shape[1])
    missed = np.ones(len(sample), dtype=bool)
    while len(g.steps) < 4 or missed.mean() > 1 - target_recall:
        walk = len(g.steps)
        if walk >= MOST_WALKS:
            raise RuntimeError(f"decontamination: recall {1 - missed.mean():.3f} on items of {least} words and more after {walk} walks, wanted {target_recall}")
        drawn = np.sort(rng.integers(0, max(1, 2 * least), size=(TABLES_PER_WALK, SAMPLED)), axis=-1)
        steps = np.unique(drawn)
        places = np.searchsorted(steps, drawn)
        g.steps.append(steps)
        g.places.append(places)
        embedded, known, asked = (cgk(m, steps, walk) for m in (windows, items, every))
        for p in places:
            missed[owner[_keys(embedded, p) == _keys(known, p)[owner]]] = False
        tables = []
        for p in places:
            keys = _keys(asked, p)
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], own[order]))
        g.tables.append(tables)
    return g


def build_items(ids: list[int | None], texts: list[str | None], target_recall: float = 0.99, seed: int = 7) -> Items:
    """LSH tables of the items, grade by grade."""
    kept = [(ids[w.first + x], w.hashes[w.bounds[x] : w.bounds[x + 1]]) for w in words(pa.array(texts, pa.string())) for x in range(len(w.offsets) - 1) if w.bounds[x] < w.bounds[x + 1]]
    tokens = [t for _, t in kept]
    cuts = [(i, int(a), int(b)) for i, t in enumerate(tokens) for ends in [np.linspace(0, len(t), -(-len(t) // LONGEST) + 1).astype(int)] for a, b in zip(ends, ends[1:], strict=False)]
    pieces = [tokens[i][a:b] for i, a, b in cuts]
    sizes = np.array([len(t) for t in pieces], dtype=np.int64)
    names, grade_of = np.unique(np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.5)).astype(np.int64), return_inverse=True) if len(sizes) else (np.zeros(0, int), np.zeros(0, int))
    rng = np.random.default_rng(seed)
    grades = [_grade(pieces, np.flatnonzero(grade_of == c), target_recall, rng) for c in range(len(names))]
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, t in enumerate(pieces):
        q = _run_length(len(t))
        runs[q] += [(h, i << 32 | at) for at, h in enumerate(shingles(t, q).tolist())]
    sorted_runs = {}
    for q, found in runs.items():
        found.sort()
        sorted_runs[q] = (np.array([h for h, _ in found], dtype=np.uint64), np.array([o for _, o in found], dtype=np.int64))
    return Items([i for i, _ in kept], tokens, [i for i, _, _ in cuts], [a for _, a, _ in cuts], grade_of, grades, sorted_runs)


def best_within(item: list[int], text: list[int], most: int) -> tuple[int, int]:
    """(least edits between the item and a run of the text, end of that run); edits are most + 1 if there is none."""
    n = len(item)
    match_at = match_rows(item)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best, end = mask, 0, n, most + 1, -1
    for j, x in enumerate(text):
        match = match_at(x, 0, n)
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        plus, minus = down | (mask & ~(diagonal | up)), diagonal & up
        now += bool(plus & top) - bool(minus & top)
        if now < best:
            best, end = now, j + 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = minus | (mask & ~(diagonal | plus)), diagonal & plus
    return best, end


@dataclass
class _Held:
    """A run of texts: its words, the bounds of its texts and the number of its first text."""

    hashes: np.ndarray
    bounds: np.ndarray
    first: int


class Matcher:
    """Finds items in texts; built once per task."""

    def __init__(self, items: Items):
        self.items = items
        self.filters = {}
        for q, (hashes, _) in items.runs.items():
            table = np.zeros(1 << _FILTER_BITS, dtype=bool)
            table[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[q] = table
        self.item_lists = [t.tolist() for t in items.tokens]

    def windows(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grades, starts and texts of the windows worth embedding."""
        found = []
        for q, (known, owners) in self.items.runs.items():
            h = shingles(hashes, q)
            at = np.flatnonzero(self.filters[q][h >> np.uint64(64 - _FILTER_BITS)])
            left, right = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            count = right - left
            hit = np.repeat(at, count)
            which = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            text = np.searchsorted(bounds, hit, "right") - 1
            keep = hit + q <= bounds[text + 1]  # a run inside one text
            start = np.maximum(hit - (owners[which] & 0xFFFFFFFF), bounds[text])
            found.append((self.items.grade_of[owners[which] >> 32][keep] << 40 | start[keep]).astype(np.int64))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        starts = both & (1 << 40) - 1
        return both >> 40, starts, np.searchsorted(bounds, starts, "right") - 1

    def candidates(self, grade: int, windows: list[np.ndarray]) -> set[tuple[int, int]]:
        """(number of the window, piece index) of the pairs that share a table entry."""
        g, found = self.items.grades[grade], set()
        rows = max(1, HELD_WORDS // g.width)
        for first in range(0, len(windows), rows):
            matrix = _matrix(windows[first : first + rows], g.width)
            for walk, (steps, places) in enumerate(zip(g.steps, g.places, strict=True)):
                embedded = cgk(matrix, steps, walk)
                for (known, owners), p in zip(g.tables[walk], places, strict=True):
                    keys = _keys(embedded, p)
                    left, right = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                    for x in np.flatnonzero(right > left).tolist():
                        found.update((first + x, i) for i in owners[left[x] : right[x]].tolist())
        return found

    def matches(self, texts: pa.Array) -> dict[int, dict[int, tuple[float, int]]]:
        """Index of a text -> item index -> (similarity, word where the run ends), for the texts with matches."""
        found: dict[int, dict[int, tuple[float, int]]] = defaultdict(dict)
        if not self.item_lists:
            return found
        held: list[tuple[_Held, int, int, int]] = []  # texts, text in them, grade, start
        kept = 0
        for w in words(texts):
            own = _Held(w.hashes, w.bounds, w.first)
            grades, starts, text = self.windows(w.hashes, w.bounds)
            held += [(own, *x) for x in zip(text.tolist(), grades.tolist(), starts.tolist(), strict=True)]
            kept += len(w.hashes) if len(starts) else 0
            if len(held) >= 8192 or kept >= HELD_WORDS:
                self._flush(held, found)
                kept = 0
        self._flush(held, found)
        return found

    def _flush(self, held: list[tuple[_Held, int, int, int]], found: dict[int, dict[int, tuple[float, int]]]) -> None:
        """Embed, look up and verify the windows held so far."""
        by_grade: dict[int, list[tuple[_Held, int, int]]] = defaultdict(list)
        tried: set[tuple[int, int, int, int]] = set()
        for own, text, grade, start in held:
            by_grade[grade].append((own, text, start))
        for grade, windows in sorted(by_grade.items()):
            width = self.items.grades[grade].width
            parts = [own.hashes[start : min(start + width, own.bounds[text + 1])] for own, text, start in windows]
            for x, piece in sorted(self.candidates(grade, parts)):
                own, text, start = windows[x]
                i = self.items.item_of[piece]
                item, offset = self.item_lists[i], self.items.offset_of[piece]
                n, most = len(item), _allowed(len(item))
                step = most // 2 + 1  # places so near each other are one
                cell = (start - offset) // step
                known = found[own.first + text].get(i) if own.first + text in found else None
                if (id(own), text, i, cell) in tried or known and known[0] == 1.0:
                    continue
                tried.add((id(own), text, i, cell))
                low, high = int(own.bounds[text]), int(own.bounds[text + 1])
                at = max(low, cell * step - most)
                near = own.hashes[at : min(high, max(low, cell * step + step + n + 2 * most))].tolist()
                if sum(map(set(near).__contains__, item)) < n - most:  # fewer shared words than any match has
                    continue
                edits, end = best_within(item, near, most)
                if edits <= most and (not known or 1 - edits / n > known[0]):
                    found[own.first + text][i] = (1 - edits / n, at - low + end)
        held.clear()


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[Items]:
    rows = benchmark.select("item_id", "text")
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    blocks = max(-(-whole.n // block_items), -(-whole.size // BLOCK_BYTES))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield build_items([r.item_id for r in own], [r.text for r in own])


_FOUND = "doc_id long, item_id long, similarity double, end_word long"


def _finder(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for b in batches:
            ids = b.column(0)
            rows = [(ids[i].as_py(), items.ids[k], s, end) for i, own in sorted(matcher.matches(b.column(1)).items()) for k, (s, end) in sorted(own.items())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "end_word"])

    return find


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, end_word) for each document and item that it contains."""
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for n, items in enumerate(_blocks(benchmark, block_items)):
        part = docs.select("doc_id", "text").mapInArrow(_finder(items), _FOUND)
        out = out.unionByName(part) if n else part
    return out


def contaminated(items: Items, text: Column) -> Column:
    """Whether a text contains an item; the row's other columns stay in the JVM."""

    def flags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items)
        for texts in batches:
            hit = np.zeros(len(texts), dtype=bool)
            hit[list(matcher.matches(texts))] = True
            yield pa.array(hit)

    flags.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(flags, T.BooleanType())(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no benchmark item, with or without an id."""
    for items in _blocks(benchmark, block_items):
        docs = docs.where(~contaminated(items, F.col("text")))
    return docs
