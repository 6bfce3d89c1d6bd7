"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's words are lower-cased runs of letters and digits. Its 5-word shingles get an occurrence label (first,
second, ... time in the text); each of several hash functions picks the two smallest labelled shingles, and a
sketch is that pair in text order, so that sketches agree where texts agree up to few edits. Texts that share a
sketch are candidates, and a link is a candidate pair whose word sequences have an edit similarity
(1 - distance / longer length) of at least 0.8, found by bit-parallel alignment inside a band. A class is a
connected component of links and of equal word sequences.

The number of sketches follows from the wanted recall at the threshold itself: words changed here and there in a
fifth of all places leave 0.8 ** 5 of the shingles, so two sketches agree with a probability of 0.03 to 0.04, and 80
of them find such a pair with one of 0.92 or more; nearer pairs are found more surely. In texts of up to SHORT words the
shingles left vary more from pair to pair, so these have MOST_SKETCHES, of which the first 80 are those of longer texts.

Each text is first compared with one leader: that of most of its buckets, where a bucket's leader is the member whose
sketches are commonest (the centre of a group of copies). Links to leaders make the first classes. A bucket that then
still holds members of several classes is open, and gets a leader for each band of lengths once. Open buckets of up to SMALL_BUCKET members compare all pairs across
classes. In larger ones all pairs across classes are compared by their prints first: parities of the hashed words of a text,
of which an edit flips two at most, so that no pair of the similarity is lost (``_print_of``). Each bucket is a group, and
tells a pair once, in the least of the buckets that the two share. The members of buckets of more than LARGE_BUCKET, which
no group holds, meet by an exact join of all of them, which loses no pair of the similarity either: texts
that near share so many runs of three words that some are among the rarest of both (``_sharing``). Texts whose rarest runs
are still those of many texts, as where a passage is most of the text, meet by runs of two words, then by single words,
without any limit on how many have them. So every pair of texts of one bucket is aligned, in the same class already, or too
far apart by what the two share.

Defined cases: null text is empty text; texts without words are equal if their bytes are; texts of fewer than
five words have no shingles and only match equal word sequences; repeated rows and repeated ids are members of
their texts' classes; an empty table gives an empty result; other columns are not read. A null id stays null and
represents a class only if it has no other id. Words are compared by 32-bit hashes when aligned. A very long text
is aligned in memory of a few times its length. A hot leader, root or node is a skewed join key of small rows, which
adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, shingles, words
from .components import components

WORDS_IN_SHINGLE = 5
SKETCHES = 80
MOST_SKETCHES = 120  # of texts of up to SHORT words
SHORT = 256
SIMILARITY = 0.8
SMALL_BUCKET = 8  # members that are compared pair by pair
LARGE_BUCKET = 4096  # members that one group compares by their prints
GRAMS = (3, 2, 1)  # words of the runs by which the members of still larger buckets meet, one after another
HEAVY = 32  # texts of a run from which they meet by shorter runs instead
PRINT_BITS = (256, 8192)  # of a print: the least power of two that is twice the words, between these
LONG = 4096  # words from which an alignment keeps positions instead of bit rows
_SEEDS = mix64(np.arange(1, 2 * MOST_SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _occurrences(h: np.ndarray) -> np.ndarray:
    """0 for a value's first occurrence, 1 for its second, ..."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    rank = np.empty(len(s), dtype=np.uint64)
    rank[order] = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    return rank


def _labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes that differ by occurrence too."""
    return mix64(h + _occurrences(h) * np.uint64(0xA24BAED4963EE407))


def order_minhash(hashes: np.ndarray, n: int | None = None, k: int = WORDS_IN_SHINGLE) -> list[int]:
    """The first n sketches of one text's word hashes, by default as many as its length asks for; none for fewer than k words."""
    n = n or (MOST_SKETCHES if len(hashes) <= SHORT else SKETCHES)
    h = shingles(hashes, k)
    if not len(h):
        return []
    labelled = _labelled(h)
    out = np.empty(n, dtype=np.uint64)
    block = max(1, (1 << 18) // len(h))
    for at in range(0, n, block):
        s = slice(at, min(n, at + block))
        y = (labelled[None, :] ^ _SEEDS[s, None]) * (_SEEDS[MOST_SKETCHES:][s, None] | np.uint64(1))
        rows = np.arange(y.shape[0])
        first = y.argmin(axis=1)
        y[rows, first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = y.argmin(axis=1) if len(h) > 1 else first
        out[s] = mix64(h[np.minimum(first, second)] * np.uint64(0xC2B2AE3D27D4EB4F) + h[np.maximum(first, second)])
    return out.view(np.int64).tolist()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2)
        nodes, sizes, sketches = [], [], []
        for w in words(texts):
            at = np.arange(len(w.hashes), dtype=np.uint64) - np.repeat(w.bounds[:-1], np.diff(w.bounds)).astype(np.uint64)
            sums = [np.zeros(len(w.hashes) + 1, dtype=np.uint64) for _ in (0, 1)]
            np.cumsum(mix64(w.hashes + at * np.uint64(0x9E3779B97F4A7C15)), out=sums[0][1:])
            np.cumsum(mix64(w.hashes ^ mix64(at + np.uint64(1))), out=sums[1][1:])
            digests = np.column_stack([s[w.bounds[1:]] - s[w.bounds[:-1]] for s in sums])
            for i in range(len(w.offsets) - 1):
                x, y = w.bounds[i], w.bounds[i + 1]
                if x == y:
                    nodes.append(hashlib.blake2b(w.data[w.offsets[i] : w.offsets[i + 1]].tobytes(), digest_size=16).digest())
                else:
                    nodes.append(digests[i].tobytes())
                sizes.append(y - x)
                sketches.append(order_minhash(w.hashes[x:y]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "h", "node", "n", "sketches"])


def _bit_rows(a: list[int]) -> Callable[[int, int, int], int]:
    """match(word, at, width): bit p is set where a[at + p] is the word, for short texts one number per word."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i

    def match(x: int, at: int, width: int) -> int:
        bits = where.get(x, 0)
        return (bits >> at if at >= 0 else bits << -at) & ((1 << width) - 1)

    return match


def _positions(a: list[int]) -> Callable[[int, int, int], int]:
    """The same from lists of positions: memory in proportion to the text, for long texts."""
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)

    def match(x: int, at: int, width: int) -> int:
        found = where.get(x)
        if not found:
            return 0
        near = found[bisect_left(found, at) : bisect_left(found, at + width)]
        if len(near) > 16:
            row = np.zeros(width, dtype=bool)
            row[np.array(near) - at] = True
            return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
        bits = 0
        for p in near:
            bits |= 1 << (p - at)
        return bits

    return match


def match_rows(a: list[int]) -> Callable[[int, int, int], int]:
    """How alignments look up where a word stands in ``a``."""
    return (_bit_rows if len(a) < LONG else _positions)(a)


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else most + 1.

    Bit-parallel over a band: bit p of column j stands for row j - low + p, and the vectors slide down by one row
    with each column, so a step works on numbers of the band's width.
    """
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    if gap > most:
        return most + 1
    low = (most - gap) // 2
    width = 2 * low + gap + 1
    mask = (1 << width) - 1
    match_at = match_rows(a)
    down = (1 << low) - 1  # rows above the text's start: each one less than the row above
    up = mask & ~down
    goal, distance = low + gap, gap
    for j, x in enumerate(b, 1):
        match = match_at(x, j - low - 1, width)
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right_up = down | (mask & ~(diagonal | up))
        right_down = diagonal & up
        if not diagonal >> goal & 1:
            distance += 1
            if distance > most:
                return most + 1
        diagonal >>= 1
        up = right_down | (mask & ~(diagonal | right_up))
        down = diagonal & right_up
    return distance


def _common(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Runs of k words that both have, each as often as in the one that has fewer."""
    both = np.concatenate([_labelled(shingles(x, k)) for x in (a, b)])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Edit similarity of two word sequences, or 0 where it is below ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    n = min(len(a), len(b))
    if longer - n > most:
        return 0.0
    if n > 8 and (_common(a, b, 1) < longer - most or _common(a, b, 2) < longer - 1 - 2 * most):  # so many words and word pairs are left by that few edits
        return 0.0
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    band = max(longer - n, 256)
    while longer >= LONG and band < most:  # few edits in a long text need a narrow band only
        if (d := banded_distance(x, y, band)) <= band:
            return 1 - d / longer
        band *= 8
    d = banded_distance(x, y, most)
    return 1 - d / longer if d <= most else 0.0


def _word_hashes(texts: pa.Array) -> pa.Array:
    """The words of each text as 32-bit hashes, one after another."""
    return pa.array([w.hashes[w.bounds[i] : w.bounds[i + 1]].astype(np.uint32).tobytes() for w in words(texts) for i in range(len(w.offsets) - 1)], pa.binary())


_COMPARED = "leader binary, node binary, s double"


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(leader, node, s) of pairs (leader, node) whose similarity s is at least ``least``, written."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([similarity(*(np.frombuffer(v.as_buffer(), dtype=np.uint32).astype(np.uint64) for v in xy), least) for xy in zip(b["x"], b["y"], strict=True)], dtype=float)
            near = pa.array(np.flatnonzero(s >= least))
            yield pa.RecordBatch.from_arrays([b["leader"].take(near), b["node"].take(near), pa.array(s, pa.float64()).take(near)], names=["leader", "node", "s"])

    x, y = (texts.select(F.col("node").alias(c), F.col("words").alias(v)) for c, v in (("leader", "x"), ("node", "y")))
    # a number of partitions that stays, as aligning takes longer than the size of its rows tells
    led = pairs.select("leader", "node").join(x, "leader").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    return materialize(led.join(y, "node").select("leader", "node", "x", "y").mapInArrow(compare, _COMPARED), "compared")


def _print_of(words_: np.ndarray) -> bytes:
    """Bit p is the parity of the words with hash p, modulo the print's bits; a word's second occurrence counts as another word.

    Replacing a word flips two bits at most, adding or dropping one flips one. Bits p and p + half of a print make bit p of the
    print of half its size.
    """
    bits = min(PRINT_BITS[1], max(PRINT_BITS[0], 1 << (2 * len(words_) - 1).bit_length()))
    at = (_labelled(words_) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _prints(texts: pa.Array) -> pa.Array:
    return pa.array([_print_of(np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(np.uint64)) for x in texts], pa.binary())


def _near_prints(n: np.ndarray, classes: np.ndarray, prints: list[bytes], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) for the rows of ascending n that may be that similar and are in different classes, each pair once."""
    sizes = np.array([len(p) for p in prints])
    for size in np.unique(sizes):
        of = np.flatnonzero((sizes == size) | (sizes == 2 * size))  # a text that near is longer by a quarter at most
        held = np.empty((len(of), size // 8), dtype=np.uint64)
        for k, i in enumerate(of):
            p = np.frombuffer(prints[i], dtype=np.uint64)
            held[k] = p if len(prints[i]) == size else p[: len(p) // 2] ^ p[len(p) // 2 :]
        length = n[of]
        most = ((1 - least) * length + 1e-9).astype(np.int64)
        ends = np.searchsorted(length - most, length, side="right")  # of the texts that are not too long
        for k in np.flatnonzero(sizes[of] == size):
            others = np.arange(k + 1, ends[k])
            others = others[classes[of[others]] != classes[of[k]]]
            if len(others):
                flipped = np.bitwise_count(held[others] ^ held[k]).sum(axis=1, dtype=np.int64)
                yield of[k], of[others[flipped <= 2 * most[others] - (length[others] - length[k])]]


_MET = "leader binary, node binary, n int, m int"


def _bucket_pairs(least: float) -> Callable[[pa.Table], pa.Table]:
    """(leader, node, n, m) of one bucket's pairs that have no lesser bucket in common."""

    def pairs(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n").combine_chunks()
        n, classes = (rows[c].to_numpy() for c in ("n", "class"))
        key = rows["key"][0].as_py()
        keys = [{k for k in own if k < key} for own in rows["keys"].to_pylist()]
        x, y = [], []
        for i, others in _near_prints(n, classes, rows["print"].to_pylist(), least):
            for j in others.tolist():
                if keys[i].isdisjoint(keys[j]):
                    x.append(i)
                    y.append(j)
        node, x, y = rows["node"], pa.array(x, pa.int64()), pa.array(y, pa.int64())
        return pa.table({"leader": node.take(x), "node": node.take(y), "n": rows["n"].take(y), "m": rows["n"].take(x)})

    return pairs


def _grams(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, class, n, key) for the labelled runs of k words of each (node, class, n, words)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words_ in enumerate(b["words"]):
                own = _labelled(shingles(np.frombuffer(words_.as_buffer(), dtype=np.uint32).astype(np.uint64), k)).view(np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    same = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays([*(b[c].take(same) for c in ("node", "class", "n")), pa.array(part)], names=["node", "class", "n", "key"])

    return grams


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, exact_id, exact_size) for every row, and the text hashes h and class_h.

    class_id and exact_id are the least ids of the near-duplicate class and of the group with the same words.
    """
    sketched = materialize(_keyed(docs).mapInArrow(_sketch, "doc_id long, h long, node binary, n int, sketches array<long>"), "sketches")
    rep = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    reps = materialize(sketched.groupBy("node").agg(F.min(rep).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketches").alias("sketches")), "reps")
    rows = materialize(sketched.select("doc_id", "h", "node"), "rows")
    discard(sketched)
    owner = reps.where(F.size("sketches") > 0).select("node", "n", F.posexplode("sketches").alias("i", "v")).select(F.xxhash64("i", "v").alias("key"), "node", "n")
    # counted where a bucket's rows are, which needs no second shuffle of all sketches and no join
    members = materialize(owner.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"), "members")
    nodes = materialize(reps.drop("sketches"), "nodes")
    discard(reps)
    texts = _node_words(docs, members.select("node").distinct().join(nodes.select("node", "rep"), "node"))

    links = lambda *compared: _union([c.select(F.col("leader").alias("a"), F.col("node").alias("b")) for c in compared])
    found = [_compared(_own_leaders(members).where(_near("n", "leader_n", least)), texts, least)]
    some = components(links(*found))
    # once more in what is open, among texts of similar length, whose leader is not just the longest
    unled = materialize(_open_buckets(members, some).withColumn("band", F.floor(F.log("n") / -np.log(least)).cast("int")), "unled")
    discard(members)
    found.append(_compared(_own_leaders(unled, "band").where(_near("n", "leader_n", least)), texts, least))
    roots = components(links(*found))
    discard(some)
    unsettled = materialize(_open_buckets(unled, roots), "open")
    discard(unled)
    size = F.col("size")
    pairs = [_across(unsettled.where(size <= SMALL_BUCKET)), _within(unsettled.where((size > SMALL_BUCKET) & (size <= LARGE_BUCKET)), texts, least)]
    wide_texts, written = unsettled.where(size > LARGE_BUCKET).select("node", "n", "root").distinct(), []
    for k in () if wide_texts.isEmpty() else GRAMS:
        if not written:
            wide_texts = materialize(wide_texts.join(texts, "node").select("node", "n", F.xxhash64("root").alias("class"), "words"), "wide_texts")
        met, heavy, held = _sharing(wide_texts, k, least)
        pairs.append(met)
        written += [wide_texts, held]
        if heavy is None or heavy.isEmpty():
            break
        wide_texts = materialize(wide_texts.join(heavy, "node", "left_semi"), "wide_texts")
    pairs = _union(pairs).where(_near("n", "m", least)).select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node"))
    met = _compared(pairs.distinct(), texts, least)
    between = _rooted(_rooted(met, roots, "leader", "a"), roots, "node", "b").select("a", "b").distinct()
    joined = components(between)

    near_root = _rooted(nodes.select("node", "rep", "copies"), roots, "node", "near_root")
    rooted = materialize(_rooted(near_root, joined, "near_root", "root"), "rooted")
    classes = rooted.groupBy("root").agg(F.min("rep").alias("first"), F.sum("copies").alias("class_size"))
    named = rooted.join(classes, "root").select(
        "node", F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("class_h"), "class_size", F.col("rep.doc_id").alias("exact_id"), F.col("copies").alias("exact_size")
    )
    out = materialize(rows.select("doc_id", "h", "node").join(named, "node").drop("node"), "classes")
    discard(rows, nodes, texts, *found, unsettled, *written, met, roots, joined, rooted)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's key is its id and a hash of its text, so that repeated ids with different texts stay apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def _own_leaders(members: DataFrame, *band: str) -> DataFrame:
    """(leader, node, n, leader_n): for each text the one that leads most of its buckets, or of their parts of one band, the most
    central one at a tie."""
    key = ["key", *band]
    central = members.groupBy("node").agg(F.sum("size").alias("central"))
    chosen = members.join(central, "node").groupBy(*key).agg(F.min(F.struct(-F.col("central"), "node", "n")).alias("l"))
    meets = members.select(*key, "node", "n").join(chosen, key).where("node != l.node").groupBy("node", "n", "l").agg(F.count("*").alias("times"))
    own = meets.groupBy("node", "n").agg(F.min(F.struct(-F.col("times"), "l")).alias("best"))
    return own.select(F.col("best.l.node").alias("leader"), "node", "n", F.col("best.l.n").alias("leader_n"))


def _rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    r = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return rows.join(r, node, "left").withColumn(root, F.coalesce(root, node))


def _near(n: str, m: str, least: float) -> Column:
    """Whether texts of so many words may be that similar."""
    return F.abs(F.col(n) - F.col(m)) <= F.lit(1 - least) * F.greatest(n, m) + 1e-9


def _across(members: DataFrame) -> DataFrame:
    """Pairs (leader, node, n, m) of the members of one small bucket that are in different classes so far."""
    own = members.groupBy("key").agg(F.collect_list(F.struct("node", "root", "n")).alias("m"))
    both = own.withColumn("x", F.explode("m")).withColumn("y", F.explode("m")).where("x.node < y.node and x.root != y.root")
    return both.select(F.col("x.node").alias("leader"), F.col("y.node").alias("node"), F.col("y.n").alias("n"), F.col("x.n").alias("m"))


def _within(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (leader, node, n, m) of the members of one bucket that are in different classes and may be near by their prints."""
    of = members.groupBy("node", "n", "root").agg(F.collect_list("key").alias("keys"))
    printed = of.join(texts, "node").select("node", "n", F.xxhash64("root").alias("class"), F.arrow_udf(_prints, "binary")("words").alias("print"), "keys")
    return printed.withColumn("key", F.explode("keys")).groupBy("key").applyInArrow(_bucket_pairs(least), _MET)


def _sharing(texts: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Pairs (leader, node, n, m) of texts of different classes that share enough runs of k words for the similarity; the nodes
    that have to meet by shorter runs as well; and the table that both are read from.

    The longer text of a pair, of L words, has L - k + 1 runs, and an edit spoils k of them at most, so the pair shares
    ``needed`` ones. A text's runs are taken in an order that is the same for all: first those of one class alone, then by the
    number of texts that have them. Of the pair's common runs at most needed - asked are among the last needed - asked of the
    text whose first part ends earlier, so ``asked`` ones are in the first parts of both. A pair that has only runs of many
    texts in them is of two texts with such runs: these meet again by shorter runs, whose first part is smaller.
    """
    own = texts.select("node", "class", "n", "words").mapInArrow(_grams(k), "node binary, class long, n int, key long")
    several = own.groupBy("key").agg(F.count("*").alias("texts"), F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("key", "texts")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("texts", "key"))
    count = F.count("*").over(Window.partitionBy("node"))
    needed = F.greatest(F.ceil(F.col("n") * (1 - k * (1 - least)) - k + 1 - 1e-6), F.lit(1))
    asked = F.greatest(F.floor(needed / 8), F.lit(1))
    first = own.join(several, "key").select("key", "node", "class", "n", "texts", rank.alias("rank"), count.alias("count"), asked.alias("asked"), needed.alias("needed"))
    held = materialize(first.where("rank <= count - needed + asked").select("key", "node", "class", "n", "texts", "asked"), "first_runs")
    last = k == GRAMS[-1]
    x = held if last else held.where(F.col("texts") <= HEAVY)
    x, y = (x.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "class", "n", "asked"))) for s in "xy")
    if last:  # classes meet first, so that the texts of one large class are not set against each other
        of = x.groupBy("key", "class_x").agg(F.count("*").alias("texts")).select("key", "class_x")
        others = of.join(of.select("key", F.col("class_x").alias("class_y")), "key").where("class_x < class_y")
        both = x.join(others, ["key", "class_x"]).join(y, ["key", "class_y"]).where(_near("n_x", "n_y", least))
    else:
        both = x.join(y, "key").where(F.col("class_x") < F.col("class_y")).where(_near("n_x", "n_y", least))
    met = both.groupBy("node_x", "node_y", "n_x", "n_y").agg(F.count("*").alias("met"), F.first(F.least("asked_x", "asked_y")).alias("asked")).where("met >= asked")
    heavy = None if last else held.where(F.col("texts") > HEAVY).select("node").distinct()
    return met.select(F.col("node_x").alias("leader"), F.col("node_y").alias("node"), F.col("n_y").alias("n"), F.col("n_x").alias("m")), heavy, held


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets of several classes, with their roots."""
    of = Window.partitionBy("key")
    rooted = _rooted(members.drop("root"), roots, "node", "root")
    return rooted.withColumns({"low": F.min("root").over(of), "high": F.max("root").over(of)}).where("low != high").drop("low", "high")


def _node_words(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """(node, words) of the involved nodes, one row each, written."""
    by_key = involved.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.h").alias("rep_h"), "node")
    found = _keyed(docs).join(by_key, (F.col("h") == F.col("rep_h")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    return materialize(found.select("node", F.arrow_udf(_word_hashes, "binary")("text").alias("words")).dropDuplicates(["node"]), "texts")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that represent their class: one row each, all columns."""
    kept = near_duplicate_classes(docs, least).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))).select("class_id", "class_h").distinct()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("h"), F.col("doc_id").alias("own_id"))
    found = keyed.join(kept, (F.col("h") == F.col("class_h")) & F.col("own_id").eqNullSafe(F.col("class_id")), "left_semi")
    return found.dropDuplicates(["own_id", "h"]).select("row.*")
