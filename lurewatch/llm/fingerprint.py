"""Document fingerprints: canonical exact digest.

A text is freed of zero-width characters, brought to Unicode's composed form (NFC), case-folded and its white space
folded; two 64-bit xxhashes of the result, with different salts, are its wide digest. Rows that share a digest are
compared byte by byte in canonical form; should different texts ever share one, a number is appended to each.

Spark has no normalisation function, so the parts of a text that may change are picked out by a pattern (a character
and the marks after it; most texts have none), taken apart, ordered and composed again by Unicode's own tables and
rules. Case folding is lower case, and for the letters where the two differ a table.

Defined cases: null text is empty text; texts that differ only in case, white space or composition are equal;
repeated rows are equal; an empty table gives an empty result; other columns are not read; ids may be any longs.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_ZERO_WIDTH = "​‌‍﻿­"
_SPACE = r"[\s\u0085   -     　]+"
COMPARED = 1 << 20  # marks of digests that several rows have
ROWS_PER_RANGE, MOST_RANGES = 512, 8192  # rows that one window orders, while there are not more ranges than that
_HANGUL = "".join(map(chr, range(0xAC00, 0xD7A4)))


def _class(chars: Iterable[str]) -> str:
    """A pattern's character class of the given characters, in ranges; what comes before the first is told by one comparison."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    listed = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if b > a else rf"\x{{{a:x}}}" for a, b in spans)
    return rf"[\x{{{spans[0][0]:x}}}-\x{{10ffff}}&&[{listed}]]"


class Tables(NamedTuple):
    """A class of the characters that composing may change, canonical decompositions, combining classes and composed pairs; a
    class of the letters whose folded form is not their lower case, and those forms."""

    moving: str
    apart: dict[str, str]
    rank: dict[str, int]
    pairs: dict[str, str]
    folding: str
    folded: dict[str, str]


@cache
def unicode_tables() -> Tables:
    """All by Unicode's own data."""
    moving, apart, rank, pairs, folded = set(), {}, {}, {}, {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if unicodedata.combining(c):
            rank[c] = unicodedata.combining(c)
            moving.add(c)
        if not 0xAC00 <= code < 0xD7A4 and (whole := unicodedata.normalize("NFD", c)) != c:
            apart[c] = whole
            direct = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
            if len(direct) == 2 and unicodedata.normalize("NFC", whole) == c:
                pairs[direct] = c
                moving.add(direct[1])
            elif unicodedata.normalize("NFC", c) != c:
                moving.add(c)
        if (full := c.lower().casefold()) != c.lower() and len(c.lower()) == 1:
            folded[c.lower()] = full
    moving.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # Hangul vowels and finals
    return Tables(_class(moving), apart, rank, pairs, _class(folded), folded)


def _table(entries: dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{kind}>")


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _decomposed(c: Column, apart: Column) -> Column:
    """Characters of one character's canonical decomposition; Hangul syllables by arithmetic."""
    at = F.ascii(c) - 0xAC00
    jamo = lambda base, i: F.substring(F.lit("".join(map(chr, range(base, base + 28)))), i + 1, F.lit(1))
    hangul = F.array(jamo(0x1100, F.floor(at / 588).cast("int")), jamo(0x1161, F.floor(at % 588 / 28).cast("int")))
    hangul = F.when(at % 28 > 0, F.concat(hangul, F.array(jamo(0x11A7, at % 28)))).otherwise(hangul)
    return F.when(at.between(0, 11171), hangul).otherwise(_characters(F.coalesce(F.try_element_at(apart, c), c)))


def _joined(a: Column, b: Column, pairs: Column) -> Column:
    """The composed character of two, or null."""
    x, y = F.ascii(a), F.ascii(b)
    syllable = lambda i: F.substring(F.lit(_HANGUL), i.cast("int") + 1, F.lit(1))
    return (
        F.when(x.between(0x1100, 0x1112) & y.between(0x1161, 0x1175), syllable((x - 0x1100) * 588 + (y - 0x1161) * 28))
        .when(x.between(0xAC00, 0xD7A3) & ((x - 0xAC00) % 28 == 0) & y.between(0x11A8, 0x11C2), syllable(x - 0xAC00 + y - 0x11A7))
        .otherwise(F.try_element_at(pairs, F.concat(a, b)))
    )


def _recomposed(piece: Column) -> Column:
    """A starter and its marks in composed form: taken apart, marks ordered by class, each joined to the starter unless blocked."""
    own = unicode_tables()
    apart, rank, pairs = _table(own.apart, "string"), _table(own.rank, "int"), _table(own.pairs, "string")
    chars = F.flatten(F.transform(_characters(piece), lambda c: _decomposed(c, apart)))
    ranked = F.transform(chars, lambda c, i: F.struct(i.alias("i"), F.coalesce(F.try_element_at(rank, c), F.lit(0)).alias("k"), c.alias("c")))
    group = lambda r: F.size(F.filter(ranked, lambda x: (x["k"] == 0) & (x["i"] <= r["i"])))
    order = F.array_sort(F.transform(ranked, lambda r: F.struct(group(r).alias("g"), r["k"].alias("k"), r["i"].alias("i"), r["c"].alias("c"))))
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit(0).alias("last"), F.lit("").alias("marks"))

    def step(s: Column, r: Column) -> Column:
        both = F.when((s["starter"] != "") & ((s["marks"] == "") | (s["last"] < r["k"])), _joined(s["starter"], r["c"], pairs))
        return (
            F.when(both.isNotNull(), F.struct(s["done"].alias("done"), both.alias("starter"), s["last"].alias("last"), s["marks"].alias("marks")))
            .when(r["k"] == 0, F.struct(F.concat(s["done"], s["starter"], s["marks"]).alias("done"), r["c"].alias("starter"), F.lit(0).alias("last"), F.lit("").alias("marks")))
            .otherwise(F.struct(s["done"].alias("done"), s["starter"].alias("starter"), r["k"].alias("last"), F.concat(s["marks"], r["c"]).alias("marks")))
        )

    return F.aggregate(order, begin, step, lambda s: F.concat(s["done"], s["starter"], s["marks"]))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def composed(text: Column) -> Column:
    """The text in Unicode's composed form."""
    moving = unicode_tables().moving
    still = moving.replace("[", "[^", 1)
    pieces = lambda t: F.regexp_extract_all(t, F.lit(rf"{still}?{moving}+|{still}+(?={still}{moving}|\z)"), 0)
    whole = lambda t: F.array_join(F.transform(pieces(t), lambda p: F.when(p.rlike(moving), _recomposed(p)).otherwise(p)), "")
    return _once(text, lambda t: F.when(t.rlike(moving), whole(t)).otherwise(t))


def case_folded(text: Column) -> Column:
    """The text in Unicode's full case folding."""
    own = unicode_tables()
    table = _table(own.folded, "string")
    pieces = lambda t: F.regexp_extract_all(t, F.lit(f"{own.folding}|{own.folding.replace('[', '[^', 1)}+"), 0)
    whole = lambda t: F.array_join(F.transform(pieces(t), lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    return _once(F.lower(text), lambda t: F.when(t.rlike(own.folding), whole(t)).otherwise(t))


def canonical(text: Column) -> Column:
    """The text in canonical form."""
    text = F.translate(F.coalesce(text, F.lit("")), _ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(case_folded(composed(text)), _SPACE, " "))


def digest(canonical_text: Column) -> Column:
    """Wide xxhash of a canonical text as 32 hex digits."""
    return _once(canonical_text, lambda c: F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(c), F.xxhash64(F.lit("wide"), c))])))


def shared_digests(docs: DataFrame) -> DataFrame:
    """(digest, canonical) of the different texts that share a digest, found by comparing bytes; normally empty.

    Every two rows with one digest are compared by their canonical bytes, never by a further hash. A digest of several rows sets
    one of COMPARED marks, of which there are no more however many texts there are, and only rows under a mark move; a mark that
    several digests share costs time only. Copies are combined before the shuffle.
    """
    digests = docs.select(digest(canonical(F.col("text"))).alias("digest"))
    mark = F.pmod(F.xxhash64("digest"), F.lit(COMPARED))
    marks = materialize(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(mark.alias("mark")).distinct(), "marks")
    canon = docs.select(canonical(F.col("text")).alias("canonical")).select(digest(F.col("canonical")).alias("digest"), "canonical")
    alike = canon.join(F.broadcast(marks), mark == F.col("mark"), "left_semi")
    least = alike.groupBy("digest").agg(F.min("canonical").alias("x"), F.max("canonical").alias("y")).where("x != y").select("digest")
    least = materialize(least, "collided")
    if least.isEmpty():
        return docs.sparkSession.createDataFrame([], "digest string, canonical string")
    return materialize(canon.join(least, "digest").distinct(), "collisions")


def with_fingerprint(rows: DataFrame, text: str, out: str, collisions: DataFrame | None) -> DataFrame:
    """Adds the fingerprint of column ``text``; a digest that different texts share gets each text's number."""
    canon = canonical(F.col(text))
    if collisions is None:
        return rows.withColumn(out, digest(canon))
    numbered = collisions.select(F.col("canonical").alias("_c"), F.col("digest").alias("_d"), F.dense_rank().over(Window.partitionBy("digest").orderBy("canonical")).alias("_n"))
    hit = rows.withColumn("_digest", digest(canon)).join(numbered, (F.col("_digest") == F.col("_d")) & (canon == F.col("_c")), "left")
    return hit.withColumn(out, F.concat_ws("-", "_digest", F.col("_n").cast("string"))).drop("_digest", "_c", "_d", "_n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    found = shared_digests(docs)
    return with_fingerprint(docs.select("doc_id", "text"), "text", "fingerprint", None if found.isEmpty() else found).select("doc_id", "fingerprint")


def _range_of(doc_id: Column, splits: list[int]) -> Column:
    """How many of the sorted splits an id reaches: first among every 64th, then among the 64 after it."""
    at = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if len(xs) <= 64 else F.from_json(F.lit(json.dumps(xs)), "array<long>")
    all_, coarse = at(splits), at(splits[::64])
    block = F.size(F.filter(coarse, lambda s: s <= doc_id))
    return F.when(block == 0, 0).otherwise((block - 1) * 64 + F.size(F.filter(F.slice(all_, F.greatest((block - 1) * 64 + 1, F.lit(1)), F.lit(64)), lambda s: s <= doc_id)))


def with_next(rows: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text, derived columns, next_text, next_ of each): each row with what the next row by id has, the last with the first's.

    Rows are dealt by quantiles of the ids, so texts move once and no range gets much more than its share, however the ids
    lie; only each range's first row crosses to the range before. Ties are ordered by text; a null id comes first. ``derive``
    adds columns to rows with a text.
    """
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], F.lit(max(10_000, 10 * ranges)))).first()[0] if ranges > 1 else None
    splits = sorted(set(found or []))
    rows = rows.withColumn("range", F.coalesce(_range_of(F.col("doc_id"), splits).cast("long"), F.lit(-1).cast("long")) if splits else F.lit(0).cast("long"))
    heads = materialize(rows.groupBy("range").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")), "heads")
    derive = derive or (lambda df: df)
    rows, heads = derive(rows), derive(heads)
    named = [c for c in heads.columns if c != "range"]
    every = F.struct(*named)
    order = Window.orderBy("range")  # one row for each range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("range").select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(whole)).alias("then"))
    bridge = following.join(heads.select(F.col("range").alias("then"), every.alias("head")), "then").select("range", "head")
    own = F.lead(every).over(Window.partitionBy("range").orderBy("doc_id", "text"))
    inside = rows.withColumn("next", own).join(bridge, "range").withColumn("next", F.coalesce("next", "head"))
    return inside.select("doc_id", *named, *[F.col("next")[c].alias(f"next_{c}") for c in named])
