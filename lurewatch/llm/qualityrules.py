"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter.

Every text gets counts (words, characters in words, symbols, repeated lines, words in repeated 5-word windows). The base
rules are absolute; the others are fences around what is usual for the document's language and source, read from a quantile
sketch of each measure. A sketch is a histogram over buckets of 7 significant bits (relative error below 1/64), so sketches
of any partition, source or language merge by adding counts and do not depend on the order or number of tasks. A group with
fewer than ``min_rows`` passing rows uses the merged sketch of its language, then that of all rows.

Everything is built-in functions. Grouping by (measure, bucket) combines before the shuffle, so a source that holds a third
of all rows sends each task's buckets only; the thresholds are one row for each group and are joined without moving texts.

Defined cases: a null text has no words; texts without words fail the base rules; null languages and sources are groups like
others; repeated rows count each; an empty table gives an empty result; other columns are carried along and never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words in repeated windows
MANTISSA = 7
MIN_ROWS = 100
FENCE = 3
#: Measures in thousandths, the least distance of a fence from the middle half, and whether small values are suspicious too.
MEASURES = {"word_length": (3000, True), "symbols": (50, False), "dup_lines": (500, False)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(h: Column) -> Column:
    """Number of words in windows that occur twice or more, from the hashes of the words; windows are equal if 64-bit hashes are.

    Most texts have no such window, which a distinct count tells; the others sort their windows, so the cost is n log n.
    """
    windows = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda x, k: F.coalesce(F.least(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)

    def twice(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["w"] == e["w"], F.lit(False))
        found = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return _let(F.sort_array(F.transform(found, lambda e: e["i"])), covered)

    some = lambda w: _let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), twice)
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(some(w)))


def text_counts(text: Column) -> Column:
    """Struct of the counts of a text; words are runs of characters that are not ASCII white space."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of_words(w: Column) -> Column:
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda total, x: total + F.length(x))
        return F.struct(F.size(w).cast("long").alias("n"), chars.alias("chars"), _let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("repeat"))

    in_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    symbols = (F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1).cast("long")
    return _let(
        F.struct(_let(words, of_words).alias("w"), in_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].alias("n_words"), x["w"]["chars"].alias("word_chars"), symbols.alias("n_symbols"),
            x["l"]["n"].alias("n_lines"), (x["l"]["n"] - x["l"]["distinct"]).alias("n_dup_lines"), x["w"]["repeat"].alias("n_repeat_words"),
        ),
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def measures(counts: Column) -> dict[str, Column]:
    """Whole thousandths of each measure."""
    share = lambda part, whole: F.call_function("div", 1000 * counts[part], F.greatest(counts[whole], F.lit(1)))
    return {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines")}


def bucket(value: Column) -> Column:
    """Least value of the bucket of a whole number from 0 on: its first 7 significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - MANTISSA, F.lit(0))).cast("long")
    return value - value % step


def sketch(facts: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, measure, low, n) of rows (lang, source, counts) that pass the base rules."""
    each = F.array(*(F.struct(F.lit(m).alias("measure"), bucket(v).alias("low")) for m, v in measures(F.col("counts")).items()))
    rows = facts.where(~base_failed(F.col("counts"))).select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "measure", "low").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets are added."""
    return sketches.groupBy(*keys, "measure", "low").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, rows, q1, q3) of each sketch: the buckets of the rows at a quarter and at three quarters."""
    own = Window.partitionBy(*keys, "measure")
    placed = sketches.withColumn("upto", F.sum("n").over(own.orderBy("low"))).withColumn("rows", F.sum("n").over(own))
    at = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("rows"), F.col("low")))
    return placed.groupBy(*keys, "measure").agg(F.first("rows").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(facts: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, limits) of every group in ``facts``: for each measure the least and greatest value that is kept.

    A fence is three times the distance between the quartiles away from them, or the measure's least distance if that is more.
    """
    fine = materialize(sketch(facts), "sketches")
    levels = [quartiles(merged(fine, *keys), *keys).withColumnsRenamed({c: f"{c}{i}" for c in ("rows", "q1", "q3")}) for i, keys in enumerate((("lang", "source"), ("lang",), ()))]
    groups = facts.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*(F.lit(m) for m in MEASURES))).alias("measure"))
    for level in levels:
        keys = [c for c in ("lang", "source") if c in level.columns]
        other = level.withColumnsRenamed({c: f"{c}_of" for c in [*keys, "measure"]})
        same = F.col("measure") == F.col("measure_of")
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
        groups = groups.join(other, same, "left").drop(*(f"{c}_of" for c in [*keys, "measure"]))
    finest = lambda q: F.when(F.col("rows0") >= min_rows, F.col(f"{q}0")).when(F.col("rows1") >= min_rows, F.col(f"{q}1")).otherwise(F.col(f"{q}2"))
    chosen = groups.select("lang", "source", "measure", finest("q1").alias("q1"), finest("q3").alias("q3"))
    limits = []
    for m, (least, both) in MEASURES.items():
        reach = F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.lit(least))
        own = F.col("measure") == m
        limits += [F.max(F.when(own, F.col("q1") - reach if both else F.lit(0))).alias(f"{m}_low"), F.max(F.when(own, F.col("q3") + reach)).alias(f"{m}_high")]
    out = materialize(chosen.groupBy("lang", "source").agg(*limits).select("lang", "source", F.struct(*(f"{m}_{end}" for m in MEASURES for end in ("low", "high"))).alias("limits")), "limits")
    discard(fine)
    return out


def verdict(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with lang, source, counts) and ``base_failed`` and ``kept``: inside every fence of the group.

    The limits are one small row for each group; Spark sends them to all tasks while they are small, by their size on disk,
    and otherwise joins with the hot groups' partitions split.
    """
    other = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("limits").alias("_limits"))
    joined = rows.join(other, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, v in measures(F.col("counts")).items():
        for end, ok in (("low", v >= F.col(f"_limits.{m}_low")), ("high", v <= F.col(f"_limits.{m}_high"))):
            inside = inside & F.coalesce(ok, F.lit(True))
    failed = base_failed(F.col("counts"))
    return joined.select(*rows.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def apply_rules(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) of every document."""
    facts = materialize(docs.select("doc_id", "lang", "source", text_counts(F.col("text")).alias("counts")), "facts")
    judged = verdict(facts, thresholds(facts, min_rows))
    return judged.select("doc_id", *(f"counts.{c}" for c in COUNTS), "base_failed", "kept")


def keep_good(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names; texts are not moved unless a join has to."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", text_counts(F.col("text")).alias("counts"))
    limits = thresholds(rows.select("lang", "source", "counts"), min_rows)
    return verdict(rows, limits).where("kept").select("row.*")
