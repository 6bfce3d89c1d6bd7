"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Texts are lower-cased, look-alike letters of other scripts and digit or sign substitutions are folded to Latin
letters, and words are set apart by single marks, so that one automaton finds whole words, word stems and
exception phrases. A longer match wins over a shorter one at the same place; an exception phrase has weight 0
and thus takes away the terms inside it. The weighted hits per length pass through a fitted logistic curve.

Defined cases: null and empty texts have no hits and get the score of a text without hits; repeated rows get
equal scores; an empty table gives an empty result; other columns are never read. Phrases of two words, one of them a
term, that are no commoner in toxic texts than in others are learned as exceptions. Without both labels in the
training rows the lexicon is the seed list alone and the curve has fixed coefficients.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample

#: Terms that count from the start, and phrases in which a term is harmless.
SEED_TERMS = ("idiot", "moron", "scum", "pathetic", "worthless")
EXCEPTIONS = ("trash can", "trash bin", "trash pickup", "clown fish", "not stupid", "idiot proof", "sore loser award")

#: Look-alike letters, and digits and signs written for letters.
LOOKALIKES = dict(zip("авеёкмнорстухіјѕԁɡӏαβεικνορτυχ", "abeekmhopctyxijsdgiabeiknoptux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_WORD = re.compile(r"[^\W\d_]+")
_SUBSTITUTED = re.compile(r"(?<![\w@$])(?=[\d@$]*[^\W\d_])[\w@$]*[\d@$][\w@$]*(?<=[^\W_])")
_FOLD = str.maketrans(LOOKALIKES | {chr(c): unicodedata.normalize("NFKC", chr(c)).lower() for c in range(0xFF21, 0xFF5B)} | {c: None for c in (0x200B, 0x200C, 0x200D, 0xAD)})
_SUB = str.maketrans(SUBSTITUTES)


def fold(text: str | None) -> list[str]:
    """Folded words of a text. Substitutions are undone only inside words that have a letter too."""
    folded = (text or "").lower()
    if not folded.isascii():
        folded = folded.translate(_FOLD)
    if any(c in folded for c in SUBSTITUTES):
        folded = _SUBSTITUTED.sub(lambda m: m[0].translate(_SUB), folded)
    return _WORD.findall(folded)


def _marked(words: Iterable[str]) -> str:
    """Each word between two spaces of its own."""
    return " " + "  ".join(words) + " "


@dataclass(frozen=True)
class Lexicon:
    """Marked pattern to weight, and the curve's slope and intercept. A pattern ending in a letter is a stem."""

    weights: dict[str, float]
    slope: float = 4.0
    intercept: float = -4.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            a.add_word(pattern, weight)
        a.make_automaton()
        return a


def density(texts: Iterable[str | None], automaton) -> np.ndarray:
    """log(1 + weighted hits per 100 words) of each text; short texts count as 20 words longer."""
    out = []
    for text in texts:
        words = fold(text)
        hits = sum(w for _, w in automaton.iter_long(_marked(words))) if words else 0.0
        out.append(math.log1p(100 * hits / (len(words) + 20)))
    return np.array(out)


SHORTEST, LONGEST = 4, 12


#: Terms that a task counts before it passes the counts on; they are summed later, so this bounds memory only.
HELD_TERMS = 200_000


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: in how many texts of each label a word or stem occurs. Every term of both labels is passed on."""
    seen = {0: Counter(), 1: Counter()}

    def counted() -> pa.RecordBatch:
        terms = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (0, 1))], names=["term", "n0", "n1"])
        for c in seen.values():
            c.clear()
        return out

    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(fold(text))
            seen[y].update({f" {w} " for w in words if len(w) > 2} | {" " + w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST + 1))})
            if len(seen[0]) + len(seen[1]) >= HELD_TERMS:
                yield counted()
    yield counted()


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000, max_terms: int = 512, min_log_odds: float = 3.0, min_share: float = 0.015) -> Lexicon:
    """Learn term weights and the curve on at most ``max_fit_rows`` labelled rows that are not held out.

    A word or stem enters if it occurs in ``min_share`` of the toxic texts and its log-odds pass ``min_log_odds``; of nested
    stems the one with the most evidence stays, the longer at a tie. At most ``max_terms`` reach the driver.
    """
    sample = labelled_sample(docs, labels, "toxic", max_fit_rows).groupBy("text").agg(F.max("y").alias("y"))  # copies count once
    counts = sample.mapInArrow(_candidates, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = labels_count(sample)
    base = {f" {t} ": 3.0 for t in SEED_TERMS} | {_marked(p.split()): 0.0 for p in EXCEPTIONS}
    if min(totals) < 1:
        return Lexicon(base)
    n0, n1 = totals
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    strong = (
        counts.where(F.col("n1") >= max(4, int(min_share * n1)))
        .withColumn("odds", odds).where(F.col("odds") >= min_log_odds)
        .orderBy(F.desc(F.col("n1") * F.col("odds")), F.desc(F.length("term")), "term").limit(8 * max_terms).collect()
    )
    learned: dict[str, float] = {}
    for r in strong:
        if len(learned) < max_terms and not any(r.term.startswith(t) or t.startswith(r.term.rstrip()) for t in learned):
            learned[r.term] = float(min(r.odds, 8.0))
    weights = base | learned
    weights |= _learned_exceptions(sample, weights, totals, max_terms)
    rows = _curve_rows(sample, Lexicon(weights))
    return Lexicon(weights, *_fit_curve(*rows))


def _phrases(weights: dict[str, float]):
    """Partial counts: in how many texts of each label two neighbouring words occur, one of which is a term."""
    wholes = {p.strip() for p, w in weights.items() if w > 0 and p.endswith(" ")}
    stems = tuple(p.strip() for p, w in weights.items() if w > 0 and not p.endswith(" "))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = fold(text)
                hit = [w in wholes or w.startswith(stems) for w in words]
                seen[y].update({_marked(words[i : i + 2]) for i in range(len(words) - 1) if hit[i] or hit[i + 1]})
            found = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([seen[y][p] for p in found], pa.int64()) for y in (0, 1))], names=["term", "n0", "n1"])

    return count


def _learned_exceptions(sample: DataFrame, weights: dict[str, float], totals: tuple[int, int], max_terms: int, least: int = 4) -> dict[str, float]:
    """Phrases in which a term is harmless: in ``least`` clean texts or more, and as a share no rarer there than in toxic ones."""
    counts = sample.mapInArrow(_phrases(weights), "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    harmless = counts.where((F.col("n0") >= least) & (F.col("n1") * totals[0] <= F.col("n0") * totals[1]))
    return {r.term: 0.0 for r in harmless.orderBy(F.desc("n0"), "term").limit(max_terms).collect()}


def labels_count(sample: DataFrame) -> tuple[int, int]:
    r = sample.agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b")).first()
    return r.a, r.b


def _curve_rows(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A histogram of densities by label: at most some hundred rows for the driver."""
    rows = sample.select(F.round(_density(lexicon, F.col("text")) * 20).alias("b"), "y").groupBy("b", "y").count().collect()
    return np.array([r.b / 20 for r in rows]), np.array([float(r.y) for r in rows]), np.array([float(r["count"]) for r in rows])


def _fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps."""
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * beta
        hessian = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def _density(lexicon: Lexicon, text: Column) -> Column:
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for texts in batches:
            yield pa.array(density(texts.to_pylist(), automaton), pa.float64())

    values.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(values, T.DoubleType())(text)


def toxicity_score(lexicon: Lexicon, text: Column) -> Column:
    """Score column, 0 to 1."""
    return 1 / (1 + F.exp(-(_density(lexicon, text) * lexicon.slope + lexicon.intercept)))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every document; predicted is 1 from ``threshold`` on."""
    scored = docs.select("doc_id", toxicity_score(lexicon, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
