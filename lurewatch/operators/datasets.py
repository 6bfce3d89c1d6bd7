"""Labelled rows for benchmarks and training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .identity import NO_URLS
from .messages import assessment_prompt

# Signs that count as harmless, and separator patterns that make a text noisy when they occur twice.
HARMLESS_SIGNS = """.,:;/-_@?&=%#+'"()"""
NOISY_PATTERNS = ("* * * * *", "_ _ _ _ _", "- - - - -", "= = = = =")
URL_MARKS = ("http://", "https://", "www.")


def text_quality(df: DataFrame, text: str) -> DataFrame:
    """Adds letters and good: length, letter, space, ASCII and sign shares of readable mail text, no long runs of one sign, no
    separator pattern twice. The text counts without white space at its ends; a null text is not good."""
    c = t.trimmed(F.coalesce(F.col(text), F.lit("")))
    count = lambda pattern: F.length(F.regexp_replace(c, pattern, ""))
    letter, space = r"\p{IsAlphabetic}", r"\s"
    signs = "".join("\\" + x for x in HARMLESS_SIGNS)
    out = df.withColumns({
        "n": F.length(c), "letters": count(f"[^{letter}]"), "ascii_letters": count("[^A-Za-z]"), "spaces": count(rf"(?U)[^{space}]"), "symbols": count(rf"(?U)[{letter}{space}0-9{signs}]"),
    })
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    good = F.col("n").between(80, 6000) & (F.col("letters") >= 40) & (F.col("spaces") >= 8) & (share("letters", "n") >= 0.45) & (share("ascii_letters", "letters") >= 0.85) & (share("symbols", "n") <= 0.12)
    noisy = reduce(lambda x, y: x | y, [c.rlike("(?s)" + ".*".join([p.replace("*", r"\*")] * 2)) for p in NOISY_PATTERNS])
    return out.withColumn("good", good & ~c.rlike(r"(?U)([^\p{IsAlphabetic}\p{N}\s])\1{12,}") & ~noisy)


def _mentions_url(message: Column) -> Column:
    return t.contains_any(F.lower(message), URL_MARKS)


def with_has_url(df: DataFrame) -> DataFrame:
    """Adds has_url: urls (a count, a list or a text) that is filled, a positive url_count, a true contains_url, or else the
    message's own text. A false or empty hint does not hide a url in the text."""
    kinds = dict(df.dtypes)
    hints = []
    if "urls" in kinds:
        k = kinds["urls"]
        hints.append(F.size("urls") > 0 if k.startswith("array") else t.trimmed(F.col("urls")) != "" if k == "string" else F.col("urls") > 0)
    if "url_count" in kinds:
        hints.append(F.col("url_count") > 0)
    if "contains_url" in kinds:
        hints.append(F.col("contains_url"))
    hints.append(_mentions_url(F.col("message")))
    return df.withColumn("has_url", reduce(lambda x, y: x | y, [F.coalesce(h, F.lit(False)) for h in hints]))


def normalize_labelled_rows(df: DataFrame, unsafe_labels: tuple[int, ...] | None = None) -> DataFrame:
    """(message, expected_unsafe) from heterogeneous rows; rows without a message or label go.

    The first text column that is not null counts, else headers (those filled) and the trimmed body. ``unsafe_labels`` names
    the unsafe values of a data set with several classes; else every label but 0 is unsafe.
    """
    there = lambda names: [F.col(f"`{n}`") for n in names if n in df.columns]
    heads = [F.when(t.trimmed(c) != "", F.concat(F.lit(f"{title}: "), t.trimmed(c))) for title, n in (("Subject", "subject"), ("From", "sender"), ("To", "receiver")) for c in there([n])]
    body = F.coalesce(*there(["text", "body"]), F.lit(None).cast("string"))
    whole = F.when(body.isNotNull(), F.concat_ws("\n", *heads, t.trimmed(body)))
    label = [F.col("label").cast("long").isin(*unsafe_labels) if unsafe_labels else F.col("label").cast("long") != 0] if "label" in df.columns else []
    label += [F.lower("Email Type").contains("phishing")] if "Email Type" in df.columns else []
    return df.select(F.coalesce(*there(["content", "combined_text", "Email Text", "sms_text"]), whole).alias("message"), F.coalesce(*label, F.lit(None).cast("boolean")).alias("expected_unsafe")).where("message is not null and expected_unsafe is not null")


def read_training_input(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed training rows, as JSON lines or as documents that are one array each."""
    head = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    return spark.read.schema(schema).option("multiLine", bool(head) and head[0].value.lstrip().startswith("[")).json(path)


def balanced_sample(df: DataFrame, label: str, order: str, limit: int) -> DataFrame:
    """At most limit / 2 rows of each class in order, limit rows in all."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= limit // 2).orderBy("_place", label).limit(limit).drop("_place")


def cut_text(c: Column, most: int) -> Column:
    """Texts of more than ``most`` bytes, cut after as many characters and marked."""
    return F.when(F.octet_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("\n[truncated]"))).otherwise(c)


def training_rows(df: DataFrame, index: str, text: str, source: Column, has_url: Column | None = None, most: int = 8000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, message, has_url and the columns to keep) of the rows with text: trimmed and cut texts, and an id of source, index and a hash of all three.

    A null source is ``unknown``; ``has_url`` overrides the text's own mention of a url where it is not null.
    """
    of = F.coalesce(source, F.lit("unknown"))
    message = cut_text(t.trimmed(F.col(text)), most)
    digest = F.substring(F.sha2(F.concat(of, F.col(index).cast("string"), message), 256), 1, 8)
    mentioned = _mentions_url(F.col(text))
    out = df.select(F.concat_ws("-", of, F.col(index).cast("string"), digest).alias("id"), message.alias("message"), (mentioned if has_url is None else F.coalesce(has_url, mentioned)).alias("has_url"), *keep)
    return out.where("message != ''")


#: Bytes of a prompt before it is cut.
MOST_PROMPT = 32_000


def training_examples(rows: DataFrame, contexts: DataFrame, scored: DataFrame, dataset: str, key: str = "id") -> DataFrame:
    """(id, origin, message, url_context, prompt, scoring): what a model is trained to answer about a message.

    ``rows`` has the key, id, message, has_url, source, index, label and expected_unsafe; ``contexts`` (key, context) the urls'
    overview, ``scored`` the key and the outcome of scoring without a model. A row without a context has no urls.
    """
    scores = [c for c in scored.columns if c != key]
    met = rows.join(contexts.select(key, "context"), key, "left").join(scored.select(key, F.struct(*scores).alias("scoring")), key, "left")
    origin = F.struct(F.lit(dataset).alias("dataset"), F.col("source").alias("original_source"), "index", "label", "has_url", "expected_unsafe")
    context = F.coalesce("context", F.lit(NO_URLS))
    return met.select("id", origin.alias("origin"), "message", context.alias("url_context"), cut_text(assessment_prompt(F.col("message"), context), MOST_PROMPT).alias("prompt"), "scoring")


def conversation_pairs(df: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): a user turn and the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nxt = df.withColumn("response", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


def label_agrees(df: DataFrame, scores: list[str], expected: str = "expected_unsafe") -> DataFrame:
    """Rows whose highest score of at least 50 agrees with the label; rows without a label stay."""
    return df.where(F.col(expected).isNull() | ((F.greatest(*scores) >= 50) == F.col(expected)))
