r"""Line deduplication by a log-template tree of fixed depth.

A line is trimmed and its white space folded; a token with a digit is a variable field ``<*>``. The tree's first
level is the number of tokens, the next are the leading tokens, so a leaf holds lines of equal length that begin
alike. A leaf has any number of templates: a template keeps some of a line's tokens at their positions, at least
``agree`` of all with the leading ones, and the rest are further variable fields. Each line proposes

* its most frequent inner tokens, one template for each number of them (frequencies count documents of the leaf);
* the same by the frequencies among the leaf's lines that share its least frequent recurring token, so that templates
  with common words in their variable fields are told apart;
* all but one of its inner tokens, each in turn, where all of them recur.

Counts are absolute: unrelated lines of a leaf take nothing from a template. A line is dropped where its exact form
or a template that it proposes occurs in at least ``min_docs`` documents.

Defined cases: null text is empty text and stays empty; blank lines belong to no template and stay; a document may
lose all lines and is then empty; rows equal in id and text count as one document; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DEPTH = 3


def template_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, h, pos, line, leaf, form, tokens) of every line that is not blank; leaf and form are hashes."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    odd = [c for c in ("\t", "\r", "\x0b", "\x0c", "\u00a0", "  ")]
    folded = F.when(contains_any("line", odd), F.regexp_replace("line", r"[\s\u00a0]+", " ")).otherwise(F.col("line"))
    rows = rows.withColumn("folded", F.trim(folded)).where("folded != ''")
    masked = F.when(F.col("folded").rlike("[0-9]"), F.regexp_replace("folded", r"[^ ]*\d[^ ]*", "<*>")).otherwise(F.col("folded"))
    cut = rows.withColumn("masked", masked)
    tokens = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "))) + 1
    return cut.withColumn("tokens", tokens).select("doc_id", "h", "pos", "masked", F.xxhash64("tokens", F.substring_index("masked", " ", depth)).alias("leaf"), F.xxhash64("masked").alias("form"), "tokens")


def contains_any(column: str, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).contains(p) for p in parts])


def _kept_sets(tokens: DataFrame, part: list[str], min_docs: int, agree: float, depth: int) -> DataFrame:
    """(leaf, form, docs, tokens, at, token, sets, last) of the tokens that recur within ``part``.

    ``sets`` are the hashes of the kept tokens of the templates that end at this token, ``last`` is the line's least frequent one.
    A set's hash is the xor of its tokens' hashes, so it is running work, linear in the line.
    """
    share = tokens.groupBy(*part, "token").agg(F.sum("docs").alias("support")).where(F.col("support") >= min_docs)
    ranked = Window.partitionBy("leaf", "form").orderBy(F.desc("support"), "at")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tokens.join(share, [*part, "token"]).select(
        "leaf", "form", "docs", "tokens", "at", "token", F.bit_xor("token").over(upto).alias("kept"), F.row_number().over(ranked).alias("k"),
        F.bit_xor("token").over(whole).alias("all"), F.count("*").over(whole).alias("n"), F.last("token").over(whole).alias("last"),
    )
    enough = lambda k: (k + depth >= F.col("tokens") * agree) & (k + depth < F.col("tokens"))
    first, without = F.when(enough(F.col("k")), F.col("kept")), F.when((F.col("n") + depth == F.col("tokens")) & enough(F.col("n") - 1), F.col("all").bitwiseXOR(F.col("token")))
    return rows.select("leaf", "form", "docs", "tokens", "at", "token", F.array_compact(F.array(first, without)).alias("sets"), "last")


def recurring_forms(lines: DataFrame, texts_of: DataFrame, min_docs: int = 3, agree: float = 0.7, depth: int = DEPTH) -> DataFrame:
    """(form) of the lines to drop. ``lines`` has the hashes alone, ``texts_of`` the same lines with their masked text."""
    per_doc = lines.select("leaf", "form", "doc_id", "h", "tokens").groupBy("leaf", "form", "doc_id", "h").agg(F.first("tokens").alias("tokens"))
    forms = materialize(per_doc.groupBy("leaf", "form").agg(F.count("*").alias("docs"), F.first("tokens").alias("tokens")), "forms")
    exact = forms.where(F.col("docs") >= min_docs).select("form")
    # leaves with several forms and enough documents: templates over positions behind the leading tokens
    leaves = forms.groupBy("leaf").agg(F.count("*").alias("forms"), F.sum("docs").alias("leaf_docs"), F.first("tokens").alias("n"))
    mixed = leaves.where((F.col("forms") > 1) & (F.col("leaf_docs") >= min_docs) & (F.col("n") > depth)).select("leaf")
    texts = texts_of.select("leaf", "form", "masked").join(mixed, "leaf", "left_semi").groupBy("form").agg(F.first("masked").alias("masked"))
    spread = forms.join(mixed, "leaf", "left_semi").join(texts, "form").select("leaf", "form", "docs", "tokens", F.posexplode(F.split("masked", " ")).alias("at", "word")).where(F.col("at") >= depth)
    tokens = materialize(spread.select("leaf", "form", "docs", "tokens", "at", F.xxhash64("at", "word").alias("token")), "tokens")
    known = materialize(_kept_sets(tokens, ["leaf"], min_docs, agree, depth), "known")
    closer = _kept_sets(known.drop("sets"), ["leaf", "last"], min_docs, agree, depth)
    sets = lambda df: df.select("leaf", "form", "docs", F.explode("sets").alias("kept"))
    proposed = materialize(sets(known).unionByName(sets(closer)).distinct(), "proposed")
    # the sum counts a document once for each of its forms, so it only bounds the number of documents from above
    bound = proposed.groupBy("leaf", "kept").agg(F.sum("docs").alias("most"), F.count("*").alias("forms")).where((F.col("most") >= min_docs) & (F.col("forms") > 1))
    members = materialize(proposed.join(bound.select("leaf", "kept"), ["leaf", "kept"]).select("leaf", "form", "kept"), "members")
    docs_of = per_doc.select("leaf", "form", "doc_id", "h").join(members, ["leaf", "form"]).groupBy("leaf", "kept", "doc_id", "h").agg(F.count("*").alias("lines"))
    covered = docs_of.groupBy("leaf", "kept").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    general = members.join(covered.select("leaf", "kept"), ["leaf", "kept"], "left_semi").select("form")
    return materialize(exact.unionByName(general).distinct(), "recurring")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, agree: float = 0.7) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row, without the lines of recurring templates."""
    full = template_lines(docs)
    lines = materialize(full.drop("masked"), "lines")
    recurring = recurring_forms(lines, full, min_docs, agree)
    gone = lines.select("doc_id", "h", "pos", "form").join(recurring, "form", "left_semi").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    g = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), "gone")
    found = rows.join(g, (F.col("h") == F.col("gone_h")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    split = F.split("text", "\n")
    # dropped positions are sorted: what stays is the slices between them, so the work is linear in the lines
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"))
    runs = F.transform(edges, lambda p, i: F.slice(split, p + 2, F.coalesce(F.get("gone", i), F.size(split)) - p - 1))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return found.select("doc_id", kept.alias("text"), F.size(split).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"))
