"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, decontam, fingerprint, linededup, mixing, neardup, oracles, periodic, quality, qualityrules, repair, sharding, toxicity, urlfilter
from .common import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, threshold=0.3).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "exact_id", "exact_size")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon, threshold=0.5).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered and read back, and one of control strings."""
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    records = rows.select("conv_id", F.to_json(F.struct(F.coalesce("turn", F.lit(-1).cast("long")).alias("turn"), blank("role"), blank("text"))).alias("record"))
    chats = chatformat.format_chats(chatformat.canonical_turns(records, "conv_id", "record"), "conv_id")
    back = chats.select("conv_id", "formatted", "loss", chatformat.read_back(F.col("formatted")).alias("turns"), chatformat.masked_text(F.col("formatted"), F.col("loss")).alias("loss_text"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines: counts and a digest of what stays."""
    kept = linededup.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text and likeness to both neighbours."""
    docs = table(spark, sf_dir, "documents")
    shared = fingerprint.shared_digests(docs)
    shared = None if shared.isEmpty() else shared
    own = lambda df: fingerprint.with_fingerprint(df, "text", "fingerprint", shared)
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.expr("left(next_text, length(text) div 4)"))
    rows = fingerprint.with_next(docs, own).select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = fingerprint.with_fingerprint(rows, "edited", "edited_fingerprint", shared)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next")
    )


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near-equal bytes over all documents, equal texts together."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op10_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.take_counts(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows, some of which are dropped, emptied, cut, repeated or given to the user by the checksum of conv_id and turn."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    left = plain.withColumn("hit", hit).where("hit != 0")
    return left.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired digest of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations")
    repaired = repair.repair_conversations(damaged(rows)).withColumnRenamed("conv_id", "r_id")
    blank = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    every = rows.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("r_id")), "left")
    return every.select("conv_id", *(F.coalesce(c, blank.get(c, F.lit(0).cast("long"))).alias(c) for c in repaired.columns[1:]))


def _with_period(text: Column, doc_id: Column) -> Column:
    """The text, in which one document of ten goes on with the period that its id's checksum sets from a word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        rest = F.size(w) - a
        p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")

    own_words = F.transform(F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, own_words).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document: their number, the longest, digests of all and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_period(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    found = periodic.with_runs(docs).select("doc_id", "runs", "collapsed", periodic.longest_run(F.col("runs")).alias("most"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period", F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether it is inside the fences of its language and source."""
    return qualityrules.apply_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_order_minhash": op5_order_minhash,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_fingerprint": op8_fingerprint,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_cube_mixing": op10_cube_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {"op4_url_filter": oracles.OP4, "op6_chat_format": oracles.OP6, "op7_line_dedup": oracles.OP7, "op11_conversation_repair": oracles.OP11, "op13_quality_rules": oracles.OP13}
