"""Memory of unsafe messages: simhash, exact and Hamming-distance lookup."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Token weights.
HEAVY = ("<url>", "login", "verify", "account", "password", "wallet", "payment")
MEDIUM = ("urgent", "suspended", "immediately", "secure", "update")
MAX_DISTANCE = 12


def with_message_keys(df: DataFrame, message: str = "message") -> DataFrame:
    """Adds normal_text and message_hash."""
    return df.withColumn("normal_text", t.redacted_message(t.normal_message(F.col(message)))).withColumn("message_hash", F.sha2("normal_text", 256))


def with_simhash(df: DataFrame, text: str = "normal_text") -> DataFrame:
    """Adds simhash, 64 weighted bits of the tokens; a bit is set where its weights' sum is not negative (all, without tokens).

    Each distinct text is hashed once: its tokens are exploded and the weights under each bit summed, combined before the
    shuffle, so the work stays in generated code. A sum carries bit i in its lower and bit i + 32 in its upper half; the
    weights of a text are less than its bytes, so no half runs over. A null text has a null simhash.
    """
    trimmed = F.regexp_replace("raw", "^[^A-Za-z0-9<>]+|[^A-Za-z0-9<>]+$", "")
    texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct().select(F.sha2("_text", 256).alias("_key"), "_text")
    tokens = texts.select("_key", F.explode(F.split("_text", " ")).alias("raw")).select("_key", trimmed.alias("token")).select("_key", "token", F.conv(F.substring(F.sha2("token", 256), 1, 16), 16, -10).cast("bigint").alias("h"))
    weight = F.when(F.col("token") == "", 0).when(F.col("token").isin(*HEAVY), 4).when(F.col("token").isin(*MEDIUM), 3).otherwise(1)
    both = F.lit((1 << 32) + 1)
    sums = tokens.withColumn("w", weight.cast("bigint")).groupBy("_key").agg(F.sum("w").alias("all"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(both) * F.col("w")).alias(f"s{i}") for i in range(32)])
    set_bits = lambda half, up: reduce(lambda a, b: a.bitwiseOR(b), [F.when(half(F.col(f"s{i}")) * 2 >= F.col("all"), F.shiftleft(F.lit(1).cast("bigint"), i + up)).otherwise(F.lit(0).cast("bigint")) for i in range(32)])
    low, high = set_bits(lambda s: s.bitwiseAND(F.lit((1 << 32) - 1)), 0), set_bits(lambda s: F.shiftrightunsigned(s, 32), 32)
    return df.withColumn("_key", F.sha2(text, 256)).join(sums.select("_key", low.bitwiseOR(high).alias("simhash")), "_key", "left").drop("_key")


def unsafe_state(events: DataFrame) -> DataFrame:
    """Current row per message_hash from append-only events (seq, message_hash, simhash, risk, decision, user_id, raw, seen_at)."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    kept = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("message_hash").agg(F.first("simhash").alias("simhash"), F.count("*").alias("seen_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), last("risk"), last("decision"), kept("user_id"), kept("raw"))


def exact_memory(messages: DataFrame, memory: DataFrame) -> DataFrame:
    return messages.join(memory.select("message_hash", F.col("risk").alias("memory_risk"), F.lit(True).alias("exact")), "message_hash", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def _masks(most: int) -> list[int]:
    one = [1 << i for i in range(16)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    return [0, *one, *(two if most > 1 else []), *(three if most > 2 else [])]


def _patterns(messages: DataFrame, side: str) -> DataFrame:
    """Distinct bit patterns; messages of one pattern are one row, however many there are."""
    return messages.select(F.col("simhash").alias(f"{side}_bits")).where("simhash is not null").distinct()


def _near(met: DataFrame, most: int) -> DataFrame:
    return met.withColumn("distance", F.bit_count(F.col("left_bits").bitwiseXOR(F.col("right_bits")))).where(F.col("distance") <= most)


def hamming_pairs(messages: DataFrame, memory: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """(left_bits, right_bits, distance) of the patterns within ``most`` bits, by keys instead of all pairs: every such pair.

    Of four 16-bit quarters one differs in at most most / 4 bits (3 here): the message side lists quarters with one
    bit flipped, the memory side with two, so such a pair meets on a key. Exact for most up to 15. About 4 % of all pairs of
    unrelated patterns meet; ``lsh_pairs`` compares far fewer and loses up to 1 %.
    """
    if most >= 16:
        raise ValueError("the key scheme covers distances below 16")

    def keyed(df: DataFrame, flips: int, side: str) -> DataFrame:
        band = F.posexplode(F.transform(F.array(F.lit(0), F.lit(16), F.lit(32), F.lit(48)), lambda s: F.call_function("shiftrightunsigned", F.col(f"{side}_bits"), s).bitwiseAND(F.lit(0xFFFF)))).alias("band", "quarter")
        flipped = F.explode(F.transform(F.array(*[F.lit(m) for m in _masks(flips)]), lambda m: F.col("quarter").bitwiseXOR(m.cast("bigint")))).alias("key")
        return df.select(f"{side}_bits", band).select(f"{side}_bits", "band", flipped)

    met = keyed(_patterns(messages, "left"), 1, "left").join(keyed(_patterns(memory, "right"), 2, "right"), ["band", "key"])
    return _near(met.select("left_bits", "right_bits"), most).distinct()


def sampled_masks(bits: int, most: int = MAX_DISTANCE, recall: float = 0.99, seed: int = 17) -> list[int]:
    """Masks of ``bits`` sampled bits each, as many as two patterns ``most`` bits apart need to agree on one with probability ``recall``."""
    agree = math.comb(64 - most, bits) / math.comb(64, bits)
    rng = random.Random(seed)
    masks = (sum(1 << i for i in rng.sample(range(64), bits)) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - agree))))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def lsh_pairs(messages: DataFrame, memory: DataFrame, most: int = MAX_DISTANCE, recall: float = 0.99, bits: int | None = None) -> DataFrame:
    """(left_bits, right_bits, distance) of at least ``recall`` of the patterns within ``most`` bits: they agree on some sampled bits.

    More bits are sampled the more patterns are remembered (their logarithm, 20 at most), so that a bucket of unrelated patterns
    stays small and the comparisons grow with the patterns, not with their square; a pair is taken from the first mask that it
    agrees on, so no distinct is needed.
    """
    left, right = _patterns(messages, "left"), _patterns(memory, "right")
    if bits is None:
        bits = min(20, max(6, right.count().bit_length()))
    masks = F.array(*[F.lit(m).cast("bigint") for m in sampled_masks(bits, most, recall)])

    def keyed(df: DataFrame, side: str) -> DataFrame:
        return df.select(f"{side}_bits", F.posexplode(F.transform(masks, lambda m: F.col(f"{side}_bits").bitwiseAND(m))).alias("mask", "key"))

    near = _near(keyed(left, "left").join(keyed(right, "right"), ["mask", "key"]).select("left_bits", "right_bits", "mask"), most)
    apart = F.col("left_bits").bitwiseXOR(F.col("right_bits"))
    first = F.array_position(F.transform(masks, lambda m: apart.bitwiseAND(m) == 0), True) - 1
    return near.where(first == F.col("mask")).drop("mask")


def message_pairs(pairs: DataFrame, messages: DataFrame, memory: DataFrame) -> DataFrame:
    """(left_hash, right_hash, distance): every pair of different messages whose patterns are a pair."""
    left = messages.select(F.col("message_hash").alias("left_hash"), F.col("simhash").alias("left_bits")).distinct()
    right = memory.select(F.col("message_hash").alias("right_hash"), F.col("simhash").alias("right_bits")).distinct()
    return pairs.join(left, "left_bits").join(right, "right_bits").where("left_hash != right_hash").select("left_hash", "right_hash", "distance")


def distance_adjustment(distance: Column) -> Column:
    return F.when(distance <= 3, 35).when(distance <= 8, 20).when(distance <= 12, 10).otherwise(0)


def memory_lookup(messages: DataFrame, memory: DataFrame, newest: int = 5000) -> DataFrame:
    """(message_hash, exact, nearest, n_similar, memory_adjustment) against the ``newest`` remembered messages; n_similar is at most 10.

    The similar side is bounded by ``newest`` rows, as the rule says, so its distinct bit patterns are broadcast and each
    distinct pattern of the messages is compared once; exact matches look at all. A message is not similar to itself, which
    only matters for equal patterns.
    """
    recent = memory.orderBy(F.desc("last_seen"), "message_hash").limit(newest).select("message_hash", "simhash")
    patterns = F.broadcast(recent.groupBy("simhash").agg(F.min("message_hash").alias("least"), F.max("message_hash").alias("most"), F.count("*").alias("n")))
    asked = messages.select("message_hash", "simhash").distinct()
    distance = F.bit_count(F.col("bits").bitwiseXOR(F.col("simhash")))
    near = asked.select(F.col("simhash").alias("bits")).distinct().join(patterns, distance.between(1, MAX_DISTANCE)).groupBy("bits").agg(F.min(distance).alias("apart"), F.sum("n").alias("others"))
    out = exact_memory(asked, memory).join(near, F.col("simhash") == F.col("bits"), "left").join(patterns, "simhash", "left")
    same = (F.col("least") != F.col("message_hash")) | (F.col("most") != F.col("message_hash"))
    itself = F.broadcast(recent.select(F.col("message_hash").alias("own"), F.lit(1).alias("itself")))
    out = out.withColumn("nearest", F.when(same, 0).otherwise(F.col("apart"))).join(itself, F.col("message_hash") == F.col("own"), "left")
    similar = F.coalesce("others", F.lit(0)) + F.coalesce("n", F.lit(0)) - F.coalesce("itself", F.lit(0))
    adjusted = F.greatest(distance_adjustment(F.col("nearest")), F.when(F.col("exact"), 35).otherwise(0))
    return out.select("message_hash", "exact", "nearest", F.least(similar, F.lit(10)).cast("int").alias("n_similar"), adjusted.alias("memory_adjustment"))


def top_similar(pairs: DataFrame, messages: DataFrame, memory: DataFrame, k: int = 10) -> DataFrame:
    """(left_hash, right_hash, distance, risk, place): the k nearest other remembered messages of each message, by distance, then
    higher risk, then hash.

    What a pattern can contribute is its k + 1 best messages, and what a message can need is in the k + 1 patterns with the best
    first ones: so at most (k + 1) ** 2 rows meet for each pattern, whatever the number of equal or near messages, and only the
    k + 1 best of these are joined with the messages.
    """
    order = lambda by, *first: Window.partitionBy(by).orderBy(*first, F.desc("risk"), "right_hash")
    top = lambda df, by, n, *first: df.withColumn("place", F.row_number().over(order(by, *first))).where(F.col("place") <= n)
    own = memory.select(F.col("simhash").alias("right_bits"), F.col("message_hash").alias("right_hash"), "risk")
    best = top(own, "right_bits", k + 1)
    nearest = top(pairs.join(best.where("place = 1").drop("place"), "right_bits"), "left_bits", k + 1, "distance").select("left_bits", "right_bits", "distance")
    wanted = top(nearest.join(best.drop("place"), "right_bits"), "left_bits", k + 1, "distance").drop("place", "right_bits")
    asked = messages.select(F.col("message_hash").alias("left_hash"), F.col("simhash").alias("left_bits")).distinct()
    return top(asked.join(wanted, "left_bits").where("left_hash != right_hash"), "left_hash", k, "distance").select("left_hash", "right_hash", "distance", "risk", "place")
