"""Neighbour search over bit patterns: exact keys, sampled bits, and the nearest few of each message."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import memory


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def planted(spark, n, seed=1):
    """Memory of random patterns, some of them shared by many messages, and messages at known distances from some of it."""
    rng = random.Random(seed)
    stored = [(f"s{i}", signed(rng.getrandbits(64)), rng.randrange(5)) for i in range(n)] + [(f"t{i}", 77, i % 7) for i in range(300)]
    asked = [(f"a{i}-{d}", signed((bits % (1 << 64)) ^ sum(1 << b for b in rng.sample(range(64), d)))) for i, (_, bits, _) in enumerate(stored[:n:3]) for d in (0, 5, 11, 12, 13)] + [(h, b) for h, b, _ in stored[-20:]]
    return spark.createDataFrame(asked, "message_hash string, simhash long"), spark.createDataFrame(stored, "message_hash string, simhash long, risk int"), asked, stored


def apart(a, b):
    return bin((a ^ b) % (1 << 64)).count("1")


def test_exact_and_sampled_pairs(spark):
    asked, stored, left, right = planted(spark, 600)
    want = {(a, b, apart(a, b)) for a in {x[1] for x in left} for b in {x[1] for x in right} if apart(a, b) <= 12}
    assert {tuple(r) for r in memory.hamming_pairs(asked, stored).collect()} == want
    got = [tuple(r) for r in memory.lsh_pairs(asked, stored).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.985 * len(want)
    assert memory.lsh_pairs(asked, stored.limit(0)).count() == 0


def test_pairs_of_all_messages(spark):
    """Every message of a pattern has its pairs, also with the other messages of the pattern, but not with itself."""
    asked, stored, left, right = planted(spark, 90)
    want = {(a[0], b[0], apart(a[1], b[1])) for a in left + [x[:2] for x in right[-30:]] for b in right if a[0] != b[0] and apart(a[1], b[1]) <= 12}
    more = asked.unionByName(spark.createDataFrame([x[:2] for x in right[-30:]], asked.schema)).distinct()
    assert sorted(map(tuple, memory.message_pairs(memory.hamming_pairs(more, stored), more, stored).collect())) == sorted(want)
    assert len(want) > 30 * 299 - 1


def test_join_returns_message_pairs(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    rows = entry.queries()["j11_hamming_join"](spark, sf_dir)
    assert rows.columns == ["left_hash", "right_hash", "distance"] and rows.where("left_hash = right_hash").isEmpty()
    assert rows.where("distance = 0").count() > 0


def test_recall_of_sampled_bits_at_the_greatest_distance():
    rng = random.Random(9)
    for bits in (6, 12, 16, 20):
        masks = [m % (1 << 64) for m in memory.sampled_masks(bits)]
        met = sum(any(not x & m for m in masks) for x in (sum(1 << b for b in rng.sample(range(64), 12)) for _ in range(2000)))
        assert met >= 0.98 * 2000 and all(bin(m).count("1") == bits for m in masks)


def test_comparisons_grow_with_the_patterns(spark):
    """Unrelated patterns: sampled bits meet for a few of them, whatever their number; the exact keys for about 4 % of all pairs."""
    rng, met = random.Random(3), {}
    for n in (1000, 8000):
        patterns = [rng.getrandbits(64) for _ in range(n)]
        bits = n.bit_length()
        masks = [m % (1 << 64) for m in memory.sampled_masks(bits)]
        some = patterns[:100]
        met[n] = sum(sum(1 for m in masks if not (a ^ b) & m) for a in some for b in patterns) / len(some)
    assert met[8000] < 3 * met[1000] and met[8000] < 0.03 * 8000


@pytest.mark.parametrize("k", [1, 3, 10])
def test_nearest_messages_by_force(spark, k):
    asked, stored, left, right = planted(spark, 60, k)
    want = set()
    for h, bits in left:
        found = sorted((apart(bits, b), -risk, g) for g, b, risk in right if g != h and apart(bits, b) <= 12)[:k]
        want |= {(h, g, d, -risk, i + 1) for i, (d, risk, g) in enumerate(found)}
    got = memory.top_similar(memory.hamming_pairs(asked, stored), asked, stored, k)
    assert {tuple(r) for r in got.collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_equal_patterns_make_no_pairs_of_messages(spark):
    asked = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("message_hash"), F.lit(5).cast("long").alias("simhash"))
    stored = asked.withColumn("risk", F.lit(1))
    assert [tuple(r) for r in memory.hamming_pairs(asked, stored).collect()] == [(5, 5, 0)]
    assert memory.top_similar(memory.hamming_pairs(asked, stored), asked, stored).count() == 30_000
