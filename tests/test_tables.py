"""Global row numbers without a single task."""

import random

from pyspark.sql import functions as F

from lurewatch import tables


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(20)]), rng.choice("abc"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, i int").withColumn("row", F.lit("mine")).withColumn("at", F.lit("mine"))
    got = sorted((r.n, r.a, r.b, r.row, r.at) for r in tables.numbered(df.repartition(7), "a", "b DESC", name="n").collect())
    want = sorted(((-1 if a is None else a, -ord(b)) for a, b, _ in rows))
    assert [n for n, *_ in got] == list(range(3000)) and [(-1 if a is None else a, -ord(b)) for _, a, b, *_ in got] == want
    assert {x[3:] for x in got} == {("mine", "mine")}


def test_equal_rows_stay_in_input_order_and_spread(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id"))
    out = tables.numbered(df, "k")
    assert out.where("nth != id").isEmpty() and out.count() == 4000
    assert tables.numbered(df.limit(0), "k").count() == 0


def test_released_tables_are_gone(spark):
    kept = tables.written(spark.range(3), "kept")
    path = kept.inputFiles()[0].rpartition("/")[0]
    assert kept.count() == 3 and tables.release(spark) >= 1
    assert not tables.files.exists(spark, path) and tables.release(spark) == 0
