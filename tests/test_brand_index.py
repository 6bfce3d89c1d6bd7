"""Tokens under their rarest grams: the same matches as by force, from few of the urls' grams."""

import random

from pyspark.sql import functions as F

from lurewatch.operators import brands, messages


def label_has(label, token):
    return label == token or label.startswith(token + "-") or label.endswith("-" + token) if len(token) <= 4 else token in label


def test_large_catalogue_by_force(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    tokens = sorted({word(rng.choice([2, 3, 4, 5, 8, 12])) for _ in range(1500)} | {"login", "loginbank"})
    urls = [f"https://{rng.choice(tokens)}{rng.choice(['', '-', 'x'])}{word(4)}.{rng.choice(['com', 'example'])}/{word(6)}/{rng.choice(tokens)}?login={word(3)}" for _ in range(300)]
    urls += [f"https://{rng.choice(tokens)}.{word(5)}-{rng.choice(tokens)}.com/" for _ in range(100)]
    catalogue = spark.createDataFrame([(i, [t]) for i, t in enumerate(tokens)], "brand_ord int, tokens array<string>")
    parts = messages.with_url_parts(spark.createDataFrame([(u,) for u in sorted(set(urls))], "url string"))
    want = set()
    for r in parts.collect():
        label, subs, path = r.registrable.split(".")[0], (r.subdomain or "").split("."), r.path_query
        for i, token in enumerate(tokens):
            found = (label_has(label, token), r.subdomain is not None and any(label_has(s, token) for s in subs), token in path)
            if any(found):
                want.add((r.url, i, token, *found))
    got = [tuple(r) for r in brands.token_matches(parts, catalogue).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_few_grams_are_joined(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = [(f"https://{word(9)}.com/{word(20)}/login/account?{word(10)}",) for _ in range(2000)]
    parts = messages.with_url_parts(spark.createDataFrame(rows, "url string"))
    tokens = spark.createDataFrame([(t,) for t in ("accountpro", "loginbank", "paypal", "microsoft", "ab")], "token string")
    index = brands.rarest_grams(tokens, parts.select(brands._searched(parts).alias("text")))
    assert {r.token: r.gram for r in index.where("token in ('accountpro', 'loginbank')").collect()}["loginbank"] not in ("login",)
    grams = parts.select(F.explode(brands._url_grams(brands._searched(parts))).alias("gram"))
    assert grams.where(brands.gram_filter(index)).count() * 10 < grams.count()
    assert grams.join(index, "gram", "left_semi").count() == grams.where(brands.gram_filter(index)).join(index, "gram", "left_semi").count()
