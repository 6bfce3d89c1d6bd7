"""The corpus operators against brute force, round trips and held-out labels, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from lurewatch.llm import chatformat, components, decontam, fingerprint, linededup, mixing, neardup, quality, queries, sharding, toxicity, urlfilter
from lurewatch.llm.common import held_out, table, words

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six seven", "en", "a", 33), (3, "one two three four five six seven", "en", "a", 33), (None, "lonely text without an id", "en", None, 1), (4, long, "de", "b", len(long)), (5, "\n \t", "en", "a", 3), (6, "!!! ???", "en", "a", 7)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("score", F.lit("s")).withColumn("h", F.lit("h")).withColumn("node", F.lit(1)).withColumn("size", F.lit("x")).withColumn("shard", F.lit(9)).withColumn("key", F.lit("k"))


def accuracy(rows, label):
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 500 and accuracy(rows, "quality") > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert accuracy(rows, "toxic") > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t ѕtupid $cum 2024 555-1234 ｃlown") == ["idiot", "stupid", "scum", "clown"]
    a = toxicity.Lexicon({" idiot ": 3.0, " mor": 2.0, " idiot  proof ": 0.0}).automaton()
    d = toxicity.density(["idiot proof", "an idiot idiot", "moronic", "humor", None, ""], a)
    assert d[0] == d[3] == d[4] == d[5] == 0 and d[1] > d[2] > 0


def test_lexicon_does_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    rng = random.Random(11)
    common = ["".join(rng.choices("abcdefghij", k=3)) + "q" for _ in range(60)]
    rows = [(i, " ".join(rng.sample(common, 6) + (["zlurgh"] if i % 10 == 0 else []) + [f"own{chr(97 + i % 26)}{chr(97 + i // 26)}"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    learned = []
    for tasks, held in (("1", 200_000), ("100", 200_000), ("1", 50)):
        monkeypatch.setattr(toxicity, "HELD_TERMS", held, raising=False)
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        try:
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            learned.append(toxicity.fit_toxicity(docs, labels).weights)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    assert learned[0] == learned[1] == learned[2] and " zlurgh " in learned[0] and not any(f" {w} " in learned[0] or f" {w}" in learned[0] for w in common)


def test_models_on_awkward_rows_and_without_labels(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        model = fit(awkward, labels)
        assert score(awkward, model).count() == awkward.count()
        assert score(awkward.limit(0), model).count() == 0
    some = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (None, 1, 1), (4, None, None)], labels.schema)
    assert quality.score_quality(awkward, quality.fit_quality(awkward, some)).where("score is null").count() == 0


def edits(a, b, free=False):
    row = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return min(row) if free else row[-1]


def test_alignments_equal_dynamic_programming():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 24))] for _ in range(2))
        if rng.random() < 0.7:
            b = [x for x in a if rng.random() > 0.15] or [0]
        k = rng.randrange(0, 10)
        assert neardup.banded_distance(a, b, k) == min(edits(a, b), k + 1)
        k = min(3, len(a) - 1)
        assert decontam.best_within(a, b, k)[0] == min(edits(a, b, free=True), k + 1)


def classes_by_force(ids, texts):
    split = [w.hashes[w.bounds[i] : w.bounds[i + 1]] for w in words(pa.array(texts, pa.string())) for i in range(len(w.offsets) - 1)]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (len(split[a]) == 0 and len(split[b]) == 0 and (texts[a] or "") == (texts[b] or "")) or (len(split[a]) and len(split[b]) and neardup.similarity(split[a], split[b]) >= 0.8):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(ids[i])
    return sorted(sorted(g) for g in groups.values())


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(60, 160))]
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(g):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    for i in range(40):  # many share a passage and nothing else
        texts.append(" ".join(passage + [f"u{i}x{rng.randrange(999)}" for _ in range(50)]))
    texts += ["", None, "!!", "short one", "short one"]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in neardup.near_duplicate_classes(df).collect():
        got[r.class_id].append(r.doc_id)
        assert r.class_id <= r.exact_id <= r.doc_id
    assert sorted(sorted(g) for g in got.values()) == classes_by_force(ids, texts)
    kept = neardup.keep_one(df.withColumn("node", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "node"] and sorted(r.doc_id for r in kept.collect()) == sorted(got)


def classes(df):
    got = defaultdict(list)
    for r in neardup.near_duplicate_classes(df).collect():
        got[r.class_id].append(r.doc_id)
    return sorted(sorted(g) for g in got.values())


def test_members_of_large_buckets_meet(spark):
    rng = random.Random(8)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(100)
    texts = [passage + own(90) for _ in range(60)]  # a passage and nothing else in common
    pairs = []
    for i in range(20):  # pairs among them
        w = passage + own(90)
        pairs.append((len(texts), len(texts) + 1))
        texts += [w, [f"e{i}x{j}" if j >= 100 and j % 9 == 0 else x for j, x in enumerate(w)]]
    whole = own(200)
    for n in (200, 199, 150, 149, 148, 120, 119, 112, 111):  # cut copies: no shingle of their own, chains of links
        texts += [whole[:n], whole[:n] + [f"t{n}"]]
    for n in range(30):  # too far from the whole, near each other in groups of three
        texts.append(whole[:120] + [f"g{n // 3}w{j}" for j in range(60)] + [f"n{n}"])
    ids, joined = list(range(len(texts))), [" ".join(t) for t in texts]
    got = classes(spark.createDataFrame(list(zip(ids, joined)), "doc_id long, text string"))
    assert got == classes_by_force(ids, joined)
    assert all(any(set(p) <= set(g) for g in got) for p in pairs)


def test_pairs_of_blocks_that_many_texts_share(spark, monkeypatch):
    """Every run of words but those with a text's own separators is in many texts; most texts are near none. All buckets count as large."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    rng = random.Random(31)
    blocks = [[f"b{i}w{j}" for j in range(20)] for i in range(12)]
    chosen = []
    for _ in range(3000):
        c = sorted(rng.sample(range(12), 6))
        if all(len(set(c) & set(d)) <= 4 for d in chosen):
            chosen.append(c)
    separated = lambda c, name: [w for b in c for w in (*blocks[b], f"{name}s{b}")]
    texts = [separated(c, f"t{i}") for i, c in enumerate(chosen)]
    pairs = []
    for i in range(0, len(chosen), 30):  # few have a near copy
        pairs.append((i, len(texts)))
        texts.append(separated(chosen[i], f"copy{i}"))
    ids, joined = list(range(len(texts))), [" ".join(t) for t in texts]
    got = classes(spark.createDataFrame(list(zip(ids, joined)), "doc_id long, text string"))
    assert got == classes_by_force(ids, joined) and sum(len(g) > 1 for g in got) == len(pairs)


def test_first_runs_hold_every_near_pair(spark, monkeypatch):
    """The join of open texts against all pairs, by each length of runs alone and by all in turn."""
    rng = random.Random(32)
    hot = [f"h{i}" for i in range(80)]
    texts = []
    for size in (6, 9, 14, 40, 90):
        for i in range(12):
            w = hot[: size * (i % 4) // 2] + [f"w{rng.randrange(60 if i % 3 else 10**9)}" for _ in range(size)]
            edited = [x if rng.random() > 0.15 else f"e{rng.randrange(10**9)}" for x in w]
            texts += [w, edited, w[: len(w) - len(w) // 6], w[2:] + w[:1]]
    hashes = [np.array([zlib.crc32(x.encode()) for x in t], dtype=np.uint32) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if neardup.similarity(hashes[i].astype(np.uint64), hashes[j].astype(np.uint64)) >= 0.8}
    rows = [(bytearray([i]), len(h), i, bytearray(h.tobytes())) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "node binary, n int, class long, words binary")
    runs = [set(zip(h, h[1:], h[2:])) for h in (x.tolist() for x in hashes)]
    for grams, heavy in (((3,), 32), ((2,), 32), ((1,), 32), ((3, 2, 1), 4), ((3, 2, 1), 32)):
        monkeypatch.setattr(neardup, "GRAMS", grams)
        monkeypatch.setattr(neardup, "HEAVY", heavy)
        got, rest = set(), df
        for k in grams:
            met, again, _ = neardup._sharing(rest, k, 0.8)
            got |= {tuple(sorted((r.leader[0], r.node[0]))) for r in met.collect()}
            rest = rest if again is None else rest.join(again, "node", "left_semi")
        assert {(i, j) for i, j in near if runs[i] & runs[j]} <= got


def test_prints_hold_every_near_pair(spark, monkeypatch):
    """Members of one hot bucket: all near pairs, each told once though two buckets have it, and few others; no join of all of them."""
    rng = random.Random(41)
    hot = [f"h{i}" for i in range(12)]
    texts = []
    for i in range(150):
        w = (hot if i % 3 else hot[:2] * rng.randrange(20, 60)) + [f"w{rng.randrange(10**9)}" for _ in range(rng.choice((3, 40, 120, 130, 500)))]
        texts += [w, [x if rng.random() > (0.05, 0.15, 0.19)[i % 3] else f"e{rng.randrange(10**9)}" for x in w], w[len(w) // 6 :]]
    hashes = [np.array([zlib.crc32(x.encode()) for x in t], dtype=np.uint32) for t in texts]
    wide = [h.astype(np.uint64) for h in hashes]
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if neardup.similarity(wide[i], wide[j]) >= 0.8}
    node = lambda i: bytearray(i.to_bytes(2, "big"))
    held = spark.createDataFrame([(node(i), bytearray(h.tobytes())) for i, h in enumerate(hashes)], "node binary, words binary")
    members = spark.createDataFrame([(k, node(i), len(h), node(i)) for i, h in enumerate(hashes) for k in (-3, 5)], "key long, node binary, n int, root binary")
    got = [tuple(sorted(int.from_bytes(v, "big") for v in (r.leader, r.node))) for r in neardup._within(members, held, 0.8).collect()]
    assert len(got) == len(set(got)) and near <= set(got) and len(got) < 2 * len(near) + 100
    one = members.withColumn("root", F.lit(bytearray(b"r")))
    assert neardup._within(one, held, 0.8).count() == 0  # one class already
    # the whole operator, by groups and by the join for buckets that no group holds
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    by_groups = classes(docs)
    monkeypatch.setattr(neardup, "LARGE_BUCKET", neardup.SMALL_BUCKET)
    assert by_groups == classes(docs)


def test_recall_by_similarity(spark):
    """Links by the operator against alignment of the planted pairs; half of them share a passage with all others."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows, planted = [], []
    for band, shares in ((0.80, (0.2, 0.18, 0.16)), (0.85, (0.15, 0.13, 0.11)), (0.90, (0.1, 0.08, 0.05))):
        for i in range(240):
            w = (passage if i % 2 else []) + [f"w{rng.randrange(10**9)}" for _ in range((80, 200, 400)[i % 3])]
            edited = list(w)
            for p in rng.sample(range(60 if i % 2 else 0, len(w)), int(shares[i // 3 % 3] * len(w))):
                edited[p] = f"e{rng.randrange(10**9)}"
            planted.append((band, i % 2, len(rows)))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(edited))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = defaultdict(list)
    for band, shared, a in planted:
        found[band, shared].append(got[a] == got[a + 1])
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    assert len(set(got.values())) >= len(rows) // 2  # and nothing else is linked
    assert all(recall[0.80, s] >= 0.9 and recall[0.85, s] >= 0.97 and recall[0.90, s] >= 0.99 for s in (0, 1)), recall


def test_recall_at_the_threshold(spark):
    """Pairs of exactly 0.80, for each length alone, without and with a passage that all texts share."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    rows, planted = [], []
    for shared, size in ((False, 60), (False, 100), (False, 150), (False, 250), (False, 260), (False, 400), (True, 100), (True, 200), (True, 400)):
        for _ in range(200):
            w = (passage if shared else []) + [f"w{rng.randrange(10**9)}" for _ in range(size)]
            edited = list(w)
            for p in rng.sample(range(60 if shared else 0, len(w)), len(w) // 5):
                edited[p] = f"e{rng.randrange(10**9)}"
            planted.append(((shared, size), len(rows)))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(edited))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter(k for k, a in planted if got[a] == got[a + 1])
    assert min(found[k] for k, _ in planted) >= 180, found


def test_long_alignments(monkeypatch):
    rng = random.Random(4)
    cases = []
    for _ in range(120):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 60))]
        cases.append((a, [x for x in a if rng.random() > 0.1] or [1], rng.randrange(0, 12)))
    want = [neardup.banded_distance(*c) for c in cases]
    monkeypatch.setattr(neardup, "LONG", 1)
    assert [neardup.banded_distance(*c) for c in cases] == want
    long = np.arange(200_000, dtype=np.uint64)
    other = long.copy()
    other[::1000] = 7
    assert abs(neardup.similarity(long, other) - 0.999) < 1e-4 and neardup.similarity(long, np.append(other, long[:10])) > 0.99


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination_equals_search_by_force(spark):
    docs, bench = table(spark, SF, "documents").limit(60), table(spark, SF, "benchmark")
    items = [(r.item_id, [w.hashes for w in words(pa.array([r.text]))][0]) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = np.random.default_rng(3)
    texts = bench.collect()
    for i in range(12):  # passages with a few edits inside other texts
        w = texts[i].text.split()
        for _ in range(len(w) // 12):
            w[int(rng.integers(len(w)))] = "changed"
        rows.append((1000 + i, rows[i][1][:300] + " " + " ".join(w) + " " + rows[i + 1][1][:300]))
    want = set()
    for doc, text in rows:
        h = [w.hashes for w in words(pa.array([text]))][0].tolist()
        want |= {(doc, k) for k, t in items if edits(t.tolist(), h, free=True) <= len(t) // 5}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(df, bench).collect()}
    assert got == want and len({d for d, _ in want if d >= 1000}) == 12
    blocks = {(r.doc_id, r.item_id) for r in decontam.find_contamination(df, bench, block_items=7).collect()}
    assert blocks == want
    clean = decontam.drop_contaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_recall_of_fully_edited_items():
    """Items of 3 to 400 words with all the edits allowed, inside other text; several items and windows in one text."""
    rng = np.random.default_rng(6)
    word = lambda: f"v{rng.integers(10**6)}"
    lengths = [n for n in (3, 5, 9, 12, 20, 35, 60, 110, 200, 400) for _ in range(12)]
    texts = [" ".join(word() for _ in range(n)) for n in lengths]
    items = decontam.build_items(list(range(len(texts))), texts)
    found = planted = 0
    for first in range(0, len(texts), 4):
        parts, own = [], range(first, first + 4)
        for i in own:
            w = texts[i].split()
            for _ in range(len(w) // 5):
                kind, at = rng.integers(3), int(rng.integers(len(w)))
                if kind == 0:
                    w[at] = word()
                elif kind == 1:
                    w.insert(at, word())
                else:
                    w.pop(at)
            parts += [word() for _ in range(30)] + w
        got = decontam.Matcher(items).matches(pa.array([None, " ".join(parts)])).get(1, {})
        planted, found = planted + 4, found + sum(i in got for i in own)
        assert set(got) <= set(own)
    assert found / planted >= 0.97


def test_long_texts_and_items_in_bounded_windows(monkeypatch):
    monkeypatch.setattr(decontam, "HELD_WORDS", 4096)  # many small matrices
    item = " ".join(f"q{i % 50}" for i in range(210))
    long = [f"l{i}" for i in range(6000)]
    items = decontam.build_items([1, 2], [item, " ".join(long)])
    text = " ".join(item.split() * 40)  # thousands of windows
    changed = " ".join(w for i, w in enumerate(long) if i % 7)
    got = decontam.Matcher(items).matches(pa.array([text, "x " + changed + " y", "none of these"]))
    assert got[0][0][0] == 1.0 and 0.8 <= got[1][1][0] < 0.9 and 2 not in got and max(g.width for g in items.grades) <= 2 * decontam.LONGEST


def test_a_missed_recall_is_an_error(monkeypatch):
    monkeypatch.setattr(decontam, "_keys", lambda embedded, places: np.arange(embedded.shape[1], dtype=np.uint64) + np.uint64(len(embedded) * 1000 + decontam.MOST_WALKS * int(embedded.shape[1])))
    monkeypatch.setattr(decontam, "MOST_WALKS", 5)
    with pytest.raises(RuntimeError, match="recall"):
        decontam.build_items([1], ["one two three four five six seven"])


def test_decontamination_on_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (None, "lonely text without an id"), (4, "tiny"), (1, "one two three four five six seven")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = Counter((r.doc_id, r.item_id) for r in decontam.find_contamination(awkward, bench).collect())
    assert got == {(3, 1): 4, (None, None): 1}
    assert decontam.find_contamination(awkward, bench.limit(0)).count() == 0
    assert decontam.find_contamination(awkward.limit(0), bench).count() == 0
    kept = decontam.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(r.doc_id for r in awkward.where("doc_id is not null and doc_id != 3").collect())
    assert kept.where("doc_id is null").count() == awkward.where("doc_id is null").count() - 1


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_urls_follow_rules_and_links(spark):
    link = '<LINK rel="canonical" href="{}">'
    pages = [
        (1, "HTTP://M.Example.NET/en/x?q", None), (2, "http://a.net", ""), (3, None, "x"), (4, "no scheme", None), (5, "http://b.net/x#y", None), (6, "http://q.org/fr/1", None),
        (7, "http://alias.info/a", link.format("http://bad.net/1")), (8, "http://alias.info/b", link.format("http://alias.info/a/")), (9, "http://mixed.info/", link.format("http://www.example.net/en/2")),
        (10, "http://mixed.info/2", '<meta http-equiv="refresh" content="0; url=http://mixed.info/">'), (11, "http://mixed.info/2", link.format("http://bad.net/2")), (12, "http://free.info/", ""),
    ]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("mine"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, rules).collect()}
    assert got[1] == ("m.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("a.net", "", None, "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("net/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert [got[i][3] for i in (7, 8, 9, 10, 11, 12)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0


def test_links_are_resolved(spark):
    link, to = '<link href="{}" rel=canonical>', "<meta http-equiv=refresh content='0;url={}'>"
    pages = [
        (1, "http://a.info/x/p", link.format("/y")), (2, "http://a.info/y", link.format("http://bad.net/1")),  # a relative link to a blocked url's alias
        (3, "http://b.info/p?id=1", link.format("http://bad.net/2")), (4, "http://b.info/p?id=2", ""),  # queries are different resources
        (5, "https://c.info/d/e", to.format("../f/./g?x=1&amp;y=2")), (6, "http://c.info/f/g?x=1&y=2", link.format("//bad.net/3")),
        (7, "http://d.info/1", link.format("http://d.info/2") + to.format("http://bad.net/4")), (8, "http://d.info/2", None),  # every link counts
        (9, "http://e.info/1", link.format("mailto:x@bad.net") + link.format("#top") + to.format("javascript:go()")), (10, "http://f.info", link.format("?q")), (11, "http://f.info/?q", link.format("http://bad.net/5")),
        (12, None, link.format("http://bad.net/6")), (13, "http://g.info/a/", link.format("b")), (14, "http://g.info/a/b", link.format("http://www.example.net/en/") + link.format("http://bad.net/7")),
        (15, "http://h.info/" + "x" * 100_000, link.format("http://bad.net/8")),
    ]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("rule", "verdict", "host", "path", "key", "node", "root", "target", "a", "b"):
        df = df.withColumn(c, F.lit("mine"))
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(df, rules).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 5, 6, 7, 8, 10, 11, 15} and len(got) == 15
    seen = spark.createDataFrame([("http://free.info/", "http://bad.net/9"), (None, "x")], "from_url string, to_url string")
    free = spark.createDataFrame([(1, "http://free.info/", None), (2, "http://other.info/", None)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urlfilter.judge_urls(free, rules, seen).collect()} == {1: "block", 2: "allow"}


def test_chats_read_back(spark):
    hard = [r"\### Assistant: </turn> ok", "\\\\", "\\h\\e\\n", "### </turn>\n###\\", "", "a\nb", "</turn>\n### user\nx", "é\\"]
    rows = [(c, i, r, t) for c in range(6) for i, (r, t) in enumerate(zip(random.Random(c).choices(["user", "assistant", "sys\ntem", "as\\sistant"], k=8), random.Random(c).sample(hard, 8), strict=True))]
    df = spark.createDataFrame(rows, "k long, at long, role string, text string")
    for r in chatformat.format_chats(df, "k").select("k", chatformat.read_back(F.col("formatted")).alias("t"), chatformat.masked_text(F.col("formatted"), F.col("loss")).alias("loss")).collect():
        own = [(x[2], x[3]) for x in rows if x[0] == r.k]
        assert [(t.role, t.text) for t in r.t] == own and r.loss == "".join(t for role, t in own if role == "assistant")


def test_layouts_become_turns(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","input":"","output":"a"}',
        '{"prompt":"q","response":"a"}', '{"completion":"a","prompt":"q"}', '{"question":"q","answer":"a"}', '{"other":1}', "broken", None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "k long, record string")
    got = defaultdict(list)
    for r in chatformat.canonical_turns(df, "k", "record").orderBy("k", "at").collect():
        got[r.k].append((r.role, r.text))
    assert dict(got) == {i: [("user", "q"), ("assistant", "a")] for i in range(6)}


def lines_by_force(docs, min_docs=3, agree=0.7, depth=3):
    """Templates as sets of (position, token), counted by documents, with nothing hashed."""

    def mask(line):
        return re.sub(r"[^ ]*\d[^ ]*", "<*>", re.sub(r"[\s\xa0]+", " ", line).strip(" "))

    forms, leaves = defaultdict(set), defaultdict(set)
    for i, t in docs:
        for m in map(mask, (t or "").split("\n")):
            if m:
                forms[m].add((i, t))
                leaves[len(m.split(" ")), tuple(m.split(" ")[:depth])].add(m)
    gone = {m for m, d in forms.items() if len(d) >= min_docs}

    def ordered(of, groups):
        support = Counter()
        for m, own in of.items():
            support.update({(groups[m], x): len(forms[m]) for x in own})
        return {m: sorted((x for x in own if support[groups[m], x] >= min_docs), key=lambda x, m=m: (-support[groups[m], x], x[0])) for m, own in of.items()}

    for (n, _), members in leaves.items():
        inner = {m: list(enumerate(m.split(" ")))[depth:] for m in members}
        first = ordered(inner, dict.fromkeys(members))
        second = ordered(first, {m: own[-1] if own else None for m, own in first.items()})
        templates = defaultdict(set)
        for own in (first, second):
            for m, xs in own.items():
                sets = [xs[:k] for k in range(1, len(xs) + 1)] + ([xs[:k] + xs[k + 1 :] for k in range(len(xs))] if len(xs) + depth == n else [])
                for s in sets:
                    if n * agree <= len(s) + depth < n:
                        templates[frozenset(s)].add(m)
        for own in templates.values():
            if len(own) > 1 and len(set().union(*(forms[m] for m in own))) >= min_docs:
                gone |= own
    return {i: "\n".join(x for x in (t or "").split("\n") if not mask(x) or mask(x) not in gone) for i, t in docs}


def test_lines_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + [(9000 + i, f"user {i} logged in from host{i}\nhello  world\n\nown line {chr(97 + i)}") for i in range(5)] + [(9100, None), (9101, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaf", F.lit(1))
    assert {r.doc_id: r.text for r in linededup.drop_recurring_lines(df).collect()} == lines_by_force(docs)


@pytest.mark.parametrize(("templates", "per", "variables", "noise"), [(3, 20, 1, 0), (3, 20, 1, 400), (10, 3, 1, 0), (10, 20, 2, 300), (10, 3, 2, 50)])
def test_several_templates_in_one_leaf(spark, templates, per, variables, noise):
    """Lines of one length and lead: every template's lines go, however many others the leaf holds; unrelated lines stay."""
    rng = random.Random(templates * 100 + per)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
    pool = words[:40]
    docs, kept = [], {}
    for k in range(templates):
        base = words[100 + 12 * k : 109 + 12 * k]
        for _ in range(per):
            line = list(base)
            for v in range(variables):
                line[2 + 3 * v] = rng.choice(pool)
            docs.append((len(docs), "the job has " + " ".join(line)))
            kept[len(docs) - 1] = ""
    for _ in range(noise):
        docs.append((len(docs), "the job has " + " ".join(rng.sample(words[1000:], 9))))
        kept[len(docs) - 1] = docs[-1][1]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == kept and lines_by_force(docs) == kept


def test_fingerprints_equal_where_canonical_texts_are(spark):
    rows = [(1, "Café  au lait"), (2, "café AU lait "), (3, "cafe au lait"), (4, None), (5, ""), (6, "​"), (7, "ệ"), (8, "ệ"), (1, "Café  au lait")]
    got = defaultdict(set)
    for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.fingerprint].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == [[1, 2], [3], [4, 5, 6], [7, 8]]


def test_canonical_texts_equal_unicode_rules(spark):
    """Against Python's own normalisation and case folding, on random marks, scripts and orders."""
    import unicodedata

    rng = random.Random(12)
    alphabet = "aeoAEINuUy sſßẞﬁİıΣσςΩΐάÅÅΩK한글가각한クガガ゙कि़ড়אָּلآ" + "\u0301\u0323\u0302\u0308\u0327\u0345\u3099\u05b7\u0653\u0f71\u0f72" + "𝅗𝅥🙂豈"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 14))) for _ in range(400)] + [unicodedata.normalize("NFD", c) for c in ("Việt Nam ǖ", "ệ ắ", "각하", "ΐ")] + ["", "a" * 20_000 + "e\u0301" + "b" * 20_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fingerprint.composed(F.col("t")).alias("c"), fingerprint.case_folded(fingerprint.composed(F.col("t"))).alias("f")).collect()
    for r in got:
        want = unicodedata.normalize("NFC", texts[r.i])
        assert r.c == want, (texts[r.i], r.c, want)
        assert unicodedata.normalize("NFC", r.f) == unicodedata.normalize("NFC", unicodedata.normalize("NFC", want.casefold())), texts[r.i]


def test_fingerprint_query_equals_brute_force(spark, tmp_path):
    """Every column of the query, with ids at both ends of long, none, and far apart."""
    import unicodedata

    texts = ["Straße Ⅸ", "STRASSE ⅸ", None, "", "Cafe\u0301 " * 50, "CAFÉ " * 50, "x" * 9, "y" * 8]
    ids = [-(2**63), 2**63 - 1, 0, 7, None, 10**12, 5, 6]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0))
    plain = lambda t: " ".join(unicodedata.normalize("NFC", t or "").casefold().split())
    got = {r.doc_id: r for r in queries.op8_fingerprint(spark, str(tmp_path)).collect()}
    prints = {}
    for (i, t), (j, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(plain(t) == plain(edited)) and r.near_next == float(plain(t) == plain(nxt))
        for text, f in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(plain(text), f) == f
    assert len(set(prints.values())) == len(prints)


def test_different_texts_never_share_a_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.substring(c, 1, 1))  # a digest that collides
    rows = [(1, "ab"), (2, "ac"), (3, "AB"), (4, "b")]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a-1", 2: "a-2", 3: "a-1", 4: "b"}


def test_texts_are_compared_by_bytes_not_by_another_hash(spark, monkeypatch):
    """Texts whose hashes all agree, that of the whole text too, are told apart."""
    monkeypatch.setattr(fingerprint.F, "xxhash64", lambda *c: F.crc32(F.substring(F.col(c[-1]) if isinstance(c[-1], str) else c[-1], 1, 1).cast("binary")))
    rows = [(1, "ab"), (2, "ac"), (3, "ab"), (4, "b")]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(got.values())) == 3 and got[1] == got[3]


@pytest.mark.parametrize("ids", [[5], [0, 1, 2, 3], [-9, 4, 10**12, 7], [-(2**63), 0, 2**63 - 1], [10**15, *range(0, 3000, 3)]])
def test_next_rows(spark, ids, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 7)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    order = sorted(ids)
    assert {r.doc_id: r.next_text for r in fingerprint.with_next(df).collect()} == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def smallest_by_force(sizes, parts):
    return min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cut, len(sizes)))) for cut in itertools.combinations(range(1, len(sizes)), min(parts, len(sizes)) - 1))


def test_capacity_is_the_smallest():
    rng = random.Random(2)
    for _ in range(200):
        sizes, parts = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 5)
        assert sharding.smallest_capacity(sizes, parts) == smallest_by_force(sizes, parts)


def test_cuts_by_ranges_equal_cuts_of_all_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 16)
    rng = random.Random(3)
    ids = sorted(rng.sample(range(10**9), 120))
    sizes = [rng.randrange(1, 50) if rng.random() < 0.95 else 900 for _ in ids]
    starts = sharding.minimax_starts(spark.createDataFrame(list(zip(ids, sizes)), "first long, weight long"), 8)
    at = [0, *(ids.index(s) for s in starts), len(ids)]
    assert max(sum(sizes[a:b]) for a, b in itertools.pairwise(at)) == sharding.smallest_capacity(sizes, 8)


def shards_by_force(rows, parts):
    """Groups of equal texts by least id, the smallest capacity by search over all sums, cut greedily."""
    first, weight = {}, Counter()
    for i, t in rows:
        t = t or ""
        first[t] = min(first.get(t, i), i)
        weight[t] += len(t.encode()) + 1
    units = defaultdict(int)
    for t, w in weight.items():
        units[first[t]] += w
    order = sorted(units)
    sizes = [units[i] for i in order]

    def cut(capacity):
        at, filled, used = [0], 0, 1
        for n, x in enumerate(sizes):
            if filled + x > capacity:
                at, filled, used = at + [n], 0, used + 1
            filled += x
        return at if used <= parts else None

    capacity = next(c for c in sorted({sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}) if c >= max(sizes) and cut(c))
    starts = [order[n] for n in cut(capacity)]
    return {(i, t): sum(first[t or ""] >= s for s in starts) - 1 for i, t in rows}


@pytest.mark.parametrize("far", [False, True])
def test_shards_equal_brute_force(spark, monkeypatch, far):
    monkeypatch.setattr(sharding, "RANGES", 8)
    rng = random.Random(13)
    ids = rng.sample(range(10**6), 38) + ([-(2**63), 2**63 - 1] if far else [1, 2])
    rows = [(i, rng.choice([None, "", "same text", "x" * rng.randrange(40), f"own {i}"])) for i in ids]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df, 4).collect()
    want = shards_by_force(rows, 4)
    sizes = defaultdict(list)
    for i, t in rows:
        sizes[i, len((t or "").encode()) + 1].append(want[i, t])
    assert len(got) == len(rows) and all(r.shard in sizes[r.doc_id, r.size] for r in got)
    for shard in {r.shard for r in got}:
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)


def test_shards_keep_equal_texts_and_number_rows(spark, awkward):
    for df in (table(spark, MID, "documents"), awkward):
        rows = sharding.assign_shards(df, 8).join(df.select("doc_id", "text").distinct(), "doc_id").collect() if df is not awkward else sharding.assign_shards(df, 8).collect()
        assert len(rows) == df.count()
        slots, where = defaultdict(list), defaultdict(set)
        for r in rows:
            slots[r.shard].append(r.slot)
            if df is not awkward:
                where[r.text].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert sharding.assign_shards(awkward.limit(0), 8).count() == 0


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(4)
    size, p = rng.integers(0, 500, 300), np.full(300, 0.37)
    out = mixing.flight(size, p, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3


def targets_by_force(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_reaches_its_targets(spark, awkward):
    docs = table(spark, MID, "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    docs = docs.where("source is null or source != 'src0' or doc_id % 40 = 0")  # one source too small for its weight
    rows = mixing.take_counts(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
    want = targets_by_force(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-3 and 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in want)
    again = {(r.doc_id, r.copies) for r in mixing.take_counts(docs).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert mixing.take_counts(awkward).count() == awkward.count() and mixing.take_counts(awkward.limit(0)).count() == 0
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_text_operators_on_awkward_rows(spark, awkward):
    n = awkward.count()
    assert neardup.near_duplicate_classes(awkward).count() == n and neardup.near_duplicate_classes(awkward.limit(0)).count() == 0
    assert fingerprint.fingerprints(awkward).count() == n and fingerprint.with_next(awkward).count() == n
    assert linededup.drop_recurring_lines(awkward).count() == n and linededup.drop_recurring_lines(awkward.limit(0)).count() == 0
    assert fingerprint.with_next(awkward.limit(0)).count() == 0


def test_edited_texts_of_the_fingerprint_query(spark):
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    want = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        want[i] = hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in queries.op8_fingerprint(spark, SF).collect()} == want


def test_equal_rows_spread_over_mixing_blocks(spark, monkeypatch):
    """20,000 equal rows of one source: no block is larger than its bound, the targets hold, and reruns agree."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 256)
    settle = mixing._settle
    log = spark.sparkContext.accumulator(0, type("Most", (AccumulatorParam,), {"zero": lambda self, v: v, "addInPlace": lambda self, a, b: max(a, b)})())

    def watched(seed, level, last):
        inner = settle(seed, level, last)

        def run(key, rows):
            log.add(rows.num_rows)
            return inner(key, rows)

        return run

    monkeypatch.setattr(mixing, "_settle", watched)
    rows = [(1, "same words here", "a")] * 20_000 + [(i, f"own text {i} " + "w " * (i % 9), "ab"[i % 2]) for i in range(2, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = ({(r.doc_id, r.h, r.source): (r.n, r.words) for r in mixing.take_counts(docs, (5, 2), 3).groupBy("doc_id", "h", "source").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("words")).collect()} for _ in range(2))
    assert once == again and log.value <= 2 * 256
    taken = mixing.take_counts(docs, (5, 2), 3).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).collect()
    assert all(abs(r.words - r.target) <= 2 * 12 for r in taken)


def test_layouts_with_further_keys_and_unmapped_records(spark):
    records = [
        '{"id": 1, "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "gpt", "content": [{"type": "text", "text": "a"}, "b", {"type": "image"}]}], "source": "s"}',
        '{"prompt": "p", "response": "r", "source": "s", "text": "t"}', '{"instruction": "i", "input": "x", "output": "o", "meta": {"a": [1]}}', '{"role": "user", "text": "only"}',
        '{"messages": [{"role": "user"}]}', '{"messages": []}', '{"a": {"b": [1]}}', '{"a": {"b": ["x"]}}', "broken", None, "[1]",
    ]
    df = spark.createDataFrame(list(enumerate(records)), "_v int, record string").withColumn("v", F.lit("mine")).withColumn("n", F.lit("mine"))
    turns = defaultdict(list)
    for r in chatformat.canonical_turns(df, "_v", "record").orderBy("_v", "at").collect():
        turns[r._v].append((r.layout, r.role, r.text))
    assert dict(turns) == {
        0: [("messages", "user", "q"), ("messages", "assistant", "ab")], 1: [("prompt_response", "user", "p"), ("prompt_response", "assistant", "r")],
        2: [("instruction", "user", "i\n\nx"), ("instruction", "assistant", "o")], 3: [("turn_row", "user", "only")],
    }
    lost = {r.paths: r.records for r in chatformat.unmapped(df, "record").collect()}
    assert sum(lost.values()) == 7 and lost[None] == 2 and lost["OBJECT<a: OBJECT<b: ARRAY<BIGINT>>>"] == 1
    assert chatformat.canonical_turns(df.limit(0), "_v", "record").count() == 0 and chatformat.unmapped(df.limit(0), "record").count() == 0
