"""Conversation repair, periodic runs and quality rules against brute force, and on awkward rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import periodic, qualityrules, queries, repair
from lurewatch.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"


# Conversation repair


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text) by a search over whole edit strings, least cost and then letters first."""
    seen, facts = set(), []
    for role, text in rows:
        tail = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        facts.append((role, text, fault))
    follows = lambda said, x: {"": "su", "s": "u", "u": "a", "a": "u"}[said] == x or said == "" and x in "su"
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, said, out = heapq.heappop(heap)
        if (i, said) in done:
            continue
        done.add((i, said))
        if i == len(facts) and said in ("", "a"):
            return cost, audit, "\n".join(out), Counter(f for *_, f in facts)
        for x, name in (("u", "user"), ("a", "assistant")):
            if follows(said, x):
                heapq.heappush(heap, (cost + 3, audit + "I", i, x, (*out, f"{name}:")))
        if i < len(facts):
            role, text, fault = facts[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, said, out))
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                if role[:1] in ("s", "u", "a") and follows(said, role[:1]):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if follows(said, x):
                        heapq.heappush(heap, (cost + 3 + cut, audit + "R", i + 1, x, (*out, f"{name}:{text}")))


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 5, most])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", "", None]) if rng.random() < 0.1 else role
            text = rng.choice(["", " \n", None, "yes.", "no", "again?"]) if rng.random() < 0.3 else f"text {turn}" + rng.choice([".", "! ", "", " ,"])
            rows.append((conv or None, None if rng.random() < 0.02 else turn + rng.randrange(2), role, text))
    return rows


def expected(rows):
    told, own = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        own[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    for conv, items in own.items():
        items.sort()
        cost, audit, said, faults = cheapest([(r, t) for *_, r, _, t in items])
        first = [r[:1] for _, _, r, _, _ in items]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        turns = [t for known, t, *_ in items if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        told[conv] = (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return told


@pytest.mark.parametrize("chunk, composed", [(256, 1024), (5, 3), (1, 2)])
def test_repair_is_the_cheapest(spark, monkeypatch, chunk, composed):
    """Whole, and cut into chunks so small that conversations take several passes and several levels of composition."""
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(repair, "COMPOSED", composed)
    rows = conversations(random.Random(chunk), 40, 30)
    got = {r.conv_id: tuple(r) for r in repair.repair_conversations(spark.createDataFrame(rows, CONV)).collect()}
    assert got == expected(rows)


def test_passes_converge_and_stop_early():
    rng = random.Random(3)
    codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9]) for _ in range(3000))
    exact = repair.backward(codes, repair.FINISH)
    assert [repair.level(v) for v in exact] == exact
    for cut in (10, 1500, 2990):
        guess = repair.backward(codes[:cut], repair.FINISH)
        assert repair.backward(codes[:cut], exact[cut], guess) == exact[: cut + 1]
        assert guess[: max(0, cut - 200)] == exact[: max(0, cut - 200)]  # the guess is off for a few rows only


def test_one_long_conversation_takes_few_passes(spark):
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 97 else "assistant", f"text {t}.") for t in range(3000)]
    messages = repair.ordered(spark.createDataFrame(rows, CONV))
    chunks = messages.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct(*repair._facts()))).alias("rows"))
    coded = chunks.select("conv_id", "block", (F.col("block") == 3000 // repair.CHUNK_ROWS).alias("last"), F.arrow_udf(repair._codes, "binary")("rows.kind", "rows.flags", "rows.key", F.array().cast("array<binary>")).alias("codes"))
    costs, passes = repair.converge(coded)
    assert passes <= 3 and costs.count() == -(-3000 // repair.CHUNK_ROWS)
    assert {tuple(r) for r in repair.repair_conversations(spark.createDataFrame(rows, CONV)).collect()} == set(expected(rows).values())


def test_repaired_rows_have_the_pattern(spark):
    rows = [r for r in conversations(random.Random(8), 30, 12)]
    chunks = repair.repair_chunks(repair.ordered(spark.createDataFrame(rows, CONV)))
    said = defaultdict(list)
    for r in repair.repaired_rows(chunks).orderBy("block", "pos").collect():
        said[r.conv_id].append(r.role[0])
    assert said and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in said.values())


def test_repair_of_awkward_tables(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.repair_conversations(empty).count() == 0
    long = "word " * 200_000 + "end."
    rows = [(7, 0, "user", long), (7, 0, "user", long), (None, None, None, None), (8, 5, "assistant", "")]
    clashing = spark.createDataFrame(rows, CONV)
    for c in ("nth", "block", "role_", "key", "row", "at", "part", "rows"):
        clashing = clashing.withColumn(c, F.lit("mine"))
    got = {r.conv_id: tuple(r) for r in repair.repair_conversations(clashing).collect()}
    assert got == expected(rows) and got[7][7] == "KDI" and got[None][7] == "D" and got[8][7] == "D"


def test_damaged_rows(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"a. b! {t}?") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        hit, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        if hit:
            one = (c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            want += [one] * (1 + (hit == 3))
    assert Counter(tuple(r) for r in queries.damaged(spark.createDataFrame(rows, CONV)).collect()) == Counter(want)


# Periodic runs


def runs_by_force(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_force():
    rng, some = random.Random(5), 0
    for _ in range(2500):
        n = rng.randint(1, 90)
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 8])) for _ in range(n)]
        if rng.random() < 0.5:
            p, s = rng.randint(1, 12), rng.randrange(n)
            w = [w[i] if i < s else w[min(n - 1, s + (i - s) % p)] for i in range(n)]
        if rng.random() < 0.3:
            w[rng.randrange(n)] = 99
        want = runs_by_force(w)
        assert periodic.runs_of(periodic._ranks(np.array(w))) == want
        some += len(want)
    assert some > 500


def test_runs_of_long_texts():
    rng = random.Random(1)
    assert periodic.runs_of(np.zeros(100_000, dtype=np.int64)) == [(0, 100_000, 1)]
    assert periodic.runs_of(np.arange(100_000) % 1000) == [(0, 100_000, 1000)]
    assert periodic.runs_of(periodic._ranks(np.array([x for i in range(10_000) for x in (0, 1, 2, 3, 4, 5, 6, 100 + i)]))) == []
    assert periodic.runs_of(periodic._ranks(np.array(rng.sample(range(10**6), 50_000)))) == []
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.runs_of(np.array(b)) == runs_by_force(b)


def test_periodic_query_by_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        w, h = re.findall(WORD, d.text or ""), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(w)
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_force(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        most = min(((-length, s, q) for s, length, q in runs), default=None)
        best = (most[1], -most[0], most[2], 1000 * -most[0] // most[2]) if most else (None,) * 4
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[d.doc_id] == (len(runs), *best, digest("".join(f"{s},{x},{q}\n" for s, x, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_awkward_rows(spark):
    long = "a b c d " * 40_000 + "end"
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "x " * 12, None, "a"), (4, long, "en", "b"), (5, "\x00\x1f \x7f é ü", "en", "a")]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("runs_", "row", "found", "start", "length", "period", "most"):
        df = df.withColumn(c, F.lit("mine"))
    out = periodic.with_runs(df)
    assert out.columns == [*df.columns, "runs", "collapsed"]
    got = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed, r.row, r.found) for r in out.collect()}
    assert got[1, None] == got[2, ""] == ([], "", "mine", "mine") and got[None, "x " * 12] == ([(0, 12, 1)], "x", "mine", "mine")
    assert got[4, long][:2] == ([(0, 160_000, 4)], "a b c d end") and got[5, rows[5][1]][1] == rows[5][1]
    assert periodic.with_runs(df.limit(0)).count() == 0


# Quality rules


def counts_by_force(text):
    text = text or ""
    w, lines, windows = re.findall(WORD, text), [x for x in text.split("\n") if re.search(WORD, x)], defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(repeated)


def rules_by_force(rows, min_rows):
    """Counts, base_failed and kept of rows (doc_id, text, lang, source), thresholds from sorted values in buckets."""
    low = lambda v: v if v < 128 else v >> (v.bit_length() - 7) << (v.bit_length() - 7)
    facts = [(d, counts_by_force(t), lang, source) for d, t, lang, source in rows]
    failed = [c[0] < 10 or 100 * c[5] > 20 * c[0] for _, c, _, _ in facts]
    values = [(1000 * c[1] // max(1, c[0]), 1000 * c[2] // max(1, c[0]), 1000 * c[4] // max(1, c[3])) for _, c, _, _ in facts]
    out = []
    for (d, c, lang, source), bad, v in zip(facts, failed, values, strict=True):
        peers = [x for x, b, f in zip(values, failed, facts, strict=True) if not b and f[2:] == (lang, source)]
        if len(peers) < min_rows:
            peers = [x for x, b, f in zip(values, failed, facts, strict=True) if not b and f[2] == lang]
        if len(peers) < min_rows:
            peers = [x for x, b in zip(values, failed, strict=True) if not b]
        inside = True
        for m, (least, both) in enumerate(qualityrules.MEASURES.values()):
            s = sorted(low(x[m]) for x in peers)
            if s:
                q1, q3 = s[-(-len(s) // 4) - 1], s[-(-3 * len(s) // 4) - 1]
                reach = max(3 * (q3 - q1), least)
                inside = inside and v[m] <= q3 + reach and (not both or v[m] >= q1 - reach)
        out.append((d, *c, bad, not bad and inside))
    return out


@pytest.mark.parametrize("min_rows", [1, 20, 1000])
def test_rules_by_force(spark, min_rows):
    rng = random.Random(min_rows)
    rows = []
    for i in range(400):
        n = rng.choice([0, 3, 9, 10, 30, 200])
        vocabulary = [f"w{rng.randrange(10**rng.randint(1, 9))}" for _ in range(rng.choice([3, 50, 1000]))]
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t\n", " # ", "  "]) for _ in range(n))
        rows.append((i, text if i % 50 else None, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])))
    rows += [(1000, "x y z " * 30, "en", "a"), (1001, "same line of five words\n" * 2 + "\n".join(f"own line {i}" for i in range(20)), "en", "a"), (1002, " lead\r\nand\x0btail \x0c", "en", "a")]
    got = sorted(tuple(r) for r in qualityrules.apply_rules(spark.createDataFrame(rows, DOCS), min_rows).collect())
    assert got == sorted(rules_by_force(rows, min_rows))


def test_rules_adapt_to_the_source(spark):
    plain = "several words of a plain text that goes on for a while number {}"
    code = "x{} = a & b | c # do % it $ all * over < there > and some words more"
    rows = [(i, plain.format(i), "en", "prose") for i in range(150)] + [(1000 + i, code.format(i), "en", "code") for i in range(150)] + [(5000, code.format(9), "en", "prose")]
    kept = {r.doc_id: r.kept for r in qualityrules.apply_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not kept.pop(5000) and all(kept.values())


def test_sketches_merge(spark):
    facts = table(spark, "/root/testdata/sf0.01", "documents").select("lang", "source", qualityrules.text_counts(F.col("text")).alias("counts"))
    whole = {tuple(r) for r in qualityrules.merged(qualityrules.sketch(facts), "lang").collect()}
    for part in (F.crc32("source") % 2 == 0, F.col("counts.n_words") % 3 == 0):
        halves = qualityrules.sketch(facts.where(part)).unionByName(qualityrules.sketch(facts.where(~part)))
        assert {tuple(r) for r in qualityrules.merged(halves, "lang").collect()} == whole


def test_clean_documents_stay(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = qualityrules.apply_rules(docs).join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("not base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.995 * len(good) and sum(not r.kept for r in bad) > 0.95 * len(bad)


def test_rules_on_awkward_rows(spark):
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(150_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two three four five six seven eight nine ten", "en", "a"), (3, "one two three four five six seven eight nine ten", "en", "a"), (None, long, "en", None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("_lang", "row", "limits", "counts_", "measure", "low", "n"):
        df = df.withColumn(c, F.lit("mine"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in qualityrules.apply_rules(df).collect())
    assert got == [(0, 300_000, counts_by_force(long)[5], True, False), (1, 0, 0, True, False), (2, 0, 0, True, False), (3, 10, 0, False, True), (3, 10, 0, False, True)]
    kept = qualityrules.keep_good(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(*rows[2], *["mine"] * 7)] * 2
    assert qualityrules.apply_rules(df.limit(0)).count() == 0 and qualityrules.keep_good(df.limit(0)).count() == 0
