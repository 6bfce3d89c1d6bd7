"""Rules without a SQL twin, on golden rows."""

import json

import pytest
from pyspark.sql import functions as F

from lurewatch import registry  # noqa: F401 (the plans load through it)
from lurewatch.fixtures import fixture
from lurewatch.operators import brands, datasets, identity, messages, pages, registries, supply, threats
from lurewatch.sources import feeds


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("one")).select(column.alias("x")).first().x


def test_cvss(spark):
    score = lambda v: one(spark, registries.cvss_score(F.col("v")), v=v)
    assert score("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H") == 9.8
    assert score("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H") == 10.0
    assert score("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N") == 0.0 and score("bad") == 0.0
    assert score("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N/C:H/I:H/A:H") == 9.8  # the last of repeated parts
    assert [one(spark, registries.severity_level(F.col("s")), s=s) for s in (9.0, 7.0, 4.0, 0.1, 0.0)] == ["critical", "high", "medium", "low", "none"]
    assert [one(spark, registries.vulnerability_level(F.col("s")), s=s) for s in ("critical", "high", "medium", "low", "none")] == ["high", "high", "medium", "low", "medium"]


def test_summaries_verdicts_and_diffs(spark):
    text = lambda a, b: one(spark, registries.vulnerability_summary(F.col("a").cast("string"), F.col("b").cast("string")), a=a, b=b)
    assert text("s", "d") == "s" and text(" ", "d") == " " and text("", " First! Second") == "First" and text(None, None) == "No description" and text("", "x" * 300) == "x" * 200
    verdict = lambda t: tuple(one(spark, supply.parsed_verdict(F.col("t")), t=t))
    assert verdict('x {"verdict":"Malicious","confidence":0.9,"reasons":["r",2]} y') == ("malicious", 0.9, ["r"], []) and verdict('{"verdict":"odd","suspicious_patterns":["p"]}') == ("uncertain", 0.5, [], ["p"])
    unread = ("uncertain", 0.0, ["LLM response could not be parsed"], [])
    assert verdict("none") == verdict('{"confidence":1}') == verdict('{"verdict":1}') == unread
    cut = lambda t: one(spark, supply.truncated_diff(F.col("t"), 5), t=t)
    assert cut("abc") == "abc" and cut("ab\ncdef") == "ab" and cut("abcdefgh") == "abcde" and cut("\nabcdefgh") == ""


def test_repository_urls(spark):
    norm = lambda u: one(spark, supply.normal_git_url(F.col("u")), u=u)
    assert norm("git+ssh://git@x/y.git") is None and norm("git@h.org:a/b.git") == "https://h.org/a/b" and norm("git+git://h/a.git") == "https://h/a" and norm("git@h.org/a") is None
    pair = lambda u: one(spark, registries.owner_repo(F.col("u")), u=u)
    assert tuple(pair("https://github.com/o/r.git/")) == ("o", "r.git") or tuple(pair("https://github.com/o/r.git/")) == ("o", "r")
    assert tuple(pair("https://git.own.org//a/b/c")) == ("a", "b") and pair("https://github.com/only") is None and pair("nothing") is None
    df = spark.createDataFrame([(0,)], "i int")
    assert df.select(supply.hosting_platform(F.lit("https://GitHub.com/x"))).first()[0] == "github" and df.select(supply.hosting_platform(F.lit("https://x"))).first()[0] == "self-hosted"


def test_registries_asked_on_request(spark):
    docs = [
        ("RubyGems", "g", None, '{"version":"2","gem":{"raw_created_at":"2024-06-30T00:00:00Z"}}'), ("Packagist", "p", None, '{"package":{"versions":{"9":{"time":"2024-06-28T00:00:00Z"}}}}'), ("Packagist", "q", None, "{}"),
        ("Go", "m", "1", '{"Time":"2024-06-25T00:00:00Z"}'), ("Go", "m", "2", '{"Time":"2024-06-01T00:00:00Z"}'), (None, None, None, None),
    ]
    packages = spark.createDataFrame([("g", "1", "RubyGems"), ("p", "1", "Packagist"), ("q", "1", "Packagist"), ("m", "1", "Go"), ("m", "2", "Go"), (None, None, None)], "name string, version string, ecosystem string")
    df, asof = spark.createDataFrame(docs, "ecosystem string, name string, version string, body string"), F.lit("2024-07-01 00:00:00").cast("timestamp")
    assert registries.registry_warnings(packages, df, asof).count() == 0
    assert sorted(r.warning for r in registries.registry_warnings(packages, df, asof, all_registries=True).collect()) == [
        "Go module m/1 is very new (published 6 days ago)", "Packagist package p/1 is very new (published 3 days ago)", "Packagist package p/1 version not found in registry", "Packagist package q/1 not found in registry",
        "RubyGems gem g/1 is very new (created 1 days ago)", "RubyGems gem g/1 requested but latest is 2",
    ]


def test_answers_and_flags(spark):
    fence = lambda x: one(spark, messages.without_fences(F.col("x")), x=x)
    assert fence(' ```json\n{"a":1}\n``` ') == '{"a":1}' and fence("```{}```") == "{}" and fence("{}") == "{}"
    columns = "memory_exact boolean, memory_similar int, url_flags array<string>, injection int, secret int, urgency_flag boolean, ai_flags array<string>, ai_missing string, ai_confidence int, capped boolean, overall_risk int"
    a, b = messages.message_flags(spark.createDataFrame([(True, 2, ["u"], 35, 85, True, ["x"], None, 50, True, 90), (None, None, None, 0, 0, False, None, "no assessment", 0, False, 10)], columns)).collect()
    assert a.flags == ["exact unsafe message memory match", "u", "prompt injection language detected", "possible secret in message", "phishing urgency/account language detected", "x", "ai-only medium risk capped without supporting evidence"]
    assert a.summary.startswith("High-risk message (90/100, AI confidence 50/100): exact unsafe") and (b.flags, b.summary) == (["ai unavailable: no assessment"], None)


def test_unsafe_messages_are_remembered(spark):
    rows = [("warn_receiver", 60, 0, 0), ("warn_sender", 60, 0, 60), ("allow", 10, 85, 0), ("warn_both", 75, 0, 0), ("block", 95, 0, 0), ("allow", 75, 0, 0)]
    df = spark.createDataFrame(rows, "d string, r int, s int, i int")
    assert [r.x for r in df.select(messages.store_as_unsafe(F.col("d"), F.col("r"), F.col("s"), F.col("i")).alias("x")).collect()] == [False, True, True, True, True, True]


def test_online_score(spark):
    columns = "start int, brand_matched boolean, page_brand boolean, credentials boolean, favicon_match boolean, external_form boolean, domain_changed boolean, whois_age int, provider string, http_status int, http_error boolean, whois_error boolean, official boolean"
    rows = [
        (55, True, False, True, False, False, False, 10, "p", 200, False, False, False), (60, True, False, False, False, False, False, 400, None, 200, False, True, False),
        (20, False, False, False, False, False, False, None, None, None, True, False, False), (5, True, False, True, False, False, False, None, None, 200, False, False, True), (20, False, False, False, False, True, False, None, None, 200, False, False, False),
        (20, False, True, True, False, True, True, 5, "p", 200, False, False, False), (70, True, False, False, False, False, True, 90, None, 200, False, False, False), (80, True, False, False, False, False, False, 90, None, None, False, False, False),
        (20, False, False, False, True, False, False, None, None, 200, False, False, False),
    ]
    got = [(r.online_score, r.online_confidence) for r in pages.score_online(spark.createDataFrame(rows, columns)).collect()]
    # a page's own brand lifts the score with credentials, but only a matched brand counts redirects, age and provider
    assert got == [(95, 90), (35, 55), (20, 45), (5, 95), (40, 60), (95, 90), (80, 75), (60, 75), (40, 60)]


def test_whois_texts(spark):
    asof = F.lit("2024-07-01 00:00:00").cast("timestamp")
    texts = [
        "Domain: x\nCreation Date: 2024-06-10T00:00:00Z\nRegistrar: A\nprivacy", "created: 01.05.2024 10:00:00\nregistrar: B\nexpire: 1.1.2030", "Created on 2020-01-01\nREDACTED", "REGISTERED: 2024-06-30T01:00:00.123+02:00\nRedacted",
        " Creation Date: 2020-01-01T00:00:00Z", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    for strict, want in (
        (False, [(21, "A", True, 80), (60, "B", False, 40), (None, None, True, 40), (1, None, False, 60), (None, None, False, 20), (None, None, False, 20)]),
        (True, [(21, "A", True, 80), (None, "B", False, 20), (None, None, True, 40), (1, None, True, 80), (None, None, False, 20), (None, None, False, 20)]),
    ):
        got = [(r.age_days, r.registrar, r.privacy, r.whois_risk) for r in pages.whois_facts(df, asof, strict=strict).orderBy("i").collect()]
        assert got == want
    assert [r.expires_text for r in pages.whois_facts(df, asof).orderBy("i").collect()][:3] == [None, "1.1.2030", None]


def test_page_facts(spark):
    html = [
        "<TITLE a='b'> A &amp;lt; B\n c </TITLE><meta content='Site' property='og:site_name'><link rel='x canonical' href='http://www.Shop.co.uk/a'>G-AB1 clarity('set', 'k9')<FORM><form>",
        '<meta property="og:site_name" content=""><link href="https://late.example.com" rel="canonical"><link rel="manifest" href="/m.json">seed phrase', None,
    ]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string")
    a, b, c = pages.page_metadata(df).orderBy("i").collect()
    assert (a.title, a.og_site_name, a.canonical_domain, a.analytics_ids, a.form_count) == ("A < B c", "Site", "shop.co.uk", ["G-AB1", "k9"], 2)
    assert (b.og_site_name, b.canonical_domain, b.manifest_domain, b.has_credential_words, b.title) == (None, None, None, True, None)
    assert (c.title, c.analytics_ids, c.form_count, c.has_password) == (None, [], 0, False)
    rows = [("https://a.shop.com/x", "<form x action = 'https://b.shop.com/in'><form action='https://evil.net'>"), ("https://shop.com", '<form action="/in"><form id=1 action="HTTPS://Evil.net/p">mfa card number'), (None, None)]
    got = pages.page_evidence(spark.createDataFrame(rows, "url string, html string"))
    assert [(r.external_form, r.otp_field, r.card_field, r.page_forms) for r in got.collect()] == [(False, False, False, 2), (True, True, True, 2), (False, False, False, 0)]
    kinds = spark.createDataFrame([("u", "https://a.b.example/x", 200, "Text/HTML; x", "abcdef"), ("u", None, 200, "image/png", "abc"), ("u", "http://x.org", 500, None, "abc")], "url string, final_url string, status int, content_type string, html string")
    assert [(r.html, r.final_domain, r.fetch_error) for r in pages.read_pages(kinds, 4).collect()] == [("abcd", "b.example", None), (None, None, "unsupported content-type: image/png"), ("abc", "x.org", None)]


def test_jsonld_nesting(spark):
    deep = '{"@type":"brand","name":"Deep","sameAs":[["https://d.example.com"],"#x",5]}'
    for _ in range(20):
        deep = '[{"@graph":' + deep + ',"@type":"WebPage","name":"no"}]'
    blocks = [deep, '{"@type":{"x":"MyCorporation"},"name":7,"url":"https://www.corp.com/a"}', "[1, {}]", "{"]
    df = spark.createDataFrame([(i, f"<script id='j' type='application/ld+json'> {b} </script>") for i, b in enumerate(blocks)] + [(9, None)], "i int, html string")
    got = {r.i: (r.org_names, r.org_domains, r.same_as_domains) for r in pages.jsonld_facts(df, "i").collect()}
    assert got == {0: (["Deep"], [], ["example.com"]), 1: ([], ["corp.com"], [])}


def test_favicons(spark):
    url = lambda u: one(spark, pages.favicon_url(F.col("u")), u=u)
    assert url(" http://a.b/c?d") == "http://a.b/favicon.ico" and url("a.b") == "https://a.b/favicon.ico"
    assert one(spark, pages.favicon_hash(F.col("b").cast("binary"), 3), b="abcd") is None and len(one(spark, pages.favicon_hash(F.col("b").cast("binary")), b="abcd")) == 64
    df = spark.createDataFrame([("paypal", "aa"), ("paypal", "bb"), (None, "aa")], "brand_key string, icon_hash string")
    known = spark.createDataFrame([("paypal", "AA"), ("paypal", "aa")], "brand_key string, hash string")
    assert sorted((r.brand_key or "", r.icon_hash, r.favicon_match) for r in pages.favicon_matches(df, known).collect()) == [("", "aa", False), ("paypal", "aa", True), ("paypal", "bb", False)]


def test_identity_names(spark):
    none = None
    rows = [
        ([], none, none, none, none, "Home | Acme Shop - x"), (["Org.com"], "Site", none, none, none, "T"), ([], none, none, none, none, "ab"), ([], none, none, none, "Big - Small", "T"), ([], none, "App", "Apple", "Og", "T"),
        ([], none, none, none, none, "Úvod: Člověk.net"), ([], none, none, none, none, "home"), ([], none, none, none, none, none),
    ]
    df = spark.createDataFrame(rows, "org_names array<string>, og_site_name string, application_name string, apple_app_title string, og_title string, title string")
    assert [r.name for r in identity.identity_name(df).collect()] == ["Acme Shop", "Org", None, "Big", "App", "Člověk", "home", None]
    assert one(spark, identity.identity_key(F.col("v")), v="Člověk & Ñandú 1!") == "clovekandu1".replace("clovekandu1", "cloveknandu1")


def test_labelled_rows(spark):
    df = spark.createDataFrame([("s", None, " b ", 1), (None, "me", "", 0), (None, None, None, 1), (" ", "x", "y", 2)], "subject string, sender string, body string, label int")
    assert [tuple(r) for r in datasets.normalize_labelled_rows(df).collect()] == [("Subject: s\nb", True), ("From: me\n", False), ("From: x\ny", True)]
    assert [r.expected_unsafe for r in datasets.normalize_labelled_rows(df, (1, 3)).collect()] == [True, False, False]
    mixed = spark.createDataFrame([("", "t", "Phishing Email"), (None, None, "Safe Email"), (None, "t", "Safe Email")], "content string, text string, `Email Type` string")
    assert [tuple(r) for r in datasets.normalize_labelled_rows(mixed).collect()] == [("", True), ("t", False)]
    scored = spark.createDataFrame([(60, 10, True), (60, 10, False), (10, 10, None)], "a int, b int, expected_unsafe boolean")
    assert datasets.label_agrees(scored, ["a", "b"]).count() == 2


def test_text_quality_and_urls(spark):
    base = "Please read the notes of the last meeting and send your remarks until noon today."
    texts = [base, base + " " + base + " !!!!!!!!!!!!", base + " " + base + " !!!!!!!!!!!!!", base + " * * * * * x * * * * *", base + " * * * * *", base + " " + "<>[]$" * 3, base + " " + "()@#" * 6, "  " + base[:70] + "  " * 20, None, base * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.good for r in datasets.text_quality(df, "text").orderBy("i").collect()] == [True, True, False, False, True, False, True, False, False, False]
    hints = [(False, 0, "see WWW.x.org"), (False, 0, "none"), (True, 0, None), (None, 2, None), (None, None, "HTTPS://x")]
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(hints)], "i int, contains_url boolean, url_count int, message string")
    assert [r.has_url for r in datasets.with_has_url(df).orderBy("i").collect()] == [True, False, True, True, True]
    lists = spark.createDataFrame([([], "a"), (["x"], "a"), (None, "www.")], "urls array<string>, message string")
    assert [r.has_url for r in datasets.with_has_url(lists).collect()] == [False, True, True]
    text = spark.createDataFrame([(" ", "a"), ("x", "a")], "urls string, message string")
    assert [r.has_url for r in datasets.with_has_url(text).collect()] == [False, True]


def test_training_rows(spark):
    import hashlib

    df = spark.createDataFrame([(3, " hi ", "s"), (4, "\n", "s"), (5, "x" * 12 + " www.a", None)], "i int, text string, source string")
    a, b = datasets.training_rows(df, "i", "text", F.col("source"), most=10).collect()
    assert (a.id, a.message, a.has_url) == ("s-3-" + hashlib.sha256(b"s3hi").hexdigest()[:8], "hi", False)
    cut = "x" * 10 + "\n[truncated]"
    assert (b.id, b.message, b.has_url) == ("unknown-5-" + hashlib.sha256(f"unknown5{cut}".encode()).hexdigest()[:8], cut, True)


def test_worker_tags(spark):
    df = spark.createDataFrame([("high", "T-Mobile & Co", False, 60, "pages.dev"), ("low", None, True, 5, None)], "risk_level string, matched_brand string, official boolean, brand_score int, hosting_provider string")
    got = [r.tags for r in identity.brand_tags(df, worker=True).collect()]
    assert got == [["risk_level:high", "brand_seen", "brand:t_mobile___co", "brand_impersonation", "known_hosting_provider", "hosting_provider:pages_dev"], ["risk_level:low", "official_brand_domain"]]


def test_due_feeds_and_learned_brands(spark):
    feeds_ = spark.createDataFrame([("a", 5), ("b", 60), ("c", 60)], "source string, interval_minutes int")
    state = spark.createDataFrame([("a", 1000), ("b", 1000)], "source string, updated_at long")
    assert sorted(r.source for r in threats.due_feeds(feeds_, state, 1000 + 31 * 60).collect()) == ["a", "c"]
    static = brands.default_brands(spark)
    both = brands.with_learned(static, spark.createDataFrame([("New", ["new.example"], 0)], "brand string, official_domains array<string>, ord int"))
    assert both.where("brand = 'New'").first().brand_ord == static.count()


def test_manifests(spark, tmp_path):
    (tmp_path / "i.html").write_text("""<a href="1.json">x</a><a href="x.txt"></a><a href='2.json'></a><a href="1.json"></a><a href=3.json></a><a href="http://a.example/d/4.json"></a>""" + '<a href="5.json"></a>' * 9)
    names = lambda f, kind: [r.name for r in feeds.manifest_names(spark, str(tmp_path / f), kind).orderBy("at").collect()]
    assert names("i.html", "misp_dir") == ["1.json", "2.json", "1.json", "http://a.example/d/4.json", *["5.json"] * 3]
    (tmp_path / "m.json").write_text('[{"uuid": "u1", "id": "x"}, {"id": "u2"}, {"uuid": null, "id": "u3"}, {"uuid": 4}, "u5", {"info": 1}, ' + ", ".join('{"uuid": "u1"}' for _ in range(60)) + "]")
    assert names("m.json", "misp_manifest") == ["u1.json", "u2.json", *["u1.json"] * 44]
    (tmp_path / "map.json").write_text('{"u1": {"info": "x"}}')
    assert names("map.json", "misp_manifest") == []


def test_only_listed_files_are_opened(spark, tmp_path):
    event = lambda v: json.dumps({"Event": {"Attribute": [{"type": "url", "value": v}]}})
    (tmp_path / "i.html").write_text("<a href='1.json'></a><a href='2.json'></a><a href='1.json'></a><a href='gone.json'></a><a href='http://x.example/d/3.json'></a>")
    for n in (1, 2, 3):
        (tmp_path / f"{n}.json").write_text(event(f"http://{n}"))
    (tmp_path / "broken.json").write_text("{broken")
    rows = feeds.read_listed(spark, str(tmp_path / "i.html"), str(tmp_path), "misp_dir", "s")
    assert sorted(r.value for r in rows.collect()) == ["http://1", "http://1", "http://2", "http://3"]
    assert all("broken" not in f for f in rows.inputFiles())
    (tmp_path / "i.html").write_text("<a href='gone.json'></a>")
    assert feeds.read_listed(spark, str(tmp_path / "i.html"), str(tmp_path), "misp_dir", "s").count() == 0
    (tmp_path / "i.html").write_text("<a href='broken.json'></a>")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        feeds.read_listed(spark, str(tmp_path / "i.html"), str(tmp_path), "misp_dir", "s").collect()


def test_every_event_has_a_page_and_a_role_in_the_queue(spark):
    from lurewatch.plans import table_queries

    for sf in ("0.001", "0.01", "0.1"):
        d = f"/root/testdata/sf{sf}"
        events, pages = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("events", "pages"))
        own = fixture(spark, d, "fx_url_events")
        n = events.count()
        assert own.count() == n and own.select("url").distinct().count() == pages.join(events.select((F.col("event_id") % pages.count()).alias("page_id")), "page_id", "left_semi").select("url").distinct().count()
        assert table_queries._queue(spark, d).count() + own.where("seq % 4 = 1").count() == n
