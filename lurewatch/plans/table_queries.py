"""Queries over state, pages, WHOIS texts and training data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, run, with_fixtures
from ..functions import text as t
from ..operators import datasets as ds
from ..operators import messages as m
from ..operators import pages as pg
from ..operators import state as st
from ..registry import query
from ..tables import shared_dir
from .message_queries import NORM_DOMAIN, NORM_URL, PARTS, SUFFIXES

_EV = f"""ev AS (SELECT seq, url, {NORM_URL.format('url')} AS url_norm, sha256({NORM_URL.format('url')}) AS url_hash, CAST(user_id AS VARCHAR) AS user_id, seen_at, verdict, risk, confidence, tag_no FROM fx_url_events)"""


def _events(s: SparkSession, d: str) -> DataFrame:
    e = fixture(s, d, "fx_url_events").withColumn("user_id", F.col("user_id").cast("string"))
    return e.withColumn("url_norm", t.normal_url(F.col("url"))).withColumn("url_hash", F.sha2("url_norm", 256))


def _ev(q: str) -> str:
    return with_fixtures(f"WITH {_EV} " + q if not q.lstrip().startswith(",") else f"WITH {_EV}{q}", "fx_url_events")


@query("k3_g3_url_state", _ev("SELECT url_hash, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count, arg_max(verdict, seq) AS verdict, arg_max(confidence, seq) AS confidence, arg_max(risk, seq) AS risk FROM ev GROUP BY url_hash"))
def _(s, d):
    return st.url_state(_events(s, d))


@query("k4_w6_tag_state", _ev("SELECT url_hash, 'tag' || tag_no AS tag, verdict AS source, max(seq) AS seq, arg_max(confidence, seq) AS confidence FROM ev GROUP BY ALL"))
def _(s, d):
    return st.latest(_events(s, d).select("url_hash", F.concat(F.lit("tag"), "tag_no").alias("tag"), F.col("verdict").alias("source"), "seq", "confidence"), ["url_hash", "tag", "source"])


@query("k5_f6_evidence", _ev("SELECT url_hash, kind, value_hash, created, CAST(row_number() OVER (PARTITION BY url_hash ORDER BY created DESC, kind, value_hash) AS INT) AS place FROM (SELECT url_hash, CASE tag_no WHEN 0 THEN 'whois' WHEN 1 THEN 'dns' WHEN 2 THEN 'cert' WHEN 3 THEN 'page' ELSE 'other' END AS kind, sha256('v' || seq) AS value_hash, seen_at AS created FROM ev) WHERE kind IN ('whois', 'dns', 'cert', 'hosting')"))
def _(s, d):
    kind = F.when(F.col("tag_no") == 0, "whois").when(F.col("tag_no") == 1, "dns").when(F.col("tag_no") == 2, "cert").when(F.col("tag_no") == 3, "page").otherwise("other")
    rows = st.evidence_rows(_events(s, d).select("url_hash", kind.alias("kind"), F.concat(F.lit("v"), "seq").alias("value"), F.col("seen_at").alias("created")), "value")
    return st.network_evidence(rows).select("url_hash", "kind", "value_hash", "created", "place")


@query("j2_j4_stored_urls", _ev(""", s AS (SELECT url_hash, count(*) AS seen_count, arg_max(risk, seq) AS risk FROM ev WHERE verdict <> 'unknown' GROUP BY url_hash), g AS (SELECT url_hash, string_agg(DISTINCT 'tag' || tag_no, ',' ORDER BY 'tag' || tag_no) AS tags FROM ev GROUP BY url_hash), b AS (SELECT url_hash, 'Brand ' || arg_max(tag_no, seq) AS matched_brand, arg_max(confidence, seq) AS brand_confidence FROM ev WHERE verdict = 'bad' GROUP BY url_hash)
SELECT u.url_hash, seen_count, risk, tags, matched_brand, brand_confidence FROM (SELECT DISTINCT url_hash FROM ev) u LEFT JOIN s USING (url_hash) LEFT JOIN g USING (url_hash) LEFT JOIN b USING (url_hash)"""))
def _(s, d):
    e = _events(s, d)
    tags = e.select("url_hash", F.concat(F.lit("tag"), "tag_no").alias("tag"))
    results = e.where("verdict = 'bad'").select("url_hash", "seq", F.concat(F.lit("Brand "), "tag_no").alias("matched_brand"), F.col("confidence").alias("brand_confidence"))
    out = st.with_stored(e.select("url_hash").distinct(), st.url_state(e.where("verdict != 'unknown'")), tags, st.latest(results, ["url_hash"]).drop("seq"))
    return out.select("url_hash", "seen_count", "risk", F.array_join("tags", ",").alias("tags"), "matched_brand", "brand_confidence")


_REG = PARTS.replace("FROM (SELECT DISTINCT url FROM urls)", "FROM (SELECT DISTINCT url FROM ev)")
_KIND = "CASE verdict WHEN 'good' THEN 'safe' WHEN 'bad' THEN 'unsafe' END"


@query("g4_g5_domain_reputation", _ev(f""", {_REG}, k AS (SELECT ev.*, registrable AS domain, {_KIND} AS kind FROM ev JOIN regs USING (url)),
r AS (SELECT domain, count(DISTINCT CASE WHEN kind = 'safe' AND trim(user_id) <> '' THEN user_id END) AS safe_users, count(*) FILTER (kind = 'unsafe') AS bad_events, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM k WHERE (kind = 'safe' AND trim(user_id) <> '') OR kind = 'unsafe' GROUP BY domain)
SELECT *, CASE WHEN bad_events > 0 THEN 0 WHEN safe_users >= 250 THEN 15 WHEN safe_users >= 75 THEN 10 WHEN safe_users >= 25 THEN 5 ELSE 0 END AS boost FROM r"""))
def _(s, d):
    kind = F.when(F.col("verdict") == "good", "safe").when(F.col("verdict") == "bad", "unsafe")
    return st.domain_reputation(_events(s, d).withColumn("kind", kind))


_QUEUE = """, q AS (SELECT url_hash, url_norm AS url, 50 + tag_no AS priority, seen_at AS created, seq AS updated, CASE WHEN seq % 3 = 0 THEN 'pending' WHEN seq % 3 = 1 THEN 'done' ELSE 'failed' END AS status, 0 AS attempts FROM ev WHERE seq % 4 <> 1)"""


def _queue(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("seq") % 3 == 0, "pending").when(F.col("seq") % 3 == 1, "done").otherwise("failed")
    return _events(s, d).where("seq % 4 <> 1").select("url_hash", F.col("url_norm").alias("url"), (F.col("tag_no") + 50).alias("priority"), F.col("seen_at").alias("created"), F.col("seq").alias("updated"), status.alias("status"), F.lit(0).alias("attempts"))


@query("j18_enqueue", _ev(_QUEUE + """, n AS (SELECT url_hash, url_norm AS url, 50 + tag_no AS priority, seen_at AS created FROM ev WHERE seq % 4 = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY created, priority DESC) AS place FROM n WHERE url_hash NOT IN (SELECT url_hash FROM q WHERE status = 'pending')) SELECT url_hash, url, priority, created, 'pending' AS status, 0 AS attempts FROM p WHERE place = 1"""))
def _(s, d):
    new = _events(s, d).where("seq % 4 = 1").select("url_hash", F.col("url_norm").alias("url"), (F.col("tag_no") + 50).alias("priority"), F.col("seen_at").alias("created"))
    return st.enqueue(_queue(s, d), new)


@query("w5_claim", _ev(_QUEUE + " SELECT url_hash, url, priority, created, updated, 'processing' AS status, 1 AS attempts FROM (SELECT * FROM q WHERE status = 'pending' ORDER BY priority DESC, created, url_hash LIMIT 20)"))
def _(s, d):
    return st.claim(_queue(s, d), 20)


@query("w7_keep_newest_done", _ev(_QUEUE + " SELECT url_hash, url, priority, created, updated, status, attempts FROM (SELECT *, row_number() OVER (PARTITION BY url_hash, status ORDER BY updated DESC) AS place FROM q) WHERE status <> 'done' OR place = 1"))
def _(s, d):
    return st.keep_newest_done(_queue(s, d))


_CAND = """, c AS (SELECT DISTINCT 'b' || CAST(tag_no * 10 + risk % 10 AS VARCHAR) AS brand_key, 'Brand ' || tag_no AS name, tag_no * 10 + 30 AS confidence, CASE WHEN tag_no >= 3 THEN 'verified' ELSE 'candidate' END AS status FROM ev), dm AS (SELECT DISTINCT 'b' || CAST(tag_no * 10 + risk % 10 AS VARCHAR) AS brand_key, regexp_extract(url_norm, '://([^/?#]+)', 1) AS domain FROM ev)"""


@query("j16_w9_learned_brands", _ev(_CAND + " SELECT brand_key, name, domain, confidence FROM c JOIN dm USING (brand_key) WHERE status = 'verified' ORDER BY confidence DESC, brand_key, domain, name LIMIT 500"))
def _(s, d):
    e = _events(s, d).withColumn("brand_key", F.concat(F.lit("b"), (F.col("tag_no") * 10 + F.col("risk") % 10).cast("string")))
    c = e.select("brand_key", F.concat(F.lit("Brand "), "tag_no").alias("name"), (F.col("tag_no") * 10 + 30).alias("confidence"), F.when(F.col("tag_no") >= 3, "verified").otherwise("candidate").alias("status")).distinct()
    return st.learned_brands(c, e.select("brand_key", F.regexp_extract("url_norm", "://([^/?#]+)", 1).alias("domain")).distinct())


@query("g18_store_summary", _ev(_QUEUE + " SELECT 'observations' AS name, count(*) AS n FROM ev UNION ALL SELECT 'urls', count(DISTINCT url_hash) FROM ev UNION ALL SELECT 'queue', count(*) FROM q"))
def _(s, d):
    e = _events(s, d)
    one = lambda name, n, df: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    return one("observations", F.count("*"), e).unionByName(one("urls", F.count_distinct("url_hash"), e)).unionByName(one("queue", F.count("*"), _queue(s, d)))


def first_match(patterns: tuple[str, ...]) -> str:
    """Group 1 of the first pattern that occurs in raw, for the oracle."""
    return "CASE " + " ".join(f"WHEN regexp_matches(raw, '{p}') THEN trim(regexp_extract(raw, '{p}', 1))" for p in patterns) + " END"


def _whois(strict: bool) -> str:
    zulu = "WHEN regexp_matches(created_text, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$') THEN strptime(created_text, '%Y-%m-%dT%H:%M:%SZ')"
    dotted = "" if strict else "WHEN regexp_matches(created_text, '^\\d{2}\\.\\d{2}\\.\\d{4} \\d{2}:\\d{2}:\\d{2}$') THEN strptime(created_text, '%d.%m.%Y %H:%M:%S')"
    privacy = "contains(lower(raw), 'privacy') OR contains(lower(raw), 'redacted')" if strict else "contains(raw, 'privacy') OR contains(raw, 'REDACTED')"
    return f"""WITH w AS (SELECT who_id, {first_match(pg.CREATED)} AS created_text, {first_match(pg.EXPIRES)} AS expires_text, {first_match(pg.REGISTRAR)} AS registrar, {privacy} AS privacy FROM fx_whois),
a AS (SELECT *, CAST(trunc((epoch(TIMESTAMP '2024-07-01 00:00:00') - epoch(CASE {zulu} {dotted} END)) / 86400) AS BIGINT) AS age_days FROM w)
SELECT *, least(100, CASE WHEN age_days IS NULL THEN 20 WHEN age_days < 30 THEN 60 WHEN age_days < 90 THEN 40 WHEN age_days < 180 THEN 20 WHEN age_days < 365 THEN 10 ELSE 0 END + CASE WHEN privacy THEN 20 ELSE 0 END) AS whois_risk FROM a"""


def _whois_facts(s: SparkSession, d: str, strict: bool) -> DataFrame:
    return pg.whois_facts(fixture(s, d, "fx_whois"), F.lit("2024-07-01 00:00:00").cast("timestamp"), strict=strict).drop("domain", "raw")


@query("p14_whois_facts", with_fixtures(_whois(False), "fx_whois"))
def _(s, d):
    return _whois_facts(s, d, False)


@query("s31_whois_texts", with_fixtures(_whois(False).replace("SELECT *, least(", "SELECT * EXCLUDE (who_id), 'host' || who_id || '.example.com' AS domain, least("), "fx_whois"))
def _(s, d):
    rows = fixture(s, d, "fx_whois")
    path = f"{shared_dir(s)}/whois-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct("domain", "raw")).alias("value")).write.text(path)
    return pg.read_whois(s, path, F.lit("2024-07-01 00:00:00").cast("timestamp")).drop("raw")


@query("p15_whois_strict", with_fixtures(_whois(True), "fx_whois"))
def _(s, d):
    return _whois_facts(s, d, True)


def registrable_sql(url: str) -> str:
    """The registrable domain of a url expression, for the oracle."""
    kept = "list_filter(string_split(h, '.'), lambda x: x <> '')"
    tail = lambda n: " || '.' || ".join(f"{kept}[-{i}]" for i in range(n, 0, -1))
    return f"list_transform([{NORM_DOMAIN.format(url)}], lambda h: CASE WHEN len({kept}) <= 2 THEN h WHEN {tail(2)} IN ({SUFFIXES}) THEN {tail(3)} ELSE {tail(2)} END)[1]"


def _sq(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _clean_sql(c: str) -> str:
    c = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"nullif(left(trim({c}), 120), '')"


def _meta_sql(attribute: str, key: str) -> str:
    p = _sq(pg.meta_pattern(attribute, key))
    return _clean_sql(f"(regexp_extract(html, {p}, 1) || regexp_extract(html, {p}, 2))")


def link_sql(url: str) -> str:
    return f"CASE WHEN NOT (starts_with({url}, '/') OR starts_with({url}, '#') OR starts_with({url}, 'mailto:')) THEN nullif({registrable_sql(url)}, '') END"


_LINK = lambda rel: link_sql(f"regexp_extract(html, {_sq(pg.link_pattern(rel))}, 1)")
_any = lambda words: "(" + " OR ".join(f"contains(lower(html), {_sq(w)})" for w in words) + ")"
META = f"""SELECT page_id, {_clean_sql(f"regexp_extract(html, {_sq(pg.TITLE)}, 1)")} AS title, {_meta_sql("property", "og:site_name")} AS og_site_name, {_meta_sql("property", "og:title")} AS og_title,
 {_meta_sql("name", "application-name")} AS application_name, {_meta_sql("name", "apple-mobile-web-app-title")} AS apple_app_title, {_LINK("canonical")} AS canonical_domain, {_LINK("manifest")} AS manifest_domain,
 list_sort(list_distinct({" || ".join(f"regexp_extract_all(html, {_sq(p)}, {g})" for p, g in pg.ANALYTICS)})) AS ids, CAST(len(regexp_extract_all(lower(html), '<form')) AS INT) AS form_count,
 {_any(pg.PASSWORD_MARKS)} AS has_password, {_any(pg.CREDENTIAL_WORDS)} AS has_credential_words FROM fx_page_html"""


@query("p16_page_metadata", with_fixtures(f"SELECT * EXCLUDE ids, array_to_string(ids, ',') AS analytics_ids FROM ({META})", "fx_page_html"))
def _(s, d):
    return pg.page_metadata(fixture(s, d, "fx_page_html")).withColumn("analytics_ids", F.array_join("analytics_ids", ",")).drop("url", "html")


#: What each kind of fixture page says, read off the fixture: names, domains and sameAs domains.
JSONLD = "facts(k, org_names, org_domains, same_as_domains) AS (VALUES (2, ['Acme'], ['acme.com'], ['acme.org', 'x.com']), (8, ['Deep Org'], ['example.co.uk'], ['example.org']), (11, [], [], ['example.com']))"


@query("p17_jsonld", with_fixtures(f"WITH {JSONLD} SELECT page_id, array_to_string(org_names, ',') AS org_names, array_to_string(org_domains, ',') AS org_domains, array_to_string(same_as_domains, ',') AS same_as_domains FROM fx_page_html JOIN facts ON k = page_id % 12", "fx_page_html"))
def _(s, d):
    facts = pg.jsonld_facts(fixture(s, d, "fx_page_html"), "page_id")
    return facts.select("page_id", *[F.array_join(c, ",").alias(c) for c in ("org_names", "org_domains", "same_as_domains")])


_ACTIONS = f"list_filter(list_transform(regexp_extract_all(lower(html), {_sq(pg.FORM_ACTION)}, 1), lambda u: {registrable_sql('u')}), lambda v: v <> '')[1]"


@query("p18_page_evidence", with_fixtures(f"""SELECT page_id, CASE WHEN regexp_matches(html, {_sq(pg.TITLE)}) THEN left(trim(regexp_replace(regexp_extract(html, {_sq(pg.TITLE)}, 1), '\\s+', ' ', 'g')), 160) END AS page_title, {_any(pg.PASSWORD_MARKS)} AS password_field,
 {_any(pg.OTP_WORDS)} AS otp_field, {_any(pg.CARD_WORDS)} AS card_field, CAST(len(regexp_extract_all(lower(html), '<form')) AS INT) AS page_forms, coalesce({_ACTIONS} <> {registrable_sql('url')}, false) AS external_form,
 page_id % 2 = 0 AND contains(lower(html), 'acme') AS page_brand FROM fx_page_html""", "fx_page_html"))
def _(s, d):
    pages = fixture(s, d, "fx_page_html").withColumn("brand", F.when(F.col("page_id") % 2 == 0, "Acme"))
    return pg.page_evidence(pages, brand="brand").drop("url", "html", "brand")


_IPS = "SELECT page_id, concat(CASE page_id % 10 WHEN 0 THEN '76.76.21' WHEN 1 THEN '75.2.60' WHEN 2 THEN '99.83.' WHEN 3 THEN '104.2' WHEN 4 THEN '172.6' WHEN 5 THEN '131.103.20' WHEN 6 THEN '185.199.1' WHEN 7 THEN '199.232' WHEN 8 THEN '151.101' ELSE '10.0.0' END, CASE WHEN page_id % 10 IN (0, 1, 5, 9) THEN '' WHEN page_id % 10 IN (7, 8) THEN concat('.', CAST(page_id % 256 AS STRING)) ELSE concat(CAST(page_id % 90 + 10 AS STRING), CASE WHEN page_id % 10 IN (3, 4) THEN concat('.', CAST(page_id % 7 AS STRING)) ELSE '' END) END, '.', CAST(page_id * 7 % 256 AS STRING)) AS ip FROM pages"


def _range_sql() -> str:
    rows = []
    for i, (provider, cidr) in enumerate(pg.PROVIDER_RANGES):
        ip, bits = cidr.split("/")
        n = sum(int(x) << 8 * (3 - k) for k, x in enumerate(ip.split(".")))
        rows.append(f"({i}, '{provider}', {n}, {1 << 32 - int(bits)})")
    return "r(ord, provider, base, size) AS (VALUES " + ", ".join(rows) + ")"


@query("j12_ip_provider", f"""WITH {_range_sql()}, i AS (SELECT *, string_split(ip, '.') AS p FROM ({_IPS})),
n AS (SELECT page_id, ip, CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) AS n FROM i)
SELECT page_id, ip, arg_min(provider, ord) AS provider FROM n JOIN r ON n - n % size = base GROUP BY ALL""")
def _(s, d):
    return pg.ip_provider(run(s, d, _IPS), pg.provider_ranges(s))


@query("p48_conversation_pairs", "SELECT conv_id, turn, text AS prompt, response FROM (SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND next_role = 'assistant'")
def _(s, d):
    return ds.conversation_pairs(s.read.parquet(f"{d}/conversations.parquet"))


_SIGN_RUNS = "|".join(("\\" + c) + "{13,}" for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SIGNS = "".join("\\" + c for c in ds.HARMLESS_SIGNS)
_NOISY = " OR ".join("regexp_matches(text, " + _sq("(?s)" + ".*".join([p.replace("*", r"\*")] * 2)) + ")" for p in ds.NOISY_PATTERNS)


@query("f3_text_quality", rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '') AS text FROM documents),
c AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\p{{L}}\p{{Nl}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS ascii_letters, length(regexp_replace(text, '[^\s\p{{Z}}]', '', 'g')) AS spaces, length(regexp_replace(text, {_sq(r'[\p{L}\p{Nl}\s\p{Z}0-9' + _SIGNS + ']')}, '', 'g')) AS symbols FROM d)
SELECT doc_id, n BETWEEN 80 AND 6000 AND letters >= 40 AND spaces >= 8 AND letters / n >= 0.45 AND coalesce(ascii_letters / nullif(letters, 0), 0) >= 0.85 AND symbols / n <= 0.12 AND NOT regexp_matches(text, {_sq(_SIGN_RUNS)}) AND NOT ({_NOISY}) AS good FROM c""")
def _(s, d):
    return ds.text_quality(s.read.parquet(f"{d}/documents.parquet"), "text").select("doc_id", "good")


@query("w10_balanced_sample", "SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS place FROM labels) WHERE place <= 20 ORDER BY place, toxic LIMIT 40")
def _(s, d):
    return ds.balanced_sample(s.read.parquet(f"{d}/labels.parquet"), "toxic", "doc_id", 40).select("doc_id", "toxic")


_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_MARKED = "contains(lower(text), 'http://') OR contains(lower(text), 'https://') OR contains(lower(text), 'www.')"


@query("p47_training_rows", f"""WITH r AS (SELECT doc_id, coalesce(source, 'unknown') AS of, {_TRIM.format('text')} AS t, {_MARKED} AS marked FROM documents),
m AS (SELECT *, CASE WHEN strlen(t) > 8000 THEN left(t, 8000) || chr(10) || '[truncated]' ELSE t END AS message FROM r)
SELECT of || '-' || doc_id || '-' || substr(sha256(of || doc_id || message), 1, 8) AS id, message, CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 ELSE marked END AS has_url FROM m WHERE message <> ''""")
def _(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return ds.training_rows(docs, "doc_id", "text", F.col("source"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 0))


@query("j17_resume", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    docs, done = (s.read.parquet(f"{d}/{n}.parquet").select(F.col("doc_id").alias("id")) for n in ("documents", "labels"))
    return st.resume(docs, done)


@query("t6_throughput", "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, round(avg(value), 6) AS mean_delay FROM events GROUP BY 1")
def _(s, d):
    from ..streaming.jobs import throughput

    out = throughput(s.read.parquet(f"{d}/events.parquet"), "ts", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("minute"), "n", F.round("mean_delay", 6).alias("mean_delay"))


@query("f4_has_url", f"SELECT doc_id, doc_id % 7 > 3 OR doc_id % 5 = 0 OR coalesce({_MARKED}, false) AS has_url FROM documents")
def _(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("message"), (F.col("doc_id") % 7 - 3).alias("url_count"), (F.col("doc_id") % 5 == 0).alias("contains_url"))
    return ds.with_has_url(docs).select("doc_id", "has_url")


_RAW_ROWS = "doc_id, CASE WHEN doc_id % 4 = 0 THEN text END AS content, CASE WHEN doc_id % 4 = 1 THEN concat(' ', text, ' ') END AS body, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN ' ' END AS sender, CASE WHEN doc_id % 2 = 1 THEN lang END AS subject, CASE WHEN doc_id % 4 = 2 THEN text END AS `Email Text`, CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 END AS label, CASE WHEN doc_id % 10 = 4 THEN 'Phishing Email' WHEN doc_id % 10 = 9 THEN 'Safe Email' END AS `Email Type`"


@query("s24_labelled_rows", rf"""WITH r AS (SELECT {_RAW_ROWS.replace('`', '"')} FROM documents)
SELECT coalesce(content, "Email Text", CASE WHEN doc_id % 2 = 1 THEN 'Subject: ' || subject || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'From: ' || sender || chr(10) ELSE '' END || {_TRIM.format('body')}) AS message,
 coalesce(label IN (1, 3), contains(lower("Email Type"), 'phishing')) AS expected_unsafe FROM r WHERE doc_id % 4 <> 3 AND content IS NOT NULL OR "Email Text" IS NOT NULL OR body IS NOT NULL""")
def _(s, d):
    raw = run(s, d, f"SELECT {_RAW_ROWS} FROM documents").drop("doc_id")
    return ds.normalize_labelled_rows(raw, unsafe_labels=(1, 3))


del m
