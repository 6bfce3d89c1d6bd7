"""Queries over learned identities, tags and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture, with_fixtures
from ..operators import brands as b
from ..operators import datasets as ds
from ..operators import identity as idn
from ..operators import messages as m
from ..operators import pages as pg
from ..registry import query
from .message_queries import ALL_URL, PARTS, SCORED, URLS, _both, _msgs, _scored, _threats, _urls
from .score import score_messages
from .table_queries import JSONLD, META

_TAGS = """array_to_string(list_filter([CASE WHEN official THEN 'official_brand_domain' END, CASE WHEN brand_score >= 45 THEN 'brand_impersonation' END, CASE WHEN hosting_provider IS NOT NULL THEN 'known_hosting_provider' END,
 'hosting_provider:' || replace(hosting_provider, '.', '_'), CASE WHEN matched_brand IS NOT NULL THEN 'brand_seen' END, 'brand:' || lower(matched_brand)], lambda x: x IS NOT NULL), ',')"""


@query("p29_brand_tags", _msgs(f"WITH {ALL_URL} SELECT url, {_TAGS} AS tags FROM branded"))
def _(s, d):
    return idn.brand_tags(b.brand_impersonation(_urls(s, d), b.default_brands(s))).select("url", F.array_join("tags", ",").alias("tags"))


@query("p28_unsafe_tags", _both(f"""WITH {SCORED} SELECT msg_id, array_to_string(list_sort(list_filter([CASE WHEN f_phishing >= 60 THEN 'phishing' END, CASE WHEN secret >= 85 THEN 'secret_leak' END, CASE WHEN injection >= 60 THEN 'prompt_injection' END,
 CASE WHEN url_reputation >= 75 THEN 'known_bad_url' END, CASE WHEN urgency_flag THEN 'urgency_language' END], lambda x: x IS NOT NULL)), ',') AS unsafe_tags FROM decided"""))
def _(s, d):
    none = F.lit(None).cast("array<string>")
    return idn.unsafe_tags(_scored(s, d).withColumn("url_tags", none)).select("msg_id", F.array_join("unsafe_tags", ",").alias("unsafe_tags"))


_WORKER = """array_to_string(list_filter(['risk_level:' || risk_level, CASE WHEN matched_brand IS NOT NULL THEN 'brand_seen' END, 'brand:' || lower(regexp_replace(matched_brand, '[^A-Za-z0-9]', '_', 'g')), CASE WHEN official THEN 'official_brand_domain' END, CASE WHEN brand_score >= 45 THEN 'brand_impersonation' END,
 CASE WHEN hosting_provider IS NOT NULL THEN 'known_hosting_provider' END, 'hosting_provider:' || lower(regexp_replace(hosting_provider, '[^A-Za-z0-9]', '_', 'g'))], lambda x: x IS NOT NULL), ',')"""


@query("p29_worker_tags", _msgs(f"WITH {ALL_URL} SELECT url, {_WORKER} AS tags FROM branded"))
def _(s, d):
    return idn.brand_tags(b.brand_impersonation(_urls(s, d), b.default_brands(s)), worker=True).select("url", F.array_join("tags", ",").alias("tags"))


_PROOF = "proof AS (SELECT url, '  Evidence:' || chr(10) || '    - dns ip_provider: cdn' || length(url) || chr(10) || '    - whois privacy: true' AS proof FROM (SELECT DISTINCT url FROM urls) WHERE length(url) % 3 = 0)"


@query("p21_url_context", _msgs(f"""WITH {URLS}, {PARTS}, {_PROOF}, told AS (SELECT msg_id, 'URL Overview:' || chr(10) || string_agg('- ' || url || chr(10) || '  Domain: ' || registrable || coalesce(chr(10) || '  Subdomain: ' || subdomain, '') || coalesce(chr(10) || '  Hosting provider: ' || hosting_provider, '') || coalesce(chr(10) || proof, ''), chr(10) ORDER BY url_pos) AS context
 FROM urls JOIN parts USING (url) LEFT JOIN proof USING (url) GROUP BY msg_id) SELECT msg_id, coalesce(context, 'No URLs found.') AS context FROM fx_messages LEFT JOIN told USING (msg_id)"""))
def _(s, d):
    urls = m.with_url_parts(_urls(s, d))
    some = urls.select("url").distinct().where("length(url) % 3 = 0")
    row = lambda kind, key, value, place: some.select("url", F.lit(kind).alias("kind"), F.lit(key).alias("key_name"), value.alias("value_text"), F.lit(place).alias("place"))
    evidence = row("whois", "privacy", F.lit("true"), 3).unionByName(row("dns", "ip_provider", F.concat(F.lit("cdn"), F.length("url").cast("string")), 1)).unionByName(row("dns", "none", F.lit(None).cast("string"), 2))
    return idn.url_context(fixture(s, d, "fx_messages"), urls, "msg_id", evidence)


_ORIGIN = "CASE WHEN msg_id % 3 > 0 THEN 'set' || (msg_id % 3) ELSE 'unknown' END"
_SAID = f"""told AS (SELECT msg_id, 'URL Overview:' || chr(10) || string_agg('- ' || url || chr(10) || '  Domain: ' || registrable || coalesce(chr(10) || '  Subdomain: ' || subdomain, '') || coalesce(chr(10) || '  Hosting provider: ' || hosting_provider, ''), chr(10) ORDER BY url_pos) AS context
 FROM urls JOIN parts USING (url) GROUP BY msg_id), kept AS (SELECT msg_id, expected_unsafe AS unsafe, {_ORIGIN} AS origin, trim(repeat(message || ' ', CASE WHEN msg_id % 50 = 0 THEN 300 ELSE 1 END)) AS long FROM fx_messages),
rows AS (SELECT *, CASE WHEN strlen(long) > 8000 THEN left(long, 8000) || chr(10) || '[truncated]' ELSE long END AS said, coalesce(context, 'No URLs found.') AS around FROM kept LEFT JOIN told USING (msg_id))"""
_ASKED = f"'{m.ASSESSMENT_PROMPT}' || chr(10) || chr(10) || 'URL overview:' || chr(10) || around || chr(10) || chr(10) || 'Message:' || chr(10) || said"


@query("p47_training_examples", with_fixtures(f"""WITH {SCORED}, {_SAID} SELECT origin || '-' || msg_id || '-' || substr(sha256(origin || msg_id || said), 1, 8) AS id, origin AS original_source, unsafe AS expected_unsafe,
 contains(lower(said), 'http://') OR contains(lower(said), 'https://') OR contains(lower(said), 'www.') AS has_url, sha256(said) AS message_sha256, around AS url_context, sha256({_ASKED}) AS prompt_sha256, decision, overall_risk
 FROM rows JOIN decided USING (msg_id)""", "fx_messages", "fx_indicators"))
def _(s, d):
    messages = fixture(s, d, "fx_messages")
    long = messages.withColumn("long", F.expr("trim(repeat(concat(message, ' '), CASE WHEN msg_id % 50 = 0 THEN 300 ELSE 1 END))")).withColumn("origin", F.expr("CASE WHEN msg_id % 3 > 0 THEN concat('set', CAST(msg_id % 3 AS STRING)) END"))
    rows = ds.training_rows(long, "msg_id", "long", F.col("origin"), keep=("msg_id", "expected_unsafe")).select("*", F.regexp_extract("id", "^([^-]*)-", 1).alias("source"), F.col("msg_id").alias("index"), F.lit(None).cast("string").alias("label"))
    contexts = idn.url_context(messages, m.with_url_parts(_urls(s, d)), "msg_id")
    scored = score_messages(messages, _threats(s, d), b.default_brands(s)).select("msg_id", "decision", "overall_risk")
    out = ds.training_examples(rows, contexts, scored, "messages", "msg_id")
    return out.select("id", "origin.original_source", "origin.expected_unsafe", "origin.has_url", F.sha2("message", 256).alias("message_sha256"), "url_context", F.sha2("prompt", 256).alias("prompt_sha256"), "scoring.decision", "scoring.overall_risk")


_SOURCE = "CASE page_id % 5 WHEN 0 THEN 'acme.com' WHEN 1 THEN 'example.co.uk' WHEN 2 THEN 'shop.net' WHEN 3 THEN 'my.vercel.app' ELSE 'example.org' END"


def _identities(s, d):
    pages = fixture(s, d, "fx_page_html")
    none = F.array().cast("array<string>")
    page = F.col("page_id")
    df = pg.page_metadata(pages).join(pg.jsonld_facts(pages, "page_id"), "page_id", "left").withColumns({c: F.coalesce(c, none) for c in ("org_names", "org_domains", "same_as_domains")})
    df = df.withColumn("popularity_rank", F.when(page % 4 == 0, None).otherwise(page * 997 % 120_000).cast("int")).withColumn("boost", F.when(page % 3 == 0, 15).otherwise(0)).withColumn("source_domain", F.expr(_SOURCE))
    df = df.withColumn("hosting_provider", F.when(F.col("source_domain") == "my.vercel.app", "vercel.app")).withColumn("final_domain", F.col("source_domain"))
    return idn.identity_confidence(idn.identity_name(df))


_FROM, _TO = "".join(idn.FOLDED.values()), "".join(k * len(v) for k, v in idn.FOLDED.items())
_KEY = lambda c: f"lower(regexp_replace(translate({c}, '{_FROM}', '{_TO}'), '[^A-Za-z0-9]', '', 'g'))"
_IDENT = f"""meta AS ({META}), {JSONLD}, i AS (SELECT meta.*, coalesce(org_names, []) AS org_names, coalesce(org_domains, []) AS org_domains, coalesce(same_as_domains, []) AS same_as_domains, {_SOURCE} AS source_domain,
 CAST(CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id * 997 % 120000 END AS INT) AS popularity_rank, CASE WHEN page_id % 3 = 0 THEN 15 ELSE 0 END AS boost FROM meta LEFT JOIN facts ON k = page_id % 12),
h AS (SELECT *, CASE WHEN source_domain = 'my.vercel.app' THEN 'vercel.app' END AS hosting_provider, coalesce(org_names[1], og_site_name, application_name, apple_app_title, og_title, title) AS raw_name FROM i),
pieces AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw_name, '[|:,\\-–—]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM h),
chosen AS (SELECT *, left(regexp_replace(trim(coalesce(list_filter(parts, lambda x: {_KEY("x")} NOT IN ('home', 'homepage', 'index', 'uvod', 'vod'))[1], parts[1], raw_name)), '(\\.net)*(\\.org)*(\\.com)*$', ''), 80) AS n FROM pieces),
j AS (SELECT *, CASE WHEN length({_KEY("n")}) >= 3 THEN n END AS name, coalesce(popularity_rank, 2000000000) AS rk, boost >= 10 AND coalesce(popularity_rank, 2000000000) <= 100000 AS trusted, split_part(source_domain, '.', 1) AS own,
 coalesce(split_part(canonical_domain, '.', 1) = split_part(source_domain, '.', 1), false) AS label_match, coalesce(canonical_domain = source_domain, false) AS same, list_contains(org_domains, source_domain) AS in_org,
 og_site_name IS NOT NULL OR application_name IS NOT NULL AS named FROM chosen),
auth AS (SELECT *, same OR in_org OR list_contains(same_as_domains, source_domain) AS authoritative FROM j),
scored AS (SELECT *, CASE WHEN form_count > 0 AND (has_password OR has_credential_words) AND NOT authoritative AND NOT label_match AND NOT trusted THEN 0 ELSE least(95, CASE WHEN popularity_rank IS NULL THEN 0 WHEN rk <= 10000 THEN 45 WHEN rk <= 100000 THEN 35 ELSE 20 END + least(boost, 15)
 + CASE WHEN len(org_names) > 0 THEN 25 ELSE 0 END + CASE WHEN named THEN 15 ELSE 0 END + CASE WHEN rk <= 10000 AND title IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN trusted AND title IS NOT NULL THEN 10 ELSE 0 END
 + CASE WHEN same OR in_org THEN 15 ELSE 0 END + CASE WHEN label_match THEN 15 ELSE 0 END + CASE WHEN rk <= 100 AND same THEN 15 ELSE 0 END + CASE WHEN len(same_as_domains) > 0 THEN 10 ELSE 0 END) END AS confidence FROM auth),
admitted AS (SELECT *, CASE WHEN confidence >= 55 AND name IS NOT NULL AND source_domain NOT IN ('example.com', 'example.org', 'example.net') AND NOT (hosting_provider IS NOT NULL AND NOT authoritative)
 AND (authoritative OR label_match OR (trusted AND title IS NOT NULL) OR (coalesce({_KEY("own")} <> '' AND contains({_KEY("name")}, {_KEY("own")}), false) AND (rk <= 1000 OR trusted OR (rk <= 10000 AND named)))) THEN CASE WHEN confidence >= 85 THEN 'verified' ELSE 'candidate' END END AS status FROM scored)"""


@query("p34_p36_identity", with_fixtures(f"WITH {_IDENT} SELECT page_id, name, confidence, status FROM admitted", "fx_page_html"))
def _(s, d):
    return _identities(s, d).select("page_id", "name", "confidence", "status")


@query("p35_identity_confidence", with_fixtures(f"WITH {_IDENT} SELECT page_id, authoritative, confidence FROM scored", "fx_page_html"))
def _(s, d):
    return _identities(s, d).select("page_id", "authoritative", "confidence")


@query("p37_brand_candidates", with_fixtures(f"""WITH {_IDENT} SELECT {_KEY("name")} AS brand_key, name AS display_name, source_domain AS primary_domain, status, confidence, popularity_rank,
 CAST(to_json({{'signals': list_filter([CASE WHEN len(org_names) > 0 THEN 'jsonld_organization' END, CASE WHEN og_site_name IS NOT NULL THEN 'og_site_name' END, CASE WHEN application_name IS NOT NULL THEN 'application_name' END, CASE WHEN canonical_domain IS NOT NULL THEN 'canonical_domain' END, CASE WHEN len(same_as_domains) > 0 THEN 'same_as_domains' END], lambda x: x IS NOT NULL),
 'tranco_rank': popularity_rank, 'local_reputation_boost': boost, 'final_domain': source_domain, 'canonical_domain': canonical_domain, 'organization_domains': org_domains, 'same_as_domains': same_as_domains, 'analytics_ids_seen': len(ids), 'forms': form_count, 'has_credentials': has_password OR has_credential_words}}) AS VARCHAR) AS evidence_json
 FROM admitted WHERE status IS NOT NULL""", "fx_page_html"))
def _(s, d):
    return idn.brand_candidates(_identities(s, d))


@query("p38_domain_relationships", with_fixtures(f"""WITH {_IDENT}, rel AS (SELECT source_domain, unnest(list_concat(org_domains, same_as_domains, [canonical_domain, manifest_domain])) AS related_domain FROM i)
SELECT source_domain, related_domain, 'page_metadata' AS relation_type, 55 AS confidence, '{{"source":"page_metadata"}}' AS evidence_json FROM rel WHERE related_domain <> '' AND related_domain <> source_domain
UNION ALL SELECT source_domain, source_domain, 'analytics_id_seen', 35, '{{"analytics_id_hash":"' || sha256(x) || '"}}' FROM (SELECT source_domain, unnest(ids) AS x FROM i)""", "fx_page_html"))
def _(s, d):
    return idn.domain_relationships(_identities(s, d))
