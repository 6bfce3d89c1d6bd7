"""Queries over the brand catalogue, ranks, evidence, state writers and landed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, run, with_fixtures
from ..operators import catalogue as cat
from ..operators import datasets as ds
from ..operators import pages as pg
from ..registry import query
from ..sources import feeds
from .source_queries import _path, land_documents
from .table_queries import registrable_sql

#: One binding for each customer: brands of several sites and popularities, some of the kinds that are left out.
_BOUND = """SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN concat('Q', CAST(c_custkey AS STRING)) WHEN c_custkey % 17 = 0 THEN 'A!' ELSE concat('Brand ', CAST(c_nationkey AS STRING), ' Co.') END AS name,
 CASE WHEN c_custkey % 11 = 0 THEN 'https://www.wikidata.org/' ELSE concat('https://www.Brand', CAST(c_nationkey AS STRING), '-', CAST(c_custkey % 3 AS STRING), '.example/x') END AS site,
 CASE WHEN c_custkey % 7 = 0 THEN 'many' ELSE CAST(c_custkey % 50 AS STRING) END AS links FROM customer"""
_BOUND_SQL = f"""bound AS (SELECT k, name, lower(regexp_extract(site, 'https://www\\.([^/]*)', 1)) AS domain, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS brand_key, coalesce(TRY_CAST(links AS INT), 0) AS sitelinks FROM ({_BOUND})),
kept AS (SELECT * FROM bound WHERE NOT regexp_matches(name, '^Q[0-9]*$') AND domain <> 'wikidata.org' AND length(brand_key) >= 3),
catalogue AS (SELECT brand_key, max(sitelinks) AS sitelinks, list_sort(list(DISTINCT domain)) AS domains FROM kept GROUP BY brand_key)"""


def _bindings(s: SparkSession, d: str) -> DataFrame:
    value = lambda c: F.struct(F.col(c).alias("value")).alias({"name": "itemLabel", "site": "website", "links": "sitelinks"}[c])
    item = F.struct(F.concat(F.lit("http://x/entity/Q"), F.col("k").cast("string")).alias("value")).alias("item")
    rows = run(s, d, _BOUND).select(F.to_json(F.struct(value("name"), value("site"), value("links"), item)).alias("item"))
    return cat.read_brand_bindings(s, land_documents(rows, "bindings", '{"results":{"bindings":[', ",", "]}}"))


@query("s22_brand_bindings", f"WITH {_BOUND_SQL} SELECT name, domain, brand_key, 'Q' || k AS item_id, sitelinks FROM kept")
def _(s, d):
    return _bindings(s, d).drop("pos")


@query("g16_brand_catalogue", f"WITH {_BOUND_SQL} SELECT brand_key, sitelinks, array_to_string(domains, ',') AS domains FROM catalogue")
def _(s, d):
    return cat.build_catalogue(_bindings(s, d)).select("brand_key", "sitelinks", F.array_join(F.array_sort("official_domains"), ",").alias("domains"))


def _sorted_catalogue(s: SparkSession, d: str) -> DataFrame:
    return cat.build_catalogue(_bindings(s, d)).withColumn("official_domains", F.array_sort("official_domains"))


@query("g17_favicon_hashes", f"WITH {_BOUND_SQL}, icons AS (SELECT DISTINCT domain, CASE WHEN length(domain) % 2 = 0 THEN md5(left(domain, 7)) END AS icon_hash FROM kept), f AS (SELECT brand_key, unnest(domains[1:2]) AS domain FROM catalogue) SELECT brand_key, array_to_string(list_sort(list(DISTINCT icon_hash) FILTER (icon_hash IS NOT NULL)), ',') AS hashes, count(*) AS attempts, count(icon_hash) AS successes FROM f LEFT JOIN icons USING (domain) GROUP BY brand_key")
def _(s, d):
    icons = _bindings(s, d).select("domain").distinct().select("domain", F.when(F.length("domain") % 2 == 0, F.md5(F.left("domain", F.lit(7)))).alias("icon_hash"))
    out = cat.catalogue_favicons(_sorted_catalogue(s, d), icons, 2)
    return out.withColumn("hashes", F.when(F.col("successes") > 0, F.array_join("hashes", ",")))


@query("f9_related_domains", f"WITH {_BOUND_SQL} SELECT DISTINCT brand_key, x AS domain FROM catalogue, (VALUES (1), (2)) v(i), (SELECT 1) o(one), LATERAL (SELECT CASE i WHEN 1 THEN brand_key || '-shop.com' ELSE brand_key || '.net' END AS x) l")
def _(s, d):
    brands = _sorted_catalogue(s, d)
    key = F.col("brand_key")
    named = F.array(F.concat(key, F.lit("-shop.com")), F.concat(F.lit("www."), key, F.lit(".net")), F.lit("facebook.com"), F.lit("other.org"), F.col("official_domains")[0], F.lit(""))
    return cat.related_brand_domains(brands, brands.select(F.col("official_domains")[0].alias("domain"), named.alias("related")))


_HOSTS = f"SELECT DISTINCT page_id, {{0}} AS domain FROM pages"  # noqa: F541
_RANKED = "ranks AS (SELECT domain, CAST(min(page_id) AS INT) + 1 AS rank FROM hosts WHERE page_id % 3 > 0 GROUP BY domain), rep AS (SELECT domain, CAST(count(*) * 30 AS BIGINT) AS safe_users, CAST(count(*) FILTER (page_id % 2 = 1) AS BIGINT) AS bad_events FROM hosts WHERE page_id % 4 < 3 GROUP BY domain)"


@query("j13_j14_rank_reputation", f"WITH hosts AS ({_HOSTS.format(registrable_sql('url'))}), {_RANKED} SELECT page_id, domain, rank AS popularity_rank, coalesce(safe_users, 0) AS safe_users, coalesce(bad_events, 0) AS bad_events, CASE WHEN coalesce(bad_events, 0) > 0 THEN 0 WHEN safe_users >= 250 THEN 15 WHEN safe_users >= 75 THEN 10 WHEN safe_users >= 25 THEN 5 ELSE 0 END AS boost FROM hosts LEFT JOIN ranks USING (domain) LEFT JOIN rep USING (domain)")
def _(s, d):
    from ..functions import text as t

    hosts = s.read.parquet(f"{d}/pages.parquet").select("page_id", t.registrable_domain(t.normal_domain(F.col("url"))).alias("domain")).distinct()
    ranks = hosts.where("page_id % 3 > 0").groupBy("domain").agg((F.min("page_id").cast("int") + 1).alias("rank"))
    rep = hosts.where("page_id % 4 < 3").groupBy("domain").agg((F.count("*") * 30).alias("safe_users"), F.count_if(F.col("page_id") % 2 == 1).alias("bad_events"))
    return cat.with_rank_and_reputation(hosts, ranks, rep)


_ICONS = "SELECT page_id, url, CASE WHEN page_id % 5 > 0 THEN left(html, CAST(page_id % 3 * 40 AS INT)) END AS icon, CASE page_id % 3 WHEN 0 THEN 'paypal' WHEN 1 THEN 'google' END AS brand_key FROM pages"
_ICON_SQL = f"i AS (SELECT page_id, brand_key, regexp_extract(url, '^https?://[^/]*') || '/favicon.ico' AS icon_url, CASE WHEN length(icon) > 0 THEN sha256(icon) END AS icon_hash FROM ({_ICONS}))"


@query("p19_j15_favicons", f"WITH {_ICON_SQL}, known AS (SELECT DISTINCT icon_hash FROM i WHERE page_id % 4 = 1 AND icon_hash IS NOT NULL) SELECT page_id, icon_url, i.icon_hash, coalesce(brand_key = 'google' AND i.icon_hash IN (SELECT icon_hash FROM known), false) AS favicon_match FROM i")
def _(s, d):
    rows = run(s, d, _ICONS).select("page_id", "brand_key", pg.favicon_url(F.col("url")).alias("icon_url"), pg.favicon_hash(F.col("icon").cast("binary")).alias("icon_hash"))
    known = rows.where("page_id % 4 = 1 and icon_hash is not null").select(F.lit("google").alias("brand_key"), F.col("icon_hash").alias("hash"))
    return pg.favicon_matches(rows, known).drop("brand_key")


_ONLINE = """SELECT event_id AS id, CAST(event_id * 7 % 91 AS INT) AS start, event_id % 2 = 0 AS brand_matched, event_id % 3 = 0 AS page_brand, event_id % 5 < 2 AS credentials, event_id % 7 = 1 AS favicon_match, event_id % 11 < 4 AS external_form, event_id % 13 < 5 AS domain_changed,
 CASE WHEN event_id % 4 > 0 THEN CAST(event_id * 11 % 400 AS INT) END AS whois_age, CASE WHEN event_id % 17 < 6 THEN 'cdn' END AS provider, CASE WHEN event_id % 19 > 3 THEN 200 END AS http_status, event_id % 23 = 0 AS http_error, event_id % 29 < 9 AS whois_error, event_id % 31 = 0 AS official FROM events"""


@query("p32_online_score", f"""WITH e AS ({_ONLINE}), a AS (SELECT *, brand_matched OR page_brand OR favicon_match AS signal, CASE WHEN credentials THEN greatest(start, CASE WHEN brand_matched THEN 90 ELSE 60 END) ELSE start END AS s1 FROM e),
b AS (SELECT *, CASE WHEN NOT official AND ((page_brand AND credentials) OR favicon_match) THEN greatest(s1, 85) ELSE s1 END AS s2 FROM a), c AS (SELECT *, CASE WHEN external_form THEN CASE WHEN credentials OR signal THEN least(s2 + 10, 95) ELSE greatest(s2, 45) END ELSE s2 END AS s3 FROM b),
d AS (SELECT *, CASE WHEN domain_changed AND brand_matched THEN least(s3 + 10, 95) ELSE s3 END AS s4 FROM c), f AS (SELECT *, CASE WHEN coalesce(whois_age < 30, false) AND brand_matched THEN least(s4 + 10, 95) ELSE s4 END AS s5 FROM d), g AS (SELECT *, CASE WHEN provider IS NOT NULL AND brand_matched THEN least(s5 + 5, 95) ELSE s5 END AS s6 FROM f),
h AS (SELECT *, CASE WHEN credentials OR favicon_match OR external_form OR (domain_changed AND brand_matched) THEN s6 WHEN coalesce(whois_age > 180, false) AND http_status IS NOT NULL THEN least(s6, 35) WHEN NOT signal THEN least(s6, 40) ELSE least(s6, 60) END AS s7 FROM g), o AS (SELECT *, CASE WHEN NOT brand_matched AND NOT page_brand THEN least(s7, 40) ELSE s7 END AS s8 FROM h)
SELECT id, CASE WHEN official THEN start ELSE s8 END AS online_score, CASE WHEN official THEN 95 ELSE CASE WHEN s8 >= 85 THEN 90 WHEN s8 >= 60 THEN 75 ELSE 60 END - CASE WHEN http_error THEN 15 ELSE 0 END - CASE WHEN whois_error THEN 5 ELSE 0 END END AS online_confidence FROM o""")
def _(s, d):
    return pg.score_online(run(s, d, _ONLINE)).select("id", "online_score", "online_confidence")


@query("f8_learning_gate", f"SELECT id FROM ({_ONLINE}) WHERE start < 45 AND NOT official")
def _(s, d):
    rows = run(s, d, _ONLINE)
    return rows.where(cat.learns_identity(F.col("start"), F.col("official"))).select("id")


_EVID = "SELECT sha256(url) AS url_hash, CASE tag_no WHEN 0 THEN 'whois' WHEN 1 THEN 'dns' WHEN 2 THEN 'cert' WHEN 3 THEN 'page' ELSE 'hosting' END AS kind, concat('k', CAST(tag_no AS STRING)) AS key_name, CASE WHEN seq % 5 > 0 THEN concat('v', CAST(seq AS STRING)) END AS value_text, concat('h', lpad(CAST(seq AS STRING), 9, '0')) AS value_hash, seen_at AS created FROM fx_url_events"


@query("j19_evidence_overview", with_fixtures(f"WITH e AS ({_EVID}) SELECT url_hash, string_agg(kind || ' ' || key_name || ': ' || value_text, '; ' ORDER BY created DESC, kind, value_hash) FILTER (kind <> 'page' AND value_text IS NOT NULL) AS lines FROM e GROUP BY url_hash", "fx_url_events"))
def _(s, d):
    e = run(s, d, _EVID.replace("sha256(url)", "sha2(url, 256)"), fx_url_events=fixture(s, d, "fx_url_events"))
    return cat.evidence_overview(e, e).withColumn("lines", F.array_join("lines", "; "))


_CANDS = "SELECT seq, seen_at, concat('b', CAST(tag_no AS STRING)) AS brand_key, url AS primary_domain, concat('Brand ', CAST(risk AS STRING)) AS display_name, verdict AS status, confidence FROM fx_url_events"


@query("k6_k7_brand_candidates", with_fixtures(f"SELECT brand_key, primary_domain, max(seq) AS seq, arg_max(seen_at, seq) AS updated_at, arg_max(display_name, seq) AS display_name, arg_max(status, seq) AS status, arg_max(confidence, seq) AS confidence, min(seen_at) AS first_seen FROM ({_CANDS}) GROUP BY ALL", "fx_url_events"))
def _(s, d):
    return cat.candidate_tables(run(s, d, _CANDS, fx_url_events=fixture(s, d, "fx_url_events")))[0]


@query("k7_brand_domains", with_fixtures(f"SELECT brand_key, primary_domain AS domain, 'primary_domain' AS relation_type, arg_max(confidence, seq) AS confidence, 'brand_detector' AS source, min(seen_at) AS first_seen, arg_max(seen_at, seq) AS updated_at FROM ({_CANDS}) GROUP BY brand_key, primary_domain", "fx_url_events"))
def _(s, d):
    return cat.candidate_tables(run(s, d, _CANDS, fx_url_events=fixture(s, d, "fx_url_events")))[1]


_RELS = "SELECT seq, seen_at, url AS source_domain, concat('r', CAST(risk % 10 AS STRING)) AS related_domain, verdict AS relation_type, confidence FROM fx_url_events"


@query("k8_relationships", with_fixtures(f"SELECT source_domain, related_domain, relation_type, max(seq) AS seq, arg_max(seen_at, seq) AS updated_at, arg_max(confidence, seq) AS confidence, min(seen_at) AS first_seen FROM ({_RELS}) GROUP BY ALL", "fx_url_events"))
def _(s, d):
    return cat.relationship_table(run(s, d, _RELS, fx_url_events=fixture(s, d, "fx_url_events")))


@query("g18_latest_relationships", with_fixtures(f"WITH r AS (SELECT source_domain, related_domain, relation_type, arg_max(confidence, seq) AS confidence, arg_max(seen_at, seq) AS updated_at FROM ({_RELS}) GROUP BY ALL) SELECT * FROM r ORDER BY updated_at DESC, source_domain, related_domain, relation_type, confidence LIMIT 20", "fx_url_events"))
def _(s, d):
    rows = cat.relationship_table(run(s, d, _RELS, fx_url_events=fixture(s, d, "fx_url_events")))
    return cat.latest_rows(rows.select("source_domain", "related_domain", "relation_type", "confidence", "updated_at"))


_NOW = f"cands AS (SELECT brand_key, primary_domain, arg_max(seen_at, seq) AS updated_at, arg_max(display_name, seq) AS display_name, arg_max(status, seq) AS status, arg_max(confidence, seq) AS confidence FROM ({_CANDS}) GROUP BY ALL)"


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cat.candidate_tables(run(s, d, _CANDS, fx_url_events=fixture(s, d, "fx_url_events")))


@query("g18_latest_candidates", with_fixtures(f"WITH {_NOW} SELECT display_name, primary_domain, status, confidence, length(primary_domain) % 50 AS tranco_rank, updated_at FROM cands ORDER BY updated_at DESC, display_name, primary_domain, status, confidence, tranco_rank LIMIT 20", "fx_url_events"))
def _(s, d):
    now, _ = _candidates(s, d)
    return cat.latest_rows(now.select("display_name", "primary_domain", "status", "confidence", (F.length("primary_domain") % 50).alias("tranco_rank"), "updated_at"))


@query("g18_latest_brand_domains", with_fixtures(f"WITH {_NOW} SELECT brand_key, primary_domain AS domain, 'primary_domain' AS relation_type, confidence, 'brand_detector' AS source, updated_at FROM cands ORDER BY updated_at DESC, brand_key, domain, relation_type, confidence, source LIMIT 20", "fx_url_events"))
def _(s, d):
    return cat.latest_rows(_candidates(s, d)[1].select("brand_key", "domain", "relation_type", "confidence", "source", "updated_at"))


@query("g18_table_counts", with_fixtures(f"""WITH {_NOW} SELECT 'tranco_domains' AS name, count(*) AS n FROM pages UNION ALL SELECT 'brand_candidates', count(*) FROM cands UNION ALL SELECT 'brand_domains', count(*) FROM cands
UNION ALL SELECT 'domain_relationships', count(*) FROM (SELECT DISTINCT source_domain, related_domain, relation_type FROM ({_RELS})) UNION ALL SELECT 'domain_reputation', count(DISTINCT user_id) FROM fx_url_events""", "fx_url_events"))
def _(s, d):
    events = fixture(s, d, "fx_url_events")
    now, domains = _candidates(s, d)
    tables = {"tranco_domains": s.read.parquet(f"{d}/pages.parquet"), "brand_candidates": now, "brand_domains": domains, "domain_relationships": cat.relationship_table(run(s, d, _RELS, fx_url_events=events)), "domain_reputation": events.where("user_id is not null").select("user_id").distinct()}
    return cat.table_counts(tables)


@query("g19_stage_times", "SELECT count(*) AS urls, round(avg(value), 6) AS dns_ms, round(avg(value * 3 + event_id % 7), 6) AS whois_ms, round(avg(CASE WHEN event_id % 5 > 0 THEN value * 10 END), 6) AS http_ms FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    timed = e.select(F.col("value").alias("dns_ms"), (F.col("value") * 3 + F.col("event_id") % 7).alias("whois_ms"), F.when(F.col("event_id") % 5 > 0, F.col("value") * 10).alias("http_ms"))
    return cat.stage_times(timed).select("urls", *[F.round(c, 6).alias(c) for c in ("dns_ms", "whois_ms", "http_ms")])


_SNAPS = "SELECT page_id, url, CASE WHEN page_id % 4 > 0 THEN url END AS final_url, 200 AS status, CASE page_id % 5 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'Text/HTML; charset=utf-8' WHEN 2 THEN '' WHEN 3 THEN 'application/xhtml+xml' END AS content_type, html FROM pages"


@query("s30_pages", f"SELECT page_id, CASE WHEN page_id % 5 > 0 THEN left(html, 524288) END AS html, CASE WHEN final_url IS NOT NULL THEN {registrable_sql('final_url')} END AS final_domain, CASE WHEN page_id % 5 = 0 THEN 'unsupported content-type: image/png' END AS fetch_error FROM ({_SNAPS})")
def _(s, d):
    return pg.read_pages(run(s, d, _SNAPS)).select("page_id", "html", "final_domain", "fetch_error")


@query("s32_dns", "SELECT 'h' || (event_id % 97) AS host, count(DISTINCT event_id % 13) AS ips, bool_or(event_id % 13 > 0) AS resolved FROM events GROUP BY 1")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    answers = e.select(F.concat(F.lit("h"), (F.col("event_id") % 97).cast("string")).alias("host"), F.concat(F.lit("10.0.0."), (F.col("event_id") % 13).cast("string")).alias("ip"))
    by_host = answers.groupBy("host").agg(F.array_sort(F.collect_set("ip")).alias("ips"))
    return by_host.select("host", F.size("ips").cast("long").alias("ips"), (F.size(F.filter("ips", lambda x: x != "10.0.0.0")) > 0).alias("resolved"))


@query("s25_k13_training_input", "SELECT doc_id AS id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def _(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.length("text").alias("n"))
    path = _path(s, "training")
    cat.append_new(rows.where("cast(id as long) % 3 = 0"), path)
    cat.append_new(rows, path)  # the rest, once each
    return ds.read_training_input(s, path, "id string, n int").select(F.col("id").cast("long").alias("id"), "n")


@query("k11_catalogue_file", f"WITH {_BOUND_SQL} SELECT 'Brand ' || regexp_extract(brand_key, '[0-9]+') || ' Co.' AS brand, array_to_string(domains, ',') AS domains FROM catalogue")
def _(s, d):
    path = _path(s, "catalogue")
    cat.write_catalogue(_sorted_catalogue(s, d), path)
    return feeds.read_brand_catalog(s, path).select("brand", F.array_join("official_domains", ",").alias("domains"))


@query("s19_brand_order", f"WITH {_BOUND_SQL}, b AS (SELECT 'Brand ' || regexp_extract(brand_key, '[0-9]+') || ' Co.' AS brand FROM catalogue) SELECT brand, CAST(row_number() OVER (ORDER BY brand) - 1 AS INT) AS brand_ord FROM (SELECT DISTINCT brand FROM b)")
def _(s, d):
    path = _path(s, "catalogue")
    cat.write_catalogue(_sorted_catalogue(s, d), path, most=100)
    return feeds.read_brand_catalog(s, path).select("brand", "brand_ord")


@query("k10_k12_result_lines", "SELECT doc_id AS id, quality > 0 AS expected_unsafe, 'm' || toxic AS message FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL")
def _(s, d):
    rows = run(s, d, "SELECT CAST(doc_id AS STRING) AS id, quality > 0 AS expected_unsafe, concat('m', CAST(toxic AS STRING)) AS message FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL")
    path = _path(s, "results")
    cat.write_results(rows, path)
    return feeds.read_cases(s, path).select(F.col("id").cast("long").alias("id"), "expected_unsafe", "message")


_MEMORY = "SELECT seq, sha256(url) AS message_hash, CAST(length(url) AS BIGINT) AS simhash, risk, verdict AS decision, CAST(user_id AS STRING) AS user_id, url AS raw, seen_at, tag_no FROM fx_url_events"


def _memory_table(s: SparkSession, d: str, name: str) -> DataFrame:
    e = run(s, d, _MEMORY.replace("sha256(url)", "sha2(url, 256)"), fx_url_events=fixture(s, d, "fx_url_events"))
    tagged = e.withColumn("tags", F.array(F.lit("all"))).withColumn("url_hashes", F.array("message_hash", F.sha2("user_id", 256)))
    edges = e.select("message_hash", F.sha2(F.concat(F.lit("o"), "tag_no"), 256).alias("other_hash"), F.col("risk").alias("distance"))
    return cat.memory_tables(tagged, edges)[name]


@query("k9_memory_urls", with_fixtures("SELECT DISTINCT sha256(url) AS message_hash, unnest([sha256(url), sha256(CAST(user_id AS VARCHAR))]) AS url_hash FROM fx_url_events", "fx_url_events"))
def _(s, d):
    return _memory_table(s, d, "urls")


@query("k9_memory_similarity", with_fixtures("SELECT sha256(url) AS message_hash, sha256('o' || tag_no) AS other_hash, min(risk) AS distance FROM fx_url_events GROUP BY ALL", "fx_url_events"))
def _(s, d):
    return _memory_table(s, d, "similarity")


@query("k9_memory_messages", with_fixtures("SELECT sha256(url) AS message_hash, count(*) AS seen_count, min(seen_at) AS first_seen, max(seen_at) AS last_seen, arg_max(risk, seq) AS risk, arg_max(verdict, seq) AS decision FROM fx_url_events GROUP BY url", "fx_url_events"))
def _(s, d):
    return _memory_table(s, d, "messages").select("message_hash", "seen_count", "first_seen", "last_seen", "risk", "decision")


@query("s21_favicon_hashes", "SELECT DISTINCT 'Site ' || host AS brand, unnest([sha256(host), sha256(host || '/2')]) AS favicon_hash FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)")
def _(s, d):
    hosts = run(s, d, "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
    listed = F.array(F.sha2("host", 256), F.lit("short"), F.sha2(F.concat("host", F.lit("/2")), 256))
    item = F.concat(F.regexp_extract(F.to_json(F.array(F.concat(F.lit("Site "), "host"))), r"^\[(.*)\]$", 1), F.lit(":"), F.to_json(listed))
    return feeds.read_favicon_hashes(s, land_documents(hosts.select(item.alias("item")), "favicons", "{", ",", "}"))


@query("k9_memory_tags", with_fixtures("SELECT DISTINCT sha256(url) AS message_hash, 'tag' || (tag_no % 3) AS tag FROM fx_url_events UNION SELECT sha256(url), 'all' FROM fx_url_events", "fx_url_events"))
def _(s, d):
    e = run(s, d, _MEMORY.replace("sha256(url)", "sha2(url, 256)"), fx_url_events=fixture(s, d, "fx_url_events"))
    e = e.withColumn("tags", F.array(F.concat(F.lit("tag"), (F.col("tag_no") % 3).cast("string")), F.lit("all"))).withColumn("url_hashes", F.array("message_hash"))
    edges = e.select("message_hash", F.col("message_hash").alias("other_hash"), F.col("risk").alias("distance"))
    return cat.memory_tables(e, edges)["tags"]

