"""Queries over messages, urls, threats, brands and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, run, with_fixtures
from ..functions import text as t
from ..operators import brands as b
from ..operators import memory as mem
from ..operators import messages as m
from ..operators import threats as th
from ..registry import query
from ..tables import written
from .score import judge_urls, score_messages

_Q = "'"
URL_RE = t.URL_PATTERN.replace("'", "''")

# ---- SQL pieces for the oracles
URLS = f"""urls AS (SELECT msg_id, unnest(x) AS url, generate_subscripts(x, 1) - 1 AS url_pos
 FROM (SELECT msg_id, regexp_extract_all(message, '{URL_RE}') AS x FROM fx_messages))"""
NORM_URL = r"lower(regexp_replace(trim({0}), '[.,;)\]]+$', ''))"
NORM_DOMAIN = r"lower(regexp_extract(regexp_replace(regexp_replace(trim({0}), '[.,;)\]]+$', ''), '^(?:http://)*(?:https://)*', ''), '^[^/:]*'))"
PATH = r"lower(regexp_extract(regexp_replace(regexp_replace(trim({0}), '[.,;)\]]+$', ''), '^(?:http://)*(?:https://)*', ''), '/.*$'))"
SUFFIXES = ", ".join(f"'{s}'" for s in t.TWO_PART_SUFFIXES)
HOSTS = ", ".join(f"'{s}'" for s in t.HOSTING_DOMAINS)


def any_of(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def count_of(c: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in words) + ")"


PARTS = f"""hosts AS (SELECT url, {NORM_DOMAIN.format('url')} AS host, {PATH.format('url')} AS path_query FROM (SELECT DISTINCT url FROM urls)),
labels AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM hosts),
regs AS (SELECT url, host, path_query, CASE WHEN len(l) <= 2 THEN host WHEN l[-2] || '.' || l[-1] IN ({SUFFIXES}) THEN l[-3] || '.' || l[-2] || '.' || l[-1] ELSE l[-2] || '.' || l[-1] END AS registrable FROM labels),
parts AS (SELECT url, host, registrable, nullif(CASE WHEN ends_with(host, '.' || registrable) THEN left(host, length(host) - length(registrable) - 1) END, '') AS subdomain, path_query,
  CASE WHEN registrable IN ({HOSTS}) THEN registrable END AS hosting_provider FROM regs)"""
THREATS = f"""ind AS (SELECT CASE WHEN indicator_type = 'url' THEN {NORM_URL.format('value')} ELSE {NORM_DOMAIN.format('value')} END AS indicator, indicator_type, threat_type, source, confidence, first_seen, tag FROM fx_indicators),
threats AS (SELECT indicator, indicator_type, threat_type, source, min(first_seen) AS first_seen, max(confidence) AS confidence FROM ind WHERE indicator <> '' GROUP BY ALL)"""
HITS = f"""hits AS (SELECT url, source AS threat_source, threat_type, confidence FROM (SELECT u.url, t.*, row_number() OVER (PARTITION BY u.url ORDER BY confidence DESC NULLS LAST, source, threat_type, indicator_type) AS place
 FROM (SELECT DISTINCT url FROM urls) u JOIN threats t ON (t.indicator_type = 'url' AND t.indicator = {NORM_URL.format('u.url')}) OR (t.indicator_type IN ('domain', 'ip') AND t.indicator = {NORM_DOMAIN.format('u.url')})) WHERE place = 1)"""


def _tokens(name: str, domains: list[str]) -> list[str]:
    key = lambda s: "".join(c for c in s if c.isascii() and c.isalnum()).lower()
    heads = [d.split(".")[0].lower() for d in domains]
    return sorted({x for x in [key(name), *heads, *map(key, heads)] if len(x) >= 3} | set(b.ALIASES.get(key(name), [])))


_brand_rows = [(i, n, d, _tokens(n, d), n.lower() in b.COMMON_WORDS) for i, (n, d) in enumerate(b.DEFAULT_BRANDS)]
BRANDS = f"""brands(brand_ord, brand, common_word) AS (VALUES {", ".join(f"({i}, '{n}', {str(c).lower()})" for i, n, _, _, c in _brand_rows)}),
domains(brand_ord, domain) AS (VALUES {", ".join(f"({i}, '{d}')" for i, _, ds, _, _ in _brand_rows for d in ds)}),
tokens(brand_ord, token) AS (VALUES {", ".join(f"({i}, '{k}')" for i, _, _, ks, _ in _brand_rows for k in ks)})"""
OFFICIAL = """official AS (SELECT url, arg_min(brand, brand_ord) AS official_brand FROM parts JOIN domains ON registrable = domain OR ends_with(host, '.' || domain) JOIN brands USING (brand_ord) GROUP BY url)"""
_has = lambda label: f"(CASE WHEN length(token) <= 4 THEN {label} = token OR starts_with({label}, token || '-') OR ends_with({label}, '-' || token) ELSE contains({label}, token) END)"
TOKEN_HITS = f"""located AS (SELECT url, brand_ord, token, {_has("split_part(registrable, '.', 1)")} AS in_label,
  coalesce(len(list_filter(string_split(subdomain, '.'), lambda x: {_has("x")})) > 0, false) AS in_subdomain, contains(path_query, token) AS in_path FROM parts CROSS JOIN tokens),
first_token AS (SELECT url, brand_ord, min(token) AS token FROM located WHERE in_label OR in_subdomain OR in_path GROUP BY ALL),
token_hits AS (SELECT located.* FROM located JOIN first_token USING (url, brand_ord, token))"""
_fold = lambda c: f"translate({c}, '0135@', 'olesa')"
_typo = f"(length(label) >= 4 AND length(token) >= 5 AND label <> token AND ({_fold('label')} = {_fold('token')} OR (abs(length(label) - length(token)) <= 2 AND CASE WHEN length(token) <= 6 THEN levenshtein({_fold('label')}, {_fold('token')}) = 1 ELSE levenshtein({_fold('label')}, {_fold('token')}) <= 2 END)))"
TYPOS = f"""pieces AS (SELECT url, split_part(registrable, '.', 1) AS label, true AS of_domain FROM parts UNION ALL
  SELECT url, label, false FROM (SELECT url, unnest(regexp_split_to_array(coalesce(subdomain, ''), '[^A-Za-z0-9]')) AS label FROM parts) WHERE label NOT IN ({", ".join(f"'{x}'" for x in b.IGNORED_LABELS)})),
typos AS (SELECT url, brand_ord, bool_or(of_domain) AS domain_typo, bool_or(NOT of_domain) AS subdomain_typo FROM pieces CROSS JOIN tokens WHERE {_typo} GROUP BY ALL)"""
BRANDED = f"""kw AS (SELECT *, {any_of("host || ' ' || coalesce(subdomain, '') || ' ' || path_query", t.PHISHING_KEYWORDS)} AS keywords FROM parts),
raw_c AS (SELECT coalesce(h.url, y.url) AS url, coalesce(h.brand_ord, y.brand_ord) AS brand_ord, coalesce(in_label, false) AS in_label, coalesce(in_subdomain, false) AS in_subdomain, coalesce(in_path, false) AS in_path, coalesce(domain_typo, false) AS domain_typo, coalesce(subdomain_typo, false) AS subdomain_typo
  FROM token_hits h FULL JOIN typos y ON h.url = y.url AND h.brand_ord = y.brand_ord),
c1 AS (SELECT r.*, brand, common_word, keywords, greatest(20, CASE WHEN in_label THEN 50 ELSE 0 END, CASE WHEN in_subdomain THEN 60 ELSE 0 END, CASE WHEN in_path THEN 25 ELSE 0 END, CASE WHEN domain_typo OR subdomain_typo THEN CASE WHEN keywords THEN 65 ELSE 30 END ELSE 0 END) AS s0
  FROM raw_c r JOIN brands USING (brand_ord) JOIN kw USING (url) WHERE url NOT IN (SELECT url FROM official)),
c2 AS (SELECT *, CASE WHEN keywords AND common_word THEN greatest(s0, 55) WHEN keywords THEN least(s0 + 20, 90) WHEN common_word THEN least(s0, 35) ELSE s0 END AS s1 FROM c1),
c3 AS (SELECT *, CASE WHEN in_path AND NOT (in_label OR in_subdomain OR domain_typo OR subdomain_typo) THEN least(s1, 35) ELSE s1 END AS score FROM c2),
best AS (SELECT url, brand, score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, brand_ord) AS place FROM c3) WHERE place = 1),
based AS (SELECT kw.*, official_brand, best.brand AS best_brand, score, CASE WHEN hosting_provider IS NOT NULL AND keywords THEN 55 ELSE 0 END AS base FROM kw LEFT JOIN official USING (url) LEFT JOIN best USING (url)),
branded AS (SELECT url, CAST(CASE WHEN official_brand IS NOT NULL THEN 5 WHEN score > base THEN score ELSE base END AS INT) AS brand_score,
  CASE WHEN official_brand IS NOT NULL THEN 95 WHEN score > base THEN CASE WHEN score >= 75 THEN 85 WHEN score >= 45 THEN 70 ELSE 55 END WHEN base > 0 THEN 70 ELSE 90 END AS brand_confidence,
  CASE WHEN official_brand IS NOT NULL THEN 'low' WHEN score > base THEN CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END WHEN base > 0 THEN 'medium' ELSE 'low' END AS risk_level,
  coalesce(official_brand, CASE WHEN score > base THEN best_brand END) AS matched_brand, official_brand IS NOT NULL AS official, hosting_provider, keywords FROM based)"""
JUDGED = """judged AS (SELECT url, 100 AS url_risk, 'bad' AS verdict, CAST(NULL AS VARCHAR) AS matched_brand, threat_source FROM hits UNION ALL
  SELECT url, brand_score, CASE WHEN official THEN 'good' WHEN brand_score >= 90 THEN 'bad' WHEN brand_score >= 45 THEN 'suspicious' ELSE 'unknown' END, CASE WHEN brand_score > 0 THEN matched_brand END, NULL FROM branded WHERE url NOT IN (SELECT url FROM hits))"""
SIGNALS = f"""signals AS (SELECT msg_id, expected_unsafe, CASE WHEN regexp_matches(message, '{t.SECRET_PATTERN}') THEN 85 ELSE 0 END AS secret,
  least(100, {count_of('lower(message)', t.INJECTION_PHRASES)} * 35) AS injection, least(80, {count_of('lower(message)', t.URGENCY_WORDS)} * 15) AS urgency, {count_of('lower(message)', t.URGENCY_WORDS)} >= 2 AS urgency_flag FROM fx_messages)"""
ALL_URL = f"{URLS}, {PARTS}, {BRANDS}, {OFFICIAL}, {TOKEN_HITS}, {TYPOS}, {BRANDED}"
SCORED = f"""{ALL_URL}, {THREATS}, {HITS}, {JUDGED}, {SIGNALS},
rep AS (SELECT msg_id, max(url_risk) AS url_reputation FROM urls JOIN judged USING (url) GROUP BY msg_id),
s AS (SELECT signals.*, url_reputation, CAST(floor(urgency * (CASE WHEN injection >= 80 THEN 30 ELSE 100 END) / 100) AS INT) AS p0 FROM signals LEFT JOIN rep USING (msg_id)),
f AS (SELECT *, NOT (coalesce(url_reputation >= 25, false) OR urgency >= 30 OR secret >= 45 OR injection >= 45) AND (url_reputation IS NULL OR p0 < 60) AS cap FROM s),
g AS (SELECT *, CASE WHEN cap THEN least(p0, 40) ELSE p0 END AS f_phishing, cap AND p0 > 40 AS capped FROM f),
h AS (SELECT *, greatest(f_phishing, secret, injection) AS base_risk FROM g),
scored AS (SELECT *, greatest(base_risk, coalesce(CASE WHEN url_reputation >= 75 OR base_risk >= 40 THEN url_reputation ELSE least(url_reputation, 40) END, 0)) AS overall_risk FROM h),
decided AS (SELECT *, CASE WHEN overall_risk >= 90 OR secret >= 85 THEN 'block' WHEN overall_risk >= 75 THEN 'warn_both' WHEN injection >= 60 THEN 'warn_sender' WHEN overall_risk >= 45 THEN 'warn_receiver' ELSE 'allow' END AS decision FROM scored)"""


def _msgs(q: str) -> str:
    return with_fixtures(q, "fx_messages")


def _both(q: str) -> str:
    return with_fixtures(q, "fx_messages", "fx_indicators")


def _messages(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, "fx_messages")


def _urls(s: SparkSession, d: str) -> DataFrame:
    return m.explode_urls(_messages(s, d)).select("msg_id", "url_pos", "url")


def _threats(s: SparkSession, d: str) -> DataFrame:
    return th.dedupe_threats(th.normalize_indicators(fixture(s, d, "fx_indicators")))


@query("p1_extract_urls", _msgs(f"WITH {URLS} SELECT msg_id, url_pos, url FROM urls"))
def _(s, d):
    return _urls(s, d)


@query("p2_p4_url_identity", _msgs(f"WITH {URLS} SELECT msg_id, url_pos, {NORM_URL.format('url')} AS url_norm, {NORM_DOMAIN.format('url')} AS host, sha256({NORM_URL.format('url')}) AS url_hash, sha256({NORM_DOMAIN.format('url')}) AS domain_hash FROM urls"))
def _(s, d):
    return m.with_url_identity(_urls(s, d)).select("msg_id", "url_pos", "url_norm", "host", "url_hash", "domain_hash")


@query("p5_p6_url_parts", _msgs(f"WITH {URLS}, {PARTS} SELECT * FROM parts"))
def _(s, d):
    return m.with_url_parts(_urls(s, d).select("url").distinct()).select("url", "host", "registrable", "subdomain", "path_query", "hosting_provider")


_TEXT = (
    f"trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '{t.EMAIL_PATTERN}', ' <email> ', 'g'), '{t.NUMBER_PATTERN}', ' <num> ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
)
_REDACTED = f"regexp_replace(regexp_replace(regexp_replace({_TEXT}, '{t.SECRET_PATTERN}', '<secret>', 'g'), '{t.CARD_PATTERN}', '<card>', 'g'), '{t.PHONE_PATTERN}', '<phone>', 'g')"


@query("p7_p9_normal_message", _msgs(f"SELECT msg_id, {_REDACTED} AS normal_text, sha256({_REDACTED}) AS message_hash FROM fx_messages"))
def _(s, d):
    return mem.with_message_keys(_messages(s, d)).select("msg_id", "normal_text", "message_hash")


def _simhash_sql(source: str) -> str:
    weights = f"CASE WHEN token IN ({', '.join(repr(x) for x in mem.HEAVY)}) THEN 4 WHEN token IN ({', '.join(repr(x) for x in mem.MEDIUM)}) THEN 3 ELSE 1 END"
    return f"""texts AS (SELECT DISTINCT normal_text FROM ({source})),
toks AS (SELECT normal_text, regexp_replace(regexp_replace(unnest(string_split(normal_text, ' ')), '^[^A-Za-z0-9<>]+', ''), '[^A-Za-z0-9<>]+$', '') AS token FROM texts),
bits AS (SELECT normal_text, CAST('0x' || substr(sha256(token), 1, 16) AS UBIGINT) AS h, {weights} AS w FROM toks WHERE token <> ''),
sums AS (SELECT normal_text, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN w ELSE -w END) AS s FROM bits, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS b) GROUP BY ALL),
hashes AS (SELECT normal_text, bit_or(CASE WHEN s >= 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS u FROM sums GROUP BY ALL),
simhashes AS (SELECT normal_text, CAST(CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END AS BIGINT) AS simhash FROM hashes)"""


_KEYED = f"SELECT msg_id, expected_unsafe, {_REDACTED} AS normal_text, sha256({_REDACTED}) AS message_hash FROM fx_messages"


@query("p10_simhash", _msgs(f"WITH keyed AS ({_KEYED}), {_simhash_sql('SELECT * FROM keyed')} SELECT msg_id, simhash FROM keyed JOIN simhashes USING (normal_text)"))
def _(s, d):
    # both sides of the hashing read the normalised texts, which cost more than the hashes
    keyed = written(mem.with_message_keys(_messages(s, d)).select("msg_id", "normal_text"), "keyed")
    return mem.with_simhash(keyed).select("msg_id", "simhash")


@query("p11_p13_signals", _msgs(f"WITH {SIGNALS} SELECT msg_id, secret, injection, urgency, urgency_flag FROM signals"))
def _(s, d):
    return m.score_signals(_messages(s, d)).select("msg_id", "secret", "injection", "urgency", "urgency_flag")


@query("p30_queue_priority", _msgs(f"WITH {URLS} SELECT DISTINCT url, CASE WHEN {any_of('lower(url)', t.QUEUE_BRANDS)} AND {any_of('lower(url)', t.QUEUE_INTENT)} THEN 90 WHEN {any_of('lower(url)', t.QUEUE_BRANDS)} THEN 80 WHEN {any_of('lower(url)', t.QUEUE_INTENT)} THEN 70 ELSE 50 END AS priority FROM urls"))
def _(s, d):
    return _urls(s, d).select("url").distinct().withColumn("priority", t.queue_priority(F.col("url")))


@query("g1_dedupe_threats", with_fixtures(f"WITH {THREATS} SELECT * FROM threats", "fx_indicators"))
def _(s, d):
    return _threats(s, d)


@query("g2_threat_tags", with_fixtures(f"WITH {THREATS} SELECT DISTINCT indicator, source, tag FROM ind WHERE tag <> '' AND indicator <> ''", "fx_indicators"))
def _(s, d):
    return th.threat_tags(th.normalize_indicators(fixture(s, d, "fx_indicators")))


@query("k2_feed_state", with_fixtures(f"WITH {THREATS} SELECT source, count(*) AS record_count, CAST(1719792000 AS BIGINT) AS updated_at FROM ind WHERE indicator <> '' GROUP BY source", "fx_indicators"))
def _(s, d):
    return th.feed_state(th.normalize_indicators(fixture(s, d, "fx_indicators")), 1_719_792_000)


@query("j1_w1_match_threats", _both(f"WITH {URLS}, {THREATS}, {HITS} SELECT * FROM hits"))
def _(s, d):
    return th.match_threats(_urls(s, d), _threats(s, d)).select("url", F.col("source").alias("threat_source"), "threat_type", "confidence")


_SITES = "SELECT DISTINCT concat(upper(substr(host, 1, 1)), substr(host, 2), ' & Co') AS brand, host FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) h WHERE host <> ''"


@query("s20_p33_brand_tokens", f"""WITH {BRANDS}, sites AS (SELECT brand, regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS key, lower(split_part(host, '.', 1)) AS label FROM ({_SITES})),
own AS (SELECT brand, key IN ({', '.join(f"'{w}'" for w in b.COMMON_WORDS)}) AS common_word, list_sort(list_distinct(list_filter([key, label, regexp_replace(label, '[^a-z0-9]', '', 'g')], lambda x: length(x) >= 3))) AS tokens FROM sites)
SELECT brand, common_word, string_agg(token, ',' ORDER BY token) AS tokens FROM brands JOIN tokens USING (brand_ord) GROUP BY ALL UNION ALL SELECT brand, common_word, array_to_string(tokens, ',') FROM own""")
def _(s, d):
    """The default brands and one for each site of the pages."""
    sites = b.brand_tokens(run(s, d, _SITES).select("brand", F.array("host").alias("official_domains")))
    both = b.default_brands(s).select("brand", "common_word", "tokens").unionByName(sites.select("brand", "common_word", "tokens"))
    return both.select("brand", "common_word", F.array_join("tokens", ",").alias("tokens"))


del _Q


def _parts(s: SparkSession, d: str) -> DataFrame:
    return m.with_url_parts(_urls(s, d).select("url").distinct())


@query("j5_official_brand", _msgs(f"WITH {ALL_URL} SELECT * FROM official"))
def _(s, d):
    return b.official_brand(_parts(s, d), b.default_brands(s)).select("url", F.col("brand").alias("official_brand"))


@query("j6_token_matches", _msgs(f"WITH {ALL_URL} SELECT * FROM located WHERE in_label OR in_subdomain OR in_path"))
def _(s, d):
    return b.token_matches(_parts(s, d), b.default_brands(s))


@query("j7_typo_matches", _msgs(f"WITH {ALL_URL} SELECT * FROM typos"))
def _(s, d):
    return b.typo_matches(_parts(s, d), b.default_brands(s))


@query("j8_w4_brand_impersonation", _msgs(f"WITH {ALL_URL} SELECT * FROM branded"))
def _(s, d):
    return b.brand_impersonation(_urls(s, d), b.default_brands(s))


@query("p31_judge_urls", _both(f"WITH {ALL_URL}, {THREATS}, {HITS}, {JUDGED} SELECT * FROM judged"))
def _(s, d):
    return judge_urls(_urls(s, d), _threats(s, d), b.default_brands(s)).drop("url_flag")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return score_messages(_messages(s, d), _threats(s, d), b.default_brands(s))


@query("score_messages", _both(f"WITH {SCORED} SELECT msg_id, secret, injection, urgency, url_reputation, f_phishing, capped, overall_risk, decision FROM decided"))
def _(s, d):
    return _scored(s, d).select("msg_id", "secret", "injection", "urgency", "url_reputation", "f_phishing", "capped", "overall_risk", "decision")


@query("p24_online_risk", _both(f"WITH {SCORED} SELECT msg_id, greatest(base_risk, coalesce(url_reputation, 0)) AS overall_risk FROM decided"))
def _(s, d):
    return score_messages(_messages(s, d), _threats(s, d), b.default_brands(s), online=True).select("msg_id", "overall_risk")


@query("g7_url_reputation", _both(f"WITH {SCORED} SELECT * FROM rep"))
def _(s, d):
    found = written(_urls(s, d).select("msg_id", "url"), "urls")
    return found.join(judge_urls(found, _threats(s, d), b.default_brands(s)), "url").groupBy("msg_id").agg(F.max("url_risk").alias("url_reputation"))


@query("p26_ai_only_decision", _both(f"WITH {SCORED} SELECT msg_id, CASE WHEN overall_risk >= 85 THEN 'block' WHEN overall_risk >= 65 THEN 'warn_both' WHEN overall_risk >= 45 THEN 'warn_sender' ELSE 'allow' END AS decision FROM decided"))
def _(s, d):
    return _scored(s, d).select("msg_id", m.decide_ai_only(F.col("overall_risk")).alias("decision"))


@query("f1_f2_observation_kind", _both(f"WITH {SCORED} SELECT msg_id, decision IN ('block', 'warn_both') OR overall_risk >= 75 OR secret >= 85 OR injection >= 60 AS stored, CASE WHEN decision = 'allow' AND overall_risk < 35 THEN 'safe' WHEN decision IN ('block', 'warn_both') OR overall_risk >= 75 THEN 'unsafe' END AS kind FROM decided"))
def _(s, d):
    r, c = F.col("overall_risk"), F.col("decision")
    return _scored(s, d).select("msg_id", m.store_as_unsafe(c, r, F.col("secret"), F.col("injection")).alias("stored"), m.observation_kind(c, r).alias("kind"))


_METRICS = "round(coalesce({0} / nullif({1}, 0), 0), 9)"
_CONFUSION = f"""SELECT tp, fp, tn, fn, {_METRICS.format('(tp + tn)', '(tp + fp + tn + fn)')} AS accuracy, {_METRICS.format('tp', '(tp + fp)')} AS precision, {_METRICS.format('tp', '(tp + fn)')} AS recall, {_METRICS.format('2 * tp', '(2 * tp + fp + fn)')} AS f1
 FROM (SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e AND NOT p) AS fn FROM ({{0}}))"""


@query("g13_detection_quality", _both(f"WITH {SCORED} " + _CONFUSION.format("SELECT expected_unsafe AS e, decision IN ('warn_receiver', 'warn_both', 'block') OR overall_risk >= 60 AS p FROM decided")))
def _(s, d):
    return m.quality_metrics(_scored(s, d))


@query("g14_url_quality", _both(f"WITH {ALL_URL}, {THREATS}, {HITS}, {JUDGED} " + _CONFUSION.format("SELECT expected_unsafe AS e, url_risk >= 45 AS p FROM urls JOIN judged USING (url) JOIN fx_messages USING (msg_id)")))
def _(s, d):
    found = m.explode_urls(_messages(s, d))
    judged = judge_urls(found, _threats(s, d), b.default_brands(s)).select("url", (F.col("url_risk") >= 45).alias("predicted"))
    return m.confusion(found.join(judged, "url"), "expected_unsafe", "predicted")


@query("g15_failures", _both(f"WITH {SCORED} SELECT msg_id, expected_unsafe, decision, overall_risk FROM decided WHERE expected_unsafe <> (decision IN ('warn_receiver', 'warn_both', 'block') OR overall_risk >= 60)"))
def _(s, d):
    predicted = F.col("decision").isin("warn_receiver", "warn_both", "block") | (F.col("overall_risk") >= 60)
    return _scored(s, d).where(F.col("expected_unsafe") != predicted).select("msg_id", "expected_unsafe", "decision", "overall_risk")


def _memory(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keyed = mem.with_simhash(written(mem.with_message_keys(_messages(s, d)).groupBy("message_hash", "normal_text").agg(F.min("msg_id").alias("seq"), F.max("expected_unsafe").alias("unsafe")), "keyed"))
    stored = keyed.where("unsafe").select("message_hash", "simhash", (F.col("seq") % 101).alias("risk"), F.col("seq").alias("last_seen"))
    return keyed, stored


_MEMORY = f"""keyed AS ({_KEYED}), {_simhash_sql('SELECT * FROM keyed')},
msgs AS (SELECT message_hash, simhash, min(msg_id) AS seq, bool_or(expected_unsafe) AS unsafe FROM keyed JOIN simhashes USING (normal_text) GROUP BY ALL),
stored AS (SELECT message_hash, simhash, seq % 101 AS risk, seq AS last_seen FROM msgs WHERE unsafe),
pairs AS (SELECT a.message_hash AS left_hash, b.message_hash AS right_hash, bit_count(xor(a.simhash, b.simhash)) AS distance FROM msgs a JOIN stored b ON a.message_hash <> b.message_hash AND bit_count(xor(a.simhash, b.simhash)) <= 12),
recent AS (SELECT * FROM stored ORDER BY last_seen DESC, message_hash LIMIT 5000)"""


@query("j11_hamming_join", _msgs(f"WITH {_MEMORY} SELECT left_hash, right_hash, CAST(distance AS INT) AS distance FROM pairs"))
def _(s, d):
    asked, stored = (written(df, "memory") for df in _memory(s, d))
    return mem.message_pairs(mem.hamming_pairs(asked, stored), asked, stored)


@query("j11_hamming_lsh")
def _(s, d):
    asked, stored = (written(df, "memory") for df in _memory(s, d))
    return mem.message_pairs(mem.lsh_pairs(asked, stored), asked, stored)


@query("j9_j10_g8_memory_lookup", _msgs(f"""WITH {_MEMORY}, near AS (SELECT left_hash, min(distance) AS nearest, count(*) AS n FROM pairs WHERE right_hash IN (SELECT message_hash FROM recent) GROUP BY ALL)
SELECT m.message_hash, s.message_hash IS NOT NULL AS exact, CAST(nearest AS INT) AS nearest, CAST(least(10, coalesce(near.n, 0)) AS INT) AS n_similar, greatest(CASE WHEN s.message_hash IS NOT NULL THEN 35 ELSE 0 END, CASE WHEN nearest <= 3 THEN 35 WHEN nearest <= 8 THEN 20 WHEN nearest <= 12 THEN 10 ELSE 0 END) AS memory_adjustment
FROM msgs m LEFT JOIN stored s USING (message_hash) LEFT JOIN near ON left_hash = m.message_hash"""))
def _(s, d):
    asked, stored = _memory(s, d)
    return mem.memory_lookup(asked, stored)


@query("w2_w3_top_similar", _msgs(f"WITH {_MEMORY} SELECT left_hash, right_hash, CAST(distance AS INT) AS distance, risk, CAST(place AS INT) AS place FROM (SELECT p.*, risk, row_number() OVER (PARTITION BY left_hash ORDER BY distance, risk DESC, right_hash) AS place FROM pairs p JOIN stored ON right_hash = message_hash) WHERE place <= 10"))
def _(s, d):
    asked, stored = _memory(s, d)
    asked, stored = written(asked, "memory"), written(stored, "memory")
    return mem.top_similar(mem.hamming_pairs(asked, stored), asked, stored)


#: Landed answer of each kind, and what is read from it: phishing, injection, impersonation, risk, confidence, flags, error.
ANSWERS = (
    ('{"phishing":90,"impersonation":20,"risk":70,"confidence":80,"flags":["a","b",3]}', (90, 0, 20, 70, 80, ["a", "b"], None)), ('```json\n{"phishing":150,"risk":-5,"flags":"x"}\n```', (100, 0, 0, 0, 0, [], None)), ("not json", (0, 0, 0, 0, 0, [], "invalid json")),
    ('{"phishing":"80","impersonation":55.5,"risk":60}', (0, 0, 0, 60, 0, [], None)), (None, (0, 0, 0, 0, 0, [], "no assessment")), ('```{"impersonation":99,"risk":99,"confidence":50,"flags":[]}```', (0, 0, 99, 99, 50, [], None)), ("{}", (0, 0, 0, 0, 0, [], None)),
    ('{"phishing":50,"prompt_injection":10,"impersonation":45,"risk":41,"confidence":101}', (50, 10, 45, 41, 100, [], None)),
)
_ANSWER = f"CASE msg_id % {len(ANSWERS)} " + " ".join(f"WHEN {i} THEN replace('{a}', '~', chr(10))".replace("\n", "~") for i, (a, _) in enumerate(ANSWERS) if a) + " END"
_AI = "ai(k, ai_phishing, ai_injection, ai_impersonation, ai_risk, ai_confidence, ai_flags, ai_missing) AS (VALUES " + ", ".join("(" + ", ".join([str(i), *map(str, w[:5]), str(w[5]) + "::VARCHAR[]", "NULL" if w[6] is None else f"'{w[6]}'"]) + ")" for i, (_, w) in enumerate(ANSWERS)) + ")"
#: What memory knows by the message's number: exact, similar, adjustment.
REMEMBERED = ((True, 2, 35), (False, 3, 20), (False, 0, 0))
_KNOWN = "known(r, memory_exact, memory_similar, memory_adjustment) AS (VALUES " + ", ".join(f"({i}, {str(e).lower()}, {n}, {a})" for i, (e, n, a) in enumerate(REMEMBERED)) + ")"


def _assessments(s: SparkSession, d: str) -> DataFrame:
    return m.parse_assessments(_messages(s, d).select("msg_id", F.expr(_ANSWER).alias("raw")).where("raw is not null"))


@query("s33_p20_assessments", _msgs(f"WITH {_AI} SELECT msg_id, ai_phishing, ai_injection, ai_impersonation, ai_risk, ai_confidence, array_to_string(ai_flags, ',') AS ai_flags, ai_missing AS ai_error FROM fx_messages JOIN ai ON k = msg_id % {len(ANSWERS)} WHERE ai_missing IS NULL OR ai_missing <> 'no assessment'"))
def _(s, d):
    return _assessments(s, d).withColumn("ai_flags", F.array_join("ai_flags", ","))


@query("p22_assessment_prompt", _msgs(f"SELECT msg_id, sha256('{m.ASSESSMENT_PROMPT}' || chr(10) || chr(10) || 'URL overview:' || chr(10) || user_id || chr(10) || chr(10) || 'Message:' || chr(10) || message) AS prompt_sha256 FROM fx_messages"))
def _(s, d):
    return _messages(s, d).select("msg_id", F.sha2(m.assessment_prompt(F.col("message"), F.col("user_id")), 256).alias("prompt_sha256"))


_ASSESSED = f"""{ALL_URL}, {THREATS}, {HITS}, {JUDGED}, {SIGNALS}, {_AI}, {_KNOWN},
rep AS (SELECT msg_id, max(url_risk) AS url_reputation, list(CASE WHEN h.url IS NOT NULL THEN 'known threat url: source=' || h.threat_source || ' threat=' || threat_type || ' confidence=' || coalesce('Some(' || confidence || ')', 'None') END ORDER BY url_pos) AS url_flags FROM urls JOIN judged USING (url) LEFT JOIN hits h USING (url) GROUP BY msg_id),
s AS (SELECT signals.*, url_reputation, url_flags, ai.*, known.*, CASE WHEN injection >= 80 THEN 30 ELSE 100 END AS w FROM signals LEFT JOIN rep USING (msg_id) JOIN ai ON k = msg_id % {len(ANSWERS)} JOIN known ON r = msg_id % {len(REMEMBERED)}),
x AS (SELECT *, CAST(floor(greatest(ai_phishing, urgency) * w / 100) AS INT) AS p0, CAST(floor(ai_impersonation * w / 100) AS INT) AS i0, CAST(floor(ai_risk * w / 100) AS INT) AS r0 FROM s),
f AS (SELECT *, NOT (coalesce(url_reputation >= 25, false) OR urgency >= 30 OR secret >= 45 OR injection >= 45) AND (url_reputation IS NULL OR p0 < 60) AS cap FROM x),
g AS (SELECT *, least(100, CASE WHEN cap THEN least(p0, 40) ELSE p0 END + memory_adjustment) AS f_phishing, CASE WHEN cap THEN least(i0, 40) ELSE i0 END AS f_impersonation, CASE WHEN cap THEN least(r0, 40) ELSE r0 END AS f_risk, cap AND greatest(p0, i0, r0) > 40 AS capped FROM f),
h AS (SELECT *, greatest(f_phishing, secret, injection, f_impersonation, f_risk) AS base_risk FROM g),
o AS (SELECT *, greatest(base_risk, coalesce(CASE WHEN url_reputation >= 75 OR base_risk >= 40 THEN url_reputation ELSE least(url_reputation, 40) END, 0)) AS overall_risk FROM h),
t AS (SELECT *, list_filter(list_concat([CASE WHEN memory_exact THEN 'exact unsafe message memory match' WHEN memory_similar > 0 THEN memory_similar || ' similar unsafe message memory matches' END], coalesce(url_flags, []),
 [CASE WHEN injection > 0 THEN 'prompt injection language detected' END, CASE WHEN secret > 0 THEN 'possible secret in message' END, CASE WHEN urgency_flag THEN 'phishing urgency/account language detected' END], ai_flags, ['ai unavailable: ' || ai_missing, CASE WHEN capped THEN 'ai-only medium risk capped without supporting evidence' END]), lambda v: v IS NOT NULL) AS flags FROM o)"""


@query("p23_p27_j25_assessed", _both(f"""WITH {_ASSESSED} SELECT msg_id, f_phishing, f_impersonation, f_risk, capped, overall_risk, CASE WHEN overall_risk >= 90 OR secret >= 85 THEN 'block' WHEN overall_risk >= 75 THEN 'warn_both' WHEN injection >= 60 THEN 'warn_sender' WHEN overall_risk >= 45 THEN 'warn_receiver' ELSE 'allow' END AS decision,
 array_to_string(flags, '; ') AS flags, CASE WHEN overall_risk >= 75 THEN 'High-risk message (' || overall_risk || '/100, AI confidence ' || ai_confidence || '/100): ' || array_to_string(flags, ', ') || '.' END AS summary FROM t"""))
def _(s, d):
    i = F.col("msg_id") % len(REMEMBERED)
    pick = lambda n: F.element_at(F.array(*[F.lit(r[n]) for r in REMEMBERED]), (i + 1).cast("int"))
    memory = _messages(s, d).select("msg_id", pick(0).alias("memory_exact"), pick(1).alias("memory_similar"), pick(2).alias("memory_adjustment"))
    out = score_messages(_messages(s, d), _threats(s, d), b.default_brands(s), _assessments(s, d), memory)
    return out.select("msg_id", "f_phishing", "f_impersonation", "f_risk", "capped", "overall_risk", "decision", F.array_join("flags", "; ").alias("flags"), "summary")
