"""Facts from pages, WHOIS texts and addresses, and the online score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

# WHOIS line patterns, marks, field words, page patterns and provider ranges.
CREATED = (r"(?im)^Creation Date:\s*(.+)", r"(?im)^created:\s*(.+)", r"(?im)^registered:\s*(.+)", r"(?im)^Created on\s*(.+)")
EXPIRES = (r"(?im)^Registry Expiry Date:\s*(.+)", r"(?im)^expire:\s*(.+)", r"(?im)^Expiry Date:\s*(.+)")
REGISTRAR = (r"(?im)^Registrar:\s*(.+)",)
PASSWORD_MARKS = ('type="password"', "type='password'")
CREDENTIAL_WORDS = ("otp", "one-time", "credit card", "cvv", "seed phrase")
OTP_WORDS = ("otp", "one-time", "2fa", "mfa")
CARD_WORDS = ("card number", "credit card", "cvv")
ORGANISATION_TYPES = ("organization", "corporation", "brand")
ANALYTICS = ((r"GTM-[A-Z0-9]+", 0), (r"G-[A-Z0-9]+", 0), (r"UA-\d+-\d+", 0), (r"""clarity\(['"]set['"],\s*['"]([a-z0-9]+)['"]""", 1))
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
FORM_ACTION = r"""(?is)<form[^>]+action\s*=\s*['"](https?://[^'"\s>]+)['"]"""
JSONLD_BLOCK = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
PROVIDER_RANGES = (
    ("vercel", "76.76.21.0/24"), ("aws-global-accelerator/netlify", "75.2.60.0/24"), ("aws-global-accelerator/netlify", "99.83.128.0/17"),
    ("cloudflare", "104.16.0.0/12"), ("cloudflare", "172.64.0.0/13"), ("github-pages", "131.103.20.160/27"),
    ("github-pages", "185.199.108.0/22"), ("fastly", "199.232.0.0/16"), ("fastly", "151.101.0.0/16"),
)


def meta_pattern(attribute: str, key: str) -> str:
    """A meta tag with the content after (group 1) or before (group 2) its key."""
    content, named = """content=["']([^"']+)["']""", f"""{attribute}=["']{key}["']"""
    return f"(?is)<meta[^>]+{named}[^>]+{content}[^>]*>|<meta[^>]+{content}[^>]+{named}[^>]*>"


def link_pattern(rel: str) -> str:
    return f"""(?is)<link[^>]+rel=["'][^"']*{rel}[^"']*["'][^>]+href=["']([^"']+)["'][^>]*>"""


def _first(raw: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that occurs, trimmed; lines end at line feeds only."""
    unix = [p.replace("(?im)", "(?imd)") for p in patterns]
    return F.coalesce(*[F.when(raw.rlike(p), t.trimmed(F.regexp_extract(raw, p, 1))) for p in unix])


def parsed_time(text: Column, strict: bool = False) -> Column:
    """RFC 3339 times with their offset, to the second; unless ``strict`` also day.month.year times, taken as UTC."""
    whole = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2})\.\d+", "$1")
    rfc = F.try_to_timestamp(F.regexp_replace(whole, "^(.{10})[Tt ]", "$1T"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return rfc if strict else F.coalesce(rfc, F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("d.M.yyyy H:m:sX")))


def whois_facts(df: DataFrame, asof: Column, raw: str = "raw", strict: bool = False) -> DataFrame:
    """Adds created_text, expires_text, registrar, privacy, age_days and whois_risk.

    ``strict`` is the form for online evidence: RFC 3339 dates only, privacy marks in any case. A null text has no facts.
    """
    c = F.col(raw)
    low = t.ascii_lower(c)
    privacy = low.contains("privacy") | low.contains("redacted") if strict else c.contains("privacy") | c.contains("REDACTED")
    out = df.withColumn("created_text", _first(c, CREATED)).withColumn("expires_text", _first(c, EXPIRES)).withColumn("registrar", _first(c, REGISTRAR)).withColumn("privacy", F.coalesce(privacy, F.lit(False)))
    age = t.whole_days(parsed_time(F.col("created_text"), strict), asof)
    by_age = F.when(F.col("age_days").isNull(), 20).when(F.col("age_days") < 30, 60).when(F.col("age_days") < 90, 40).when(F.col("age_days") < 180, 20).when(F.col("age_days") < 365, 10).otherwise(0)
    return out.withColumn("age_days", age).withColumn("whois_risk", F.least(F.lit(100), by_age + F.when(F.col("privacy"), 20).otherwise(0)))


def _squeezed(c: Column) -> Column:
    return t.trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def _clean(c: Column) -> Column:
    """White space squeezed, five entities undone in their order, at most 120 characters; null where nothing is left."""
    c = _squeezed(c)
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.nullif(F.left(t.trimmed(c), F.lit(120)), F.lit(""))


def read_whois(spark: SparkSession, path: str, asof: Column, strict: bool = False) -> DataFrame:
    """(domain, raw and its facts) of landed answers, a JSON line (domain, raw) each; the last of several of a domain by its text."""
    rows = spark.read.schema("domain string, raw string").json(path).where("domain is not null")
    return whois_facts(rows.groupBy("domain").agg(F.max("raw").alias("raw")), asof, strict=strict)


def link_domain(url: Column) -> Column:
    """Registrable domain of a link; null for relative links, fragments and mail addresses."""
    domain = F.nullif(t.registrable_domain(t.normal_domain(url)), F.lit(""))
    return F.when(~(url.startswith("/") | url.startswith("#") | url.startswith("mailto:")), domain)


def read_pages(df: DataFrame, most: int = 524_288) -> DataFrame:
    """Landed snapshots (url, final_url, status, content_type, html): html cut at ``most`` characters, final_domain and fetch_error.

    A content type that is filled and neither HTML nor XHTML leaves no html and an error.
    """
    kind = F.coalesce(t.ascii_lower(F.col("content_type")), F.lit(""))
    other = (kind != "") & ~kind.contains("text/html") & ~kind.contains("application/xhtml")
    return df.withColumns({
        "html": F.when(~other, F.left("html", F.lit(most))), "final_domain": t.registrable_domain(t.normal_domain(F.col("final_url"))),
        "fetch_error": F.when(other, F.concat(F.lit("unsupported content-type: "), kind)),
    })


def page_metadata(df: DataFrame, html: str = "html", most: int = 524_288) -> DataFrame:
    """Adds title, og_site_name, og_title, application_name, apple_app_title, canonical_domain, manifest_domain, analytics_ids,
    form_count, has_password and has_credential_words. A null page has null texts, no ids, no forms and no fields."""
    h = F.coalesce(F.left(F.col(html), F.lit(most)), F.lit(""))
    low = t.ascii_lower(h)
    meta = lambda attribute, key: _clean(F.concat(*[F.regexp_extract(h, meta_pattern(attribute, key), g) for g in (1, 2)]))
    ids = F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(h, F.lit(p), g) for p, g in ANALYTICS])))
    return df.withColumns({
        "title": _clean(F.regexp_extract(h, TITLE, 1)), "og_site_name": meta("property", "og:site_name"), "og_title": meta("property", "og:title"),
        "application_name": meta("name", "application-name"), "apple_app_title": meta("name", "apple-mobile-web-app-title"),
        "canonical_domain": link_domain(F.regexp_extract(h, link_pattern("canonical"), 1)), "manifest_domain": link_domain(F.regexp_extract(h, link_pattern("manifest"), 1)),
        "analytics_ids": ids, "form_count": F.size(F.regexp_extract_all(low, F.lit("<form"), 0)), "has_password": t.contains_any(low, PASSWORD_MARKS), "has_credential_words": t.contains_any(low, CREDENTIAL_WORDS),
    })


def page_evidence(df: DataFrame, html: str = "html", url: str = "url", brand: str | None = None) -> DataFrame:
    """Adds page_title, password_field, otp_field, card_field, page_forms, external_form and page_brand.

    external_form: the first absolute form action with a domain is on another registrable domain than the page. ``brand`` names
    the column of the matched brand. A null page has no evidence.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    low = t.ascii_lower(h)
    actions = F.transform(F.regexp_extract_all(low, F.lit(FORM_ACTION), 1), lambda a: t.registrable_domain(t.normal_domain(a)))
    first = F.get(F.filter(actions, lambda a: a != ""), F.lit(0))
    own = t.registrable_domain(t.normal_domain(F.coalesce(F.col(url), F.lit(""))))
    named = low.contains(t.ascii_lower(F.col(brand))) if brand else F.lit(False)
    return df.withColumns({
        "page_title": F.when(h.rlike(TITLE), F.left(_squeezed(F.regexp_extract(h, TITLE, 1)), F.lit(160))), "password_field": t.contains_any(low, PASSWORD_MARKS),
        "otp_field": t.contains_any(low, OTP_WORDS), "card_field": t.contains_any(low, CARD_WORDS), "page_forms": F.size(F.regexp_extract_all(low, F.lit("<form"), 0)),
        "external_form": F.coalesce(first != own, F.lit(False)), "page_brand": F.coalesce(named, F.lit(False)),
    })


_MOST_LEVELS = 64  # of nested lists and graphs; JSON parsers refuse far deeper ones


def _unfolded(start: Column, children) -> Column:
    """All variants met from ``start`` on by going to ``children``, level by level, none twice."""
    none = F.array().cast("array<variant>")
    begin = F.struct(none.alias("met"), start.alias("next"))
    step = lambda acc, _: F.struct(F.concat(acc["met"], acc["next"]).alias("met"), F.flatten(F.transform(acc["next"], children)).alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_LEVELS)), begin, step, lambda acc: acc["met"])


def _listed(v: Column, path: str = "$") -> Column:
    """The items of a list under the path, or the single value there, or nothing."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def jsonld_facts(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, org_names, org_domains, same_as_domains), sorted and distinct, for pages with JSON-LD blocks.

    Organisations are objects whose type text names an organisation, corporation or brand, through lists and @graph. Blocks
    that are no JSON give nothing.
    """
    own = df.where(F.col(html).contains("ld+json") | F.col(html).contains("LD+JSON") | F.lower(html).contains("ld+json"))
    blocks = own.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(JSONLD_BLOCK), 1)).alias("block")).select(key, F.try_parse_json(t.trimmed(F.col("block"))).alias("v")).where("v is not null")
    is_list = lambda v: F.try_variant_get(v, "$", "array<variant>").isNotNull()
    none = F.array().cast("array<variant>")
    item = blocks.select(key, F.explode(_unfolded(F.array("v"), lambda x: F.when(is_list(x), _listed(x)).otherwise(_listed(x, "$['@graph']")))).alias("o"))
    kind = F.lower(F.coalesce(F.try_variant_get("o", "$['@type']", "string"), F.lit("")))
    org = item.where(~is_list(F.col("o")) & t.contains_any(kind, ORGANISATION_TYPES))
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    links = _unfolded(F.array(F.try_variant_get("o", "$.sameAs", "variant")), lambda x: F.when(is_list(x), _listed(x)).otherwise(none))
    facts = org.select(
        key, _clean(text(F.try_variant_get("o", "$.name", "variant"))).alias("name"), link_domain(text(F.try_variant_get("o", "$.url", "variant"))).alias("domain"),
        F.filter(F.transform(F.filter(links, lambda x: x.isNotNull()), lambda x: link_domain(text(x))), lambda x: x.isNotNull()).alias("same"),
    )
    return facts.groupBy(key).agg(
        F.array_sort(F.collect_set("name")).alias("org_names"), F.array_sort(F.collect_set("domain")).alias("org_domains"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("same")))).alias("same_as_domains")
    )


def provider_ranges(spark: SparkSession) -> DataFrame:
    """(ord, provider, cidr): the known ranges in their order."""
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(PROVIDER_RANGES)], "ord int, provider string, cidr string")


def ip_provider(df: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """(row columns, provider): first range in order that holds the IPv4 address.

    Ranges are keyed by their /8 so that the join is an equality; each range of up to /8 has one key.
    """
    number = lambda c: F.aggregate(F.transform(F.split(c, r"\."), lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    valid = df.where(F.col(ip).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).withColumn("_n", number(F.col(ip))).withColumn("_a", F.expr("_n div 16777216"))
    bits = F.split("cidr", "/")[1].cast("int")
    r = ranges.select("ord", "provider", number(F.split("cidr", "/")[0]).alias("_base"), F.pow(F.lit(2), 32 - bits).cast("bigint").alias("_size")).withColumn("_a", F.expr("_base div 16777216"))
    met = valid.join(r, "_a").where((F.col("_n") >= F.col("_base") - F.col("_base") % F.col("_size")) & (F.col("_n") < F.col("_base") - F.col("_base") % F.col("_size") + F.col("_size")))
    return met.groupBy(*df.columns).agg(F.min_by("provider", "ord").alias("provider"))


def score_online(df: DataFrame) -> DataFrame:
    """Adds online_score and online_confidence, by the rules in their order.

    Reads start (a score), brand_matched, page_brand, credentials, favicon_match, external_form, domain_changed, whois_age,
    provider, http_status, http_error, whois_error, official.
    """
    c = F.col
    matched = c("brand_matched")
    signal = matched | c("page_brand") | c("favicon_match")
    s = F.when(c("credentials"), F.greatest(c("start"), F.when(matched, 90).otherwise(60))).otherwise(c("start"))
    out = df.withColumn("_s", s)
    step = lambda cond, value: out.withColumn("_s", F.when(F.coalesce(cond, F.lit(False)), value).otherwise(c("_s")))
    more = lambda n: F.least(c("_s") + n, F.lit(95))
    out = step(c("page_brand") & c("credentials") & ~c("official"), F.greatest(c("_s"), F.lit(85)))
    out = step(c("favicon_match") & ~c("official"), F.greatest(c("_s"), F.lit(85)))
    out = step(c("external_form"), F.when(c("credentials") | signal, more(10)).otherwise(F.greatest(c("_s"), F.lit(45))))
    out = step(c("domain_changed") & matched, more(10))
    out = step((c("whois_age") < 30) & matched, more(10))
    out = step(c("provider").isNotNull() & matched, more(5))
    weak = ~c("credentials") & ~c("favicon_match") & ~c("external_form") & ~(c("domain_changed") & matched)
    cap = F.when((c("whois_age") > 180) & c("http_status").isNotNull(), 35).when(~signal, 40).otherwise(60)
    out = step(weak, F.least(c("_s"), cap))
    out = step(~matched & ~c("page_brand"), F.least(c("_s"), F.lit(40)))
    conf = F.when(c("_s") >= 85, 90).when(c("_s") >= 60, 75).otherwise(60) - F.when(c("http_error"), 15).otherwise(0) - F.when(c("whois_error"), 5).otherwise(0)
    return out.withColumn("online_score", F.when(c("official"), c("start")).otherwise(c("_s"))).withColumn("online_confidence", F.when(c("official"), 95).otherwise(conf)).drop("_s")


def favicon_url(url: Column) -> Column:
    """Where a page's icon lies: at the root of what stands before the first slash, over https unless the url says http."""
    u = t.trimmed(url)
    return F.concat(F.when(u.startswith("http://"), "http://").otherwise("https://"), F.split(t.without_scheme(u), "/")[0], F.lit("/favicon.ico"))


def favicon_hash(icon: Column, most: int = 262_144) -> Column:
    """SHA-256 of an icon's bytes; null for none and for more than ``most`` bytes."""
    return F.when(F.octet_length(icon).between(1, most), F.sha2(icon, 256))


def favicon_matches(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds favicon_match: the page's icon hash is listed for its matched brand. ``catalogue`` has (brand_key, hash)."""
    known = catalogue.select(F.col("brand_key").alias("_k"), F.lower("hash").alias("_h"), F.lit(True).alias("_m")).distinct()
    met = df.join(known, (F.col("brand_key") == F.col("_k")) & (F.col("icon_hash") == F.col("_h")), "left")
    return met.withColumn("favicon_match", F.coalesce("_m", F.lit(False))).drop("_k", "_h", "_m")
