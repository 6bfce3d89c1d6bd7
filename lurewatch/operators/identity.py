"""Learning brand identities from pages, and tags and texts made from judged urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
# Domains never learned, letters folded in keys, titles that name no brand, points and limits.
RESERVED = ("example.com", "example.org", "example.net")
FOLDED = {"a": "áàäâãåÁÀÄÂÃÅ", "c": "čçČÇ", "d": "ďĎ", "e": "éěèëêÉĚÈËÊ", "i": "íìïîÍÌÏÎ", "n": "ňñŇÑ", "o": "óòöôõÓÒÖÔÕ", "r": "řŘ", "s": "šŠ", "t": "ťŤ", "u": "úůùüûÚŮÙÜÛ", "y": "ýÿÝŸ", "z": "žŽ"}
GENERIC_TITLES = ("home", "homepage", "index", "uvod", "vod")
LEAST_CONFIDENCE, VERIFIED = 55, 85


def _label(domain: Column) -> Column:
    return F.split(domain, r"\.")[0]


def identity_key(c: Column) -> Column:
    """Letters and digits of a name, accents folded, in lower case."""
    folded = F.translate(c, "".join(FOLDED.values()), "".join(k * len(v) for k, v in FOLDED.items()))
    return t.ascii_lower(F.regexp_replace(folded, "[^A-Za-z0-9]", ""))


def clean_name(c: Column) -> Column:
    """The first part of a title that says more than home, without a closing domain ending, at most 80 characters."""
    parts = F.filter(F.transform(F.split(c, "[|:,\\-–—]"), t.trimmed), lambda p: p != "")
    own = F.filter(parts, lambda p: ~identity_key(p).isin(*GENERIC_TITLES))
    chosen = t.trimmed(F.coalesce(F.get(own, F.lit(0)), F.get(parts, F.lit(0)), c))
    return F.left(F.regexp_replace(chosen, r"(?:\.net)*(?:\.org)*(?:\.com)*$", ""), F.lit(80))


def identity_name(df: DataFrame) -> DataFrame:
    """Adds name: the first organisation, og site name, application name, app title, og title or title, cleaned; null if its key
    has under three letters. Reads org_names (array), og_site_name, application_name, apple_app_title, og_title, title."""
    name = clean_name(F.coalesce(F.get("org_names", F.lit(0)), "og_site_name", "application_name", "apple_app_title", "og_title", "title"))
    return df.withColumn("name", F.when(F.length(identity_key(name)) >= 3, name))


def identity_confidence(df: DataFrame) -> DataFrame:
    """Adds authoritative, confidence and status (verified, candidate or null where not admitted).

    Reads source_domain, popularity_rank (nullable), boost, org_names, org_domains, same_as_domains (arrays), og_site_name,
    application_name, title, name, canonical_domain, form_count, has_password, has_credential_words, hosting_provider.
    """
    c = F.col
    rank, boost = F.coalesce(c("popularity_rank"), F.lit(2_000_000_000)), c("boost")
    same_canonical = F.coalesce(c("canonical_domain") == c("source_domain"), F.lit(False))
    in_org, in_same = F.array_contains("org_domains", c("source_domain")), F.array_contains("same_as_domains", c("source_domain"))
    label_match = F.coalesce(_label(c("canonical_domain")) == _label(c("source_domain")), F.lit(False))
    trusted = (boost >= 10) & (rank <= 100_000)
    named = c("og_site_name").isNotNull() | c("application_name").isNotNull()
    df = df.withColumn("authoritative", same_canonical | in_org | in_same)
    when = lambda cond, n: F.when(cond, n).otherwise(0)
    points = (
        F.when(c("popularity_rank").isNull(), 0).when(rank <= 10_000, 45).when(rank <= 100_000, 35).otherwise(20) + F.least(boost, F.lit(15)) + when(F.size("org_names") > 0, 25)
        + when(named, 15) + when((rank <= 10_000) & c("title").isNotNull(), 10) + when(trusted & c("title").isNotNull(), 10)
        + when(same_canonical | in_org, 15) + when(label_match, 15) + when((rank <= 100) & same_canonical, 15) + when(F.size("same_as_domains") > 0, 10)
    )
    asks = (c("form_count") > 0) & (c("has_password") | c("has_credential_words")) & ~c("authoritative") & ~label_match & ~trusted
    own = identity_key(_label(c("source_domain")))
    title_match = F.coalesce((own != "") & identity_key(c("name")).contains(own), F.lit(False))
    allowed = (
        F.when(c("source_domain").isin(*RESERVED), False).when(c("hosting_provider").isNotNull() & ~c("authoritative"), False)
        .when(c("authoritative") | label_match | (trusted & c("title").isNotNull()), True).when(~title_match, False)
        .otherwise((rank <= 1_000) | trusted | ((rank <= 10_000) & named))
    )
    df = df.withColumn("confidence", F.when(asks, 0).otherwise(F.least(F.lit(95), points)))
    admitted = (c("confidence") >= LEAST_CONFIDENCE) & allowed & c("name").isNotNull()
    return df.withColumn("status", F.when(admitted & (c("confidence") >= VERIFIED), "verified").when(admitted, "candidate"))


def identity_signals() -> Column:
    """The kinds of identity evidence that a page has, in their order."""
    c = F.col
    kinds = (
        (F.size("org_names") > 0, "jsonld_organization"), (c("og_site_name").isNotNull(), "og_site_name"), (c("application_name").isNotNull(), "application_name"),
        (c("canonical_domain").isNotNull(), "canonical_domain"), (F.size("same_as_domains") > 0, "same_as_domains"),
    )
    return F.array_compact(F.array(*[F.when(cond, k) for cond, k in kinds]))


def brand_candidates(df: DataFrame) -> DataFrame:
    """(brand_key, display_name, primary_domain, status, confidence, popularity_rank, evidence_json) of the admitted pages.

    Reads what ``identity_confidence`` reads and gives, and final_domain; nulls stay in the JSON.
    """
    evidence = F.struct(
        identity_signals().alias("signals"), F.col("popularity_rank").alias("tranco_rank"), F.col("boost").alias("local_reputation_boost"), "final_domain", "canonical_domain",
        F.col("org_domains").alias("organization_domains"), "same_as_domains", F.size("analytics_ids").alias("analytics_ids_seen"), F.col("form_count").alias("forms"),
        (F.col("has_password") | F.col("has_credential_words")).alias("has_credentials"),
    )
    return df.where("status is not null").select(
        identity_key(F.col("name")).alias("brand_key"), F.col("name").alias("display_name"), F.col("source_domain").alias("primary_domain"), "status", "confidence", "popularity_rank",
        F.to_json(evidence, {"ignoreNullFields": "false"}).alias("evidence_json"),
    )


def domain_relationships(df: DataFrame) -> DataFrame:
    """(source_domain, related_domain, relation_type, confidence, evidence_json): one row for each other domain that the page's
    organisation, sameAs, canonical link and manifest name, and one for each analytics id, hashed."""
    listed = F.concat("org_domains", "same_as_domains", F.array("canonical_domain", "manifest_domain"))
    domains = df.select("source_domain", F.explode(listed).alias("related_domain")).where("related_domain is not null and related_domain != '' and related_domain != source_domain")
    page = domains.select("*", F.lit("page_metadata").alias("relation_type"), F.lit(55).alias("confidence"), F.lit('{"source":"page_metadata"}').alias("evidence_json"))
    ids = df.select("source_domain", F.col("source_domain").alias("related_domain"), F.lit("analytics_id_seen").alias("relation_type"), F.lit(35).alias("confidence"), F.explode("analytics_ids").alias("i"))
    return page.unionByName(ids.withColumn("evidence_json", F.to_json(F.struct(F.sha2("i", 256).alias("analytics_id_hash")))).drop("i"))


def brand_tags(df: DataFrame, worker: bool = False) -> DataFrame:
    """Adds tags of a brand result. ``worker`` is the queue worker's form: the risk level first, the brand before what it means, and
    each sign of a name as one underscore."""
    value = lambda c: t.ascii_lower(F.regexp_replace(c, "[^A-Za-z0-9]", "_"))
    provider, brand = F.col("hosting_provider"), F.col("matched_brand")
    seen = [F.when(brand.isNotNull(), "brand_seen"), F.concat(F.lit("brand:"), value(brand) if worker else t.ascii_lower(brand))]
    level = [F.when(F.col("official"), "official_brand_domain"), F.when(F.col("brand_score") >= 45, "brand_impersonation")]
    host = [F.when(provider.isNotNull(), "known_hosting_provider"), F.concat(F.lit("hosting_provider:"), value(provider) if worker else F.replace(provider, F.lit("."), F.lit("_")))]
    tags = [F.concat(F.lit("risk_level:"), "risk_level"), *seen, *level, *host] if worker else [*level, *host, *seen]
    return df.withColumn("tags", F.array_compact(F.array(*tags)))


def unsafe_tags(df: DataFrame) -> DataFrame:
    """Adds unsafe_tags, sorted and distinct: reads f_phishing, secret, injection, f_impersonation, url_reputation, url_tags, urgency_flag."""
    own = F.array_compact(F.array(F.when(F.col("f_phishing") >= 60, "phishing"), F.when(F.col("secret") >= 85, "secret_leak"), F.when(F.col("injection") >= 60, "prompt_injection"), F.when(F.col("f_impersonation") >= 60, "impersonation"), F.when(F.col("url_reputation") >= 75, "known_bad_url"), F.when(F.col("urgency_flag"), "urgency_language")))
    return df.withColumn("unsafe_tags", F.array_sort(F.array_union(own, F.coalesce("url_tags", F.array().cast("array<string>")))))


NO_URLS = "No URLs found."


def url_context(messages: DataFrame, urls: DataFrame, key: str, evidence: DataFrame | None = None) -> DataFrame:
    """(key, context) of every message: its urls in order with domain, subdomain, hosting provider and network evidence.

    ``urls`` has the key, url_pos, url, registrable, subdomain and hosting_provider (null unless the url's brand result names
    it); ``evidence`` has url, kind, key_name, value_text and place (newest first); rows without a value are left out.
    """
    line = F.concat_ws("\n", F.concat(F.lit("- "), "url"), F.concat(F.lit("  Domain: "), "registrable"), F.concat(F.lit("  Subdomain: "), "subdomain"), F.concat(F.lit("  Hosting provider: "), "hosting_provider"))
    rows = urls.withColumn("line", line)
    if evidence is not None:
        told = F.concat(F.lit("    - "), "kind", F.lit(" "), "key_name", F.lit(": "), "value_text")
        lines = F.transform(F.array_sort(F.collect_list(F.struct("place", told.alias("told")))), lambda x: x["told"])
        known = evidence.groupBy("url").agg(F.concat(F.lit("  Evidence:\n"), F.array_join(lines, "\n")).alias("proof"))
        rows = rows.join(known, "url", "left").withColumn("line", F.concat_ws("\n", "line", F.regexp_replace("proof", "\n$", "")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("url_pos", "line"))), lambda x: x["line"])
    told = rows.groupBy(key).agg(F.concat_ws("\n", F.lit("URL Overview:"), F.array_join(ordered, "\n")).alias("context"))
    return messages.select(key).join(told, key, "left").select(key, F.coalesce("context", F.lit(NO_URLS)).alias("context"))
