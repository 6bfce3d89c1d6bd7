"""Building the brand catalogue, joining ranks, reputation and evidence, and writing state tables and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from .brands import brand_key
from .identity import identity_key
from .state import latest, network_evidence, reputation_boost

# Domains that belong to no single brand, and where bindings come from.
SHARED_DOMAINS = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "github.com", "medium.com", "wikipedia.org", "wikidata.org", "google.com", "apple.com",
    "play.google.com", "apps.apple.com", "microsoft.com", "windows.net",
)
BINDINGS_HOME = "wikidata.org"


def read_brand_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, domain, brand_key, item_id, sitelinks) from landed query results, one binding a line or in a results document.

    Names that are mere item numbers, empty domains, the home of the results itself and keys under three letters are left out.
    """
    value = "struct<value:string>"
    one = f"struct<itemLabel:{value},website:{value},sitelinks:{value},item:{value}>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"results struct<bindings:array<{one}>>").alias("j"), F.xxhash64("value").alias("file")).select("file", F.posexplode("j.results.bindings").alias("at", "b"))
    c = F.col
    site = F.regexp_replace(t.normal_domain(c("b.website.value")), r"^(?:www\.)+", "")
    out = rows.select(
        F.struct("file", "at").alias("pos"), c("b.itemLabel.value").alias("name"), site.alias("domain"), brand_key(c("b.itemLabel.value")).alias("brand_key"), F.coalesce(F.regexp_extract(c("b.item.value"), "[^/]*$", 0), F.lit("")).alias("item_id"),
        F.coalesce(F.expr("try_cast(b.sitelinks.value as int)"), F.lit(0)).alias("sitelinks"),
    )
    return out.where("name is not null and domain is not null and domain != ''").where(~c("name").rlike("^Q[0-9]*$") & (c("domain") != BINDINGS_HOME) & (F.length("brand_key") >= 3))


def build_catalogue(bindings: DataFrame) -> DataFrame:
    """(brand_key, brand, item_id, sitelinks, official_domains): one row per key with the name seen first, its domains in order of
    sight, and the greatest popularity."""
    seen = bindings.groupBy("brand_key", "domain").agg(F.min("pos").alias("at"))
    domains = seen.groupBy("brand_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "domain"))), lambda x: x["domain"]).alias("official_domains"))
    first = bindings.groupBy("brand_key").agg(F.min_by(F.struct("name", "item_id"), "pos").alias("f"), F.max("sitelinks").alias("sitelinks"))
    return first.join(domains, "brand_key").select("brand_key", F.col("f.name").alias("brand"), "f.item_id", "sitelinks", "official_domains")


def related_brand_domains(brands: DataFrame, pages: DataFrame) -> DataFrame:
    """(brand_key, domain): domains that a brand's first site names and that carry the brand's name.

    ``brands`` has (brand_key, brand, official_domains), ``pages`` (domain, related: array) of the first sites.
    """
    asked = brands.where(F.size("official_domains") > 0).withColumn("domain", F.col("official_domains")[0])
    met = asked.join(pages, "domain").select("brand_key", "brand", "official_domains", F.col("domain").alias("own"), F.explode("related").alias("named")).where("named is not null and named != ''")
    shared = F.broadcast(pages.sparkSession.createDataFrame([(d,) for d in SHARED_DOMAINS], "shared string"))
    met = met.withColumn("reg", t.registrable_domain(t.normal_domain(F.col("named")))).where("reg != '' and reg != own").where(~F.array_contains("official_domains", F.col("reg")))
    met = met.join(shared, (F.col("named") == F.col("shared")) | (F.col("reg") == F.col("shared")), "left_anti")
    token = identity_key(F.col("brand"))
    label = identity_key(F.split("reg", r"\.")[0])
    return met.where((token != "") & (F.col("reg").contains(token) | label.contains(token))).select("brand_key", F.col("reg").alias("domain")).distinct()


def catalogue_favicons(brands: DataFrame, icons: DataFrame, most: int = 3) -> DataFrame:
    """(brand_key, hashes, attempts, successes) over each brand's first ``most`` domains; ``icons`` has (domain, icon_hash)."""
    first = brands.select("brand_key", F.explode(F.slice("official_domains", 1, most)).alias("domain"))
    return first.join(icons, "domain", "left").groupBy("brand_key").agg(F.array_sort(F.collect_set("icon_hash")).alias("hashes"), F.count("*").alias("attempts"), F.count("icon_hash").alias("successes"))


def with_rank_and_reputation(df: DataFrame, ranks: DataFrame, reputation: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds popularity_rank (null if unlisted), safe_users, bad_events and boost (0 if unknown) of each domain."""
    r = ranks.groupBy(F.col("domain").alias("_d")).agg(F.min("rank").alias("popularity_rank"))
    p = reputation.select(F.col("domain").alias("_p"), "safe_users", "bad_events")
    out = df.join(r, F.col(domain) == F.col("_d"), "left").join(p, F.col(domain) == F.col("_p"), "left").drop("_d", "_p")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("safe_users", "bad_events")})
    return out.withColumn("boost", reputation_boost(F.col("safe_users"), F.col("bad_events")))


def evidence_overview(urls: DataFrame, evidence: DataFrame) -> DataFrame:
    """(url_hash, lines): network evidence of each url as texts, newest first; no list for urls without any.

    ``evidence`` has (url_hash, kind, key_name, value_text, value_hash, created).
    """
    shown = network_evidence(evidence).where("value_text is not null")
    line = F.concat("kind", F.lit(" "), "key_name", F.lit(": "), "value_text")
    lists = shown.groupBy("url_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return urls.select("url_hash").distinct().join(lists, "url_hash", "left")


def learns_identity(risk: Column, official: Column) -> Column:
    """Whether an enriched url may teach a brand: little risk and no official brand domain."""
    return (risk < 45) & ~official


def candidate_tables(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current candidates by (brand_key, primary_domain) and their primary_domain rows, from append-only events with seq and seen_at."""
    key = ["brand_key", "primary_domain"]
    first = candidates.groupBy(*key).agg(F.min("seen_at").alias("first_seen"))
    now = latest(candidates, key).withColumnRenamed("seen_at", "updated_at").join(first, key)
    domains = now.select("brand_key", F.col("primary_domain").alias("domain"), F.lit("primary_domain").alias("relation_type"), "confidence", F.lit("brand_detector").alias("source"), "first_seen", "updated_at")
    return now, domains


def relationship_table(events: DataFrame) -> DataFrame:
    """Current relationships by (source_domain, related_domain, relation_type), with the time each was first seen."""
    key = ["source_domain", "related_domain", "relation_type"]
    first = events.groupBy(*key).agg(F.min("seen_at").alias("first_seen"))
    return latest(events, key).withColumnRenamed("seen_at", "updated_at").join(first, key)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the number of rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def latest_rows(df: DataFrame, n: int = 20, order: str = "updated_at") -> DataFrame:
    """The n newest rows, ties by all columns in their order: a listing."""
    return df.orderBy(F.desc(order), *[c for c in df.columns if c != order]).limit(n)


def stage_times(timings: DataFrame) -> DataFrame:
    """(urls, dns_ms, whois_ms, http_ms): mean times of each stage per url, over landed timings in milliseconds."""
    return timings.agg(F.count("*").alias("urls"), *[F.avg(c).alias(c) for c in ("dns_ms", "whois_ms", "http_ms")])


def memory_tables(events: DataFrame, similar: DataFrame) -> dict[str, DataFrame]:
    """The four tables of the message memory from append-only events with tags and url_hashes: current messages, and distinct
    tags, urls and edges (message_hash, other_hash, distance)."""
    from .memory import unsafe_state

    return {
        "messages": unsafe_state(events), "tags": events.select("message_hash", F.explode("tags").alias("tag")).distinct(),
        "urls": events.select("message_hash", F.explode("url_hashes").alias("url_hash")).distinct(), "similarity": similar.groupBy("message_hash", "other_hash").agg(F.min("distance").alias("distance")),
    }


def write_results(scored: DataFrame, path: str) -> None:
    """Scored messages as lines of JSON, nulls written."""
    scored.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_catalogue(brands: DataFrame, path: str, most: int = 10_000) -> None:
    """The catalogue as documents of brand to domains, each of about ``most`` brands."""
    part = F.pmod(F.xxhash64("brand"), F.lit(max(1, brands.count() // most)))
    body = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("brand", "official_domains")))))
    brands.groupBy("brand").agg(F.max("official_domains").alias("official_domains")).groupBy(part.alias("part")).agg(body.alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def append_new(rows: DataFrame, path: str, key: str = "id") -> None:
    """Append the rows whose id the JSON lines at ``path`` do not hold yet; a first run starts the file."""
    from .state import resume

    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        rows = resume(rows, spark.read.schema(f"{key} string").json(path), key)
    rows.write.mode("append").json(path)
