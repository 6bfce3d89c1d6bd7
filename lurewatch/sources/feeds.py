"""Readers of landed threat feeds. Every one yields (value, indicator_type, threat_type, source, source_ref, first_seen, last_seen, confidence, tag):
one row per tag, with an empty tag where there is none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..tables import numbered
from .archives import read_archive

# MISP attribute types that are indicators.
MISP_TYPES = {"url": "url", "domain": "domain", "ip-dst": "ip", "ip-src": "ip"}


def _shaped(df: DataFrame, source: str, threat: str, value: Column, kind: Column | str, ref: Column | None = None, first: Column | None = None, last: Column | None = None, confidence: Column | None = None, tags: Column | None = None) -> DataFrame:
    null = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    each = F.lit("") if tags is None else F.explode_outer(F.filter(tags, lambda x: x.isNotNull() & (x != "")))
    out = df.select(value.alias("value"), kind.alias("indicator_type"), F.lit(threat).alias("threat_type"), F.lit(source).alias("source"), null(ref).alias("source_ref"), null(first).alias("first_seen"), null(last).alias("last_seen"), (F.lit(None) if confidence is None else confidence).cast("int").alias("confidence"), each.alias("tag"))
    return out.where("value is not null and trim(value) != ''").withColumn("tag", F.coalesce("tag", F.lit("")))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"))


_HAUS = "struct<url:string,dateadded:string,last_online:string,urlhaus_link:string,tags:array<string>>"


def _urlhaus(lists: DataFrame, source: str, threat: str) -> DataFrame:
    """Rows of lists of entries (column l)."""
    e = lists.select(F.explode("l").alias("e")).select("e.*")
    return _shaped(e, source, threat, F.col("url"), "url", F.col("urlhaus_link"), F.col("dateadded"), F.col("last_online"), None, F.col("tags"))


def _plain(lines: DataFrame, source: str, threat: str, kind: str) -> DataFrame:
    kept = lines.where("line != '' and not startswith(line, '#') and not startswith(line, '!')")
    return _shaped(kept, source, threat, F.col("line"), kind)


_EVENT = "Event struct<Attribute:array<struct<type:string,value:string,comment:string,timestamp:string>>>"


def _misp(events: DataFrame, source: str, threat: str) -> DataFrame:
    a = events.select(F.explode("Event.Attribute").alias("a")).select("a.*").where(F.col("type").isin(*MISP_TYPES))
    names = F.create_map(*[F.lit(x) for kv in MISP_TYPES.items() for x in kv])
    level = F.expr("try_cast(nullif(regexp_extract(comment, 'confidence level: *([0-9]+)%', 1), '') as int)")
    return _shaped(a, source, threat, F.col("value"), names[F.col("type")], None, F.col("timestamp"), None, level)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_feed(spark: SparkSession, path: str, kind: str, source: str, threat: str = "phishing", default_type: str = "url", most: int | None = None) -> DataFrame:
    """Rows of one landed feed of the named format."""
    c = F.col
    if kind == "urlhaus_json":
        return _urlhaus(_whole(spark, path).select(F.explode(F.map_values(F.from_json("value", f"map<string,array<{_HAUS}>>"))).alias("l")), source, threat)
    if kind == "urlhaus_zip":
        return _urlhaus(read_archive(spark, path, "entries").select(F.from_json("value", f"array<{_HAUS}>").alias("l")), source, threat)
    if kind == "phishunt":
        df = _json(spark, path, "url string, date string, company string, country string, asn string")
        return _shaped(df, source, threat, c("url"), "url", None, c("date"), None, None, F.array("company", "country", "asn"))
    if kind == "string_array":
        return _shaped(_whole(spark, path).select(F.explode(F.from_json("value", "array<string>")).alias("v")), source, threat, c("v"), default_type)
    if kind == "block_fuzzy":
        lists = _whole(spark, path).select(F.from_json("value", "blacklist array<string>, fuzzylist array<string>").alias("j"))
        parts = [lists.select(F.explode(f"j.{n}").alias("v"), F.lit(n).alias("list")) for n in ("blacklist", "fuzzylist")]
        return _shaped(parts[0].unionByName(parts[1]), source, threat, c("v"), "domain", tags=F.array("list"))
    if kind == "tweetfeed":
        df = _json(spark, path, "type string, value string, date string, tweet string, tags array<string>")
        df = df.withColumn("type", F.coalesce("type", F.lit(default_type))).where(c("type").isin("url", "domain", "ip"))
        return _shaped(df, source, threat, c("value"), c("type"), c("tweet"), c("date"), None, None, c("tags"))
    if kind == "detected_urls":
        df = _whole(spark, path).select(F.explode(F.from_json("value", "detected_urls array<string>").getField("detected_urls")).alias("v"))
        return _shaped(df, source, threat, c("v"), "domain")
    if kind == "phishtank_gz":
        df = _json(spark, path, "url string, phish_detail_url string, submission_time string, verification_time string, target string")
        return _shaped(df, source, threat, c("url"), "url", c("phish_detail_url"), c("submission_time"), c("verification_time"), None, F.array("target"))
    if kind in ("misp", "misp_dir", "misp_manifest"):
        return _misp(_json(spark, path, _EVENT), source, threat)
    if kind == "hosts":
        df = _lines(spark, path).select(F.regexp_extract("line", r"^(?:0\.0\.0\.0|127\.0\.0\.1) +(\S+)", 1).alias("v"))
        return _shaped(df, source, threat, c("v"), "domain")
    if kind == "plain":
        return _plain(_lines(spark, path), source, threat, default_type)
    if kind == "targz":
        return _plain(read_archive(spark, path).select(F.trim("value").alias("line")), source, threat, default_type)
    if kind == "viriback_csv":
        df = spark.read.option("header", True).csv(path)
        a, b, d = df.columns[0], df.columns[1], df.columns[3]
        return _shaped(df, source, threat, c(f"`{b}`"), "url", None, c(f"`{d}`"), None, None, F.array(F.col(f"`{a}`")))
    if kind == "adguard":
        df = _lines(spark, path).where(c("line").rlike(r"^\|\|[^\^/]+\^")).select(F.regexp_extract("line", r"^\|\|([^\^/]+)\^", 1).alias("v"))
        return _shaped(df, source, threat, c("v"), "domain")
    raise ValueError(f"unknown feed format {kind!r}")


#: How many links of an index page, or entries of a manifest, are read.
MOST_LISTED = {"misp_dir": 7, "misp_manifest": 50}


def manifest_names(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(at, name) of the event files that an index page (its .json links) or a manifest (entries with a uuid, or else an id) lists.

    Only the first MOST_LISTED links or entries count, one that is listed twice twice.
    """
    text = _whole(spark, path)
    if kind == "misp_dir":
        listed = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"""href=["']([^"']+\.json)["']"""), 1)).alias("at", "name"))
    else:
        entry = text.where("startswith(trim(value), '[')").select(F.posexplode(F.from_json("value", "array<variant>")).alias("at", "e"))
        chosen = entry.select("at", F.coalesce(F.try_variant_get("e", "$.uuid", "variant"), F.try_variant_get("e", "$.id", "variant")).alias("id"))
        listed = chosen.where(F.schema_of_variant("id") == "STRING").select("at", F.concat(F.variant_get("id", "$", "string"), F.lit(".json")).alias("name"))
    return listed.where(F.col("at") < MOST_LISTED[kind])


def read_listed(spark: SparkSession, listing: str, folder: str, kind: str, source: str, threat: str = "phishing") -> DataFrame:
    """Rows of the landed event files in ``folder`` that the landed listing names; no other file is opened, missing ones are left out.

    A listing names a few files by its rule, so their names go through the driver; files listed twice are read twice. Links are
    names below ``folder``; the last part of a link to another place is looked up there.
    """
    names = [r.name.rpartition("/")[2] if r.name.startswith("http") else r.name for r in manifest_names(spark, listing, kind).orderBy("at").collect()]
    there = [f"{folder}/{n}" for n in names if files.exists(spark, f"{folder}/{n}")]
    rounds = [[p for i, p in enumerate(there) if there[:i].count(p) == k] for k in range(max(map(there.count, there), default=0))]
    parts = [_misp(spark.read.schema(_EVENT).option("multiLine", True).option("mode", "FAILFAST").json(paths), source, threat) for paths in rounds]
    return reduce(DataFrame.unionByName, parts) if parts else _misp(spark.createDataFrame([], _EVENT), source, threat)


def read_rank_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(rank, domain) of a popularity list; rows without a number or domain go."""
    df = spark.read.csv(path).select(F.expr("try_cast(_c0 as int)").alias("rank"), F.lower(F.trim("_c1")).alias("domain")).where("rank is not null and domain != ''")
    return df if limit is None else df.orderBy("rank").limit(limit)


def read_brand_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(brand_ord, brand, official_domains) of a catalogue of any number of files: maps in key order over all files, then arrays in
    the order of their files and their own."""
    v = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    as_map = v.where("startswith(trim(value), '{')").select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("brand", "official_domains"))
    as_map = as_map.select(F.lit("").alias("file"), F.lit(0).alias("pos"), "brand", "official_domains")
    item = "array<struct<name:string,official_domains:array<string>,domains:array<string>>>"
    as_list = v.where("startswith(trim(value), '[')").select("file", F.posexplode(F.from_json("value", item)).alias("pos", "e"))
    as_list = as_list.select("file", "pos", F.col("e.name").alias("brand"), F.coalesce("e.official_domains", "e.domains").alias("official_domains"))
    clean = lambda d: F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace(F.trim(d), "^https?://", ""), "^[^/]*", 0), r"^(?:www\.)+", ""))
    both = as_map.unionByName(as_list).withColumn("official_domains", F.filter(F.transform("official_domains", clean), lambda d: d != ""))
    return numbered(both, "file", "pos", "brand", name="brand_ord").select(F.col("brand_ord").cast("int").alias("brand_ord"), "brand", "official_domains")


def read_favicon_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(brand, favicon_hash) of a map from brands to 64-digit hashes."""
    return _whole(spark, path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("brand", "l")).select("brand", F.explode("l").alias("favicon_hash")).where("length(favicon_hash) = 64")


def read_cases(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(id, expected_unsafe, message) of JSONL files in the order of their lines, blank and # lines left out.

    ``offset`` lines are skipped and ``limit`` lines are read after them; a line among these that is no JSON, or lacks a field
    or has one of another type, is an error.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = numbered(rows.where("line != '' and not startswith(line, '#')"), "file", "start").where(F.col("nth") >= offset)
    if limit is not None:
        placed = placed.where(F.col("nth") < offset + limit)
    parsed = placed.select("nth", F.try_parse_json("line").alias("v"))

    def field(name: str, kind: str) -> Column:
        part = F.try_variant_get("v", f"$.{name}", "variant")
        fault = F.raise_error(F.concat(F.lit(f"no {name} in case "), F.col("nth").cast("string")))
        return F.when(F.schema_of_variant(part) == kind.upper(), F.try_variant_get(part, "$", kind)).otherwise(fault).alias(name)

    return parsed.select(field("id", "string"), field("expected_unsafe", "boolean"), field("message", "string"))


# The feeds that are known, with their addresses; the last column tells those read by default.
FEEDS = (
    ("urlhaus_online", "https://urlhaus.abuse.ch/downloads/json_online/", "urlhaus_json", "malware_download", "url", True),
    ("phishunt", "https://phishunt.io/feed.json", "phishunt", "phishing", "url", True),
    ("destroylist", "https://raw.githubusercontent.com/phishdestroy/destroylist/main/list.json", "string_array", "phishing,crypto_drainer", "domain", True),
    ("metamask_eth_phishing", "https://raw.githubusercontent.com/MetaMask/eth-phishing-detect/main/src/config.json", "block_fuzzy", "crypto_drainer", "domain", True),
    ("spmedia_crypto", "https://raw.githubusercontent.com/spmedia/Crypto-Scam-and-Crypto-Phishing-Threat-Intel-Feed/refs/heads/main/detected_urls.json", "detected_urls", "crypto_drainer,pig_butchering", "domain", True),
    ("phishtank", "http://data.phishtank.com/data/online-valid.json.gz", "phishtank_gz", "phishing", "url", True),
    ("threatfox_misp", "https://threatfox.abuse.ch/downloads/misp/", "misp_dir", "botnet_cc,malware_download", "domain", True),
    ("curbengh_phishing_filter", "https://malware-filter.gitlab.io/malware-filter/phishing-filter-agh.txt", "adguard", "phishing", "domain", True),
    ("blackbook", "https://raw.githubusercontent.com/stamparm/blackbook/master/blackbook.txt", "plain", "malware_download,botnet_cc", "domain", True),
    ("urlhaus", "https://urlhaus.abuse.ch/downloads/json/", "urlhaus_zip", "malware_download", "url", False),
    ("destroylist_community", "https://raw.githubusercontent.com/phishdestroy/destroylist/main/community/blocklist.json", "string_array", "phishing,crypto_drainer", "domain", False),
    ("tweetfeed_week", "https://api.tweetfeed.live/v1/week", "tweetfeed", "phishing,scam", "domain", False),
    ("infoblox_misp", "https://raw.githubusercontent.com/infobloxopen/threat-intelligence/main/indicators/misp/manifest.json", "misp_manifest", "botnet_cc,phishing,pig_butchering", "domain", False),
    ("blocklistproject_phishing", "https://blocklistproject.github.io/Lists/phishing.txt", "hosts", "phishing", "domain", False),
    ("blocklistproject_malware", "https://blocklistproject.github.io/Lists/malware.txt", "hosts", "malware_download", "domain", False),
    ("blocklistproject_scam", "https://blocklistproject.github.io/Lists/scam.txt", "hosts", "scam", "domain", False),
    ("blocklistproject_fraud", "https://blocklistproject.github.io/Lists/fraud.txt", "hosts", "fraud", "domain", False),
    ("blocklistproject_crypto", "https://blocklistproject.github.io/Lists/crypto.txt", "hosts", "crypto_drainer", "domain", False),
    ("blocklistproject_ransomware", "https://blocklistproject.github.io/Lists/ransomware.txt", "hosts", "ransomware", "domain", False),
    ("phishing_database_links", "https://phish.co.za/latest/ALL-phishing-links.lst", "plain", "phishing", "url", False),
    ("phishing_database_domains", "https://phish.co.za/latest/ALL-phishing-domains.tar.gz", "targz", "phishing", "domain", False),
    ("viriback", "https://tracker.viriback.com/dump.php", "viriback_csv", "botnet_cc", "url", False),
    ("curbengh_urlhaus_filter", "https://malware-filter.gitlab.io/malware-filter/urlhaus-filter-agh.txt", "adguard", "malware_download", "domain", False),
    ("phishing_army", "https://phishing.army/download/phishing_army_blocklist.txt", "plain", "phishing", "domain", False),
    ("phishing_army_extended", "https://phishing.army/download/phishing_army_blocklist_extended.txt", "plain", "phishing", "domain", False),
    ("circl_osint_misp", "https://www.circl.lu/doc/misp/feed-osint/", "misp_dir", "threat_intel", "domain", False),
)


def feed_registry(spark: SparkSession, feeds: list[tuple[str, str, str, str, str, bool]] | None = None) -> DataFrame:
    """(source, url, format, threat_type, default_type, enabled): the feeds that a deployment reads, or those known."""
    return spark.createDataFrame(list(feeds or FEEDS), "source string, url string, format string, threat_type string, default_type string, enabled boolean")


def read_all_feeds(spark: SparkSession, landed: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Rows of all landed feeds (source, format, threat_type, default_type, path), one after another."""
    return reduce(DataFrame.unionByName, [read_feed(spark, path, kind, source, threat, default) for source, kind, threat, default, path in landed])
