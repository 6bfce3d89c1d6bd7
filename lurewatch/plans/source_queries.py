"""Queries that land derived rows as files of each source format and read them back."""

from __future__ import annotations

import io
import itertools
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, run, with_fixtures
from ..operators import brands as b
from ..operators import datasets as ds
from ..operators import memory as mem
from ..operators import threats as th
from ..registry import query
from ..sources import archives, feeds, versions
from ..streaming.jobs import safe_votes
from ..tables import numbered, shared_dir

ROWS_PER_FILE = 500


def _path(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/landed-{name}-{uuid.uuid4().hex}"


def land_lines(lines: DataFrame, name: str) -> str:
    """Lines as text files."""
    path = _path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def land_documents(items: DataFrame, name: str, head: str, between: str, tail: str) -> str:
    """Items (one text column) as files of a bounded number of items, each file one document; only the last may hold fewer."""
    path = _path(items.sparkSession, name)
    n = items.count()
    part = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n // ROWS_PER_FILE))))
    docs = items.groupBy(part.alias("part")).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("item")), between), F.lit(tail)).alias("value"))
    docs.write.partitionBy("part").text(path)
    return path


def land_files(rows: DataFrame, name: str) -> str:
    """(file, member, content) as files: members of one .zip or .tar.gz file, which a task writes, or files of their own."""
    path = _path(rows.sparkSession, name)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = archives.store(path)
        where.create_dir(folder, recursive=True)
        each = ((r["file"], r["member"], r["content"].encode()) for b in batches for r in b.to_pylist())
        for file, group in itertools.groupby(each, key=lambda r: r[0]):
            where.create_dir(f"{folder}/{file}".rpartition("/")[0], recursive=True)
            with where.open_output_stream(f"{folder}/{file}", compression=None) as out:
                if file.endswith(".zip"):
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                        for _, member, content in group:
                            z.writestr(member, content)
                elif file.endswith(".tar.gz"):
                    with tarfile.open(fileobj=out, mode="w|gz") as t:
                        for _, member, content in group:
                            info = tarfile.TarInfo(member)
                            info.size = len(content)
                            t.addfile(info, io.BytesIO(content))
                else:
                    for _, _, content in group:
                        out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

    rows.repartition("file").sortWithinPartitions("file", "member").mapInArrow(pack, "file string").write.format("noop").mode("overwrite").save()
    return path


def _indicators(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, "fx_indicators").withColumn("k", F.monotonically_increasing_id())


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("item")


#: Format, rows of the fixture that it can say, how they are written, and what comes back as SQL: kind, ref, first, last, confidence, tag.
_SAYS = {
    "urlhaus_json": ("indicator_type = 'url'", ("'url'", "NULL", "first_seen", "NULL", "NULL", "tag")), "phishunt": ("indicator_type = 'url'", ("'url'", "NULL", "first_seen", "NULL", "NULL", "source")),
    "string_array": ("true", ("'url'", "NULL", "NULL", "NULL", "NULL", "''")), "tweetfeed": ("true", ("indicator_type", "NULL", "first_seen", "NULL", "NULL", "tag")),
    "misp": ("true", ("indicator_type", "NULL", "NULL", "NULL", "confidence", "''")), "hosts": ("indicator_type = 'domain'", ("'domain'", "NULL", "NULL", "NULL", "NULL", "''")),
    "plain": ("true", ("'url'", "NULL", "NULL", "NULL", "NULL", "''")), "viriback_csv": ("indicator_type = 'url'", ("'url'", "NULL", "first_seen", "NULL", "NULL", "tag")),
    "adguard": ("indicator_type = 'domain'", ("'domain'", "NULL", "NULL", "NULL", "NULL", "''")), "phishtank_gz": ("indicator_type = 'url'", ("'url'", "NULL", "first_seen", "NULL", "NULL", "source")),
    "block_fuzzy": ("indicator_type = 'domain'", ("'domain'", "NULL", "NULL", "NULL", "NULL", "'blacklist'")), "detected_urls": ("indicator_type = 'domain'", ("'domain'", "NULL", "NULL", "NULL", "NULL", "''")),
}


def land_feed(df: DataFrame, kind: str) -> str:
    """The indicator rows as landed files of one feed format."""
    c = F.col
    quoted = F.to_json(F.array("value"))
    if kind == "urlhaus_json":
        one = F.to_json(F.array(F.struct(c("value").alias("url"), c("first_seen").alias("dateadded"), F.array("tag").alias("tags"))))
        return land_documents(df.select(F.concat(F.lit('"'), c("k").cast("string"), F.lit('":'), one).alias("item")), kind, "{", ",", "}")
    if kind == "string_array":
        return land_documents(df.select(F.concat(F.regexp_extract(quoted, r"^\[(.*)\]$", 1), F.concat(F.lit(" "), F.repeat(F.lit(" "), (c("k") % 3).cast("int")))).alias("item")), kind, "[", ",", "]")
    if kind in ("block_fuzzy", "detected_urls"):
        head, tail = ('{"blacklist":[', '],"fuzzylist":[]}') if kind == "block_fuzzy" else ('{"detected_urls":[', "]}")
        return land_documents(df.select(F.regexp_extract(quoted, r"^\[(.*)\]$", 1).alias("item")), kind, head, ",", tail)
    if kind == "misp":
        kinds = F.when(c("indicator_type") == "url", "url").otherwise("domain")
        item = _json(kinds.alias("type"), "value", F.concat(F.lit("seen; confidence level: "), c("confidence").cast("string"), F.lit("%")).alias("comment"), c("k"))
        return land_documents(df.select(item), kind, '{"Event":{"Attribute":[', ",", "]}}")
    if kind == "viriback_csv":
        path = _path(df.sparkSession, kind)
        df.select(c("tag").alias("Family"), c("value").alias("URL"), F.lit("1.1.1.1").alias("IP"), c("first_seen").alias("FirstSeen")).write.option("header", True).csv(path)
        return path
    lines = {"hosts": F.concat(F.lit("0.0.0.0 "), "value"), "plain": c("value"), "adguard": F.concat(F.lit("||"), "value", F.lit("^"))}
    if kind in lines:
        noise = df.sparkSession.createDataFrame([("# comment",), ("! note",), ("",)], "value string")
        return land_lines(df.select(lines[kind].alias("value")).unionByName(noise), kind)
    items = {
        "phishunt": _json(c("value").alias("url"), c("first_seen").alias("date"), c("source").alias("company"), "k"), "tweetfeed": _json(c("indicator_type").alias("type"), "value", c("first_seen").alias("date"), F.array("tag").alias("tags"), "k"),
        "phishtank_gz": _json(c("value").alias("url"), c("first_seen").alias("submission_time"), c("source").alias("target"), "k"),
    }
    return land_documents(df.select(items[kind]), kind, "[", ",", "]")


def _feed_query(kind: str, number: str) -> None:
    where, (typ, ref, first, last, confidence, tag) = _SAYS[kind]
    sql = f"SELECT value, {typ} AS indicator_type, 'phishing' AS threat_type, '{kind}' AS source, CAST({ref} AS VARCHAR) AS source_ref, CAST({first} AS VARCHAR) AS first_seen, CAST({last} AS VARCHAR) AS last_seen, CAST({confidence} AS INT) AS confidence, {tag} AS tag FROM fx_indicators WHERE {where}"

    @query(f"{number}_{kind}", with_fixtures(sql, "fx_indicators"))
    def _(s: SparkSession, d: str, kind: str = kind, where: str = where) -> DataFrame:
        return feeds.read_feed(s, land_feed(_indicators(s, d).where(where), kind), kind, kind)


for _kind, _number in (("urlhaus_json", "s1"), ("phishunt", "s3"), ("string_array", "s4"), ("block_fuzzy", "s5"), ("tweetfeed", "s6"), ("detected_urls", "s7"), ("phishtank_gz", "s8"), ("misp", "s9"), ("hosts", "s12"), ("plain", "s13"), ("viriback_csv", "s15"), ("adguard", "s16")):
    _feed_query(_kind, _number)


def _packed(s: SparkSession, d: str, kind: str) -> DataFrame:
    """The url indicators as members of three archives, two members each: JSON documents for zip, lines for tar.gz."""
    rows = _indicators(s, d).where("indicator_type = 'url'")
    item = F.to_json(F.array(F.struct(F.col("value").alias("url"), F.col("first_seen").alias("dateadded"), F.array("tag").alias("tags")))) if kind == "zip" else F.col("value")
    item = F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('": '), item) if kind == "zip" else item
    place = [F.concat((F.col("k") % 3).cast("string"), F.lit(f".{kind}")).alias("file"), F.concat(F.lit("d/m"), (F.col("k") % 2).cast("string")).alias("member")]
    body = F.array_sort(F.collect_list(item))
    content = F.concat(F.lit("{"), F.array_join(body, ",\n"), F.lit("}")) if kind == "zip" else F.concat(F.lit("# head\n\n"), F.array_join(body, "\r\n"))
    return rows.groupBy(*place).agg(content.alias("content"))


_URLS = "SELECT value, 'url' AS indicator_type, 'phishing' AS threat_type, 'packed' AS source, {0} AS first_seen, {1} AS tag FROM fx_indicators WHERE indicator_type = 'url'"
_SHAPE = ("value", "indicator_type", "threat_type", "source", "first_seen", "tag")


@query("s2_urlhaus_zip", with_fixtures(_URLS.format("first_seen", "tag"), "fx_indicators"))
def _(s, d):
    return feeds.read_feed(s, land_files(_packed(s, d, "zip"), "zip"), "urlhaus_zip", "packed").select(*_SHAPE)


@query("s14_targz", with_fixtures(_URLS.format("NULL", "''"), "fx_indicators"))
def _(s, d):
    return feeds.read_feed(s, land_files(_packed(s, d, "tar.gz"), "targz"), "targz", "packed").select(*_SHAPE)


#: Twelve event files, of which a listing names some: one twice, one that is missing, and more than its rule reads.
_LISTED = {"misp_dir": [3, 1, 99, 1, 4, 5, 0, 7, 8], "misp_manifest": [*range(9), 99, 2, *range(20, 60), 11, 10]}


def _listing(kind: str) -> str:
    if kind == "misp_dir":
        return "".join(f"<a href={q}e{n}.json{q}>e</a><a href='other.txt'></a>\n" for n, q in zip(_LISTED[kind], '"\'' * 9, strict=False))
    return "[" + ", ".join(f'{{"uuid": "e{n}", "id": 7}}' if n % 2 else f'{{"id": "e{n}"}}' for n in _LISTED[kind]) + "]"


def _listed_query(kind: str, number: str) -> None:
    times = f"(VALUES {', '.join(f'({n})' for n in _LISTED[kind][: feeds.MOST_LISTED[kind]])}) AS t(n)"
    sql = f"SELECT value, indicator_type, confidence FROM fx_indicators JOIN {times} ON n = length(value) % 12"

    @query(f"{number}_{kind}", with_fixtures(sql, "fx_indicators"))
    def _(s: SparkSession, d: str, kind: str = kind) -> DataFrame:
        typ = F.when(F.col("indicator_type") == "url", "url").otherwise("domain")
        item = F.struct(typ.alias("type"), "value", F.concat(F.lit("confidence level: "), F.col("confidence").cast("string"), F.lit("%")).alias("comment"))
        name = F.concat(F.lit("e"), (F.length("value") % 12).cast("string"), F.lit(".json"))
        events = fixture(s, d, "fx_indicators").groupBy(name.alias("file")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("Attribute")).alias("Event"))).alias("content"))
        folder = land_files(events.withColumn("member", F.lit("")), kind)
        listing = land_files(s.createDataFrame([("listing", "", _listing(kind))], "file string, member string, content string"), f"{kind}-list")
        return feeds.read_listed(s, listing, folder, kind, kind).select("value", "indicator_type", "confidence")


_listed_query("misp_dir", "s10")
_listed_query("misp_manifest", "s11")


_KNOWN = f"feeds(source, format, threat_type, default_type, enabled) AS (VALUES {', '.join('(' + ', '.join([repr(n), repr(f), repr(kinds), repr(k), str(on).lower()]) + ')' for n, _, f, kinds, k, on in feeds.FEEDS)})"


@query("s17_feed_registry", with_fixtures(f"WITH {_KNOWN} SELECT source, format, default_type, enabled, (SELECT count(*) FROM fx_indicators i WHERE list_contains(string_split(f.threat_type, ','), i.threat_type)) AS indicators FROM feeds f", "fx_indicators"))
def _(s, d):
    counted = fixture(s, d, "fx_indicators").groupBy("threat_type").agg(F.count("*").alias("n"))
    each = feeds.feed_registry(s).withColumn("threat_type", F.explode(F.split("threat_type", ","))).join(counted, "threat_type", "left")
    return each.groupBy("source", "format", "default_type", "enabled").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("indicators"))


_RANKS = "SELECT CASE WHEN page_id % 7 = 3 THEN 'x' ELSE CAST(page_id + 1 AS STRING) END AS r, CASE WHEN page_id % 11 = 5 THEN '' ELSE concat(' Site', CAST(page_id AS STRING), '.Example ') END AS domain FROM pages"


@query("s18_rank_list", f"SELECT CAST(r AS INT) AS rank, lower(trim(domain)) AS domain FROM ({_RANKS}) WHERE r <> 'x' AND domain <> '' ORDER BY 1 LIMIT 100")
def _(s, d):
    path = _path(s, "ranks")
    run(s, d, _RANKS).write.csv(path)
    return feeds.read_rank_list(s, path, 100)


_CASES = "SELECT concat('c', lpad(CAST(event_id AS STRING), 12, '0')) AS id, event_id % 3 = 0 AS expected_unsafe, CASE WHEN event_id % 5 > 0 THEN concat('message ', event_type) END AS message FROM events"


@query("s23_w11_cases", f"SELECT id, expected_unsafe, message FROM ({_CASES}) WHERE message IS NOT NULL ORDER BY id LIMIT 300 OFFSET 20")
def _(s, d):
    rows = run(s, d, _CASES)
    lines = rows.where("message IS NOT NULL").select("id", F.to_json(F.struct("id", "expected_unsafe", "message")).alias("value"))
    noise = s.createDataFrame([("", "# comment"), ("c1", ""), ("d", "# end")], "id string, value string")
    ordered = lines.unionByName(noise).repartitionByRange(4, "id").sortWithinPartitions("id")
    return feeds.read_cases(s, land_lines(ordered.select("value"), "cases"), 20, 300)


_ASKED = "SELECT doc_id, quality * 60 AS a, toxic * 45 AS b, CASE WHEN doc_id % 4 > 0 THEN doc_id % 2 = 0 END AS expected_unsafe FROM labels"


@query("f5_label_agreement", f"SELECT * FROM ({_ASKED}) WHERE expected_unsafe IS NULL OR (greatest(a, b) >= 50) = expected_unsafe")
def _(s, d):
    return ds.label_agrees(run(s, d, _ASKED), ["a", "b"])


@query("f7_due_feeds", with_fixtures("WITH st AS (SELECT source, max(length(value)) * 60 AS updated_at FROM fx_indicators GROUP BY source), r(source, interval_minutes) AS (VALUES ('feed_u', 5), ('feed_d', 40), ('feed_m', 600), ('never', 60)) SELECT r.source FROM r LEFT JOIN st USING (source) WHERE updated_at IS NULL OR 4200 - updated_at >= greatest(interval_minutes, 30) * 60", "fx_indicators"))
def _(s, d):
    state = fixture(s, d, "fx_indicators").groupBy("source").agg((F.max(F.length("value")) * 60).alias("updated_at"))
    asked = s.createDataFrame([("feed_u", 5), ("feed_d", 40), ("feed_m", 600), ("never", 60)], "source string, interval_minutes int")
    return th.due_feeds(asked, state, 4200)


_UNSAFE = "SELECT seq, sha256(url) AS message_hash, length(url) AS simhash, risk, verdict AS decision, CASE WHEN tag_no > 2 THEN CAST(user_id AS STRING) END AS user_id, CASE WHEN tag_no < 2 THEN url END AS raw, seen_at FROM fx_url_events"


@query("g6_unsafe_state", with_fixtures(f"SELECT message_hash, any_value(simhash) AS simhash, count(*) AS seen_count, min(seen_at) AS first_seen, max(seen_at) AS last_seen, arg_max(risk, seq) AS risk, arg_max(decision, seq) AS decision, arg_max(user_id, seq) AS user_id, arg_max(raw, seq) AS raw FROM ({_UNSAFE}) GROUP BY message_hash", "fx_url_events"))
def _(s, d):
    return mem.unsafe_state(run(s, d, _UNSAFE.replace("sha256(url)", "sha2(url, 256)"), fx_url_events=fixture(s, d, "fx_url_events")))


_TAGGED = "SELECT value AS indicator, tag, source FROM fx_indicators WHERE tag <> ''"


@query("k1_replace_sources", with_fixtures(f"""WITH t AS (SELECT 'threats' AS tbl, value AS indicator, '' AS tag, source FROM fx_indicators UNION SELECT 'tags', indicator, tag, source FROM ({_TAGGED}))
SELECT * FROM t WHERE source = 'feed_m' UNION ALL SELECT tbl, concat('new.', indicator), tag, 'feed_d' FROM t WHERE source = 'feed_u'""", "fx_indicators"))
def _(s, d):
    root = _path(s, "threats")
    rows = fixture(s, d, "fx_indicators").select(F.col("value").alias("indicator"), "tag", "source")
    both = lambda df: {"threats": df.select("indicator", "source").distinct(), "tags": df.where("tag != ''").distinct()}
    versions.replace(s, root, both(rows), ["feed_u", "feed_d", "feed_m"])
    new = rows.where("source = 'feed_u'").select(F.concat(F.lit("new."), "indicator").alias("indicator"), "tag", F.lit("feed_d").alias("source"))
    versions.replace(s, root, both(new), ["feed_d", "feed_u"])
    versions.vacuum(s, root)
    parts = [versions.read(s, root, t, "indicator string, tag string, source string" if t == "tags" else "indicator string, source string").withColumn("tbl", F.lit(t)) for t in ("threats", "tags")]
    return parts[0].withColumn("tag", F.lit("")).unionByName(parts[1]).select("tbl", "indicator", "tag", "source")


_UNION = " UNION ALL ".join(f"SELECT value, {_SAYS[k][1][0]} AS indicator_type, {_SAYS[k][1][5]} AS tag, '{k}' AS source FROM fx_indicators WHERE {_SAYS[k][0]}" for k in ("hosts", "plain", "tweetfeed"))


@query("u1_all_feeds", with_fixtures(_UNION, "fx_indicators"))
def _(s, d):
    rows = _indicators(s, d)
    landed = [(k, k, "phishing", "url", land_feed(rows.where(_SAYS[k][0]), k)) for k in ("hosts", "plain", "tweetfeed")]
    return feeds.read_all_feeds(s, landed).select("value", "indicator_type", "tag", "source")


_NEW = "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain FROM pages"


@query("u2_learned_brands", f"WITH n AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS ord FROM ({_NEW})) SELECT concat('New ', domain) AS brand, CAST({len(b.DEFAULT_BRANDS)} + ord AS INT) AS brand_ord FROM n UNION ALL SELECT brand, brand_ord FROM (VALUES {', '.join(f'({i}, {n!r})' for i, (n, _) in enumerate(b.DEFAULT_BRANDS))}) AS v(brand_ord, brand)")
def _(s, d):
    domains = numbered(run(s, d, _NEW), "domain", name="ord")
    learned = domains.select(F.concat(F.lit("New "), "domain").alias("brand"), F.array("domain").alias("official_domains"), "ord")
    return b.with_learned(b.default_brands(s), learned).select("brand", F.col("brand_ord").cast("int").alias("brand_ord"))


@query("t2_safe_votes", with_fixtures("SELECT domain, count(DISTINCT user_id) AS safe_users FROM (SELECT user_id, regexp_extract(url, '([^./]+\\.[^./]+)(/|$)', 1) AS domain FROM fx_url_events WHERE verdict = 'good' AND user_id IS NOT NULL) GROUP BY domain", "fx_url_events"))
def _(s, d):
    events = fixture(s, d, "fx_url_events").withColumn("user_id", F.col("user_id").cast("string")).withColumn("kind", F.when(F.col("verdict") == "good", "safe"))
    return safe_votes(events)

