"""URL filters: longest matching rule, and block decisions spread over redirect equivalence.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; the longest
rule wins. Pages name their aliases by canonical links, meta refreshes and redirect targets; connected components
of these links are one resource. A url without a rule gets its component's decision: allow if some member is allowed
by a rule, else block if some member is blocked, else allow.

A resource is host, path and query; scheme, fragment and a closing slash of the path make no difference. All links of a page count; relative ones are resolved against the page's own url (``<base>`` is not read),
with ``&amp;`` undone. Links of other schemes (mailto, javascript) and mere fragments name no resource.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed, and its links
count only where they are absolute; repeated rows get equal rows; an empty table gives an empty result; a null html has
no links; other columns are not read; very long urls are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL, _HREF = r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH, _TO = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
_ABSOLUTE, _OTHER = "(?s)^[A-Za-z][A-Za-z0-9+.-]*://.*", "(?s)^[A-Za-z][A-Za-z0-9+.-]*:.*"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 2)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _QUERY, 1)


def resource_key(url: Column) -> Column:
    """Host, path without a closing slash, and query: what links point at. Null for a url without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), query_of(url)))


def resolved(target: Column, base: Column) -> Column:
    """The absolute url of a link on the page ``base``; null where it names no other resource."""
    scheme, site = F.regexp_extract(base, "(?s)^(.*?)://", 1), F.regexp_extract(base, "(?s)^.*?://[^/?#]*", 0)
    path = path_of(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^.*/", 0))
    parts = F.regexp_extract_all(F.concat(F.when(target.startswith("/"), "").otherwise(folder), F.regexp_extract(target, "(?s)^[^?#]*", 0)), F.lit("(?s)/[^/]*"), 0)
    place = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when(p == "/..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == "/.", done).otherwise(F.concat(done, F.array(p))),
    )
    relative = F.concat(site, F.array_join(place, ""), F.when(F.element_at(parts, -1).isin("/.", "/.."), "/").otherwise(""), F.regexp_extract(target, r"(?s)\?[^#]*", 0))
    return (
        F.when((target == "") | target.startswith("#"), None).when(target.rlike(_ABSOLUTE), target).when(target.rlike(_OTHER) | (site == ""), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(site, path, target)).otherwise(relative)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): every canonical link and refresh of a page, as an absolute url."""
    linked = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    tags = F.regexp_extract_all("html", F.lit(_TAGS), 0)
    of = lambda kind, where: F.transform(F.filter(tags, lambda x: x.rlike(kind)), lambda x: F.regexp_extract(x, where, 1))
    targets = F.transform(F.concat(of(_CANONICAL, _HREF), of(_REFRESH, _TO)), lambda x: F.regexp_replace(x, "&amp;|&#38;|&#[xX]26;", "&"))
    found = linked.select(F.coalesce("url", F.lit("")).alias("url"), F.explode(targets).alias("raw"))
    return found.select("url", resolved(F.col("raw"), F.col("url")).alias("target")).where("target is not null")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict to (host, path) rows: an equi join on host suffixes, then the longest fitting rule."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"))
    distinct = places.select("host", "path").distinct()
    fitting = distinct.where("host != ''").withColumn("suffix", F.explode(suffixes)).join(r, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    best = fitting.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule_verdict") == "allow", "rule")).alias("best"))
    return places.join(best.select("host", "path", "best.rule", "best.rule_verdict"), ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page. ``redirects`` adds observed (from_url, to_url) pairs."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("target")))
    place = lambda c, to: F.struct(resource_key(F.col(c)).alias("key"), host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path")).alias(to)
    links = materialize(links.select(place("url", "a"), place("target", "b")).where("a.key is not null and b.key is not null and a.key != b.key").distinct(), "links")
    places = pages.select("page_id", place("url", "p")).select("page_id", "p.host", "p.path", "p.key")
    judged = match_rules(places, rules)
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    roots = components(links.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")))
    # a linked resource may be no page itself; its rule counts too
    ends = links.select("a.*").unionByName(links.select("b.*")).distinct()
    votes = match_rules(ends, rules).select("key", "rule_verdict").unionByName(judged.select("key", "rule_verdict")).where("rule_verdict is not null").distinct()
    decided = votes.join(roots, F.col("key") == F.col("node")).groupBy("root").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    spread = roots.join(decided, "root").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("spread"))
    out = judged.join(spread, F.col("key") == F.col("node"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"))
