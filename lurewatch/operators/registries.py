"""Landed registry, vulnerability and forge documents: warnings, severity, repository urls and commits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from .pages import parsed_time
from .supply import CVSS, hosting_platform, normal_git_url, truncated_diff

# Severity words with their scores, link names in their order, forges, days that count as new.
SEVERITY_WORDS = {"CRITICAL": ("critical", 9.0), "HIGH": ("high", 7.0), "MEDIUM": ("medium", 5.0), "MODERATE": ("medium", 5.0), "LOW": ("low", 3.0), "NONE": ("none", 0.0)}
DEFAULT_SEVERITY = ("medium", 5.0)
PYPI_LINKS = ("Source", "Source Code", "Repository", "GitHub", "Code")
HEX_LINKS = ("GitHub", "Source", "Source Code", "Repository", "Code")
FORGES = ("github.com", "gitlab.com", "bitbucket.org")
NEW_DAYS = 7
NO_DESCRIPTION = "No description"

VULNERABILITY = "struct<id:string,summary:string,details:string,severity:array<struct<type:string,score:string>>,database_specific:variant>"


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str = "$") -> Column:
    """The string under the path; null for anything else."""
    found = _get(v, path)
    return F.when(F.schema_of_variant(found) == "STRING", _get(v, path, "string"))


def _is_true(v: Column, path: str) -> Column:
    found = _get(v, path)
    return F.coalesce((F.schema_of_variant(found) == "BOOLEAN") & _get(v, path, "boolean"), F.lit(False))


def _first_of(*choices: tuple[Column, Column]) -> Column:
    """The value of the first choice whose condition holds, even where that value is null."""
    out = F
    for cond, value in choices:
        out = out.when(F.coalesce(cond, F.lit(False)), value)
    return out


def read_vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """(ecosystem, name, version, vuln) from landed JSON lines with a list of vulnerabilities for each package."""
    rows = spark.read.schema(f"ecosystem string, name string, version string, vulns array<{VULNERABILITY}>").json(path)
    return rows.select("ecosystem", "name", "version", F.explode("vulns").alias("vuln"))


def read_registry_docs(spark: SparkSession, path: str) -> DataFrame:
    """(ecosystem, name, version, body, page) from landed JSON lines: the registry's answer and, where it has one, a second page."""
    return spark.read.schema("ecosystem string, name string, version string, body string, page string").json(path)


def cvss_score(vector: Column) -> Column:
    """Base score of a CVSS vector; unknown or missing parts weigh 0, the last of repeated parts counts."""
    v = reduce(lambda c, p: F.regexp_replace(c, f"^CVSS:{p}/", ""), (r"3\.1", r"3\.0", r"2\.0"), vector)
    letter = lambda key: F.regexp_extract(v, f"^(?:.*/)?{key}:([^/:])", 1)
    pick = lambda key, own: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CVSS[key].items() for x in kv]), own), F.lit(0.0))
    weight = lambda key: pick(key, letter(key))
    changed = letter("S") == "C"
    iss = 1 - (1 - weight("C")) * (1 - weight("I")) * (1 - weight("A"))
    impact = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.029, F.lit(15))).otherwise(6.42 * iss)))
    needed = F.when(changed, pick("PR", letter("PR(?:_C)?"))).otherwise(pick("PR", letter("PR(?:_U)?")))
    ease = 8.22 * weight("AV") * weight("AC") * needed * weight("UI")
    raw = F.least(F.lit(10.0), F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease))
    return F.when(impact <= 0, 0.0).otherwise(F.floor(raw * 10 + 0.5) / 10)


def severity_level(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("none")


def vulnerability_severity(severity: Column, specific: Column | None = None) -> Column:
    """struct(score, level) of a vulnerability: its first entry with a number or a CVSS vector, else the database's own word
    (where ``specific`` is given), else medium."""
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    one = lambda s: F.when(s["score"].rlike(number), s["score"].try_cast("double")).when(s["type"].isin("CVSS_V3", "CVSS_V2"), cvss_score(s["score"]))
    score = F.get(F.filter(F.transform(severity, one), lambda x: x.isNotNull()), F.lit(0))
    told = F.struct(score.alias("score"), severity_level(score).alias("level"))
    default = F.struct(F.lit(DEFAULT_SEVERITY[1]).alias("score"), F.lit(DEFAULT_SEVERITY[0]).alias("level"))
    if specific is None:
        return F.when(score.isNotNull(), told).otherwise(default)
    words = F.create_map(*[x for k, (level, s) in SEVERITY_WORDS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("score"), F.lit(level).alias("level")))])
    word = F.upper(_text(specific, "$.severity"))
    return F.when(score.isNotNull(), told).when(word.isNotNull(), F.coalesce(F.try_element_at(words, word), default)).otherwise(default)


def vulnerability_summary(summary: Column, details: Column) -> Column:
    """The summary, else the first sentence of the details, at most 200 characters, else a default."""
    first = F.left(t.trimmed(F.split(details, "[.!?]")[0]), F.lit(200))
    return F.when(summary != "", summary).when(details != "", first).otherwise(NO_DESCRIPTION)


def vulnerability_level(severity: Column) -> Column:
    """Warning level of a severity word: critical counts as high, none as medium."""
    s = F.lower(severity)
    return F.when(s.contains("critical") | s.contains("high"), "high").when(s.contains("medium"), "medium").when(s.contains("low"), "low").otherwise("medium")


def vulnerability_findings(packages: DataFrame, vulns: DataFrame) -> DataFrame:
    """(package columns, kind, pos, issue, level) of the packages' vulnerabilities, in order of id; ``vulns`` as the reader gives them."""
    v = F.col("vuln")
    met = packages.join(vulns, ["ecosystem", "name", "version"])
    level = vulnerability_level(vulnerability_severity(v["severity"])["level"])
    return met.select(*packages.columns, F.lit(1).alias("kind"), v["id"].alias("pos"), F.concat(v["id"], F.lit(": "), vulnerability_summary(v["summary"], v["details"])).alias("issue"), level.alias("level"))


def _warnings(name: Column, version: Column, v: Column, asof: Column) -> dict[str, Column]:
    age = lambda text: t.whole_days(parsed_time(text, strict=True), asof)
    say = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    both = (name, "/", version)
    new = lambda text, head, verb, tail=" days ago)": say(age(text) < NEW_DAYS, head, *both, verb, age(text), tail)
    lists = F.size(_get(v, "$.vulnerabilities", "array<variant>"))
    pypi = [
        new(_text(v, "$.upload_time"), "PyPI package ", " is very new (uploaded "), say(lists > 0, "PyPI package ", *both, " has ", lists, " known vulnerabilities"),
        say(_is_true(v, "$.yanked"), "PyPI package ", *both, " has been YANKED from the registry"),
    ]
    own = F.try_element_at(_get(v, "$.versions", "map<string,variant>"), version)
    told = _text(own, "$.deprecated")
    npm = F.when(own.isNull(), F.array(F.concat(F.lit("npm package "), name, F.lit(" version "), version, F.lit(" was not found in the registry")))).otherwise(
        F.array_compact(F.array(new(_text(v, "$.time.published"), "npm package ", " is very new (published "), say(told != "", "npm package ", *both, " is deprecated: ", told)))
    )
    crates = [new(_text(v, "$.crate.updated_at"), "crates.io crate ", " updated very recently ("), say(_is_true(v, "$.version.yanked"), "crates.io version ", *both, " has been YANKED")]
    latest = _text(v, "$.version")
    gems = [
        new(F.coalesce(_text(v, "$.created_at"), F.when(_get(v, "$.created_at").isNull(), _text(v, "$.gem.raw_created_at"))), "RubyGems gem ", " is very new (created "),
        say(latest != version, "RubyGems gem ", *both, " requested but latest is ", latest),
    ]
    versions = _get(v, "$.package.versions", "map<string,variant>")
    chosen = F.coalesce(F.try_element_at(versions, version), F.get(F.map_values(versions), F.lit(0)))
    packagist = F.when(_get(v, "$.package").isNull(), F.array(F.concat(F.lit("Packagist package "), name, F.lit("/"), version, F.lit(" not found in registry")))).otherwise(
        F.array_compact(F.array(say(~F.map_contains_key(versions, version), "Packagist package ", *both, " version not found in registry"), new(_text(chosen, "$.time"), "Packagist package ", " is very new (published ")))
    )
    lists_of = lambda xs: F.array_compact(F.array(*xs))
    return {"pypi": lists_of(pypi), "npm": npm, "crates.io": lists_of(crates), "rubygems": lists_of(gems), "packagist": packagist, "go": lists_of([new(_text(v, "$.Time"), "Go module ", " is very new (published ")])}


#: Names by which registries are asked for warnings; those in the second group are asked only on request.
REGISTRY_NAMES = {"pypi": ("pypi", "pip", "pyproject"), "npm": ("npm", "nodejs", "yarn", "pnpm"), "crates.io": ("crates.io", "crates", "cargo", "rust")}
MORE_REGISTRIES = {"rubygems": ("rubygems",), "packagist": ("packagist",), "go": ("go",)}


def registry_warnings(packages: DataFrame, docs: DataFrame, asof: Column, all_registries: bool = False) -> DataFrame:
    """(package columns, pos, warning): what the registry's document says against each package, in order.

    ``docs`` has (ecosystem, name, version, body); a null version stands for all versions of the name. Packages without a
    document, and documents that are no JSON, give no warnings.
    """
    keyed = docs.select(F.lower("ecosystem").alias("_e"), F.col("name").alias("_n"), F.col("version").alias("_v"), F.try_parse_json("body").alias("_doc")).where("_doc is not null")
    met = packages.join(keyed, (F.lower("ecosystem") == F.col("_e")) & (F.col("name") == F.col("_n")) & (F.col("_v").isNull() | (F.col("version") == F.col("_v"))))
    told = _warnings(F.col("name"), F.col("version"), F.col("_doc"), asof)
    names = REGISTRY_NAMES | (MORE_REGISTRIES if all_registries else {})
    chosen = reduce(lambda acc, k: acc.when(F.col("_e").isin(*names[k]), told[k]), names, F)
    return met.select(*packages.columns, F.posexplode(chosen).alias("pos", "warning"))


def warning_level(warning: Column, deep: bool = False) -> Column:
    """Level of a registry warning by its words; ``deep`` also minds packages some days old."""
    recent = warning.contains("week old") | (warning.contains("days ago") if deep else F.lit(False))
    return F.when(warning.contains("yanked"), "critical").when(recent, "medium").otherwise("safe")


def registry_findings(warnings: DataFrame, deep: bool = False) -> DataFrame:
    rest = [c for c in warnings.columns if c not in ("pos", "warning")]
    return warnings.select(*rest, F.lit(2).alias("kind"), F.format_string("%03d", F.col("pos")).alias("pos"), F.col("warning").alias("issue"), warning_level(F.col("warning"), deep).alias("level"))


def repository_urls(packages: DataFrame, docs: DataFrame) -> DataFrame:
    """(package columns, git_url, platform) of the packages whose registry names a source repository.

    ``docs`` has (ecosystem, name, body, page): page is the second answer of some registries (module page, POM, older API).
    The first link that a registry gives decides: if it is no web address, there is none.
    """
    keyed = docs.groupBy(F.lower("ecosystem").alias("_e"), F.col("name").alias("_n")).agg(F.max("body").alias("_body"), F.max("page").alias("_page"))
    met = packages.join(keyed, (F.lower("ecosystem") == F.col("_e")) & (F.col("name") == F.col("_n")), "left").withColumn("_doc", F.try_parse_json("_body")).withColumn("_old", F.try_parse_json("_page"))
    v, page, name = F.col("_doc"), F.coalesce("_page", F.lit("")), F.col("name")
    norm = normal_git_url

    def links(path: str, keys: tuple[str, ...], filled: bool) -> list[tuple[Column, Column]]:
        table = _get(v, path, "map<string,variant>")
        texts = [_text(F.try_element_at(table, F.lit(k))) for k in keys]
        return [((x != "") if filled else x.isNotNull(), norm(x)) for x in texts]

    home = _text(v, "$.info.home_page")
    origin, source = _text(v, "$.Origin"), F.regexp_extract(page, 'data-source-url="([^"]*)"', 1)
    code, gem_home = _text(v, "$.source_code_uri"), _text(v, "$.homepage_uri")
    packs = _get(v, "$.packages", "map<string,variant>")
    pack = _text(F.coalesce(F.try_element_at(packs, name), F.get(F.map_values(packs), F.lit(0))), "$.repository")
    parts = F.split(name, ":")
    group, artifact = F.when(F.size(parts) >= 2, parts[0]).otherwise(name), F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(name)
    found = F.get(_get(v, "$.response.docs", "array<variant>"), F.lit(0))
    latest = F.coalesce(_text(found, "$.latestVersion"), F.when(_get(found, "$.latestVersion").isNull(), _text(found, "$.v")))
    scm = t.trimmed(F.regexp_extract(page, "(?s)<scm>.*?<url>(.*?)</url>", 1))
    words = F.split(group, r"\.")
    at = F.array_position(words, "github")
    owner = F.get(words, at.cast("int"))
    each = lambda path: lambda x: F.coalesce(_get(x, path, "array<variant>"), F.array().cast("array<variant>"))
    entries = F.transform(F.flatten(F.transform(_get(v, "$.items", "array<variant>"), each("$.items"))), lambda x: _get(x, "$.catalogEntry"))
    nuget = F.get(F.flatten(F.transform(entries, lambda c: F.array_compact(F.array(F.nullif(_text(c, "$.projectUrl"), F.lit("")), _text(c, "$.repository"), _text(c, "$.repository.url"))))), F.lit(0))
    pub = [_text(v, f"$.latest.pubspec.{k}") for k in ("repository", "homepage")]
    hex_any = F.get(F.filter(F.transform(F.map_values(_get(v, "$.meta.links", "map<string,variant>")), lambda x: _text(x)), lambda u: t.contains_any(u, FORGES)), F.lit(0))
    http = lambda u: u.startswith("http")
    by_registry = {
        "crates.io": norm(_text(v, "$.crate.repository")),
        "npm": _first_of(*[(u.isNotNull(), norm(u)) for u in (_text(v, "$.repository.url"), _text(v, "$.repository"))]),
        "pypi": _first_of((http(home), norm(home)), *links("$.info.project_urls", PYPI_LINKS, True)),
        "go": _first_of((origin.startswith("git "), norm(F.substring(origin, F.lit(5), F.length(origin)))), (source.startswith("https://"), norm(source)), (name.startswith("github.com/"), norm(F.concat(F.lit("https://"), F.substring(name, F.lit(12), F.length(name)), F.lit(".git"))))),
        "rubygems": _first_of((code != "", norm(code)), (gem_home.contains("github"), norm(gem_home))),
        "packagist": _first_of((v.isNull(), F.lit(None).cast("string")), *[(u.isNotNull(), norm(u)) for u in (pack, _text(F.col("_old"), "$.package.repository"))]),
        "maven": _first_of((latest.isNotNull() & http(scm), norm(scm)), (found.isNotNull() & (at > 1) & owner.isNotNull(), norm(F.concat(F.lit("https://github.com/"), owner, F.lit("/"), artifact, F.lit(".git"))))),
        "nuget": norm(nuget), "pub": _first_of(*[(http(u), norm(u)) for u in pub]),
        "hex": _first_of(*links("$.meta.links", HEX_LINKS, False), (hex_any.isNotNull(), norm(hex_any))),
    }
    url = reduce(lambda acc, k: acc.when(F.lower("ecosystem") == k, by_registry[k]), by_registry, F)
    out = met.select(*packages.columns, url.alias("git_url")).where("git_url is not null")
    return out.withColumn("platform", hosting_platform(F.col("git_url")))


def owner_repo(url: Column) -> Column:
    """struct(owner, repo) of a repository url: the first two path parts after a forge, or after any host; null without two."""
    u = F.regexp_replace(F.regexp_replace(url, r"(?:\.git)+$", ""), "/+$", "")
    after = [F.when(F.instr(u, f"{f}/") > 0, F.split(F.regexp_extract(u, f"(?s)^.*?{f.replace('.', chr(92) + '.')}/(.*)$", 1), "/")) for f in FORGES]
    after.append(F.when(u.rlike("(?s)://[^/]*/"), F.split(F.regexp_replace(F.regexp_extract(u, "(?s)://[^/]*/(.*)$", 1), "^/+", ""), "/")))
    pair = lambda p: F.when(F.size(p) >= 2, F.struct(p[0].alias("owner"), F.get(p, F.lit(1)).alias("repo")))
    return F.coalesce(*[pair(p) for p in after])


def read_commits(lists: DataFrame, diffs: DataFrame) -> DataFrame:
    """(git_url, pos, hash, author, date, message, diff) from landed commit lists (git_url, platform, body) of four shapes, and
    diffs (git_url, hash, body): plain text, or on GitLab a list of parts. Missing fields are empty; diffs are cut."""
    v = lists.withColumn("_v", F.try_parse_json("body")).withColumn("_items", F.when(F.col("platform") == "bitbucket", _get(F.col("_v"), "$.values", "array<variant>")).otherwise(_get(F.col("_v"), "$", "array<variant>")))
    # outer: an explode would have its list, and so the parsing, evaluated again in a filter
    c = v.select("git_url", "platform", F.posexplode_outer("_items").alias("pos", "c")).where("pos is not null")
    at = lambda path: _text(F.col("c"), path)
    hub = [at(p) for p in ("$.sha", "$.commit.author.name", "$.commit.author.date", "$.commit.message")]
    lab = [at(p) for p in ("$.id", "$.author_name", "$.created_at", "$.message")]
    bucket = [at("$.hash"), F.split(at("$.author.raw"), "<")[0], at("$.date"), at("$.message")]
    of = lambda i: F.coalesce(F.when(F.col("platform") == "github", hub[i]).when(F.col("platform") == "gitlab", lab[i]).when(F.col("platform") == "bitbucket", bucket[i]).otherwise(F.coalesce(hub[i], lab[i])), F.lit(""))
    rows = c.select("git_url", "platform", "pos", *[of(i).alias(n) for i, n in enumerate(("hash", "author", "date", "message"))])
    landed = diffs.groupBy("git_url", "hash").agg(F.max("body").alias("_diff"))
    # only what begins as a list is parsed: a failed attempt at plain text costs more than all else
    parts = _get(F.when(F.col("_diff").rlike(r"^\s*\["), F.try_parse_json("_diff")), "$", "array<variant>")
    listed = F.array_join(F.transform(F.filter(F.transform(parts, lambda d: _text(d, "$.diff")), lambda d: d.isNotNull()), lambda d: F.concat(d, F.lit("\n"))), "")
    whole = F.when((F.col("platform") == "gitlab") | ((F.col("platform") == "self-hosted") & parts.isNotNull()), F.coalesce(listed, F.lit(""))).otherwise(F.coalesce("_diff", F.lit("")))
    return rows.join(landed, ["git_url", "hash"], "left").select("git_url", "pos", "hash", "author", "date", "message", truncated_diff(whole).alias("diff"))
