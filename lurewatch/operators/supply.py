"""Packages: lockfiles, severity, look-alike names, repositories, commit verdicts and levels."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

# File names by format and ecosystem; look-alike letters; severity weights and levels.
LOCKFILES = {
    "Cargo.lock": ("toml", "crates.io"), "package-lock.json": ("package_lock", "npm"), "yarn.lock": ("yarn", "npm"), "pnpm-lock.yaml": ("pnpm", "npm"), "pnpm-lock.yml": ("pnpm", "npm"),
    "poetry.lock": ("toml", "PyPI"), "Pipfile.lock": ("pipfile", "PyPI"), "requirements.txt": ("requirements", "PyPI"), "go.sum": ("go_sum", "Go"), "Gemfile.lock": ("gemfile", "RubyGems"),
    "composer.lock": ("composer", "Packagist"), "pom.xml": ("pom", "Maven"), "maven-lockfile.json": ("maven_json", "Maven"), "gradle.lockfile": ("gradle", "Maven"),
    "packages.lock.json": ("nuget", "NuGet"), "pubspec.lock": ("pubspec", "Pub"), "mix.lock": ("mix", "Hex"),
}
LOOK_ALIKES = {"0": "oO", "1": "liI", "l": "1", "i": "1l", "o": "0", "O": "0", "5": "sS", "s": "5S", "a": "e", "e": "a", "g": "q", "q": "g", "c": "k", "k": "c"}
CVSS = {"AV": {"N": 0.85, "A": 0.62, "P": 0.55, "L": 0.20}, "AC": {"L": 0.77, "H": 0.44}, "PR": {"N": 0.85, "L": 0.62, "H": 0.27}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0}}
LEVELS = ["safe", "low", "medium", "high", "critical"]
OPERATORS = ["~=", ">=", "<=", "!=", "=== ", "> ", "< "]


def file_kind(filename: Column, part: int) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in LOCKFILES.items() for x in (k, v[part])])
    return F.try_element_at(known, F.substring_index(filename, "/", -1))


def lockfile_packages(files: DataFrame) -> DataFrame:
    """(filename, pos, name, version, ecosystem) of every package in (filename, content) rows of the known formats.

    A format is one branch over its own files: a regex per line or block, JSON, or names carried to the version line that
    follows. Quirks of the rules are kept: scoped npm names end at the scope, Maven has the artifact id alone.
    """
    f = with_format(files)
    of = lambda *kinds: f.where(F.col("format").isin(*kinds))
    blocks = of("toml").select("filename", "ecosystem", F.posexplode(F.split("content", TOML_BLOCK)).alias("pos", "b")).where("pos > 0")
    deps = of("pom").select("filename", "ecosystem", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>.*?</dependency>"), 0)).alias("pos", "b"))
    entries = [of(k).select("filename", "ecosystem", "format", F.posexplode(F.from_json("content", schema).getField(field) if field else F.from_json("content", schema)).alias("pos", "e")) for k, schema, field in _JSON_LISTS]
    entries += [of(k).select("filename", "ecosystem", "format", F.posexplode(F.map_entries(F.from_json("content", schema).getField(field) if field else F.from_json("content", schema))).alias("pos", "e")) for k, schema, field in _JSON_MAPS]
    lines = of(*LINE_FORMATS).select("filename", "ecosystem", "format", F.posexplode(F.split("content", "\r?\n")).alias("pos", "raw"))
    return reduce(DataFrame.unionByName, [toml_packages(blocks), pom_packages(deps), *map(json_packages, entries), packages_of_lines(lines, _carry)])


TOML_BLOCK = r"\[\[package\]\]"
LINE_FORMATS = ("requirements", "go_sum", "gemfile", "yarn", "gradle", "package_lock", "pipfile", "pnpm", "pubspec")
#: Format, schema and field of the JSON formats that hold a list, or a map, of packages.
_JSON_LISTS = (("composer", "packages array<struct<name:string,version:string>>", "packages"), ("maven_json", "dependencies array<struct<groupId:string,artifactId:string,version:string>>", "dependencies"))
_JSON_MAPS = (("nuget", "dependencies map<string,struct<resolved:string>>", "dependencies"), ("mix", "map<string,variant>", None))


def with_format(files: DataFrame) -> DataFrame:
    """Files of the known formats, with format and ecosystem by their names."""
    return files.withColumn("format", file_kind(F.col("filename"), 0)).withColumn("ecosystem", file_kind(F.col("filename"), 1)).where("format is not null")


def _keep(df: DataFrame, name: Column, version: Column) -> DataFrame:
    return df.select("filename", F.col("pos").cast("long").alias("pos"), name.alias("name"), version.alias("version"), "ecosystem").where("name != '' and version != ''")


def _carry(df: DataFrame, firsts: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """Adds the last filled value (of ``firsts`` the first one) at the earlier lines of each line's file: a window over the file."""
    w = Window.partitionBy("filename").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({k: (F.first if k in firsts else F.last)(v, True).over(w) for k, v in values.items()})


def toml_first(field: str, block: str = "b") -> Column:
    return F.regexp_extract(block, rf'(?m)^\s*{field}\s*=\s*"([^"]+)"', 1)


def toml_packages(blocks: DataFrame) -> DataFrame:
    return _keep(blocks, toml_first("name"), toml_first("version"))


def pom_packages(deps: DataFrame) -> DataFrame:
    part = lambda tag: F.trim(F.regexp_extract("b", f"(?s)<{tag}>(.*?)</{tag}>", 1))
    return _keep(deps, part("artifactId"), part("version"))


def json_packages(entries: DataFrame) -> DataFrame:
    """Packages of parsed entries (e) of one JSON format, told by their type."""
    fields = entries.schema["e"].dataType.fieldNames()
    if fields == ["name", "version"]:
        return _keep(entries, F.col("e.name"), F.col("e.version"))
    if "artifactId" in fields:
        return _keep(entries, F.concat_ws(":", "e.groupId", "e.artifactId"), F.col("e.version"))
    if entries.schema["e"].dataType["value"].dataType.typeName() == "struct":
        return _keep(entries, F.col("e.key"), F.col("e.value.resolved"))
    text = F.when(F.schema_of_variant("e.value") == "STRING", F.variant_get("e.value", "$", "string"))
    return _keep(entries, F.col("e.key"), F.regexp_extract(text, r'"([^"]*)"[^"]*$', 1))


def packages_of_lines(lines: DataFrame, carry: Callable[..., DataFrame]) -> DataFrame:
    """Packages of the formats that go by lines (filename, ecosystem, format, pos, raw); ``carry`` brings values from earlier lines."""
    f = lines.withColumn("line", F.trim("raw"))
    of = lambda *kinds: f.where(F.col("format").isin(*kinds))
    x = F.regexp_extract

    req = of("requirements").where(r"line != '' and not line rlike '^[#\\-\\\\]'")
    op = F.when(F.col("line").contains("=="), F.lit("=="))
    for o in OPERATORS:
        op = op.when(F.col("line").contains(o), F.lit(o))
    req = req.withColumn("op", op).where("op is not null").withColumn("at", F.instr("line", F.col("op")))
    out = [_keep(req, F.trim(F.expr("left(line, at - 1)")), F.trim(F.expr("substr(line, at + length(op))")))]

    go = of("go_sum").withColumn("p", F.split("line", r"\s+")).where("size(p) >= 3").select("filename", "ecosystem", "pos", F.col("p")[0].alias("n"), F.col("p")[1].alias("v"))
    first = go.groupBy("filename", "ecosystem", "n", "v").agg(F.min("pos").alias("pos"))
    out.append(_keep(first, F.col("n"), F.col("v")))

    gem = carry(of("gemfile"), section=F.when(F.col("raw").rlike("^[A-Z]"), F.col("line")))
    gem = gem.where((F.col("section") == "GEM") & F.col("raw").rlike(r"^ {4}\S"))
    out.append(_keep(gem, x("line", r"^(\S+) \(", 1), x("line", r"\(([^)]+)\)", 1)))

    yarn = of("yarn").select("filename", "ecosystem", "pos", F.trim(x("line", r"^([^@]*)@([^:]*):", 1)).alias("n"), F.trim(x("line", r"^([^@]*)@([^:]*):", 2)).alias("v")).where("n != '' and v != ''")
    yarn = carry(yarn, before=F.struct("n", "v")).where("before is null or before.n != n or before.v != v")
    out.append(_keep(yarn, F.col("n"), F.col("v")))

    gradle = of("gradle").where("line != '' and not startswith(line, '#')")
    out.append(_keep(gradle, x("line", "^(.*):([^:]*)$", 1), x("line", "^(.*):([^:]*)$", 2)))

    # formats whose version follows its name: the newest name line, unless a version came after it
    name = {
        "package_lock": x("line", r'^"node_modules/([^/"]+)[^"]*":\s*\{?$', 1), "pipfile": x("line", r"""^["']([^"']+)["']:\s*\{?$""", 1),
        "pnpm": F.regexp_replace(x("line", "^([^@]+)@", 1), "^/+", ""), "pubspec": F.when(F.col("raw").rlike(r"^ {2}[^ :]+:\s*$"), x("line", "^([^:]+):", 1)).otherwise(""),
    }
    version = {"package_lock": x("line", r'^"version":\s*"?([^",]*)"?,?$', 1), "pipfile": x("line", r'^"version":\s*"(.*?)"?,?$', 1), "pnpm": x("line", r"^version:\s*(.+)$", 1), "pubspec": x("line", r'^version:\s*"?([^"]*)"?$', 1)}
    start = {"package_lock": r'^"packages":', "pipfile": r'^"?default"?:', "pnpm": "^packages:$", "pubspec": "^packages:$"}
    pick = lambda table: reduce(lambda acc, k: F.when(F.col("format") == k, table[k]).otherwise(acc), table, F.lit(""))
    c = of(*name).withColumn("n", pick(name)).withColumn("v", pick(version))
    begins = F.when(F.col("line").rlike("|".join(f"(?:{p})" for p in start.values())), F.col("pos"))
    named, used = F.when(F.col("n") != "", F.col("pos")), F.when(F.col("v") != "", F.col("pos"))
    c = c.select("filename", "ecosystem", "pos", "v", begins.alias("begins"), named.alias("named"), used.alias("used"), F.when(F.col("n") != "", F.col("n")).alias("n"))
    c = c.where("begins is not null or named is not null or used is not null")
    c = carry(c, firsts=("begun_at",), begun_at=F.col("begins"), name_at=F.col("named"), used_at=F.col("used"), carried=F.col("n"))
    # lines up to the first start count for nothing: neither such a name nor, being before the name, such a version
    out.append(_keep(c.where("v != '' and name_at > begun_at and name_at > coalesce(used_at, -1)"), F.col("carried"), F.col("v")))
    return reduce(DataFrame.unionByName, out)


def name_mutations(name: Column) -> Column:
    """Distinct typing mistakes of a name: a letter left out, doubled, swapped or replaced, rn read as m, a dash or
    underscore put in, and, unless scoped, its own lower and upper form."""
    n, at = F.length(name), lambda i, k=1: F.substring(name, i, F.lit(k))
    head, tail = lambda i: F.substring(name, F.lit(1), i - 1), lambda i: F.substring(name, i, n)
    none = F.array().cast("array<string>")
    upto = lambda last, first=1: F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    put_in = lambda s: lambda i: F.concat(head(i), F.lit(s), tail(i))
    alike = F.create_map(*[x for k, v in LOOK_ALIKES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    parts = [
        F.transform(upto(n), lambda i: F.concat(head(i), tail(i + 1))), F.transform(upto(n), lambda i: F.concat(head(i), at(i), tail(i))),
        F.transform(upto(n - 1), lambda i: F.concat(head(i), at(i + 1), at(i), tail(i + 2))),
        F.flatten(F.transform(upto(n), lambda i: F.transform(F.coalesce(F.try_element_at(alike, at(i)), none), lambda r: F.concat(head(i), r, tail(i + 1))))),
        F.transform(F.filter(upto(n - 1), lambda i: at(i, 2) == "rn"), lambda i: F.concat(head(i), F.lit("m"), tail(i + 2))),
        *[F.when(name.contains(s), none).otherwise(F.transform(upto(n, 2), put_in(s))) for s in "-_"],
        F.when(name.startswith("@"), none).otherwise(F.array(F.lower(name), F.upper(name))),
    ]
    return F.filter(F.array_distinct(F.concat(*parts)), lambda m: m != "")


def _near_forms(c: Column) -> Column:
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    once = drop(c)
    return F.array_distinct(F.concat(F.array(c), once, F.flatten(F.transform(once, drop))))


def typosquats(packages: DataFrame, popular: DataFrame, by_ecosystem: bool = True) -> DataFrame:
    """(name, [ecosystem], popular, kind, mutation, distance) for names that are not popular but look like a popular one.

    First by mutations (an equi join in lower case), one row for each mutation that hits, and only where none fits by edit
    distance 1 to 2, met on deletion forms. Names are compared in lower case.
    """
    keys = ["ecosystem"] if by_ecosystem else []
    own = packages.select(F.lower("name").alias("name"), *keys).distinct()
    known = popular.select(F.lower("name").alias("_low"), F.col("name").alias("popular"), *keys).distinct()
    asked = own.join(known.select(F.col("_low").alias("name"), *keys).distinct(), ["name", *keys], "left_anti").where("name != ''")
    mutated = asked.select("name", *keys, F.explode(name_mutations(F.col("name"))).alias("mutation")).withColumn("_low", F.lower("mutation")).join(known, ["_low", *keys])
    by_mutation = mutated.select("name", *keys, "popular", F.lit("mutation").alias("kind"), "mutation", F.lit(None).cast("int").alias("distance"))
    rest = asked.join(by_mutation.select("name", *keys).distinct(), ["name", *keys], "left_anti")
    met = rest.withColumn("form", F.explode(_near_forms(F.col("name")))).join(known.withColumn("form", F.explode(_near_forms(F.col("_low")))), ["form", *keys]).select("name", *keys, "popular", "_low").distinct()
    distance = F.levenshtein("name", "_low")
    by_distance = met.where(distance.between(1, 2)).select("name", *keys, "popular", F.lit("distance").alias("kind"), F.lit(None).cast("string").alias("mutation"), distance.alias("distance"))
    return by_mutation.unionByName(by_distance)


def typosquat_findings(packages: DataFrame, popular: DataFrame) -> DataFrame:
    """(package columns, kind, pos, issue, level) for packages with look-alike names."""
    found = typosquats(packages, popular).withColumnRenamed("name", "_low")
    told = F.when(F.col("kind") == "mutation", F.format_string("Possible typosquat of '%s': '%s'", F.col("popular"), F.col("mutation"))).otherwise(
        F.format_string("Possible typosquat of '%s' (Levenshtein distance %d): '%s'", F.col("popular"), F.col("distance"), F.col("name"))
    )
    met = packages.withColumn("_low", F.lower("name")).join(found, ["_low", "ecosystem"])
    return met.select(*packages.columns, F.lit(3).alias("kind"), F.concat_ws(" ", "popular", "mutation").alias("pos"), told.alias("issue"), F.lit("high").alias("level"))


def normal_git_url(url: Column) -> Column:
    """A repository's web address: git+ and .git dropped, git@ and git:// made https; null where that gives none."""
    u = F.regexp_replace(url, r"^git\+", "")
    u = F.regexp_replace(u, r"(?s)^git@([^:]*):(.*?)(?:\.git)?$", "https://$1/$2")
    u = F.regexp_replace(F.regexp_replace(u, "^git://", "https://"), r"\.git$", "")
    return F.when(u.rlike("^https?://"), u)


def hosting_platform(url: Column) -> Column:
    u = F.lower(url)
    return F.when(u.contains("github.com"), "github").when(u.contains("gitlab.com"), "gitlab").when(u.contains("bitbucket.org"), "bitbucket").otherwise("self-hosted")


def repo_verdict(commits: DataFrame) -> DataFrame:
    """(git_url, commit_verdict, confidence, reasons, commits): malicious over suspicious over allow, mean confidence, distinct
    reasons, from commits (git_url, verdict, confidence, reasons)."""
    rank = F.when(F.col("verdict") == "malicious", 2).when(F.col("verdict") == "suspicious", 1).otherwise(0)
    g = commits.groupBy("git_url").agg(F.max(rank).alias("r"), F.avg("confidence").alias("confidence"), F.count("*").alias("commits"))
    told = commits.select("git_url", F.explode("reasons").alias("reason")).groupBy("git_url").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    verdict = F.when(F.col("r") == 2, "malicious").when(F.col("r") == 1, "suspicious").otherwise("allow")
    return g.join(told, "git_url", "left").select("git_url", verdict.alias("commit_verdict"), "confidence", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "commits")


def package_levels(packages: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """Packages with level (the highest of their findings, safe without) and issues, in order of kind and place.

    ``findings`` have the key, kind, pos, issue and level; vulnerabilities come first, then registry warnings, then names.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")) - 1
    told = F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "issue"))), lambda x: x["issue"])
    g = findings.groupBy(*key).agg(F.max(rank).alias("_r"), told.alias("issues"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce("_r", F.lit(0)).cast("int") + 1)
    return packages.join(g, key, "left").withColumn("level", level).withColumn("issues", F.coalesce("issues", F.array().cast("array<string>"))).drop("_r")


def level_counts(levels: DataFrame, by: list[str]) -> DataFrame:
    """Per group: packages at each level, the overall (highest) level and the summary text."""
    out = levels.groupBy(*by).agg(F.count("*").alias("packages"), *[F.count_if(F.col("level") == x).alias(x) for x in LEVELS])
    top = F.lit(LEVELS[0])
    for x in LEVELS[1:]:
        top = F.when(F.col(x) > 0, x).otherwise(top)
    summary = F.concat_ws(", ", *[F.concat(F.col(x).cast("string"), F.lit(f" {x}")) for x in reversed(LEVELS)])
    return out.withColumn("overall", top).withColumn("summary", F.when(F.col("packages") == 0, "No packages found in lockfile").otherwise(summary))


def package_verdicts(levels: DataFrame) -> DataFrame:
    return levels.withColumn("verdict", F.when(F.col("level") == "critical", "rejected").otherwise("pass"))


def truncated_diff(diff: Column, most: int = 102_400) -> Column:
    """A diff of more than ``most`` bytes, cut after as many characters, back to the last line break if there is one."""
    cut = F.left(diff, F.lit(most))
    return F.when(F.octet_length(diff) <= most, diff).when(F.instr(cut, "\n") > 0, F.regexp_extract(cut, r"(?s)^(.*)\n", 1)).otherwise(cut)


#: Fixed value: what a model is asked about a commit.
COMMIT_PROMPT = """You are a cybersecurity agent analyzing a single code commit for supply chain compromise.

Focus on these suspicious patterns:
- Obfuscated/minified/encoded code (base64, hex, eval(), string encoding)
- New network calls (fetch, curl, request, post) to unfamiliar hosts/IPs
- Modified install scripts (postinstall, build, setup, preinstall)
- Changed repository URLs or download URLs in the code
- Code reading environment variables, config files, or credentials
- Unexpected binary blobs or large encoded strings added
- Backdoored imports or modified require/import paths
- Suspicious file writes to system directories

Ignore: version bumps in metadata, whitespace-only changes, lockfile-only changes, README/doc updates, dependency version bumps without code changes.

Commit: {hash}
Author: {author}
Date: {date}
Message: {message}
Diff:
{diff}

Respond with EXACTLY this JSON — no markdown fences, no explanatory text, exactly this structure:
{"verdict": "allow", "confidence": 1.0, "reasons": [], "suspicious_patterns": []}

Verdict must be one of: "allow", "suspicious", "malicious"
Confidence must be a float 0.0-1.0
Reasons is an array of strings explaining the verdict
Suspicious_patterns is an array of detected pattern names (empty if allow)"""


def commit_prompt() -> Column:
    """The question about one commit, from columns hash, author, date, message and diff."""
    parts = re.split(r"\{(hash|author|date|message|diff)\}", COMMIT_PROMPT)
    return F.concat(*[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


UNREADABLE = "LLM response could not be parsed"


def parsed_verdict(text: Column) -> Column:
    """struct(verdict, confidence, reasons, suspicious_patterns) of a model's answer, from the first brace to the last.

    An unknown verdict is uncertain, a missing confidence 0.5; an answer that is no JSON or has no verdict is uncertain with
    confidence 0 and says so.
    """
    v = F.try_parse_json(F.when(text.rlike(r"(?s)\{.*\}"), F.regexp_extract(text, r"(?s)\{.*\}", 0)).otherwise(text))
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    word = F.try_variant_get(v, "$.verdict", "variant")
    read = F.coalesce(is_text(word), F.lit(False))
    low = F.lower(F.try_variant_get(v, "$.verdict", "string"))
    number = F.try_variant_get(v, "$.confidence", "variant")
    sure = F.when(~is_text(number) & (F.schema_of_variant(number) != "BOOLEAN"), F.try_variant_get(v, "$.confidence", "double"))
    texts = lambda path: F.transform(F.filter(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), is_text), lambda x: x.cast("string"))
    return F.struct(
        F.when(read & low.isin("allow", "suspicious", "malicious"), low).otherwise("uncertain").alias("verdict"), F.when(read, F.coalesce(sure, F.lit(0.5))).otherwise(0.0).alias("confidence"),
        F.when(read, texts("$.reasons")).otherwise(F.array(F.lit(UNREADABLE))).alias("reasons"), F.when(read, texts("$.suspicious_patterns")).otherwise(F.array().cast("array<string>")).alias("suspicious_patterns"),
    )


def with_verdicts(answers: DataFrame, said: str) -> DataFrame:
    """``answers`` with what was said read as a verdict (v); models repeat themselves, so each distinct answer is parsed once."""
    distinct = written(answers.select(F.col(said).alias("_said")).distinct(), "answers")
    return answers.join(distinct.select("_said", parsed_verdict(F.col("_said")).alias("v")), F.col(said).eqNullSafe(F.col("_said")), "left").drop("_said")


def first_mentions(packages: DataFrame) -> DataFrame:
    """(name, version, ecosystem, filename): each package once, from the first file and place that lists it."""
    first = F.min(F.struct("filename", "pos")).alias("f")
    return packages.groupBy("name", "version", "ecosystem").agg(first).select("name", "version", "ecosystem", "f.filename")


def deep_packages(levels: DataFrame, repositories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Passing packages with their repository and its commits' verdict, then rejected ones without.

    ``levels`` has (name, version, ecosystem, level, issues), ``repositories`` (name, version, ecosystem, git_url, platform),
    ``verdicts`` (git_url, commit_verdict, confidence, reasons, commits), each repository once. A repository without
    analysed commits is allowed with confidence 1.
    """
    key = ["name", "version", "ecosystem"]
    judged = package_verdicts(levels)
    out = judged.join(repositories.select(*key, "git_url", "platform"), key, "left").join(verdicts, "git_url", "left")
    passed, has = F.col("verdict") == "pass", F.col("git_url").isNotNull()
    none = F.array().cast("array<string>")
    mine = lambda c, default: F.when(passed & has, F.coalesce(F.col(c), default)).alias(c)
    return out.select(
        *key, "level", "issues", "verdict", F.when(passed, F.col("git_url")).alias("git_url"), F.when(passed, F.col("platform")).alias("platform"), (passed & ~has).alias("no_git_url_notice"),
        mine("commit_verdict", F.lit("allow")), mine("confidence", F.lit(1.0)), mine("reasons", none), mine("commits", F.lit(0).cast("long")), F.when(passed, 0).otherwise(1).alias("part"),
    )


def deep_summary(deep: DataFrame, details: DataFrame | None) -> DataFrame:
    """One row: total_packages, flagged, threshold and ai_status (not_configured without answers, failed if none could be read)."""
    flagged = F.col("commit_verdict").isin("suspicious", "malicious") | (F.col("verdict") == "rejected")
    total = deep.agg(F.count("*").alias("total_packages"), F.count_if(flagged).alias("flagged")).withColumn("threshold", F.lit("Critical"))
    if details is None:
        return total.withColumn("ai_status", F.lit("not_configured"))
    unread = (F.col("verdict") == "uncertain") & (F.col("confidence") == 0) & (F.size("reasons") == 1) & (F.get("reasons", F.lit(0)) == UNREADABLE)
    return total.join(details.agg(F.coalesce(F.every(unread), F.lit(True)).alias("_all")), how="cross").withColumn("ai_status", F.when(F.col("_all"), "failed").otherwise("ok")).drop("_all")
