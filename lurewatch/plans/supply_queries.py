"""Queries over packages, repositories and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, with_fixtures
from ..operators import supply as sp
from ..operators.popular import popular_names
from ..registry import query
from ..sources import lockfiles
from ..tables import written
from .source_queries import land_files
from . import registry_queries as rq

#: Packages of one rendered lockfile.
PER_FILE = 500

# one file of each kind for so many packages: rendered, parsed again, and compared with the packages themselves
_RENDER = {
    "Cargo.lock": "concat('[[package]]\\nname = \"', p.name, '\"\\nversion = \"', p.version, '\"\\n')", "poetry.lock": "concat('[[package]]\\nname = \"', p.name, '\"\\nversion = \"', p.version, '\"\\n')",
    "requirements.txt": "concat(p.name, '==', p.version)", "Gemfile.lock": "concat('    ', p.name, ' (', p.version, ')')", "gradle.lockfile": "concat('org.x:', p.name, ':', p.version)",
    "package-lock.json": "concat('    \"node_modules/', p.name, '\": {\\n      \"version\": \"', p.version, '\",\\n    },')", "pnpm-lock.yaml": "concat('  /', p.name, '@', p.version, ':\\n    version: ', p.version)",
    "pubspec.lock": "concat('  ', p.name, ':\\n    version: \"', p.version, '\"')", "pom.xml": "concat('<dependency><groupId>g</groupId><artifactId>', p.name, '</artifactId><version>', p.version, '</version></dependency>')",
    "composer.lock": "concat('{\"name\":\"', p.name, '\",\"version\":\"', p.version, '\"}')", "maven-lockfile.json": "concat('{\"groupId\":\"g\",\"artifactId\":\"', p.name, '\",\"version\":\"', p.version, '\"}')",
    "go.sum": "concat(p.name, ' ', p.version, ' h1:x')", "yarn.lock": "concat(p.name, '@', p.version, ':')",
    "Pipfile.lock": "concat('        \"', p.name, '\": {\\n            \"version\": \"==', p.version, '\"\\n        },')",
    "packages.lock.json": "concat('\"', p.name, '-', CAST(p.pkg_id AS STRING), '\":{\"type\":\"Direct\",\"resolved\":\"', p.version, '\"}')",
    "mix.lock": "concat('\"', p.name, '-', CAST(p.pkg_id AS STRING), '\":', CASE WHEN p.pkg_id % 9 = 0 THEN '[\"no text\"]' ELSE concat('\"{:hex, :', p.name, ', \\\\\"', p.version, '\\\\\"}\"') END)",
}
_HEAD = {"Gemfile.lock": ("GEM\n", "\n", ""), "package-lock.json": ('{\n"packages": {\n', "\n", "\n}"), "pnpm-lock.yaml": ("packages:\n", "\n", ""), "pubspec.lock": ("packages:\n", "\n", ""), "composer.lock": ('{"packages":[', ",", "]}"), "maven-lockfile.json": ('{"dependencies":[', ",", "]}"),
    "Pipfile.lock": ('{\n    "default": {\n', "\n", "\n    }\n}"), "packages.lock.json": ('{"version":1,"dependencies":{', ",", "}}"), "mix.lock": ("{", ",", "}")}


def _rendered(s: SparkSession, d: str) -> DataFrame:
    """(filename, content) of the files of all formats, from one grouping of the packages."""
    packages = fixture(s, d, "fx_packages").groupBy(F.expr(f"pkg_id div {PER_FILE}").cast("string").alias("dir"))
    files = []
    for name, one in _RENDER.items():
        head, between, end = _HEAD.get(name, ("", "\n", ""))
        body = F.array_join(F.expr(f"transform(packages, p -> {one})"), between)
        files.append(F.struct(F.concat("dir", F.lit("/" + name)).alias("filename"), F.concat(F.lit(head), body, F.lit(end)).alias("content")))
    return packages.agg(F.sort_array(F.collect_list(F.struct("pkg_id", "name", "version"))).alias("packages")).select(F.inline(F.array(*files)))


def _files(s: SparkSession, d: str) -> DataFrame:
    # each format is a branch of its own over these files, which would render all of them again
    return written(_rendered(s, d), "rendered")


_ECO = {k: v[1] for k, v in sp.LOCKFILES.items()}
_NAMED = {"gradle.lockfile": "'org.x:' || name", "maven-lockfile.json": "'g:' || name", "packages.lock.json": "name || '-' || pkg_id", "mix.lock": "name || '-' || pkg_id"}
_VERSIONED = {"Pipfile.lock": "'==' || version"}
_SOME = {"go.sum": f"(SELECT DISTINCT pkg_id // {PER_FILE} * {PER_FILE} AS pkg_id, name, version FROM fx_packages)", "mix.lock": "fx_packages WHERE pkg_id % 9 > 0"}
_EXPECT = " UNION ALL ".join(
    f"SELECT (pkg_id // {PER_FILE}) || '/{n}' AS filename, {_NAMED.get(n, 'name')} AS name, {_VERSIONED.get(n, 'version')} AS version, '{_ECO[n]}' AS ecosystem FROM {_SOME.get(n, 'fx_packages')}"
    for n in _RENDER if n != "yarn.lock"
)


@query("p39_lockfiles", with_fixtures(_EXPECT, "fx_packages"))
def _(s, d):
    return sp.lockfile_packages(_files(s, d).where("not endswith(filename, 'yarn.lock')")).drop("pos")


_YARN = f"SELECT pkg_id // {PER_FILE} || '/yarn.lock' AS filename, name, version, 'npm' AS ecosystem FROM (SELECT *, lag(name || '@' || version) OVER (PARTITION BY pkg_id // {PER_FILE} ORDER BY pkg_id) AS before FROM fx_packages) WHERE before IS NULL OR before <> name || '@' || version"


@query("p39_yarn", with_fixtures(_YARN, "fx_packages"))
def _(s, d):
    return sp.lockfile_packages(_files(s, d).where("endswith(filename, 'yarn.lock')")).drop("pos")


@query("s26_lockfile_corpus", with_fixtures(f"{_EXPECT} UNION ALL {_YARN}", "fx_packages"))
def _(s, d):
    files = _rendered(s, d).select(F.col("filename").alias("file"), F.lit("").alias("member"), "content")
    return lockfiles.read_packages(s, land_files(files, "lockfiles")).drop("pos")


_N = "length(name)"
_MUT = f"""names AS (SELECT DISTINCT lower(name) AS name, ecosystem FROM fx_packages), pos AS (SELECT name, ecosystem, unnest(range(1, {_N} + 1)) AS i FROM names),
alike(a, b) AS (VALUES {", ".join(f"('{k}', '{c}')" for k, v in sp.LOOK_ALIKES.items() for c in v)}),
muts AS (SELECT name, ecosystem, left(name, i - 1) || substr(name, i + 1) AS m FROM pos UNION SELECT name, ecosystem, left(name, i) || substr(name, i) FROM pos
 UNION SELECT name, ecosystem, left(name, i - 1) || substr(name, i + 1, 1) || substr(name, i, 1) || substr(name, i + 2) FROM pos WHERE i < {_N}
 UNION SELECT name, ecosystem, left(name, i - 1) || b || substr(name, i + 1) FROM pos JOIN alike ON substr(name, i, 1) = a
 UNION SELECT name, ecosystem, left(name, i - 1) || 'm' || substr(name, i + 2) FROM pos WHERE substr(name, i, 2) = 'rn'
 UNION SELECT name, ecosystem, left(name, i - 1) || s || substr(name, i) FROM pos, (VALUES ('-'), ('_')) t(s) WHERE i > 1 AND NOT contains(name, s)
 UNION SELECT name, ecosystem, CASE w WHEN 1 THEN lower(name) ELSE upper(name) END FROM names, (VALUES (1), (2)) t(w) WHERE NOT starts_with(name, '@'))"""


@query("p43_name_mutations", with_fixtures(f"WITH {_MUT} SELECT DISTINCT name, m AS mutation FROM muts WHERE m <> ''", "fx_packages"))
def _(s, d):
    names = fixture(s, d, "fx_packages").select(F.lower("name").alias("name")).distinct()
    return names.select("name", F.explode(sp.name_mutations(F.col("name"))).alias("mutation"))


_SQUAT = f"""{_MUT}, {rq.POPULAR_SQL}, asked AS (SELECT DISTINCT name {{e}} FROM names n WHERE NOT EXISTS (SELECT 1 FROM popular p WHERE lower(p.popular) = n.name {{eco}})),
bm AS (SELECT DISTINCT a.name, {{pe}} popular, m AS mutation FROM asked a JOIN muts m ON m.name = a.name {{me}} JOIN popular p ON lower(p.popular) = lower(m.m) {{pm}})
SELECT *, 'mutation' AS kind, CAST(NULL AS INT) AS distance FROM bm UNION ALL SELECT DISTINCT a.name, {{pe}} popular, CAST(NULL AS VARCHAR), 'distance', levenshtein(a.name, lower(popular)) FROM asked a JOIN popular p ON levenshtein(a.name, lower(popular)) BETWEEN 1 AND 2 {{pa}} WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.name = a.name {{pb}})"""


@query("j22_typosquats", with_fixtures("WITH " + _SQUAT.format(e=", ecosystem", eco="AND p.ecosystem = n.ecosystem", me="AND m.ecosystem = a.ecosystem", pe="a.ecosystem,", pm="AND p.ecosystem = a.ecosystem", pa="AND p.ecosystem = a.ecosystem", pb="AND bm.ecosystem = a.ecosystem"), "fx_packages"))
def _(s, d):
    return sp.typosquats(fixture(s, d, "fx_packages"), popular_names(s))


@query("j23_typosquats_all", with_fixtures("WITH " + _SQUAT.format(e="", eco="", me="", pe="", pm="", pa="", pb=""), "fx_packages"))
def _(s, d):
    return sp.typosquats(fixture(s, d, "fx_packages"), popular_names(s), by_ecosystem=False)


_LEVELS = rq.findings_sql(_MUT, False)
_NAMES = "['safe', 'low', 'medium', 'high', 'critical']"


@query("j20_g9_package_levels", with_fixtures(f"WITH {_LEVELS} SELECT * FROM levels", "fx_packages"))
def _(s, d):
    return rq.package_levels(s, d).withColumn("issues", F.array_join("issues", "; "))


@query("g10_level_counts", with_fixtures(f"WITH {_LEVELS}, c AS (SELECT ecosystem, count(*) AS packages, " + ", ".join(f"count(*) FILTER (level = '{x}') AS {x}" for x in sp.LEVELS) + f", ({_NAMES})[max(list_position({_NAMES}, level))] AS overall FROM levels GROUP BY ecosystem) SELECT *, critical || ' critical, ' || high || ' high, ' || medium || ' medium, ' || low || ' low, ' || safe || ' safe' AS summary FROM c", "fx_packages"))
def _(s, d):
    return sp.level_counts(rq.package_levels(s, d), ["ecosystem"])


@query("f10_package_verdicts", with_fixtures(f"WITH {rq._deep_sql(_MUT)} SELECT name, version, ecosystem, verdict FROM deep", "fx_packages", "fx_commit_verdicts"))
def _(s, d):
    return rq._deep(s, d).select("name", "version", "ecosystem", "verdict")


@query("j24_u6_deep_packages", with_fixtures(f"WITH {rq._deep_sql(_MUT)} SELECT * FROM deep", "fx_packages", "fx_commit_verdicts"))
def _(s, d):
    return rq._deep(s, d).withColumn("issues", F.array_join("issues", "; ")).withColumn("reasons", F.array_join("reasons", ",")).withColumn("confidence", F.round("confidence", 6))


@query("g12_deep_summary", with_fixtures(f"WITH {rq._deep_sql(_MUT)} SELECT count(*) AS total_packages, count(*) FILTER (verdict = 'rejected' OR commit_verdict IN ('suspicious', 'malicious')) AS flagged, 'Critical' AS threshold, 'ok' AS ai_status FROM deep", "fx_packages", "fx_commit_verdicts"))
def _(s, d):
    return sp.deep_summary(rq._deep(s, d), rq._details(s, d))


@query("u3_w12_first_mentions", with_fixtures(f"SELECT name, version, ecosystem, min(filename) AS filename FROM ({_EXPECT} UNION ALL {_YARN}) GROUP BY ALL", "fx_packages"))
def _(s, d):
    return sp.first_mentions(sp.lockfile_packages(_files(s, d)))
