"""Queries over vulnerability, registry and forge documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, run, with_fixtures
from ..operators import registries as rg
from ..operators import supply as sp
from ..operators.popular import BY_ECOSYSTEM, popular_names
from ..registry import ORACLES, query
from ..tables import shared_dir, written

ASOF = "2024-07-01 00:00:00"
_PKGS = "SELECT DISTINCT name, version, ecosystem, (length(name) * 7 + length(version) + CAST(substr(version, 1, 1) AS INT)) % 7 AS k FROM fx_packages"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(text: str) -> str:
    """SQL for a text with {name} and {version} in it."""
    parts, out = text.replace("{name}", "\0name\0").replace("{version}", "\0version\0").split("\0"), []
    for i, p in enumerate(parts):
        out.append(p if i % 2 else _quote(p))
    return "concat(" + ", ".join([*out, "''"]) + ")"


#: Kind of vulnerability: its JSON, its score and level without and with the database's word, read off the rules; its summary.
VULNS = (
    ('{"summary":"plain","severity":[{"type":"X","score":"7.5"}]}', (7.5, "high"), (7.5, "high"), "plain"),
    ('{"summary":"","details":"Worst case! More","severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}]}', (9.8, "critical"), (9.8, "critical"), "Worst case"),
    ('{"details":" Two. Three","severity":[{"type":"CVSS_V2","score":"AV:N/AC:L/Au:N/C:P/I:P/A:P"}]}', (0.0, "none"), (0.0, "none"), "Two"),
    ('{"summary":"s","severity":[],"database_specific":{"severity":"high"}}', (5.0, "medium"), (7.0, "high"), "s"),
    ('{"severity":[{"type":"OTHER","score":"x"},{"type":"CVSS_V3","score":"CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"}]}', (10.0, "critical"), (10.0, "critical"), "No description"),
    ('{"details":"?","severity":[{"score":"0.0"}],"database_specific":{"severity":"LOW"}}', (0.0, "none"), (0.0, "none"), ""),
    ('{"database_specific":{"severity":"odd"}}', (5.0, "medium"), (5.0, "medium"), "No description"),
)
_VULN_ROWS = "SELECT name, version, ecosystem, k, concat('V-', CAST(length(version) AS STRING), '-', name) AS vuln_id, " + "CASE k " + " ".join(f"WHEN {i} THEN {_quote(v[0])}" for i, v in enumerate(VULNS)) + f" END AS body FROM ({_PKGS}) p WHERE k <> 6 OR length(version) > 5"


def _vulns(s: SparkSession, d: str) -> DataFrame:
    rows = run(s, d, _VULN_ROWS, fx_packages=fixture(s, d, "fx_packages"))
    v = F.from_json("body", rg.VULNERABILITY)
    whole = F.struct(F.col("vuln_id").alias("id"), v["summary"].alias("summary"), v["details"].alias("details"), v["severity"].alias("severity"), v["database_specific"].alias("database_specific"))
    return rows.select("ecosystem", "name", "version", whole.alias("vuln"))


_KINDS = "kinds(k, score, level, full_score, full_level, summary) AS (VALUES " + ", ".join(f"({i}, {a[0]}, '{a[1]}', {b[0]}, '{b[1]}', {_quote(t)})" for i, (_, a, b, t) in enumerate(VULNS)) + ")"


@query("p40_p41_severity", with_fixtures(f"WITH {_KINDS} SELECT v.name, version, ecosystem, vuln_id AS id, CAST(score AS DOUBLE) AS score, level, CAST(full_score AS DOUBLE) AS full_score, full_level, kinds.summary FROM ({_VULN_ROWS}) v JOIN kinds USING (k)", "fx_packages"))
def _(s, d):
    return _severities(_vulns(s, d))


def _severities(vulns: DataFrame) -> DataFrame:
    v = F.col("vuln")
    plain, full = rg.vulnerability_severity(v["severity"]), rg.vulnerability_severity(v["severity"], v["database_specific"])
    return vulns.select(
        "name", "version", "ecosystem", v["id"].alias("id"), plain["score"].alias("score"), plain["level"].alias("level"), full["score"].alias("full_score"), full["level"].alias("full_level"),
        rg.vulnerability_summary(v["summary"], v["details"]).alias("summary"),
    )


#: Document of each registry and kind, and the warnings that it gives, read off the rules.
DOCS = {
    "PyPI": (
        ('{"upload_time":"2024-06-28T00:00:00Z"}', ["PyPI package {name}/{version} is very new (uploaded 3 days ago)"]),
        ('{"vulnerabilities":[{},{}],"upload_time":"2024-06-24T00:00:00Z"}', ["PyPI package {name}/{version} has 2 known vulnerabilities"]),
        ('{"yanked":true,"upload_time":"2024-06-28"}', ["PyPI package {name}/{version} has been YANKED from the registry"]),
        ('{"yanked":true,"vulnerabilities":[1],"upload_time":"2024-06-25T12:00:00+00:00"}', ["PyPI package {name}/{version} is very new (uploaded 5 days ago)", "PyPI package {name}/{version} has 1 known vulnerabilities", "PyPI package {name}/{version} has been YANKED from the registry"]),
        ('{"yanked":"true","vulnerabilities":[]}', []), ("broken", []), ("{}", []),
    ),
    "npm": (
        ('{"versions":{}}', ["npm package {name} version {version} was not found in the registry"]),
        ('{"versions":{"{version}":{}},"time":{"published":"2024-06-30T00:00:00Z"}}', ["npm package {name}/{version} is very new (published 1 days ago)"]),
        ('{"versions":{"{version}":{"deprecated":"use other"}}}', ["npm package {name}/{version} is deprecated: use other"]),
        ('{"versions":{"{version}":{"deprecated":"old"}},"time":{"published":"2024-06-26T00:00:00Z"}}', ["npm package {name}/{version} is very new (published 5 days ago)", "npm package {name}/{version} is deprecated: old"]),
        ('{"versions":{"{version}":{"deprecated":""}},"time":{"published":"2020-01-01T00:00:00Z"}}', []), ("broken", []), ("{}", ["npm package {name} version {version} was not found in the registry"]),
    ),
    "crates.io": (
        ('{"crate":{"updated_at":"2024-06-29T00:00:00Z"}}', ["crates.io crate {name}/{version} updated very recently (2 days ago)"]),
        ('{"version":{"yanked":true}}', ["crates.io version {name}/{version} has been YANKED"]),
        ('{"crate":{"updated_at":"2024-07-01T00:00:00Z"},"version":{"yanked":true}}', ["crates.io crate {name}/{version} updated very recently (0 days ago)", "crates.io version {name}/{version} has been YANKED"]),
        ('{"crate":{"updated_at":"2023-07-01T00:00:00Z"},"version":{"yanked":false}}', []), ("[]", []), ("broken", []), ("{}", []),
    ),
}
_DOC_ROWS = f"SELECT ecosystem, name, version, CASE " + " ".join(f"WHEN ecosystem = '{e}' AND k = {i} THEN {fill(body)}" for e, kinds in DOCS.items() for i, (body, _) in enumerate(kinds)) + f" END AS body FROM ({_PKGS}) p"  # noqa: F541
_WARNED = " UNION ALL ".join(f"SELECT name, version, ecosystem, {pos} AS pos, {fill(w)} AS warning FROM pkgs WHERE ecosystem = '{e}' AND k = {i}" for e, kinds in DOCS.items() for i, (_, told) in enumerate(kinds) for pos, w in enumerate(told))


def _packages(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, "fx_packages").select("name", "version", "ecosystem").distinct()


def _docs(s: SparkSession, d: str) -> DataFrame:
    return run(s, d, _DOC_ROWS, fx_packages=fixture(s, d, "fx_packages"))


def _warned(s: SparkSession, d: str) -> DataFrame:
    return rg.registry_warnings(_packages(s, d), _docs(s, d), F.lit(ASOF).cast("timestamp"))


@query("p42_j21_registry_warnings", with_fixtures(f"WITH pkgs AS ({_PKGS}) {_WARNED}", "fx_packages"))
def _(s, d):
    return _warned(s, d)


def _landed(rows: DataFrame, name: str) -> str:
    """Rows as landed JSON lines."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


@query("s27_vulnerability_files", ORACLES["p40_p41_severity"])
def _(s, d):
    listed = _vulns(s, d).groupBy("ecosystem", "name", "version").agg(F.collect_list("vuln").alias("vulns"))
    return _severities(rg.read_vulnerabilities(s, _landed(listed, "vulnerabilities")))


@query("s28_registry_files", ORACLES["p42_j21_registry_warnings"])
def _(s, d):
    docs = rg.read_registry_docs(s, _landed(_docs(s, d), "registry"))
    return rg.registry_warnings(_packages(s, d), docs, F.lit(ASOF).cast("timestamp"))


_LISTED = [(n, e) for e, names in BY_ECOSYSTEM.items() for n in names]
POPULAR_SQL = "popular(popular, ecosystem) AS (VALUES " + ", ".join(f"({_quote(n)}, '{e}')" for n, e in _LISTED) + ")"


def findings_sql(muts: str, deep: bool) -> str:
    """Common tables of all findings and of the levels, for the oracle."""
    return f"""{muts}, {POPULAR_SQL}, {_KINDS}, pkgs AS ({_PKGS}), vulns AS ({_VULN_ROWS}), warned AS ({_WARNED}),
asked AS (SELECT DISTINCT lower(name) AS low, ecosystem FROM pkgs n WHERE NOT EXISTS (SELECT 1 FROM popular p WHERE lower(p.popular) = lower(n.name) AND p.ecosystem = n.ecosystem)),
bm AS (SELECT DISTINCT low, a.ecosystem, popular, m FROM asked a JOIN muts ON muts.name = low AND muts.ecosystem = a.ecosystem JOIN popular p ON lower(p.popular) = lower(m) AND p.ecosystem = a.ecosystem),
bd AS (SELECT low, a.ecosystem, popular, levenshtein(low, lower(popular)) AS distance FROM asked a JOIN popular p ON p.ecosystem = a.ecosystem AND levenshtein(low, lower(popular)) BETWEEN 1 AND 2 WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.low = a.low AND bm.ecosystem = a.ecosystem)),
findings AS (SELECT v.name, version, ecosystem, 1 AS kind, vuln_id AS pos, vuln_id || ': ' || kinds.summary AS issue, CASE WHEN level IN ('critical', 'high') THEN 3 WHEN level = 'low' THEN 1 ELSE 2 END AS r FROM vulns v JOIN kinds USING (k)
 UNION ALL SELECT name, version, ecosystem, 2, printf('%03d', pos), warning, CASE WHEN contains(warning, 'yanked') THEN 4 WHEN contains(warning, 'week old'){" OR contains(warning, 'days ago')" if deep else ""} THEN 2 ELSE 0 END FROM warned
 UNION ALL SELECT name, version, pkgs.ecosystem, 3, popular || ' ' || m, 'Possible typosquat of ''' || popular || ''': ''' || m || '''', 3 FROM pkgs JOIN bm ON low = lower(name) AND bm.ecosystem = pkgs.ecosystem
 UNION ALL SELECT name, version, pkgs.ecosystem, 3, popular, 'Possible typosquat of ''' || popular || ''' (Levenshtein distance ' || distance || '): ''' || name || '''', 3 FROM pkgs JOIN bd ON low = lower(name) AND bd.ecosystem = pkgs.ecosystem),
levels AS (SELECT p.name, p.version, p.ecosystem, (['safe', 'low', 'medium', 'high', 'critical'])[coalesce(max(r), 0) + 1] AS level, coalesce(string_agg(issue, '; ' ORDER BY kind, pos, issue), '') AS issues FROM pkgs p LEFT JOIN findings USING (name, version, ecosystem) GROUP BY ALL)"""


def package_levels(s: SparkSession, d: str, deep: bool = False) -> DataFrame:
    packages = _packages(s, d)
    findings = rg.vulnerability_findings(packages, _vulns(s, d)).unionByName(rg.registry_findings(_warned(s, d), deep)).unionByName(sp.typosquat_findings(packages, popular_names(s)))
    return sp.package_levels(packages, findings, ["name", "version", "ecosystem"])


#: Registry, package name, answers of the registry, and the repository read off the rules (null: none).
REPOSITORIES = (
    ("crates.io", "{name}", '{"crate":{"repository":"git+https://github.com/o/{name}.git"}}', None, "https://github.com/o/{name}"), ("crates.io", "{name}", '{"crate":{"repository":"svn://x"}}', None, None),
    ("npm", "{name}", '{"repository":{"type":"git","url":"git://bitbucket.org/o/{name}"}}', None, "https://bitbucket.org/o/{name}"), ("npm", "{name}", '{"repository":"git@gitlab.com:o/{name}.git"}', None, "https://gitlab.com/o/{name}"),
    ("npm", "{name}", '{"repository":{"url":"nowhere"}}', None, None), ("PyPI", "{name}", '{"info":{"home_page":"http://{name}.example","project_urls":{"Source":"https://github.com/o/r"}}}', None, "http://{name}.example"),
    ("PyPI", "{name}", '{"info":{"home_page":"","project_urls":{"Code":"https://x.org/c","Source Code":"https://GitLab.com/o/{name}"}}}', None, "https://GitLab.com/o/{name}"), ("PyPI", "{name}", '{"info":{"project_urls":{"Docs":"https://github.com/o/r"}}}', None, None),
    ("Go", "github.com/u/{name}", None, None, "https://u/{name}"), ("Go", "go.x.org/{name}", '{"Origin":"git https://github.com/x/{name}"}', "data-source-url=\"https://no\"", "https://github.com/x/{name}"),
    ("Go", "go.y.org/{name}", '{"Origin":{"VCS":"git"}}', '<a data-source-url="https://gitlab.com/y/{name}">', "https://gitlab.com/y/{name}"), ("RubyGems", "{name}", '{"source_code_uri":"https://github.com/g/{name}/","homepage_uri":"https://github.com/h"}', None, "https://github.com/g/{name}/"),
    ("RubyGems", "{name}", '{"source_code_uri":"","homepage_uri":"https://{name}.github.io"}', None, "https://{name}.github.io"), ("RubyGems", "{name}", '{"source_code_uri":null,"homepage_uri":"https://{name}.org"}', None, None),
    ("Packagist", "v/{name}", '{"packages":{"v/{name}":{"repository":"https://github.com/v/{name}.git"}}}', None, "https://github.com/v/{name}"),
    ("Packagist", "v/{name}2", '{"packages":{"v/{name}2":[{"repository":"x"}]}}', '{"package":{"repository":"https://gitlab.com/v/{name}"}}', "https://gitlab.com/v/{name}"),
    ("Maven", "org.x:{name}", '{"response":{"docs":[{"latestVersion":"1"}]}}', "<project><url>http://no</url><scm><connection>c</connection><url> https://github.com/x/{name} </url></scm></project>", "https://github.com/x/{name}"),
    ("Maven", "io.github.own:{name}", '{"response":{"docs":[{"v":"1"}]}}', "<scm></scm>", "https://github.com/own/{name}"), ("Maven", "io.github.own2:{name}", '{"response":{"docs":[]}}', None, None),
    ("NuGet", "{name}", '{"items":[{"items":[{"catalogEntry":{"projectUrl":"","repository":{"url":"https://github.com/n/{name}"}}},{"catalogEntry":{"projectUrl":"https://no"}}]}]}', None, "https://github.com/n/{name}"),
    ("NuGet", "{name}2", '{"items":[{},{"items":[{"catalogEntry":{"projectUrl":"https://bitbucket.org/n/{name}"}}]}]}', None, "https://bitbucket.org/n/{name}"),
    ("Pub", "{name}", '{"latest":{"pubspec":{"repository":"git://x","homepage":"https://github.com/p/{name}"}}}', None, "https://github.com/p/{name}"), ("Pub", "{name}2", '{"latest":{"pubspec":{"repository":"https://code.example/{name}"}}}', None, "https://code.example/{name}"),
    ("Hex", "{name}", '{"meta":{"links":{"Code":"https://c","Source":"https://gitlab.com/h/{name}"}}}', None, "https://gitlab.com/h/{name}"), ("Hex", "{name}2", '{"meta":{"links":{"Docs":"https://d","Home":"https://github.com/h/{name}"}}}', None, "https://github.com/h/{name}"),
    ("Other", "{name}", '{"crate":{"repository":"https://github.com/o/r"}}', None, None),
)
_of = lambda i: "CASE g " + " ".join(f"WHEN {n} THEN {'NULL' if r[i] is None else fill(r[i])}" for n, r in enumerate(REPOSITORIES)) + " END"
_REPO_ROWS = f"SELECT {_of(0)} AS ecosystem, {_of(1)} AS name, version, {_of(2)} AS body, {_of(3)} AS page, {_of(4)} AS want FROM (SELECT DISTINCT concat(name, '-', CAST(pkg_id % {len(REPOSITORIES)} AS STRING)) AS name, version, pkg_id % {len(REPOSITORIES)} AS g FROM fx_packages) p"
_PLATFORM = "CASE WHEN contains(lower(want), 'github.com') THEN 'github' WHEN contains(lower(want), 'gitlab.com') THEN 'gitlab' WHEN contains(lower(want), 'bitbucket.org') THEN 'bitbucket' ELSE 'self-hosted' END"


@query("p44_repo_urls", with_fixtures(f"SELECT name, version, ecosystem, want AS git_url, {_PLATFORM} AS platform FROM ({_REPO_ROWS}) r WHERE want IS NOT NULL", "fx_packages"))
def _(s, d):
    rows = run(s, d, _REPO_ROWS, fx_packages=fixture(s, d, "fx_packages"))
    return rg.repository_urls(rows.select("name", "version", "ecosystem"), rows.select("ecosystem", "name", "body", "page").distinct())


_OWNER = "regexp_extract(u, '(?:github\\.com|gitlab\\.com|bitbucket\\.org)/([^/]*)/([^/]*)', {0})"


@query("p44_owner_repo", with_fixtures(f"SELECT name, version, ecosystem, coalesce(nullif({_OWNER.format(1)}, ''), nullif(regexp_extract(u, '://[^/]*/([^/]*)/([^/]*)', 1), '')) AS owner, coalesce(nullif({_OWNER.format(2)}, ''), nullif(regexp_extract(u, '://[^/]*/([^/]*)/([^/]*)', 2), '')) AS repo FROM (SELECT name, version, ecosystem, rtrim(want, '/') AS u FROM ({_REPO_ROWS}) r WHERE want IS NOT NULL)", "fx_packages"))
def _(s, d):
    rows = run(s, d, _REPO_ROWS, fx_packages=fixture(s, d, "fx_packages")).where("want is not null")
    return rows.select("name", "version", "ecosystem", rg.owner_repo(F.col("want")).alias("o")).select("name", "version", "ecosystem", "o.owner", "o.repo")


#: Commit lists of four forges, one commit each here, and their diffs.
_FORGE = "CASE CAST(regexp_extract(git_url, 'org([0-9]+)', 1) AS INT) % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' ELSE 'self-hosted' END"
_LISTS = f"""SELECT git_url, hash, {_FORGE} AS platform, verdict, reason, CASE {_FORGE}
 WHEN 'github' THEN concat('[{{"sha":"', hash, '","commit":{{"author":{{"name":"Ann","date":"2024-01-01"}},"message":"m ', verdict, '"}}}}]')
 WHEN 'gitlab' THEN concat('[{{"id":"', hash, '","author_name":"Bob","created_at":"2024-01-02"}}]')
 WHEN 'bitbucket' THEN concat('{{"values":[{{"hash":"', hash, '","author":{{"raw":"Cy <c@x.org>"}},"date":"2024-01-03","message":7}}]}}')
 ELSE concat('[{{"sha":"', hash, '","author_name":"Di","commit":{{"message":"own"}},"created_at":"2024-01-04"}}]') END AS body,
 CASE {_FORGE} WHEN 'gitlab' THEN '[{{"diff":"+a"}},{{"x":1}},{{"diff":"-b"}}]' ELSE concat('+', reason) END AS diff FROM (SELECT DISTINCT git_url, concat(hash, '-', reason, '-', verdict) AS hash, verdict, reason FROM fx_commit_verdicts) f"""
_COMMITS = f"""SELECT git_url, hash, CASE platform WHEN 'github' THEN 'Ann' WHEN 'gitlab' THEN 'Bob' WHEN 'bitbucket' THEN 'Cy ' ELSE 'Di' END AS author, CASE platform WHEN 'github' THEN '2024-01-01' WHEN 'gitlab' THEN '2024-01-02' WHEN 'bitbucket' THEN '2024-01-03' ELSE '2024-01-04' END AS date,
 CASE platform WHEN 'github' THEN 'm ' || verdict WHEN 'self-hosted' THEN 'own' ELSE '' END AS message, CASE platform WHEN 'gitlab' THEN '+a' || chr(10) || '-b' || chr(10) ELSE '+' || reason END AS diff FROM (SELECT DISTINCT * FROM ({_LISTS}))"""


def _commits(s: SparkSession, d: str) -> DataFrame:
    # the commits are distinct in the SQL, and what is derived from each follows from it
    rows = written(run(s, d, _LISTS, fx_commit_verdicts=fixture(s, d, "fx_commit_verdicts")), "commits")
    return rg.read_commits(rows.select("git_url", "platform", "body"), rows.select("git_url", "hash", F.col("diff").alias("body")))


@query("s29_commits", with_fixtures(_COMMITS, "fx_commit_verdicts"))
def _(s, d):
    return _commits(s, d).drop("pos")


_PROMPT = "replace(replace(replace(replace(replace(" + _quote(sp.COMMIT_PROMPT) + ", '{hash}', hash), '{author}', author), '{date}', date), '{message}', message), '{diff}', diff)"


@query("p45_p46_commit_prompts", with_fixtures(f"SELECT git_url, hash, sha256({_PROMPT}) AS prompt_sha256 FROM ({_COMMITS})", "fx_commit_verdicts"))
def _(s, d):
    return _commits(s, d).select("git_url", "hash", F.sha2(sp.commit_prompt(), 256).alias("prompt_sha256"))


#: What a model said about a commit: most as asked, some with an odd verdict, without one, or no JSON at all.
_SAID = "CASE WHEN confidence > 0.95 THEN concat('{\"verdict\":\"odd\",\"reasons\":[\"', reason, '\",1]}') WHEN confidence > 0.85 THEN 'sorry' WHEN confidence > 0.75 THEN '{\"confidence\":1}' ELSE concat('So: {\"verdict\":\"', upper(verdict), '\",\"confidence\":', CAST(ROUND(confidence * 100) AS INT), 'e-2,\"reasons\":[\"', reason, '\"]} end') END"
_READ = """SELECT git_url, hash, CASE WHEN confidence <= 0.75 THEN verdict ELSE 'uncertain' END AS verdict, CASE WHEN confidence > 0.95 THEN 0.5 WHEN confidence > 0.75 THEN 0.0 ELSE round(confidence * 100) / 100 END AS confidence,
 CASE WHEN confidence > 0.95 OR confidence <= 0.75 THEN reason ELSE 'LLM response could not be parsed' END AS reason FROM fx_commit_verdicts"""


def _details(s: SparkSession, d: str) -> DataFrame:
    said = fixture(s, d, "fx_commit_verdicts").select("git_url", "hash", F.expr(_SAID).alias("said"))
    return sp.with_verdicts(said, "said").select("git_url", "hash", "v.verdict", "v.confidence", "v.reasons")


@query("p46_verdicts", with_fixtures(f"SELECT git_url, hash, verdict, CAST(confidence AS DOUBLE) AS confidence, reason AS reasons FROM ({_READ})", "fx_commit_verdicts"))
def _(s, d):
    return _details(s, d).withColumn("reasons", F.array_join("reasons", ","))


_AGREED = f"""SELECT git_url, CASE WHEN bool_or(verdict = 'malicious') THEN 'malicious' WHEN bool_or(verdict = 'suspicious') THEN 'suspicious' ELSE 'allow' END AS commit_verdict, round(avg(confidence), 6) AS confidence, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, count(*) AS commits FROM ({_READ}) GROUP BY git_url"""


@query("g11_repo_verdict", with_fixtures(_AGREED, "fx_commit_verdicts"))
def _(s, d):
    return sp.repo_verdict(_details(s, d)).withColumn("confidence", F.round("confidence", 6)).withColumn("reasons", F.array_join("reasons", ","))


_REPO_OF = "CASE WHEN length(name) % 5 = 0 THEN NULL ELSE concat('https://github.com/org', CAST((length(name) * 31 + ascii(name) * 17) % 150 AS STRING), '/repo') END"
#: What the registries of these packages answer, naming the repository in their own ways.
_ANSWERED = "CASE ecosystem WHEN 'npm' THEN concat('{\"repository\":{\"url\":\"git+', repo, '.git\"}}') WHEN 'PyPI' THEN concat('{\"info\":{\"home_page\":\"\",\"project_urls\":{\"Source\":\"', repo, '\"}}}') ELSE concat('{\"crate\":{\"repository\":\"', repo, '\"}}') END"


def _deep(s: SparkSession, d: str) -> DataFrame:
    levels = package_levels(s, d, deep=True)
    # registries never say "yanked" in lower case, so a rejection is planted
    levels = levels.withColumn("level", F.when(F.col("version").startswith("9"), "critical").otherwise(F.col("level")))
    named = levels.select("ecosystem", "name").distinct().withColumn("repo", F.expr(_REPO_OF))
    docs = named.select("ecosystem", "name", F.expr(_ANSWERED).alias("body"), F.lit(None).cast("string").alias("page"))
    repos = rg.repository_urls(levels.select("name", "version", "ecosystem"), docs)
    return sp.deep_packages(levels, repos, sp.repo_verdict(_details(s, d)))


def _deep_sql(muts: str) -> str:
    return f"""{findings_sql(muts, True)}, agreed AS ({_AGREED}),
planted AS (SELECT name, version, ecosystem, CASE WHEN starts_with(version, '9') THEN 'critical' ELSE level END AS level, issues, {_REPO_OF} AS repo FROM levels),
deep AS (SELECT p.name, p.version, p.ecosystem, level, issues, CASE WHEN level = 'critical' THEN 'rejected' ELSE 'pass' END AS verdict, CASE WHEN level <> 'critical' THEN repo END AS git_url, CASE WHEN level <> 'critical' AND repo IS NOT NULL THEN 'github' END AS platform,
 level <> 'critical' AND repo IS NULL AS no_git_url_notice, CASE WHEN level <> 'critical' AND repo IS NOT NULL THEN coalesce(commit_verdict, 'allow') END AS commit_verdict, CASE WHEN level <> 'critical' AND repo IS NOT NULL THEN coalesce(confidence, 1.0) END AS confidence,
 CASE WHEN level <> 'critical' AND repo IS NOT NULL THEN coalesce(reasons, '') END AS reasons, CASE WHEN level <> 'critical' AND repo IS NOT NULL THEN coalesce(commits, 0) END AS commits, CAST(level = 'critical' AS INT) AS part FROM planted p LEFT JOIN agreed ON git_url = repo)"""
