"""Lockfiles read by lines and entries, over chunks of any size, give what whole files give."""

import json
import random

import pytest

from lurewatch.operators import supply
from lurewatch.sources import lockfiles

NOISE = ["", "# note", "  indented: x", "GEM", "PATH", "packages:", '"default": {', '"packages": {', "[[package]]", 'name = "stray"', "</dependency>", "<dependency>", "version: 9", '"version": "8",', "@odd@line:", "}", "\r", "a:b:c"]


def text_of(kind, rng):
    """A file of one format with mistakes in it."""
    n, v = lambda: rng.choice("abc") + str(rng.randrange(6)), lambda: f"{rng.randrange(3)}.{rng.randrange(3)}"
    line = {
        "toml": lambda: rng.choice([f'[[package]]\nname = "{n()}"\nversion = "{v()}"', f'x [[package]] name = "{n()}"', f' version = "{v()}"', '[[package]]']),
        "pom": lambda: rng.choice([f"<dependency><groupId>g</groupId><artifactId> {n()}\n</artifactId>\n<version>{v()}</version></dependency>", f"<dependency><artifactId>{n()}</artifactId>", f"<version>{v()}</version></dependency> tail", f"<dependency><dependency><artifactId>{n()}</artifactId><version>{v()}</version></dependency><dependency>"]),
        "requirements": lambda: rng.choice([f"{n()}=={v()}", f"{n()} >= {v()}", f"-r {n()}", n()]), "go_sum": lambda: f"{n()} {v()} h1:x",
        "gemfile": lambda: rng.choice(["GEM", "  specs:", f"    {n()} ({v()})", f"      {n()}", "PLATFORMS"]), "yarn": lambda: rng.choice([f"{n()}@{v()}:", f'  version "{v()}"']),
        "gradle": lambda: f"g:{n()}:{v()}=x", "package_lock": lambda: rng.choice([f'"node_modules/{n()}": {{', f'  "version": "{v()}",', '"packages": {']),
        "pipfile": lambda: rng.choice(['"default": {', f'"{n()}": {{', f'"version": "=={v()}"']), "pnpm": lambda: rng.choice([f"  /{n()}@{v()}:", f"    version: {v()}", "packages:"]),
        "pubspec": lambda: rng.choice(["packages:", f"  {n()}:", f'    version: "{v()}"']),
    }
    if kind in line:
        head = {"package_lock": '"packages": {', "pipfile": '"default": {', "pnpm": "packages:", "pubspec": "packages:"}.get(kind, "")
        return "\n".join([head, *(rng.choice(NOISE) if rng.random() < 0.15 else line[kind]() for _ in range(rng.choice([0, 3, 60])))])
    items = {
        "composer": lambda k: {"packages": [{"name": n(), "version": v(), "x": [1]} for _ in range(k)], "packages-dev": [{"name": "dev", "version": "1"}]},
        "maven_json": lambda k: {"v": 1, "dependencies": [{"groupId": "g", "artifactId": n(), "version": v()} for _ in range(k)]},
        "nuget": lambda k: {"version": 1, "dependencies": {f"{n()}{i}": {"type": "Direct", "resolved": v()} for i in range(k)}},
        "mix": lambda k: {f"{n()}{i}": rng.choice([f'{{:hex, :a, "{v()}"}}', "plain", ["=> \"1\""], 7]) for i in range(k)},
    }
    out = json.dumps(items[kind](rng.choice([0, 2, 40])), indent=rng.choice([None, 1]))
    return out if rng.random() < 0.8 else out[: len(out) - 2]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_chunked_is_whole(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(lockfiles, "CHUNK", chunk)
    rng, files = random.Random(chunk + 100), []
    for d in range(9):
        folder = tmp_path / f"a b+{d}%" / "x"
        folder.mkdir(parents=True)
        for name, (kind, _) in supply.LOCKFILES.items():
            text = text_of(kind, rng)
            (folder / name).write_text(text, newline="")
            files.append((f"a b+{d}%/x/{name}", text))
        (folder / "other.lock").write_text('[[package]]\nname = "no"\nversion = "1"')
    whole = supply.lockfile_packages(spark.createDataFrame(files, "filename string, content string"))
    key = lambda df: sorted((r.filename, r.name, r.version, r.ecosystem) for r in df.collect())
    want = key(whole)
    assert {supply.LOCKFILES[f.rpartition("/")[2]][0] for f, *_ in want} == {k for k, _ in supply.LOCKFILES.values()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = lockfiles.read_packages(spark, str(tmp_path))
        assert key(got) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = lambda df: [(r.filename, r.name, r.version) for r in sorted(df.collect(), key=lambda r: (r.filename, r.pos))]
    assert order(got) == order(whole)


def test_mix_values_that_are_no_text(spark):
    rows = [("mix.lock", '{"a": "=> {:hex, :a, \\"1.2\\"}", "b": ["x", "2"], "c": {"d": "\\"3\\""}, "e": 4, "f": "\\"\\""}')]
    assert [(r.name, r.version) for r in supply.lockfile_packages(spark.createDataFrame(rows, "filename string, content string")).collect()] == [("a", "1.2")]


def test_no_window_is_larger_than_a_chunk(spark):
    """What a chunk's window holds, and what the window over chunks holds, for one file of many lines."""
    lines = spark.range(20_000).selectExpr("'f' AS filename", "id AS pos", "CASE WHEN id % 977 = 5 THEN id END AS x")
    out = lockfiles.carry_over(lines, 100, last=lines["x"])
    want, last = [], None
    for i in range(20_000):
        want.append(last)
        last = i if i % 977 == 5 else last
    assert [r.last for r in out.orderBy("pos").collect()] == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk" in plan and plan.count("Window") == 2


def test_rendered_files_are_written_once(spark):
    """The branches of the formats read one table: none of them renders the files again."""
    from lurewatch.registry import QUERIES

    for name in ("u3_w12_first_mentions", "p39_lockfiles", "p39_yarn"):
        assert "collect_list" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_packages_are_grouped_once_for_all_formats(spark):
    from lurewatch.plans.supply_queries import _RENDER, _rendered

    files = _rendered(spark, "/root/testdata/sf0.001")
    assert files._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert {r.filename.rpartition("/")[2] for r in files.collect()} == set(_RENDER)


def test_lines_of_whole_files_are_not_sorted(spark, tmp_path, monkeypatch):
    """Without files that are split, no line goes through a sort over all files, and a branch reads its format alone."""
    monkeypatch.setattr(lockfiles, "numbered", None)
    for i in range(3):
        (tmp_path / f"{i}").mkdir()
        for name in ("yarn.lock", "go.sum"):
            (tmp_path / f"{i}" / name).write_text("\n".join(f"{name} {i} {k}" for k in range(50)))
    lines = lockfiles.read_lines(spark, str(tmp_path))
    got = [(r.filename, r.raw) for r in sorted(lines.collect(), key=lambda r: (r.filename, r.pos))]
    assert got == [(f"{i}/{name}", f"{name} {i} {k}") for i in range(3) for name in ("go.sum", "yarn.lock") for k in range(50)]
    assert "PartitionFilters: [isnotnull(format" in lines.where("format = 'yarn'")._jdf.queryExecution().executedPlan().toString()


def test_first_value_is_carried_over_chunks(spark):
    lines = spark.range(2_000).selectExpr("'f' AS filename", "id AS pos", "CASE WHEN id % 700 = 650 THEN id END AS x")
    out = lockfiles.carry_over(lines, 100, firsts=("first",), first=lines["x"], last=lines["x"])
    got = [(r.first, r.last) for r in out.orderBy("pos").collect()]
    assert got == [(650 if i > 650 else None, 1350 if i > 1350 else 650 if i > 650 else None) for i in range(2_000)]
