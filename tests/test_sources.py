"""Feed formats: small landed files, read back."""

import gzip
import io
import itertools
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lurewatch import files
from lurewatch.sources import feeds, versions

HAUS = {"1": [{"url": "http://a.example/x", "dateadded": "2024-01-01", "last_online": None, "urlhaus_link": "l", "tags": ["t1", "t2"]}], "2": [{"url": "http://b.example/y", "tags": None}]}


def values(df):
    return sorted((r.value, r.indicator_type, r.tag) for r in df.collect())


CASES = {
    "urlhaus_json": (json.dumps(HAUS), [("http://a.example/x", "url", "t1"), ("http://a.example/x", "url", "t2"), ("http://b.example/y", "url", "")]),
    "phishunt": (json.dumps([{"url": "u", "company": "c", "country": None, "asn": ""}]), [("u", "url", "c")]),
    "string_array": (json.dumps(["x", "", "y"]), [("x", "url", ""), ("y", "url", "")]),
    "block_fuzzy": (json.dumps({"blacklist": ["a.example"], "fuzzylist": ["b.example"]}), [("a.example", "domain", "blacklist"), ("b.example", "domain", "fuzzylist")]),
    "tweetfeed": (json.dumps([{"type": "ip", "value": "1.2.3.4", "tags": ["#x"]}, {"type": "md5", "value": "z"}, {"value": "w"}]), [("1.2.3.4", "ip", "#x"), ("w", "url", "")]),
    "detected_urls": (json.dumps({"detected_urls": ["d.example"]}), [("d.example", "domain", "")]),
    "misp": (json.dumps({"Event": {"Attribute": [{"type": "ip-dst", "value": "1.1.1.1", "comment": "confidence level: 75%"}, {"type": "md5", "value": "z"}]}}), [("1.1.1.1", "ip", "")]),
    "hosts": ("# c\n0.0.0.0 a.example\n127.0.0.1 b.example\n::1 c\n", [("a.example", "domain", ""), ("b.example", "domain", "")]),
    "plain": ("# c\n! d\n\nhttp://a\n", [("http://a", "url", "")]),
    "viriback_csv": ("Family,URL,IP,FirstSeen\nfam,http://c2,1.1.1.1,2024-01-02\n", [("http://c2", "url", "fam")]),
    "adguard": ("! x\n||ads.example^\n/path\n", [("ads.example", "domain", "")]),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_format(spark, tmp_path, kind):
    text, want = CASES[kind]
    (tmp_path / "f").write_text(text)
    assert values(feeds.read_feed(spark, str(tmp_path / "f"), kind, "s")) == sorted(want)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("m.json", json.dumps(HAUS))
    assert len(values(feeds.read_feed(spark, str(tmp_path / "f.zip"), "urlhaus_zip", "s"))) == 3
    with tarfile.open(tmp_path / "f.tar.gz", "w:gz") as t:
        data = b"# c\nhttp://a\n"
        info = tarfile.TarInfo("m.txt")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    assert values(feeds.read_feed(spark, str(tmp_path / "f.tar.gz"), "targz", "s")) == [("http://a", "url", "")]
    (tmp_path / "p.json.gz").write_bytes(gzip.compress(json.dumps([{"url": "u", "target": "t"}]).encode()))
    assert values(feeds.read_feed(spark, str(tmp_path / "p.json.gz"), "phishtank_gz", "s")) == [("u", "url", "t")]


def test_misp_confidence(spark, tmp_path):
    (tmp_path / "f").write_text(CASES["misp"][0])
    assert feeds.read_feed(spark, str(tmp_path / "f"), "misp", "s").first().confidence == 75


def test_lists(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,A.example\nx,b\n2,c.example\n")
    assert [tuple(r) for r in feeds.read_rank_list(spark, str(tmp_path / "r.csv"), 1).collect()] == [(1, "a.example")]
    (tmp_path / "m.json").write_text(json.dumps({"b": ["https://www.b.example/x"], "a": ["a.example"]}))
    assert [(r.brand_ord, r.brand, r.official_domains) for r in feeds.read_brand_catalog(spark, str(tmp_path / "m.json")).orderBy("brand_ord").collect()] == [(0, "a", ["a.example"]), (1, "b", ["b.example"])]
    (tmp_path / "l.json").write_text(json.dumps([{"name": "z", "domains": ["z.example"]}]))
    assert feeds.read_brand_catalog(spark, str(tmp_path / "l.json")).first().official_domains == ["z.example"]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.json").write_text(json.dumps([{"name": "B", "domains": []}, {"name": "A", "domains": []}]))
    (tmp_path / "two" / "a.json").write_text(json.dumps([{"name": "Z", "domains": []}]))
    (tmp_path / "two" / "m1.json").write_text(json.dumps({"k": [], "c": []}))
    (tmp_path / "two" / "m0.json").write_text(json.dumps({"d": []}))
    assert [(r.brand_ord, r.brand) for r in feeds.read_brand_catalog(spark, str(tmp_path / "two")).orderBy("brand_ord").collect()] == [*enumerate("cdkZBA")]
    (tmp_path / "h.json").write_text(json.dumps({"a": ["f" * 64, "short"]}))
    assert feeds.read_favicon_hashes(spark, str(tmp_path / "h.json")).count() == 1


def test_cases_are_read_in_the_order_of_their_lines(spark, tmp_path):
    case = lambda n, **more: json.dumps({"id": n, "expected_unsafe": n > "m", "message": f"m {n}"} | more)
    (tmp_path / "c.jsonl").write_text("\n".join(["# head", case("z"), "", case("b"), " " + case("y"), "# note", case("a"), case("x", id=5), "{broken"]))
    ids = lambda *a: [r.id for r in feeds.read_cases(spark, str(tmp_path / "c.jsonl"), *a).collect()]
    assert sorted(ids(0, 4)) == ["a", "b", "y", "z"] and sorted(ids(1, 2)) == ["b", "y"] and ids(3, 1) == ["a"] and ids(9, 1) == []
    for bad in (4, 5):
        with pytest.raises(Exception, match="no id in case"):
            ids(bad, 1)


def test_replace_keeps_other_sources(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda *r: {"threats": spark.createDataFrame(list(r), "value string, source string"), "tags": spark.createDataFrame([(v + "!", s) for v, s in r], "value string, source string")}
    now = lambda: [sorted((r.value, r.source) for r in versions.read(spark, root, t, "value string, source string").collect()) for t in ("threats", "tags")]
    assert now() == [[], []]
    versions.replace(spark, root, rows(("a", "s1"), ("b", "s/2 =ü")), ["s1", "s/2 =ü"])
    versions.replace(spark, root, rows(("new", "s1"), ("other", "not loaded")), ["s1"])
    assert now() == [[("b", "s/2 =ü"), ("new", "s1")], [("b!", "s/2 =ü"), ("new!", "s1")]]
    versions.replace(spark, root, rows(), ["s1"])
    assert now() == [[("b", "s/2 =ü")], [("b!", "s/2 =ü")]]
    assert len(versions.vacuum(spark, root)) == 1 and now() == [[("b", "s/2 =ü")], [("b!", "s/2 =ü")]]


def test_a_crash_between_any_two_steps_leaves_old_or_new_rows(spark, tmp_path, monkeypatch):
    calls = {"write": files.write, "move_over": files.move_over, "names": files.names}
    for name, old, after in itertools.product(calls, (True, False), (True, False)):
        root = str(tmp_path / f"{name}-{old}-{after}")
        rows = lambda v: {"threats": spark.createDataFrame([(v, "s")], "value string, source string"), "tags": spark.createDataFrame([(v, "s")], "value string, source string")}
        if old:
            versions.replace(spark, root, rows("old"), ["s"])

        def crash(*a, real=calls[name], after=after):
            if after:
                real(*a)
            raise OSError("lost")

        with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
            m.setattr(files, name, crash)
            versions.replace(spark, root, rows("new"), ["s"])
        got = [[r.value for r in versions.read(spark, root, t, "value string, source string").collect()] for t in ("threats", "tags")]
        assert got[0] == got[1] and got[0] in ([["old"]] if old else [[]]) + [["new"]]
        assert (got[0] == ["new"]) == (name == "move_over" and after)
        versions.replace(spark, root, rows("again"), ["s"])
        versions.vacuum(spark, root)
        assert [r.value for r in versions.read(spark, root, "tags", "value string, source string").collect()] == ["again"]
