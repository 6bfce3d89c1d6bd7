"""Archives read in pieces."""

import io
import json
import random
import tarfile
import zipfile

import pytest

from lurewatch.sources import archives, feeds


def cut(data, rng):
    while data:
        n = rng.randint(1, 9)
        yield data[:n]
        data = data[n:]


def test_entries_of_any_pieces():
    rng = random.Random(4)
    value = lambda depth: rng.choice([1, -2.5e3, 10**20, None, True, "a\\\"b]},é€😀", "", [], {}] + ([[value(depth - 1) for _ in range(3)], {f"k{i}\"": value(depth - 1) for i in range(3)}] if depth else []))
    for _ in range(150):
        items = [value(3) for _ in range(rng.randint(0, 6))]
        for document in (items, {f"key {i} ü": x for i, x in enumerate(items)}):
            data = json.dumps(document, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5).encode()
            assert [json.loads(x) for _, x in archives.entries(cut(data, rng))] == items
            nested = json.dumps({"a": 1, "p": {"x": [], "q": document, "q2": [1]}, "z": {"q": 5}}).encode()
            got = list(archives.entries(cut(nested, rng), ("p", "q")))
            assert [json.loads(x) for _, x in got] == items and [k for k, _ in got] == (list(document) if isinstance(document, dict) else [None] * len(items))
    for broken in (b"", b"[1, 2", b"{\"a\" 1}", b"[1 2]", b"7", b'{"a":'):
        with pytest.raises((ValueError, KeyError)):
            list(archives.entries(cut(broken, rng)))


def test_lines_of_any_pieces():
    rng = random.Random(5)
    for text in ("", "a", "a\n", "a\r\n\nbü\n", "\n\n", "x" * 50 + "\r\ny"):
        assert list(archives.lines(cut(text.encode(), rng))) == [x.removesuffix("\r") for x in text.split("\n")][: text.count("\n") + (not text.endswith("\n") and text != "")]


def test_members_are_partitions_and_read_in_batches(spark, tmp_path):
    entry = lambda i: [{"url": f"http://h{i}.example/x", "dateadded": "2024-01-01", "tags": ["t"] if i % 2 else None}]
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"f{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(2):
                z.writestr(f"d/m{m}.json", json.dumps({str(i): entry(i) for i in range(m * 1000, m * 1000 + 1000)}))
    (tmp_path / "_ignored.zip").write_bytes(b"no archive")
    df = archives.read_archive(spark, str(tmp_path), "entries", rows="10", piece="100")
    assert df.rdd.getNumPartitions() == 4
    assert df.groupBy("archive", "member").count().count() == 4 and df.count() == 4000
    reader = archives.ArchiveReader({"path": str(tmp_path), "mode": "entries", "rows": "10", "piece": "4000"})
    sizes = [b.num_rows for b in reader.read(reader.partitions()[0])]
    assert max(sizes) <= 10 and sum(sizes) == 1000
    rows = feeds.read_feed(spark, str(tmp_path), "urlhaus_zip", "s").collect()
    assert len(rows) == 4000 and {r.tag for r in rows} == {"", "t"}


def test_tar_lines_and_broken_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "f.tar.gz", "w:gz") as t:
        for n, text in (("a.txt", "# c\nhttp://a\r\n"), ("b.txt", "! d\nhttp://b")):
            info = tarfile.TarInfo(n)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    got = [(r.member, r.nth, r.value) for r in archives.read_archive(spark, f"file://{tmp_path}/f.tar.gz").orderBy("member", "nth").collect()]
    assert got == [("a.txt", 0, "# c"), ("a.txt", 1, "http://a"), ("b.txt", 0, "! d"), ("b.txt", 1, "http://b")]
    (tmp_path / "g.tar.gz").write_bytes((tmp_path / "f.tar.gz").read_bytes()[:40])
    with pytest.raises(Exception, match="."):
        archives.read_archive(spark, str(tmp_path / "g.tar.gz")).count()


def test_small_plain_files_share_partitions(spark, tmp_path):
    """Many small files are as many tasks as asked for, each file whole in one of them; large ones are bounded by PART."""
    want = []
    for i in range(60):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "a.lock").write_text(json.dumps({"k": 0, "at": [i, i + 1]}))
        (tmp_path / f"{i}" / "b.lock").write_text(json.dumps([i]) if i % 7 else "[1,")
        want += [("a.lock", str(i)), ("a.lock", str(i + 1)), ("b.lock", str(i) if i % 7 else "1"), *([] if i % 7 else [("b.lock", None)])]
    options = {"at": json.dumps({"a.lock": ["at"]}), "lenient": "true"}
    df = archives.read_archive(spark, str(tmp_path), "entries", tasks="4", **options)
    assert df.rdd.getNumPartitions() in (4, 5)
    assert sorted(((r.member, r.value) for r in df.collect()), key=str) == sorted(want, key=str)
    parts = archives.ArchiveReader({"path": str(tmp_path), "tasks": "1"} | options).partitions()
    assert len(parts) == 1 and len({m for p in parts for m in p.members}) == 120
