"""Fixtures: how their rows meet."""

import contextlib
import io

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_events_meet_pages_by_a_key(spark):
    """Conditions on columns of both, as an explode gives one, make no product of events and pages."""
    for name in ("k9_memory_urls", "k9_memory_messages"):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            entry.queries()[name](spark, SF).explain()
        nested = [x for x in plan.getvalue().splitlines() if "NestedLoopJoin" in x or "CartesianProduct" in x]
        assert all("page_id" not in x and "Inner" not in x for x in nested), nested


def test_lists_are_made_once(spark):
    """Neither a message's urls nor a commit list is evaluated again in a filter below its explode."""
    from lurewatch.operators import messages, registries

    said = spark.createDataFrame([(1, "see http://a.com and b.org"), (2, "nothing"), (3, None)], "msg_id int, message string")
    lists = spark.createDataFrame([("g", "self-hosted", '[{"sha":"1"},{"id":"2"}]'), ("h", "github", "[]"), ("i", "github", "no"), ("k", "gitlab", None)], "git_url string, platform string, body string")
    diffs = spark.createDataFrame([("g", "1", ' [{"diff":"+a"}]'), ("g", "2", "[broken")], "git_url string, hash string, body string")
    urls, commits = messages.explode_urls(said), registries.read_commits(lists, diffs)
    assert [tuple(r) for r in urls.select("msg_id", "url_pos", "url").sort("url_pos").collect()] == [(1, 0, "http://a.com"), (1, 1, "b.org")]
    assert sorted((r.git_url, r.pos, r.hash, r["diff"]) for r in commits.collect()) == [("g", 0, "1", "+a\n"), ("g", 1, "2", "[broken")]
    for df in (urls, commits):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain()
        assert "Filter (size(" not in plan.getvalue() and "(size(" not in plan.getvalue()
