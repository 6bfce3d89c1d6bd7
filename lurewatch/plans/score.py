"""The message scoring plan: every distinct url is judged once and joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import brands as b
from ..operators import messages as m
from ..operators import threats as th
from ..tables import written


def judge_urls(urls: DataFrame, threats: DataFrame, brands: DataFrame) -> DataFrame:
    """(url, url_risk, verdict, matched_brand, threat_source, url_flag) per distinct url; a threat hit skips the brand rules.

    The distinct urls are written once: every branch reads these, not the messages' urls again.
    """
    urls = written(urls.select("url").distinct(), "asked")
    hits = th.match_threats(urls, threats)
    told = F.concat(F.lit("known threat url: source="), "source", F.lit(" threat="), "threat_type", F.lit(" confidence="), F.coalesce(F.concat(F.lit("Some("), F.col("confidence").cast("string"), F.lit(")")), F.lit("None")))
    hits = hits.select("url", F.col("source").alias("threat_source"), told.alias("url_flag"))
    rest = urls.join(hits, "url", "left_anti")
    scored = b.brand_impersonation(rest, brands)
    none = F.lit(None).cast("string")
    by_brand = scored.select("url", F.col("brand_score").alias("url_risk"), m.url_verdict(F.col("official"), F.col("brand_score")).alias("verdict"), F.when(F.col("brand_score") > 0, F.col("matched_brand")).alias("matched_brand"), none.alias("threat_source"), none.alias("url_flag"))
    return by_brand.unionByName(hits.select("url", F.lit(100).alias("url_risk"), F.lit("bad").alias("verdict"), none.alias("matched_brand"), "threat_source", "url_flag"))


def score_messages(messages: DataFrame, threats: DataFrame, brands: DataFrame, assessments: DataFrame | None = None, memory: DataFrame | None = None, online: bool = False) -> DataFrame:
    """(msg_id, scores, overall_risk, decision, flags, summary, ...) of every message against snapshots of threats, brands and memory.

    ``memory`` has (msg_id, memory_exact, memory_similar, memory_adjustment); without it those parts are 0. ``assessments`` are
    as ``parse_assessments`` gives them; without them every message's assessment is missing. Urls are found once and written,
    each distinct one is judged once.
    """
    found = written(m.explode_urls(messages.select("msg_id", "message")).select("msg_id", "url_pos", "url"), "urls")
    judged = judge_urls(found, threats, brands)
    flags = F.transform(F.array_sort(F.collect_list(F.when(F.col("url_flag").isNotNull(), F.struct("url_pos", "url_flag")))), lambda x: x["url_flag"])
    reputation = found.join(judged, "url").groupBy("msg_id").agg(F.max("url_risk").alias("url_reputation"), flags.alias("url_flags"))
    df = m.score_signals(messages).join(reputation, "msg_id", "left")
    if assessments is None:
        scores = ("ai_phishing", "ai_injection", "ai_impersonation", "ai_risk", "ai_confidence")
        df = df.withColumns({c: F.lit(0) for c in scores}).withColumn("ai_flags", F.array().cast("array<string>")).withColumn("ai_missing", F.lit("no assessment"))
    else:
        df = m.join_assessments(df, assessments)
    if memory is None:
        df = df.withColumn("memory_exact", F.lit(False)).withColumn("memory_similar", F.lit(0))
        df = df.withColumn("memory_adjustment", F.lit(0))
    else:
        df = df.join(memory, "msg_id", "left")
    df = df.withColumn("memory_adjustment", F.coalesce("memory_adjustment", F.lit(0)))
    return m.message_flags(m.decide(m.overall_risk(m.fuse_scores(df), online)))
