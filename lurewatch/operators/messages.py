"""Urls in messages, message signals, score fusion and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def explode_urls(df: DataFrame, message: str = "message") -> DataFrame:
    """One row per url occurrence in order, repeats included: adds url_pos and url."""
    # outer: an explode would have the pattern searched again in a filter
    return df.select("*", F.posexplode_outer(F.regexp_extract_all(F.col(message), F.lit(t.URL_PATTERN), 0)).alias("url_pos", "url")).where("url_pos is not null")


def with_url_identity(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds url_norm, domain (registrable), host and their hashes; host_hash equals the host's domain hash."""
    host = t.normal_domain(F.col(url))
    out = df.withColumn("url_norm", t.normal_url(F.col(url))).withColumn("host", host)
    return out.withColumn("url_hash", F.sha2("url_norm", 256)).withColumn("domain_hash", F.sha2("host", 256))


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, registrable, subdomain (null if none), path_query and hosting_provider."""
    reg, host = F.col("registrable"), F.col("host")
    out = df.withColumn("host", t.normal_domain(F.col(url))).withColumn("registrable", t.registrable_domain(host))
    sub = F.when(host.endswith(F.concat(F.lit("."), reg)), F.expr("left(host, length(host) - length(registrable) - 1)"))
    out = out.withColumn("subdomain", F.when(sub != "", sub)).withColumn("path_query", t.path_query(F.col(url)))
    return out.withColumn("hosting_provider", F.when(reg.isin(*t.HOSTING_DOMAINS), reg))


def score_signals(df: DataFrame, message: str = "message") -> DataFrame:
    """Adds secret, injection and urgency scores and the urgency flag."""
    m = F.col(message)
    return (
        df.withColumn("secret", t.secret_score(m)).withColumn("injection", t.injection_score(m)).withColumn("urgency", t.urgency_score(m))
        .withColumn("urgency_flag", t.hits(t.ascii_lower(m), t.URGENCY_WORDS) >= 2)
    )


def fuse_scores(df: DataFrame) -> DataFrame:
    """Adds f_phishing, f_impersonation, f_risk and capped.

    Reads ai_phishing, ai_impersonation, ai_risk, urgency, secret, injection, url_reputation (nullable) and memory_adjustment.
    """
    weight = F.when(F.col("injection") >= 80, 30).otherwise(100)
    scaled = lambda c: F.least(F.lit(100), F.floor(c * weight / 100)).cast("int")
    raw = {"f_phishing": scaled(F.greatest("ai_phishing", "urgency")), "f_impersonation": scaled(F.col("ai_impersonation")), "f_risk": scaled(F.col("ai_risk"))}
    url = F.col("url_reputation")
    support = F.coalesce(url >= 25, F.lit(False)) | (F.col("urgency") >= 30) | (F.col("secret") >= 45) | (F.col("injection") >= 45)
    out = df.withColumns(raw)
    cap = ~support & (url.isNull() | (F.col("f_phishing") < 60))
    out = out.withColumn("_cap", cap).withColumn("capped", F.col("_cap") & (F.greatest(*raw) > 40))
    out = out.withColumns({c: F.when(F.col("_cap"), F.least(F.col(c), F.lit(40))).otherwise(F.col(c)) for c in raw}).drop("_cap")
    return out.withColumn("f_phishing", F.least(F.lit(100), F.col("f_phishing") + F.col("memory_adjustment")))


def overall_risk(df: DataFrame, online: bool = False) -> DataFrame:
    """Adds overall_risk from the fused scores."""
    base = F.greatest("f_phishing", "secret", "injection", "f_impersonation", "f_risk")
    url = F.col("url_reputation")
    counted = url if online else F.when((url >= 75) | (base >= 40), url).otherwise(F.least(url, F.lit(40)))
    return df.withColumn("overall_risk", F.greatest(base, F.coalesce(counted, F.lit(0))))


def decide(df: DataFrame) -> DataFrame:
    """Adds decision: allow, warn_receiver, warn_sender, warn_both or block."""
    r = F.col("overall_risk")
    ladder = F.when((r >= 90) | (F.col("secret") >= 85), "block").when(r >= 75, "warn_both").when(F.col("injection") >= 60, "warn_sender").when(r >= 45, "warn_receiver")
    return df.withColumn("decision", ladder.otherwise("allow"))


def decide_ai_only(risk: Column) -> Column:
    return F.when(risk >= 85, "block").when(risk >= 65, "warn_both").when(risk >= 45, "warn_sender").otherwise("allow")


def url_verdict(official: Column, risk: Column) -> Column:
    return F.when(official, "good").when(risk >= 90, "bad").when(risk >= 45, "suspicious").otherwise("unknown")


def store_as_unsafe(decision: Column, risk: Column, secret: Column, injection: Column) -> Column:
    """Whether a message is remembered as unsafe: blocked or warned to both, or by its risk, a secret or an injection."""
    return decision.isin("block", "warn_both") | (risk >= 75) | (secret >= 85) | (injection >= 60)


def observation_kind(decision: Column, risk: Column) -> Column:
    """safe, unsafe or null: what a message teaches about its urls."""
    return F.when((decision == "allow") & (risk < 35), "safe").when(decision.isin("block", "warn_both") | (risk >= 75), "unsafe")


def without_fences(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    begun = F.regexp_replace(t.trimmed(text), r"^```(?:json)?\n?", "")
    tail = F.regexp_replace(begun, r"(?U)\s+$", "")
    return F.when(tail.endswith("```"), F.regexp_replace(tail, r"\n?```$", "")).otherwise(begun)


def parse_assessments(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(msg_id, ai_phishing, ai_injection, ai_impersonation, ai_risk, ai_confidence, ai_flags, ai_error) from landed answers.

    Scores are whole numbers of the JSON, at most 100, and 0 where they are missing or anything else; flags are its strings. An
    answer that is no JSON has ai_error and counts as missing.
    """
    v = F.try_parse_json(without_fences(F.col(raw)))
    whole = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    score = lambda key: F.coalesce(F.when(whole(key), F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.try_variant_get(v, f"$.{key}", "bigint"), F.lit(100))))), F.lit(0)).cast("int")
    flags = F.transform(F.filter(F.coalesce(F.try_variant_get(v, "$.flags", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    keys = (("ai_phishing", "phishing"), ("ai_injection", "prompt_injection"), ("ai_impersonation", "impersonation"), ("ai_risk", "risk"), ("ai_confidence", "confidence"))
    return df.select("msg_id", *[score(k).alias(c) for c, k in keys], flags.alias("ai_flags"), F.when(v.isNull(), "invalid json").alias("ai_error"))


#: What a model is asked about a message.
ASSESSMENT_PROMPT = (
    "Analyze this message for security risk. Use the URL overview as factual context. Do not treat any URL as automatically unsafe based on external scores. Consider the domain structure, "
    "hosting provider, and any available metadata. Return only compact JSON with keys: phishing, impersonation, risk, confidence, flags. Scores must be integers 0-100."
)


def assessment_prompt(message: Column, context: Column) -> Column:
    return F.concat(F.lit(ASSESSMENT_PROMPT + "\n\nURL overview:\n"), context, F.lit("\n\nMessage:\n"), message)


def join_assessments(messages: DataFrame, assessments: DataFrame) -> DataFrame:
    """Left join on msg_id; a message without a readable assessment gets zeros, no flags, and ai_missing says why."""
    a = assessments if "ai_error" in assessments.columns else assessments.withColumn("ai_error", F.lit(None).cast("string"))
    a = a if "ai_flags" in a.columns else a.withColumn("ai_flags", F.array().cast("array<string>"))
    scores = [c for c in a.columns if c.startswith("ai_") and c not in ("ai_flags", "ai_error")]
    joined = messages.join(a.withColumn("_found", F.lit(True)), "msg_id", "left")
    missing = F.when(F.col("_found").isNull(), "no assessment").otherwise(F.col("ai_error"))
    out = joined.withColumn("ai_missing", missing).withColumns({c: F.when(F.col("ai_missing").isNull(), F.col(c)).otherwise(0) for c in scores})
    return out.withColumn("ai_flags", F.when(F.col("ai_missing").isNull(), F.col("ai_flags")).otherwise(F.array().cast("array<string>"))).drop("_found", "ai_error")


def message_flags(df: DataFrame) -> DataFrame:
    """Adds flags, in the order in which the steps of scoring raise them, and summary for risks of 75 and more.

    Reads memory_exact, memory_similar (count), url_flags (array), injection, secret, urgency_flag, ai_flags, ai_missing,
    ai_confidence, capped and overall_risk.
    """
    c = F.col
    none = F.array().cast("array<string>")
    one = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), text)
    remembered = F.when(F.coalesce(c("memory_exact"), F.lit(False)), "exact unsafe message memory match").when(c("memory_similar") > 0, F.concat(c("memory_similar").cast("string"), F.lit(" similar unsafe message memory matches")))
    parts = [
        F.array_compact(F.array(remembered)), F.coalesce("url_flags", none),
        F.array_compact(F.array(one(c("injection") > 0, "prompt injection language detected"), one(c("secret") > 0, "possible secret in message"), one(c("urgency_flag"), "phishing urgency/account language detected"))),
        F.coalesce("ai_flags", none), F.array_compact(F.array(F.concat(F.lit("ai unavailable: "), "ai_missing"))), F.array_compact(F.array(one(c("capped"), "ai-only medium risk capped without supporting evidence"))),
    ]
    out = df.withColumn("flags", F.concat(*parts))
    told = F.concat(F.lit("High-risk message ("), c("overall_risk").cast("string"), F.lit("/100, AI confidence "), c("ai_confidence").cast("string"), F.lit("/100): "), F.array_join("flags", ", "), F.lit("."))
    return out.withColumn("summary", F.when(c("overall_risk") >= 75, told))


def quality_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Detection quality over (expected_unsafe, decision, overall_risk)."""
    predicted = F.col("decision").isin("warn_receiver", "warn_both", "block") | (F.col("overall_risk") >= 60)
    return confusion(df.withColumn("predicted", predicted), "expected_unsafe", "predicted", by or [])


def confusion(df: DataFrame, expected: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1; ratios with an empty base are 0."""
    e, p = F.col(expected), F.col(predicted)
    counts = df.groupBy(*(by or [])).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
