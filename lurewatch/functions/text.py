"""Column expressions for messages and urls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Patterns, phrases and word lists of the rules.
URL_PATTERN = r'https?://[^\s<>"]+|[a-zA-Z0-9][a-zA-Z0-9\-]*\.[a-zA-Z]{2,}(?:/[^\s<>"]*)?'
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
NUMBER_PATTERN = r"\b\d{4,}\b"
SECRET_PATTERN = r"(?i)(api[_-]?key|token|secret|password)[^a-zA-Z0-9]{0,10}[A-Za-z0-9_\-]{16,}"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,19}\b"
PHONE_PATTERN = r"\b\+?\d[\d\s().-]{7,}\d\b"
INJECTION_PHRASES = ("ignore previous instructions", "disregard previous instructions", "system prompt", "developer message", "jailbreak", "act as")
URGENCY_WORDS = ("urgent", "immediately", "suspended", "verify", "account", "credit")
PHISHING_KEYWORDS = ("login", "verify", "secure", "account", "password", "wallet", "payment", "invoice", "support", "update", "suspended", "recover")
TWO_PART_SUFFIXES = ("co.uk", "com.au", "co.za", "co.jp", "com.br")
HOSTING_DOMAINS = ("vercel.app", "netlify.app", "github.io", "pages.dev", "web.app", "firebaseapp.com", "replit.app", "glitch.me", "surge.sh", "ngrok-free.app", "qzz.io")
QUEUE_BRANDS = ("paypal", "google", "microsoft", "apple", "amazon", "facebook", "instagram", "coinbase", "binance", "metamask")
QUEUE_INTENT = ("login", "verify", "account", "password", "wallet", "payment")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def trimmed(c: Column) -> Column:
    """Without white space at either end (all of Unicode's)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _without_tail(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"[.,;)\]]+$", "")


def normal_url(c: Column) -> Column:
    return ascii_lower(_without_tail(c))


def without_scheme(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:http://)*(?:https://)*", "")


def normal_domain(c: Column) -> Column:
    return ascii_lower(F.regexp_extract(without_scheme(_without_tail(c)), r"(?s)^[^/:]*", 0))


def registrable_domain(host: Column) -> Column:
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, host).when(tail(2).isin(*TWO_PART_SUFFIXES), tail(3)).otherwise(tail(2))


def path_query(url: Column) -> Column:
    rest = without_scheme(_without_tail(url))
    return ascii_lower(F.regexp_extract(rest, r"(?s)/.*$", 0))


def normal_message(c: Column) -> Column:
    out = F.regexp_replace(F.lower(c), EMAIL_PATTERN, " <email> ")
    out = F.regexp_replace(out, NUMBER_PATTERN, " <num> ")
    return trimmed(F.regexp_replace(out, r"(?U)\s+", " "))


def redacted_message(c: Column) -> Column:
    out = F.regexp_replace(c, SECRET_PATTERN, "<secret>")
    return F.regexp_replace(F.regexp_replace(out, CARD_PATTERN, "<card>"), PHONE_PATTERN, "<phone>")


def hits(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(p).cast("int") for p in phrases])


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def secret_score(c: Column) -> Column:
    return F.when(c.rlike(SECRET_PATTERN), 85).otherwise(0)


def injection_score(c: Column) -> Column:
    return F.least(F.lit(100), hits(ascii_lower(c), INJECTION_PHRASES) * 35)


def urgency_score(c: Column) -> Column:
    return F.least(F.lit(80), hits(ascii_lower(c), URGENCY_WORDS) * 15)


def queue_priority(url: Column) -> Column:
    low = ascii_lower(url)
    brand, intent = contains_any(low, QUEUE_BRANDS), contains_any(low, QUEUE_INTENT)
    return F.when(brand & intent, 90).when(brand, 80).when(intent, 70).otherwise(50)


def whole_days(earlier: Column, later: Column) -> Column:
    """Whole periods of 24 hours, towards zero."""
    return ((F.unix_seconds(later) - F.unix_seconds(earlier)) / 86400).cast("bigint")
