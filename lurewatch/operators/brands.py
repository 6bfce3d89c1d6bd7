"""Brand catalogue and brand impersonation of urls, by keyed equi joins and a check of each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..tables import written
from .messages import with_url_parts

# The brands used without a catalogue, aliases, common words, labels that are no brand's.
DEFAULT_BRANDS = [
    ("PayPal", ["paypal.com", "paypal.me"]), ("Google", ["google.com", "gmail.com"]), ("Microsoft", ["microsoft.com", "live.com", "office.com", "outlook.com"]),
    ("Apple", ["apple.com", "icloud.com"]), ("Amazon", ["amazon.com", "amazon.co.uk"]), ("Facebook", ["facebook.com", "meta.com"]), ("Instagram", ["instagram.com"]),
    ("X", ["x.com", "twitter.com"]), ("LinkedIn", ["linkedin.com"]), ("GitHub", ["github.com"]), ("Coinbase", ["coinbase.com"]), ("Binance", ["binance.com"]),
    ("MetaMask", ["metamask.io"]), ("Dropbox", ["dropbox.com"]), ("DocuSign", ["docusign.com"]), ("Adobe", ["adobe.com"]), ("Netflix", ["netflix.com"]),
    ("Ledger", ["ledger.com"]), ("T-Mobile", ["t-mobile.com"]), ("Barclays", ["barclays.co.uk", "barclays.com"]), ("Roblox", ["roblox.com"]), ("Airbnb", ["airbnb.com"]),
]
ALIASES = {"apple": ["appleid"], "facebook": ["fb"], "ledger": ["ledgr", "liveledgr"], "tmobile": ["t-mobile"]}
COMMON_WORDS = ("apple", "meta", "box", "x", "discoveryinc")
IGNORED_LABELS = ("www", "www1", "www2", "mail", "m", "web", "dev", "app")


def brand_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def brand_tokens(df: DataFrame) -> DataFrame:
    """Adds tokens and common_word to (brand, official_domains); brands without domains go."""
    labels = F.transform("official_domains", lambda d: t.ascii_lower(F.split(d, r"\.")[0]))
    own = F.concat(F.array(brand_key(F.col("brand"))), labels, F.transform(labels, brand_key))
    alias = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    extra = F.coalesce(F.try_element_at(alias, brand_key(F.col("brand"))), F.array().cast("array<string>"))
    tokens = F.array_sort(F.array_distinct(F.concat(F.filter(own, lambda x: F.length(x) >= 3), extra)))
    return df.where(F.size("official_domains") > 0).withColumn("tokens", tokens).withColumn("common_word", brand_key(F.col("brand")).isin(*COMMON_WORDS))


def default_brands(spark: SparkSession) -> DataFrame:
    """(brand_ord, brand, official_domains, tokens, common_word)."""
    rows = [(i, n, d) for i, (n, d) in enumerate(DEFAULT_BRANDS)]
    return brand_tokens(spark.createDataFrame(rows, "brand_ord int, brand string, official_domains array<string>"))


def with_learned(static: DataFrame, learned: DataFrame) -> DataFrame:
    """Static brands, then learned ones (brand, official_domains, ord) behind them."""
    offset = static.agg(F.coalesce(F.max("brand_ord") + 1, F.lit(0)).alias("o"))
    more = brand_tokens(learned).join(F.broadcast(offset)).withColumn("brand_ord", (F.col("ord") + F.col("o")).cast("int"))  # one row
    cols = ["brand_ord", "brand", "official_domains", "tokens", "common_word"]
    return static.select(cols).unionByName(more.select(cols))


def official_brand(parts: DataFrame, brands: DataFrame) -> DataFrame:
    """(url, brand_ord, brand): first brand in order whose official domain is the registrable one or ends the host."""
    labels = F.split("host", r"\.")
    # proper suffixes of the host, and the registrable domain
    suffixes = F.array_union(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array("registrable"))
    domains = brands.select("brand_ord", "brand", F.explode("official_domains").alias("domain"))
    met = parts.select("url", F.explode(suffixes).alias("domain")).join(domains, "domain")
    return met.groupBy("url").agg(F.min(F.struct("brand_ord", "brand")).alias("b")).select("url", "b.*")


def _grams(c: Column, n: int) -> Column:
    size = F.length(c) - (n - 1)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _label_has(label: Column, token: Column) -> Column:
    short = (label == token) | label.startswith(F.concat(token, F.lit("-"))) | label.endswith(F.concat(F.lit("-"), token))
    return F.when(F.octet_length(token) <= 4, short).otherwise(label.contains(token))


def _searched(parts: DataFrame) -> Column:
    return F.concat_ws(" ", F.split("registrable", r"\.")[0], F.coalesce("subdomain", F.lit("")), "path_query")


def _url_grams(text: Column) -> Column:
    return F.concat(*[_grams(text, n) for n in (5, 3, 2)])


#: Urls that tell how frequent a gram is; a poor guess costs time only.
COUNTED_URLS = 20_000
#: Bits of the filter that goes with the urls: 128 KB.
FILTER_BITS = 1 << 20


def rarest_grams(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(gram, token): each token under the one of its grams that the fewest of some texts (text) have.

    A text that holds the token holds the gram too. Grams have 5 letters, 3 for tokens of 3 or 4, and shorter tokens are their
    own gram.
    """
    length = F.length("token")
    grams = F.when(length >= 5, _grams(F.col("token"), 5)).when(length >= 3, _grams(F.col("token"), 3)).otherwise(F.array("token"))
    own = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(grams)).alias("gram"))
    seen = texts.limit(COUNTED_URLS).select(F.explode(F.array_distinct(_url_grams(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return own.join(seen, "gram", "left").groupBy("token").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")).select("gram", "token")


def gram_filter(index: DataFrame) -> Column:
    """Whether the column gram may be indexed, by FILTER_BITS bits that the indexed grams set: a bound, whatever the catalogue."""
    at = F.pmod(F.xxhash64("gram"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(at, 6).cast("int"), at.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = [0] * (FILTER_BITS // 64)
    for r in index.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits")).collect():  # as many as words at most
        words[r.word] = r.bits
    told = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")  # folded into one constant
    return F.getbit(F.get(told, word), bit) == 1


def token_matches(parts: DataFrame, brands: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """(url, brand_ord, token, in_label, in_subdomain, in_path): a token and a url meet on the token's rarest gram.

    Of a url's grams only those that may be indexed leave the scan. The filter lets all indexed grams pass, and grows less
    selective, not wrong, for very large catalogues. ``like`` are urls that tell how frequent grams are, by default ``parts``.
    """
    tokens = brands.select("brand_ord", F.explode("tokens").alias("token"))
    texts = (parts if like is None else like).select(_searched(parts).alias("text"))
    index = written(rarest_grams(tokens, texts).join(tokens, "token"), "grams")
    grams = parts.select("url", "registrable", "subdomain", "path_query", F.explode(_url_grams(_searched(parts))).alias("gram"))
    met = grams.where(gram_filter(index)).join(index, "gram")
    token, label = F.col("token"), F.split("registrable", r"\.")[0]
    in_sub = F.coalesce(F.exists(F.split("subdomain", r"\."), lambda x: _label_has(x, token)), F.lit(False))
    found = met.select("url", "brand_ord", "token", _label_has(label, token).alias("in_label"), in_sub.alias("in_subdomain"), F.col("path_query").contains(token).alias("in_path"))
    return found.where("in_label or in_subdomain or in_path").distinct()


def fold_typos(c: Column) -> Column:
    return F.translate(c, "0135@", "olesa")


def _deletions(c: Column) -> Column:
    """The string and all forms with one or two characters left out."""
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    once = drop(c)
    return F.array_distinct(F.concat(F.array(c), once, F.flatten(F.transform(once, drop))))


def typo_matches(parts: DataFrame, brands: DataFrame) -> DataFrame:
    """(url, brand_ord, domain_typo, subdomain_typo): labels within the edit distance of a token, met on deletion forms."""
    tokens = brands.select("brand_ord", F.explode("tokens").alias("token")).where(F.octet_length("token") >= 5)
    tokens = tokens.withColumn("folded_token", fold_typos(F.col("token"))).withColumn("form", F.explode(_deletions(F.col("folded_token"))))
    pieces = F.filter(F.split(F.coalesce("subdomain", F.lit("")), "[^A-Za-z0-9]"), lambda x: ~x.isin(*IGNORED_LABELS))
    labels = F.concat(F.array(F.struct(F.split("registrable", r"\.")[0].alias("label"), F.lit(True).alias("of_domain"))), F.transform(pieces, lambda x: F.struct(x.alias("label"), F.lit(False).alias("of_domain"))))
    asked = parts.select("url", F.explode(labels).alias("l")).select("url", "l.*").where(F.octet_length("label") >= 4).distinct()
    words = asked.select("label").distinct().withColumn("folded", fold_typos(F.col("label"))).withColumn("form", F.explode(_deletions(F.col("folded"))))
    met = words.join(tokens, "form").select("label", "folded", "brand_ord", "token", "folded_token").distinct().where("label != token")
    d = F.levenshtein("folded", "folded_token")
    near = F.when(F.col("folded") == F.col("folded_token"), True).when(F.octet_length("folded_token") <= 6, d == 1).otherwise(d <= 2)
    hit = met.where(near).select("label", "brand_ord").distinct()
    return asked.join(hit, "label").groupBy("url", "brand_ord").agg(F.max("of_domain").alias("domain_typo"), F.max(~F.col("of_domain")).alias("subdomain_typo"))


def brand_impersonation(urls: DataFrame, brands: DataFrame) -> DataFrame:
    """One row per distinct url: brand_score, brand_confidence, risk_level, matched_brand, official, hosting_provider, keywords."""
    parts = with_url_parts(urls.select("url").distinct())
    haystack = F.concat_ws(" ", "host", F.coalesce("subdomain", F.lit("")), "path_query")
    parts = parts.withColumn("keywords", t.contains_any(haystack, t.PHISHING_KEYWORDS))
    official = official_brand(parts, brands).select("url", F.col("brand").alias("official_brand"))
    # only urls of no official domain are matched further; a url's first matching token decides where it was found
    rest = parts.join(official, "url", "left_anti")
    first = token_matches(rest, brands, with_url_parts(urls.select("url").limit(COUNTED_URLS))).groupBy("url", "brand_ord").agg(F.min(F.struct("token", "in_label", "in_subdomain", "in_path")).alias("m")).select("url", "brand_ord", "m.*")
    both = first.join(typo_matches(rest, brands), ["url", "brand_ord"], "full").na.fill(False)
    c = both.join(brands.select("brand_ord", "brand", "common_word"), "brand_ord").join(parts.select("url", "keywords"), "url")
    kw, common = F.col("keywords"), F.col("common_word")
    typo_score = lambda flag: F.when(F.col(flag), F.when(kw, 65).otherwise(30)).otherwise(20)
    at_least = lambda flag, s: F.when(F.col(flag), s).otherwise(20)
    score = F.greatest(at_least("in_label", 50), at_least("in_subdomain", 60), at_least("in_path", 25), typo_score("domain_typo"), typo_score("subdomain_typo"))
    score = F.when(kw & common, F.greatest(score, F.lit(55))).when(kw, F.least(score + 20, F.lit(90))).when(common, F.least(score, F.lit(35))).otherwise(score)
    path_only = F.col("in_path") & ~(F.col("in_label") | F.col("in_subdomain") | F.col("domain_typo") | F.col("subdomain_typo"))
    c = c.withColumn("score", F.when(path_only, F.least(score, F.lit(35))).otherwise(score))
    best = c.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "brand_ord"))).where("place = 1").select("url", F.col("brand").alias("best_brand"), "score")
    base = F.when(F.col("hosting_provider").isNotNull() & kw, 55).otherwise(0)
    out = parts.join(official, "url", "left").join(best, "url", "left").withColumn("base", base)
    wins = F.coalesce(F.col("score") > F.col("base"), F.lit(False))
    by_score = lambda a, b, c_: F.when(F.col("score") >= 75, a).when(F.col("score") >= 45, b).otherwise(c_)
    is_official = F.col("official_brand").isNotNull()
    return out.select(
        "url", F.when(is_official, 5).when(wins, F.col("score")).otherwise(F.col("base")).cast("int").alias("brand_score"),
        F.when(is_official, 95).when(wins, by_score(85, 70, 55)).when(F.col("base") > 0, 70).otherwise(90).alias("brand_confidence"),
        F.when(is_official, "low").when(wins, by_score("high", "medium", "low")).when(F.col("base") > 0, "medium").otherwise("low").alias("risk_level"),
        F.coalesce("official_brand", F.when(wins, F.col("best_brand"))).alias("matched_brand"), is_official.alias("official"), "hosting_provider", "keywords",
    )
