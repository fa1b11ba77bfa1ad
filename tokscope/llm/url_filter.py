"""URL filter: host rules, and association rules mined by FP-growth for the rest.

URLs become sets of tokens (host labels, path segments, query keys). Spark's
FP-growth mines token combinations of labelled URLs; rules ``tokens =>
blocked`` are pruned by confidence and support and, where a shorter rule is as
confident, dropped. Rules are applied by inverted index: each rule stands under
its rarest token, pages look their tokens up there, and only those
candidates are compared with the whole rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokscope.llm.common import ascii_lower, written

#: Host rules of the result contract: host and path, verdict.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_BLOCKED = "=blocked"
#: Mined rules up to this number are broadcast (a rule has few tokens); more are joined by a shuffle.
MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class MiningOptions:
    min_support: float = 0.002
    min_confidence: float = 0.8
    #: A rule needs at least this many blocked URLs, however small the labelled set is.
    min_count: int = 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule whose host or parent domain and path prefix fit; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` host labels, ``p:`` path segments (digits as #), ``q:`` query keys."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.lower(F.substring_index(x, "=", 1))))
    return F.array_distinct(F.concat(labels, parts, keys))


def mine_rules(labelled: DataFrame, options: MiningOptions = MiningOptions()) -> DataFrame:
    """Rules ``rule_tokens, confidence, support`` from rows of ``tokens`` (array) and ``blocked`` (boolean).

    Token sets are mined whole. FP-growth itself first drops tokens below the
    support over all rows, which bounds what is left of long sets and changes no rule.
    """
    spark = labelled.sparkSession
    schema = "rule_tokens array<string>, confidence double, support double"
    items = labelled.filter(F.col("blocked").isNotNull() & (F.size("tokens") > 0))
    items = items.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(_BLOCKED))).otherwise(F.col("tokens")).alias("items"))
    items = written(items, "url-items")
    n = items.count()
    if not n:
        return spark.createDataFrame([], schema)
    support = max(options.min_support, min(1.0, options.min_count / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=options.min_confidence).fit(items)
    rules = model.associationRules.filter(F.array_contains("consequent", _BLOCKED))
    rules = written(rules.select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support"), "url-rules")
    # A rule is dropped if a shorter one within it is as confident.
    other = rules.select(F.col("rule_tokens").alias("less"), F.col("confidence").alias("c"), F.explode("rule_tokens").alias("token"))
    within = rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("token")).join(other, "token")
    within = within.filter((F.size("less") < F.size("rule_tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("less", "rule_tokens")) == 0))
    return rules.join(within.select("rule_tokens").distinct(), "rule_tokens", "left_anti")


def match_rules(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` of the rows of ``key, tokens`` that some rule fits."""
    rules = written(rules.select(F.monotonically_increasing_id().alias("rule_id"), "rule_tokens"), "url-rule-ids")
    count = rules.count()
    exploded = pages.select(key, "tokens", F.explode("tokens").alias("token"))
    if not count:
        return exploded.select(key).limit(0)
    listed = rules.select("rule_id", "rule_tokens", F.explode("rule_tokens").alias("token"))
    hits = listed.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rarest = Window.partitionBy("rule_id").orderBy("uses", "token")
    index = listed.join(hits, "token").withColumn("r", F.row_number().over(rarest)).filter("r = 1").select("token", "rule_tokens")
    index = F.broadcast(index) if count <= MAX_BROADCAST_RULES else index
    return exploded.join(index, "token").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0).select(key).distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules=HOST_RULES, options: MiningOptions = MiningOptions()) -> DataFrame:
    """Verdict for every row of ``page_id, url``: ``page_id, host, path, rule, verdict, mined``.

    The longest fitting host rule decides; without one, the URL is blocked if
    a mined rule fits and allowed otherwise. ``labels`` (``doc_id, quality``, optionally
    ``toxic``) label the page with the same id: blocked are quality 0 or toxic 1.

    Edge cases: a null URL or one without ``://`` has empty host and path, no
    rule, and is allowed. Null ids carry no label. Repeated rows are judged
    each. Without labels no rule is mined. Empty tables give an empty result.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    base = base.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    marked = labels.filter("quality is not null").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (toxic == 1)).alias("blocked"))
    marked = marked.groupBy("page_id").agg(F.bool_or("blocked").alias("blocked"))
    mined = mine_rules(base.join(marked, "page_id").select("tokens", "blocked"), options)
    # URLs with the same tokens are looked up once.
    base = base.withColumn("token_hash", F.xxhash64("tokens"))
    distinct = base.groupBy("token_hash").agg(F.any_value("tokens").alias("tokens"))
    hits = match_rules(distinct, mined, "token_hash").withColumn("hit", F.lit(True))
    out = base.join(hits, "token_hash", "left").withColumn("mined", F.coalesce("hit", F.lit(False)))
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    fallback = F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"), "mined")
