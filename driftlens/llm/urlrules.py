"""URL filters: given host and path rules, and association rules mined from the urls that those decide.

Given rules are matched by key lookup: a url's host suffixes and path prefixes are compared with the rules'
(host, path), longest first. They label the urls they fit. FP-growth mines token combinations from those labels
(one transaction for each labelled url: its tokens and its verdict); rules ``tokens -> verdict`` are pruned by
support and confidence, and a rule that a shorter one with the same verdict and no less confidence covers
goes. An inverted index holds each rule under its rarest token: a url meets the rules of its tokens only,
and the index's other tokens are then tested in place. The rule with the highest confidence decides
(then more tokens, then the tokens' order); no rule: allow.

All of it runs on DataFrames and Spark ML in the JVM. No step brings together the rows of a common token:
the index has a rule under one token, and it is joined to urls by a broadcast only below Spark's own
threshold for a checked size.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no given rule and has no tokens;
repeated urls count each; without labelled urls nothing is mined and the rest is allowed; an empty table gives
an empty table; null ids pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import pick, stored


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The production rules.
RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
#: Tokens in a rule at most; with MIN_SUPPORT it bounds what mining can return.
MAX_TOKENS = 3
VERDICT = "verdict="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: HostRule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
    return host & F.startswith("path", F.lit(rule.path))


def given(urls: DataFrame, rules=RULES) -> DataFrame:
    """host, path, rule and rule_verdict; the longest rule that fits, by host then path, wins."""
    x = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    best = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(best):
        rule, verdict = F.when(fits(r), r.name).otherwise(rule), F.when(fits(r), r.verdict).otherwise(verdict)
    return x.withColumns({"rule": rule, "rule_verdict": verdict})


def tokens() -> Column:
    """Distinct tokens of host labels (with their place from the right) and path words; none for an empty host."""
    labels = F.reverse(F.split("host", r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    words = F.transform(F.filter(F.split("path", r"[/._-]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("path="), x))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(hosts, words)))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, anchor) from rows with tokens and verdict."""
    spark = labelled.sparkSession
    empty = "tokens array<string>, verdict string, confidence double, support double, anchor string"
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(VERDICT), "verdict")).alias("items"))
    if baskets.isEmpty():
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    said = F.get("consequent", F.lit(0))
    rules = model.associationRules.where(said.startswith(VERDICT) & (F.size("antecedent") <= max_tokens) & ~F.exists("antecedent", lambda x: x.startswith(VERDICT)))
    rules = rules.select(F.sort_array("antecedent").alias("tokens"), F.substring(said, len(VERDICT) + 1, 100).alias("verdict"), "confidence", "support")
    rules = stored(rules, "url-rules")
    # Pruning: a rule goes if one with a part of its tokens says the same as surely. Parts are looked up by key.
    n = F.size("tokens")
    parts = rules.select("tokens", "verdict", "confidence", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.shiftleft(F.lit(1), max_tokens) - 2), lambda m: subset(F.col("tokens"), m, max_tokens)), lambda x: (F.size(x) > 0) & (F.size(x) < n))).alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    covered = parts.join(shorter, "part").where((F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence"))).select("tokens", "verdict").distinct()
    kept = rules.join(covered, ["tokens", "verdict"], "left_anti")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    rarest = kept.select("tokens", "verdict", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    return stored(kept.join(rarest, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", "support", "anchor"), "url-index")


def subset(items: Column, mask: Column, most: int) -> Column:
    return F.array_compact(F.array(*[F.when((mask.bitwiseAND(1 << k) != 0) & (F.size(items) > k), F.get(items, F.lit(k))) for k in range(most)]))


def judged(pages: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of pages."""
    urls = given(pick(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    urls = stored(urls.select("page_id", "url", "host", "path", "rule", "rule_verdict", tokens().alias("tokens"), F.monotonically_increasing_id().alias("row")), "urls")
    index = mined(urls.where("rule_verdict is not null").select("tokens", F.col("rule_verdict").alias("verdict")), **mining)
    open_ = urls.where("rule_verdict is null")
    asked = open_.select("row", F.col("tokens").alias("own"), F.explode("tokens").alias("anchor"))
    met = asked.join(index, "anchor").where(F.size(F.array_except("tokens", "own")) == 0)
    # Per row the surest rule; rows are keys of one url each, so no group is large.
    best = met.groupBy("row").agg(F.max_by("verdict", F.struct("confidence", F.size("tokens"), "tokens", "verdict")).alias("mined_verdict"))
    return urls.join(best, "row", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "mined_verdict", F.lit("allow")).alias("verdict"))
