"""URL filters: host and path rules, then a ratio of two character language models.

DataFrame functions only. The models are variable-order Markov models of
characters: the probability of a character after up to ORDER - 1 others is
interpolated with that after one fewer, weighted by how many different
characters followed (Witten-Bell). One model is counted over URLs that the
rules allow, the other over those they block. A URL without a rule is judged by
the difference of its two log-likelihoods per character, against a threshold
calibrated on rule-judged URLs that the models were not counted over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import Scratch

#: Characters of a gram: ORDER - 1 of context and the one predicted.
ORDER = 4
#: Characters that models tell apart; A-Z are lower-cased and all others count as OTHER. This bounds the
#: number of grams of n characters by (len(ALPHABET) + 2) ** n.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
OTHER, START = "·", "^"
#: One of so many rule-judged URLs is kept from the counts, for the threshold.
CALIBRATION = 5
#: Steps of the score per unit, for the threshold's histogram.
STEPS = 1000
#: Grams that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_GRAMS = 400_000
#: Decimals to which a score is rounded before it meets the threshold.
DECIMALS = 6


@dataclass(frozen=True)
class Rule:
    """A host, which stands for its subdomains too, and the start of a path."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path up to ? or #; both empty for null or without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, allow) of the longest rule that fits, else null. The list is for some hundreds of rules."""
    out = F.lit(None).cast("struct<rule: string, allow: boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allow"))).otherwise(out)
    return out


def normalised(url: Column) -> Column:
    """The URL as models see it: lower case, other characters as OTHER."""
    known = lower_ascii(F.coalesce(url, F.lit("")))
    return F.regexp_replace(known, r"[^a-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]", OTHER)


def grams(text: Column) -> Column:
    """Per character, the gram that ends with it; contexts that begin before the text hold START.

    The characters are made once, as an element of an array, as what a lambda
    takes from outside is computed again for each gram.
    """
    characters = F.split(F.concat(F.lit(START * (ORDER - 1)), text), "")
    each = lambda own: F.transform(F.sequence(F.lit(1), F.size(own) - (ORDER - 1)), lambda k: F.array_join(F.slice(own, k, ORDER), ""))
    made = F.element_at(F.transform(F.array(characters), each), 1)
    return F.when(F.length(text) > 0, made).otherwise(F.array().cast("array<string>"))


def log_ratios(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio): log p(accepted) - log p(rejected) of the last character of each wanted gram after the others.

    counted has gram, allow and n. Each order is one aggregation and one join
    over grams, whose number the alphabet bounds, not the pages.
    """
    out = wanted.select("gram").distinct()
    size = len(ALPHABET) + 1
    for side, allow in (("good", True), ("bad", False)):
        own = counted.where(F.col("allow") == allow)
        out = out.withColumn(side, F.lit(1.0 / size))
        for order in range(1, ORDER + 1):
            tail = F.expr(f"right(gram, {order})")
            counts = own.groupBy(tail.alias("tail")).agg(F.sum("n").cast("double").alias("c"))
            context = counts.groupBy(F.expr(f"left(tail, {order - 1})").alias("context")).agg(F.sum("c").alias("total"), F.count("*").cast("double").alias("kinds"))
            out = out.withColumn("tail", tail).withColumn("context", F.expr(f"left(right(gram, {order}), {order - 1})"))
            out = out.join(counts, "tail", "left").join(context, "context", "left")
            mixed = (F.coalesce("c", F.lit(0.0)) + F.col("kinds") * F.col(side)) / (F.col("total") + F.col("kinds"))
            out = out.withColumn(side, F.when(F.col("total").isNull(), F.col(side)).otherwise(mixed)).drop("c", "total", "kinds", "tail", "context")
    return out.select("gram", (F.log("good") - F.log("bad")).alias("ratio"))


def threshold(scored: DataFrame) -> int | None:
    """The cut, in whole steps, that tells allowed from blocked rows best; null where either is missing.

    scored has step and allow; a row is accepted from the cut on. Best is the
    greatest sum of the shares of allowed rows accepted and blocked rows
    rejected; of equal cuts, the least. The cut lies halfway between the steps
    that it parts. The histogram has a row per step.
    """
    steps = scored.groupBy("step").agg(F.sum(F.col("allow").cast("long")).alias("good"), F.sum((~F.col("allow")).cast("long")).alias("bad")).collect()
    good, bad = sum(r.good for r in steps), sum(r.bad for r in steps)
    if not good or not bad:
        return None
    best, below_good, below_bad, before = (-1, 0), 0, 0, None
    for row in sorted(steps, key=lambda r: r.step):
        gain = (good - below_good) * bad + below_bad * good
        if gain > best[0]:
            best = (gain, row.step if before is None else (before + row.step + 1) // 2)
        below_good, below_bad, before = below_good + row.good, below_bad + row.bad, row.step
    return best[1]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score, a row per row of ``pages``, which needs page_id and url.

    score is null for URLs without characters; without a rule they are blocked,
    as nothing speaks for them. Where the rules allow or block nothing, no
    model can be counted and other URLs are blocked. Repeated rows and null ids
    give a result each; equal URLs have equal results.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url").cast("string").alias("url")).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("held", F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % CALIBRATION == 0)
    urls = judged.groupBy("url").agg(F.count("*").alias("n"), F.first(F.col("found.allow")).alias("allow"), F.first("held").alias("held"))
    # The number of partitions is given, as Spark would gather what is small here and large once its grams are made;
    # dealt by a key, the exchange of the aggregation would do, and that is gathered.
    urls = urls.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = scratch.keep(urls.withColumn("grams", grams(normalised(F.col("url")))), "urls")
    each = urls.select("url", "n", "allow", "held", F.explode("grams").alias("gram"))
    counted = scratch.keep(each.where("allow is not null and not held").groupBy("gram", "allow").agg(F.sum("n").alias("n")), "counts")
    ratios = scratch.keep(log_ratios(counted, each), "ratios")
    small = ratios.count() <= BROADCAST_GRAMS
    scores = each.join(F.broadcast(ratios) if small else ratios, "gram").groupBy("url").agg(F.round(F.avg("ratio"), DECIMALS).alias("score"))
    scores = scratch.keep(urls.select("url", "n", "allow", "held").join(scores, "url", "left"), "scores")
    calibration = scores.where("held and allow is not null and score is not null").select("allow", F.floor(F.col("score") * STEPS).alias("step"))
    cut = threshold(calibration)
    accepted = F.floor(F.col("score") * STEPS) >= cut if cut is not None else F.lit(False)
    allow = F.coalesce(F.col("found.allow"), accepted, F.lit(False))
    out = judged.join(scores.select("url", "score"), judged["url"].eqNullSafe(scores["url"]), "left")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), "score")
