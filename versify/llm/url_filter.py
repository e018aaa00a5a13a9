"""URL filter: rules first, then the ratio of two character language models.

A rule (host, path, verdict) fits a URL of its host or a subdomain whose path starts with the rule's; the
longest rule wins.  URLs without a rule are judged by two variable-order Markov models of the
characters of host and path, one of accepted and one of rejected URLs: the counts of up to four
characters of context, smoothed by Witten and Bell's rule, which falls back to a shorter
context by as much as the longer one was seen to vary.  A URL's score is the difference of the
log probabilities a character; the cut is the one that parts accepted from rejected URLs best
among a quarter of the labelled ones, kept out of the counts.

Labels: a URL is rejected if a word of its host is in ``terms``, accepted if no word is and no rule
blocks it; what only a rule blocks says nothing about its characters and is not learned from.

All of it is DataFrame expressions.  Counts of shorter contexts come from those of the longest, so each
character of a URL is dealt out once to be counted and once to be scored.

Edge cases: null URLs and URLs without :// have an empty host and path, no rule, and are allowed by
the method with score 0; without labels of both classes nothing is blocked by the method; repeated
rows get equal verdicts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versify.llm.common import keep, lower_ascii, table

#: The rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of a host that mark it as rejected for training.
TERMS = ("adult", "ads", "bet", "bets", "betting", "casino", "cheap", "escort", "gambling", "lottery", "pharma", "pills", "poker", "porn", "replica", "slots", "spam", "track", "tracker", "viagra", "xxx")
ORDER = 4
#: Fixed value: begins every URL, so that the first characters have a context.
BEGIN = "^"
ALPHABET = 256
BIN = 0.01


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def markov_log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) for (gram, yes, no): how often the last character followed the others in both classes."""
    chance = None
    found = []
    for k in range(order + 1):
        at = grams.where(F.length("gram") > k).groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        at = at.withColumn("context", F.expr(f"left(gram, {k})"))
        own = [F.sum(c).alias(f"n_{c}") for c in ("yes", "no")] + [F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}") for c in ("yes", "no")]
        at = at.join(at.groupBy("context").agg(*own), "context")
        if chance is None:
            at = at.withColumns({"low_yes": F.lit(1 / ALPHABET), "low_no": F.lit(1 / ALPHABET)})
        else:
            lower = chance.select(F.col("gram").alias("rest"), F.col("p_yes").alias("low_yes"), F.col("p_no").alias("low_no"))
            at = at.withColumn("rest", F.expr(f"right(gram, {k})")).join(lower, "rest")
        for c in ("yes", "no"):
            seen = F.col(f"n_{c}") + F.col(f"t_{c}")
            at = at.withColumn(f"p_{c}", F.when(seen > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"low_{c}")) / seen).otherwise(F.col(f"low_{c}")))
        chance = keep(at.select("gram", "p_yes", "p_no"), f"order{k}")
        found.append(chance)
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def best_cut(scored: DataFrame) -> float | None:
    """The score that parts (score, yes) best: most of accepted above plus rejected below, the middle of equal
    ones; None without both classes.  The histogram has a row for each hundredth of a score."""
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.partitionBy()
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(ever))
    gain = share("no") - share("yes")  # null without a class
    ranked = bins.select("bin", gain.alias("gain")).where("gain is not null")
    row = ranked.groupBy("gain").agg(F.min("bin").alias("low"), F.max("bin").alias("high")).orderBy(F.desc("gain")).first()
    return None if row is None or row["gain"] <= 0 else (row["low"] + row["high"]) / 2 * BIN


def url_verdicts(pages: DataFrame, rules=RULES, terms=TERMS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, judged = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), judged.alias("judged"), F.concat(F.lit(BEGIN), "host", "path").alias("s"))
    rejected = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*[F.lit(t) for t in terms]))
    urls = rows.where(F.length("s") > 1).groupBy("s").agg(F.first("host").alias("host"), F.first("judged").alias("judged"), F.count("*").alias("many"))
    label = F.when(rejected, 0).when(F.coalesce(F.col("judged"), F.lit("")) != "block", 1)
    urls = urls.select("s", "many", label.alias("yes"), F.substring(F.md5("s"), 1, 1).isin("0", "1", "2", "3").alias("out"))
    urls = keep(urls.withColumn("u", F.monotonically_increasing_id()), "urls")
    gram = F.expr(f"substring(s, greatest(i - {ORDER}, 1), i - greatest(i - {ORDER}, 1) + 1)")
    each = urls.withColumn("i", F.explode(F.sequence(F.lit(2), F.length("s"))))
    learned = F.when(~F.col("out"), F.col("many")).otherwise(0)
    grams = each.groupBy(gram.alias("gram")).agg(
        F.sum(F.when(F.col("yes") == 1, learned).otherwise(0)).alias("yes"), F.sum(F.when(F.col("yes") == 0, learned).otherwise(0)).alias("no")
    )
    ratios = markov_log_ratios(keep(grams, "grams"))
    scores = each.select("u", gram.alias("gram")).join(ratios, "gram").groupBy("u").agg(F.round(F.avg("ratio"), 6).alias("score"))
    scored = keep(urls.join(scores, "u").select("s", "yes", "out", "score"), "scores")
    cut = best_cut(scored.where("out and yes is not null").select("score", "yes"))
    score = F.coalesce("score", F.lit(0.0))
    verdict = F.lit("allow") if cut is None else F.when(F.col("score") < cut, "block").otherwise("allow")
    joined = rows.join(scored.select("s", "score"), "s", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("judged", verdict).alias("verdict"), score.alias("score"))


def op2_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_lm_ratio": op2_url_lm_ratio}
