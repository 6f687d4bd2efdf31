"""URL filters (operator 2): a ratio of two character language models, under host and path rules.

Rules are looked up by the host's suffixes: a rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins. What the rules allow and block trains two variable-order Markov models over the characters of host and
path: the probability of a character is interpolated from its longest context of ORDER characters down to none, each order
weighing as much as it has been seen (p = (count + SMOOTH * shorter) / (context + SMOOTH)). The verdict of the other URLs
compares the length-normalised difference of log-likelihoods with a threshold, the one that best tells apart the URLs that
the rules decide (greatest sum of both classes' shares decided right).

Contexts are counted over all URLs and joined as a table of distinct ORDER + 1 grams.

Defined results: null URLs and those without :// have an empty host and path, no rule and, without characters, a score of 0,
which the threshold decides as any other; rows that repeat stay; rows without page_id are kept; without rule-decided URLs of
both classes every other URL is allowed; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, cut, table

ORDER, SMOOTH, ALPHABET, BINS = 4, 4.0, 256, 400
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PAD = "\x02"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit(PAD * ORDER), text)
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def _ratios(grams: DataFrame) -> DataFrame:
    """(gram, allow, block: counts) -> gram, ratio: log p(last character | rest) of the allowed less that of the blocked."""
    parts = grams.select("gram", "allow", "block", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("n"))
    parts = parts.withColumn("sub", F.substring(F.col("gram"), F.lit(ORDER + 2) - F.col("n"), F.col("n")))
    parts = cut(parts.withColumn("context", F.substring(F.col("sub"), F.lit(1), F.col("n") - F.lit(1))), "url-grams")
    seen = parts.groupBy("n", "sub").agg(F.sum("allow").alias("allow_c"), F.sum("block").alias("block_c"))
    ahead = parts.groupBy("n", "context").agg(F.sum("allow").alias("allow_n"), F.sum("block").alias("block_n"))
    levels = parts.select("gram", "n", "sub", "context").join(seen.hint("rebalance"), ["n", "sub"]).join(ahead.hint("rebalance"), ["n", "context"])
    levels = levels.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("n", "allow_c", "allow_n", "block_c", "block_n"))).alias("levels"))

    def log_p(kind: str) -> Column:
        step = lambda p, x: (x[f"{kind}_c"] + F.lit(SMOOTH) * p) / (x[f"{kind}_n"] + F.lit(SMOOTH))
        return F.log(F.aggregate("levels", F.lit(1.0 / ALPHABET), step))

    return levels.select("gram", (log_p("allow") - log_p("block")).alias("ratio"))


def _threshold(judged: DataFrame) -> float:
    """Of the scores of rule-decided URLs, put in bins: the bin's edge that tells the classes apart best."""
    low, high = judged.agg(F.min("score"), F.max("score")).first()
    if low is None or judged.select("verdict").distinct().count() < 2:
        return float("-inf")
    width = (high - low) / BINS or 1.0
    bins = judged.groupBy(F.floor((F.col("score") - low) / width).alias("bin")).agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block")])
    upto, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    right = F.coalesce(F.sum("block").over(upto), F.lit(0)) / F.sum("block").over(every) - F.coalesce(F.sum("allow").over(upto), F.lit(0)) / F.sum("allow").over(every)
    return low + width * bins.withColumn("right", right).orderBy(F.desc("right"), "bin").first()["bin"]


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log-likelihood ratio per character)."""
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    # one score for each distinct text
    texts = cut(rows.groupBy("text", F.col("found.verdict").alias("verdict")).agg(F.count("*").alias("pages")), "url-texts")
    spelt = texts.where("text <> ''").select("text", "verdict", "pages", F.explode(_grams(F.col("text"))).alias("gram"))
    counts = [F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("allow", "block")]
    ratios = cut(_ratios(spelt.groupBy("gram").agg(*counts)), "url-ratios")
    # merge: from the small file below it Spark would take the exploded side for small, and broadcast it
    scores = spelt.select("text", "gram").hint("merge").join(ratios, "gram").groupBy("text").agg(F.avg("ratio").alias("score"))
    scored = cut(texts.join(scores, "text", "left").select("text", "verdict", F.coalesce("score", F.lit(0.0)).alias("score")), "url-scores")
    least = _threshold(scored.where("verdict is not null and text <> ''"))
    # a text has one rule, so one row in scored
    held = rows.join(scored.select("text", "score"), "text")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= F.lit(least), F.lit("allow")).otherwise(F.lit("block")))
    return held.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))
