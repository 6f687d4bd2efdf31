"""Search of names among many candidates: an inverted index of words and letters, bounds on the score, verified pairs.

score = 0.4 * sorted words' ratio + 0.35 * word sets' ratio + 0.25 * best part's ratio, each at most 1, plus at most BONUS for
shared genres and country. A query asks for candidates whose score alone is at least s, its least confidence less BONUS: all that
can be found, or make the match ambiguous. Such a pair of spellings

- shares a word, and then 0.4 * r + 0.6 >= s for the sorted words' ratio r, which lengths bound by 2 * min / sum; or
- shares none, and then its sets' ratio is that of the sorted words (without repeats), so that 0.75 * r + 0.25 >= s. A ratio of r
  needs r * sum / 2 letters in common, counted as often as both have them. Each spelling is posted under the rarest of its
  letters, as many as leave too few of the rest: two that can reach r share one of these. Counts of common letters are checked
  before the score is, once for all spellings of the same letters.

Ratios are rounded to whole hundredths, which the bounds allow for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import SYMBOLS, least_confidence, plain, similarity_score
from lodestone.operators.written import write_once

# fixed values
GENRE_POINTS, MOST_GENRE_POINTS, COUNTRY_POINTS, CLOSE, SHOWN = 0.03, 0.1, 0.05, 0.05, 5
BONUS = MOST_GENRE_POINTS + COUNTRY_POINTS
#: Letters from rare to frequent; others count as rarer.
LETTERS = "zqxjkvbpygfwmucldrhsnioate "
#: The smallest s of any query: that of the longest names.
FLOOR = 0.75 - BONUS
#: Spellings or pairs of a task.
DEALT = 5000
FORM = "spelling string, form string, words array<string>, letters array<string>, n int"


def least_ratio(s: float) -> float:
    """The ratio that spellings without a common word need for a score of s."""
    return max(0.0, (s - 0.25) / 0.75 - 0.005)


def least_common(n: int, ratio: float) -> int:
    """Letters that a spelling of n letters needs in common with any other of that ratio."""
    return max(1, math.ceil(n * ratio / (2 - ratio) - 1e-9))


def _letters(form: str) -> list[str]:
    """Each letter with its count so far (a1, a2, ...), from rare to frequent."""
    seen: Counter[str] = Counter()
    out = []
    for c in form:
        seen[c] += 1
        out.append((-seen[c], LETTERS.find(c), c))
    return [f"{c}{-k}" for k, _, c in sorted(out)]


def forms_of(spelling: str) -> list[str]:
    """The plain and the symbol-free form, each with sorted words, with and without repeated ones."""
    told = []
    for text in (plain(spelling), plain("".join(SYMBOLS.get(c, c) for c in spelling))):
        words = text.split()
        told += [" ".join(sorted(words)), " ".join(sorted(set(words)))]
    return [t for t in dict.fromkeys(told) if t]


def _forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(s, f, sorted(set(f.split())), _letters(f), len(f)) for s in frame["spelling"] for f in forms_of(s)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FORM.split(", ")])


def spread_out(rows: DataFrame, label: str) -> DataFrame:
    """rows, written and dealt into tasks of about DEALT rows: small rows that cost much each would share few tasks by their bytes."""
    kept = write_once(rows, label)
    return kept.repartition(max(1, kept.count() // DEALT))


def forms(spellings: DataFrame) -> DataFrame:
    return spread_out(spellings.select("spelling").where("spelling IS NOT NULL").distinct(), "distinct-spellings").mapInPandas(_forms, FORM)


def candidate_pairs(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (query, spelling) that may score s or more. asked: spelling, s; named: spelling."""
    own = write_once(forms(asked).join(asked.select("spelling", "s"), "spelling"), "asked-forms")
    other = write_once(forms(named), "named-forms")
    ratio = F.greatest(F.lit(0.0), (F.col("s") - 0.25) / 0.75 - 0.005)
    near = F.least("n", "m") * 2.0 / (F.col("n") + F.col("m"))
    q = own.select(F.col("spelling").alias("query"), "form", "words", "letters", "n", "s", ratio.alias("ratio"))
    told = other.select("spelling", F.col("words").alias("its_words"), F.col("letters").alias("its_letters"), F.col("n").alias("m"))
    # a common word
    word = q.withColumn("word", F.explode("words")).join(told.withColumn("word", F.explode("its_words")), "word")
    shared = word.where(near * 0.4 + 0.6 + 0.01 >= F.col("s")).select("query", "spelling")
    # none: common rare letters
    least = lambda n, r: F.greatest(F.lit(1), F.ceil(F.col(n) * r / (2 - r) - 1e-9))
    low = F.lit(least_ratio(FLOOR))
    mine = q.select("*", F.explode(F.slice("letters", F.lit(1), (F.col("n") - least("n", F.col("ratio")) + 1).cast("int"))).alias("letter"))
    # spellings of the same letters meet the same queries: each of their classes is looked up once
    classes = told.select("its_letters", "m").distinct()
    theirs = classes.select("*", F.posexplode(F.slice("its_letters", F.lit(1), (F.col("m") - least("m", low) + 1).cast("int"))).alias("at", "letter"))
    met = mine.join(theirs, "letter").where((near + 0.005 >= F.col("ratio")) & (F.col("at") < F.col("m") - least("m", F.col("ratio")) + 1))
    common = F.size(F.array_intersect("letters", "its_letters"))
    met = met.where(common * 2.0 / (F.col("n") + F.col("m")) + 0.005 >= F.col("ratio")).select("query", "words", "its_letters").distinct()
    met = met.join(told.select("spelling", "its_words", "its_letters"), "its_letters").where(~F.arrays_overlap("words", "its_words")).select("query", "spelling")
    return shared.union(met).distinct()


def _overlap(a: str, b: str) -> Column:
    fold = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    return F.size(F.array_intersect(fold(a), fold(b)))


def match_names(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries: query_id, name, genres, country; candidates: candidate_id, name, aliases, genres, country (all but ids and names may be null).

    One row a query: query_id, found, confidence, matched_name, candidate_id, method, ambiguous, candidates (the first SHOWN with
    name, id, score). A candidate's score is the best of its name's and its aliases'; ties go by candidate_id. Candidates
    out of reach (see above) aren't shown; without any, confidence is 0 and the rest null.
    """
    length = least_confidence(F.col("form"))
    asked = queries.select(F.col("name").alias("spelling")).where("spelling IS NOT NULL").distinct()
    plain_form = F.pandas_udf(lambda names: names.map(plain), "string")
    asked = write_once(asked.withColumn("form", plain_form("spelling")).select("spelling", length.alias("least"), (length - F.lit(BONUS)).alias("s")), "asked")
    spelt = candidates.select("candidate_id", F.explode(F.array_compact(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("spelling"))
    spelt = write_once(spelt, "spellings")
    pairs = spread_out(candidate_pairs(asked, spelt), "pairs")
    # the bounded number of distinct spellings a query meets is scored, wherever they come from
    scored = pairs.withColumn("score", similarity_score(F.col("query"), F.col("spelling"))).join(asked.select(F.col("spelling").alias("query"), "s", "least"), "query").where(F.col("score") >= F.col("s") - 1e-9)
    best = scored.join(spelt, "spelling").groupBy("query", "least", "candidate_id").agg(F.max("score").alias("score"))
    its = candidates.select("candidate_id", F.col("name").alias("its_name"), F.col("genres").alias("its_genres"), F.col("country").alias("its_country"))
    # the total depends on score, genres and country alone: of candidates that are alike in these, the first SHOWN can be told
    alike = Window.partitionBy("query", "score", "its_genres", "its_country").orderBy("candidate_id")
    best = best.join(its, "candidate_id").withColumn("place", F.row_number().over(alike)).where(F.col("place") <= SHOWN).drop("place")
    # equal queries are answered once
    asks = write_once(queries.groupBy(F.col("name").alias("query"), "genres", "country").agg(F.min("query_id").alias("ask")), "asks")
    met = asks.join(best, "query")
    genres = F.least(_overlap("genres", "its_genres") * GENRE_POINTS, F.lit(MOST_GENRE_POINTS))
    country = F.when(F.lower("country") == F.lower("its_country"), COUNTRY_POINTS).otherwise(0.0)
    met = met.withColumn("total", F.round(F.col("score") + genres + country, 9))
    order = Window.partitionBy("ask").orderBy(F.desc("total"), "candidate_id")
    top = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SHOWN)
    item = F.struct("place", F.col("its_name").alias("name"), F.col("candidate_id").alias("id"), F.col("total"))
    top = top.groupBy("ask", "least").agg(F.array_sort(F.collect_list(item)).alias("items"))
    first, second = F.get("items", F.lit(0)), F.get("items", F.lit(1))
    total, found = first["total"], first["total"] >= F.col("least")
    method = F.when(found, F.when(total >= 1.0, "exact").when(total >= 0.98, "normalized").otherwise("fuzzy"))
    close = (total - second["total"] < CLOSE) & (second["total"] > F.col("least"))
    out = top.select("ask", found.alias("found"), F.when(found, F.least(total, F.lit(1.0))).otherwise(total).alias("confidence"), first["name"].alias("matched_name"), F.when(found, first["id"]).alias("candidate_id"), method.alias("method"), F.coalesce(close, F.lit(False)).alias("ambiguous"), F.transform("items", lambda i: F.struct(i["name"], i["id"], F.round(i["total"], 4).alias("score"))).alias("candidates"))
    same = F.col("name").eqNullSafe(F.col("query")) & F.col("q.genres").eqNullSafe(F.col("a.genres")) & F.col("q.country").eqNullSafe(F.col("a.country"))
    answers = asks.join(out, "ask").alias("a")
    rows = queries.alias("q").join(answers, same, "left").select("q.query_id", *[c for c in out.columns if c != "ask"])
    return rows.fillna({"found": False, "confidence": 0.0, "ambiguous": False})
