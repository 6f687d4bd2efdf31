"""Scalar functions over names, URLs, texts and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dates, text
from lodestone.operators.names import match_names
from lodestone.plans.base import query
from lodestone.sources import bindings as b

NAME_SQL = "SELECT p_partkey AS id, p_name || CASE p_partkey % 6 WHEN 0 THEN ' Records' WHEN 1 THEN ' Music Group LLC' WHEN 2 THEN ' & Co.' WHEN 3 THEN ', Inc.' WHEN 4 THEN ' feat. ' || p_brand ELSE '!$' END AS name FROM part"

ACCENTED_SQL = f"SELECT id, CASE WHEN id % 2 = 0 THEN translate(name, 'aeo', 'àéö') ELSE name END AS name FROM ({NAME_SQL})"


#: Names of a task: few bytes, but many regular expressions each.
NAMES = 10_000


def names(spark, d):
    ends = F.array(F.lit(" Records"), F.lit(" Music Group LLC"), F.lit(" & Co."), F.lit(", Inc."), F.concat(F.lit(" feat. "), F.col("p_brand")), F.lit("!$"))
    parts = b.table(spark, d, "part")
    return b.dealt(parts.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.get(ends, F.col("p_partkey") % 6)).alias("name")), parts, "id", size=NAMES)


@query(rf"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\s*\b({text.ENTITY_WORDS})\b\.?', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM ({NAME_SQL})")
def normalize_entity(spark, d):
    return names(spark, d).select("id", text.normalize_entity(F.col("name")).alias("norm"))


@query(rf"SELECT id, translate(trim(regexp_replace(lower(trim(name)), '\s+({text.LABEL_ENDINGS})\.?$', '')), '.,''\"', '') AS label_key FROM ({NAME_SQL})")
def label_fuzzy_key(spark, d):
    return names(spark, d).select("id", text.label_key(F.col("name")).alias("label_key"))


@query(f"SELECT id, replace(replace(replace(replace(replace(name, '$', 's'), '!', 'i'), '@', 'a'), '+', 'and'), '&', 'and') AS plain FROM ({NAME_SQL})")
def symbol_replace(spark, d):
    return names(spark, d).select("id", text.replace_symbols(F.col("name")).alias("plain"))


@query(f"SELECT id, CASE WHEN name LIKE '%, %' THEN split_part(name, ', ', 1) WHEN name LIKE '% & %' THEN split_part(name, ' & ', 1) WHEN name LIKE '% feat. %' THEN split_part(name, ' feat. ', 1) ELSE trim(name) END AS artist FROM ({NAME_SQL})")
def primary_artist(spark, d):
    return names(spark, d).select("id", text.primary_artist(F.col("name")).alias("artist"))


@query(rf"SELECT id, CAST(CASE WHEN regexp_matches(name, '^(The\s+)?[A-Z][a-z]+\s+[A-Z][a-z]+s?$') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(name, '^[a-z]{{3,15}}$') THEN 20 ELSE 0 END + CASE WHEN length(trim(name)) <= 3 THEN 15 ELSE 0 END AS INTEGER) AS points FROM ({NAME_SQL} UNION ALL SELECT -s_suppkey, 'Ab Cd' FROM supplier UNION ALL SELECT -1000 - n_nationkey, lower(n_name) FROM nation)")
def name_patterns(spark, d):
    rows = names(spark, d).union(b.table(spark, d, "supplier").select(-F.col("s_suppkey"), F.lit("Ab Cd"))).union(b.table(spark, d, "nation").select(-1000 - F.col("n_nationkey"), F.lower("n_name")))
    return rows.select("id", text.name_patterns(F.col("name")).alias("points"))


@query(f"WITH l AS (SELECT id, regexp_replace(lower(name), '[^a-z]', '', 'g') AS t FROM ({NAME_SQL})) SELECT id, round(CASE WHEN length(t) > 0 THEN CASE WHEN length(regexp_replace(t, '[aeiou]', '', 'g')) > 0 THEN length(regexp_replace(t, '[^lrsnvmwyhj]', '', 'g')) / length(regexp_replace(t, '[aeiou]', '', 'g')) ELSE 1.0 END END, 6) AS ratio FROM l")
def soft_consonant_ratio(spark, d):
    return names(spark, d).select("id", F.round(text.soft_consonant_ratio(F.col("name")), 6).alias("ratio"))


BUCKET_SQL = " ".join(f"WHEN contains(u, '{n}') THEN '{n}'" if n != "twitter" else "WHEN contains(u, 'twitter.com') OR contains(u, 'x.com') THEN 'twitter'" for n in text.URL_BUCKETS)


@query(f"WITH p AS (SELECT page_id, lower(CASE page_id % 4 WHEN 0 THEN 'https://www.YouTube.com/c' WHEN 1 THEN 'https://x.com/u' WHEN 2 THEN url ELSE 'https://en.wikipedia.org/wiki/a' END) AS u FROM pages) SELECT page_id, CASE {BUCKET_SQL} ELSE 'other' END AS bucket FROM p")
def url_categories(spark, d):
    urls = F.array(F.lit("https://www.YouTube.com/c"), F.lit("https://x.com/u"), F.col("url"), F.lit("https://en.wikipedia.org/wiki/a"))
    return b.table(spark, d, "pages").select("page_id", text.url_bucket(F.get(urls, F.col("page_id") % 4)).alias("bucket"))


@query("SELECT artist_id, string_agg(DISTINCT r, ',' ORDER BY r) AS registrants FROM (SELECT o_custkey AS artist_id, substr(replace('US-' || upper(substr(md5(CAST(o_orderkey % 7 AS VARCHAR)), 1, 3)) || '-24-1', '-', ''), 3, 3) AS r FROM orders) GROUP BY 1")
def isrc_registrant(spark, d):
    code = F.concat(F.lit("US-"), F.upper(F.substring(F.md5((F.col("o_orderkey") % 7).cast("string").cast("binary")), 1, 3)), F.lit("-24-1"))
    rows = b.table(spark, d, "orders").select(F.col("o_custkey").alias("artist_id"), text.isrc_registrant(code).alias("r"))
    return rows.groupBy("artist_id").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("registrants"))


BIO_SQL = "SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Born 1984, toured in 1999 and 2150.' WHEN 1 THEN ' She studied at the University.' ELSE '' END AS bio FROM documents"


def _bio_signals(spark, d):
    """Of whole texts."""
    ends = F.array(F.lit(" Born 1984, toured in 1999 and 2150."), F.lit(" She studied at the University."), F.lit(""))
    bio = F.concat("text", F.get(ends, F.col("doc_id") % 3))
    return b.table(spark, d, "documents").select("doc_id", text.career_words(bio).alias("career"), F.array_join(text.years(bio, 2028), ",").alias("years"))


_BIO_ORACLE = "WITH x AS (" + BIO_SQL + ") SELECT doc_id, CAST(" + " + ".join(f"contains(lower(bio), '{w}')::INT" for w in text.CAREER_WORDS) + r" AS INTEGER) AS career, array_to_string(list_filter(regexp_extract_all(bio, '\b((?:19|20)[0-9]{2})\b', 1), lambda y: y::INT BETWEEN 1900 AND 2028), ',') AS years FROM x"
for _name in ("bio_signals", "bio_signals_full"):
    query(_BIO_ORACLE, name=_name)(_bio_signals)


@query(r"SELECT doc_id, trim(trim(regexp_extract(t, '(?i)verdict:\s*(.+?)(?:\n|$)', 1)), '[]') AS verdict, trim(trim(regexp_extract(t, '(?i)score:\s*(.+?)(?:\n|$)', 1)), '[]') AS score FROM (SELECT doc_id, 'VERDICT: [' || CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END || ']' || chr(10) || 'Score: ' || quality AS t FROM labels)")
def response_fields(spark, d):
    t = F.concat(F.lit("VERDICT: ["), F.when(F.col("toxic") == 1, "bad").otherwise("good"), F.lit("]\nScore: "), F.col("quality"))
    return b.table(spark, d, "labels").select("doc_id", text.response_field(t, "verdict").alias("verdict"), text.response_field(t, "score").alias("score"))


PARTIAL_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS t FROM orders"


@query(f"SELECT id, CAST(CASE WHEN length(t) = 4 AND t <> 'soon' THEN t || '-07-01' WHEN length(t) = 7 THEN t || '-15' WHEN length(t) = 10 THEN t END AS VARCHAR) AS mid, CASE WHEN length(t) = 4 AND t <> 'soon' THEN t || '-01-01' WHEN length(t) = 7 THEN t || '-01' WHEN length(t) = 10 THEN t END AS start, CASE WHEN length(t) = 10 THEN t END AS strict FROM ({PARTIAL_SQL})")
def partial_dates(spark, d):
    at = F.col("o_orderdate")
    t = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(at, "yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(at, "yyyy-MM")).when(F.col("o_orderkey") % 4 == 2, F.date_format(at, "yyyy-MM-dd")).otherwise("soon")
    rows = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.alias("t"))
    return rows.select("id", dates.date_mid(F.col("t")).cast("string").alias("mid"), dates.date_start(F.col("t")).cast("string").alias("start"), dates.date_strict(F.col("t")).cast("string").alias("strict"))


@query(rf"SELECT id, trim(regexp_replace(translate(lower(strip_accents(name)), '-.,;:!?''()[]{{}}/', ' '), '\s+', ' ', 'g')) AS plain FROM ({ACCENTED_SQL})")
def normalize_name(spark, d):
    """Names, some of whose vowels have accents, in their plain form."""
    accented = F.when(F.col("id") % 2 == 0, F.translate("name", "aeo", "àéö")).otherwise(F.col("name"))
    return names(spark, d).select("id", text.normalize_name(accented).alias("plain"))


def searched_names(spark, d):
    """Queries (each supplier's: its nation, spelt in one of six ways) and candidates (all nations with their aliases, and all customers)."""
    nations = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"))
    n = F.col("nation")
    ways = F.array(F.concat(F.lit("The "), F.initcap(n)), F.concat(F.substring(n, F.lit(1), F.lit(2)), F.substring(n, F.lit(4), F.length(n))), F.concat(F.lower(n), F.lit("!")), F.concat_ws(" ", F.reverse(F.split(n, " "))), F.translate(n, "SA", "$@"), F.concat(F.lit("Nation "), F.col("nation_id")))
    queries = b.songwriters(spark, d).join(nations, "nation_id").select(F.col("songwriter_id").alias("query_id"), F.get(ways, (F.col("songwriter_id") % 6).cast("int")).alias("name"), F.when(F.col("songwriter_id") % 2 == 0, F.array(F.lit("Building"), F.lit("MACHINERY"))).alias("genres"), F.when(F.col("songwriter_id") % 4 < 2, F.initcap(n)).alias("country"))
    places = nations.select(F.concat(F.lit("n"), F.col("nation_id")).alias("candidate_id"), F.concat(F.lit("Nation, "), F.col("nation_id")).alias("name"), F.array(n, F.concat(F.lit("land of "), F.lower(n))).alias("aliases"), F.lit(None).cast("array<string>").alias("genres"), n.alias("country"))
    artists = b.artists(spark, d).join(nations, "nation_id").select(F.concat(F.lit("c"), F.col("artist_id")).alias("candidate_id"), "name", F.when(F.col("artist_id") % 7 == 0, F.array(F.concat(F.initcap(n), F.lit(" "), F.col("artist_id") % 100))).alias("aliases"), F.array("genre").alias("genres"), n.alias("country"))
    return queries, places.union(artists)


@query()
def best_match(spark, d):
    """For every supplier's query the best of all nations and customers by name, aliases, genres and country. A test holds it against a loop over all pairs."""
    found = match_names(*searched_names(spark, d))
    shown = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["id"], c["score"])), " ")
    return found.select("query_id", "found", F.round("confidence", 4).alias("confidence"), "matched_name", "candidate_id", "method", "ambiguous", shown.alias("candidates"))
