"""Scalar functions over names, URLs, responses and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.plans.base import query
from lodestone.plans.scalars import NAME_SQL, names
from lodestone.sources import bindings as b


@query(f"SELECT id, lower(substr(replace(trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}} _-]', '_', 'g')), ' ', '_'), 1, 80)) AS safe FROM ({NAME_SQL})")
def safe_id(spark, d):
    return names(spark, d).select("id", text.safe_id(F.col("name")).alias("safe"))


@query(f"SELECT id, trim(string_split(name, ',')[1]) AS first FROM ({NAME_SQL})")
def comma_primary(spark, d):
    return names(spark, d).select("id", F.trim(F.split("name", ",")[0]).alias("first"))


@query(f"SELECT id, CASE WHEN length(name) <= 3 THEN 0.99 WHEN length(name) <= 6 THEN 0.95 WHEN length(name) <= 10 THEN 0.88 WHEN length(name) <= 20 THEN 0.82 ELSE 0.75 END::DOUBLE AS least FROM ({NAME_SQL})")
def least_confidence(spark, d):
    return names(spark, d).select("id", text.least_confidence(F.col("name")).cast("double").alias("least"))


_ASCII = "trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[-_]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH n AS (SELECT id, name, {_ASCII} AS norm, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(replace(name, '$', 's'), '!', 'i'), '@', 'a'), '+', 'and'), '&', 'and')), '[-_]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS sym FROM ({NAME_SQL})),
    w AS (SELECT *, string_split(norm, ' ') AS words FROM n) SELECT id, array_to_string(list_filter([trim(name), norm, CASE WHEN sym <> norm THEN sym END, CASE WHEN norm NOT LIKE 'the %' THEN 'the ' || norm END, CASE WHEN contains(norm, ' feat ') THEN string_split(norm, ' feat ')[1] END, CASE WHEN contains(norm, ' feat ') THEN string_split(norm, ' feat ')[2] END,
      CASE WHEN len(words) = 2 THEN words[2] || ', ' || words[1] END, CASE WHEN len(words) = 2 THEN words[2] || ' ' || words[1] END], lambda c: c IS NOT NULL AND c <> ''), '|') AS candidates FROM w""")
def name_candidates(spark, d):
    """Spellings to search a name by; these names have no prefixes and no separator but feat."""
    rows = names(spark, d).select("id", "name", text.plain_ascii(F.col("name")).alias("norm"), text.plain_ascii(text.replace_symbols(F.col("name"))).alias("symbols"))
    return rows.select("id", F.array_join(text.spellings(F.col("name"), F.col("norm"), F.col("symbols")), "|").alias("candidates"))


_URL_SQL = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://www.discogs.com/artist/' || page_id || '-Name' WHEN 1 THEN 'https://genius.com/artists/N' || page_id WHEN 2 THEN 'https://www.Last.fm/music/A+' || page_id WHEN 3 THEN 'https://youtube.com/channel/c' || page_id WHEN 4 THEN 'https://n.bandcamp.com/' || page_id WHEN 5 THEN 'https://www.wikidata.org/wiki/Q' || page_id WHEN 6 THEN 'https://www.songkick.com/artists/' || page_id || '-n' WHEN 7 THEN 'https://en.wikipedia.org/wiki/N_' || page_id ELSE url END AS u FROM pages"


def urls(spark, d):
    k, p = F.col("page_id") % 9, F.col("page_id").cast("string")
    parts = (("https://www.discogs.com/artist/", "-Name"), ("https://genius.com/artists/N", ""), ("https://www.Last.fm/music/A+", ""), ("https://youtube.com/channel/c", ""), ("https://n.bandcamp.com/", ""), ("https://www.wikidata.org/wiki/Q", ""), ("https://www.songkick.com/artists/", "-n"), ("https://en.wikipedia.org/wiki/N_", ""))
    out = F
    for n, (a, z) in enumerate(parts):
        out = out.when(k == n, F.concat(F.lit(a), p, F.lit(z)))
    return b.table(spark, d, "pages").select("page_id", out.otherwise(F.col("url")).alias("u"))


@query(f"""SELECT page_id, CASE WHEN contains(u, 'discogs.com/artist/') THEN CASE WHEN regexp_matches(string_split(string_split(u, '/artist/')[-1], '-')[1], '^[0-9]+$') THEN 'discogs' END WHEN contains(u, 'genius.com/artists/') THEN 'genius' WHEN contains(lower(u), 'last.fm/music/') THEN 'lastfm' WHEN contains(lower(u), 'youtube.com/channel/') THEN 'youtube' WHEN contains(lower(u), 'bandcamp.com') THEN 'bandcamp'
    WHEN contains(lower(u), 'setlist.fm') THEN 'setlistfm' WHEN contains(lower(u), 'wikidata.org') THEN 'wikidata' WHEN contains(lower(u), 'songkick.com/artists/') THEN 'songkick' WHEN contains(lower(u), 'wikipedia.org/wiki/') THEN 'wikipedia' END AS platform,
    CASE page_id % 9 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN 'N' || page_id WHEN 2 THEN 'A ' || page_id WHEN 3 THEN 'c' || page_id WHEN 4 THEN u WHEN 5 THEN 'Q' || page_id WHEN 6 THEN CAST(page_id AS VARCHAR) WHEN 7 THEN 'N_' || page_id END AS id FROM ({_URL_SQL})""")
def platform_ids(spark, d):
    """The platform and the artist's id on it that a URL names."""
    found = text.platform_id(F.col("u"))
    return urls(spark, d).select("page_id", found["platform"].alias("platform"), found["id"].alias("id"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'A' || p_partkey WHEN 1 THEN 'B' || p_partkey WHEN 2 THEN 'c' || p_partkey ELSE p_brand END AS resource FROM part")
def extract_id(spark, d):
    """Ids from links, URIs and bare ids."""
    p, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("https://open.example/playlist/A"), p, F.lit("?si=1"))).when(k == 1, F.concat(F.lit("spotify:playlist:B"), p)).when(k == 2, F.concat(F.lit(" c"), p, F.lit(" "))).otherwise(F.col("p_brand"))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.resource_id(raw, "playlist").alias("resource"))


@query("SELECT doc_id, upper(key) AS key, verdict FROM (SELECT doc_id, unnest(['a', 'b']) AS key, unnest([CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END, CAST(quality AS VARCHAR)]) AS verdict FROM labels WHERE quality IS NOT NULL)")
def batch_blocks(spark, d):
    """A batch response cut into its artists' blocks."""
    response = F.concat(F.lit("intro\n=== ARTIST [A] ===\nVERDICT: "), F.when(F.col("toxic") == 1, "bad").otherwise("good"), F.lit("\n=== ARTIST [B] ===\nverdict: ["), F.col("quality").cast("string"), F.lit("]\nend"))
    rows = b.table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.inline(text.blocks(response)))
    return rows.select("doc_id", "key", text.response_field(F.col("body"), "VERDICT").alias("verdict"))


@query(r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'api_field' WHEN page_id % 5 = 1 THEN 'api_genre' WHEN page_id % 5 = 2 AND page_id % 2 = 0 THEN 'ssr_data' WHEN regexp_matches(html, '(?i)"ai[_-]?generated"\s*:\s*true|"content[_-]?type"\s*:\s*"ai|"isAi"\s*:\s*true|"is_ai_generated"\s*:\s*true') THEN 'ssr_data' WHEN page_id % 5 = 3 THEN 'page_text'
    WHEN regexp_matches(html, '(?i)AI[\s-]+generated|generated\s+by\s+AI|contenu\s+généré\s+par\s+(?:l[''])?IA|artificial(?:ly)?[\s-]+(?:intelligence[\s-]+)?generated') THEN 'page_text' ELSE '' END AS method FROM pages""")
def ai_page_detection(spark, d):
    """How an album's page gives itself away: by an API field, a genre, the page's data or its text, in this order."""
    k = F.col("page_id") % 5
    fields = F.when(k == 0, F.create_map(F.lit("is_ai"), F.lit("true"))).otherwise(F.create_map(F.lit("is_ai"), F.lit("false")))
    html = F.when((k == 2) & (F.col("page_id") % 2 == 0), F.concat("html", F.lit('<script id="__NEXT_DATA__">{"a": [{"x_ai_content_y": true}]}</script>'))).when(k == 3, F.concat("html", F.lit("<b>Generated by AI</b>"))).otherwise(F.col("html"))
    return b.table(spark, d, "pages").select("page_id", text.ai_method(fields, F.when(k == 1, F.array(F.lit("AI Generated pop"))).otherwise(F.array(F.lit("pop"))), html).alias("method"))


_HITS_SQL = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'https://pitchfork.com/x' WHEN 1 THEN 'https://www.nme.com/y' ELSE 'https://blog.example/z' END AS url, CASE p_partkey % 3 WHEN 0 THEN 'On ' || p_brand ELSE 'news' END AS title, CASE p_partkey % 5 WHEN 0 THEN p_brand || ' plays' ELSE '' END AS snippet, p_brand AS artist FROM part"


@query(f"""WITH h AS (SELECT *, contains(lower(title), lower(artist)) AS in_title, CASE WHEN contains(url, 'pitchfork.com') THEN 'pitchfork.com' WHEN contains(url, 'nme.com') THEN 'nme.com' END AS pub FROM ({_HITS_SQL}) WHERE contains(lower(title), lower(artist)) OR contains(lower(snippet), lower(artist))),
    p AS (SELECT artist, count(DISTINCT pub) AS publications FROM h GROUP BY 1), f AS (SELECT id FROM h WHERE pub IS NOT NULL QUALIFY row_number() OVER (PARTITION BY artist, pub ORDER BY id) = 1)
    SELECT h.artist, CAST(max(publications) AS BIGINT) AS publications, CAST(count(*) FILTER (f.id IS NOT NULL OR in_title) AS BIGINT) AS hits FROM h JOIN p USING (artist) LEFT JOIN f ON h.id = f.id GROUP BY 1""")
def press_hits(spark, d):
    """Search results on each artist: each publication counts once, other hits if the title names the artist."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    url = F.when(k % 4 == 0, "https://pitchfork.com/x").when(k % 4 == 1, "https://www.nme.com/y").otherwise("https://blog.example/z")
    rows = b.table(spark, d, "part").select(k.alias("id"), url.alias("url"), F.when(k % 3 == 0, F.concat(F.lit("On "), brand)).otherwise("news").alias("title"), F.when(k % 5 == 0, F.concat(brand, F.lit(" plays"))).otherwise("").alias("snippet"), brand.alias("artist"))
    return text.press(rows, ("pitchfork.com", "nme.com"))


@query("SELECT s_suppkey AS id, 'City' || s_nationkey AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'Land' ELSE '' END AS country FROM supplier")
def city_country(spark, d):
    where = F.concat(F.lit("City"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, ", State, Land").otherwise(""))
    city, country = text.city_country(where)
    return b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), city.alias("city"), country.alias("country"))


@query("SELECT p_partkey AS id, p_partkey % 3 <> 2 AS physical FROM part")
def physical_formats(spark, d):
    formats = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("File"), F.lit('12" Vinyl'))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("CDr"))).otherwise(F.array(F.lit("File"), F.lit("MP3")))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.is_physical(formats).alias("physical"))


@query("SELECT o_orderkey AS id, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS thousands, CAST(CAST(round(100 * (o_orderkey % 37) / 37) AS INTEGER) AS VARCHAR) || '%' AS pct, replace(replace(replace(replace(replace('<' || o_orderpriority || '> & \"x\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM orders")
def format_helpers(spark, d):
    raw = F.concat(F.lit("<"), "o_orderpriority", F.lit('> & "x"'))
    share = F.round(F.lit(100) * (F.col("o_orderkey") % 37) / 37).cast("int")
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_number(F.floor("o_totalprice"), 0).alias("thousands"), F.concat(share.cast("string"), F.lit("%")).alias("pct"), text.escape_html(raw).alias("escaped"))


@query("SELECT artist_id, CASE WHEN genius_found THEN 'found' WHEN err_genius AND artist_id % 2 = 0 THEN 'timeout' WHEN err_genius THEN 'error' ELSE 'not_found' END AS genius, CASE WHEN lastfm_found THEN 'found' WHEN err_lastfm THEN 'error' ELSE 'not_found' END AS lastfm, CASE WHEN NOT youtube_checked THEN 'skipped' WHEN youtube_found THEN 'found' ELSE 'not_found' END AS youtube, 'found' AS deezer FROM b_dossier")
def api_status(spark, d):
    """What each platform's lookup came to; errors go by the platform's name in any spelling."""
    from lodestone.sources.dossier import dossiers

    said = F.map_from_entries(F.array_compact(F.array(F.when(F.col("err_genius"), F.struct(F.lit("Genius").alias("key"), F.when(F.col("artist_id") % 2 == 0, "request timed out").otherwise("HTTP 500").alias("value"))), F.when(F.col("err_lastfm"), F.struct(F.lit("Last.fm").alias("key"), F.lit("refused").alias("value"))))))
    status = lambda name, found, checked=F.lit(True): text.api_status(name, found, checked, said).alias(name)
    return dossiers(spark, d).select("artist_id", status("genius", F.col("genius_found")), status("lastfm", F.col("lastfm_found")), status("youtube", F.col("youtube_found"), F.col("youtube_checked")), status("deezer", F.lit(True)))


@query("SELECT artist_id, CASE WHEN artist_id % 3 = 0 THEN 'https://facebook.com/rel' WHEN artist_id % 2 = 0 THEN 'https://facebook.com/h' || artist_id END AS facebook, CASE WHEN artist_id % 2 = 0 THEN 'https://instagram.com/h' || artist_id END AS instagram FROM b_artist")
def profile_urls(spark, d):
    """Links of relations, and those made of handles where no relation has one."""
    relations = F.when(F.col("artist_id") % 3 == 0, F.create_map(F.lit("social network"), F.lit("https://facebook.com/rel"))).otherwise(F.create_map().cast("map<string,string>"))
    handle = F.when(F.col("artist_id") % 2 == 0, F.concat(F.lit("h"), F.col("artist_id").cast("string")))
    found = text.social_urls(relations, {"facebook": handle, "instagram": handle})
    return b.artists(spark, d).select("artist_id", found["facebook"].alias("facebook"), found["instagram"].alias("instagram"))


@query("""SELECT artist_id, CAST(n AS BIGINT) AS sources, CAST(chars AS BIGINT) AS chars, chars < 200 AND n <= 1 AS generic, chars >= 200 AND n >= 2 AS verifiable FROM (SELECT artist_id, (wikipedia_found AND wiki_length > 0)::INT + (bio_len > 0)::INT + lastfm_bio::INT AS n, CASE WHEN wikipedia_found THEN wiki_length ELSE 0 END + bio_len AS chars FROM b_dossier)""")
def bio_data(spark, d):
    from lodestone.sources.dossier import dossiers

    n = (F.col("wikipedia_found") & (F.col("wiki_length") > 0)).cast("long") + (F.col("bio_len") > 0).cast("long") + F.col("lastfm_bio").cast("long")
    chars = F.when(F.col("wikipedia_found"), F.col("wiki_length")).otherwise(0) + F.col("bio_len")
    return dossiers(spark, d).select("artist_id", n.alias("sources"), chars.cast("long").alias("chars"), ((chars < 200) & (n <= 1)).alias("generic"), ((chars >= 200) & (n >= 2)).alias("verifiable"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN k WHEN 2 THEN k ELSE 0 END AS n, round(log10(greatest(k, 1)), 3) AS log_n FROM (SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)")
def safe_numbers(spark, d):
    """Whole numbers from nulls, texts, objects with a total, and what isn't one."""
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, k).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"total": '), k, F.lit("}"))).otherwise("n/a")
    return b.table(spark, d, "events").select("event_id", text.safe_int(raw).alias("n"), F.round(F.log10(F.greatest(k.cast("long"), F.lit(1))), 3).alias("log_n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS first FROM events")
def json_columns(spark, d):
    """Arrays kept as JSON text; what can't be parsed is an empty array."""
    raw = F.when(F.col("event_id") % 3 == 0, "not json").otherwise(F.to_json(F.array("event_type", F.lit("x"))))
    parsed = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return b.table(spark, d, "events").select("event_id", F.when(F.exists(parsed, lambda x: x.isNotNull()), F.size(parsed)).otherwise(0).alias("n"), F.get(parsed, F.lit(0)).alias("first"))


@query("SELECT page_id, length(html) > 0 AS found, CAST(round(strlen(html) / 6) AS BIGINT) AS words, 'Jazz' AS category FROM pages WHERE page_id % 7 <> 0")
def wiki_page_parse(spark, d):
    """A page's words by its length, its categories without their prefix; disambiguation pages are left out."""
    rows = b.table(spark, d, "pages").select("page_id", "html", F.array(F.lit("Category:Jazz"), F.when(F.col("page_id") % 7 == 0, "Category:Disambiguation pages").otherwise("Category:1984 births")).alias("categories"))
    return rows.where(~text.is_disambiguation(F.col("categories"))).select("page_id", (F.length("html") > 0).alias("found"), F.round(F.octet_length("html") / 6).cast("long").alias("words"), text.categories(F.col("categories"))[0].alias("category"))
