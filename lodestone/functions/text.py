"""Names, labels, URLs and response texts as column expressions; similarity as pandas UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.unicode import DASHES, MARKS, plain_name

# fixed values
ENTITY_WORDS = "records|recordings|music|entertainment|publishing|productions?|group|llc|ltd|inc|gmbh|co|corp|intl|international"
LABEL_ENDINGS = "records?|music|entertainment|studios?|productions?|publishing|group|ab|llc|inc|gmbh|ltd"
SYMBOLS = {"$": "s", "!": "i", "@": "a", "+": "and", "&": "and"}
SEPARATORS = (", ", " & ", " feat. ", " ft. ", " feat ", " ft ", " x ", " vs. ", " vs ", " prod. ", " prod ")
CAREER_WORDS = ("born", "grew up", "formed in", "founded", "member of", "grammy", "award", "toured", "festival", "performed at", "signed to", "record deal", "debut album", "released", "collaborated with", "produced by", "studied", "conservatory", "university", "trained")
URL_BUCKETS = ("youtube", "bandcamp", "soundcloud", "instagram", "twitter", "facebook", "wikipedia", "wikidata", "allmusic")


def normalize_entity(name: Column, keep_unicode: bool = False) -> Column:
    """Trimmed, lower case, without company words, with letters of a-z, digits and single blanks alone."""
    bare = F.regexp_replace(F.lower(F.trim(name)), rf"\s*\b({ENTITY_WORDS})\b\.?", "")
    bare = F.regexp_replace(bare, r"[^\p{L}\p{N}\s]" if keep_unicode else r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def label_key(name: Column) -> Column:
    """Lower case, without one company word at the end, without . , ' and quotes."""
    return F.translate(F.trim(F.regexp_replace(F.lower(F.trim(name)), rf"\s+({LABEL_ENDINGS})\.?$", "")), ".,'\"", "")


def replace_symbols(name: Column) -> Column:
    for symbol, text in SYMBOLS.items():
        name = F.replace(name, F.lit(symbol), F.lit(text))
    return name


def primary_artist(credit: Column, bands: tuple[str, ...] = ()) -> Column:
    """The first artist of a credit: without bracketed features and production, cut at the first separator by priority."""
    bare = F.trim(F.regexp_replace(credit, r"(?i)\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring|with)\s+.+?[\)\]]", ""))
    bare = F.trim(F.regexp_replace(bare, r"(?i)\s+prod\.?\s+.+$", ""))
    low = F.lower(bare)
    out = F.when(low.isin(*bands) | low.contains(" and the "), bare)
    for s in SEPARATORS:
        out = out.when(F.instr(low, s) > 0, F.trim(F.substring(bare, F.lit(1), F.instr(low, s) - F.lit(1))))
    return F.when(credit.isNull() | (F.trim(credit) == ""), credit).otherwise(out.otherwise(bare))


def name_patterns(name: Column) -> Column:
    """Points of a name that looks made up: 25 for two plain words, 20 for one lower-case word, 15 for three letters or fewer."""
    generic = name.rlike(r"^(The\s+)?[A-Z][a-z]+\s+[A-Z][a-z]+s?$")
    return F.when(generic, 25).otherwise(0) + F.when(name.rlike(r"^[a-z]{3,15}$"), 20).otherwise(0) + F.when(F.length(F.trim(name)) <= 3, 15).otherwise(0)


def soft_consonant_ratio(name: Column) -> Column:
    """Share of l r s n v m w y h j among the consonants; 1 without consonants, null without letters."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    hard = F.length(F.regexp_replace(letters, "[aeiou]", ""))
    soft = F.length(F.regexp_replace(letters, "[^lrsnvmwyhj]", ""))
    return F.when(F.length(letters) > 0, F.when(hard > 0, soft / hard).otherwise(1.0))


def url_bucket(url: Column) -> Column:
    low = F.lower(url)
    out = F
    for name in URL_BUCKETS:
        found = low.contains("twitter.com") | low.contains("x.com") if name == "twitter" else low.contains(name)
        out = out.when(found, name)
    return out.otherwise("other")


def isrc_registrant(isrc: Column) -> Column:
    return F.substring(F.replace(isrc, F.lit("-"), F.lit("")), 3, 3)


def career_words(bio: Column) -> Column:
    """How many career words the text holds."""
    low = F.lower(bio)
    return sum((F.when(low.contains(w), 1).otherwise(0) for w in CAREER_WORDS[1:]), F.when(low.contains(CAREER_WORDS[0]), 1).otherwise(0))


def years(bio: Column, latest: int) -> Column:
    """The years 1900 to latest that the text names."""
    found = F.regexp_extract_all(bio, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    return F.filter(found, lambda y: y.cast("int").between(1900, latest))


def response_field(text: Column, field: str) -> Column:
    """The value after FIELD: up to the line's end, without brackets."""
    found = F.regexp_extract(text, rf"(?i){re.escape(field)}:\s*([^\n]+?)(?:\n|$)", 1)
    return F.btrim(F.btrim(found, F.lit(" \t\r\n\x0b\x0c")), F.lit("[]"))


def least_confidence(name: Column) -> Column:
    """Shorter names must match more closely."""
    n = F.length(name)
    return F.when(n <= 3, 0.99).when(n <= 6, 0.95).when(n <= 10, 0.88).when(n <= 20, 0.82).otherwise(0.75)


def plain(name: str | None) -> str:
    """NFC, case folded, without accents and marks of punctuation, with dashes as blanks and single blanks."""
    text = unicodedata.normalize("NFC", name or "").casefold()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return " ".join(text.translate(str.maketrans(DASHES, " " * len(DASHES), MARKS)).split())


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    rest = (1 << len(a)) - 1
    for c in b:
        hit = rest & masks.get(c, 0)
        rest = (rest + hit) | (rest - hit)
    return len(a) - (rest & (1 << len(a)) - 1).bit_count()


def _ratio(a: str, b: str) -> float:
    """Insertions and deletions alone, as a share of both lengths, in whole hundredths."""
    return round(200 * _common(a, b) / (len(a) + len(b))) / 100 if a or b else 1.0


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of its length at most."""
    short, long = sorted((a, b), key=len)
    if not short:
        return float(not long)
    return max(_ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    return max(_ratio(both, left) if both else 0.0, _ratio(both, right) if both else 0.0, _ratio(left, right))


def similarity(query: str | None, candidate: str | None) -> float:
    """0.4 of the sorted words' ratio, 0.35 of the word sets', 0.25 of the best part's; the best of plain and symbol-free spellings."""
    forms = [{plain(t), plain("".join(SYMBOLS.get(c, c) for c in t or ""))} for t in (query, candidate)]
    score = lambda a, b: 1.0 if a == b and a else 0.0 if not a or not b else 0.4 * _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) + 0.35 * _token_set(a, b) + 0.25 * _partial(a, b)
    return max(score(a, b) for a in forms[0] for b in forms[1])


def normalize_name(name: Column) -> Column:
    """plain() of each name, by column functions."""
    return plain_name(name)


def similarity_score(query: Column, candidate: Column) -> Column:
    """similarity() of each pair."""

    def each(queries: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series([similarity(q, c) for q, c in zip(queries, candidates, strict=True)])

    return F.pandas_udf(each, "double")(query, candidate)


# fixed values
PREFIXES = ("the ", "dj ", "mc ", "dr. ", "dr ", "mr. ", "mr ", "mrs. ", "mrs ", "lil ", "lil' ", "big ", "young ")
SPLITS = (" & ", " and ", " x ", " vs ", " vs. ", " feat ", " feat. ", " ft ", " ft. ", " with ")
PHYSICAL = ("vinyl", "lp", "cd", "cassette", "7\"", "10\"", "12\"")
AI_FIELDS = ("ai_generated", "is_ai", "content_type", "ai_content", "generated_by_ai", "artificial")
AI_DATA = r'(?i)"ai[_-]?generated"\s*:\s*true|"content[_-]?type"\s*:\s*"ai|"isAi"\s*:\s*true|"is_ai_generated"\s*:\s*true'
AI_TEXT = r"(?i)AI[\s-]+generated|generated\s+by\s+AI|contenu\s+généré\s+par\s+(?:l['’])?IA|artificial(?:ly)?[\s-]+(?:intelligence[\s-]+)?generated"
AI_KEYS = r'(?i)"[^"]*(?:ai_gen|is_ai|aigen|ai_content)[^"]*"\s*:\s*(?:true|"true"|1\b)'
AI_STATE = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>|window\.__DZR_APP_STATE__\s*=\s*(\{.*?\})\s*;'


def safe_id(name: Column) -> Column:
    """A name for files: letters, digits, - and _, 80 characters at most."""
    return F.lower(F.substring(F.replace(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")), F.lit(" "), F.lit("_")), 1, 80))


def plain_ascii(name: Column) -> Column:
    """Lower case, dashes as blanks, letters a-z and digits alone; normalize_name() for names in other letters."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[-_]", " "), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(bare, " +", " "))


def has_non_latin(name: Column) -> Column:
    return name.rlike(r"[^\x00-\x7F]")


def transliterate(name: Column) -> Column:
    """Letters with marks as those without; other scripts by the Unicode names of their letters' Latin form, where they have one."""

    def latin(c: str) -> str:
        if c < "\x80":
            return c
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80")
        if bare:
            return bare
        words = unicodedata.name(c, "").split()
        return words[-1].lower() if "LETTER" in words and len(words[-1]) <= 4 else ""

    def each(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else "".join(map(latin, n)))

    return F.pandas_udf(each, "string")(name)


def candidates(name: Column, normal=normalize_name) -> Column:
    """Spellings to search by, the closest first: as given, normalized, with symbols as letters, without a prefix, with the, split, reversed."""
    return spellings(name, normal(name), normal(replace_symbols(name)))


def spellings(name: Column, norm: Column, symbols: Column) -> Column:
    """candidates() of columns that hold the normalized forms: each is named some thirty times."""
    without = F
    for p in PREFIXES:
        without = without.when(norm.startswith(p), F.substring(norm, F.lit(len(p) + 1), F.length(norm)))
    parts = F
    for s in SPLITS:
        parts = parts.when(norm.contains(s), F.split(norm, re.escape(s)))
    words = F.split(norm, " ")
    two = F.size(words) == 2
    single = F.array(F.trim(name), norm, F.when(symbols != norm, symbols), without.otherwise(None), F.when(~norm.startswith("the "), F.concat(F.lit("the "), norm)))
    turned = F.array(F.when(two, F.concat(F.get(words, F.lit(1)), F.lit(", "), F.get(words, F.lit(0)))), F.when(two, F.concat(F.get(words, F.lit(1)), F.lit(" "), F.get(words, F.lit(0)))))
    every = F.concat(single, F.transform(F.coalesce(parts.otherwise(None), F.array().cast("array<string>")), lambda p: F.trim(p)), turned)
    return F.array_distinct(F.filter(every, lambda c: c.isNotNull() & (c != "")))


def platform_id(url: Column) -> Column:
    """platform and id of the first rule that fits; null where an id that has to be a number isn't."""
    low = F.lower(url)
    after = lambda mark: F.element_at(F.split(url, mark), -1)
    number = lambda x: F.when(F.split(x, "-")[0].rlike("^[0-9]+$"), F.split(x, "-")[0])
    rules = (
        (url.contains("discogs.com/artist/"), "discogs", number(after("/artist/"))), (url.contains("genius.com/artists/"), "genius", after("/artists/")), (low.contains("last.fm/music/"), "lastfm", F.replace(after("/music/"), F.lit("+"), F.lit(" "))), (low.contains("youtube.com/channel/"), "youtube", after("/channel/")),
        (low.contains("bandcamp.com"), "bandcamp", url), (low.contains("setlist.fm"), "setlistfm", url), (low.contains("wikidata.org"), "wikidata", after("/")), (low.contains("songkick.com/artists/"), "songkick", number(after("/artists/"))), (low.contains("wikipedia.org/wiki/"), "wikipedia", after("/wiki/")),
    )
    out = F
    for cond, name, value in rules:
        out = out.when(cond, F.struct(F.when(value.isNotNull(), F.lit(name)).alias("platform"), value.alias("id")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("id")))


def resource_id(text: Column, resource: str) -> Column:
    """The id in a link or URI, else the text itself."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, rf"{resource}/([a-zA-Z0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, rf"spotify:{resource}:([a-zA-Z0-9]+)", 1), F.lit("")))
    return F.coalesce(found, F.trim(text))


def blocks(response: Column) -> Column:
    """key and body of each section === ARTIST [key] ===."""
    parts = F.slice(F.split(response, r"(?i)===\s*ARTIST\s*\["), 2, 1 << 20)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([^\]]*)\]\s*===", 1).alias("key"), F.regexp_replace(p, r"^[^\]]*\]\s*===", "").alias("body")))


def ai_method(fields: Column, genres: Column, html: Column) -> Column:
    """The first sign that an album's page gives of AI, empty without any: a true API field, a genre, the page's data, its text."""
    field = F.exists(F.map_entries(fields), lambda e: e["key"].isin(*AI_FIELDS) & ~F.coalesce(e["value"], F.lit("")).isin("", "false", "0"))
    genre = F.exists(genres, lambda g: F.lower(g).rlike("ai.generated"))
    state = F.concat_ws(" ", F.regexp_extract(html, AI_STATE, 1), F.regexp_extract(html, AI_STATE, 2))
    return F.when(field, "api_field").when(genre, "api_genre").when(html.rlike(AI_DATA) | state.rlike(AI_KEYS), "ssr_data").when(html.rlike(AI_TEXT), "page_text").otherwise("")


def press(results, publications: tuple[str, ...]):
    """(id, artist, url, title, snippet) -> artist, publications, hits."""
    low, name = (lambda c: F.lower(F.col(c))), F.lower("artist")
    named = results.where(low("title").contains(name) | low("snippet").contains(name))
    pub = F
    for p in publications:
        pub = pub.when(low("url").contains(p), p)
    rows = named.select("artist", "id", low("title").contains(name).alias("in_title"), pub.otherwise(None).alias("pub"))
    firsts = rows.where("pub IS NOT NULL").groupBy("artist", "pub").agg(F.min("id").alias("id")).select("artist", "id", F.lit(True).alias("first"))
    rows = rows.join(firsts, ["artist", "id"], "left")
    hit = F.coalesce("first", F.lit(False)) | F.col("in_title")
    return rows.groupBy("artist").agg(F.countDistinct("pub").alias("publications"), F.sum(hit.cast("long")).alias("hits"))


def city_country(place: Column) -> tuple[Column, Column]:
    """The first and, where there are several, the last part of a place."""
    parts = F.split(place, ",")
    return F.trim(parts[0]), F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))).otherwise("")


def is_physical(formats: Column) -> Column:
    return F.exists(formats, lambda f: sum((F.lower(f).contains(p).cast("int") for p in PHYSICAL), F.lit(0)) > 0)


def escape_html(text: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def api_status(platform: str, found: Column, checked: Column, errors: Column) -> Column:
    """skipped, found, timeout, error or not_found; errors: a map by platform, whatever its case, dots and blanks."""
    own = F.get(F.map_values(F.map_filter(errors, lambda k, v: F.regexp_replace(F.lower(k), "[. ]", "") == platform)), F.lit(0))
    return F.when(~checked, "skipped").when(found, "found").when(F.lower(own).rlike("timeout|timed out"), "timeout").when(own.isNotNull(), "error").otherwise("not_found")


def social_urls(relations: Column, handles: dict[str, Column]) -> dict[str, Column]:
    """Links by site: the last relation's that names it, else one made of the handle."""
    out = {}
    for site in ("facebook", "instagram", "twitter"):
        pattern = "twitter|x[.]com" if site == "twitter" else site
        named = F.filter(F.map_values(relations), lambda u: F.lower(u).rlike(pattern))  # noqa: B023  called at once
        made = F.concat(F.lit(f"https://{site}.com/"), handles[site]) if site in handles else F.lit(None).cast("string")
        out[site] = F.coalesce(F.get(named, F.size(named) - 1), made)
    return out


def safe_int(value: Column) -> Column:
    """A whole number from text, from an object's total, else 0."""
    return F.coalesce(value.try_cast("bigint"), F.get_json_object(value, "$.total").try_cast("bigint"), F.lit(0).cast("bigint"))


def categories(names: Column) -> Column:
    return F.transform(names, lambda n: F.regexp_replace(n, "^Category:", ""))


def is_disambiguation(names: Column) -> Column:
    return F.exists(names, lambda n: F.lower(n).contains("disambiguation"))
