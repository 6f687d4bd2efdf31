"""Plain names against unicodedata, and the search of names against a loop over all pairs."""

from __future__ import annotations

import random

from conftest import SF
from pyspark.sql import functions as F

from lodestone.functions.text import plain, similarity
from lodestone.functions.unicode import plain_name
from lodestone.operators.names import match_names
from lodestone.plans.scalars import best_match, searched_names


def test_plain_names_follow_unicodedata(spark):
    every = [chr(cp) for cp in range(0x3000)]
    rng = random.Random(7)
    pool = [*map(chr, range(32, 0x250)), *map(chr, range(0x300, 0x345)), *"ﬁ①Ⅷ한글ＡＢ𝐀İıßſΣς  \x1c"]
    texts = [f"a{c}b {c}" for c in every] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["Ke$ha", "AC/DC", "Guns N' Roses", "  Sigur  Rós ", "Jay-Z", ""]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", plain_name(F.col("t")).alias("p")).collect()
    wrong = [(texts[r.k], r.p, plain(texts[r.k])) for r in got if r.p != plain(texts[r.k])]
    assert not wrong, wrong[:5]
    assert spark.range(1).select(plain_name(F.lit(None).cast("string")).alias("p")).first().p is None


def least(name):
    n = len(plain(name))
    return next(score for most, score in ((3, 0.99), (6, 0.95), (10, 0.88), (20, 0.82), (10**9, 0.75)) if n <= most)


def loop(queries, candidates):
    """query_id -> (found, confidence, name, id, method, ambiguous, [(id, score)]), all pairs compared."""
    out, known = {}, {}
    for query_id, name, genres, country in queries:
        scored = []
        for candidate_id, its_name, aliases, its_genres, its_country in candidates:
            score = 0.0
            for spelling in [its_name, *(aliases or [])]:
                if (name, spelling) not in known:
                    known[name, spelling] = similarity(name, spelling)
                score = max(score, known[name, spelling])
            if name is None or score < least(name) - 0.15 - 1e-9:
                continue
            both = len({g.lower() for g in genres or []} & {g.lower() for g in its_genres or []})
            total = score + min(both * 0.03, 0.1) + (0.05 if country and its_country and country.lower() == its_country.lower() else 0.0)
            scored.append((-round(total, 9), candidate_id, its_name))
        scored.sort()
        if not scored:
            out[query_id] = (False, 0.0, None, None, None, False, [])
            continue
        best, second = -scored[0][0], -scored[1][0] if len(scored) > 1 else 0.0
        found = best >= least(name)
        method = ("exact" if best >= 1 else "normalized" if best >= 0.98 else "fuzzy") if found else None
        out[query_id] = (found, round(min(best, 1.0) if found else best, 4), scored[0][2], scored[0][1] if found else None, method, best - second < 0.05 and second > least(name), [(c, round(-s, 4)) for s, c, _ in scored[:5]])
    return out


def found(df):
    return {r.query_id: (r.found, round(r.confidence, 4), r.matched_name, r.candidate_id, r.method, r.ambiguous, [(c.id, c.score) for c in r.candidates or []]) for r in df.collect()}


QUERY, CANDIDATE = "query_id long, name string, genres array<string>, country string", "candidate_id string, name string, aliases array<string>, genres array<string>, country string"


def test_search_equals_all_pairs(spark):
    rng = random.Random(11)
    words = ["the", "kesha", "pink", "floyd", "sigur", "rós", "beyoncé", "velvet", "under", "ground", "x", "dj", "moon", "noom", "mirror", "mirrors", "ab", "a$ap", "rocky"]

    def name():
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.5:
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["", "e", "-", "!", "é", "$"]) + text[k + 1 :]
        return text

    some = lambda *of: rng.choice([None, *of])
    queries = [(k, name(), some(["Pop"], ["pop", "ROCK", "jazz", "folk"]), some("US", "is")) for k in range(60)] + [(90, "", None, None), (91, None, None, None), (92, "!!!", None, None), (93, "moon moon moon", None, None)]
    candidates = [(f"c{k}", name(), some([name()], [name(), name(), ""]), some(["rock", "Pop", "Jazz", "folk"], []), some("us", "IS")) for k in range(120)] + [("d1", "", None, None, None), ("d2", "moon", ["moon"], None, None)]
    got = found(match_names(spark.createDataFrame(queries, QUERY), spark.createDataFrame(candidates, CANDIDATE)))
    want = loop(queries, candidates)
    assert got == want
    assert {w[4] for w in want.values()} >= {"exact", "fuzzy", None} and any(w[5] for w in want.values())
    assert match_names(spark.createDataFrame([], QUERY), spark.createDataFrame(candidates, CANDIDATE)).count() == 0
    assert found(match_names(spark.createDataFrame(queries[:1], QUERY), spark.createDataFrame([], CANDIDATE))) == {0: (False, 0.0, None, None, None, False, [])}


def test_best_match_on_all_suppliers(spark):
    queries, candidates = searched_names(spark, SF)
    want = loop([tuple(r) for r in queries.collect()], [tuple(r) for r in candidates.collect()])
    got = {r.query_id: (r.found, r.confidence, r.matched_name, r.candidate_id, r.method, r.ambiguous, r.candidates) for r in best_match(spark, SF).collect()}
    assert {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in want.items()}
    assert all([c.split(":")[0] for c in (got[k][6] or "").split()] == [c for c, _ in want[k][6]] for k in want)


def test_equal_queries_and_like_candidates_are_kept_once(spark, monkeypatch):
    """What is joined doesn't grow with queries times candidates: equal queries are one ask."""
    from lodestone.operators import names, written

    kept = {}

    def write(df, label):
        kept[label] = written.write_once(df, label)
        return kept[label]

    monkeypatch.setattr(names, "write_once", write)
    queries = [(k, "moon river", ["Pop"] if k % 2 else None, None) for k in range(60)]
    candidates = [(f"c{k:02}", "moon river" if k % 3 else "moon rivers", None, ["pop"] if k % 2 else None, "US") for k in range(60)]
    assert found(match_names(spark.createDataFrame(queries, QUERY), spark.createDataFrame(candidates, CANDIDATE))) == loop(queries, candidates)
    assert kept["asks"].count() == 2
