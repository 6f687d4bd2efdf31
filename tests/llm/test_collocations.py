"""Operator 11 against its SQL and against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import LOWER
from conftest import same_rows

from lodestone.llm import collocations as op
from lodestone.llm.collocations import OP11_SQL, Bitmaps, collocations, op11_collocations

DATA = "/root/testdata/sf0.01"


def expected(docs, least, top=2000):
    """{(lang, rank): the other columns}; docs: (lang, text)"""
    n, f = Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = {}
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = lambda p: {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        gone = {s for p, a in found.items() for s in inner(p) if s in found and a >= found[s]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):  # noqa: E741
            out[lang, rank] = (p.decode(), -a, l, r, n[lang], -score)
    return out


def rows(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def test_bitmaps_find_all_phrases():
    rng = random.Random(5)
    for _ in range(60):
        codes = np.array([rng.choice([0, 3, 3, 7, 9, 12]) for _ in range(rng.randint(0, 300))], np.int64)
        want = Counter()
        for k in range(2, 6):
            for i in range(len(codes) - k + 1):
                if all(codes[i : i + k]):
                    want[tuple(codes[i : i + k].tolist())] += 1
        got = Counter()
        for words, n in Bitmaps(codes).phrases(5):
            for w, c in zip(words.tolist(), n.tolist(), strict=True):
                got[tuple(w)] += c
        assert got == want


@pytest.mark.parametrize("shard", [1 << 20, 60])
def test_small_corpus(spark, monkeypatch, shard):
    monkeypatch.setattr(op, "LEAST", 3)
    monkeypatch.setattr(op, "SHARD_WORDS", shard)
    monkeypatch.setattr(op, "CHUNK", 64)
    rng = random.Random(6)
    words = ["In", "the", "long", "run", "é", "a", "a", "x\xa0y"]
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", ";\r", "!?", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    docs += [("en", None), ("en", ""), (None, " .\n "), ("de", "a " * 400), ("de", "b.b b.b b.b b")]
    df = spark.createDataFrame([(*d, 1, "n") for d in docs], "lang string, text string, rank int, phrase string")
    want = expected(docs, 3)
    assert len(want) > 50 and rows(collocations(df)) == want
    assert rows(collocations(df, 5)) == expected(docs, 3, 5)
    assert collocations(df.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    score = op.F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(38,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    a, n, left, right = 123_456_789_012_345, 98_765_432_109_876_543, 234_567_890_123_456, 345_678_901_234_567
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(score.alias("s")).first().s == 1000 * a * n // (left * right)


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    result = op11_collocations(spark, DATA).toPandas()
    assert len(result) > 50
    same_rows(result, con.execute(OP11_SQL).df())
