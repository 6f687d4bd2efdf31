"""Operator 12 against all pairs."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from conftest import SF

from lodestone.llm import hamming_join
from lodestone.llm.common import table
from lodestone.llm.hamming_join import CHUNKS, DISTANCE, EDGES, ERRORS, PARTS, near_duplicates, op12_hamming_join, signatures


def components(docs):
    sets = {d: brute.shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) >= 85 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def varied(seed, bases, most):
    """Texts with up to 12 exchanged words, many about the threshold."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 12])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own).upper() if rng.random() < 0.3 else "\n".join(own))
    docs += ["", None, " \n\x0b", "a b", "A  b", "b a", "one", "a b c d e", "a b c d e f", "\xa0word x", "a " * 3000, "a " * 3001]
    return [(k * 7 % 4999, t) for k, t in enumerate(docs)]


def test_keys_meet_whatever_parts_differ():
    """Any DISTANCE parts leave a chunk with ERRORS parts at most."""
    assert ERRORS == 1 and EDGES[0] == 0 and EDGES[-1] == PARTS and (ERRORS + 1) * CHUNKS > DISTANCE
    rng = np.random.default_rng(1)
    for _ in range(2000):
        gone = np.zeros(PARTS, int)
        gone[rng.choice(PARTS, DISTANCE, replace=False)] = 1
        assert np.add.reduceat(gone, EDGES[:-1]).min() <= ERRORS


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(2)
    a = [rng.integers(0, 1 << 62, 400, dtype=np.uint64) for _ in range(200)]
    b = [np.concatenate((x[:340], rng.integers(0, 1 << 62, 40, dtype=np.uint64))) for x in a]
    apart = (signatures(a) != signatures(b)).mean()
    assert abs(apart - (1 - 340 / 440)) < 0.02


def test_all_pairs(spark):
    docs = varied(4, 30, 6)
    assert found(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == components(docs)


def test_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert found(op12_hamming_join(spark, SF)) == components(docs)


@pytest.mark.parametrize("stars", [0, 2])
def test_hot_keys_go_block_by_block(spark, monkeypatch, stars):
    """Most links come from keys that more than HOT documents share; without hubs all come from the last step."""
    monkeypatch.setattr(hamming_join, "STARS", stars)
    monkeypatch.setattr(hamming_join, "HOT", 4)
    monkeypatch.setattr(hamming_join, "BLOCK", 6)
    docs = varied(9, 3, 40)
    assert found(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == components(docs)


def test_odd_tables(spark):
    text = "a b c d e f g"
    rows = [(1, text, 1, 2), (1, text, 1, 2), (None, text, 3, 4), (5, text.upper(), 5, 6), (None, "x y", 0, 0), (None, "x y", 0, 0), (None, None, 0, 0), (-3, "x  Y", 0, 0), (None, "no one else has this", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int, node int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (5, 3, 1, False), (None, 1, -3, False), (None, 1, -3, False), (-3, 1, -3, True), (None, 0, None, False), (None, 1, None, False)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).count() == 0
