"""Operator 13 against plain loops over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from conftest import SF

from lodestone.llm.common import table
from lodestone.llm.periodic_runs import document_runs, op13_periodic_runs, periodic_runs, runs_of


def all_runs(x, times=2, least=2):
    """Every maximal stretch with smallest period q and at least max(least, times * q) symbols, by loops."""
    out, n = [], len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                own = x[i : j + q]
                if not any(own[r:] == own[:-r] for r in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted=True):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(own), zlib.crc32(str(doc_id).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)]
    runs = all_runs(own, 4, 6)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(own) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(told), sha(kept))


def test_all_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randint(1, 40), rng.choice([1, 2, 2, 3, 4])
        x = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5:
            p, a = rng.randint(1, 8), rng.randrange(n)
            x = [x[min(n - 1, a + (i - a) % p)] if i >= a else x[i] for i in range(n)]
        got = sorted(zip(*[v.tolist() for v in runs_of(np.array([*x, kinds]))], strict=True), key=lambda r: (r[0], r[2]))
        assert got == all_runs(x)
        words = [b"%d" % v for v in x]
        assert document_runs([words, [], words])[::2] == [all_runs(words, 4, 6)] * 2


def test_runs_of_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op13_periodic_runs(spark, SF).collect()]
    assert sorted(got) == sorted(expected(*d) for d in docs)
    assert sum(1 for r in got if r[1]) >= len(docs) // 20


def test_odd_texts(spark):
    texts = [None, "", " \n\x0b", "a", "a " * 5, "a " * 6, "A a " * 4, "ab\tab\x0cab\rab ab  ab", "x y z " * 4 + "x", "\xa0 \xa0 " * 3, "a b " * 8 + "b a " * 8, "a " * 40000, "p q r s t " * 9000]
    rows = [(k if k != 3 else None, t, "x", 1) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int")
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.collapsed) for r in periodic_runs(df).collect()}
    want = {(4, 0, None, None, None, "a a a a a"), (5, 1, 0, 6, 1, "a"), (6, 1, 0, 8, 2, "A a"), (7, 1, 0, 6, 1, "ab"), (8, 1, 0, 13, 3, "x y z"), (9, 1, 0, 6, 1, "\xa0"), (11, 1, 0, 40000, 1, "a"), (12, 1, 0, 45000, 5, "p q r s t")}
    assert want | {(0, 0, None, None, None, ""), (1, 0, None, None, None, ""), (2, 0, None, None, None, ""), (None, 0, None, None, None, "a")} <= got
    assert (10, 2, 0, 16, 2, "a b b a") in got and len(got) == len(texts)
    assert periodic_runs(df.limit(0)).count() == 0
