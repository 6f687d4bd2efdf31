"""Operators 1, 6, 7 and the pipeline against their brute-force versions."""

from __future__ import annotations

import random
import zlib

import brute
import pytest
from conftest import SF

from lodestone.llm.common import table
from lodestone.llm.components import connected_components
from lodestone.llm.decontamination import contaminated, decontaminate
from lodestone.llm.jaccard_join import near_duplicates, one_of_each_group
from lodestone.llm.mixing import OP7_SQL, mix, mixed_documents, op7_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def copies_fixture():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append(" ".join(own[rng.choice([0, 0, 1]) :]).upper() if rng.random() < 0.3 else "\t".join(own))
    docs += ["", None, " \n\x0b", "a b", "A  b", "b a", "one", "a b c d e", "a b c d e f", "\xa0word x", "a " * 3000, "a " * 3001]
    return [(k * 7 % 1009, t) for k, t in enumerate(docs)]


def test_jaccard_join_finds_what_all_pairs_give(spark):
    docs = copies_fixture()
    got = {d: (n, c) for d, n, c in rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")}
    assert got == brute.components(docs)


def test_jaccard_join_on_documents(spark):
    docs = rows(table(spark, SF, "documents"), "doc_id", "text")
    got = {d: (n, c) for d, n, c in rows(near_duplicates(table(spark, SF, "documents")), "doc_id", "n_shingles", "component_id")}
    assert got == brute.components(docs)


def test_jaccard_join_hot_copies(spark):
    """A large group of copies and a large group of near copies stay one component each."""
    base = " ".join(f"x{k}" for k in range(60))
    near = [" ".join(f"y{k}" if k != 59 or j % 7 else f"z{j}" for k in range(60)) for j in range(150)]
    docs = [(k, base) for k in range(300)] + [(1000 + k, t) for k, t in enumerate(near)]
    got = rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "component_id")
    assert sorted(got) == sorted([(k, 0) for k in range(300)] + [(1000 + k, 1000) for k in range(150)])


def test_jaccard_join_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicates(empty).count() == 0 and one_of_each_group(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", 5, 9), (1, "a b c d e f", 5, 9), (None, "a b c d e f", 1, 1), (2, "A b c d e F", 1, 1)], "doc_id long, text string, n int, component int")
    assert sorted(rows(near_duplicates(odd), "doc_id", "n_shingles", "component_id")) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    kept = one_of_each_group(odd)
    assert kept.columns == odd.columns and rows(kept, "doc_id", "n") == [(1, 5)]
    alone = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 2), (None, "other words of its own here", 3), (7, "", 4), (8, None, 5)], "doc_id long, text string, row int")
    assert sorted(rows(one_of_each_group(alone), "doc_id", "text"), key=str) == sorted([(None, "a b c d e f"), (None, "other words of its own here"), (7, ""), (8, None)], key=str)


def test_jaccard_join_of_many_unlike_texts_that_share_words(spark, monkeypatch):
    """More than HOT texts of different groups share their rarest shingles: they meet by tokens of the other orders."""
    from lodestone.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HOT", 4)
    rng = random.Random(3)
    common = [f"c{k}" for k in range(40)]
    docs = []
    for k in range(60):
        own = [f"u{k // 2}x{j}" for j in range(rng.choice([8, 10, 12]) if k % 2 else 9)]
        docs.append((k, " ".join(common + own if k % 3 else own + common)))
    got = {d: (n, c) for d, n, c in rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")}
    assert got == brute.components(docs)


def test_jaccard_join_holds_one_large_component_against_the_few_others(spark):
    """However many documents of one component share a shingle, few others beside them need no narrower keys, and no pair is lost."""
    from lodestone.llm import jaccard_join

    docs = [(1, k, 40, 0, 0) for k in range(400)] + [(1, 400 + k, 40, 0, 400 + k // 2) for k in range(6)] + [(2, k, 40, 0, 0) for k in range(9)]
    few, hot = jaccard_join._by_key(spark.createDataFrame(docs, "token long, doc_id long, n int, rank int, component long"), ["token"])
    want = {(a, b) for t, a, _, _, x in docs for u, b, _, _, y in docs if t == u and a < b and x != y}
    got = rows(jaccard_join._pairs(few, ["token"]), "a", "b")
    assert hot.isEmpty() and len(got) == len(want) == 400 * 6 + 12 and set(got) == want


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (201, 200), (201, 200)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def leak_rows(df):
    return {(d, i): (m, n, s) for d, i, m, n, s in rows(df, "doc_id", "item_id", "matched", "length", "doc_start")}


def test_decontamination_on_documents(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = brute.leaks(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))
    assert want and leak_rows(contaminated(docs, items)) == want


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(8)
    item = [f"i{k}" for k in range(40)]
    filler = lambda n: [f"f{rng.randrange(500)}" for _ in range(n)]
    docs = []
    for k in range(30):
        own = list(item)
        for at in rng.sample(range(40), k % 6):
            own[at] = "other"
        docs.append((k, " ".join([*filler(rng.randint(0, 50)), *own, *filler(rng.randint(0, 50))]).upper()))
    short = [f"s{k}" for k in range(11)]
    docs += [(200, " ".join(filler(20) + short + filler(20))), (201, " ".join(short[:10])), (202, " ".join(short[:7]).upper()), (203, " ".join(filler(3) + short[:6])), (204, "s0 s1 s2 s3")]
    docs += [(100, " ".join(item[:9])), (101, " ".join(filler(200))), (102, None), (103, ""), (104, " ".join(item[:11] + filler(30)))]
    items = [(1, " ".join(item)), (2, "too short to hit"), (3, None), (4, " ".join(item)), (5, " ".join(short)), (6, " ".join(short[:7])), (7, "s0 s1 s2 s3"), (8, " ".join(short[:5]))]
    got = leak_rows(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute.leaks(docs, items)
    assert {(k, i) for k in range(30) for i in (1, 4)} == {k for k in got if k[1] in (1, 4)}
    assert {k for k in got if k[1] > 4} == {(200, 5), (200, 6), (200, 8), (201, 6), (201, 8), (202, 6), (202, 8), (203, 8)}


def test_decontamination_odd_tables(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(1, passage, 3), (1, passage, 4), (None, passage, 5), (2, "clean", 6)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, passage, 1), (7, passage, 2), (None, passage, 3)], "item_id long, text string, doc_id int")
    assert sorted(rows(contaminated(docs, items), "doc_id", "item_id", "matched"), key=str) == [(1, 7, 20), (None, 7, 20)]
    assert sorted(rows(decontaminate(docs, items), "doc_id", "item_id"), key=str) == [(2, 6)]
    assert contaminated(docs.limit(0), items).count() == contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == 4


def test_decontamination_of_repetitive_texts(spark, monkeypatch):
    """A repeated line against a repetitive item, and hits on both sides of a region's border."""
    from lodestone.llm import decontamination

    monkeypatch.setattr(decontamination, "REGION", 16)
    line = [f"r{k % 6}" for k in range(24)]
    docs = [(1, " ".join(line * 20)), (2, " ".join(["x"] * 15 + line)), (3, " ".join(line[5:] + ["y"] * 40 + line[:20])), (4, " ".join(["z"] * 90))]
    items = [(1, " ".join(line)), (2, " ".join(line * 3))]
    got = leak_rows(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute.leaks(docs, items) and {d for d, _ in got} == {1, 2, 3}


def mixed(df):
    return sorted((r["row"]["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in mix(df, ["doc_id"]).collect())


def test_mixing_on_documents(spark, duck):
    from conftest import same_rows

    docs = rows(table(spark, SF, "documents"), "doc_id", "source", "text")
    want = sorted((d[0], n, s, round(t, 6), c) for d, (n, s, t, c) in zip(docs, brute.mix(docs), strict=True))
    assert mixed(table(spark, SF, "documents")) == want
    same_rows(op7_mixing(spark, SF).toPandas(), duck.execute(OP7_SQL).df())


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(2)
    docs = [(k, "w " * rng.choice([0, 1, 5, 30, 400]), "l", rng.choice(["hot", "hot", "hot", "b", "\U0001f600", "￿", None]), 1) for k in range(900)] + [(5000, "one two", "l", "tiny", 1)]
    df = spark.createDataFrame(docs, DOCS)
    got = mixed(df)
    assert got == sorted((d[0], n, s, round(t, 6), c) for d, (n, s, t, c) in zip(docs, brute.mix([(d, s, t) for d, t, _, s, _ in docs]), strict=True))
    source = {d: s for d, _, _, s, _ in docs}
    for name in {*source.values()}:
        own = [g for g in got if source[g[0]] == name]
        assert abs(sum(n * c for _, n, _, _, c in own) - own[0][3]) <= 3 * 400
    assert max(g[4] for g in got) <= 3


def test_mixing_odd_tables(spark):
    assert mix(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0
    same = spark.createDataFrame([(1, "a b c", "x", None, 1)] * 3 + [(2, None, "x", None, 1), (None, "d", "x", "s", 1)], DOCS)
    docs = rows(same, "doc_id", "source", "text")
    got = sorted(((r["row"]["doc_id"], r["size"], r["copies"]) for r in mix(same, ["doc_id"]).collect()), key=str)
    assert got == sorted(((d[0], n, c) for d, (n, _, _, c) in zip(docs, brute.mix(docs), strict=True)), key=str)
    assert mixed_documents(same).columns == same.columns
    clash = spark.createDataFrame([(k, "a b", "x", 70 + k, "s", "p", 5) for k in range(2)], "doc_id long, text string, source string, size int, slice string, place string, copies int")
    assert sorted(rows(mixed_documents(clash), "doc_id", "size", "copies")) == [(0, 70, 5), (1, 71, 5)]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pipeline_by_stages(spark, vocabulary, tmp_path_factory):
    """The last four stages against brute force, each on what the first one keeps."""
    import corpus_pipeline
    from conftest import SF

    docs = table(spark, SF, "documents")
    safe = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert safe.columns == docs.columns
    kept = [tuple(r) for r in safe.select("doc_id", "source", "text").collect()]
    assert 0.5 * docs.count() < len(kept) < docs.count()
    found = brute.components([(d, t) for d, _, t in kept])
    kept = [r for r in kept if found[r[0]][1] == r[0]]
    leaked = {d for d, _ in brute.leaks([(d, t) for d, _, t in kept], rows(table(spark, SF, "benchmark"), "item_id", "text"))}
    kept = [r for r in kept if r[0] not in leaked]
    copies = [(r[0], r[2]) for r, (*_, c) in zip(kept, brute.mix(kept), strict=True) for _ in range(c)]
    want, start = [], 0
    for d, text in sorted(copies):
        ids = [*vocabulary.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(rows(corpus_pipeline.run(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, an extra column with an odd name, repeated rows; and an empty table."""
    import corpus_pipeline

    passage = " ".join(f"p{k}" for k in range(20))
    texts = [(1, passage), (2, "some clean words in a row"), (2, "some clean words in a row"), (3, None), (None, passage), (None, "no id but words of its own"), (4, ""), (5, "x" * 9000)]
    docs = spark.createDataFrame([(d, t, None, "s" if d else None, None, "x") for d, t in texts], DOCS + ", size string")
    spark.createDataFrame([(1, passage), (None, "null")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows_, want in ((docs, {2, 5, None}), (docs.limit(0), set())):
        now = rows_
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
            if name == "benchmark_decontamination":  # the mix may leave some of these out
                assert {d for d, t in rows(now, "doc_id", "text") if t} == want and now.count() == len(want) + 2 * bool(want)
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert out.count() == now.count()
