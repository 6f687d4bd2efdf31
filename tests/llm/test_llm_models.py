"""Operators 9 and 10: exact counts, probabilities that add up, held-out scores and accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from lodestone.llm.common import table
from lodestone.llm.context_mixing import PIECE, SLOTS, Code, Learner, Mixer, canonical, code_lengths, pieces, tokens
from lodestone.llm.lm_scoring import _packed, _summed, lm_scores
from lodestone.llm.shingles import word_hashes
from lodestone.llm.toxicity import text_words, toxicity_scores, train, windows, without_toxic


def held_out(doc_id, n, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == remainder


def base_scores(docs):
    """docs: (doc_id, text) -> rows (doc_id, held_out, n_tokens, n_known, N, base_score)."""
    count = Counter()
    for d, t in docs:
        if not held_out(d, 7, 2):
            count.update([*brute.words(t), ""])
    n = sum(count.values())
    log_p = lambda w: math.log10((count[w] + 1) / (n + 1 * (len(count) + 1)))
    out = []
    for d, t in docs:
        w = [*brute.words(t), ""]
        out.append((d, held_out(d, 7, 2), len(w), sum(count[x] > 0 for x in w), n, round(sum(map(log_p, w)), 4)))
    return out


def as_rows(df):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in df]


def test_lm_scores_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = lm_scores(table(spark, SF, "documents")).collect()
    assert sorted(as_rows(got)) == sorted(base_scores(docs))
    assert all(r["score"] < 0 for r in got)
    for r in got:
        n_bytes = len((dict(docs)[r["doc_id"]] or "").encode())
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / max(1, n_bytes))


def test_lm_predicts_held_out_documents_better_than_counts(spark):
    """Two languages that share no word: the document tells its class."""
    rng = np.random.default_rng(4)
    docs = [(k, " ".join(f"{'ab'[k % 2]}{n}x" for n in rng.zipf(1.5, 80) % 400), "ab"[k % 2]) for k in range(300)]
    got = [r for r in lm_scores(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.95 * sum(r["base_score"] for r in got)


def test_lm_beats_the_base_score_on_held_out_documents(spark):
    """From texts alone; and copies of training documents are told from fresh ones."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = lm_scores(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    texts = dict(docs.collect())
    trained = {texts[r["doc_id"]] for r in got if not r["held_out"]}
    gain = {seen: [(r["score"] - r["base_score"]) / r["n_tokens"] for r in held if r["n_tokens"] > 30 and (texts[r["doc_id"]] in trained) == seen] for seen in (True, False)}
    assert not gain[True] or np.mean(gain[True]) > np.mean(gain[False]) + 0.5


def test_lm_scores_odd_tables(spark):
    texts = [(1, "a b c a", "x"), (1, "a b c a", "x"), (2, None, None), (4, "", "y"), (None, "A é \xa0 b", "x"), (5, "new words " * 2000, "z"), (9, " \n ", "x"), (12, "hapax", "x")]
    df = spark.createDataFrame([(*t, 1, 2.0) for t in texts], "doc_id long, text string, lang string, hash int, score double")
    assert sorted(as_rows(lm_scores(df).collect()), key=str) == sorted(base_scores([t[:2] for t in texts]), key=str)
    assert lm_scores(df.limit(0)).count() == 0
    only = next(k for k in range(100) if held_out(k, 7, 2))
    alone = lm_scores(spark.createDataFrame([(only, "never seen")], "doc_id long, text string")).first()
    assert (alone["train_tokens"], alone["n_known"], alone["n_tokens"]) == (0, 0, 3) and math.isfinite(alone["score"])


def small_model(train, least=2):
    """A mixer trained on a few texts, its dictionary the words that occur often enough."""
    count = Counter(w for t in train for w in t.lower().split())
    held = sorted(w for w, c in count.items() if c >= least)
    counts = np.array([count[w] for w in held], np.int64)
    code = Code(held, word_hashes(held)[0], counts, len(train), sum(count.values()) - int(counts.sum()))
    table = np.zeros((SLOTS, 2), np.uint32)
    learner = Learner(table)
    for at in range(0, len(train), 8):
        learner.learn(code, train[at : at + 8])
    return Mixer(code, table.astype(np.float32), learner.weights, learner.hits, learner.total)


def scores(model, texts):
    return sum(model.score(t, len(texts)) for t in tokens(model.code, texts))


def test_codes_are_prefix_free_and_complete():
    for counts in ([5, 1, 1, 9, 30, 2], [1] * 7, [1 << k for k in range(40)], [3], [1, 1]):
        lengths = code_lengths(np.array(counts, np.int64))
        words = [format(c, f"0{n}b") for c, n in zip(canonical(lengths).tolist(), lengths.tolist(), strict=True)]
        assert all(n <= 30 for n in lengths) and not any(a != b and b.startswith(a) for a in words for b in words)
        assert len(counts) < 2 or sum(2.0**-n for n in lengths.tolist()) == 1


def test_mixer_scores_as_a_loop_over_decisions():
    """The same model by plain loops over exact contexts, one decision at a time."""
    rng = np.random.default_rng(9)
    words = [b"the", b"of", b"und", b"der", b"la"] + [bytes(rng.choice(list(b"abcdef"), rng.integers(1, 7)).tolist()) for _ in range(60)]
    text = lambda: b" ".join(words[min(k, len(words)) - 1] for k in rng.zipf(1.3, rng.integers(0, 60)).tolist())
    train = [text() for _ in range(40)] + [b"x y z the the of " * 6, b""]
    fresh = [text(), b"", b"x y z the x y z the x y z unseen", b"The  Of\nTHE", "é unbekannt".encode()]
    model = small_model(train)
    assert scores(model, fresh).tolist() == pytest.approx([brute.mixed_score(model, train, t) for t in fresh], rel=2e-3)


def test_learner_corrects_by_every_decision(monkeypatch):
    """No batch is left out of the weights and the last stage, however many there are."""
    from lodestone.llm import context_mixing

    monkeypatch.setattr(context_mixing, "BATCH", 64)
    train = [b" ".join(b"w%d" % (k * j % 37) for j in range(400)) for k in range(1, 9)]
    held = sorted({w for t in train for w in t.split()})
    code = Code(held, word_hashes(held)[0], np.full(len(held), 5, np.int64), len(train), 0)
    learner = Learner(np.zeros((SLOTS, 2), np.uint32))
    learner.learn(code, train)
    batches = [len(bit) for t in tokens(code, train) for _, _, bit, *_ in context_mixing.walk(code, t)]
    assert len(batches) > 100 and learner.mass == learner.total.sum() == sum(batches)


def test_learner_reads_a_slot_once():
    """Both counts of a slot come with one read, the dearest step of learning."""
    from lodestone.llm import context_mixing

    reads = []

    class Counted(np.ndarray):
        def take(self, *args, **kwargs):
            reads.append(len(args[0]))
            return super().take(*args, **kwargs)

    train = [b"a b c a b d", b"b a unseen"]
    code = Code([b"a", b"b"], word_hashes([b"a", b"b"])[0], np.array([3, 3], np.int64), 2, 3)
    learner = Learner(np.zeros((SLOTS, 2), np.uint32).view(Counted))
    learner.learn(code, train)
    want = [len(slot) for t in tokens(code, train) for _, slots, *_ in context_mixing.walk(code, t) for slot in slots]
    assert sorted(reads) == sorted(want) and learner.table.sum() == sum(want)


def test_mixer_gives_probabilities():
    """All texts of one word and its end come to 1 at most, and a known word is likelier than a misspelt one."""
    model = small_model([b"the then there a an and"] * 5 + [b"a the", b"an"] * 20)
    every = [b"", b"the", b"then", b"there", b"a", b"an", b"and", *[bytes([x]) for x in range(256) if chr(x) not in " \t\n\x0b\f\r"]]
    assert (10 ** scores(model, every)).sum() <= 1 + 1e-3
    one, other = scores(model, [b"then", b"thqn"])
    assert one > other


def test_lm_score_knows_the_order_of_words(spark):
    """The same words in another order are another text: contexts run across the ends of words."""
    ids = [k for k in range(2000) if not held_out(k, 7, 2)][:400]
    fresh = [k for k in range(2000) if held_out(k, 7, 2)][:3]
    rng = np.random.default_rng(2)
    sentence = ["one", "two", "three", "four", "five", "six"]
    docs = [(k, " ".join(sentence[(s + j) % 6] for j in range(30))) for k, s in zip(ids, rng.integers(0, 6, len(ids)), strict=True)]
    plain = " ".join(sentence * 5)
    docs += [(fresh[0], plain), (fresh[1], " ".join(sorted(plain.split()))), (fresh[2], plain.replace(" ", " \n ").upper())]
    got = {r["doc_id"]: r["score"] for r in lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[fresh[0]] > got[fresh[1]] + 5 and got[fresh[0]] == pytest.approx(got[fresh[2]])


def test_mixer_takes_long_texts_whole():
    """Every word of a text over several pieces is coded, and its end once; no piece breaks a word."""
    text = b"ab cdefg " * 300_000 + b"z" * (PIECE + 5) + b" q"
    model = small_model([b"ab cd"] * 3)
    found = [t for t in tokens(model.code, [text, b"", b" \n"])]
    assert sum(int((t.owner == 0).sum()) for t in found) == 600_003 and sum(int(t.end.sum()) for t in found) == 3
    parts = [p for group in pieces([text]) for p in group[0]]
    assert b"".join(parts) == text and len(parts) > 2 and all(len(p) < 2 * PIECE + 8 for p in parts)


def auc(pairs):
    good, bad = [s for s, y in pairs if not y], [s for s, y in pairs if y]
    return sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(good) * len(bad))


def test_toxicity_held_out(spark):
    """A seventh of the toxic labels are noise there, which bounds the area at about 0.93."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    truth = dict(labels.select("doc_id", "toxic").where("toxic is not null").collect())
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r["held_out"] == held_out(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    fresh = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert auc([f[:2] for f in fresh]) > 0.9
    assert np.mean([p == y for _, y, p in fresh]) > 0.92
    assert np.mean([p for _, y, p in fresh if not y]) < 0.02


def test_toxicity_scores_know_neither_held_out_labels_nor_other_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = lambda df: {r["doc_id"]: round(r["score"], 9) for r in df.collect()}
    fewer = labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    assert scores(toxicity_scores(docs.select("doc_id", "text"), fewer)) == scores(toxicity_scores(docs, labels))


def test_misspelt_words_share_vectors():
    rng = np.random.default_rng(0)
    plain = [f"plain{k}".encode() for k in range(60)]
    bad = [b"horridness", b"vilestuff", b"scumbaggery"]
    texts, labels = [], []
    for k in range(200):
        own = list(rng.choice(plain, 30))
        if k % 2:
            for at in rng.integers(0, 30, 4):
                own[at] = bad[rng.integers(3)]
        texts.append(b" ".join(own))
        labels.append(k % 2)
    model = train(texts, np.array(labels))
    score = lambda t: model.score(model.worst(np.array(model.words(text_words(t)))))
    assert score(b"plain1 plain2 horidness plain3 plain4 plain5") > score(b"plain1 plain2 plain9 plain3 plain4 plain5") * 100


def test_windows_cover_all_words():
    for n in range(60):
        first, last = windows(n)
        assert set(range(n)) == {k for a, b in zip(first, last) for k in range(a, b)}


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, "fine words", 1), (1, "fine words", 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (None, "x " * 9000, 1), (5, "é\xa0ü", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity_scores(docs, none).collect()] == pytest.approx([0.0] * 7, abs=1e-9)
    odd = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 0, 1), (3, None, None), (5, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity_scores(docs, odd).count() == 7
    assert without_toxic(docs, none).columns == docs.columns and without_toxic(docs, none).count() == 7
    assert toxicity_scores(docs.limit(0), odd).count() == 0


def test_counts_above_2_to_24_are_exact():
    """Single additions to a large count still count, in a task, on the way and in the sum of a page."""
    counts = np.zeros((SLOTS, 2), np.uint32)
    counts[5] = (1 << 24, 254)
    counts[7] = (0, 255)
    learner = Learner(counts)
    np.add.at(learner.table, np.array([10, 10, 10]), 1)  # slot 5, zeros
    parts = pa.Table.from_batches([_packed(0, counts)] * 3)
    total = _summed(parts)
    assert total.dtype == np.int64 and total[5].tolist() == [3 * ((1 << 24) + 3), 3 * 254] and total[7].tolist() == [0, 765]
    assert total.sum() == 3 * int(counts.sum())
