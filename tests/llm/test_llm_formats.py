"""Operators 2, 3, 4, 5 and 8: brute force, exact round trips, and the library tokenizers."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lodestone.llm import compaction
from lodestone.llm.common import fresh_path, table
from lodestone.llm.interleaved import as_page, decode_png, encode_png, interleave, interleaved_pages, op3_interleaved, parse_items, parse_sequences, read_media, store_media
from lodestone.llm.rans import BLOCK, LANES, pack_segment, quantise, unpack_segment
from lodestone.llm.token_counts import Counter as Counter_
from lodestone.llm.token_counts import default_vocabulary, token_counts, vocabulary
from lodestone.llm.token_output import PieceEncoder, read_tokens, token_output, write_tokens
from lodestone.llm.url_filter import RULES, url_verdicts

ODD_TEXTS = [None, "", " ", "\n\t ", "a", "é", "e\u0301", "日本語のテキスト", "\U0001f600\U0001f600x", "naïve café's don't I'LL", "x" * 5000, "ab " * 4000, "▁ ▁▁a ▁", "<unk> <s></s>", "a<unk>b", "<0x41>", "1234567890 12", "  two  blanks  ", "tab\tand\r\nlines\n\n", "ÀÖØöÿ ×÷", "<|endoftext|> inside", "\u00a0nbsp\u2003em", "\x00\x01\x7f", "ſ K"]


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def odd(spark):
    return spark.createDataFrame([(k, t, "html", 1) for k, t in enumerate(ODD_TEXTS)] + [(3, "same", "html", 1)] * 2 + [(None, "no id", None, None)], "doc_id long, text string, html string, media int")


# URL filter


def judged(df):
    return {p: (h, s, r, v, round(x, 6)) for p, h, s, r, v, x in rows(df, "page_id", "host", "path", "rule", "verdict", "score")}


def test_url_filter_on_pages(spark):
    pages = table(spark, SF, "pages")
    want = brute.url_verdicts(rows(pages, "page_id", "url"), RULES)
    assert judged(url_verdicts(pages)) == {p: (*w[:4], round(w[4], 6)) for p, w in want.items()}


def test_url_filter_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/x", "http://net", "http://a.net/", "http://example.net/en/1", "http://www.Example.NET/en/2?q", "http://example.net/EN/1", "http://notnet/x", "http://xexample.com/de/1", "https://example.com/de/ü", "a://b.org/fr/?x://y", "a://b.org/fr#z", "a://b.org/fr/x#z?y", "x://org?/fr/", "http://Ünet.com/de/\n2", "://org/fr/", "u://h/p" + "q" * 3000]
    pages = [(k, u) for k, u in enumerate(urls)]
    df = spark.createDataFrame([(k, u, k, "x") for k, u in pages] + [(4, urls[4], 0, "x")], "page_id long, url string, host int, verdict string")
    want = brute.url_verdicts([*pages], RULES)
    got = url_verdicts(df)
    assert got.count() == len(urls) + 1
    assert {p: g[:4] for p, g in judged(got).items() if g[2] or not g[0]}.items() >= {p: w[:4] for p, w in want.items() if w[2]}.items()
    assert {p: g[:2] for p, g in judged(got).items()} == {p: w[:2] for p, w in want.items()}
    one = url_verdicts(spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string"))
    assert {g[3] for g in judged(one).values()} == {"allow"}
    assert url_verdicts(df.limit(0)).count() == 0


# Media columns


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for n in (192, 384, 192 * 50):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        image = encode_png(payload)
        assert decode_png(image).tobytes() == payload
        assert struct.unpack(">II", image[16:24]) == (64, n // 192)
        with pytest.raises(ValueError):
            decode_png(image[:40] + bytes([image[40] ^ 1]) + image[41:])
    with pytest.raises(ValueError):
        decode_png(b"GIF89a")


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_media_of_texts(spark, tmp_path, source):
    if source == "odd":
        odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    folder = SF if source == "documents" else str(tmp_path)
    docs = rows(table(spark, folder, "documents"), "doc_id", "text")
    want = Counter()
    for d, text in docs:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        image = encode_png(payload)
        want[d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest()] += 1
    got = op3_interleaved(spark, folder)
    assert Counter(rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want
    assert got.where("feature is null or media <> 2 or caption is null").count() == 0
    halves = lambda t: [h for h in (t[: len(t) // 2], t[len(t) // 2 :]) if h.strip()]
    assert Counter(rows(got, "doc_id", "position", "texts", "text_bytes")) == Counter((d, 2 + bool((t or "")[: len(t or "") // 2].strip()), 1 + len(halves(t or "")), sum(len(h.encode()) for h in halves(t or ""))) for d, t in docs)


def test_interleaved_sequences_keep_positions_and_captions(spark, tmp_path):
    texts = ["first", "second"]
    store_media(spark.createDataFrame([(t,) for t in texts], "text string"), str(tmp_path / "m"))
    media = read_media(spark, str(tmp_path / "m"))
    digests = [hashlib.sha256(t.encode().ljust(192)).hexdigest() for t in texts]
    page = f"<p>before &amp; on</p><figure><img src='media:{digests[0]}' alt='a'><figcaption>one &lt; two</figcaption></figure>middle<script>no()</script><img src='media:{digests[1]}' alt='b'><img src='media:gone'><p>end"
    found = parse_sequences(spark.createDataFrame([(1, page), (2, "plain"), (3, None), (2, "plain")], "doc_id long, html string"), ["doc_id"])
    got = interleave(found, media, ["doc_id"]).collect()
    items = {r["doc_id"]: r["items"] for r in got}
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2]
    assert [(i["position"], i["kind"], i["text"], i["caption"], i["payload_sha256"]) for i in items[1]] == [(0, "text", "before & on", None, None), (1, "media", None, "one < two", digests[0]), (2, "text", "middle", None, None), (3, "media", None, "b", digests[1]), (4, "media", None, None, None), (5, "text", "end", None, None)]
    assert [i["text"] for i in items[2]] == ["plain"] and 3 not in items
    parts = parse_items(as_page('c"<', "<b>&x &amp;y", "d"))
    assert [(i["kind"], i["text"], i["digest"], i["caption"]) for i in parts] == [("text", 'c"<', None, None), ("media", None, 'cover of c"<', "cover"), ("text", "<b>&x ", None, None), ("media", None, "d", 'image of c"<'), ("text", "&amp;y", None, None)]


def test_pages_as_sequences(spark):
    pages = rows(table(spark, SF, "pages"), "page_id", "html")
    want = {}
    for p, page in pages:
        items = parse_items(page)
        told = "\n".join(f"{i['position']} {i['kind']} {i['text'] if i['text'] is not None else i['digest']}" for i in items)
        if items:
            want[p] = (sum(i["kind"] == "text" for i in items), sum(i["kind"] == "media" for i in items), hashlib.md5(told.encode()).hexdigest())
    assert {r[0]: r[1:] for r in rows(interleaved_pages(spark, SF), "page_id", "texts", "media", "outline_md5")} == want


# Sharding


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_compaction_keeps_rows_and_versions(spark):
    docs = table(spark, SF, "documents")
    store = compaction.ShardStore(spark, fresh_path(spark, "store"), docs.schema)
    assert store.versions() == [] and store.read().count() == 0 and store.compact() is None
    parts = [docs.where(F.pmod("doc_id", F.lit(5)) == k) for k in range(5)]
    for part in parts:
        store.append(part.coalesce(1))
    store.append(docs.limit(0))
    before = store.manifest()
    runs = [r["run"] for r in before.collect()]
    assert len(runs) == 5
    version = store.compact()
    assert version == store.latest() and store.compact() is None
    after = store.manifest().collect()
    assert len(after) == 1 and after[0]["inputs"] == 5 and after[0]["rows"] == docs.count() and after[0]["bytes"] <= after[0]["shards"] * compaction.TARGET_BYTES
    whole = as_counter(docs)
    assert as_counter(store.read()) == whole
    assert as_counter(store.read(3)) == sum(map(as_counter, parts[:3]), Counter())
    with pytest.raises(compaction.Conflict):
        store._commit(before, version)
    assert store.vacuum() == 0 and store.versions() == [version]  # within the grace time
    assert store.vacuum(grace=-60) == len(runs) + 1  # and the empty batch's folder
    assert as_counter(store.read()) == whole


def test_compaction_merges_by_size(spark, monkeypatch):
    """Runs of similar size are merged, larger ones wait for their like; the target is the caller's."""
    monkeypatch.setattr(compaction, "LEAST_BYTES", 0)
    numbers = spark.range(0, 40_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = compaction.ShardStore(spark, fresh_path(spark, "sizes"), numbers.schema)
    for k in range(4):
        store.append(numbers.where(F.col("doc_id").between(k * 2000, k * 2000 + 1999)).coalesce(1))
    for k in range(1, 4):
        store.append(numbers.where(F.col("doc_id").between(k * 8000, k * 8000 + 7999)).coalesce(2))
    assert [len(g) for g in store.due()] == [4]
    store.compact(target=200_000)
    assert [len(g) for g in store.due()] == [4] and sorted(r["inputs"] for r in store.manifest().collect()) == [1, 1, 1, 4]
    store.compact(target=200_000)
    (last,) = store.manifest().collect()
    assert last["shards"] > 1 and last["rows"] == 32_000 and store.compact() is None
    assert store.read().agg(F.count("*"), F.sum("doc_id")).first() == (32_000, 32_000 * 31_999 // 2)


def test_compaction_and_another_writer(spark):
    """An append that is committed during a merge stays; of two merges of the same runs one is dropped."""
    rows_ = spark.range(10).select(F.col("id").alias("doc_id"))

    class Interrupted(compaction.ShardStore):
        meanwhile = staticmethod(lambda: None)

        def _merge(self, runs, target):
            made = super()._merge(runs, target)
            self.meanwhile()
            return made

    store = Interrupted(spark, fresh_path(spark, "two"), rows_.schema)
    other = compaction.ShardStore(spark, store.root, rows_.schema)
    for _ in range(4):
        store.append(rows_)
    store.meanwhile = lambda: other.append(rows_)
    assert store.compact() == 6 and store.read().count() == 50
    assert sorted(r["rows"] for r in store.manifest().collect()) == [10, 40]
    for _ in range(3):
        store.append(rows_)
    store.meanwhile = lambda: other.compact()
    assert store.compact() is None and store.read().count() == 80 and store.manifest().count() == 1
    assert store.vacuum(grace=-60) == 4 + 4 + 2 and store.read().count() == 80


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_compaction_query_merges_on_small_tables(spark, folder):
    got = compaction.op4_compaction(spark, folder)
    assert got.where("merged").count() == got.count() == table(spark, folder, "documents").count()


def test_compaction_odd_rows(spark):
    rows_ = odd(spark).withColumn("run", F.lit("own"))
    store = compaction.ShardStore(spark, fresh_path(spark, "odd"), rows_.schema)
    for _ in range(4):
        store.append(rows_.coalesce(1))
    assert store.compact()
    assert as_counter(store.read()) == Counter({r: 4 * n for r, n in as_counter(rows_).items()})


# Token counts


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = vocabulary(default_vocabulary())
    library = Tokenizer(models.Unigram(pieces, unknown, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["a", "e", "th", "ing", " ", "▁", "é", "世", "ß", ".", "<unk>", "zz", "Q"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = rows(table(spark, SF, "documents"), "doc_id", "text") + list(enumerate([*ODD_TEXTS, *mixed], 10**6))
    got = dict(rows(token_counts(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_tokens"))
    want = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in docs}
    assert {d: (n, want[d]) for d, n in got.items() if n != want[d]} == {}


def test_token_counts_of_a_vocabulary_with_fractional_scores(spark):
    """Sums of fractions depend on their order: ties come out as in the library."""
    from tokenizers import Tokenizer, models

    rng = random.Random(11)
    pieces = [("<unk>", 0.0), ("▁", -2.1), *[(c, -rng.choice([0.1, 0.2, 0.3, 0.7, 1.1])) for c in "abcdef"]]
    for _ in range(120):
        piece = "".join(rng.choice("▁abcdef" if k == 0 else "abcdef") for k in range(rng.randint(2, 5)))
        if piece not in dict(pieces):
            pieces.append((piece, -round(rng.uniform(0.1, 3), 1)))
    library, own = Tokenizer(models.Unigram(pieces, 0)), Counter_(pieces, 0)
    for _ in range(3000):
        word = "▁" + "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 14)))
        assert own.word(word)[0] == len(library.encode(word).ids), word


def test_token_counts_odd_tables(spark):
    assert token_counts(odd(spark)).count() == len(ODD_TEXTS) + 3
    assert token_counts(odd(spark).limit(0)).count() == 0
    assert rows(token_counts(odd(spark).where("doc_id in (0, 1)")), "n_tokens", "score") == [(0, 0.0)] * 2


# Token-ID output


def test_rans_round_trip():
    rng = np.random.default_rng(3)
    for ids in ([0], [7] * 5000, rng.integers(0, 50257, 70_000), rng.zipf(1.3, BLOCK + 77) % 50257, np.arange(LANES + 1)):
        ids = np.asarray(ids, np.uint32)
        ids_table, blocks = pack_segment(ids)
        assert (unpack_segment(ids_table, blocks) == ids).all()
        last = blocks[-1]
        assert (unpack_segment(ids_table, [last]) == ids[last["at"] :]).all()  # a block alone
        with pytest.raises(ValueError):
            unpack_segment(ids_table, [last | {"data": last["data"][:-1] + bytes([last["data"][-1] ^ 1])}])
    many = rng.permutation(200_000).astype(np.uint32)  # more distinct ids than the table holds
    ids_table, blocks = pack_segment(many)
    assert (unpack_segment(ids_table, blocks) == many).all() and (unpack_segment(ids_table, [blocks[-1]]) == many[blocks[-1]["at"] :]).all()
    skewed = rng.zipf(1.3, 200_000) % 50257
    assert sum(len(b["data"]) for b in pack_segment(skewed.astype(np.uint32))[1]) < 2 * len(skewed)
    for counts in ([1], [1] * 50257, [10**9] + [1] * 50000):
        f = quantise(np.array(counts))
        assert f.sum() == 1 << 16 and f.min() >= 1


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_are_the_library_s(library):
    import public_tokenizers

    own, rng = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    parts = ["a", "Z", "é", "ÿ", "×", "÷", "_", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\r", "9", "12", ".", "--", "the", "\xa0", "\x1c", "日", "<|endoftext|>", "ª", "²"]
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_of_other_vocabularies(library, tmp_path):
    """A vocabulary that cuts or spells texts otherwise isn't cut into pieces here."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    for change in ("pre_tokenizer", "normalizer", "split"):
        other = Tokenizer.from_str(library.to_str())
        if change == "pre_tokenizer":
            other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
        elif change == "normalizer":
            other.normalizer = normalizers.Lowercase()
        else:
            other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
        other.save(str(tmp_path / change))
        own = PieceEncoder(str(tmp_path / change))
        for text in ("The Cat 1234 sat", "x", ""):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_token_output_keeps_large_ids_beside_nulls(spark, library):
    ids = [2**53 + 1, 2**53 + 3, None, None, -(2**62) - 1, 2**63 - 1]
    docs = spark.createDataFrame([(d, f"text {k}") for k, d in enumerate(ids)], "doc_id long, text string")
    assert sorted(rows(token_output(docs), "doc_id"), key=str) == sorted([(d,) for d in ids], key=str)


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_token_output(spark, library, source):
    docs = table(spark, SF, "documents") if source == "documents" else odd(spark)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    want, start = [], 0
    for d, text in sorted(rows(docs, "doc_id", "text"), key=order):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows(token_output(docs), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1]) == want


def test_token_files_in_small_segments(spark, library, tmp_path):
    import public_tokenizers

    docs = table(spark, SF, "documents").limit(60)
    write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), end_id=5, segment=1000)
    back = rows(read_tokens(spark, str(tmp_path / "t")), "doc_id", "start", "ids")
    assert {d: ids for d, _, ids in back} == {d: [*library.encode(t, add_special_tokens=False).ids, 5] for d, t in rows(docs, "doc_id", "text")}
    ends = sorted((s, s + len(ids)) for _, s, ids in back)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert token_output(docs.limit(0)).count() == 0
