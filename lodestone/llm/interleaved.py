"""Media columns (operator 3): interleaved sequences of text and media references, whose payloads a digest join resolves.

store_media() writes payloads as images: 8-bit RGB samples, 64 pixels (192 bytes) a row, in PNG, named by the SHA-256 of the
payload. parse_sequences() turns HTML into the ordered items of a page: stretches of text, and media references with their
caption. read_media() reads the stored images back and computes features. interleave() joins them to the references by digest
and gives whole pages again: an array of items in order, positions and captions as they were.

Defined results: null HTML and null text are empty; an empty page has no items, and no row; an empty text has a payload of
blanks; a reference without a stored payload keeps nulls; rows that repeat stay, each as a page; rows without an id are kept;
an empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_path, table

WIDTH, ROW = 64, 192
SCHEME = "media:"
ITEM = "position int, kind string, text string, digest string, caption string"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Rows that a task holds as Python objects at once.
ROWS = 128
_HEAD = b"\x89PNG\r\n\x1a\n"


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, ROWS rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def pad(data: bytes) -> bytes:
    """data with blanks up to a positive multiple of ROW."""
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1)  # each line's filter: none
    return _HEAD + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples (rows, ROW) of an image that encode_png wrote; raises on a wrong checksum or another kind of image."""
    if data[:8] != _HEAD:
        raise ValueError("not a PNG image")
    at, packed, size = 8, b"", (0, 0)
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("PNG chunk with a wrong checksum")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], 1 + 3 * size[0])
    if lines[:, 0].any():
        raise ValueError("PNG with line filters")
    return lines[:, 1:]


class _Items(HTMLParser):
    """Ordered items: text between block tags, and images with their caption (figcaption, else alt)."""

    BLOCKS = {"p", "div", "figure", "figcaption", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "table", "tr", "td", "body", "nav", "footer", "header", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = self.in_caption = 0
        self.open_figure = -1  # the figure's first item

    def end_text(self) -> None:
        text = "".join(self.text)
        self.text = []
        if not text.strip():
            return
        if self.in_caption:
            for item in self.items[max(0, self.open_figure) :]:
                if item["kind"] == "media":
                    item["caption"] = text
        else:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in self.BLOCKS or tag == "img":
            self.end_text()
        if tag == "figure":
            self.open_figure = len(self.items)
        if tag == "figcaption":
            self.in_caption += 1
        if tag == "img":
            a = dict(attrs)
            source = a.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": source.removeprefix(SCHEME) if source.startswith(SCHEME) else source, "caption": a.get("alt")})

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BLOCKS:
            self.end_text()
        if tag == "figcaption":
            self.in_caption = max(0, self.in_caption - 1)

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def parse_items(page: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(page or "")
    parser.close()
    parser.end_text()
    return [{"position": k} | item for k, item in enumerate(parser.items)]


def as_page(name: str, text: str, digest: str) -> str:
    """A page that shows a text's payload between the halves of the text, after its name and a picture that isn't stored."""
    half, caption, quoted = len(text) // 2, html.escape(f"image of {name}"), html.escape(name)
    before, after = (html.escape(t, quote=False) for t in (text[:half], text[half:]))
    return f'<article><h1>{quoted}</h1><img src="{SCHEME}cover of {quoted}" alt="cover"><pre>{before}</pre><figure><img src="{SCHEME}{digest}" alt=""><figcaption>{caption}</figcaption></figure><pre>{after}</pre></article>'


def parse_sequences(pages: DataFrame, keep: list[str]) -> DataFrame:
    """(html and the columns keep) -> the columns keep, page (a number for each row), position, kind, text, digest, caption."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            items, row = [], []
            for k, page in enumerate(batch["html"].to_pylist()):
                own = parse_items(page)
                items += own
                row += [k] * len(own)
            whole = batch.select([*keep, "page"]).take(pa.array(row, pa.int32()))
            columns = [pa.array([i["position"] for i in items], pa.int32()), *[pa.array([i[k] for i in items], pa.string()) for k in ("kind", "text", "digest", "caption")]]
            yield pa.RecordBatch.from_arrays([*whole.columns, *columns], names=[*whole.schema.names, "position", "kind", "text", "digest", "caption"])

    numbered = pages.select(*keep, "html").withColumn("page", F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("html").schema)
    return numbered.mapInArrow(parse, f"{fields}, {ITEM}")


def _payloads(batch: pa.RecordBatch) -> list[bytes]:
    return [pad(t or b"") for t in batch["text"].cast(pa.binary()).to_pylist()]


def store_media(docs: DataFrame, path: str) -> None:
    """Writes the image of every text under path: digest, media."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            payloads = _payloads(batch)
            digests = [hashlib.sha256(p).hexdigest() for p in payloads]
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array([encode_png(p) for p in payloads], pa.binary())], names=["digest", "media"])

    docs.select("text").mapInArrow(store, "digest string, media binary").write.parquet(path)


def text_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: each text as a page that refers to its own payload."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            pages = [as_page(f"document {d}", t, hashlib.sha256(p).hexdigest()) for t, p, d in zip(texts, _payloads(batch), batch["doc_id"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "html"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return texts.mapInArrow(write, f"doc_id {kind}, n_bytes long, html string")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """FEATURES of each stored image, from its bytes as read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = []
            for digest, media in zip(batch["digest"].to_pylist(), batch["media"].to_pylist(), strict=True):
                samples = decode_png(media)
                payload = samples.tobytes()
                by_channel = samples.reshape(-1, 3).sum(0, dtype=np.int64)
                values = np.bincount(samples.ravel(), minlength=256)
                feature = f"{WIDTH}x{len(samples)} sums {','.join(map(str, by_channel))} values {int((values > 0).sum())} mode {int(values.argmax())}"
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            fields = [f.split() for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if t == "long" else pa.string()) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    stored = spark.read.schema("digest string, media binary").parquet(path).mapInArrow(read, FEATURES)
    return stored.groupBy("digest").agg(*[F.first(c.split()[0]).alias(c.split()[0]) for c in FEATURES.split(", ")[1:]])


def interleave(items: DataFrame, media: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and items: each page's items in order, those of media with the columns of media (one row a digest).

    Texts have no digest; they get one of their own each for the join, so that they don't meet in one task.
    """
    own = F.when(F.col("kind") == "media", F.coalesce("digest", F.lit(""))).otherwise(F.concat_ws(" ", F.lit("text"), "page", "position"))
    found = items.withColumn("key", own).join(media.withColumnRenamed("digest", "key").hint("rebalance"), "key", "left")
    fields = [c for c in found.columns if c not in ("key", "page", "position", *keep)]
    pages = found.groupBy("page").agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(F.struct("position", *fields))).alias("items"))
    return pages.drop("page")


def _light(items: DataFrame) -> DataFrame:
    """Items with the sizes of texts in place of the texts."""
    return items.withColumn("text", F.octet_length("text").cast("long")).withColumnRenamed("text", "text_bytes")


def _bytes_of(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, i: n + F.coalesce(i["text_bytes"], F.lit(0)))


def op3_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an interleaved page; the digest columns are those of the page's stored image, text_bytes those of its texts."""
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "media")
    store_media(docs, path)
    pages = interleave(_light(parse_sequences(text_pages(docs), ["doc_id", "n_bytes"])), read_media(spark, path), ["doc_id", "n_bytes"])
    found = pages.withColumn("m", F.filter("items", lambda i: i["payload_sha256"].isNotNull())[0])
    of_kind = lambda kind: F.size(F.filter("items", lambda i: i["kind"] == kind))
    return found.select("doc_id", "n_bytes", *[f"m.{c.split()[0]}" for c in FEATURES.split(", ")[1:]], "m.position", "m.caption", of_kind("text").alias("texts"), of_kind("media").alias("media"), _bytes_of(F.slice("items", 2, F.size("items"))).alias("text_bytes"))


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages as sequences: how many texts and media references, and a digest of all items in order."""
    pages = table(spark, sf_dir, "pages")
    told = F.concat_ws("\n", F.transform("items", lambda i: F.concat_ws(" ", i["position"], i["kind"], F.coalesce(i["text"], i["digest"]))))
    rows = interleave(parse_sequences(pages, ["page_id"]), spark.createDataFrame([], FEATURES), ["page_id"])
    of_kind = lambda kind: F.size(F.filter("items", lambda i: i["kind"] == kind))
    return rows.select("page_id", of_kind("text").alias("texts"), of_kind("media").alias("media"), F.md5(told.cast("binary")).alias("outline_md5"))
