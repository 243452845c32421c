"""Media columns: documents as interleaved sequences of text and media references, payloads resolved by digest.

HTML becomes an ordered array of structs (position, kind text or media, text, source, caption). Payloads live in a media
table keyed by the SHA-256 of their stored form, a portable graymap (8-bit samples, rows of 64, lossless). Features are
computed where the stored bytes are read, so only digests and features meet in the join; positions and captions stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import attach, new_path, read, written
from tagmask.llm.vector_text import light

WIDTH = 64
SEGMENT = "array<struct<position:int,kind:string,text:string,source:string,caption:string>>"
#: Elements that hold no text, that may stand in the head, that hold a media source, and that end a run of text.
SILENT = ("script", "style", "template", "noscript", "title")
HEAD = ("title", "meta", "link", "base", "script", "style", "template", "noscript")
MEDIA = ("img", "video", "audio", "source", "embed", "object")
BREAKS = ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "table", "article", "section", "nav", "footer", "header", "blockquote", "pre", "figure", "hr", "body")


class _Figure:
    """An open figure: its media, the words of its caption and where the caption stood."""

    def __init__(self):
        self.media: list[dict] = []
        self.caption: list[str] = []
        self.captioned, self.place = False, 0


class _Interleaver(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[dict] = []
        self.words: list[str] = []
        self.figures: list[_Figure] = []
        self.head, self.silent = False, []

    def text(self, words: list[str]) -> list[dict]:
        text = " ".join("".join(words).split())
        return [{"kind": "text", "text": text, "source": None, "caption": None}] if text else []

    def cut(self) -> None:
        self.segments += self.text(self.words)
        self.words = []

    def end_figure(self) -> None:
        """The caption goes to the figure's media; without media it is text where it stood."""
        self.cut()
        figure = self.figures.pop()
        found = self.text(figure.caption)
        for media in figure.media:
            media["caption"] = found[0]["text"] if found else media["caption"]
        if not figure.media:
            self.segments[figure.place : figure.place] = found

    def finish(self) -> None:
        while self.figures:
            self.end_figure()
        self.cut()

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif self.head and (tag == "body" or tag not in HEAD and not self.silent):  # </head> may be left out
            self.head, self.silent = False, []
        if tag in SILENT:
            self.silent.append(tag)
        if self.head or self.silent:
            return
        if tag in BREAKS or tag in MEDIA:
            self.cut()
            if self.figures and self.figures[-1].captioned:
                self.figures[-1].caption.append(" ")
        if tag == "figure":
            self.figures.append(_Figure())
        if tag == "figcaption" and self.figures:
            self.cut()
            if not self.figures[-1].caption:
                self.figures[-1].place = len(self.segments)
            self.figures[-1].captioned = True
        named = dict(attrs)
        source = named.get("src") or named.get("data") or first_candidate(named.get("srcset"))
        if tag in MEDIA and source:
            self.segments.append({"kind": "media", "text": None, "source": source, "caption": named.get("alt")})
            if self.figures:
                self.figures[-1].media.append(self.segments[-1])

    def handle_endtag(self, tag):
        if tag == "head":
            self.head, self.silent = False, []
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
        if self.head or self.silent:
            return
        if tag == "figcaption" and self.figures:
            self.figures[-1].captioned = False
        if tag in BREAKS:
            self.cut()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if self.head and not self.silent and data.strip():
            self.head = False
        if not self.head and not self.silent:
            (self.figures[-1].caption if self.figures and self.figures[-1].captioned else self.words).append(data)


def first_candidate(srcset: str | None) -> str | None:
    """The address of the first image of a srcset (addresses, each with a descriptor, between commas); null where there is none."""
    found = re.match(r"[\s,]*(\S+)", srcset or "")
    return (found[1].rstrip(",") or None) if found else None


def interleave(html: str | None) -> list[dict]:
    """Text and media of an HTML text in reading order; a figure's caption belongs to the media of the figure.

    Scripts, styles, templates, noscript and the head give neither text nor media. End tags may be missing: content ends
    the head, the end of a figure or of the text ends a caption. A caption without media is text.
    """
    parser = _Interleaver()
    parser.feed(html or "")
    parser.close()
    parser.finish()
    return [{"position": i, **s} for i, s in enumerate(parser.segments)]


def parse_sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of `pages` but the HTML, plus `segments`. Null or empty HTML gives an empty array."""
    own = [c for c in pages.columns if c not in (html_col, "segments")]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("source", pa.string()), ("caption", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = pa.array([interleave(h) for h in batch.column(html_col).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), segments], [*own, "segments"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(*own, html_col).mapInArrow(parse, ", ".join([*(f"`{c}` {kinds[c]}" for c in own), f"segments {SEGMENT}"]))


def graymap(payload: bytes) -> bytes:
    """A payload as a graymap: padded with 0 to a positive multiple of 64; its own length is the comment."""
    padded = payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))
    return b"P5\n# %d\n%d %d\n255\n" % (len(payload), WIDTH, len(padded) // WIDTH) + padded


def samples(media: bytes) -> tuple[int, bytes]:
    """(length without padding, padded payload) of a graymap of this module."""
    magic, comment, size, depth, payload = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(payload) != width * height:
        raise ValueError("not a graymap of 8-bit samples")
    return int(comment[2:]), payload


def feature(payload: bytes) -> str:
    """Hash of the column means against the mean (64 bits), mean and spread of the samples."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = image.sum(0, dtype=np.int64) * WIDTH
    bits = np.packbits(columns > columns.sum() // WIDTH).tobytes().hex()
    mean = image.mean()
    return f"{bits}:{mean:.4f}:{image.std():.4f}"


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """Write (doc_id, text) to a media table: doc_id, media_sha256, media. The text is stored whole, as UTF-8."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches):
            media = [graymap((t or "").encode()) for t in batch.column("text").to_pylist()]
            digest = [hashlib.sha256(m).hexdigest() for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.string()), pa.array(media, pa.binary())], ["doc_id", "media_sha256", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, media_sha256 string, media binary")
    stored.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(stored.schema).parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """One row per stored medium, from the bytes read: digests, sizes and feature, keyed by the digest of those bytes."""
    names = ["media_sha256", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for value in batch.column("media"):
                data = value.as_py()
                digest = hashlib.sha256(data).hexdigest()
                if digest not in rows:
                    n, payload = samples(data)
                    rows[digest] = (digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), feature(payload))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows.values()], schema=pa.schema([(n, pa.string() if n in ("media_sha256", "payload_sha256", "feature") else pa.int64()) for n in names]))

    found = media.select("media").mapInArrow(compute, "media_sha256 string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")
    return found.groupBy("media_sha256").agg(*[F.first(n).alias(n) for n in names[1:]])


def resolve_media(sequences: DataFrame, resolved: DataFrame, id_col: str = "doc_id", scheme: str = "sha256:") -> DataFrame:
    """One row per media reference: the id, position, caption and the columns of `resolved` (null where the digest is unknown).

    Order within a sequence is `position`; sequences without media give no row. `sequences` has segments as parsed.
    """
    refs = sequences.select(id_col, F.explode("segments").alias("s")).filter("s.kind = 'media'")
    refs = written(refs.select(id_col, "s.position", "s.caption", F.regexp_replace("s.source", f"^{scheme}", "").alias("media_sha256")), "media-refs")
    return attach(refs, resolved, ["media_sha256"], id_col)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a medium, referred to by an interleaved page, resolved from the stored bytes."""
    media = store_media(read(spark, sf_dir, "documents"), new_path(spark, "media"))
    resolved = written(media_features(media), "media-features")
    page = F.concat(F.lit('<article><p>Document</p><figure><img src="sha256:'), "media_sha256", F.lit('"><figcaption>payload of document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"))
    sequences = parse_sequences(media.select("doc_id", page.alias("html")))
    rows = resolve_media(sequences, resolved)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
