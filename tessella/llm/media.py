"""Media columns: documents as ordered sequences of text and media.

Method: HTML is parsed into an ordered array of structs, text blocks and media references; a reference holds the digest
that names its payload and the caption of its figure. Payloads lie in a table of media by digest; a digest join resolves references
to what was computed from the stored bytes, and the array is put together again by position, so that text, media and
captions stay aligned. Only references and results are dealt by the join, never payloads.

Media are binary greymaps (P5): 192 samples of 8 bits a row, the payload's bytes as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from html import escape
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textarrays import bounded, released, small_batches
from tessella.plans.shared import materialize

WIDTH = 192
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
SEQUENCE = f"array<{ITEM}>"
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])

#: Elements whose text isn't shown; elements that end a block of text; elements with a media reference.
HIDDEN = {"script", "style", "template", "noscript", "title"}
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "figure", "figcaption", "nav", "footer", "header", "table", "tr", "td", "th", "blockquote", "pre", "hr", "body"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class Sequence(HTMLParser):
    """Collects the items of a page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA and (ref := dict(attrs).get("src")):
            item = {"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.figure or ():
                item["caption"] = text or item["caption"]
            self.caption = None
            if self.figure is None and text:  # a caption of nothing is text
                self.held.append(text)
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.held if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The ordered items of a page; null and empty pages have none."""
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", carried: tuple[str, ...] = ()) -> DataFrame:
    """pages' ids with the carried columns and their items as `items`, one row for each row."""
    kind = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (id_column, *carried))

    @released()
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "html"):
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in carried), pa.array([sequence(x) for x in b.column("html").to_pylist()], pa.list_(_ITEM))], [id_column, *carried, "items"])

    return bounded(pages).select(F.col(id_column).alias("id"), *carried, F.col(html_column).cast("string").alias("html")).mapInArrow(make, f"{kind}, items {SEQUENCE}")


def resolve(rows: DataFrame, media: DataFrame, id_column: str) -> DataFrame:
    """rows(id, ..., items) with every media item's row of media(ref, ...) as `media`, null where there is none.

    media has one row a ref at most. Rows are written with a number each, so repeated rows and null ids are kept; only the
    references are dealt by the join, and what they refer to comes back to its row and position. Rows without items have an empty array.
    """
    fields = [c for c in media.columns if c != "ref"]
    whose = [id_column, *(c for c in rows.columns if c not in (id_column, "items"))]
    rows = materialize(rows.select(*whose, F.coalesce("items", F.array().cast(SEQUENCE)).alias("items"), F.monotonically_increasing_id().alias("_row")), "sequences")
    refs = rows.select("_row", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item")).select("_row", "item.position", "item.ref")
    found = refs.join(media, "ref").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*fields)))).alias("_found"))
    whole = lambda x: F.struct(x["position"].alias("position"), x["kind"].alias("kind"), x["text"].alias("text"), x["ref"].alias("ref"), x["caption"].alias("caption"), F.try_element_at("_found", x["position"]).alias("media"))
    return rows.join(found, "_row", "left").select(*whose, F.transform("items", whole).alias("items"))


# ---- documents as greymaps -------------------------------------------------------------------------------------------


def stored(payload: bytes) -> bytes:
    """A greymap of a payload whose size is a multiple of WIDTH."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(media: bytes) -> np.ndarray:
    """The samples of a greymap, a row of the picture each."""
    head = re.match(rb"P5\n(\d+) (\d+)\n255\n", media)
    if not head:
        raise ValueError("no greymap")
    flat = np.frombuffer(media, np.uint8, offset=head.end())
    return flat.reshape(int(head[2]), int(head[1]))


def article(text: str, ref: str) -> str:
    """A text as a page: its lines as paragraphs, with its picture after the first and that line's first words as caption."""
    lines = [x for x in text.split("\n") if x.strip()]
    caption = " ".join(lines[0].split()[:12]) if lines else ""
    figure = f'<figure><img src="{escape(ref)}"><figcaption>{escape(caption)}</figcaption></figure>'
    shown = [f"<p>{escape(x)}</p>" for x in lines]
    return "<article>" + "".join([*shown[:1], figure, *shown[1:]]) + "</article>"


@released()
def _store(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text", 4 << 20):
        rows = []
        for text in b.column("text").to_pylist():
            data = (text or "").encode()
            media = stored(data + b" " * (-len(data) % WIDTH if data else WIDTH))
            rows.append((len(data), "sha256:" + sha256(media).hexdigest(), media))
        size, ref, media = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(id_type), pa.array(size, pa.int64()), pa.array(ref, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "ref", "media"])


@released()
def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, ref, media) to (doc_id, n_bytes, items): the stored text as a page, parsed."""
    for b in small_batches(batches, "media", 2 << 20):
        texts = [samples(m).tobytes()[:n].decode() for m, n in zip(b.column("media").to_pylist(), b.column("n_bytes").to_pylist(), strict=True)]
        items = [sequence(article(t, ref)) for t, ref in zip(texts, b.column("ref").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(items, pa.list_(_ITEM))], ["doc_id", "n_bytes", "items"])


FEATURES = "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, picture string"


@released()
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for b in small_batches(batches, "media", 4 << 20):
        rows = []
        for ref, media in zip(b.column("ref").to_pylist(), b.column("media").to_pylist(), strict=True):
            digest = sha256(media).hexdigest()
            if ref != f"sha256:{digest}":
                raise ValueError(f"the stored bytes of {ref} have changed")
            x = samples(media)
            payload = x.tobytes()
            shares = np.bincount(x.ravel() >> 5, minlength=8) * 100 // x.size
            rows.append((ref, len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]), len(media), digest, f"{x.shape[1]}x{x.shape[0]} mean {int(x.sum(dtype=np.int64)) * 100 // x.size} bands {'-'.join(map(str, shares))}"))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def document_media(docs: DataFrame, brief: bool = False) -> DataFrame:
    """(doc_id, n_bytes, items with media) of every row of docs(doc_id, text, ...): its lines as text items, and its whole text as a picture.

    n_bytes is the text's own and stays with the document: texts that differ in trailing spaces can share a padded picture. Texts are stored
    as greymaps in a written table and read back from it. Null text is empty, a picture of spaces alone. brief: with the lengths of
    texts and captions (as strings) in their place, so that no text is dealt. Ids are strings or whole numbers.
    """
    arrow = pa.string() if docs.schema["doc_id"].dataType.simpleString() == "string" else pa.int64()
    kind = "string" if pa.types.is_string(arrow) else "long"
    rows = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    table = materialize(rows.mapInArrow(partial(_store, id_type=arrow), f"doc_id {kind}, n_bytes long, ref string, media binary"), "media")
    names = [x.split()[0] for x in FEATURES.split(", ") if not x.startswith("ref ")]
    media = table.select("ref", "media").mapInArrow(_features, FEATURES).groupBy("ref").agg(*(F.first(c).alias(c) for c in names))
    items = table.mapInArrow(_articles, f"doc_id {kind}, n_bytes long, items {SEQUENCE}")
    if brief:
        short = lambda x: F.struct(x["position"].alias("position"), x["kind"].alias("kind"), F.length(x["text"]).cast("string").alias("text"), x["ref"].alias("ref"), F.length(x["caption"]).cast("string").alias("caption"))
        items = items.select("doc_id", "n_bytes", F.transform("items", short).alias("items"))
    # As a table of its own, so that the join deals both sides anew and can split a reference that many documents share.
    return resolve(items, materialize(media, "features"), "doc_id")


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row.

    feature: the document's items in order, texts by their lengths, the picture by size, mean and shares of brightness, with its caption's length.
    """
    item = F.filter("items", lambda x: x["kind"] == "media")[0]
    told = F.transform("items", lambda x: F.when(x["kind"] == "text", F.concat(F.lit("text "), x["text"])).otherwise(F.concat(F.lit("picture "), x["media"]["picture"], F.lit(" caption "), F.coalesce(x["caption"], F.lit("0")))))
    rows = document_media(docs, brief=True).select("doc_id", "n_bytes", item.alias("m"), F.array_join(told, " | ").alias("feature"))
    return rows.select("doc_id", "n_bytes", "m.media.payload_bytes", "m.media.payload_sha256", "m.media.tail_crc32", "m.media.media_bytes", "m.media.media_sha256", "feature")
