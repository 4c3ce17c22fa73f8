"""Media columns: interleaved document sequences.

HTML becomes a sequence of text and media-reference structs in reading order; a reference carries a digest, by which joins
resolve its payload; position and caption stay with it. Payloads are stored losslessly as binary PGM images, 64 samples of eight
bits a row.
"""

from __future__ import annotations

import hashlib
import html as markup
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, OWN, chunks, keyed, picked, trim, written

#: Samples in a row of the stored image.
WIDTH = 64
#: Tags that end a run of text; tags whose text isn't shown; tags that refer to media.
BREAKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "section", "article", "figure", "blockquote", "pre", "hr", "header", "footer", "main", "nav"}
HIDDEN = {"script", "style", "template", "noscript", "head"}
MEDIA = {"img": "image", "video": "video", "audio": "audio", "embed": "object", "object": "object"}

ITEM = "array<struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>>"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden: list[str] = []
        self.figures: list[int] = []
        self.caption: list[str] | None = None
        self.open_media: dict | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag in MEDIA:
            self.flush()
            item = {"kind": MEDIA[tag], "src": a.get("src") or a.get("data"), "digest": (a.get("data-sha256") or "").lower() or None, "caption": a.get("alt") or a.get("title")}
            self.items.append(item)
            self.open_media = item if tag in ("video", "audio", "object") else None
        elif tag == "source" and self.open_media is not None and not self.open_media["src"]:
            self.open_media["src"] = a.get("src")
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figures.append(len(self.items))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item["kind"] != "text" and said:
                    item["caption"] = said
        elif tag in BREAKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()
        elif tag in MEDIA:
            self.open_media = None

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The texts and media references of a page, in reading order; a figure's caption goes to all of its media. Null has none."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    blank = {"text": None, "src": None, "digest": None, "caption": None}
    return [blank | x | {"pos": k} for k, x in enumerate(parser.items)]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, items) of each page. Null or empty html has no items; ids may be null or repeat; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "caption"))]))
        for batch in batches:
            for part in chunks(batch, 1, 4 << 20):
                yield pa.record_batch([part.column(0), part.column(2), pa.array([sequence(h) for h in part.column(1).to_pylist()], kind)], names=["doc_id", KEY, "items"])

    return picked(pages, id_col, html_col).mapInArrow(run, f"doc_id long, {KEY} long, items {ITEM}")


def resolve(items: DataFrame, payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each media reference of ``items`` (of ``interleave``): doc_id, the row key, pos, kind, src, caption, the columns ``keep`` of
    ``items``, and the columns of ``payloads`` with its digest, null where there is none or the reference has no digest.

    References are first put together by stretch and digest, so that a payload which a third of all documents show is a
    few rows of the join, and exploded after it. ``payloads`` has one row per digest; its columns that are named like one of the
    reference's come out as payload_<name>.
    """
    refs = items.select("doc_id", KEY, *keep, F.explode("items").alias("m")).where("m.kind <> 'text'")
    own = ["doc_id", KEY, "pos", "kind", "src", "caption", *keep]
    packed = refs.groupBy(F.expr(f"{KEY} div 4096").alias(OWN + "stretch"), F.col("m.digest").alias(OWN + "digest"))
    packed = packed.agg(F.collect_list(F.struct("doc_id", KEY, "m.pos", "m.kind", "m.src", "m.caption", *keep)).alias(OWN + "refs"))
    names = {c: f"payload_{c}" if c in own else c for c in payloads.columns if c != "digest"}
    found = packed.join(payloads.select(F.col("digest").alias(OWN + "digest"), *(F.col(f"`{c}`").alias(n) for c, n in names.items())), OWN + "digest", "left")
    found = found.select(F.explode(OWN + "refs").alias(OWN + "ref"), F.col(OWN + "digest").alias("digest"), *names.values())
    return found.select(*(F.col(f"{OWN}ref.{c}").alias(c) for c in own), "digest", *names.values())


def pgm(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a positive multiple of ``WIDTH``."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload has to fill whole rows")
    return f"P5\n{WIDTH} {len(payload) // WIDTH}\n255\n".encode() + payload


def samples(stored: bytes) -> np.ndarray:
    """The samples of a stored image, a row of ``WIDTH`` each; a wrong header or length is an error."""
    magic, size, most, body = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or width != WIDTH or len(body) != width * height:
        raise ValueError("not a stored payload")
    return np.frombuffer(body, np.uint8).reshape(height, width)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def feature(image: np.ndarray) -> str:
    """Mean, spread, entropy and a 64-bit difference hash over an eight by eight grid of the image's area means."""
    counts = np.bincount(image.ravel(), minlength=256)
    share = counts[counts > 0] / image.size
    values = np.arange(256)
    mean = counts @ values / image.size
    spread = np.sqrt(max(0.0, counts @ (values * values) / image.size - mean * mean))
    rows = np.linspace(0, image.shape[0], 9).astype(int)
    bands = np.stack([image[a : max(a + 1, b)].mean(0) if a < image.shape[0] else image[-1] for a, b in zip(rows[:-1], rows[1:], strict=True)])
    cells = bands.reshape(8, 8, WIDTH // 8).mean(2)
    bits = np.packbits(cells > np.roll(cells, -1, 1)).tobytes().hex()
    return f"mean={mean:.4f};std={spread:.4f};entropy={abs(-(share * np.log2(share)).sum()):.4f};dhash={bits}"


def digest_of(raw: bytes) -> str:
    """The name of a text's payload: a digest of the payload and of the length that it has without its padding."""
    return hashlib.sha256(padded(raw) + len(raw).to_bytes(8, "little")).hexdigest()


def page_of(text: str) -> str:
    """A document as a page: a paragraph for each of its lines that isn't blank, and the figure of its payload, with a caption, between the halves."""
    raw = text.encode("utf-8")
    digest = digest_of(raw)
    runs = [f"<p>{markup.escape(line)}</p>" for line in text.split("\n") if line.strip()]
    figure = f'<figure><img src="media:{digest[:16]}.pgm" data-sha256="{digest}"><figcaption>{len(raw)} bytes as an image</figcaption></figure>'
    half = len(runs) // 2
    return "".join(["<article>", *runs[:half], figure, *runs[half:], "</article>"])


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the row key, html): each document as a page. Nothing is stored; a null text is a page with the figure only."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, 1, 4 << 20):
                yield pa.record_batch([part.column(0), part.column(2), pa.array([page_of(t) for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", KEY, "html"])
            trim()

    return picked(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {KEY} long, html string")


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stores each padded text as an image: the stored table (digest, n_bytes, media).

    Equal texts of a stretch are stored once; the same payload from several stretches is stored by each, and ``payloads_of``
    counts it once, so no payload is ever shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, 0, 4 << 20):
                raws = {digest_of(raw): raw for raw in map(str.encode, part.column(0).to_pylist())}
                yield pa.record_batch([pa.array(list(raws)), pa.array([len(r) for r in raws.values()], pa.int64()), pa.array([pgm(padded(r)) for r in raws.values()], pa.binary())], names=["digest", "n_bytes", "media"])
            trim()

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(OWN + "text"))
    return written(texts.mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


def payloads_of(stored: DataFrame) -> DataFrame:
    """One row per digest, computed from the stored bytes: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, 2, 4 << 20):
                rows = []
                for digest, n, media in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    image = samples(media)
                    payload = image.tobytes()
                    rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)

    found = stored.mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(*(F.min(c).alias(c) for c in COLUMNS[1:]))


COLUMNS = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as an interleaved page of its lines and one image, which is stored, referred to, resolved by digest and read back.

    Beside the payload's columns: ``pos`` and ``caption`` of the reference, ``n_items`` of the sequence and ``runs_sha256``, of its text
    runs joined by line breaks. A null text counts as empty, which is one row of zeros. Ids may be null or repeat; each row has
    its own result, and equal texts have equal values in all columns but the id. An empty table gives no rows. Other columns are
    ignored. A text has to fit into a worker's memory.
    """
    df = docs if KEY in docs.columns else keyed(docs)
    items = interleave(text_pages(df, id_col, text_col), "doc_id", "html")
    runs = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    items = items.select("doc_id", KEY, "items", F.size("items").alias("n_items"), F.sha2(F.concat_ws("\n", runs).cast("binary"), 256).alias("runs_sha256"))
    return resolve(items, payloads_of(store_texts(df, text_col)), ("n_items", "runs_sha256")).select("doc_id", *COLUMNS[1:], "pos", "caption", "n_items", "runs_sha256")


def page_sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_items, n_media, chars, runs_sha256) of each page's sequence: its items, media references, code points of its text runs, and their digest.

    Null and empty html have no items. Ids may be null or repeat. An empty table gives no rows. Other columns are ignored.
    """
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    chars = F.aggregate(texts, F.lit(0), lambda a, t: a + F.char_length(t)).cast("long")
    return interleave(pages, id_col, html_col).select(F.col("doc_id").alias("page_id"), F.size("items").alias("n_items"), F.size(F.filter("items", lambda x: x["kind"] != "text")).alias("n_media"), chars.alias("chars"), F.sha2(F.concat_ws("\n", texts).cast("binary"), 256).alias("runs_sha256"))
