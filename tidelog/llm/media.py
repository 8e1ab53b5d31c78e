"""Interleaved document sequences: ordered text and media references from HTML, payloads by digest.

Payloads are stored once per row as PNG images of 64 pixels a line, 8-bit RGB samples; the stored table carries the
digest of the payload. HTML becomes an ordered list of items: a text block, or a reference with its source, digest and
caption. resolve() joins references to the stored media by digest and keeps positions and captions beside what it finds.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import pieces
from tidelog.llm.extract import BLOCKS, DROP
from tidelog.llm.markup import END, START, TEXT, attributes, events
from tidelog.storage import cut, ship

UNIT, LINE = 192, 64
ITEM = "position int, kind string, text string, src string, digest string, caption string"
MEDIA = {"img": "image", "audio": "audio", "video": "video", "embed": "object", "object": "object", "source": "source"}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(payload: bytes) -> bytes:
    """payload with spaces up to a positive multiple of UNIT bytes."""
    return payload + b" " * (UNIT - len(payload) if len(payload) <= UNIT else -len(payload) % UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """A padded payload as an RGB image of LINE pixels a line."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, 3 * LINE)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1)  # filter 0 before each line
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that to_png() wrote, as (lines, LINE, 3); checks the chunks' checksums."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, raw, head = 8, [], b""
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            raw.append(body)
        at += 12 + size
    width, height, depth, color = struct.unpack(">IIBB", head[:10])
    lines = np.frombuffer(zlib.decompress(b"".join(raw)), np.uint8).reshape(height, 1 + 3 * width)
    if depth != 8 or color != 2 or lines[:, 0].any():
        raise ValueError("other samples than 8-bit RGB without filters")
    return lines[:, 1:].reshape(height, width, 3)


def feature(samples: np.ndarray) -> str:
    """Size, mean and deviation of each channel, and the share of samples in each eighth of the range."""
    flat = samples.reshape(-1, 3)
    counts = np.bincount(flat.reshape(-1) >> 5, minlength=8)
    value = np.arange(256)
    out = []
    for c in range(3):
        n = np.bincount(flat[:, c], minlength=256)
        mean = float((n * value).sum()) / len(flat)
        out.append(f"{mean:.4f}/{max(0.0, float((n * value * value).sum()) / len(flat) - mean * mean) ** 0.5:.4f}")
    return f"{samples.shape[1]}x{samples.shape[0]};" + ";".join(out) + ";" + ",".join(f"{x / flat.size:.4f}" for x in counts)


def items(html: str | None) -> list[dict]:
    """Ordered text blocks and media references of a page; a reference's caption is its figure's figcaption, else its alt text."""
    out: list[dict] = []
    run: list[str] = []
    figures: list[int] = []  # number of items where each open figure began
    caption: list[str] | None = None
    depth = skip = 0

    def flush() -> None:
        if run:
            if t := " ".join("".join(run).split()):
                out.append({"kind": "text", "text": t, "src": None, "digest": None, "caption": None})
            run.clear()

    for kind, what, raw in events(html or ""):
        if kind == TEXT:
            if not skip:
                (run if caption is None else caption).append(what)
        elif kind == START:
            depth += 1
            if skip:
                continue
            if what in MEDIA:
                a = attributes(raw)
                src = a.get("src") or a.get("data")
                if src:
                    flush()
                    m = re.fullmatch(r"sha256:([0-9a-f]{64})", src)
                    out.append({"kind": MEDIA[what], "text": None, "src": src, "digest": m[1] if m else a.get("data-digest"), "caption": a.get("alt") or None})
            elif what == "figcaption":
                caption = []
            elif what in DROP:
                skip = depth
            elif what in BLOCKS:
                flush()
                if what == "figure":
                    figures.append(len(out))
        else:
            if skip:
                skip = 0 if skip == depth else skip
            elif what == "figcaption" and caption is not None:
                t, caption = " ".join("".join(caption).split()), None
                for x in out[figures[-1] if figures else len(out) :]:
                    if x["kind"] != "text":
                        x["caption"] = t
            elif what in BLOCKS:
                flush()
                if what == "figure" and figures:
                    figures.pop()
            depth -= 1
    flush()
    return [{"position": k, **x} for k, x in enumerate(out)]


def sequences(pages: DataFrame, key: str = "doc_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., items) of every row of pages, items array<struct<ITEM>> in page order. Null html: no items."""
    rows = pages.select(F.col(html).alias("html"), F.col(key).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(keep)])
    kind = pa.list_(pa.struct([(n.split()[0], pa.int32() if n.split()[1] == "int" else pa.string()) for n in ITEM.split(", ")]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in pieces(y, 0)):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([items(x.as_py()) for x in b.column(0)], kind)], names=[*b.schema.names[1:], "items"])

    ship(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    struct_ = ", ".join(f"{a}: {t}" for a, t in (n.split() for n in ITEM.split(", ")))
    out = rows.mapInArrow(of, ", ".join([*[f"k{i} {kinds[f'k{i}']}" for i in range(len(keep) + 1)], f"items array<struct<{struct_}>>"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate([key, *keep])], "items")


STORED = "doc_id long, n_bytes long, digest string, html string, media binary"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for y in batches for x in pieces(y, 1)):
        n, digest, html, media = [], [], [], []
        for key, t in zip(b.column(0), b.column(1)):
            raw = (t.as_py() or "").encode()
            payload = pad(raw)
            n.append(len(raw))
            digest.append(hashlib.sha256(payload).hexdigest())
            html.append(f'<article><p>Document {key.as_py()}</p><figure><img src="sha256:{digest[-1]}" alt="document"><figcaption>document {key.as_py()}</figcaption></figure><p>{len(raw)} bytes</p></article>')
            media.append(to_png(payload))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(html, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "digest", "html", "media"])


def store(docs: DataFrame) -> DataFrame:
    """Documents as stored media and a page that refers to them by digest, written to the shared folder. Null text: empty payload."""
    return cut(docs.select("doc_id", "text").mapInArrow(_stored, STORED), "media")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for b in (x for y in batches for x in pieces(y, 1)):
        rows = {}
        for d, m in zip(b.column(0).to_pylist(), b.column(1)):
            data = m.as_py()
            s = from_png(data)
            p = s.tobytes()
            sha = hashlib.sha256(p).hexdigest()
            if sha != d:
                raise ValueError(f"stored media of digest {d} reads back as {sha}")
            if d not in rows:
                rows[d] = (d, len(p), sha, zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(s))
        cols = list(zip(*rows.values())) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for n, c in zip(names, cols)], names=names)


def read_back(media: DataFrame) -> DataFrame:
    """One row a digest of stored media (digest, media): sizes, checksums and features of the samples read back.

    Every stored row is read and its payload's digest compared; another one is an error. An empty table gives no rows.
    """
    got = media.select("digest", "media").mapInArrow(_read_back, FEATURES)
    return got.groupBy("digest").agg(*[F.first(c.split()[0]).alias(c.split()[0]) for c in FEATURES.split(", ")[1:]])


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """One row an item of seqs, with the columns of media (one row a digest) where its digest is found, else nulls.

    Positions and captions stay beside what they belong to; text items and unknown digests have nulls. A digest may be
    referred to by any number of items: Spark splits a join partition that is large. An empty table gives no rows.
    """
    flat = seqs.select(*[c for c in seqs.columns if c != "items"], F.inline("items"))
    return flat.join(media, "digest", "left")


def gather(flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of resolve() as one sequence a key again, in order of position; a null key is a key, repeated keys are one."""
    rest = [c for c in flat.columns if c not in (key, "position")]
    return flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", *rest))).alias("items"))


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, caption of every row of docs.

    A document's sequence is a heading, its payload's image with a caption, and a line of text; the row of the image is
    returned, with the text before and after it. Null and empty texts are a payload of UNIT spaces. Equal texts give
    equal values. Repeated rows stay; an empty table gives an empty result.
    """
    stored = store(docs)
    seqs = sequences(stored, keep=("n_bytes",))
    beside = lambda by: F.element_at(F.transform(F.filter(F.transform("items", lambda x, i: F.struct((F.get("items", i + by)["text"]).alias("text"), x["kind"].alias("kind"))), lambda x: x["kind"] == "image"), lambda x: x["text"]), 1)
    pictures = seqs.withColumns({"before": beside(-1), "after": beside(1)}).withColumn("items", F.filter("items", lambda x: x["kind"] == "image"))
    flat = resolve(pictures, read_back(stored))
    return flat.select("doc_id", "n_bytes", *[c.split()[0] for c in FEATURES.split(", ")[1:]], "position", "caption", "before", "after")
