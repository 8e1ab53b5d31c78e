"""WARC archives: one gzip member a record, revisit records for repeated payloads, and a sequential reader.

Tasks write and read archives through Arrow's file systems in the folder that all executors share. A task writes under
a name of its own and reports the file in its output, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.storage import cut, new_path

#: Compressed bytes after which a task begins another archive.
ROLL = 256 << 20
CHUNK = 1 << 16
EMPTY_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _name(x) -> str:
    return f"<{ID}{'null' if x is None or x != x else int(x)}>"


def _uri(url) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if isinstance(url, str) and url else "urn:none"


def page_record(page_id, url, payload: bytes, refers_to=None, date: str = EMPTY_DATE, level: int = 6) -> bytes:
    """A response record, or a revisit record without payload if refers_to is given."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None and refers_to == refers_to
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
               ("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("WARC-Payload-Digest", "sha256:" + digest)]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    return member(headers, block, level)


class BadRecord(ValueError):
    """An archive that breaks the framing, or a record whose digest is not that of its content."""


class Reader:
    """Sequential records of an archive: at any time it holds a chunk, and a payload only if asked for it."""

    def __init__(self, stream: BinaryIO, payloads: bool = False):
        self.stream, self.payloads, self.raw, self.ready, self.z = stream, payloads, b"", b"", None

    def _more(self) -> bool:
        """Decompress another piece of the current member; False at its end."""
        while True:
            if self.z.eof:
                return False
            piece = self.raw or self.stream.read(CHUNK)
            if not piece:
                raise BadRecord("the archive ends inside a record")
            got = self.z.decompress(piece, CHUNK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.ready += got
                return True

    def _until(self, mark: bytes) -> bytes:
        """What stands before mark, however long it is: a header may carry any url that the writer took."""
        seen = 0
        while (k := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self._more():
                raise BadRecord("a header has no end")
        out, self.ready = self.ready[:k], self.ready[k + len(mark) :]
        return out

    def __iter__(self) -> Iterator[tuple[dict[str, str], int, str, bytes | None]]:
        """(headers by lower-case name, payload bytes, payload sha256, payload or None) of each record."""
        while self.raw or (self.stream_piece()):
            self.z, self.ready = zlib.decompressobj(31), b""
            lines = self._until(b"\r\n\r\n").decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise BadRecord("no WARC version line")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            left = int(headers["content-length"])
            block, payload, kept, size, http = hashlib.sha256(), hashlib.sha256(), [], 0, b""
            in_payload = not headers.get("content-type", "").startswith("application/http")
            while left:
                if not self.ready and not self._more():
                    raise BadRecord("a block is shorter than its content length")
                piece, self.ready = self.ready[:left], self.ready[left:]
                left -= len(piece)
                block.update(piece)
                if not in_payload:
                    http += piece
                    k = http.find(b"\r\n\r\n")
                    if k < 0:
                        continue
                    in_payload, piece = True, http[k + 4 :]
                payload.update(piece)
                size += len(piece)
                if self.payloads:
                    kept.append(piece)
            while len(self.ready) < 4 and self._more():
                pass
            if self.ready != b"\r\n\r\n" or self._more():
                raise BadRecord("a record does not end where its content length says")
            if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha256:" + block.hexdigest():
                raise BadRecord("wrong block digest")
            if headers.get("warc-type") != "revisit" and "warc-payload-digest" in headers and headers["warc-payload-digest"] != "sha256:" + payload.hexdigest():
                raise BadRecord("wrong payload digest")
            yield headers, size, payload.hexdigest(), b"".join(kept) if self.payloads else None

    def stream_piece(self) -> bool:
        self.raw = self.stream.read(CHUNK)
        return bool(self.raw)


def _files(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", folder))


def _writer(folder: str, roll: int, level: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(folder)
        out, path, n, size = None, "", 0, 0
        for pdf in parts:
            done = []
            for row in pdf.itertuples(index=False):
                if out is None:
                    files.create_dir(root, recursive=True)
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{path}", compression=None)
                rec = page_record(row.page_id, row.url, (row.html or "").encode("utf-8"), row.refers_to, level=level)
                out.write(rec)
                n, size = n + 1, size + len(rec)
                if size >= roll:
                    out.close()
                    done.append((path, n, size))
                    out = None
            yield pd.DataFrame(done, columns=["archive", "records", "bytes"])
        if out is not None:
            out.close()
            yield pd.DataFrame([(path, n, size)], columns=["archive", "records", "bytes"])

    return of


def _digest(html):
    return F.unhex(F.sha2(F.coalesce(html, F.lit("")), 256))


def roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads that revisit an equal one of at least `least` bytes under a smaller page_id.

    A page_id that occurs with several payloads has a row for each that is a revisit.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = cut(pages.where(F.octet_length(html) >= least).select("page_id", _digest(html).alias("digest")), "warc-digests")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str | None = None, least: int = 100, roll: int = ROLL, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) and return the table of archives (archive, records, bytes), archive a full path.

    Null html is an empty payload. A row with a null page_id is written as a response that nothing refers to. Rows that
    repeat a page_id are records of their own, each with the role of its payload. An empty table gives no archives.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    again = cut(roles(pages, least), "warc-roles")
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", "url", html.alias("html"))
    rows = rows.withColumn("digest", _digest(F.col("html"))).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    made = cut(rows.mapInPandas(_writer(folder, roll, level), "archive string, records long, bytes long"), "warc-manifest")
    return made.withColumn("archive", F.concat(F.lit(folder + "/"), "archive"))


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    number = lambda x: None if x is None or x.endswith("null>") else int(x[len(ID) + 1 : -1])
    for pdf in parts:
        for path in pdf["archive"]:
            folder, _, name = path.rpartition("/")
            files, root = _files(folder)
            rows = []
            with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for h, size, digest, _ in Reader(stream):
                    kind = h["warc-type"]
                    rows.append((number(h["warc-record-id"]), size if kind == "response" else None, digest if kind == "response" else h["warc-payload-digest"].removeprefix("sha256:"), kind, number(h.get("warc-refers-to"))))
                    if len(rows) >= 4096:
                        yield _typed(pd.DataFrame(rows, columns=names))
                        rows = []
            yield _typed(pd.DataFrame(rows, columns=names))


def _typed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64", "payload_digest": "object", "record_type": "object"})


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each archive read by one task.

    A revisit's payload is that of the response it refers to, in whatever archive that is; it is an error if that
    response is missing or has another digest. Broken framing or a wrong digest is an error too.
    """
    n = max(1, archives.count())
    rows = cut(archives.select("archive").repartition(n).mapInPandas(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "warc-read")
    full = rows.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("r_id"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest")).dropDuplicates(["r_id", "r_digest"])
    back = rows.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    bad = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id").cast("string")))
    back = back.select("page_id", F.coalesce("r_bytes", bad.cast("long")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return rows.where("record_type <> 'revisit'").unionByName(back)
