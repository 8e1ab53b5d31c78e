"""Framed segment files as a Spark data source, with a writer, recovery, sealing and deletion.

A folder's manifest names its live files; each change writes a whole new one, and the latest that is complete counts.
So files that a lost or repeated task left behind are never read. Reading: spark.read.format("framed").option("path",
folder).load() gives one partition a file, read in windows; a torn or damaged tail ends a file's records. Filters are
not pushed into the reader: Spark keeps one reader for all queries on a loaded DataFrame, so a filter of one query would
hold for the next. Writing goes through Parquet for tables of the engine itself; the framed format is for exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.functions.frames import FRAME_HEADER, Cut, Record, pack, unpack

SCHEMA = "file string, position long, offset long, timestamp long, key binary, value binary, headers array<struct<key: binary, value: binary>>"
MANIFEST = "file string, records long, bytes long"
WINDOW = 4 << 20


class Sealed(RuntimeError):
    """The folder takes no more records."""


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _versions(folder: str) -> list[str]:
    """Complete manifests, oldest first."""
    from pyarrow import fs

    files, root = _fs(folder)
    listed = files.get_file_info(fs.FileSelector(f"{root}/_manifest", allow_not_found=True, recursive=True))
    return sorted({f.path.rpartition("/")[0].rpartition("/")[2] for f in listed if f.base_name == "_SUCCESS"})


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, records, bytes) of the live files of a folder."""
    known = _versions(folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest/{known[-1]}") if known else spark.createDataFrame([], MANIFEST)


def _publish(live: DataFrame, folder: str) -> None:
    known = _versions(folder)
    live.coalesce(1).write.parquet(f"{folder}/_manifest/{int(known[-1].partition('-')[0]) + 1 if known else 1:09d}-{uuid.uuid4().hex[:8]}")


def scan_stream(stream: BinaryIO, window: int = WINDOW) -> Iterator[tuple[Record, int, int]]:
    """(record, position, end) of the valid frames at the front of a stream; holds a window, or one frame that is longer."""
    ready, base, at, ended = b"", 0, 0, False
    while True:
        try:
            record, end = unpack(memoryview(ready), at)
        except Cut as e:
            if ended or str(e) != "incomplete":
                return
            # a frame's length stands in its head: read at least that much, so that a long frame is not tried at every window
            need = FRAME_HEADER + int.from_bytes(ready[at + 2 : at + 6], "big") - (len(ready) - at) if len(ready) - at >= FRAME_HEADER else 0
            more = stream.read(max(window, need))
            ended = len(more) < max(window, need)
            ready, base, at = ready[at:] + more, base + at, 0
            continue
        yield record, base + at, base + end
        at = end


class FramedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = _fs(self.path)
        if known := _versions(self.path):
            listed = pq.read_table(f"{root}/_manifest/{known[-1]}", filesystem=files, columns=["file"])["file"].to_pylist()
            return [InputPartition(f"{root}/{f}") for f in sorted(listed)]
        return [InputPartition(f.path) for f in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.path) if f.path.endswith(".log")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = _fs(self.path)
        with files.open_input_stream(partition.value) as s:
            for r, at, _ in scan_stream(s):
                yield partition.value.rpartition("/")[2], at, r.offset, r.timestamp, r.key, r.value, [{"key": k, "value": v} for k, v in r.headers]


class Framed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FramedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Framed)


def write_framed(log: DataFrame, folder: str, batch: int = 20_000) -> DataFrame:
    """Append (offset, timestamp, key, value, headers if there are any), sorted by offset within each partition, as segment files.

    Returns (file, records, bytes) of the new files, which are live once all tasks are done; a failed write leaves the
    folder as it was to its readers. A sealed folder is refused.
    """
    files, root = _fs(folder)
    if files.get_file_info(f"{root}/_sealed").is_file:
        raise Sealed(folder)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _fs(folder)
        files.create_dir(root, recursive=True)
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                name = f"{int(part['offset'].iloc[0]):020d}-{uuid.uuid4().hex[:8]}.log"
                heads = part["headers"] if "headers" in part else [None] * len(part)
                data = b"".join(pack(Record(int(o), int(t), None if k is None else bytes(k), bytes(v), tuple((bytes(x["key"]), bytes(x["value"])) for x in (() if h is None else h))))
                                for o, t, k, v, h in zip(part["offset"], part["timestamp"], part["key"], part["value"], heads))
                with files.open_output_stream(f"{root}/{name}") as s:
                    s.write(data)
                yield pd.DataFrame([(name, len(part), len(data))], columns=["file", "records", "bytes"])

    rows = log.select("offset", "timestamp", log["key"].cast("binary").alias("key"), log["value"].cast("binary").alias("value"), *(
        [F.transform("headers", lambda h: F.struct(h["key"].cast("binary").alias("key"), h["value"].cast("binary").alias("value"))).alias("headers")] if "headers" in log.columns else []))
    spark, staged = log.sparkSession, f"{folder}/_staged-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("offset").mapInPandas(of, MANIFEST).write.parquet(staged)
    made = spark.read.schema(MANIFEST).parquet(staged)
    _publish(manifest(spark, folder).unionByName(made), folder)
    return made


def seal(folder: str) -> None:
    """From now on the folder takes no more records; sealing it again changes nothing."""
    files, root = _fs(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/_sealed"):
        pass


def recover(spark: SparkSession, folder: str) -> DataFrame:
    """Cut torn or damaged tails off: (file, records, bytes, lost) of the live files, lost the bytes that were cut.

    A damaged file is copied up to its last valid frame, and the copy takes its place in the manifest; a file that is
    missing or has no valid frame leaves it. Sound folders stay as they are.
    """

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _fs(folder)
        for pdf in parts:
            out = []
            for name in pdf["file"]:
                info = files.get_file_info(f"{root}/{name}")
                n = end = 0
                if info.is_file:
                    with files.open_input_stream(info.path) as s:
                        for _, _, end in scan_stream(s):
                            n += 1
                size = info.size or 0
                if end < size and n:
                    name = f"{name.partition('-')[0]}-{uuid.uuid4().hex[:8]}.log"
                    with files.open_input_stream(info.path) as s, files.open_output_stream(f"{root}/{name}") as to:
                        for at in range(0, end, WINDOW):
                            to.write(s.read(min(WINDOW, end - at)))
                out.append((name, n, end, size - end))
            yield pd.DataFrame(out, columns=["file", "records", "bytes", "lost"])

    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    manifest(spark, folder).select("file").repartition(32, "file").mapInPandas(of, MANIFEST + ", lost long").write.parquet(staged)
    got = spark.read.schema(MANIFEST + ", lost long").parquet(staged)
    if not got.where("lost > 0 or records = 0").isEmpty():
        _publish(got.where("records > 0").drop("lost"), folder)
    return got


def delete(spark: SparkSession, folder: str, gone: DataFrame) -> None:
    """Take files (file) out of a folder, first out of its manifest, then off the store. Files that are not there are no error."""
    live = manifest(spark, folder)
    _publish(live.join(gone.select("file").distinct(), "file", "left_anti").select("file", "records", "bytes"), folder)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _fs(folder)
        for pdf in parts:
            for name in pdf["file"]:
                if files.get_file_info(f"{root}/{name}").is_file:
                    files.delete_file(f"{root}/{name}")
            yield pdf

    live.join(gone.select("file").distinct(), "file", "left_semi").select("file").mapInPandas(of, "file string").write.format("noop").mode("overwrite").save()


def scan_files(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> (path, records, valid_bytes, total_bytes): what a recovery scan finds in segment files."""
    import io

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                n = end = 0
                for _, _, end in scan_stream(io.BytesIO(content)):
                    n += 1
                out.append((path, n, end, len(content)))
            yield pd.DataFrame(out, columns=["path", "records", "valid_bytes", "total_bytes"])

    return files.select("path", "content").mapInPandas(of, "path string, records long, valid_bytes long, total_bytes long")
