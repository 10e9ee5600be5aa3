"""A replayable record source with a resumable cursor, as a Python data source.

A recording is a folder of batches, one file each: a header line (truncated, newest_us)
and a line for each record (id, published_us, ...). The driver reads header lines alone;
records are read by the tasks, one partition a batch. The offset holds the number of batches
and the cursor without ids: while fetches are truncated the watermark is held, and
``high`` remembers the newest time. Each batch is read from its own lower bound, the
watermark of its time less the overlap, so what an overlap brings again is left to the
idempotent sink behind the source.

How far a query has planned is kept in the ``progress`` folder, so that every trigger,
also the first after a restart, takes at most ``batchesPerTrigger`` further batches.
Without that folder the first trigger takes all there are."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def next_cursor(cursor: dict, ids: list[str], times: list[int], truncated: bool, skipped: list[str] = ()) -> dict:
    """The cursor after one fetch. Times are microseconds; keys: watermark, high, pending."""
    pending = set(map(str, cursor.get("pending", ()))) | set(map(str, ids)) | set(map(str, skipped))
    known = [t for t in (cursor.get("high"), *times) if t is not None]
    high = max(known, default=None)
    if truncated:
        return {"watermark": cursor.get("watermark"), "high": high, "pending": sorted(pending)}
    return {"watermark": max((t for t in (cursor.get("watermark"), high) if t is not None), default=None), "high": None, "pending": []}


def since(cursor: dict, last_success: int | None, overlap_minutes: int) -> int | None:
    """Where the next fetch begins: the watermark, or the last success, less the overlap."""
    start = cursor.get("watermark") if cursor.get("watermark") is not None else last_success
    return None if start is None else start - overlap_minutes * 60_000_000


class Recording:
    """The batches of a folder on any file system that Arrow knows."""

    def __init__(self, path: str):
        self.system, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _file(self, n: int) -> str:
        return f"{self.path}/{n:06d}.jsonl"

    def has(self, n: int) -> bool:
        return self.system.get_file_info(self._file(n)).type == fs.FileType.File

    def header(self, n: int) -> dict:
        with self.system.open_input_stream(self._file(n), buffer_size=4096) as f:
            line = b""
            while b"\n" not in line and (more := f.read(4096)):
                line += more
        return json.loads(line.split(b"\n", 1)[0])

    def records(self, n: int) -> Iterator[dict]:
        with self.system.open_input_stream(self._file(n), buffer_size=1 << 20) as f:
            rest, first = b"", True
            while more := f.read(1 << 20):
                *lines, rest = (rest + more).split(b"\n")
                for line in lines:
                    if not first and line:
                        yield json.loads(line)
                    first = False
            if rest and not first:
                yield json.loads(rest)

    def add(self, n: int, records: list[dict], truncated: bool = False) -> None:
        times = [r["published_us"] for r in records if r.get("published_us") is not None]
        self.system.create_dir(self.path, recursive=True)
        lines = [{"truncated": truncated, "newest_us": max(times, default=None)}, *records]
        with self.system.open_output_stream(self._file(n)) as f:
            f.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())


class ReplaySource(DataSource):
    """Options: path, overlapMinutes (0), batchesPerTrigger (16), progress (a folder of its own for each query)."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "batch int, external_id string, published_us bigint, value string"

    def streamReader(self, schema):
        o = self.options
        return ReplayReader(o["path"], int(o.get("overlapMinutes", 0)), int(o.get("batchesPerTrigger", 16)), o.get("progress"))


class Batch(InputPartition):
    def __init__(self, n: int, since_us: int | None):
        self.n, self.since_us = n, since_us


class ReplayReader(DataSourceStreamReader):
    def __init__(self, path: str, overlap: int, per_trigger: int, progress: str | None):
        self.path, self.overlap, self.per_trigger = path, overlap, per_trigger
        self.progress = Recording(progress) if progress else None
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"batch": 0, "watermark": None, "high": None}

    def _walk(self, offset: dict, end: int) -> Iterator[tuple[Batch, dict]]:
        """Each batch from an offset on, and the offset behind it."""
        recording = Recording(self.path)
        for n in range(offset["batch"], end):
            if not recording.has(n):
                return
            header = recording.header(n)
            batch = Batch(n, since(offset, None, self.overlap))
            times = [header["newest_us"]] if header.get("newest_us") is not None else []
            cursor = next_cursor(offset, [], times, header.get("truncated", False))
            offset = {"batch": n + 1, "watermark": cursor["watermark"], "high": cursor["high"]}
            yield batch, offset

    def latestOffset(self) -> dict:
        if self.at is None and self.progress is not None and self.progress.has(0):
            self.at = self.progress.header(0)
        bounded = self.at is not None or self.progress is not None
        start = self.at or self.initialOffset()
        out = start
        for _, out in self._walk(start, start["batch"] + self.per_trigger if bounded else 1 << 31):
            pass
        return out

    def partitions(self, start: dict, end: dict) -> list[Batch]:
        # planned means logged: after a restart an unfinished batch is planned again before more is asked for
        self.at = end
        if self.progress is not None:
            self.progress.system.create_dir(self.progress.path, recursive=True)
            with self.progress.system.open_output_stream(self.progress._file(0)) as f:
                f.write(json.dumps(end).encode() + b"\n")
        return [b for b, _ in self._walk(start, end["batch"])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for r in Recording(self.path).records(partition.n):
            at = r.get("published_us")
            if at is None or partition.since_us is None or at >= partition.since_us:
                yield partition.n, str(r["id"]), at, json.dumps(r, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        """Nothing is held back for a batch that is done."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplaySource)
