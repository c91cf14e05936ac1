"""Long WAV recordings read by byte ranges: a file is as many tasks as it has ranges, and no task holds more than a chunk of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: ``samples`` begin ``skip`` samples before the chunk, hold its ``own`` ones and go on into the next one; ``total`` is the recording's.
CHUNK = "recording string, chunk int, start double, sample_rate int, samples array<float>, skip int, own int, total long"
ARROW = pa.schema([("recording", pa.string()), ("chunk", pa.int32()), ("start", pa.float64()), ("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("skip", pa.int32()), ("own", pa.int32()), ("total", pa.int64())])


def header(f, size: int) -> tuple[int, int, int, int]:
    """Sample rate, channels, and where the samples begin and how many there are, of an open file; damaged or not 16 bits: none."""
    f.seek(0)
    top = f.read(12)
    if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
        return 0, 1, 0, 0
    at, rate, channels, bits = 12, 44_100, 1, 16
    while at + 8 <= size:
        f.seek(at)
        head = f.read(8)
        n = int.from_bytes(head[4:8], "little")
        if head[:4] == b"fmt " and n >= 16:
            part = f.read(16)
            channels, rate, bits = int.from_bytes(part[2:4], "little"), int.from_bytes(part[4:8], "little"), int.from_bytes(part[14:16], "little")
        elif head[:4] == b"data":
            good = bits == 16 and channels and rate
            return rate, max(1, channels), at + 8, min(n, size - at - 8) // (2 * channels) if good else 0
        at += 8 + n + n % 2
    return rate, max(1, channels), 0, 0


def span(chunk: int, step: int, total: int, before: int, after: int) -> tuple[int, int, int, int]:
    """First and last sample to read for a chunk, how many come before it, and how many are its own."""
    lo = max(0, chunk * step - before)
    return lo, min(total, (chunk + 1) * step + after), chunk * step - lo, min(step, total - chunk * step)


class Ranges(InputPartition):
    """Byte ranges ``(path, first, end)`` of files."""

    def __init__(self, parts: list[tuple[str, int, int]]) -> None:
        super().__init__(parts)


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sec = options["path"], float(options.get("chunkSec", 3))
        self.step_of, self.before, self.after = int(options.get("stepOf", 1)), int(options.get("before", 0)), int(options.get("after", 0))
        self.bytes = int(options.get("rangeBytes", 64 << 20))

    def partitions(self) -> list[Ranges]:
        """Ranges of large files, and small files together, of about ``rangeBytes``; the driver lists names and sizes only."""
        where, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = where.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else [x for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.base_name.lower().endswith(".wav")]
        out, held, used = [], [], 0
        for x in sorted(files, key=lambda x: x.path):
            for at in range(0, x.size, self.bytes):
                n = min(self.bytes, x.size - at)
                if held and used + n > self.bytes:
                    out.append(Ranges(held))
                    held, used = [], 0
                held.append((x.path, at, at + n))
                used += n
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        where = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path, first, end in partition.value:
            with where.open_input_file(path) as f:
                rate, channels, data, total = header(f, f.size())
                step, wide = max(1, int(rate * self.sec)) // self.step_of * self.step_of or self.step_of, 2 * channels
                chunk = max(0, -(-(first - data) // (step * wide)))
                while chunk * step < total and data + chunk * step * wide < end:
                    lo, hi, skip, own = span(chunk, step, total, self.before, self.after)
                    f.seek(data + lo * wide)
                    x = np.frombuffer(f.read((hi - lo) * wide), "<i2").reshape(-1, channels)[:, 0] / np.float32(32768)
                    yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, (path, chunk, chunk * step / rate, rate, x.astype(np.float32), skip, own, total), strict=True))], ARROW)
                    chunk += 1


class WavRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)  # names of options in any case


def read_wav_ranges(spark: SparkSession, path: str, *, chunk_sec: float = 3.0, size: int = 0, hop: int = 0, range_bytes: int = 64 << 20) -> DataFrame:
    """CHUNK rows of a 16-bit WAV file, or of all in a folder, by byte ranges; the first channel counts.

    ``path`` is local to all machines, or a URI that pyarrow opens. A chunk belongs to the range that its first sample is in. With a frame
    ``size`` and ``hop`` chunks are cut to whole hops and overlap, so that every frame that starts in a chunk is whole in its row, and so
    is the frame before. Files that aren't such WAV files, and empty ones, have no rows.
    """
    spark.dataSource.register(WavRanges)
    options = {"chunkSec": chunk_sec, "stepOf": max(1, hop), "before": hop, "after": max(0, size - hop), "rangeBytes": range_bytes}
    return spark.read.format("wav_ranges").options(**options).load(path)
