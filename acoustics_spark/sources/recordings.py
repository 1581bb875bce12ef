"""Windows of recordings as a data source: ``spark.read.format("recordings")``."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.signal import extract_slice
from .files import _blocks, decode, open_file, read_header, window_frames

SCHEMA = "path string, window_index int, window_start double, window_length double, samplerate int, samples array<float>, error string"
SPLIT = 1 << 25  # bytes of recordings that a partition reads, about
EPS = 1e-6


def listing(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the recordings at or below a path; FileNotFoundError if it isn't there. Object stores by any of
    Hadoop's names for them; local paths without their scheme."""
    from pyarrow import fs

    own = re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "/", path)).rstrip("/") or "/"
    where, at = fs.FileSystem.from_uri(own)
    head = own[: len(own) - len(at)]
    found = where.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((head + f.path, f.size) for f in below if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))


def starts(duration: float, window: float, hop: float) -> np.ndarray:
    """The window starts of ``boxes.window_starts``."""
    last = duration - window
    if last + EPS < 0:
        return np.zeros(0)
    n = max(math.floor((last + EPS) / hop), 0)
    grid = np.arange(n + 1) * hop
    near = abs(n * hop - last) <= max(EPS, EPS * max(n * hop, abs(last)))
    return np.append(grid, last) if last > 0 and not near else grid


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, from, to) of recordings, of which a task reads the windows that start there; or what failed."""

    of: list[tuple[str, int, int]]
    failed: list[tuple[str, str]]


class Recordings(DataSource):
    """Options: path (several parted by ``;``), window and hop in seconds (3 and 1), split in bytes. A row is a window, or a
    recording or path that can't be read, with its error. Override ``lists`` and ``opens`` for other stores."""

    lists: Callable = staticmethod(listing)
    opens: Callable = staticmethod(open_file)

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options, self.lists, self.opens)


class RecordingReader(DataSourceReader):
    """Partitions are planned from the listing alone, by bytes, so a long recording is several tasks' work and many short
    ones are one's. Filters on path choose files before that, those on window_start windows before they are read."""

    def __init__(self, options, lists: Callable, opens: Callable):
        self.paths = [p for p in options.get("path", "").split(";") if p]
        self.window, self.hop, self.split = float(options.get("window", 3.0)), float(options.get("hop", 1.0)), int(options.get("split", SPLIT))
        self.lists, self.opens = lists, opens
        self.only: set[str] | None = None
        self.bounds: list[tuple[type, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("window_start",):
                self.bounds.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        out, held, total, failed = [], [], 0, []
        for path in self.paths:
            try:
                files = self.lists(path)
            except OSError as e:
                failed.append((path, f"{type(e).__name__}: {e}"))
                continue
            for file, size in files:
                if self.only is not None and file not in self.only:
                    continue
                for a in range(0, max(size, 1), self.split):
                    held.append((file, a, a + self.split if a + self.split < size else 1 << 62))
                    total += min(self.split, size - a)
                    if total >= self.split:
                        out.append(Ranges(held, []))
                        held, total = [], 0
        failed = [x for x in failed if self.only is None or x[0] in self.only]
        return [*out, Ranges(held, failed)]

    def _asked(self, at: np.ndarray) -> np.ndarray:
        checks = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
        keep = np.ones(len(at), bool)
        for kind, value in self.bounds:
            keep &= checks[kind](at, value)
        return keep

    def _batch(self, path: str, index, at, rate, samples, error) -> pa.RecordBatch:
        n = len(index)
        columns = [
            pa.array([path] * n, pa.string()), pa.array(index, pa.int32()), pa.array(at, pa.float64()), pa.array([None if error else self.window] * n, pa.float64()),
            pa.array([rate] * n, pa.int32()), pa.array(samples, pa.list_(pa.float32())), pa.array([error] * n, pa.string()),
        ]
        return pa.record_batch(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    def _unread(self, path: str, error: str) -> Iterator[pa.RecordBatch]:
        if not self.bounds:  # no window_start meets a bound
            yield self._batch(path, [None], [None], None, [None], error)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, error in partition.failed:
            yield from self._unread(path, error)
        for path, lo, hi in partition.of:
            try:
                yield from self._windows(path, lo, hi)
            except (OSError, ValueError, struct.error) as e:
                if lo == 0:
                    yield from self._unread(path, str(e))

    def _windows(self, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        with self.opens(path) as f:
            h = read_header(f)
            at = starts(h["frames"] / h["samplerate"], self.window, self.hop)
            byte = h["offset"] + np.floor(at * h["samplerate"]).astype(np.int64) * h["block"]
            index = np.flatnonzero((byte >= lo) & (byte < hi) & self._asked(at))
            frames = [window_frames(at[i], self.window, h, "cover") for i in index]
            for a, z, held in _blocks(frames, h["block"]):
                x = decode(f.read_at((z - a) * h["block"], h["offset"] + a * h["block"]), h).mean(1)
                own = [extract_slice(x, frames[k][0] - a, frames[k][1]) for k in held]
                yield self._batch(path, index[held], at[index[held]], h["samplerate"], own, None)


def register(spark: SparkSession, source: type[DataSource] = Recordings) -> None:
    """Makes the source known to a session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
