"""Readers of recordings, metafiles, logs and tables; each gives good rows and, where rows can be bad, the rejects."""

from __future__ import annotations

import fnmatch
import io
import os
import posixpath
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.names import basename, local_path
from ..functions.signal import extract_slice
from ..schemas import ANNOTATIONS, DETECTIONS, LOG, REQUIRED_ANNOTATIONS, SIGNATURES, require_columns
from ..store import kept

HEADER_BYTES = 1 << 16
AT_ONCE, GAP = 1 << 24, 1 << 16  # bytes read at once, and bytes between windows that are read rather than skipped
TASKS_PER_CORE = 4  # that list folders and open files; small ones are opened many in a task
LISTED, LINES = 10_000, 5_000  # files, and lines of logs, that a task gives at once
BLOCK, CHUNK = 1 << 25, 1 << 20  # bytes of a log that are one task's, and of these at once
PACKED, UNREAD = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}, ("deflate", "lz4", "snappy")  # ends of names of compressed logs
SPACE = bytes(range(33))


def store_of(path: str):
    """(file system, place there) of a path: local ones and those of the object stores that Arrow knows, under Hadoop's names
    for them, too."""
    from urllib.parse import quote

    from pyarrow import fs

    own = re.sub("^s3[an]://", "s3://", re.sub(r"^file:/+", "/", path))
    return fs.FileSystem.from_uri(own if own.startswith("/") else quote(own, safe=":/@"))


def open_file(path: str):
    """A file that was listed, for reading at any place; of the stores that :func:`store_of` knows."""
    where, at = store_of(path)
    return where.open_input_file(at)


def reached(path: str) -> bool:
    """Whether tasks can list and open what lies at a path: it isn't relative, has no wildcards and is in a store that
    :func:`store_of` knows."""
    try:
        store_of(path)
    except (ValueError, OSError, ImportError, NotImplementedError):
        return False
    return not set("*?[]{}\\") & set(path)


def _passed(name: str, length: int | None) -> bool:
    """Whether Spark's readers pass over a file, or a folder (without a length), of this name."""
    inner = length is None and name.startswith(("_metadata", "_common_metadata"))
    return length == 0 or name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not inner


def list_folder(path: str, top: bool = False) -> Iterator[tuple[str, int | None]]:
    """(path, bytes) of what lies in a folder, bytes None for a folder. What Spark's readers pass over is left out, empty files,
    too, as is what vanishes meanwhile. A ``top`` that is a file stands for itself, and one that isn't there is an error."""
    from pyarrow import fs

    where, at = store_of(path)
    if top:
        found = where.get_file_info(at)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if found.type == fs.FileType.File:
            yield path, found.size
            return
    if isinstance(where, fs.LocalFileSystem):
        below = _scanned(at, top)
    else:
        found = where.get_file_info(fs.FileSelector(at, allow_not_found=not top))
        below = ((x.base_name, x.size if x.type == fs.FileType.File else None) for x in found)
    for name, length in below:
        if not _passed(name, length):
            yield f"{path.rstrip('/')}/{name}", length


def _scanned(folder: str, top: bool) -> Iterator[tuple[str, int | None]]:
    """(name, bytes) of what a local folder holds, which is never in memory as a whole."""
    try:
        with os.scandir(folder) as found:
            for x in found:
                try:
                    length = None if x.is_dir() else x.stat().st_size
                except FileNotFoundError:
                    continue
                yield x.name, length
    except FileNotFoundError:
        if top:
            raise


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over the tasks that list or open files."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE, *keys)


def list_files(spark: SparkSession, paths, glob: str = "*", recursive: bool = True, lister: Callable = list_folder) -> DataFrame:
    """(path, length) of files; local paths have no scheme. Only the listing is read.

    Tasks list folders with ``lister``, those of one depth at a time, so the driver never holds the files. Where tasks can't
    (see :func:`reached`; globs beyond ``*``, ``?`` and ``[..]``) Spark's reader lists, which takes all of them through the driver.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    if set("{}\\^!") & set(glob) or not all(map(reached, roots)):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
        return reader.load(paths).select(local_path(F.col("path")).alias("path"), "length")

    def run(top):
        def below(batches):
            rows = []
            for b in batches:
                for folder in b.column(0).to_pylist():
                    for path, length in lister(folder, top):
                        if length is None or fnmatch.fnmatchcase(path.rpartition("/")[2], glob):
                            rows.append((path, length))
                        if len(rows) == LISTED:
                            yield batch(rows)
                            rows = []
            yield batch(rows)

        return below

    def batch(rows):
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64()))], names=["path", "length"])

    roots = [re.sub("^file:/+", "/", x) for x in roots]
    roots = [re.sub("^/+", "/", posixpath.normpath(x)) if x.startswith("/") else x for x in roots]
    level = kept(spark.createDataFrame([(x,) for x in roots], "path string").mapInArrow(run(True), "path string, length long"))
    out = level
    while recursive and not (folders := level.filter("length is null")).isEmpty():
        level = kept(dealt(folders.select("path"), "path").mapInArrow(run(False), "path string, length long"))
        out = out.unionAll(level)
    out = out.filter("length is not null")
    return dealt(out.distinct() if len(roots) > 1 else out, "path")


def read_from() -> F.Column:
    """The file that a row was read from, as :func:`list_files` has it: Spark's own column percent-encodes it."""
    return local_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def list_recordings(spark: SparkSession, paths, recursive: bool = True, exclude: str | None = None) -> DataFrame:
    """(path, length) of ``*.wav`` files; names that contain ``exclude`` in any case are left out. Only the listing is read."""
    out = list_files(spark, paths, "*.[wW][aA][vV]", recursive)
    return out.filter(~F.contains(F.lower(basename(F.col("path"))), F.lit(exclude.lower()))) if exclude else out


def read_metafiles(spark: SparkSession, root, opener: Callable = open_file) -> DataFrame:
    """(metafile, text) of all ``*metafile.txt`` below root. ``root`` may be a listing(path): tasks open its metafiles with
    ``opener`` then, and the driver holds none of their names."""
    if isinstance(root, DataFrame):

        def run(batches):
            for b in batches:
                paths, texts, held = [], [], 0
                for path in b.column(0).to_pylist():
                    with opener(path) as f:
                        paths.append(path)
                        texts.append(f.read())
                    held += len(texts[-1])
                    if held >= AT_ONCE:
                        yield batch(paths, texts)
                        paths, texts, held = [], [], 0
                yield batch(paths, texts)

        def batch(paths, texts):
            return pa.record_batch([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["metafile", "text"])

        asked = root.filter(F.endswith("path", F.lit("metafile.txt"))).select("path")
        return asked.mapInArrow(run, "metafile string, text binary").withColumn("text", F.col("text").cast("string"))
    reader = spark.read.option("pathGlobFilter", "*metafile.txt").option("recursiveFileLookup", "true")
    return reader.text(root, wholetext=True).select(read_from().alias("metafile"), F.col("value").alias("text"))


def parse_metafiles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metafile, text) -> entries (metafile, log_ref, pos, entry_name) and rejects (metafile, reason). Lines are trimmed
    and blank ones dropped; the first must be ``annotationfile=``."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = files.withColumn("_lines", lines).withColumn("_first", F.get("_lines", F.lit(0)))
    headed = F.lower("_first").startswith("annotationfile=")
    good = rows.filter(headed).withColumn("log_ref", F.trim(F.substring("_first", 16, 1 << 20)))
    entries = good.select("metafile", "log_ref", F.posexplode(F.slice("_lines", F.lit(2), F.size("_lines"))).alias("pos", "entry_name"))
    reason = F.when(F.size("_lines") == 0, "empty").otherwise("no annotationfile line")
    return entries, rows.filter(~F.coalesce(headed, F.lit(False))).select("metafile", reason.alias("reason"))


def typed(rows: DataFrame, doubles, ints) -> tuple[DataFrame, DataFrame]:
    """Rows with these columns cast, and those in which one can't be."""
    casts = {c: F.trim(c).try_cast("double") for c in doubles} | {c: F.trim(c).try_cast("int") for c in ints}
    bad = F.lit(False)
    for c in casts.values():
        bad = bad | c.isNull()
    return rows.filter(~bad).withColumns(casts), rows.filter(bad)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows that :func:`placed` has read, with each one's number in its file from 1, in the order of ``_row`` if they have it. Rows are numbered within the file's
    blocks, and blocks by the counts of those before, so no task has a whole file."""
    counts = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_file", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row"))
    rows = (rows if "_row" in rows.columns else rows.withColumn("_row", F.monotonically_increasing_id())).join(counts, ["_file", "_block"])
    return rows.withColumn(name, F.col("_before") + own).drop("_before", "_row", "_file", "_block")


def placed(rows: DataFrame, *columns) -> DataFrame:
    """Columns of rows just read, with the file and block that each is from."""
    return rows.select(*columns, read_from().alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _lines(f, start: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte is in start..end, without their ends (any of Spark's three)."""
    place, rest, skip = max(start - 1, 0), b"", start > 0  # what begins before start is the range's before
    if skip:
        f.seek(place)
    while skip or place < end:
        more = f.read(max(CHUNK, len(rest)))
        pieces = (rest + more).splitlines(keepends=True)
        rest = pieces.pop() if more else b""  # the last may go on
        for line in pieces:
            if not skip and place < end:
                yield line.rstrip(b"\r\n")
            place, skip = place + len(line), False
        if not more:
            return


def log_lines(listing: DataFrame, opener: Callable = open_file) -> DataFrame:
    """(log_path, _file, _block, _row, line) of the logs of a listing(path, length): their lines but blank ones and the
    first other, which is the header, as Spark's reader takes them. A task opens a log with ``opener`` and reads BLOCK bytes of
    it; a compressed log is one task's."""
    packed = F.substring_index("path", ".", -1).isin(*PACKED, *UNREAD)
    size = F.when(packed, 0).otherwise(F.greatest(F.col("length") - 1, F.lit(0))).cast("long")
    block = F.explode(F.sequence(F.lit(0).cast("long"), size, F.lit(BLOCK).cast("long")))
    parts = dealt(listing.select("path", block.alias("block")), "path", "block")

    def run(batches):
        for b in batches:
            rows = []
            for path, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, head = 0, block == 0
                for i, line in enumerate(lines(path, block)):
                    if i == 0 and block == 0:
                        line = line.removeprefix(b"\xef\xbb\xbf")
                    if not line.strip(SPACE):
                        continue
                    if head:
                        head = False
                        continue
                    rows.append((path, block, n, line))
                    n += 1
                    if len(rows) == LINES:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    def lines(path, block):
        kind = path.rpartition(".")[2]
        if kind in UNREAD:
            raise ValueError(f"{path}: logs of this compression aren't read")
        with opener(path) as f:
            if kind in PACKED:
                with pa.CompressedInputStream(f, PACKED[kind]) as unpacked:
                    yield from _lines(unpacked, 0, 1 << 62)
            else:
                yield from _lines(f, block, block + BLOCK)

    def batch(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["log_path", "_block", "_row", "line"])

    found = parts.mapInArrow(run, "log_path string, _block long, _row long, line binary")
    return found.select("log_path", F.col("log_path").alias("_file"), "_block", "_row", F.col("line").cast("string").alias("line"))


def read_annotation_log(spark: SparkSession, paths, recursive: bool = False, held: Callable = lambda df: df, opener: Callable = open_file) -> tuple[DataFrame, DataFrame]:
    """Tab-separated logs -> (good, rejects): rows tagged ``an:`` or ``ft:`` with typed channel, times and frequencies, the
    log's path, and ``line_no``, a row's number in it from 1, others counted. With ``recursive`` every file below paths is
    taken for a log but recordings and metafiles, which aren't read. ``paths`` may be a listing(path, length) of logs: tasks
    open them with ``opener`` then (see :func:`log_lines`). ``held`` is given the rows as read and may store them."""
    known = [x.split()[0] for x in LOG.split(", ")]
    if isinstance(paths, DataFrame):
        rows = log_lines(paths, opener).withColumn("_of", F.from_csv("line", LOG, {"sep": "\t", "mode": "PERMISSIVE"}))
        rows = held(rows.select(*[F.col(f"_of.{c}").alias(c) for c in known], "log_path", "_file", "_block", "_row"))
    else:
        reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
        rows = reader.csv(paths, sep="\t", header=True, schema=LOG, mode="PERMISSIVE", enforceSchema=True)
        if recursive:
            path = F.lower("_metadata.file_path")
            rows = rows.filter(~F.endswith(path, F.lit(".wav")) & ~F.endswith(path, F.lit("metafile.txt")))
        rows = held(placed(rows, *known, read_from().alias("log_path")).withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered(rows, "line_no").filter(F.lower(F.trim("tag")).isin("an:", "ft:"))
    good, bad = typed(rows, ("left", "right", "top", "bottom"), ("channel",))
    short = F.col("comment").isNull()
    return good.filter(~short), bad.unionByName(good.filter(short).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in bad.schema]))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(folder, meta, log, name, seq) trimmed, nulls as empty, seq a row's number in its file; all four columns are needed."""
    rows = spark.read.csv(path, header=True)
    require_columns(rows, SIGNATURES)
    return numbered(placed(rows, *[F.coalesce(F.trim(c), F.lit("")).alias(n) for c, n in zip(SIGNATURES, ("folder", "meta", "log", "name"))]), "seq")


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Processed annotations (13 columns, 8 of them needed) -> (good, rejects), both with ``row_index``, a row's number in
    its file from 1."""
    head = spark.read.csv(path, header=True)
    require_columns(head, REQUIRED_ANNOTATIONS)
    known = [x.split()[0] for x in ANNOTATIONS.split(", ")]
    rows = placed(head, *[F.trim(c).alias(c) if c in head.columns else F.lit(None).cast("string").alias(c) for c in known])
    return typed(numbered(rows, "row_index"), ("lefttimesec", "righttimesec", "topfreqhz", "bottomfreqhz"), ("channel",))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, schema=DETECTIONS)


def read_header(f) -> dict:
    """samplerate, channels, sample bytes, frames and the data's offset of a RIFF file open for reading at any place. The
    chunks' names and sizes are read, wherever they lie, but not the chunks."""
    length = f.size()

    def at(place: int, n: int) -> bytes:
        return head[place : place + n] if place + n <= len(head) else f.read_at(n, place)

    head = f.read_at(min(HEADER_BYTES, length), 0)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    place, out = 12, {}
    while place + 8 <= length:
        name, size = struct.unpack("<4sI", at(place, 8))
        if name == b"fmt ":
            chunk = at(place + 8, min(size, length - place - 8))
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", chunk)
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", chunk, 24)[0]
            if kind not in (1, 3) or not channels or not rate or not block:
                raise ValueError(f"unsupported format {kind}")
            out = {"samplerate": rate, "channels": channels, "width": bits // 8, "block": block, "float": kind == 3}
        elif name == b"data" and out:
            size = min(size, length - place - 8)
            return out | {"offset": place + 8, "frames": size // out["block"]}
        place += 8 + size + size % 2
    raise ValueError("no data chunk")


def listed(spark: SparkSession, paths) -> DataFrame:
    """A listing of recordings as it is, or that of paths."""
    return paths if isinstance(paths, DataFrame) else list_recordings(spark, paths)


def recording_info(spark: SparkSession, paths, opener: Callable = open_file) -> DataFrame:
    """(path, samplerate, channels, frames, duration, error) of recordings, one row a file; unreadable ones have an error
    and nulls. ``paths`` may be a listing(path). Spark lists the files; a task opens each with ``opener`` and reads its
    chunks' heads alone."""

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    with opener(path) as f:
                        h = read_header(f)
                    rows.append((path, h["samplerate"], h["channels"], h["frames"], h["frames"] / h["samplerate"], None))
                except (OSError, ValueError, struct.error) as e:
                    rows.append((path, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "samplerate", "channels", "frames", "duration", "error"])

    return listed(spark, paths).select("path").mapInArrow(run, "path string, samplerate int, channels int, frames long, duration double, error string")


def decode(raw: bytes, header: dict) -> np.ndarray:
    """Whole frames as float32 in -1..1, frames x channels."""
    width = header["width"]
    if header["float"]:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) / 2.0**31).astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = (np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)).astype(np.float32)
    return x.reshape(-1, header["channels"])


def frame_range(start: float, length: float, rate: int, rule: str) -> tuple[int, int]:
    """(first frame, frames) by one of four rules: ``cover`` floor(start) and ceil(length), ``span`` floor(start) to
    ceil(end), ``nearest`` round(start) to round(end), ``slice`` round(start) and round(length)."""
    if rule == "cover":
        return int(np.floor(start * rate)), int(np.ceil(length * rate))
    if rule == "span":
        first = int(np.floor(start * rate))
        return first, max(int(np.ceil((start + length) * rate)) - first, 1)
    if rule == "slice":
        return round(start * rate), round(length * rate)
    return int(round(start * rate)), int(round((start + length) * rate)) - int(round(start * rate))


def window_frames(start: float, length: float, header: dict, rule: str, segment: tuple[float, float] | None = None) -> tuple[int, int, int, int]:
    """(first frame, frames, low, high): a window's frames, of which those in low..high sound and all others are zero. A
    segment (from, to), cut to the recording, is rounded as such, and the window's place is counted from its start."""
    rate, total = header["samplerate"], header["frames"]
    if segment is None:
        return *frame_range(start, length, rate, rule), 0, total
    begin, end = max(segment[0], 0.0), min(segment[1], total / rate)
    low = round(begin * rate)
    first, n = frame_range(start - begin, length, rate, rule)
    return low + first, n, low, max(min(low + round((end - begin) * rate), total), low)


def _blocks(frames: list[tuple[int, int, int, int]], width: int) -> Iterator[tuple[int, int, list[int]]]:
    """(lo, hi, windows): ranges of frames to read at once and the windows in them, by the windows' own frames."""
    own = [(max(first, low), max(min(first + n, high), max(first, low)), first, n) for first, n, low, high in frames]
    lo = hi = samples = 0
    held: list[int] = []
    for i in sorted(range(len(own)), key=lambda i: own[i][:2]):
        a, b, _, n = own[i]
        if held and (a > hi + GAP // width or (max(hi, b) - lo) * width > AT_ONCE or samples + n > AT_ONCE // 4):
            yield lo, hi, held
            held, samples = [], 0
        lo, hi = (lo, max(hi, b)) if held else (a, b)
        held.append(i)
        samples += n
    if held:
        yield lo, hi, held


def load_windows(spark: SparkSession, windows: DataFrame, paths, pad: bool = True, rule: str = "cover", start: str = "window_start", length: str = "window_length", segment: tuple[str, str] | None = None, opener: Callable = open_file, then: tuple[Callable, str] | None = None) -> DataFrame:
    """windows(path, start, length, ..) with samplerate and samples: the mono mean, zeros before and after what there is
    if pad, one zero where the window lies outside. ``segment`` names two columns, times beyond which nothing sounds.

    Only windows are shuffled, gathered by recording and stretch of time, so a long recording is several tasks' work. A
    task opens the file with ``opener``, reads the bytes of neighbouring windows at once, AT_ONCE of them at most (or one
    window), and gives their samples before it reads on. Windows of paths that the listing of ``paths`` lacks are dropped.
    ``then`` is a function of Arrow batches with the schema of what it gives, such as ``slices.features``: it runs on the
    samples where they were read, so that these never leave the task.
    """
    known = listed(spark, paths).select(F.col("path").alias("_known"))
    others = [c for c in windows.columns if c != "path"]
    asked = windows.join(known, F.col("path") == F.col("_known")).drop("_known")
    asked = asked.withColumn("_part", F.floor(F.col(start) / (512.0 * F.col(length)))).groupBy("path", "_part").agg(F.collect_list(F.struct(*others)).alias("_windows"))

    def read(batches):
        for b in batches:
            for path, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opener(path) as f:
                    h = read_header(f)
                    frames = [window_frames(w[start], w[length], h, rule, segment and (w[segment[0]], w[segment[1]])) for w in asked]
                    for lo, hi, held in _blocks(frames, h["block"]):
                        x = decode(f.read_at((hi - lo) * h["block"], h["offset"] + lo * h["block"]), h).mean(1) if hi > lo else np.zeros(0, np.float32)
                        out = []
                        for i in held:
                            first, n, low, high = frames[i]
                            a, z = max(first, low), min(first + n, high)
                            own = x[a - lo : z - lo] if z > a else x[:0]
                            out.append(extract_slice(own, first - a if z > a else 0, n) if pad and n > 0 else own if len(own) else np.zeros(1, np.float32))
                        table = pa.Table.from_pylist([asked[i] for i in held], schema=pa.schema([(k.name, _arrow(k.dataType)) for k in kept]))
                        table = table.append_column("path", pa.array([path] * len(held))).append_column("samplerate", pa.array([h["samplerate"]] * len(held), pa.int32()))
                        yield from table.append_column("samples", pa.array(out, pa.list_(pa.float32()))).to_batches()

    kept = [windows.schema[c] for c in others]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["path string", "samplerate int", "samples array<float>"])
    if then is None:
        return asked.select("path", "_windows").mapInArrow(read, schema)
    after, more = then
    return asked.select("path", "_windows").mapInArrow(lambda batches: after(read(batches)), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["path string", more]))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def wav_bytes(samples: np.ndarray, samplerate: int) -> bytes:
    """16-bit PCM of samples in -1..1."""
    import wave

    x = samples if samples.ndim == 2 else samples[:, None]
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(x.shape[1])
            w.setsampwidth(2)
            w.setframerate(samplerate)
            w.writeframes(np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
        return f.getvalue()
