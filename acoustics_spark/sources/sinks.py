"""Writers of annotations, detections, labels, statistics and clips."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import signal
from ..functions.names import relative_to, sanitize_audio, stem
from ..schemas import ANNOTATIONS, DETECTION_COLUMNS
from .files import wav_bytes

AT_ONCE = 1 << 23  # bytes of recordings that a task gathers before it gives them
ANNOTATION_COLUMNS = tuple(x.split()[0] for x in ANNOTATIONS.split(", "))


def annotation_lines(rows: DataFrame) -> DataFrame:
    """The 13 columns, numbers with six decimals."""
    numbers = {"lefttimesec", "righttimesec", "topfreqhz", "bottomfreqhz"}
    return rows.select([F.format_string("%.6f", F.col(c)).alias(c) if c in numbers else F.col(c) for c in ANNOTATION_COLUMNS])


def write_annotations(rows: DataFrame, path: str) -> None:
    annotation_lines(rows).write.mode("overwrite").csv(path, header=True)


def write_detections(rows: DataFrame, path: str, form: str = "csv") -> None:
    rows.select(*DETECTION_COLUMNS).write.mode("overwrite").format(form).option("header", True).save(path)


def by_recording(rows: DataFrame, root: str = "") -> DataFrame:
    """Detections with ``folder``, the recording's folder below root with parts joined by ``__`` (``-`` for root itself),
    and ``recording``, its stem: together they tell any two recordings apart by their place."""
    above = F.regexp_replace(relative_to(F.col("audio_path"), root) if root else F.col("audio_path"), r"[/\\]?[^/\\]*$", "")
    folder = F.array_join(F.transform(F.filter(F.split(above, r"[/\\]"), lambda p: p != ""), sanitize_audio), "__")
    return rows.select(*DETECTION_COLUMNS, F.coalesce(F.nullif(folder, F.lit("")), F.lit("-")).alias("folder"), sanitize_audio(stem(F.col("audio_path"))).alias("recording"))


def write_detections_by_recording(rows: DataFrame, path: str, root: str = "") -> None:
    """A folder for each folder of recordings below root and in it one a recording. Rows are dealt by these, so each is one
    task's file."""
    keyed = by_recording(rows, root).repartition("folder", "recording").sortWithinPartitions("folder", "recording", "detection_index")
    keyed.write.mode("overwrite").partitionBy("folder", "recording").csv(path, header=True)


def label_text(boxes: Column) -> Column:
    """A line ``class x y w h`` a box, in their order."""
    line = lambda b: F.format_string("%d %.6f %.6f %.6f %.6f", b["class_id"], b["x_center"], b["y_center"], b["width"], b["height"])
    return F.array_join(F.transform(boxes, line), "\n")


def label_lines(samples: DataFrame) -> DataFrame:
    """(split, sample, label) of the samples with boxes."""
    return samples.filter(F.size("boxes") > 0).select("split", "sample", label_text(F.col("boxes")).alias("label"))


def write_labels(samples: DataFrame, path: str) -> None:
    label_lines(samples).write.mode("overwrite").partitionBy("split").parquet(path)


def write_dataset_stats(stats: DataFrame, path: str) -> None:
    """stats is a few rows by construction; one JSON file."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def filtered_clips(clips: DataFrame, margin: float = 0.0) -> DataFrame:
    """clips(samples, samplerate, low, high, ..) with samples band-passed to low - margin .. high + margin."""
    out = clips.schema

    def run(batches):
        for b in batches:
            at = [b.schema.get_field_index(c) for c in ("samples", "samplerate", "low", "high")]
            rows = zip(*(b.column(i).to_pylist() for i in at))
            done = [None if x is None else signal.bandpass(np.asarray(x, float), r, lo - margin, hi + margin) for x, r, lo, hi in rows]
            yield b.set_column(at[0], b.schema.field(at[0]), pa.array(done, b.schema.field(at[0]).type))

    return clips.mapInArrow(run, out)


def write_files(files: DataFrame, out: str) -> int:
    """Writes files(path, content) below out, one a row, from the tasks; returns how many. A file has another name until it is
    whole, so a task that fails or runs twice leaves no half one. For the file systems that Arrow knows."""

    def run(batches):
        import uuid

        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(re.sub("^file:/+", "/", out))
        made = set()
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                at = f"{top}/{path.as_py()}"
                if (folder := at.rpartition("/")[0]) not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with where.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                where.move(part, at)
            yield pa.record_batch([pa.array([len(b)], pa.int64())], names=["n"])

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def clip_files(clips: DataFrame) -> DataFrame:
    """clips(name, samples, samplerate) -> files(path, content): 16-bit recordings. A task turns one clip at a time and gives
    AT_ONCE bytes of them (or one), so what it holds hangs neither on the batches nor on the number of clips."""

    def run(batches):
        for b in batches:
            first, out, held = 0, [], 0
            for i, (x, rate) in enumerate(zip(b.column(1), b.column(2)), 1):
                out.append(wav_bytes(np.asarray(x.values, float), rate.as_py()))
                held += len(out[-1])
                if held >= AT_ONCE or i == len(b):
                    yield pa.record_batch([b.column(0).slice(first, i - first), pa.array(out, pa.binary())], names=["path", "content"])
                    first, out, held = i, [], 0

    return clips.select(F.col("name").cast("string"), "samples", F.col("samplerate").cast("int")).mapInArrow(run, "path string, content binary")


def write_clips(clips: DataFrame, path: str) -> None:
    clips.write.mode("overwrite").parquet(path)
