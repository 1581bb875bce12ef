"""Scoring windows with a user's detector, and spectrograms of windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import signal
from ..functions.boxes import box_to_physical

BOX = "x_center double, y_center double, width double, height double, confidence double"


def detect(windows: DataFrame, make_detector: Callable[[], Callable], samples: str = "samples") -> DataFrame:
    """windows(.., samples, samplerate) -> one row a box. ``make_detector()`` runs once a task and gives a function of
    (list of sample arrays, samplerates) to a list of (n, 5) arrays: x, y, width, height in 0..1 and confidence. Windows
    without boxes vanish; samples are dropped."""
    others = [c for c in windows.columns if c != samples]
    boxes = [x.split()[0] for x in BOX.split(", ")]

    def run(batches):
        score = make_detector()
        for b in batches:
            x = [np.asarray(s, np.float32) for s in b.column(b.schema.get_field_index(samples)).to_pylist()]
            found = [np.reshape(f, (-1, 5)) for f in score(x, b.column(b.schema.get_field_index("samplerate")).to_pylist())]
            take = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]))
            flat = np.concatenate([np.zeros((0, 5)), *found])
            cols = [b.column(b.schema.get_field_index(c)).take(take) for c in others] + [pa.array(flat[:, i]) for i in range(5)]
            yield pa.record_batch(cols, names=others + boxes)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*others).schema] + [BOX])
    return windows.select(*others, samples).mapInArrow(run, schema)


def physical_detections(boxes: DataFrame, window: float) -> DataFrame:
    """Boxes(path, window_index, window_start, samplerate, ..) as detections in seconds and hertz; detection_index is the
    order of emission: window, then confidence."""
    box = F.struct("x_center", "y_center", "width", "height")
    out = boxes.withColumn("p", box_to_physical(box, F.col("window_start"), window, F.col("samplerate") / 2))
    order = F.shiftleft(F.col("window_index").cast("long"), 32) + F.row_number().over(Window.partitionBy("path", "window_index").orderBy(F.desc("confidence"), "x_center", "y_center"))
    return out.select(
        F.col("path").alias("audio_path"), F.col("window_index").cast("long"), "window_start", (F.col("window_start") + window).alias("window_end"),
        order.cast("long").alias("detection_index"), "p.start_time", "p.end_time", "p.duration", "p.low_freq", "p.high_freq", "confidence",
    )


def band_energy_detector(low: float = 6000.0, high: float = 8000.0, frame: float = 0.05, factor: float = 4.0) -> Callable[[], Callable]:
    """A plain test detector: runs of frames in which the band holds ``factor`` times the median frame's energy."""

    def make():
        def score(samples, rates):
            out = []
            for x, rate in zip(samples, rates):
                n = max(int(frame * rate), 1)
                rows = x[: len(x) // n * n].reshape(-1, n)
                freqs, power = signal.power_spectra(rows, rate)
                energy = power[:, (freqs >= low) & (freqs <= high)].sum(1) if len(rows) else np.zeros(0)
                loud = energy > factor * max(float(np.median(energy)) if len(energy) else 0.0, 1e-6)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
                top, total = rate / 2, max(len(x), 1)
                boxes = [((a + b) / 2 * n / total, 1 - (low + high) / 2 / top, (b - a) * n / total, (high - low) / top, float(1 - np.exp(-energy[a:b].max()))) for a, b in edges.reshape(-1, 2)]
                out.append(np.array(boxes))
            return out

        return score

    return make


SPECTROGRAM = "spectrogram struct<freqs:array<double>,times:array<double>,db:array<array<float>>,low_db:double,high_db:double>"


def spectrograms(size: int = 1024, overlap: int = 768, samples: str = "samples") -> tuple[Callable[[Iterator], Iterator], str]:
    """(a function of Arrow batches, the column that it adds): the spectrogram of each row's samples in place of these. Rows
    with a true ``flipped`` have it mirrored in time, those with ``rectangles`` have these filled with its median."""
    kind = pa.struct([("freqs", pa.list_(pa.float64())), ("times", pa.list_(pa.float64())), ("db", pa.list_(pa.list_(pa.float32()))), ("low_db", pa.float64()), ("high_db", pa.float64())])

    def run(batches):
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist() if c in b.schema.names else [None] * len(b)  # noqa: B023, E731
            out = []
            for x, rate, flipped, rects in zip(column(samples), column("samplerate"), column("flipped"), column("rectangles")):
                f, t, p = signal.spectrogram(np.asarray(x, float), rate, size, overlap)
                db = (10 * np.log10(p + 1e-12)).astype(np.float32)
                low, high = signal.db_clip_range(db)
                db = signal.mask(db[:, ::-1] if flipped else db, [(q["x"], q["y"], q["width"], q["height"]) for q in rects or []])
                out.append({"freqs": f.tolist(), "times": t.tolist(), "db": db.tolist(), "low_db": low, "high_db": high})
            others = [c for c in b.schema.names if c != samples]
            yield pa.record_batch([b.column(b.schema.get_field_index(c)) for c in others] + [pa.array(out, kind)], names=[*others, "spectrogram"])

    return run, SPECTROGRAM


def with_spectrogram(windows: DataFrame, size: int = 1024, overlap: int = 768, samples: str = "samples") -> DataFrame:
    """windows with ``spectrogram`` in place of their samples, see :func:`spectrograms`."""
    run, own = spectrograms(size, overlap, samples)
    return windows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in windows.drop(samples).schema] + [own]))
