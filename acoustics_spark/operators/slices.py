"""Slices of detections: spectral features, labels, statistics, deduplicated calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import signal
from ..functions.boxes import rms, slice_grid

KEY = ("audio_path", "detection_index")
CALL_HZ = 6000.0
CALL_SHARE = 0.05


def expand_slices(detections: DataFrame, slice_seconds: float = 0.02, pad: float = 0.05) -> DataFrame:
    """One row a slice: slice_idx and slice_start."""
    grid = slice_grid(F.col("start_time"), F.col("end_time"), pad, slice_seconds)
    return detections.select("*", F.posexplode(grid).alias("slice_idx", "slice_start"))


def band_filter(freqs: Column, power: Column, low: float = signal.BAND[0], high: float = signal.BAND[1]) -> Column:
    """Array of (freq, power) structs within low..high, both included."""
    return F.filter(F.arrays_zip(freqs.alias("freq"), power.alias("power")), lambda x: x["freq"].between(low, high))


FEATURES = ("power_floor", "dom_freq", "left_freq", "right_freq", "dom_power")


def features(samplerate: float, samples: str = "samples", keep_spectrum: bool = False, drop: tuple[str, ...] = ()) -> tuple[Callable[[Iterator], Iterator], str]:
    """(a function of Arrow batches, the columns that it adds): the features of each row's samples in place of these.

    A batch of slices becomes one matrix for each slice length; empty slices have null features.
    """

    def run(batches):
        for b in batches:
            rows = [np.asarray(x, float) if x is not None else np.zeros(0) for x in b.column(b.schema.get_field_index(samples)).to_pylist()]
            lengths = np.array([len(r) for r in rows], int)
            out = {n: np.full(len(rows), np.nan) for n in FEATURES}
            freqs, power = [None] * len(rows), [None] * len(rows)
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                f = signal.slice_features(np.stack([rows[i] for i in at]), samplerate)
                for name in FEATURES:
                    out[name][at] = f[name]
                if keep_spectrum:
                    for k, i in enumerate(at):
                        freqs[i], power[i] = f["freqs"], f["power"][k]
            others = [c for c in b.schema.names if c != samples and c not in drop]
            cols = [b.column(b.schema.get_field_index(c)) for c in others] + [pa.array(out[n], mask=np.isnan(out[n])) for n in FEATURES]
            if keep_spectrum:
                cols += [pa.array(x, pa.list_(pa.float64())) for x in (freqs, power)]
            yield pa.record_batch(cols, names=[*others, *FEATURES, *["freqs_band", "power_band"] * keep_spectrum])

    return run, ", ".join([f"{n} double" for n in FEATURES] + ["freqs_band array<double>, power_band array<double>"] * keep_spectrum)


def with_features(slices: DataFrame, samplerate: float, samples: str = "samples", keep_spectrum: bool = False) -> DataFrame:
    """slices(.., samples) with power_floor, dom_freq, left_freq, right_freq and dom_power (and freqs_band, power_band); see
    :func:`features`. The samples are dropped, so nothing behind this moves them."""
    run, more = features(samplerate, samples, keep_spectrum)
    others = slices.drop(samples)
    return slices.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema] + [more]))


def label_slices(slices: DataFrame) -> DataFrame:
    """classification: ``Trill`` if the dominant frequency is at least CALL_HZ and its power at least CALL_SHARE of the
    largest in the detection, else ``Silence``."""
    most = F.max(F.coalesce("dom_power", F.lit(0.0))).over(Window.partitionBy(*KEY))
    call = (F.col("dom_freq") >= CALL_HZ) & ((most <= 0) | (F.col("dom_power") >= CALL_SHARE * most))
    return slices.withColumn("classification", F.when(call, "Trill").otherwise("Silence"))


def central_slices(slices: DataFrame, n: int = 20) -> DataFrame:
    """The n slices around the middle of each detection, moved inward at its edges."""
    total = F.count("*").over(Window.partitionBy(*KEY))
    first = F.greatest(F.least(F.floor(total / 2) - n // 2, total - n), F.lit(0))
    return slices.withColumn("_first", first).filter((F.col("slice_idx") >= F.col("_first")) & (F.col("slice_idx") < F.col("_first") + n)).drop("_first")


def noise_slice(slices: DataFrame, samples: str = "samples") -> DataFrame:
    """The slice of least root mean square in each detection (ties: the first); null-sample slices don't count."""
    own = slices.withColumn("rms", rms(F.col(samples))).filter("rms is not null")
    return own.groupBy(*KEY).agg(F.min(F.struct("rms", "slice_idx")).alias("m")).select(*KEY, "m.slice_idx", "m.rms")


def trajectories(slices: DataFrame) -> DataFrame:
    """(KEY, points): the call slices' time since the window's start with their three frequencies, in order of time."""
    point = F.struct((F.col("slice_start") - F.col("window_start")).alias("t"), F.col("dom_freq").alias("dom"), F.col("left_freq").alias("low"), F.col("right_freq").alias("high"))
    calls = F.collect_list(F.when(F.col("classification") == "Trill", point))
    return slices.groupBy(*KEY).agg(F.array_sort(calls).alias("points"))


def detection_stats(slices: DataFrame, slice_seconds: float = 0.02) -> DataFrame:
    """Per detection: dominant frequencies of call slices, low and high ones of all slices, in order of slices, counts and
    the rate of calls. The arrays hold a detection's slices, which its length bounds."""
    def series(value: str, only_calls: bool = False) -> Column:
        own = F.struct("slice_idx", F.col(value).alias("v"))
        own = F.when(F.col(value).isNotNull() & ((F.col("classification") == "Trill") if only_calls else F.lit(True)), own)
        return F.transform(F.array_sort(F.collect_list(own)), lambda x: x["v"])

    out = slices.groupBy(*KEY).agg(
        F.count("*").alias("n_slices"), F.count_if(F.col("classification") == "Trill").alias("n_calls"),
        series("dom_freq", True).alias("dom_freqs"), series("left_freq").alias("low_freqs"), series("right_freq").alias("high_freqs"),
    )
    return out.withColumn("rate_hz", F.col("n_calls") / (F.col("n_slices") * slice_seconds))


def dedupe_calls(points: Column, window_seconds: float, inclusive: bool = False) -> Column:
    """Points (t, dom, ..) in order of time, without those of the same call: a group starts at a point and takes all
    within window_seconds of that start (inclusive: at just that distance, too); its point of largest dom stays, the first
    of equals. Points whose dom isn't positive don't count (only in the exclusive variant)."""
    own = points if inclusive else F.filter(points, lambda p: p["dom"] > 0)
    near = (lambda a, b: a - b <= window_seconds) if inclusive else (lambda a, b: a - b < window_seconds)

    def step(acc: Column, p: Column) -> Column:
        best = F.element_at(acc["kept"], -1)
        same = F.coalesce(near(p["t"], acc["anchor"]), F.lit(False))
        better = F.coalesce(p["dom"] > best["dom"], F.lit(False))
        head = F.slice(acc["kept"], F.lit(1), F.size(acc["kept"]) - 1)
        kept = F.when(~same, F.concat(acc["kept"], F.array(p))).when(better, F.concat(head, F.array(p))).otherwise(acc["kept"])
        return F.struct(F.when(same, acc["anchor"]).otherwise(p["t"]).alias("anchor"), kept.alias("kept"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.slice(own, 1, 0).alias("kept"))
    return F.aggregate(F.array_sort(own), start, step, lambda a: a["kept"])


def deduped_rate(trajectory: DataFrame, window_seconds: float, slice_seconds: float = 0.02, inclusive: bool = False) -> DataFrame:
    """trajectories with ``kept`` and the rate of kept calls over the time of all call slices."""
    out = trajectory.withColumn("kept", dedupe_calls(F.col("points"), window_seconds, inclusive))
    total = F.greatest(F.size("points"), F.lit(1)) * F.lit(slice_seconds)
    return out.withColumn("rate_hz", F.size("kept") / F.greatest(total, F.lit(1e-9)))


def frequency_summary(slices: DataFrame) -> DataFrame:
    """Per detection and frequency (dom of call slices, low and high of all): quartiles and mean in kHz."""
    call = F.when(F.col("classification") == "Trill", F.col("dom_freq"))
    long = slices.select(*KEY, call.alias("dom"), F.col("left_freq").alias("low"), F.col("right_freq").alias("high"))
    long = long.unpivot(list(KEY), ["dom", "low", "high"], "measure", "hz").filter("hz is not null")
    q = F.percentile("hz", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = long.groupBy(*KEY, "measure").agg(q.alias("q"), F.avg("hz").alias("mean"), F.count("*").alias("n"))
    return out.select(*KEY, "measure", "n", *[(F.col("q")[i] / 1000).alias(f"q{25 * (i + 1)}_khz") for i in range(3)], (F.col("mean") / 1000).alias("mean_khz"))


def db_clip_range(spectra: DataFrame, *keys: str) -> DataFrame:
    """(keys, low_db, high_db) of spectra(keys, power): the 5th and 99th percentile in decibels, in long form."""
    db = 10 * F.log10(F.col("power") + 1e-12)
    out = spectra.groupBy(*keys).agg(F.percentile(db, F.array(F.lit(0.05), F.lit(0.99))).alias("q"))
    return out.select(*keys, F.col("q")[0].alias("low_db"), F.col("q")[1].alias("high_db"))
