"""From annotations to split, augmented samples with normalised boxes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.names import sample_name, stem
from ..operators import detect, splits, variants, windows
from ..sources import files, sinks


@dataclass(frozen=True)
class Plan:
    train: float = 0.7
    val: float = 0.2
    test: float = 0.1
    seed: int = 0
    least_slice: float = 3.0
    step: float = 0.25
    least_shift: float = 0.25
    most_shift: float | None = None
    shifts: int = 2
    drops: int = 1
    masks: int = 1
    flip: bool = False


def build(annotations: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """annotations(id, path, channel, left, right, bottom, top, audio_duration, samplerate) -> one row a sample: sample,
    split, kind, source, window_start, window, boxes and rectangles. Only plans move; :func:`samples` reads them.

    The slice length is one number, collected before the plan of the rest is built.
    """
    stats = splits.duration_stats(annotations, plan.least_slice).collect()
    if not stats:
        raise ValueError("no annotation with a positive duration")
    window = float(stats[0].slice_seconds)
    anchors = windows.usable_anchors(windows.positive_annotations(annotations), window)
    anchors = splits.assign_splits(anchors, plan.train, plan.val, plan.test, plan.seed)
    base = windows.base_windows(anchors, window)
    shifted = variants.shift_plans(base.filter("split = 'train'"), window, plan.step, plan.least_shift, plan.most_shift, plan.shifts, plan.seed)
    rest = base.filter("split <> 'train'").withColumns({"kind": F.lit("base"), "variant": F.lit(None).cast("int")})
    samples = shifted.unionByName(rest.select(shifted.columns))
    name = sample_name(stem(F.col("path").cast("string")), F.col("id"), F.col("kind"), F.col("variant"))
    samples = samples.withColumns({"sample": name, "freq_max": F.col("samplerate") / 2.0})
    pairs = windows.boxes_in_window(samples, annotations, window, "freq_max")
    boxes = windows.collect_boxes(pairs)
    keep = samples.select("sample", "id", "path", "channel", "split", "kind", "variant", "window_start", F.lit(window).alias("window"))
    out = variants.variants(windows.drop_empty_samples(keep.join(boxes, "sample")), plan.drops, plan.masks, plan.flip, plan.seed)
    suffix = F.when(F.col("derived").isNull(), "").otherwise(F.concat(F.lit("__"), "derived", F.coalesce(F.col("derived_variant").cast("string"), F.lit(""))))
    return out.withColumn("sample", F.concat("sample", suffix))


def samples(spark: SparkSession, plans: DataFrame, paths) -> DataFrame:
    """Plans of :func:`build` with ``spectrogram`` (flipped or masked as planned) and ``label``, one row a sample, so that what
    belongs to one is written by one task or not at all. Samples are read and turned to spectrograms in one pass."""
    asked = plans.withColumns({"window_length": F.col("window"), "flipped": F.coalesce(F.col("derived") == "flip", F.lit(False)), "label": sinks.label_text(F.col("boxes"))})
    return files.load_windows(spark, asked, paths, then=spectrogram_rows()).drop("flipped", "window_length")


def spectrogram_rows():
    run, own = detect.spectrograms()
    return run, f"samplerate int, {own}"


def write(spark: SparkSession, plans: DataFrame, paths, out: str) -> dict[str, int]:
    """Writes :func:`samples` below out, a folder a split, by one job that commits all or nothing; returns how many samples
    each kind has, counted as they were written."""
    rows, kinds = samples(spark, plans, paths), ("base", "shift", "shiftneg", "flip", "drop", "mask")
    written = Observation("samples")
    rows = rows.observe(written, *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    rows.write.mode("overwrite").partitionBy("split").parquet(out)
    return {k: written.get[k] for k in kinds}
