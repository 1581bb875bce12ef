"""From recordings to merged detections and their spectral statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import detect, intervals, slices, windows
from ..sources import files


def detections(spark: SparkSession, paths, make_detector: Callable, window: float = 3.0, hop: float = 1.0, confidence: float = 0.25, most: int = 2, low: float = 0.0, high: float = 1e9, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(merged detections, unusable recordings) of all recordings below paths, or of a listing(path) of them."""
    info = files.recording_info(spark, paths)
    usable, rest = windows.usable_recordings(info.filter("error is null"), window)
    grid = windows.expand_windows(usable.select("path", "duration"), window, hop).drop("duration", "window_end").withColumn("window_length", F.lit(window))
    boxes = detect.detect(files.load_windows(spark, grid, paths), make_detector)
    found = detect.physical_detections(boxes, window)
    found = intervals.top_k_per_window(intervals.filter_confidence(found, confidence), most)
    merged = intervals.premerge(intervals.filter_duration(found, low, high), 3600.0, tolerance)
    return intervals.renumber_detections(merged.drop("island")), rest.unionByName(info.filter("error is not null"))


def characterise(spark: SparkSession, found: DataFrame, paths, samplerate: float, shortest: float = 1.0, longest: float = 5.0, slice_seconds: float = 0.02, pad: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(labelled slices, statistics) of the detections that last shortest .. longest seconds. Samples are read and turned to
    features in one pass."""
    chosen = intervals.filter_duration(found, shortest, longest).withColumnRenamed("audio_path", "path")
    cut = slices.expand_slices(chosen.select("path", "detection_index", "window_start", "start_time", "end_time"), slice_seconds, pad)
    cut = cut.withColumns({"slice_length": F.lit(slice_seconds), "from": F.col("start_time") - pad, "to": F.col("end_time") + pad})
    then = slices.features(samplerate, drop=("samplerate",))
    read = files.load_windows(spark, cut, paths, rule="slice", start="slice_start", length="slice_length", segment=("from", "to"), then=then).drop("from", "to")
    labelled = slices.label_slices(read.withColumnRenamed("path", "audio_path"))
    return labelled, slices.detection_stats(labelled, slice_seconds)
