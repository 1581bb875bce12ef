"""Detections as intervals: selection, merging, numbering and counts, each recording on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEY = "audio_path"
ORDER = ("start_time", "window_index", "detection_index")


def filter_duration(df: DataFrame, low: float, high: float) -> DataFrame:
    """Both ends included."""
    return df.filter(F.col("duration").between(low, high))


def filter_confidence(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("confidence") >= threshold)


def top_k_per_window(df: DataFrame, k: int = 2) -> DataFrame:
    """The k detections of highest confidence in each window (ties: the lower detection_index)."""
    best = Window.partitionBy(KEY, "window_index").orderBy(F.desc("confidence"), "detection_index")
    return df.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")


def with_islands(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """df with ``island``: a new one begins where an interval starts beyond the largest end so far plus tolerance, so
    touching intervals share one. Rows that end before they start are dropped, as they would break the running maximum."""
    order = Window.partitionBy(KEY).orderBy(*ORDER)
    before = F.max("end_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_time") <= before + tolerance, 0).otherwise(1)
    out = df.filter(F.col("end_time") >= F.col("start_time")).withColumn("_new", new)
    return out.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_overlapping(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row an island: the outer ends, lowest low and highest high frequency, highest confidence; its first row's
    detection_index. The aggregation reuses the window's partitioning, so there is one shuffle."""
    first = F.struct(*ORDER)
    out = with_islands(df, tolerance).groupBy(KEY, "island").agg(
        F.min("window_index").alias("window_index"),
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.min_by("detection_index", first).alias("detection_index"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.min("low_freq").alias("low_freq"),
        F.max("high_freq").alias("high_freq"),
        F.max("confidence").alias("confidence"),
    )
    return out.withColumn("duration", F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time")))


def premerge(df: DataFrame, bucket_seconds: float, tolerance: float = 0.0) -> DataFrame:
    """merge_overlapping for recordings too long for one task: merged within buckets of start time first, which spreads
    a recording over tasks, and then across them. The result is the same, as merging is associative."""
    bucket = F.floor(F.col("start_time") / bucket_seconds)
    keyed = df.withColumn("_path", F.col(KEY)).withColumn(KEY, F.concat_ws("\x00", KEY, bucket))
    part = merge_overlapping(keyed, tolerance).withColumn(KEY, F.substring_index(KEY, "\x00", 1))
    return merge_overlapping(part.drop("island"), tolerance)


def renumber_detections(df: DataFrame, order=("start_time",)) -> DataFrame:
    """detection_index anew, 1 to n in each recording."""
    return df.withColumn("detection_index", F.row_number().over(Window.partitionBy(KEY).orderBy(*order, "detection_index")))


def detection_counts(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """Raw and merged detections of each recording, and of all (audio_path null)."""
    both = raw.select(KEY, F.lit(1).alias("r"), F.lit(0).alias("m")).unionAll(merged.select(KEY, F.lit(0).alias("r"), F.lit(1).alias("m")))
    out = both.rollup(KEY).agg(F.sum("r").alias("n_raw"), F.sum("m").alias("n_merged"), F.grouping(KEY).cast("int").alias("is_total"))
    return out
