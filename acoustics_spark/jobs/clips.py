"""Clips of remapped annotations, band-passed to their frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.boxes import padded_window
from ..sources import files, sinks


def clips(spark: SparkSession, annotations: DataFrame, paths, padding: float = 0.0, margin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """annotations(AudioPath, lefttimesec, righttimesec, topfreqhz, bottomfreqhz, stem, global_index, ..) of ``remap`` ->
    (clips, rejects). A clip is the mono mean of its annotation's time with ``padding`` on both sides, as far as the
    recording goes, band-passed without a shift to its frequencies and ``margin``; ``name`` is its file's. Rejects are
    outside their recording, or have none."""
    info = files.recording_info(spark, paths).filter("error is null").select(F.col("path").alias("_path"), F.col("duration").alias("_duration"))
    rows = annotations.join(info, F.col("AudioPath") == F.col("_path"), "left")
    window = padded_window(F.col("lefttimesec"), F.col("righttimesec"), padding, F.col("_duration"))
    rows = rows.withColumns({"path": F.col("AudioPath"), "_w": window, "low": F.col("bottomfreqhz"), "high": F.col("topfreqhz"), "name": F.format_string("%s_ann_%05d.wav", "stem", F.col("global_index").cast("long"))})
    rows = rows.withColumns({"clip_start": F.col("_w.start"), "clip_length": F.col("_w.length")}).drop("_w", "_path")
    fits = F.coalesce((F.col("clip_length") > 0) & (F.col("clip_start") < F.col("_duration")), F.lit(False))
    reason = F.when(F.col("_duration").isNull(), "no recording").otherwise("outside the recording")
    read = files.load_windows(spark, rows.filter(fits).drop("_duration"), paths, pad=False, rule="span", start="clip_start", length="clip_length")
    return sinks.filtered_clips(read, margin), rows.filter(~fits).select(*annotations.columns, reason.alias("reason"))
