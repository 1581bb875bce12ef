"""Concatenated timelines: rebuilding them and mapping annotations back to single recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_SPACER = 55.125
TOLERANCE = 1e-3


def is_spacer(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("spacer"))


def is_audio(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".wav")) & ~is_spacer(name)


def effective_spacer(override: Column, spacer_duration: Column | None = None, default: float = DEFAULT_SPACER) -> Column:
    """The spacer recording's own duration where it counts, else the override, else the default."""
    own = [spacer_duration] if spacer_duration is not None else []
    return F.coalesce(*own, override, F.lit(default))


def with_durations(entries: DataFrame, recordings: DataFrame | None = None, overrides: DataFrame | None = None, default: float = DEFAULT_SPACER, spacer_recordings: bool = False) -> DataFrame:
    """entries(metafile, pos, entry_name) with is_audio and duration: a recording's own, else the metafile's spacer.

    recordings(entry_name, duration), or (path, duration) where entries have their path, and overrides(metafile, spacer) are
    joined by key; Spark broadcasts what is small.
    With ``spacer_recordings`` a spacer that is a ``.wav`` among the recordings lasts as long as it does.
    """
    out = entries.withColumn("is_audio", is_audio(F.col("entry_name")))
    if recordings is not None:
        key = "path" if "path" in entries.columns else "entry_name"
        out = out.join(recordings.select(key, F.col("duration").alias("_own")), key, "left")
    else:
        out = out.withColumn("_own", F.lit(None).cast("double"))
    if overrides is not None:
        out = out.join(overrides.select("metafile", F.col("spacer").alias("_spacer")), "metafile", "left")
    else:
        out = out.withColumn("_spacer", F.lit(None).cast("double"))
    counts = F.when(F.endswith(F.lower("entry_name"), F.lit(".wav")), F.col("_own")) if spacer_recordings else None
    duration = F.when(F.col("is_audio"), F.col("_own")).otherwise(effective_spacer(F.col("_spacer"), counts, default))
    return out.withColumn("duration", duration).drop("_own", "_spacer")


def build_timeline(entries: DataFrame) -> DataFrame:
    """entries(metafile, pos, duration, ..) with start and end: running sums in play order, spacers included."""
    before = Window.partitionBy("metafile").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = entries.withColumn("start", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))
    return out.withColumn("end", F.col("start") + F.col("duration"))


def timeline_summary(segments: DataFrame) -> DataFrame:
    """Length and entry counts of each metafile."""
    return segments.groupBy("metafile").agg(
        F.max("end").alias("length"), F.count("*").alias("n_entries"), F.count_if("is_audio").alias("n_audio"), F.count_if(~F.col("is_audio")).alias("n_spacer")
    )


def map_to_segments(annotations: DataFrame, segments: DataFrame, tolerance: float = TOLERANCE, bucket: float = 64.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Annotations(metafile, left, right, ..) with the audio segment that each starts in and its times there.

    The earliest audio segment with start - tolerance <= left <= end + tolerance takes it; times are clamped to it.
    ``status`` is ``ok``, ``past_end`` (ends beyond the segment) or ``unmatched``; ``reason`` tells where an unmatched
    one starts. Segments are gathered by metafile and time bucket, in each bucket that they touch, and an annotation meets
    the one of its left end: a join that gives every row back once, whatever its other columns, and that spreads a
    metafile of any length over tasks. An annotation without a metafile or a left end is unmatched. ``carry`` names columns
    of segments that come along.
    """
    span = F.sequence(F.floor((F.col("start") - tolerance) / bucket), F.floor((F.col("end") + tolerance) / bucket))
    row = F.struct("pos", "entry_name", "is_audio", "start", "end", "duration", *carry)
    held = segments.select(F.col("metafile").alias("_m"), F.explode(span).alias("_bucket"), row.alias("_row"))
    held = held.groupBy("_m", "_bucket").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    left = F.col("left")
    near = F.filter("_rows", lambda s: s["is_audio"] & (left >= s["start"] - tolerance) & (left <= s["end"] + tolerance))
    at = F.filter("_rows", lambda s: (left >= s["start"]) & (left <= s["end"]))
    out = annotations.join(held, (annotations["metafile"] == F.col("_m")) & (F.floor(left / bucket) == F.col("_bucket")), "left")
    out = out.withColumns({"_seg": F.get(near, F.lit(0)), "_in": F.get(at, F.lit(0))["entry_name"]})
    found = F.col("_seg").isNotNull()
    rel = lambda c: F.when(found, F.least(F.greatest(F.col(c) - F.col("_seg.start"), F.lit(0.0)), F.col("_seg.duration")))
    status = F.when(~found, "unmatched").when(F.col("right") > F.col("_seg.end") + tolerance, "past_end").otherwise("ok")
    reason = F.when(~found, F.coalesce(F.concat(F.lit("starts in "), F.col("_in")), F.lit("starts outside the timeline")))
    return out.select(
        *annotations.columns, F.col("_seg.pos").alias("pos"), F.col("_seg.entry_name").alias("entry_name"), *[F.col(f"_seg.{c}").alias(c) for c in carry], rel("left").alias("left_rel"), rel("right").alias("right_rel"), status.alias("status"), reason.alias("reason")
    )


def good_and_rejects(mapped: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mapped rows, the others with their reason); strict raises if there are others."""
    good, bad = mapped.filter("status = 'ok'"), mapped.filter("status <> 'ok'")
    if strict and (first := bad.limit(1).collect()):
        raise ValueError(f"annotation not mapped: {first[0].asDict()}")
    return good, bad
