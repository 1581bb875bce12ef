"""Analysis windows over recordings, and the boxes of annotations in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.boxes import EPS, to_box, window_start_for, window_starts


def kept_and_counted(rows: DataFrame, name: str, **reasons: Column) -> tuple[DataFrame, Observation]:
    """rows that no reason holds for, and an observation that has, once an action has read them: ``n``, all rows, ``kept``, and
    by reason those it is the first to hold for. Nothing is read a second time to tell what was left out."""
    seen, first, taken = Observation(name), {}, F.lit(False)
    for reason, holds in reasons.items():
        holds = F.coalesce(holds, F.lit(True))
        first[reason] = holds & ~taken
        taken = taken | holds
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(~taken).alias("kept"), *[F.count_if(c).alias(r) for r, c in first.items()])
    return counted.filter(~taken), seen


def usable_recordings(recordings: DataFrame, window: float) -> tuple[DataFrame, DataFrame]:
    """(recordings of at least a window, the others)."""
    long = F.col("duration") + EPS >= window
    return recordings.filter(long), recordings.filter(~long | F.col("duration").isNull())


def expand_windows(recordings: DataFrame, window: float = 3.0, hop: float = 1.0) -> DataFrame:
    """recordings(path, duration, ..) -> one row a window: window_index from 0, window_start, window_end. Narrow: no samples
    are read and nothing is shuffled."""
    out = recordings.select("*", F.posexplode(window_starts(F.col("duration"), window, hop)).alias("window_index", "window_start"))
    return out.withColumn("window_end", F.col("window_start") + window)


def with_recordings(rows: DataFrame, recordings: DataFrame, key: str = "path") -> DataFrame:
    """rows with duration and samplerate of their recording."""
    return rows.join(recordings.select(key, F.col("duration").alias("audio_duration"), "samplerate"), key)


def positive_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.withColumn("duration", F.greatest(F.col("right") - F.col("left"), F.lit(0.0))).filter("duration > 0")


def usable_anchors(annotations: DataFrame, window: float) -> DataFrame:
    """Without those whose recording is shorter than the window or that are longer than it."""
    return annotations.filter((F.col("audio_duration") >= window) & (F.col("right") - F.col("left") <= window))


def counted_anchors(annotations: DataFrame, window: float) -> tuple[DataFrame, Observation]:
    """:func:`usable_anchors` of the positive annotations with the counts of what was left out, by reason."""
    length = F.col("right") - F.col("left")
    return kept_and_counted(annotations, "anchors", not_positive=~(length > 0), short_recording=~(F.col("audio_duration") >= window), too_long=~(length <= window))


def base_windows(annotations: DataFrame, window: float, shift: float = 0.0) -> DataFrame:
    """annotations(left, right, audio_duration, ..) with window_start; rows that no window can hold are dropped."""
    start = window_start_for(F.col("left"), F.col("right"), window, F.col("audio_duration"), F.lit(shift))
    return annotations.withColumn("window_start", start).filter("window_start is not null")


def boxes_in_window(windows: DataFrame, annotations: DataFrame, window: float, freq_max=None, key: str = "sample") -> DataFrame:
    """windows(key, path, channel, window_start, ..) x annotations(id, path, channel, left, right, bottom, top) that lie
    wholly within: (key, id, window_start, box). With freq_max (a column of windows or a number) also within 0..freq_max.

    A range join by time buckets of a window's length: an annotation is in the bucket it starts in, a window in the two
    or three it covers, and the bounds are a residual of the equi-join on recording, channel and bucket.
    """
    w = windows.select(key, "path", "channel", "window_start", *([freq_max] if isinstance(freq_max, str) else []))
    first, last = F.floor((F.col("window_start") - EPS) / window), F.floor((F.col("window_start") + window + EPS) / window)
    w = w.withColumn("_bucket", F.explode(F.sequence(first, last)))
    a = annotations.filter("right > left").select("id", "path", "channel", "left", "right", "bottom", "top", F.floor(F.col("left") / window).alias("_bucket"))
    out = w.join(a, ["path", "channel", "_bucket"])
    inside = (F.col("left") >= F.col("window_start") - EPS) & (F.col("right") <= F.col("window_start") + window + EPS)
    if freq_max is not None:
        top = F.col(freq_max) if isinstance(freq_max, str) else F.lit(float(freq_max))
        inside &= (F.col("bottom") >= -EPS) & (F.col("top") <= top + EPS)
        out = out.withColumn("box", to_box(F.col("left"), F.col("right"), F.col("bottom"), F.col("top"), F.col("window_start"), window, top))
    return out.filter(inside).drop("_bucket")


def collect_boxes(pairs: DataFrame, key: str = "sample") -> DataFrame:
    """(key, boxes) in the order of annotations; windows without a box have no row."""
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("id", "box"))), lambda x: x["box"])
    return pairs.groupBy(key).agg(boxes.alias("boxes"))


def drop_empty_samples(samples: DataFrame) -> DataFrame:
    return samples.filter(F.size("boxes") > 0)
