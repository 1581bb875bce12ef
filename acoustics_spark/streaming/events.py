"""Detections that keep arriving: ingest, merging, window counts and deduplicated calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.names import local_path
from ..sources import sinks


def ingest(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends new parquet files of detections to a table of one folder a day, each file once."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("day", F.to_date("start_ts"))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("day")
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_recordings(spark: SparkSession, folder: str, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Detections of recordings that keep arriving below folder, each recording once, in a folder for each of theirs.

    ``detect`` makes detections of a listing(path, length); see ``jobs.characterise.detections``. A batch of new
    recordings is written below ``batch=<its id>``, which a batch that is run again overwrites: what a failure leaves is
    the same as without it.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true")
    listing = reader.load(folder).select(local_path(F.col("path")).alias("path"), "length")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(detect(batch), batch_id, out, folder)

    writer = listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batch(found: DataFrame, batch_id: int, out: str, root: str) -> None:
    """The detections of one batch, in place of what an earlier run of the same batch has written."""
    sinks.write_detections_by_recording(found, f"{out}/batch={batch_id}", root)


def merge_stream(rows: DataFrame, delay: str, tolerance: float = 0.0) -> DataFrame:
    """rows(audio_path, start_ts, duration, low_freq, high_freq, confidence) merged as they overlap or touch, by sessions
    whose gap is each row's length plus tolerance. Zero gaps would be lost, so a row lasts a microsecond at least. Rows
    later than the watermark are dropped."""
    gap = F.concat(F.greatest(F.floor((F.col("duration") + tolerance) * 1e6), F.lit(1)).cast("long").cast("string"), F.lit(" microseconds"))
    own = F.session_window("start_ts", gap)
    out = rows.withWatermark("start_ts", delay).groupBy("audio_path", own.alias("w")).agg(
        F.min("low_freq").alias("low_freq"), F.max("high_freq").alias("high_freq"), F.max("confidence").alias("confidence"), F.count("*").alias("n")
    )
    end = F.col("w.end") - F.make_dt_interval(secs=F.lit(tolerance).cast("decimal(18,6)"))
    return out.select("audio_path", F.col("w.start").alias("start_ts"), end.alias("end_ts"), "low_freq", "high_freq", "confidence", "n")


def window_counts(rows: DataFrame, delay: str, window: str = "3 seconds", hop: str = "1 second") -> DataFrame:
    """Detections and highest confidence in sliding windows of each recording."""
    out = rows.withWatermark("start_ts", delay).groupBy("audio_path", F.window("start_ts", window, hop).alias("w"))
    return out.agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")).select("audio_path", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "confidence")


class AnchoredDedupe(StatefulProcessor):
    """Calls wait in a list until the watermark has passed them, as none before them can come any more; then they go, in
    the order of time, to the one group that is open: its anchor's time and its best call so far. A call beyond the
    anchor's window closes it, and so does the watermark once it has passed that window."""

    def __init__(self, window_seconds: float):
        self.window = window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, dom double")
        self.group = handle.getValueState("group", "anchor double, t double, dom double")

    @staticmethod
    def _after(t: float) -> int:
        """The first millisecond after a time."""
        return int(t * 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(rows)
        calls = calls[calls["dom"] > 0]
        if len(calls):
            self.waiting.appendList(list(zip(calls["t"].astype(float), calls["dom"].astype(float))))
            for at in {self._after(t) for t in calls["t"]}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, later = [x for x in held if self._after(x[0]) <= now], [x for x in held if self._after(x[0]) > now]
        group, done = self.group.get() if self.group.exists() else None, []
        for t, dom in sorted(due, key=lambda x: (x[0], -x[1])):
            if group is None or t - group[0] >= self.window:
                done += [group] if group else []
                group = (t, t, dom)
                self.handle.registerTimer(self._after(t + self.window))
            elif dom > group[2]:
                group = (group[0], t, dom)
        if group and self._after(group[0] + self.window) <= now:
            done.append(group)
            group = None
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        self.group.update(tuple(group)) if group else self.group.clear()
        if done:
            yield pd.DataFrame({"audio_path": [key[0]] * len(done), "detection_index": [key[1]] * len(done), "t": [g[1] for g in done], "dom": [g[2] for g in done]})

    def close(self) -> None:
        pass


def dedupe_stream(rows: DataFrame, delay: str, window_seconds: float) -> DataFrame:
    """rows(audio_path, detection_index, ts, t, dom) -> kept calls (audio_path, detection_index, t, dom) by the anchor rule
    of the batch operator, whatever the order in which calls come within the watermark; later ones are dropped. Needs the
    RocksDB state store."""
    keyed = rows.withWatermark("ts", delay).groupBy("audio_path", "detection_index")
    return keyed.transformWithStateInPandas(AnchoredDedupe(window_seconds), "audio_path string, detection_index long, t double, dom double", "append", "eventTime")
