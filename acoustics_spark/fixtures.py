"""The driver's tables in the roles of timelines, annotations, detections, names, signals and recordings, with the same
expressions as SQL. Times are multiples of 1/8 or 1/64 where sums are taken, so results don't hang on the order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sources import sinks
from .store import shared_folder

SAMPLERATE = 24000.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def entries(spark, sf_dir) -> DataFrame:
    audio = F.col("role") == "assistant"
    name = F.when(audio, F.concat(F.lit("rec_"), "turn", F.lit(".wav"))).otherwise(F.concat(F.lit("spacer_"), "role"))
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("metafile"), F.col("turn").alias("pos"), name.alias("entry_name"), audio.alias("is_audio"),
        F.when(audio, F.length("text") / 64.0).otherwise(5.125).alias("duration"),
    )


ENTRIES = """entries AS (
  SELECT conv_id AS metafile, turn AS pos, role = 'assistant' AS is_audio,
         CASE WHEN role = 'assistant' THEN concat('rec_', turn, '.wav') ELSE concat('spacer_', role) END AS entry_name,
         CASE WHEN role = 'assistant' THEN length(text) / 64.0 ELSE 5.125 END::DOUBLE AS duration FROM conversations)"""
SEGMENTS = (
    ENTRIES
    + """, segments AS (
  SELECT *, coalesce(sum(duration) OVER (PARTITION BY metafile ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
         sum(duration) OVER (PARTITION BY metafile ORDER BY pos) AS e FROM entries)"""
)


def annotations(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id")).first()[0] or 1
    left, bottom = F.floor(F.col("value") * 8) / 8, 2000.0 + (F.col("event_id") % 50) * 100
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % F.lit(n)).alias("metafile"), (F.col("event_id") % 2).alias("channel"),
        left.alias("left"), (left + (1 + F.col("event_id") % 16) / 8.0).alias("right"),
        bottom.alias("bottom"), (bottom + 1000 + (F.col("event_id") % 7) * 125).alias("top"),
    )


ANNOTATIONS = """annotations AS (
  SELECT event_id AS id, user_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS metafile, event_id % 2 AS channel,
         floor(value * 8) / 8 AS l, floor(value * 8) / 8 + (1 + event_id % 16) / 8.0::DOUBLE AS r,
         2000.0::DOUBLE + (event_id % 50) * 100 AS bottom, 2000.0::DOUBLE + (event_id % 50) * 100 + 1000 + (event_id % 7) * 125 AS top FROM events)"""


def anchors(spark, sf_dir) -> DataFrame:
    """Annotations as anchors of windows in recordings of 60 s."""
    return annotations(spark, sf_dir).withColumns({"path": F.col("metafile"), "audio_duration": F.lit(60.0), "samplerate": F.lit(24000)})


def detections(spark, sf_dir) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    events = read(spark, sf_dir, "events").withColumn("start_time", micros / 1e6)
    events = events.withColumn("end_time", F.col("start_time") + F.col("value") * 600)
    index, bottom = F.floor(F.col("start_time") / 3600), 2000.0 + (F.col("event_id") % 50) * 100
    return events.select(
        F.concat(F.lit("rec_"), "user_id").alias("audio_path"), index.alias("window_index"), (index * 3600.0).alias("window_start"), (index * 3600.0 + 3600).alias("window_end"),
        F.col("event_id").alias("detection_index"), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"),
        bottom.alias("low_freq"), (bottom + 1000 + (F.col("event_id") % 7) * 125).alias("high_freq"), ((F.col("event_id") * 37 % 100) / 100.0).alias("confidence"),
    )


DETECTIONS = """times AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS start_time, epoch_us(ts) / 1e6::DOUBLE + value * 600 AS end_time FROM events),
detections AS (
  SELECT concat('rec_', user_id) AS audio_path, CAST(floor(start_time / 3600) AS BIGINT) AS window_index,
         floor(start_time / 3600) * 3600 AS window_start, floor(start_time / 3600) * 3600 + 3600 AS window_end, event_id AS detection_index,
         start_time, end_time, end_time - start_time AS duration, 2000.0::DOUBLE + (event_id % 50) * 100 AS low_freq,
         2000.0::DOUBLE + (event_id % 50) * 100 + 1000 + (event_id % 7) * 125 AS high_freq, (event_id * 37 % 100) / 100.0::DOUBLE AS confidence
  FROM times)"""
ISLANDS = (
    DETECTIONS
    + """, flagged AS (
  SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY audio_path ORDER BY start_time, window_index, detection_index
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM detections WHERE end_time >= start_time),
islands AS (SELECT *, sum(new) OVER (PARTITION BY audio_path ORDER BY start_time, window_index, detection_index) AS island FROM flagged),
merged AS (
  SELECT audio_path, CAST(island AS BIGINT) AS island, min(window_index) AS window_index, min(window_start) AS window_start, max(window_end) AS window_end,
         arg_min(detection_index, start_time) AS first_index, min(start_time) AS start_time, max(end_time) AS end_time,
         greatest(0.0::DOUBLE, max(end_time) - min(start_time)) AS duration, min(low_freq) AS low_freq, max(high_freq) AS high_freq, max(confidence) AS confidence
  FROM islands GROUP BY audio_path, island)"""
)


def signatures(spark, sf_dir) -> DataFrame:
    """Names with the first part that has them."""
    part = read(spark, sf_dir, "part")
    odd = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sig_"), F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("sig-"), F.element_at(F.split("p_name", " "), 2)))
    rows = part.groupBy(F.col("p_brand").alias("folder"), odd.alias("name")).agg(F.min("p_partkey").alias("seq"))
    return rows.withColumns({"meta": F.lit("m"), "log": F.lit("log")})


def comments(spark, sf_dir) -> DataFrame:
    comment = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("folder"), F.lit("m").alias("meta"), comment.alias("comment"))


NAMES = """sigs AS (
  SELECT p_brand AS folder, CASE WHEN p_partkey % 2 = 0 THEN concat('sig_', replace(p_name, ' ', '_')) ELSE concat('sig-', split_part(p_name, ' ', 2)) END AS name,
         min(p_partkey) AS seq FROM part GROUP BY ALL),
tokens AS (
  SELECT folder, name, seq, k, token FROM (
    SELECT folder, name, seq, unnest([1, 2, 3, 4, 5]) AS k,
           unnest([lower(name), replace(lower(name), '-', '_'), replace(replace(lower(name), '-', '_'), '_', ' '),
                   substr(replace(lower(name), '-', '_'), 5), replace(substr(replace(lower(name), '-', '_'), 5), '_', ' ')]) AS token FROM sigs)),
comments AS (SELECT p_partkey AS id, p_brand AS folder, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS comment FROM part)"""


def signals(spark, sf_dir) -> DataFrame:
    """Embeddings as the slices of one detection for each label."""
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label_"), "label").alias("audio_path"), F.col("label").cast("long").alias("detection_index"), (F.row_number().over(order) - 1).alias("slice_idx"),
        ((F.row_number().over(order) - 1) * 0.015625).alias("slice_start"), F.lit(0.0).alias("window_start"), F.col("embedding").cast("array<double>").alias("samples"),
    )


SIGNALS = """sig AS (
  SELECT concat('label_', label) AS audio_path, label::BIGINT AS detection_index, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slice_idx, embedding FROM embeddings),
x AS (SELECT audio_path, detection_index, slice_idx, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS v FROM sig),
bins AS (SELECT unnest(range(11, 33)) AS k),
spec AS (
  SELECT audio_path, detection_index, slice_idx, k, k * 375.0::DOUBLE AS freq,
         pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * cos(2 * pi() * k * n / 64)), 2) + pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * sin(2 * pi() * k * n / 64)), 2) AS power
  FROM x, bins GROUP BY ALL),
feat AS (
  SELECT audio_path, detection_index, slice_idx, greatest(quantile_cont(power, 0.1), 1e-12) AS power_floor, arg_max(freq, power) AS dom_freq, arg_max(k, power) AS peak, max(power) AS dom_power
  FROM spec GROUP BY ALL),
soft AS (SELECT detection_index, slice_idx, k, sum(power) OVER (PARTITION BY detection_index, slice_idx ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS soft FROM spec),
walk AS (
  SELECT f.detection_index, f.slice_idx, dir, d, s.k, soft, soft <= power_floor * 1.12 AND lag(soft) OVER (PARTITION BY f.detection_index, f.slice_idx, dir ORDER BY d) <= power_floor * 1.12 AS met
  FROM (SELECT *, unnest([1, 2, 3]) AS d FROM (SELECT *, unnest([-1, 1]) AS dir FROM feat)) f JOIN soft s ON s.detection_index = f.detection_index AND s.slice_idx = f.slice_idx AND s.k = f.peak + dir * d),
ends AS (SELECT detection_index, slice_idx, dir, coalesce(arg_min(k - dir, d) FILTER (met), arg_min(k, struct_pack(soft := soft, d := d))) AS k FROM walk GROUP BY ALL),
crossings AS (
  SELECT f.detection_index, f.slice_idx, 375.0::DOUBLE * coalesce(a.k, peak) AS left_freq, 375.0::DOUBLE * coalesce(b.k, peak) AS right_freq FROM feat f
  LEFT JOIN ends a ON a.detection_index = f.detection_index AND a.slice_idx = f.slice_idx AND a.dir = -1
  LEFT JOIN ends b ON b.detection_index = f.detection_index AND b.slice_idx = f.slice_idx AND b.dir = 1),
labelled AS (
  SELECT *, CASE WHEN dom_freq >= 6000 AND (max(dom_power) OVER w <= 0 OR dom_power >= 0.05 * max(dom_power) OVER w) THEN 'Trill' ELSE 'Silence' END AS classification
  FROM feat WINDOW w AS (PARTITION BY audio_path, detection_index))"""


def recordings(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("rec_"), "o_orderkey").alias("path"), (F.floor(F.col("o_totalprice") / 1000) / 8.0).alias("duration"))


RECORDINGS = "recordings AS (SELECT concat('rec_', o_orderkey) AS path, floor(o_totalprice / 1000) / 8.0::DOUBLE AS duration FROM orders)"


def deployment(spark, sf_dir, rate: int = 64) -> str:
    """The conversations' timelines as files in the shared folder, and its path: a folder each with recordings, whose names all
    folders have, the metafile, and the log of its annotations. A recording has a sample a letter of its text."""
    root = f"{shared_folder(spark)}/deployment-{uuid.uuid4().hex}"
    folder = lambda key: F.concat(F.lit("conv "), F.col(key), F.lit("/"))
    text = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    wave = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: ((i * 7 + F.col("turn")) % 101 - 50) * 100 / 32767.0)
    clips = text.select(F.concat(folder("conv_id"), F.lit("rec_"), "turn", F.lit(".wav")).alias("name"), wave.alias("samples"), F.lit(rate).alias("samplerate"))
    sinks.write_files(sinks.clip_files(clips), root)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry_name"))), lambda x: x["entry_name"]), "\n")
    metas = entries(spark, sf_dir).groupBy("metafile").agg(F.concat(F.lit("annotationfile=the log\n"), names).alias("content"))
    sinks.write_files(metas.select(F.concat(folder("metafile"), F.lit("conv metafile.txt")).alias("path"), "content"), root)
    line = F.concat_ws("\t", F.lit("an:"), F.lit("s"), "channel", "left", "right", "top", "bottom", F.concat(F.lit("c"), F.col("id")), F.lit(""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n")
    logs = annotations(spark, sf_dir).groupBy("metafile").agg(F.concat(F.lit("tag\tsource\tchannel\tleft\tright\ttop\tbottom\tcomment\tnotes\n"), lines).alias("content"))
    sinks.write_files(logs.select(F.concat(folder("metafile"), F.lit("the log")).alias("path"), "content"), root)
    return root
