"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import fixtures as fx
from .functions import boxes, names, signal
from .jobs import remap
from .operators import detect, intervals, matching, slices, splits, timeline, variants, windows
from .schemas import DETECTION_COLUMNS
from .sources import files, recordings, sinks
from .store import shared_folder
from .streaming import events as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def micro(c: str) -> F.Column:
    """A double rounded to six decimals, for values that two engines sum in different orders."""
    return F.round(c, 6).alias(c)


# Intervals


@query(f"WITH {fx.ISLANDS} SELECT * EXCLUDE (first_index), first_index AS detection_index FROM merged")
def merge_overlapping(spark, d) -> DataFrame:
    return intervals.merge_overlapping(fx.detections(spark, d))


@query(f"WITH {fx.ISLANDS} SELECT * EXCLUDE (first_index), first_index AS detection_index FROM merged")
def merge_overlapping_in_buckets(spark, d) -> DataFrame:
    return intervals.premerge(fx.detections(spark, d), 86400.0)


@query(f"WITH {fx.ISLANDS} SELECT audio_path, start_time, end_time, row_number() OVER (PARTITION BY audio_path ORDER BY start_time, first_index) AS detection_index FROM merged")
def renumber_detections(spark, d) -> DataFrame:
    return intervals.renumber_detections(intervals.merge_overlapping(fx.detections(spark, d))).select("audio_path", "start_time", "end_time", F.col("detection_index").cast("long"))


@query(f"WITH {fx.DETECTIONS} SELECT * FROM detections WHERE duration BETWEEN 1000 AND 5000")
def filter_duration(spark, d) -> DataFrame:
    return intervals.filter_duration(fx.detections(spark, d), 1000.0, 5000.0)


@query(f"WITH {fx.DETECTIONS} SELECT * FROM detections WHERE confidence >= 0.25")
def filter_confidence(spark, d) -> DataFrame:
    return intervals.filter_confidence(fx.detections(spark, d), 0.25)


@query(f"""WITH {fx.DETECTIONS} SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY audio_path, window_index ORDER BY confidence DESC, detection_index) AS rn FROM detections) WHERE rn <= 2""")
def top_k_per_window(spark, d) -> DataFrame:
    return intervals.top_k_per_window(fx.detections(spark, d), 2)


@query(f"""WITH {fx.ISLANDS}, r AS (SELECT audio_path, count(*) AS n_raw FROM detections GROUP BY ALL), m AS (SELECT audio_path, count(*) AS n_merged FROM merged GROUP BY ALL)
SELECT audio_path, n_raw, n_merged, 0 AS is_total FROM r JOIN m USING (audio_path)
UNION ALL SELECT NULL, CAST(sum(n_raw) AS BIGINT), CAST(sum(n_merged) AS BIGINT), 1 FROM r JOIN m USING (audio_path)""")
def detection_counts(spark, d) -> DataFrame:
    raw = fx.detections(spark, d)
    return intervals.detection_counts(raw, intervals.merge_overlapping(raw))


@query(f"""WITH {fx.ISLANDS.replace("FROM detections WHERE end_time", "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audio_path, window_index ORDER BY confidence DESC, detection_index) AS rn FROM detections WHERE confidence >= 0.25) WHERE rn <= 2) WHERE end_time")}
SELECT audio_path, count(*) AS n_merged, max(duration) AS longest, max(confidence) AS confidence FROM merged GROUP BY audio_path""")
def flagship(spark, d) -> DataFrame:
    """Score filter, best two of each window, merged, counted by recording."""
    found = intervals.top_k_per_window(intervals.filter_confidence(fx.detections(spark, d), 0.25), 2)
    merged = intervals.merge_overlapping(found)
    return merged.groupBy("audio_path").agg(F.count("*").alias("n_merged"), F.max("duration").alias("longest"), F.max("confidence").alias("confidence"))


# Timelines


@query(f"WITH {fx.SEGMENTS} SELECT metafile, pos, entry_name, is_audio, duration, s::DOUBLE AS start, e::DOUBLE AS \"end\" FROM segments")
def build_timeline(spark, d) -> DataFrame:
    return timeline.build_timeline(fx.entries(spark, d))


@query(f"""WITH {fx.SEGMENTS} SELECT metafile, max(e)::DOUBLE AS length, count(*) AS n_entries, count(*) FILTER (is_audio) AS n_audio,
  count(*) FILTER (NOT is_audio) AS n_spacer FROM segments GROUP BY metafile""")
def timeline_summary(spark, d) -> DataFrame:
    return timeline.timeline_summary(timeline.build_timeline(fx.entries(spark, d)))


@query(f"WITH {fx.ENTRIES} SELECT metafile, pos, is_audio, CASE WHEN is_audio THEN NULL WHEN metafile % 3 = 0 THEN 7.5 ELSE 55.125 END::DOUBLE AS duration FROM entries")
def entry_durations(spark, d) -> DataFrame:
    rows = fx.entries(spark, d)
    overrides = rows.select("metafile").distinct().filter("metafile % 3 = 0").withColumn("spacer", F.lit(7.5))
    return timeline.with_durations(rows.select("metafile", "pos", "entry_name"), overrides=overrides).select("metafile", "pos", "is_audio", "duration")


@query(f"""WITH {fx.SEGMENTS}, {fx.ANNOTATIONS}, hits AS (
  SELECT a.id, arg_min(struct_pack(pos := pos, s := s, e := e, dur := duration), pos) AS seg FROM annotations a JOIN segments g
  ON a.metafile = g.metafile AND is_audio AND l BETWEEN s - 0.001 AND e + 0.001 GROUP BY a.id)
SELECT a.id, seg.pos AS pos, CASE WHEN seg IS NOT NULL THEN least(greatest(l - seg.s, 0), seg.dur)::DOUBLE END AS left_rel, CASE WHEN seg IS NOT NULL THEN least(greatest(r - seg.s, 0), seg.dur)::DOUBLE END AS right_rel,
  CASE WHEN seg IS NULL THEN 'unmatched' WHEN r > seg.e + 0.001 THEN 'past_end' ELSE 'ok' END AS status,
  CASE WHEN seg IS NULL THEN coalesce((SELECT 'starts in ' || arg_min(entry_name, pos) FROM segments g WHERE g.metafile = a.metafile AND l BETWEEN g.s AND g.e), 'starts outside the timeline') END AS reason FROM annotations a LEFT JOIN hits USING (id)""")
def map_to_segments(spark, d) -> DataFrame:
    segments = timeline.build_timeline(fx.entries(spark, d))
    return timeline.map_to_segments(fx.annotations(spark, d), segments).select("id", "pos", "left_rel", "right_rel", "status", "reason")


@query(f"""WITH {fx.ENTRIES}, named AS (SELECT *, CASE WHEN is_audio THEN entry_name ELSE concat(entry_name, CASE WHEN metafile % 2 = 0 THEN '.WAV' ELSE '' END) END AS name FROM entries),
own AS (SELECT name, max(pos) / 4.0::DOUBLE AS own FROM named WHERE name NOT LIKE '%_7.wav' GROUP BY name)
SELECT metafile, pos, CASE WHEN is_audio OR name LIKE '%.WAV' THEN CASE WHEN is_audio THEN own ELSE coalesce(own, CASE WHEN metafile % 3 = 0 THEN 7.5 ELSE 55.125 END) END
  ELSE CASE WHEN metafile % 3 = 0 THEN 7.5 ELSE 55.125 END END::DOUBLE AS duration FROM named LEFT JOIN own USING (name)""")
def spacer_durations(spark, d) -> DataFrame:
    """Spacers that are recordings last as long as these do, before any override."""
    end = F.when(~F.col("is_audio") & (F.col("metafile") % 2 == 0), ".WAV").otherwise("")
    rows = fx.entries(spark, d).withColumn("entry_name", F.concat("entry_name", end))
    own = rows.filter("entry_name NOT LIKE '%_7.wav'").groupBy("entry_name").agg((F.max("pos") / 4.0).alias("duration"))
    overrides = rows.select("metafile").distinct().filter("metafile % 3 = 0").withColumn("spacer", F.lit(7.5))
    return timeline.with_durations(rows.select("metafile", "pos", "entry_name"), own, overrides, spacer_recordings=True).select("metafile", "pos", "duration")


# Texts of the file formats


def _metafiles(spark, d) -> DataFrame:
    """Every fifth one is empty, every fifth lacks its first line."""
    key, head = F.col("p_partkey"), F.concat(F.lit("\r\n AnnotationFile= "), "p_brand", F.lit("\r\n"))
    body = F.concat(F.lit(" "), "p_name", F.lit(".wav \n\n spacer\r"), "p_type", F.lit(".wav"))
    text = F.when(key % 5 == 0, " \n").when(key % 5 == 1, body).otherwise(F.concat(head, body))
    return fx.read(spark, d, "part").select(key.alias("metafile"), text.alias("text"))


@query("""SELECT p_partkey AS metafile, p_brand AS log_ref, unnest([0, 1, 2]) AS pos, unnest([concat(p_name, '.wav'), 'spacer', concat(p_type, '.wav')]) AS entry_name FROM part WHERE p_partkey % 5 > 1""")
def parse_metafiles(spark, d) -> DataFrame:
    return files.parse_metafiles(_metafiles(spark, d))[0]


@query("SELECT p_partkey AS metafile, CASE WHEN p_partkey % 5 = 0 THEN 'empty' ELSE 'no annotationfile line' END AS reason FROM part WHERE p_partkey % 5 < 2")
def rejected_metafiles(spark, d) -> DataFrame:
    return files.parse_metafiles(_metafiles(spark, d))[1]


TYPED = "t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE concat(' ', p_size, '.5 ') END AS seconds, CASE p_partkey % 6 WHEN 0 THEN '1.5.0' ELSE concat(p_size, ' ') END AS channel FROM part)"


def _typed(spark, d) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    seconds = F.when(key % 4 == 0, "x").when(key % 4 > 1, F.concat(F.lit(" "), "p_size", F.lit(".5 ")))
    channel = F.when(key % 6 == 0, "1.5.0").otherwise(F.concat("p_size", F.lit(" ")))
    return files.typed(fx.read(spark, d, "part").select("p_partkey", seconds.alias("seconds"), channel.alias("channel")), ["seconds"], ["channel"])


@query(f"WITH {TYPED} SELECT p_partkey, TRY_CAST(trim(seconds) AS DOUBLE) AS seconds, TRY_CAST(trim(channel) AS INTEGER) AS channel FROM t WHERE TRY_CAST(trim(seconds) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(channel) AS INTEGER) IS NOT NULL")
def typed_rows(spark, d) -> DataFrame:
    return _typed(spark, d)[0]


@query(f"WITH {TYPED} SELECT * FROM t WHERE TRY_CAST(trim(seconds) AS DOUBLE) IS NULL OR TRY_CAST(trim(channel) AS INTEGER) IS NULL")
def rejected_rows(spark, d) -> DataFrame:
    return _typed(spark, d)[1]


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(p_brand, '=-', p_size) WHEN 2 THEN concat(' = ', p_size) WHEN 3 THEN concat(p_brand, '=', p_name) ELSE concat(' ', p_brand, ' = ', p_size) END AS text FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN lower(trim(split_part(text, '=', 1))) END AS name, CASE WHEN p_partkey % 5 = 4 THEN TRY_CAST(trim(split_part(text, '=', 2)) AS DOUBLE) END AS seconds FROM t""")
def parse_override(spark, d) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(key % 5 == 0, F.col("p_name")).when(key % 5 == 1, F.concat("p_brand", F.lit("=-"), size)).when(key % 5 == 2, F.concat(F.lit(" = "), size))
    text = text.when(key % 5 == 3, F.concat("p_brand", F.lit("="), "p_name")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" = "), size))
    return fx.read(spark, d, "part").select("p_partkey", names.parse_override(text).alias("o")).select("p_partkey", "o.name", "o.seconds")


@query(f"""WITH {fx.ANNOTATIONS} SELECT concat('F', metafile) AS "FolderName", 'm' AS "MetafileName", 'l' AS "AnnotationFileName", concat('n', id) AS "AnnotationName", concat('/a/', id, '.wav') AS "AudioPath", concat(id, '.wav') AS soundfile,
  channel, printf('%.6f', l) AS lefttimesec, printf('%.6f', r) AS righttimesec, printf('%.6f', top) AS topfreqhz, printf('%.6f', bottom) AS bottomfreqhz, 'c' AS comment, CAST(NULL AS VARCHAR) AS notes FROM annotations""")
def annotation_lines(spark, d) -> DataFrame:
    text = lambda head, c, tail="": F.concat(F.lit(head), F.col(c).cast("string"), F.lit(tail))
    rows = fx.annotations(spark, d).select(
        text("F", "metafile").alias("FolderName"), F.lit("m").alias("MetafileName"), F.lit("l").alias("AnnotationFileName"), text("n", "id").alias("AnnotationName"), text("/a/", "id", ".wav").alias("AudioPath"), text("", "id", ".wav").alias("soundfile"),
        "channel", F.col("left").alias("lefttimesec"), F.col("right").alias("righttimesec"), F.col("top").alias("topfreqhz"), F.col("bottom").alias("bottomfreqhz"), F.lit("c").alias("comment"), F.lit(None).cast("string").alias("notes"),
    )
    return sinks.annotation_lines(rows)


@query(f"""WITH {fx.ANNOTATIONS} SELECT id, concat('rec_', metafile, '_det', printf('%04d', id), '_start', printf('%07.2f', floor(l)), 's_end', printf('%07.2f', floor(r * 4) / 4), 's_conf', printf('%.2f', (id * 37 % 100) / 100.0::DOUBLE)) AS name FROM annotations""")
def detection_name(spark, d) -> DataFrame:
    rows = fx.annotations(spark, d)
    name = names.detection_name(F.concat(F.lit("rec #"), F.col("metafile")), F.col("id"), F.floor("left").cast("double"), F.floor(F.col("right") * 4) / 4, F.col("id") * 37 % 100 / 100.0)
    return rows.select("id", name.alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN replace(p_brand, '#', '_') ELSE concat(replace(p_brand, '#', '_'), '__', replace(p_type, ' ', '_')) END AS folder, replace(p_name, ' ', '_') AS recording FROM part""")
def by_recording(spark, d) -> DataFrame:
    """Where a recording's detections are written: folders are mirrored, so recordings of one name don't meet."""
    key = F.col("p_partkey")
    below = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat("p_brand", F.lit("/"))).otherwise(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/")))
    rows = fx.read(spark, d, "part").select("p_partkey", F.concat(F.lit("/in/"), below, "p_name", F.lit(".wav")).alias("audio_path"))
    columns = [F.lit(0).alias(c) for c in DETECTION_COLUMNS if c not in ("audio_path", "detection_index")]
    return sinks.by_recording(rows.select("audio_path", key.alias("detection_index"), *columns), "/in").select(F.col("detection_index").alias("p_partkey"), "folder", "recording")


# Names


@query(f"WITH {fx.NAMES} SELECT folder, token, CAST(count(DISTINCT name) AS INTEGER) AS n_names, arg_min(name, seq * 10 + k) AS first_name FROM tokens WHERE token <> '' GROUP BY ALL")
def build_token_table(spark, d) -> DataFrame:
    t = matching.build_token_table(fx.signatures(spark, d))
    return t.select("folder", "token", F.size("names").alias("n_names"), F.element_at("names", 1).alias("first_name"))


@query(f"""WITH {fx.NAMES}, pairs AS (
  SELECT c.id, c.comment, t.name, t.seq, t.k, t.token FROM comments c JOIN tokens t ON c.folder = t.folder
  WHERE contains(lower(comment), token) OR contains(replace(lower(comment), '-', '_'), token) OR contains(replace(lower(comment), '_', ' '), token) OR contains(replace(lower(comment), ' ', '_'), token))
SELECT id, comment, name AS annotation_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(token) DESC, seq, k) AS rn FROM pairs) WHERE rn = 1""")
def match_names(spark, d) -> DataFrame:
    rows = fx.comments(spark, d)
    return matching.match_names(rows, matching.build_token_table(fx.signatures(spark, d))).select("id", "comment", "annotation_name")


@query("SELECT p_brand AS folder, count(DISTINCT p_type) AS n_logs FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def signature_conflicts(spark, d) -> DataFrame:
    rows = fx.read(spark, d, "part").select(F.col("p_brand").alias("folder"), F.lit("m").alias("meta"), F.col("p_type").alias("log"))
    return matching.signature_conflicts(rows).drop("meta")


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)")
def allowed_folders(spark, d) -> DataFrame:
    part = fx.read(spark, d, "part").withColumn("folder", F.col("p_brand"))
    return matching.allowed_folders(part, part.filter("p_size > 49")).select("p_partkey")


CATALOG = r"""catalog AS (
  SELECT concat('/data/', p_brand, '/', replace(p_type, ' ', '_'), '/', replace(p_name, ' ', '_'), '.wav') AS path FROM part UNION SELECT concat('/data/', p_brand, '/', p_size, '/take.wav') FROM part),
wanted AS (SELECT *, CASE kind WHEN 2 THEN concat('old/', name) WHEN 3 THEN 'take.wav' WHEN 4 THEN 'take.wav' WHEN 5 THEN concat(p_size, '/take.wav') ELSE name END AS soundfile,
    CASE kind WHEN 0 THEN concat(brand, '/', type) WHEN 1 THEN brand WHEN 2 THEN brand WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN concat(brand, '/none') ELSE '' END AS folder,
    CASE kind WHEN 1 THEN concat(type, '/../', type, '/./', name) WHEN 6 THEN concat('/old/', name) WHEN 2 THEN concat(brand, '/gone/', name) WHEN 7 THEN concat('gone/', name) END AS audio_path
  FROM (SELECT p_partkey AS id, p_partkey % 8 AS kind, p_size, p_brand AS brand, replace(p_type, ' ', '_') AS type,
        concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 25 = 0 THEN '.flac' ELSE '.wav' END) AS name FROM part))"""


def _catalog(spark, d) -> DataFrame:
    """Files below brands and types, and one name that every brand and size has."""
    part, spaced = fx.read(spark, d, "part"), lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    own = part.select(F.concat(F.lit("/data/"), "p_brand", F.lit("/"), spaced("p_type"), F.lit("/"), spaced("p_name"), F.lit(".wav")).alias("path"))
    return own.union(part.select(F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_size", F.lit("/take.wav")))).distinct()


def _wanted(spark, d) -> DataFrame:
    """Annotations whose recordings are in place, elsewhere below a hinted folder, of a hot name, or nowhere."""
    spaced, kind = lambda c: F.replace(c, F.lit(" "), F.lit("_")), F.col("p_partkey") % 8
    brand, kinds, size = F.col("p_brand"), spaced("p_type"), F.col("p_size").cast("string")
    name = F.concat(spaced("p_name"), F.when(F.col("p_partkey") % 25 == 0, ".flac").otherwise(".wav"))
    sound = F.when(kind == 2, F.concat(F.lit("old/"), name)).when(kind.isin(3, 4), "take.wav").when(kind == 5, F.concat(size, F.lit("/take.wav"))).otherwise(name)
    folder = F.when(kind == 0, F.concat_ws("/", brand, kinds)).when(kind.isin(1, 2), brand).when(kind == 3, size).when(kind == 4, F.concat(brand, F.lit("/none"))).otherwise("")
    audio = F.when(kind == 1, F.concat(kinds, F.lit("/../"), kinds, F.lit("/./"), name)).when(kind == 6, F.concat(F.lit("/old/"), name))
    audio = audio.when(kind == 2, F.concat(brand, F.lit("/gone/"), name)).when(kind == 7, F.concat(F.lit("gone/"), name))
    return fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", folder.alias("folder"), audio.alias("audio_path"), sound.alias("soundfile"))


RESOLVED = rf"""{CATALOG},
exact AS (SELECT id, path FROM wanted JOIN catalog ON path = CASE kind WHEN 0 THEN concat('/data/', folder, '/', soundfile) WHEN 1 THEN concat('/data/', folder, '/', type, '/', name) ELSE concat('/data/', soundfile) END),
asked AS (SELECT *, regexp_extract(coalesce(audio_path, soundfile), '[^/]*$') AS base,
    list_filter(string_split(folder, '/') || CASE WHEN audio_path NOT LIKE '/%' THEN string_split(regexp_replace(audio_path, '/[^/]*$', ''), '/') ELSE [] END, lambda x: x <> '') AS parts FROM wanted WHERE id NOT IN (SELECT id FROM exact)),
met AS (SELECT id, path, len(parts) > 0 AND list_has_all(string_split(path, '/'), parts) AS hinted, ends_with(path, soundfile) AS fits FROM asked JOIN catalog ON regexp_extract(path, '[^/]*$') = base),
left_ AS (SELECT * FROM met QUALIFY hinted OR NOT bool_or(hinted) OVER (PARTITION BY id)),
near AS (SELECT id, CASE WHEN count(*) > 1 AND count(*) FILTER (fits) = 1 THEN min(path) FILTER (fits) ELSE min(path) END AS path, count(*) > 1 AND count(*) FILTER (fits) <> 1 AS ambiguous FROM left_ GROUP BY id)"""


@query(f"WITH {RESOLVED} SELECT id, coalesce(e.path, n.path) AS path, CASE WHEN e.path IS NOT NULL THEN false ELSE ambiguous END AS ambiguous FROM wanted LEFT JOIN exact e USING (id) LEFT JOIN near n USING (id)")
def resolve_audio(spark, d) -> DataFrame:
    return matching.resolve_audio(_wanted(spark, d), _catalog(spark, d), "/data").select("id", "path", "ambiguous")


@query(f"""WITH {CATALOG}, base AS (SELECT regexp_extract(path, '[^/]*$') AS b, count(*) AS n, min(path) AS p FROM catalog GROUP BY b),
e AS (SELECT id, kind, concat('/data/', brand, '/', type) AS place, soundfile, name FROM wanted),
x AS (SELECT id, path FROM e JOIN catalog ON path = concat(place, '/', name) WHERE kind IN (0, 1, 2, 6) UNION SELECT id, path FROM wanted JOIN catalog ON kind = 5 AND path = concat('/data/', brand, '/', soundfile))
SELECT id AS entry_id, coalesce(x.path, CASE WHEN n = 1 THEN p END) AS path, CASE WHEN x.path IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM e LEFT JOIN x USING (id) LEFT JOIN base ON b = regexp_extract(CASE WHEN kind IN (3, 4, 5) THEN soundfile ELSE name END, '[^/]*$')""")
def resolve_entries(spark, d) -> DataFrame:
    """Entries of timelines whose audio folders differ: absolute names, both slashes, parts that go up, names elsewhere."""
    part, spaced, kind = fx.read(spark, d, "part"), lambda c: F.replace(c, F.lit(" "), F.lit("_")), F.col("id") % 8
    own = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("/data/"), "p_brand").alias("brand"), spaced("p_type").alias("type"))
    rows = _wanted(spark, d).join(own, "id").withColumn("name", names.basename(F.coalesce("audio_path", "soundfile")))
    place = F.concat_ws("/", "brand", "type")
    name = F.when(kind == 0, F.col("name")).when(kind == 1, F.concat(F.lit("..\\"), "type", F.lit("\\"), "name")).when(kind == 2, F.concat_ws("/", place, F.lit("x/.."), "name"))
    name = name.when(kind == 5, F.concat(F.lit("../"), "soundfile")).when(kind == 6, F.concat(F.lit("C:\\old\\"), "name")).when(kind == 7, F.col("name")).otherwise(F.col("soundfile"))
    rows = rows.select(F.col("id").alias("entry_id"), name.alias("entry_name"), F.when(kind == 7, "/elsewhere").otherwise(place).alias("place"))
    return matching.resolve_entries(rows, _catalog(spark, d), F.col("place")).select("entry_id", "path", "status")


@query(f"WITH {RESOLVED} SELECT id, CASE WHEN folder = '' THEN soundfile ELSE concat(folder, '/', soundfile) END AS expected FROM wanted WHERE id NOT IN (SELECT id FROM exact UNION SELECT id FROM near)")
def missing_audio_report(spark, d) -> DataFrame:
    return matching.missing_audio_report(matching.resolve_audio(_wanted(spark, d), _catalog(spark, d), "/data")).select("id", "expected")


@query("""WITH p AS (SELECT p_brand AS top, concat(p_name, '-', p_partkey) AS stem, concat(p_name, '-', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.TXT' ELSE '.txt' END) AS name, p_partkey, p_size, p_type FROM part),
k AS (SELECT top AS folder, unnest(CASE p_partkey % 5 WHEN 0 THEN [stem] WHEN 1 THEN [name] WHEN 2 THEN [concat(stem, '.txt')] WHEN 3 THEN [stem, name] ELSE [] END) AS meta, p_type AS log FROM p)
SELECT stem AS metafile, k.folder, meta, log FROM p JOIN k ON k.folder = top AND meta IN (stem, name, concat(stem, '.txt'))
QUALIFY row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN meta = stem THEN 0 WHEN meta = name THEN 1 ELSE 2 END) = 1""")
def match_signature_key(spark, d) -> DataFrame:
    """Metafiles of which signatures know the stem, the whole name, the stem with .txt, two of these, or nothing."""
    key, stem = F.col("p_partkey"), F.concat_ws("-", "p_name", "p_partkey")
    rows = fx.read(spark, d, "part").select(
        F.col("p_brand").alias("top"), stem.alias("stem"), stem.alias("metafile"), F.concat(stem, F.when(F.col("p_size") % 2 == 0, ".TXT").otherwise(".txt")).alias("name"), key.alias("seq"), F.col("p_type").alias("log")
    )
    own = F.when(key % 5 == 0, F.array("stem")).when(key % 5 == 1, F.array("name")).when(key % 5 == 2, F.array(F.concat("stem", F.lit(".txt")))).when(key % 5 == 3, F.array("stem", "name"))
    signatures = rows.withColumn("p_partkey", F.col("seq")).select(F.col("top").alias("folder"), "log", "seq", F.explode(own).alias("meta"))
    return matching.match_signature_key(rows.select("metafile", "top", "name", "stem"), signatures)


@query("""WITH m AS (SELECT DISTINCT p_brand AS folder, p_name AS log_ref FROM part), c AS (SELECT DISTINCT concat(p_brand, '/', p_name, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.log' ELSE '.txt' END) AS path FROM part)
SELECT concat(folder, '/', log_ref) AS metafile, coalesce(a.path, b.path, t.path) AS log_path FROM m LEFT JOIN c a ON a.path = concat(folder, '/', log_ref)
LEFT JOIN c b ON b.path = concat(folder, '/', log_ref, '.log') LEFT JOIN c t ON t.path = concat(folder, '/', log_ref, '.txt')""")
def resolve_log(spark, d) -> DataFrame:
    part = fx.read(spark, d, "part")
    end = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, ".log").otherwise(".txt")
    rows = part.select(F.col("p_brand").alias("folder"), F.col("p_name").alias("log_ref")).distinct().withColumn("metafile", F.concat("folder", F.lit("/"), "log_ref"))
    return matching.resolve_log(rows, part.select(F.concat("p_brand", F.lit("/"), "p_name", end).alias("path")).distinct()).select("metafile", "log_path")


OVERRIDES = "o AS (SELECT lower(p_brand) AS name, min(p_size)::DOUBLE AS seconds FROM part GROUP BY ALL UNION ALL SELECT lower(p_type), 1.5 FROM part GROUP BY ALL)"


def _overrides(spark, d) -> DataFrame:
    part = fx.read(spark, d, "part")
    one = part.groupBy(F.lower("p_brand").alias("name")).agg(F.min("p_size").cast("double").alias("seconds"))
    return one.unionAll(part.select(F.lower("p_type").alias("name"), F.lit(1.5)).distinct())


def _overridden(spark, d) -> DataFrame:
    part = fx.read(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("metafile"), F.concat("p_name", F.lit(" metafile.txt")).alias("file"), F.concat("p_brand", F.lit("_metafile")).alias("folder"))
    return matching.match_overrides(rows, _overrides(spark, d))


@query(f"WITH {OVERRIDES} SELECT p_partkey AS metafile, name, seconds FROM part JOIN o ON name = lower(p_brand)")
def match_overrides(spark, d) -> DataFrame:
    return _overridden(spark, d)


@query(f"WITH {OVERRIDES} SELECT name, seconds FROM o WHERE name NOT IN (SELECT lower(p_brand) FROM part)")
def unused_overrides(spark, d) -> DataFrame:
    return matching.unused_overrides(_overrides(spark, d), _overridden(spark, d))


@query(r"""SELECT p_partkey, concat_ws('__', replace(p_brand, '#', '_'), replace(p_name, ' ', '_')) AS output_stem, p_brand AS top_folder,
  concat(replace(p_name, ' ', '_'), '_ann_', printf('%05d', p_partkey), '__shift2') AS sample, concat(p_name, '.wav') AS base,
  CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN concat(p_brand, '/', p_type) ELSE 'in' END AS folder_name FROM part""")
def names_and_paths(spark, d) -> DataFrame:
    path = F.concat(F.lit("/data/in/"), "p_brand", F.lit("/"), "p_name", F.lit(".wav"))
    rows = fx.read(spark, d, "part").withColumn("path", path)
    sample = names.sample_name(names.sanitize(names.stem(F.col("path"))), F.col("p_partkey"), F.lit("shift"), F.lit(2))
    deep = F.when(F.col("p_partkey") % 3 == 0, F.col("path")).when(F.col("p_partkey") % 3 == 1, F.concat_ws("/", F.lit("/data/in"), "p_brand", "p_type", F.lit("x.wav"))).otherwise("/data/in/x.wav")
    return rows.select("p_partkey", names.output_stem(F.col("path"), "/data/in").alias("output_stem"), names.top_level_folder(F.col("path"), "/data/in").alias("top_folder"), sample.alias("sample"), names.basename(F.col("path")).alias("base"), names.folder_name(deep, "/data/in/").alias("folder_name"))


# From files


@query(f"""WITH {fx.SEGMENTS}, {fx.ANNOTATIONS}, hits AS (
  SELECT a.id, arg_min(struct_pack(entry_name := entry_name, s := s, e := e, dur := duration), pos) AS seg FROM annotations a JOIN segments g
  ON a.metafile = g.metafile AND is_audio AND l BETWEEN s - 0.001 AND e + 0.001 GROUP BY a.id),
good AS (SELECT a.*, seg FROM annotations a JOIN hits USING (id) WHERE r <= seg.e + 0.001 AND metafile IN (SELECT metafile FROM entries))
SELECT concat('conv ', metafile) AS folder, 'conv metafile' AS metafile, 'the log' AS log, concat('conv ', metafile, '/', seg.entry_name) AS audio, seg.entry_name AS soundfile, channel::INTEGER AS channel,
  least(greatest(l - seg.s, 0), seg.dur)::DOUBLE AS lefttimesec, least(greatest(r - seg.s, 0), seg.dur)::DOUBLE AS righttimesec, top::DOUBLE AS topfreqhz, bottom::DOUBLE AS bottomfreqhz, concat('c', id) AS comment,
  row_number() OVER (ORDER BY concat('conv ', metafile, '/'), id) AS global_index FROM good""")
def remap_from_files(spark, d) -> DataFrame:
    """Annotations remapped from metafiles, logs and recordings in files, which all have the same names in each folder."""
    rows, _ = remap.remap(spark, fx.deployment(spark, d), default_spacer=5.125)
    return rows.select(
        F.col("FolderName").alias("folder"), F.col("MetafileName").alias("metafile"), F.col("AnnotationFileName").alias("log"), F.regexp_extract("AudioPath", "[^/]+/[^/]+$", 0).alias("audio"), "soundfile", "channel",
        "lefttimesec", "righttimesec", "topfreqhz", "bottomfreqhz", "comment", F.col("global_index").cast("long"),
    )


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant' AND length(text) >= 192),
s AS (SELECT *, unnest(list_distinct(list_append(list_transform(range((n - 192) // 64 + 1), lambda i: i * 64), n - 192))) AS first FROM r)
SELECT concat('conv ', conv_id, '/rec_', turn, '.wav') AS recording, first / 64.0::DOUBLE AS window_start, 64 AS samplerate,
  list_sum(list_transform(range(first, first + 192), lambda i: ((i * 7 + turn) % 101 - 50) * 100))::BIGINT AS total FROM s""")
def recording_windows(spark, d) -> DataFrame:
    """Windows of recordings in files, read by the data source."""
    recordings.register(spark)
    rows = spark.read.format("recordings").option("path", fx.deployment(spark, d)).load().filter("error is null")
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 32768).cast("long"))
    return rows.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("recording"), "window_start", "samplerate", total.alias("total"))


@query("""SELECT concat('conv ', conv_id, '/rec_', turn, '.wav') AS recording, 64 AS samplerate, 1 AS channels, length(text)::BIGINT AS frames, length(text) / 64.0::DOUBLE AS duration FROM conversations WHERE role = 'assistant'""")
def recording_info(spark, d) -> DataFrame:
    """Headers of the recordings in files."""
    rows = files.recording_info(spark, fx.deployment(spark, d))
    return rows.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("recording"), "samplerate", "channels", "frames", "duration")


@query(f"""WITH {fx.DETECTIONS} SELECT audio_path, window_index, window_start, window_end, detection_index, start_time, end_time, duration, low_freq, high_freq, confidence FROM detections""")
def detections_in_files(spark, d) -> DataFrame:
    """Detections written and read again."""
    path = f"{shared_folder(spark)}/detections-{uuid.uuid4().hex}"
    sinks.write_detections(fx.detections(spark, d), path)
    return files.read_detections(spark, path)


@query(f"""WITH {fx.DETECTIONS}, r AS (SELECT audio_path, count(*) AS n, max(confidence) AS confidence FROM detections GROUP BY ALL) SELECT * FROM r""")
def dataset_stats(spark, d) -> DataFrame:
    """Statistics written as JSON and read again."""
    path = f"{shared_folder(spark)}/stats-{uuid.uuid4().hex}"
    sinks.write_dataset_stats(fx.detections(spark, d).groupBy("audio_path").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")), path)
    return spark.read.schema("audio_path string, n long, confidence double").json(path)


@query("""WITH p AS (SELECT p_partkey, p_brand, p_name, p_partkey % 3 AS ch, p_size FROM part)
SELECT concat('b', p_size, '.log') AS log, count(*) AS n, sum(p_partkey)::BIGINT AS keys, max(line) AS last FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS line FROM p) WHERE ch < 2 GROUP BY p_size""")
def logs_in_files(spark, d) -> DataFrame:
    """Logs, one for each size, written and read again: of three rows two are tagged as annotations, and all have a number."""
    path, key = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}", F.col("p_partkey")
    tag = F.when(key % 3 == 0, " AN: ").when(key % 3 == 1, "ft:").otherwise("zz:")
    line = F.concat_ws("\t", tag, F.lit("s"), F.lit("1"), key, key + 1, F.lit("9.5"), F.lit("5"), F.concat(F.lit("c"), key), F.lit(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"]), "\n")
    logs = fx.read(spark, d, "part").groupBy("p_size").agg(F.concat(F.lit("tag\n"), text).alias("content"))
    sinks.write_files(logs.select(F.concat(F.lit("b"), "p_size", F.lit(".log")).alias("path"), "content"), path)
    rows = files.read_annotation_log(spark, path)[0].groupBy(names.basename(F.col("log_path")).alias("log"))
    return rows.agg(F.count("*").alias("n"), F.sum("left").cast("long").alias("keys"), F.max("line_no").alias("last"))


@query("SELECT p_brand AS folder, p_type AS meta, min(p_name) AS first, count(*) AS n FROM part GROUP BY ALL")
def signatures_in_files(spark, d) -> DataFrame:
    """Signatures written and read again, in their order."""
    path = f"{shared_folder(spark)}/signatures-{uuid.uuid4().hex}"
    part = fx.read(spark, d, "part").select(F.col("p_brand").alias("FolderName"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("MetafileName"), F.lit("l").alias("AnnotationFileName"), F.col("p_name").alias("AnnotationName"))
    part.repartitionByRange("FolderName", "MetafileName").sortWithinPartitions("FolderName", "MetafileName", "AnnotationName").write.option("header", True).csv(path)
    return files.read_signatures(spark, path).groupBy("folder", "meta").agg(F.min_by("name", "seq").alias("first"), F.count("*").alias("n"))


@query(f"""WITH {fx.ANNOTATIONS} SELECT concat(id, '.wav') AS soundfile, channel::INTEGER AS channel, l::DOUBLE AS lefttimesec, r::DOUBLE AS righttimesec, top AS topfreqhz, bottom AS bottomfreqhz, concat('c, "', id, '"') AS comment FROM annotations""")
def annotations_in_files(spark, d) -> DataFrame:
    """Annotations written and read again, with typed numbers."""
    path, text = f"{shared_folder(spark)}/annotations-{uuid.uuid4().hex}", lambda c, tail: F.concat(F.col(c).cast("string"), F.lit(tail))
    rows = fx.annotations(spark, d).select(
        *[F.lit("x").alias(c) for c in ("FolderName", "MetafileName", "AnnotationFileName", "AnnotationName", "AudioPath", "notes")], text("id", ".wav").alias("soundfile"), "channel",
        F.col("left").alias("lefttimesec"), F.col("right").alias("righttimesec"), F.col("top").alias("topfreqhz"), F.col("bottom").alias("bottomfreqhz"), F.concat(F.lit('c, "'), "id", F.lit('"')).alias("comment"),
    )
    sinks.write_annotations(rows, path)
    return files.read_annotations(spark, path)[0].select("soundfile", "channel", "lefttimesec", "righttimesec", "topfreqhz", "bottomfreqhz", "comment")


@query(r"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, avg(v) AS mean FROM (SELECT vec_id, unnest(x) AS v FROM e) GROUP BY vec_id),
w AS (SELECT vec_id, n, v - mean AS v FROM (SELECT vec_id, unnest(range(64)) AS n, unnest(x) AS v FROM e) JOIN m USING (vec_id)),
t AS (SELECT vec_id, n, v * CASE WHEN least(n, 64 - n) < 8 THEN 0.5 * (1 - cos(pi() * least(n, 64 - n) / 8)) ELSE 1 END AS v FROM w),
p AS (SELECT vec_id, k, (pow(sum(v * cos(2 * pi() * k * n / 64)), 2) + pow(sum(v * sin(2 * pi() * k * n / 64)), 2)) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS power FROM t, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k)
SELECT vec_id, count(*) AS n_bins, arg_max(k * 375.0::DOUBLE, power) AS loudest FROM p GROUP BY vec_id""")
def spectrograms(spark, d) -> DataFrame:
    """The loudest bin of each clip's one frame."""
    rows = fx.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(int(fx.SAMPLERATE)).alias("samplerate"))
    db = F.transform("spectrogram.db", lambda row: row[0])
    out = detect.with_spectrogram(rows).withColumn("db", db)
    return out.select("vec_id", F.size("db").cast("long").alias("n_bins"), F.get("spectrogram.freqs", (F.array_position("db", F.array_max("db")) - 1).cast("int")).alias("loudest"))


@query("""WITH b AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS top, list_max(embedding) > 0.3 AS loud FROM embeddings)
SELECT concat('v', vec_id) AS audio_path, 0::BIGINT AS window_index, greatest(0, (top + 0.5) / 64 * 3 - 0.375)::DOUBLE AS start_time, least(3, (top + 0.5) / 64 * 3 + 0.375)::DOUBLE AS end_time, 3000.0::DOUBLE AS low_freq, 9000.0::DOUBLE AS high_freq, 0.5::DOUBLE AS confidence FROM b WHERE loud""")
def detected(spark, d) -> DataFrame:
    """Windows scored by a detector that marks their highest sample."""

    def make():
        def score(samples, rates):
            return [np.array([[(x.argmax() + 0.5) / len(x), 0.5, 0.25, 0.5, 0.5]]) if x.max() > np.float32(0.3) else np.zeros((0, 5)) for x in samples]

        return score

    rows = fx.read(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("path"), F.lit(0).alias("window_index"), F.lit(0.0).alias("window_start"), F.lit(int(fx.SAMPLERATE)).alias("samplerate"), F.col("embedding").alias("samples"))
    return detect.physical_detections(detect.detect(rows, make), 3.0).select("audio_path", "window_index", "start_time", "end_time", "low_freq", "high_freq", "confidence")


# Windows and boxes


@query(f"""WITH {fx.RECORDINGS}, n AS (SELECT *, CAST(floor(duration - 3 + 1e-6) AS INTEGER) AS n FROM recordings WHERE duration + 1e-6 >= 3),
w AS (SELECT path, unnest(range(n + 1)) AS window_index, unnest(range(n + 1))::DOUBLE AS window_start FROM n
  UNION ALL SELECT path, n + 1, duration - 3 FROM n WHERE duration - 3 > 0 AND abs(n - (duration - 3)) > greatest(1e-6, 1e-6 * greatest(n, duration - 3)))
SELECT path, CAST(window_index AS INTEGER) AS window_index, window_start, window_start + 3 AS window_end FROM w""")
def expand_windows(spark, d) -> DataFrame:
    usable, _ = windows.usable_recordings(fx.recordings(spark, d), 3.0)
    return windows.expand_windows(usable).drop("duration")


@query(f"WITH {fx.RECORDINGS} SELECT path, duration FROM recordings WHERE NOT duration + 1e-6 >= 20")
def unusable_recordings(spark, d) -> DataFrame:
    return windows.usable_recordings(fx.recordings(spark, d), 20.0)[1]


BASE = f"""{fx.ANNOTATIONS}, base AS (
  SELECT *, greatest(0, least(greatest(greatest(0, r - 3), least(least(l, 57), (l + r) / 2 - 1.5)), 57))::DOUBLE AS ws FROM annotations
  WHERE r > l AND r - l <= 3 AND greatest(0, r - 3) <= least(l, 57)),
pairs AS (SELECT b.id AS sample, a.id AS id, b.ws, a.l, a.r, a.bottom, a.top FROM base b JOIN annotations a ON a.metafile = b.metafile AND a.channel = b.channel
  WHERE a.l >= b.ws - 1e-6 AND a.r <= b.ws + 3 + 1e-6 AND a.bottom >= -1e-6 AND a.top <= 12000 + 1e-6)"""


def _windows(spark, d) -> DataFrame:
    anchors = windows.usable_anchors(windows.positive_annotations(fx.anchors(spark, d)), 3.0)
    return windows.base_windows(anchors, 3.0)


def _pairs(spark, d) -> DataFrame:
    return windows.boxes_in_window(_windows(spark, d).withColumn("sample", F.col("id")), fx.anchors(spark, d), 3.0, 12000.0)


@query(f"WITH {BASE} SELECT id, ws AS window_start FROM base")
def base_windows(spark, d) -> DataFrame:
    return _windows(spark, d).select("id", "window_start")


@query(f"""WITH {BASE} SELECT sample, id, round(greatest(0, least(1, (l - ws + (r - l) / 2) / 3)), 6)::DOUBLE AS x_center, round(1 - (bottom + (top - bottom) / 2) / 12000, 6)::DOUBLE AS y_center,
  round((r - l) / 3, 6)::DOUBLE AS width, round((top - bottom) / 12000, 6)::DOUBLE AS height FROM pairs""")
def boxes_in_window(spark, d) -> DataFrame:
    return _pairs(spark, d).select("sample", "id", *[F.round(f"box.{c}", 6).alias(c) for c in ("x_center", "y_center", "width", "height")])


@query(f"WITH {BASE} SELECT sample, count(*) AS n_boxes, min(id) AS first_id FROM pairs GROUP BY sample")
def box_counts(spark, d) -> DataFrame:
    return _pairs(spark, d).groupBy("sample").agg(F.count("*").alias("n_boxes"), F.min("id").alias("first_id"))


@query(f"WITH {BASE} SELECT sample, id, round(l, 6)::DOUBLE AS start_time, round(r, 6)::DOUBLE AS end_time, round(bottom, 3)::DOUBLE AS low_freq, round(top, 3)::DOUBLE AS high_freq FROM pairs")
def box_round_trip(spark, d) -> DataFrame:
    """Boxes back to seconds and hertz: the annotations they came from."""
    p = _pairs(spark, d).withColumn("p", boxes.box_to_physical(F.col("box"), F.col("window_start"), 3.0, 12000.0))
    return p.select("sample", "id", F.round("p.start_time", 6).alias("start_time"), F.round("p.end_time", 6).alias("end_time"), F.round("p.low_freq", 3).alias("low_freq"), F.round("p.high_freq", 3).alias("high_freq"))


@query(f"WITH {BASE} SELECT sample, id, round(1 - (l - ws + (r - l) / 2) / 3, 6)::DOUBLE AS x_center FROM pairs")
def flipped_boxes(spark, d) -> DataFrame:
    p = _pairs(spark, d).withColumn("b", boxes.flip_box(F.array("box"))[0])
    return p.select("sample", "id", F.round("b.x_center", 6).alias("x_center"))


@query(f"""WITH {fx.DETECTIONS} SELECT audio_path, detection_index, greatest(start_time - 0.25, 0) AS start, greatest(end_time + 0.25 - greatest(start_time - 0.25, 0), 0.001) AS length,
  round((end_time - start_time) / greatest(end_time + 0.25 - greatest(start_time - 0.25, 0), 0.001), 6)::DOUBLE AS width FROM detections WHERE end_time > start_time + 1""")
def padded_windows(spark, d) -> DataFrame:
    rows = fx.detections(spark, d).filter("end_time > start_time + 1").withColumn("w", boxes.padded_window(F.col("start_time"), F.col("end_time"), 0.25))
    box = boxes.local_box(F.col("start_time"), F.col("end_time"), F.col("low_freq"), F.col("high_freq"), F.col("w"), 12000.0)
    return rows.select("audio_path", "detection_index", "w.start", "w.length", F.round(box["width"], 6).alias("width"))


@query(f"WITH {fx.ANNOTATIONS} SELECT id, CAST(ceil((r - l + 0.25) / 0.25) AS BIGINT) AS n_slices, (l - 0.125)::DOUBLE AS first_start FROM annotations")
def slice_grid(spark, d) -> DataFrame:
    grid = fx.annotations(spark, d).withColumn("g", boxes.slice_grid(F.col("left"), F.col("right"), 0.125, 0.25))
    return grid.select("id", F.size("g").cast("long").alias("n_slices"), F.get("g", F.lit(0)).alias("first_start"))


@query(f"""WITH {BASE}, line AS (SELECT sample, id, printf('%d %.6f %.6f %.6f %.6f', 0, (l - ws + (r - l) / 2) / 3, 1 - (bottom + (top - bottom) / 2) / 12000, (r - l) / 3, (top - bottom) / 12000) AS x FROM pairs)
SELECT sample, length(string_agg(x, chr(10) ORDER BY id)) AS n_chars, min(split_part(x, ' ', 5)) AS least_height FROM line GROUP BY sample""")
def label_lines(spark, d) -> DataFrame:
    """Labels of every sample, by their length and least height (printed digits of ties may differ between engines)."""
    rows = windows.collect_boxes(_pairs(spark, d)).withColumn("split", F.lit("train"))
    out = sinks.label_lines(rows).select("sample", F.length("label").cast("long").alias("n_chars"), F.split("label", "\n").alias("lines"))
    return out.select("sample", "n_chars", F.array_min(F.transform("lines", lambda x: F.element_at(F.split(x, " "), 5))).alias("least_height"))


# Splits and variants


@query(f"""WITH {fx.ANNOTATIONS} SELECT count(*) AS n, round(avg(r - l), 6)::DOUBLE AS mean, round(stddev_pop(r - l), 6)::DOUBLE AS std,
  greatest(3.0, 1.0, round_even(avg(r - l) + 4 * stddev_pop(r - l), 0))::DOUBLE AS slice_seconds FROM annotations WHERE r > l""")
def duration_stats(spark, d) -> DataFrame:
    return splits.duration_stats(fx.annotations(spark, d), 3.0).select("n", micro("mean"), micro("std"), "slice_seconds")


SPLIT = """ranked AS (SELECT event_id AS id, row_number() OVER (ORDER BY md5(concat('7:', event_id)), event_id) AS rn, count(*) OVER () AS n FROM events),
split AS (SELECT id, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train' WHEN rn <= round_even(n * 0.7, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query(f"WITH {SPLIT} SELECT id, split FROM split")
def assign_splits(spark, d) -> DataFrame:
    return splits.assign_splits(fx.annotations(spark, d), 0.7, 0.2, 0.1, seed=7).select("id", "split")


@query("""SELECT event_id AS id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT event_id, CAST(concat('0x', substr(md5(concat('7:', event_id)), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM events)""")
def assign_splits_by_hash(spark, d) -> DataFrame:
    return splits.assign_splits(fx.annotations(spark, d), 0.7, 0.2, 0.1, seed=7, mode="hash").select("id", "split")


@query("""WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
o AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY md5(concat('7:', user_id)), user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(n) OVER () AS total FROM g)
SELECT event_id AS id, CASE WHEN s < round_even(total * 0.7, 0) THEN 'train' WHEN s < round_even(total * 0.7, 0) + round_even(total * 0.2, 0) THEN 'val' ELSE 'test' END AS split FROM events JOIN o USING (user_id)""")
def assign_group_splits(spark, d) -> DataFrame:
    """Splits by recording: no recording is in two."""
    rows = fx.read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    return splits.assign_group_splits(rows, 0.7, 0.2, 0.1, "user_id", seed=7).select("id", "split")


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS global_index FROM events")
def global_index(spark, d) -> DataFrame:
    return splits.global_index(fx.read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id").select("event_id", "global_index")


@query(f"""WITH {SPLIT}, s AS (SELECT split, CASE id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'shift' ELSE 'flip' END AS kind FROM split)
SELECT split, kind, count(*) AS n, CAST(grouping(split) * 2 + grouping(kind) AS BIGINT) AS level FROM s GROUP BY GROUPING SETS ((split), (kind), ())""")
def sample_counts(spark, d) -> DataFrame:
    rows = splits.assign_splits(fx.annotations(spark, d), 0.7, 0.2, 0.1, seed=7)
    kind = F.when(F.col("id") % 3 == 0, "base").when(F.col("id") % 3 == 1, "shift").otherwise("flip")
    return splits.sample_counts(rows.withColumn("kind", kind))


@query(f"""WITH {BASE}, {SPLIT}, b AS (SELECT DISTINCT sample FROM pairs), k AS (SELECT id, split, unnest(CASE WHEN split = 'train' THEN ['base', 'flip', 'drop', 'mask'] ELSE ['base'] END) AS kind FROM split WHERE id IN (SELECT sample FROM b))
SELECT split, kind, count(*) AS n FROM k GROUP BY ALL""")
def variant_counts(spark, d) -> DataFrame:
    """Samples with boxes and their derived ones, by split and kind."""
    split = splits.assign_splits(fx.annotations(spark, d), 0.7, 0.2, 0.1, seed=7).select(F.col("id").alias("sample"), "split")
    rows = windows.collect_boxes(_pairs(spark, d)).join(split, "sample").withColumns({"kind": F.lit("base"), "variant": F.lit(None).cast("int")})
    return variants.variants(windows.drop_empty_samples(rows)).groupBy("split", "kind").agg(F.count("*").alias("n"))


def _unit(part: str, key: str = "id") -> str:
    return f"CAST(concat('0x', substr(md5(concat('0:', {key}, ':', {part})), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query(f"""WITH {BASE}, c AS (SELECT id, ws, (l + r) / 2 AS c, greatest(0, r - 3) + 1.5 AS lo, least(l, 57) + 1.5 AS hi FROM base),
g AS (SELECT *, list_append(list_filter(list_transform(range(CAST(floor((hi - lo) / 0.25 + 1e-6) AS BIGINT) + 1), lambda i: lo + i * 0.25), lambda x: x < hi - 1e-6), hi) AS grid FROM c WHERE hi - lo > 1e-6),
s AS (SELECT *, list_filter(list_transform(grid, lambda x: x - c), lambda x: x < -1e-6) AS n0, list_filter(list_transform(grid, lambda x: x - c), lambda x: x > 1e-6) AS p0 FROM g),
f AS (SELECT *, list_filter(n0, lambda x: x <= -0.25 + 1e-6) AS n1, list_filter(p0, lambda x: x >= 0.25 - 1e-6) AS p1 FROM s),
pools AS (SELECT *, CASE WHEN len(n1) > 0 THEN n1 ELSE n0 END AS n, CASE WHEN len(p1) > 0 THEN p1 ELSE p0 END AS p FROM f),
turns AS (SELECT *, unnest([0, 1]) AS i FROM pools),
own AS (SELECT *, CASE WHEN i = 0 AND len(n) > 0 OR len(p) = 0 THEN n ELSE p END AS pool FROM turns),
picks AS (SELECT *, pool[1 + CAST(floor({_unit("concat('shift', i)")} * len(pool)) AS BIGINT)] AS o FROM own WHERE len(pool) > 0),
moved AS (SELECT *, greatest(least(greatest(least(c + o - 1.5, hi - 1.5), lo - 1.5), 57), 0)::DOUBLE AS s FROM picks)
SELECT id, 'base' AS kind, CAST(NULL AS INTEGER) AS variant, ws AS window_start FROM base
UNION ALL SELECT id, CASE WHEN o < 0 THEN 'shiftneg' ELSE 'shift' END, i + 1, s FROM moved WHERE abs(s - ws) >= 0.25 - 1e-6""")
def shift_plans(spark, d) -> DataFrame:
    """Base and shifted windows of every anchor."""
    return variants.shift_plans(_windows(spark, d), 3.0, 0.25, 0.25, None, 2).select("id", "kind", "variant", "window_start")


def _rectangles(df) -> DataFrame:
    out = df.select("id", F.posexplode("rectangles").alias("i", "r"))
    return out.select("id", "i", *[F.round(f"r.{c}", 9).alias(c) for c in ("x", "y", "width", "height")])


@query(f"""WITH n AS (SELECT event_id AS id, unnest([0, 1, 2]) AS i FROM events), s AS (SELECT id, i, 0.05 + 0.15 * {_unit("concat(i, 'w')")} AS w, 0.05 + 0.15 * {_unit("concat(i, 'h')")} AS h FROM n)
SELECT id, i, round({_unit("concat(i, 'x')")} * (1 - w), 9)::DOUBLE AS x, round({_unit("concat(i, 'y')")} * (1 - h), 9)::DOUBLE AS y, round(w, 9)::DOUBLE AS width, round(h, 9)::DOUBLE AS height FROM s""")
def mask_plans(spark, d) -> DataFrame:
    return _rectangles(variants.plan_masks(fx.annotations(spark, d).select("id"), 3))


@query(f"""WITH s AS (SELECT event_id AS id, 0.1 * {_unit("'stripw'", "event_id")} AS w, 0.1 * {_unit("'striph'", "event_id")} AS h FROM events)
SELECT id, 0 AS i, round({_unit("'stripx'")} * (1 - w), 9)::DOUBLE AS x, 0.0::DOUBLE AS y, round(w, 9)::DOUBLE AS width, 1.0::DOUBLE AS height FROM s
UNION ALL SELECT id, 1, 0.0, round({_unit("'stripy'")} * (1 - h), 9), 1.0, round(h, 9) FROM s""")
def strip_plans(spark, d) -> DataFrame:
    return _rectangles(variants.plan_strips(fx.annotations(spark, d).select("id")))


# Filters


def _filter_sql(low: float, high: float, samples: int = 64) -> str:
    """Forward and backward runs of the sections of a filter over embeddings, sample by sample."""
    sections = signal.butterworth(4, low / (fx.SAMPLERATE / 2), high / (fx.SAMPLERATE / 2)).tolist()
    edge, n = 3 * (2 * len(sections) + 1), range(1, len(sections) + 1)
    states, starts, level = [f"s{i}{k}" for i in n for k in (1, 2)], [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        starts += [f"{level * (gain - b0)!r} * e[1]", f"{level * (b2 - a2 * gain)!r} * e[1]"]
        level *= gain
    step = "SELECT * FROM {name} WHERE n < len(e)"
    for i, (b0, *_) in zip(n, sections):
        step = f"SELECT *, {b0!r} * {'e[n + 1]' if i == 1 else f't{i - 1}'} + s{i}1 AS t{i} FROM ({step})"
    moved = []
    for i, (_, b1, b2, _, a1, a2) in zip(n, sections):
        x = "e[n + 1]" if i == 1 else f"t{i - 1}"
        moved += [f"{b1!r} * {x} - {a1!r} * t{i} + s{i}2", f"{b2!r} * {x} - {a2!r} * t{i}"]

    def run(name: str, source: str) -> str:
        return f"""{name} (vec_id, e, n, y, {', '.join(states)}) AS (
  SELECT vec_id, e, 0, 0.0::DOUBLE, {', '.join(starts)} FROM {source}
  UNION ALL SELECT vec_id, e, n + 1, t{n[-1]}, {', '.join(moved)} FROM ({step.format(name=name)})),
{name}_out AS (SELECT vec_id, list(y ORDER BY n DESC) AS e FROM {name} WHERE n > 0 GROUP BY vec_id)"""

    return f"""WITH RECURSIVE own AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
ext AS (SELECT vec_id, list_transform(range({edge}, 0, -1), lambda i: 2 * x[1] - x[i + 1]) || x || list_transform(range(1, {edge + 1}), lambda i: 2 * x[{samples}] - x[{samples} - i]) AS e FROM own),
{run('forth', 'ext')},
{run('back', 'forth_out')}
SELECT vec_id, unnest(range({samples})) AS i, round(unnest(e[{edge + 1}:{edge + samples}]) * 1e6)::BIGINT AS micro FROM back_out"""


@query(_filter_sql(4000.0, 7000.0))
def bandpassed(spark, d) -> DataFrame:
    """Clips band-passed without a shift, in millionths."""
    rows = fx.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(int(fx.SAMPLERATE)).alias("samplerate"), F.lit(4500.0).alias("low"), F.lit(6500.0).alias("high"))
    out = sinks.filtered_clips(rows, margin=500.0).select("vec_id", F.posexplode("samples").alias("i", "v"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("v") * 1e6).cast("long").alias("micro"))


# Slices


def _features(spark, d) -> DataFrame:
    return slices.with_features(fx.signals(spark, d), fx.SAMPLERATE)


@query(f"WITH {fx.SIGNALS} SELECT detection_index, slice_idx, round(power_floor * 1e6)::BIGINT AS power_floor, dom_freq, round(dom_power * 1e6)::BIGINT AS dom_power FROM feat")
def slice_features(spark, d) -> DataFrame:
    """Hann spectra in 4 to 12 kHz against a direct transform in SQL; powers in millionths."""
    f = _features(spark, d)
    return f.select("detection_index", F.col("slice_idx").cast("long"), F.round(F.col("power_floor") * 1e6).cast("long").alias("power_floor"), "dom_freq", F.round(F.col("dom_power") * 1e6).cast("long").alias("dom_power"))


@query(f"WITH {fx.SIGNALS} SELECT detection_index, slice_idx, classification FROM labelled")
def label_slices(spark, d) -> DataFrame:
    return slices.label_slices(_features(spark, d)).select("detection_index", F.col("slice_idx").cast("long"), "classification")


@query(f"""WITH {fx.SIGNALS} SELECT detection_index, count(*) AS n_slices, count(*) FILTER (classification = 'Trill') AS n_calls, round(count(*) FILTER (classification = 'Trill') / (count(*) * 0.015625), 6)::DOUBLE AS rate_hz,
  round(sum(dom_freq) FILTER (classification = 'Trill'), 3)::DOUBLE AS dom_sum, sum(left_freq) AS low_sum, sum(right_freq * (slice_idx + 1)) AS high_sum FROM labelled JOIN crossings USING (detection_index, slice_idx) GROUP BY ALL""")
def detection_stats(spark, d) -> DataFrame:
    """The arrays by their sums, that of the high frequencies weighed by their places."""
    out = slices.detection_stats(slices.label_slices(_features(spark, d)), 0.015625)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    placed = F.transform("high_freqs", lambda x, i: x * (i + 1))
    return out.select("detection_index", "n_slices", "n_calls", micro("rate_hz"), F.when(F.size("dom_freqs") > 0, F.round(total("dom_freqs"), 3)).alias("dom_sum"), total("low_freqs").alias("low_sum"), total(placed).alias("high_sum"))


@query(f"""WITH {fx.SIGNALS}, m AS (SELECT detection_index, 'dom' AS measure, dom_freq AS hz FROM labelled WHERE classification = 'Trill'
  UNION ALL SELECT detection_index, 'low', left_freq FROM crossings UNION ALL SELECT detection_index, 'high', right_freq FROM crossings)
SELECT detection_index, measure, count(*) AS n, round(quantile_cont(hz, 0.25) / 1000, 6)::DOUBLE AS q25_khz, round(quantile_cont(hz, 0.5) / 1000, 6)::DOUBLE AS q50_khz,
  round(quantile_cont(hz, 0.75) / 1000, 6)::DOUBLE AS q75_khz, round(avg(hz) / 1000, 6)::DOUBLE AS mean_khz FROM m GROUP BY ALL""")
def frequency_summary(spark, d) -> DataFrame:
    out = slices.frequency_summary(slices.label_slices(_features(spark, d)))
    return out.select("detection_index", "measure", "n", micro("q25_khz"), micro("q50_khz"), micro("q75_khz"), micro("mean_khz"))


@query(f"""WITH {fx.SIGNALS}, c AS (SELECT *, count(*) OVER (PARTITION BY detection_index) AS n FROM feat)
SELECT detection_index, slice_idx FROM c WHERE slice_idx >= greatest(least(n // 2 - 10, n - 20), 0) AND slice_idx < greatest(least(n // 2 - 10, n - 20), 0) + 20""")
def central_slices(spark, d) -> DataFrame:
    return slices.central_slices(fx.signals(spark, d), 20).select("detection_index", F.col("slice_idx").cast("long"))


@query(f"""WITH {fx.SIGNALS}, r AS (SELECT detection_index, slice_idx, sqrt(sum(v * v) / 64) AS rms FROM x GROUP BY ALL)
SELECT detection_index, arg_min(slice_idx, rms) AS slice_idx, round(min(rms), 6)::DOUBLE AS rms FROM r GROUP BY detection_index""")
def noise_slice(spark, d) -> DataFrame:
    return slices.noise_slice(fx.signals(spark, d)).select("detection_index", F.col("slice_idx").cast("long"), micro("rms"))


@query(f"""WITH {fx.SIGNALS} SELECT detection_index, slice_idx * 0.015625::DOUBLE AS t, dom_freq AS dom FROM labelled WHERE classification = 'Trill'""")
def trajectories(spark, d) -> DataFrame:
    out = slices.trajectories(slices.label_slices(_features(spark, d)))
    return out.select("detection_index", F.explode("points").alias("p")).select("detection_index", "p.t", "p.dom")


@query(f"""WITH RECURSIVE {fx.SIGNALS}, p AS (SELECT detection_index, slice_idx * 0.015625::DOUBLE AS t, dom_freq AS dom FROM labelled WHERE classification = 'Trill'),
a AS (SELECT detection_index, min(t) AS t FROM p GROUP BY ALL UNION ALL SELECT a.detection_index, min(p.t) FROM a JOIN p ON p.detection_index = a.detection_index AND p.t - a.t >= 0.05 GROUP BY a.detection_index),
g AS (SELECT p.detection_index, max(a.t) AS anchor, p.t, any_value(dom) AS dom FROM p JOIN a ON a.detection_index = p.detection_index AND a.t <= p.t GROUP BY p.detection_index, p.t),
k AS (SELECT detection_index, anchor, max(dom) AS dom, arg_min(t, struct_pack(d := -dom, t := t)) AS t FROM g GROUP BY ALL),
n AS (SELECT detection_index, count(*) AS n FROM p GROUP BY ALL)
SELECT detection_index, CAST(any_value(n) AS INTEGER) AS n_points, CAST(count(*) AS INTEGER) AS n_kept, sum(dom) AS dom_sum, round(sum(t), 6)::DOUBLE AS t_sum, round(count(*) / (any_value(n) * 0.015625), 6)::DOUBLE AS rate_hz
FROM k JOIN n USING (detection_index) GROUP BY detection_index""")
def deduped_rate(spark, d) -> DataFrame:
    """Anchored greedy groups: how many, and the sums of what stays of each."""
    out = slices.deduped_rate(slices.trajectories(slices.label_slices(_features(spark, d))), 0.05, 0.015625).filter("size(points) > 0")
    total = lambda c: F.aggregate("kept", F.lit(0.0), lambda a, p: a + p[c])
    return out.select("detection_index", F.size("points").alias("n_points"), F.size("kept").alias("n_kept"), total("dom").alias("dom_sum"), F.round(total("t"), 6).alias("t_sum"), micro("rate_hz"))


@query(f"WITH {fx.SIGNALS} SELECT detection_index, slice_idx, left_freq, right_freq FROM crossings")
def floor_crossings(spark, d) -> DataFrame:
    """Bins at which the spectrum falls to its floor."""
    return _features(spark, d).select("detection_index", F.col("slice_idx").cast("long"), "left_freq", "right_freq")


@query(f"""WITH {fx.SIGNALS} SELECT detection_index, round(quantile_cont(10 * log10(power + 1e-12), 0.05), 3)::DOUBLE AS low_db, round(quantile_cont(10 * log10(power + 1e-12), 0.99), 3)::DOUBLE AS high_db FROM spec GROUP BY ALL""")
def db_clip_range(spark, d) -> DataFrame:
    f = slices.with_features(fx.signals(spark, d), fx.SAMPLERATE, keep_spectrum=True)
    long = f.select("detection_index", F.explode("power_band").alias("power"))
    return slices.db_clip_range(long, "detection_index").select("detection_index", F.round("low_db", 3).alias("low_db"), F.round("high_db", 3).alias("high_db"))


# Joins to recordings, unions and sequences


@query(f"WITH {fx.ANNOTATIONS}, {fx.SEGMENTS}, len AS (SELECT metafile, max(e)::DOUBLE AS audio_duration FROM segments GROUP BY metafile) SELECT id, audio_duration, r - l AS duration FROM annotations JOIN len USING (metafile) WHERE r > l AND audio_duration >= 3 AND r - l <= 3")
def usable_anchors(spark, d) -> DataFrame:
    """Annotations joined to the length of their timeline; those that a window can't hold are left out."""
    lengths = timeline.timeline_summary(timeline.build_timeline(fx.entries(spark, d))).select(F.col("metafile").alias("path"), F.col("length").alias("duration"), F.lit(24000).alias("samplerate"))
    rows = windows.positive_annotations(fx.annotations(spark, d).withColumnRenamed("metafile", "path")).withColumnRenamed("duration", "length")
    return windows.usable_anchors(windows.with_recordings(rows, lengths), 3.0).select("id", "audio_duration", F.col("length").alias("duration"))


@query("SELECT user_id AS metafile, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_index FROM events")
def sequence_index(spark, d) -> DataFrame:
    rows = fx.read(spark, d, "events").select(F.col("user_id").alias("metafile"), "event_id")
    return matching.sequence_index(rows, order="event_id").select("metafile", "event_id", F.col("sequence_index").cast("long"))


@query("SELECT event_id AS line_no, user_id % 3 AS source FROM events UNION ALL SELECT o_orderkey, 7 FROM orders")
def union_annotations(spark, d) -> DataFrame:
    """Annotations of several sources, whose columns come in different orders."""
    events = fx.read(spark, d, "events").select(F.col("event_id").alias("line_no"), (F.col("user_id") % 3).alias("source"))
    return events.unionByName(fx.read(spark, d, "orders").select(F.lit(7).cast("long").alias("source"), F.col("o_orderkey").alias("line_no")))


@query(f"WITH {fx.DETECTIONS} SELECT detection_index, round(10 * log10(confidence + 1e-12), 6)::DOUBLE AS added_db, round(10 * log10(greatest(confidence, 1e-12)), 6)::DOUBLE AS floored_db FROM detections")
def decibels(spark, d) -> DataFrame:
    c = F.col("confidence")
    return fx.detections(spark, d).select("detection_index", F.round(boxes.to_db(c), 6).alias("added_db"), F.round(boxes.to_db(c, add=False), 6).alias("floored_db"))


# Streams, run over what there is and read back


def _replayed(spark, d, change, name: str) -> DataFrame:
    """The table that a streaming query writes when the events are delivered and nothing follows."""
    import uuid

    from .store import shared_folder

    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(fx.read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a glob, as a stream takes no single file
    start = F.col("ts").cast("timestamp")
    rows = rows.select(F.concat(F.lit("rec_"), "user_id").alias("audio_path"), start.alias("start_ts"), (F.col("value") * 600).alias("duration"), (2000.0 + (F.col("event_id") % 50) * 100).alias("low_freq"),
        (3000.0 + (F.col("event_id") % 50) * 100 + (F.col("event_id") % 7) * 125).alias("high_freq"), ((F.col("event_id") * 37 % 100) / 100.0).alias("confidence"))
    out = change(rows)
    out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@query(f"""WITH {fx.ISLANDS}, n AS (SELECT audio_path, island, count(*) AS n FROM islands GROUP BY ALL)
SELECT audio_path, round(start_time, 3)::DOUBLE AS start_time, round(end_time, 3)::DOUBLE AS end_time, low_freq, high_freq, confidence, n
FROM merged JOIN n USING (audio_path, island) WHERE end_time <= (SELECT max(start_time) FROM detections) - 86400""")
def stream_merge(spark, d) -> DataFrame:
    """Merged detections that the watermark of one day has closed."""
    out = _replayed(spark, d, lambda rows: streams.merge_stream(rows, "1 day"), "merge")
    seconds = lambda c: F.round(F.unix_micros(c) / 1e6, 3)
    return out.select("audio_path", seconds("start_ts").alias("start_time"), seconds("end_ts").alias("end_time"), "low_freq", "high_freq", "confidence", "n")


@query(f"""WITH {fx.DETECTIONS}, w AS (SELECT *, unnest([0, 1]) AS back FROM detections),
c AS (SELECT audio_path, (floor(start_time / 3600) - back) * 3600 AS window_start, count(*) AS n, max(confidence) AS confidence FROM w GROUP BY ALL)
SELECT audio_path, window_start, n, confidence FROM c WHERE window_start + 7200 <= (SELECT max(start_time) FROM detections) - 86400""")
def stream_window_counts(spark, d) -> DataFrame:
    """Counts in windows of two hours, each hour, that the watermark of one day has closed."""
    out = _replayed(spark, d, lambda rows: streams.window_counts(rows, "1 day", "2 hours", "1 hour"), "counts")
    return out.select("audio_path", (F.unix_micros("window_start") / 1e6).alias("window_start"), "n", "confidence")
