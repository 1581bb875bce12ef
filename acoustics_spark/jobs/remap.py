"""Remapping annotations of concatenated recordings to single recordings, from files to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import basename, folder_name, output_stem, parent, path_below, stem, top_level_folder
from ..operators import matching, splits, timeline
from ..sources import files, sinks
from ..store import cut


def wavs_of(listing: DataFrame) -> DataFrame:
    """The recordings of a listing(path)."""
    return listing.filter(F.endswith(F.lower("path"), F.lit(".wav")))


def logs_of(listing: DataFrame, logs: DataFrame) -> DataFrame:
    """What of a listing(path, ..) logs(log_path, ..) name and can be a log: no recording and no metafile."""
    low = F.lower("path")
    return listing.filter(~F.endswith(low, F.lit(".wav")) & ~F.endswith(low, F.lit("metafile.txt"))).join(logs.select(F.col("log_path").alias("path")).distinct(), "path")


def placed_metafiles(metafiles: DataFrame, root: str) -> DataFrame:
    """metafiles(metafile, ..) with the names that others are found by: folder_path, top, name and stem."""
    path = F.col("metafile")
    return metafiles.withColumns({"folder_path": parent(path), "top": top_level_folder(path, root), "name": basename(path), "stem": stem(path)})


def chosen_logs(place: DataFrame, listing: DataFrame, signatures: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """place(metafile, folder_path, log_ref, top, name, stem) -> (metafile, folder, meta, log_path) and rejects: the log that
    the metafile names, beside it; with signatures that of the metafile's signature, in any of its forms. Metafiles of
    which signatures don't know the folder or the key are left out."""
    if signatures is None:
        wanted = place.select("metafile", F.col("top").alias("folder"), F.col("stem").alias("meta"), F.array(path_below(F.col("folder_path"), F.col("log_ref"))).alias("candidates"))
        found = wanted.join(matching.first_existing(wanted, listing, "metafile").withColumnRenamed("path", "log_path"), "metafile", "left").drop("candidates")
    else:
        known = matching.allowed_folders(place.withColumn("folder", F.col("top")), signatures).drop("folder")
        keys = matching.match_signature_key(known, signatures)
        asked = known.select("metafile", F.col("folder_path").alias("folder")).join(keys.select("metafile", F.col("log").alias("log_ref")), "metafile")
        found = keys.drop("log").join(matching.resolve_log(asked, listing).select("metafile", "log_path"), "metafile")
    return found.filter("log_path is not null"), found.filter("log_path is null").select("metafile", F.lit("annotation log not found").alias("reason"))


def timelines(entries: DataFrame, place: DataFrame, recordings: DataFrame, overrides: DataFrame | None, audio_dir: str | None, default_spacer: float, spacer_recordings: bool) -> tuple[DataFrame, DataFrame]:
    """entries(metafile, pos, entry_name) -> (segments with path, rejects). A name is sought below the audio folder, by
    default the metafile's own, so one name in two folders is two recordings. A metafile with a recording that isn't found,
    or of unknown length, has no timeline: every such entry is a reject."""
    spacer = None
    if overrides is not None:
        spacer = matching.match_overrides(place.select("metafile", F.col("name").alias("file"), basename(F.col("folder_path")).alias("folder")), overrides)
        spacer = spacer.select("metafile", F.col("seconds").alias("spacer"))
    named = entries.join(place.select("metafile", F.col("folder_path").alias("_folder")), "metafile").withColumn("entry_id", F.struct("metafile", "pos"))
    sought = named.filter(F.endswith(F.lower("entry_name"), F.lit(".wav")))
    folder = F.col("_folder") if audio_dir is None else F.lit(audio_dir)
    found = matching.resolve_entries(sought.select("entry_id", "entry_name", "_folder"), recordings, folder).select("entry_id", "path", "status")
    timed = timeline.with_durations(named.join(found, "entry_id", "left").drop("entry_id", "_folder"), recordings, spacer, default_spacer, spacer_recordings)
    lost = timed.filter(F.col("is_audio") & F.col("duration").isNull())
    why = F.concat(F.lit("recording "), "entry_name", F.lit(": "), F.when(F.col("path").isNull(), F.col("status")).otherwise("unreadable"))
    whole = timed.join(lost.select("metafile").distinct(), "metafile", "left_anti")
    return timeline.build_timeline(whole.drop("status")), lost.select("metafile", why.alias("reason"))


def remap(
    spark: SparkSession, root: str, signatures: DataFrame | None = None, overrides: DataFrame | None = None, audio_dir: str | None = None,
    default_spacer: float = timeline.DEFAULT_SPACER, spacer_recordings: bool = False, tolerance: float = timeline.TOLERANCE, recordings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(annotations, rejects(metafile, reason)) of all metafiles below root, with their logs and recordings.

    recordings(path, duration) is the catalogue, by default the headers of what lies below root; signatures(folder, meta,
    log, name, seq) choose metafiles, logs and names, overrides(name, seconds) spacers. With ``spacer_recordings`` a spacer
    that is a recording lasts as long as it does. Tasks list and open the files, so the driver holds none of their names
    (where they can't, see :func:`files.reached`, Spark's readers do). What is listed and read is checkpointed, as several joins
    ask for it: every metafile, header and log is opened once. All joins are by key, and by merging sorted rows: by the few
    bytes of a listing or of short files, what they unfold to would be held for small and broadcast.
    """
    root = root.rstrip("/")
    held = lambda df: cut(df).hint("merge")
    listing = held(files.list_files(spark, root))
    known = files.reached(root)
    entries, rejects = files.parse_metafiles(held(files.read_metafiles(spark, files.dealt(listing, "path") if known else root)))
    place = placed_metafiles(entries.select("metafile", "log_ref").distinct(), root)
    if recordings is None:
        recordings = held(files.recording_info(spark, files.dealt(wavs_of(listing), "path")).filter("error is null").select("path", "duration"))
    logs, unknown = chosen_logs(place, listing, signatures)
    place = place.join(logs.select("metafile"), "metafile", "left_semi")
    segments, lost = timelines(entries, place, recordings, overrides, audio_dir, default_spacer, spacer_recordings)
    good, bad = files.read_annotation_log(spark, logs_of(listing, logs) if known else root, recursive=True, held=held)
    rows = good.join(logs, "log_path")
    bad = bad.join(logs, "log_path").select("metafile", F.concat(F.lit("bad value in row "), "line_no").alias("reason"))
    if signatures is not None:
        rows = matching.match_names(rows, matching.build_token_table(signatures))
    else:
        rows = rows.withColumn("annotation_name", F.col("comment"))
    rows = rows.join(segments.select("metafile").distinct(), "metafile", "left_semi")
    mapped, off = timeline.good_and_rejects(timeline.map_to_segments(rows, segments, tolerance, carry=("path",)))
    mapped = splits.global_index(matching.sequence_index(mapped), "metafile", "sequence_index")
    out = mapped.select(
        folder_name(F.col("metafile"), root).alias("FolderName"), stem(F.col("metafile")).alias("MetafileName"), stem(F.col("log_path")).alias("AnnotationFileName"), F.col("annotation_name").alias("AnnotationName"),
        F.col("path").alias("AudioPath"), F.col("entry_name").alias("soundfile"), "channel", F.col("left_rel").alias("lefttimesec"), F.col("right_rel").alias("righttimesec"),
        F.col("top").alias("topfreqhz"), F.col("bottom").alias("bottomfreqhz"), "comment", "notes", "global_index", "sequence_index", output_stem(F.col("path"), root).alias("stem"),
    )
    for other in (unknown, lost, bad, off.select("metafile", "reason")):
        rejects = rejects.unionByName(other)
    return out, rejects


def remap_to_csv(spark: SparkSession, root: str, out: str, **inputs) -> None:
    rows, _ = remap(spark, root, **inputs)
    sinks.write_annotations(rows, out)
