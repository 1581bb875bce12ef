"""Joins by name: signatures, comment tokens, catalogues of files and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import basename, comment_forms, is_absolute, match_tokens, metafile_candidates, parent, path_below, path_parts, slash_variants


def build_token_table(signatures: DataFrame) -> DataFrame:
    """signatures(folder, meta, log, name, seq) -> (folder, meta, token, names, seq): for every token the distinct names
    that have it, in order, and the place it first occurs at. Rows without folder, meta or log are left out."""
    full = signatures.filter("folder <> '' and meta <> '' and log <> '' and name <> ''")
    tokens = full.select("folder", "meta", "name", "seq", F.posexplode(match_tokens(F.col("name"))).alias("k", "token"))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "k", "name"))), lambda x: x["name"]))
    return tokens.groupBy("folder", "meta", "token").agg(names.alias("names"), F.min(F.struct("seq", "k")).alias("first"))


def signature_conflicts(signatures: DataFrame) -> DataFrame:
    """(folder, meta, n_logs) that name more than one log."""
    return signatures.groupBy("folder", "meta").agg(F.count_distinct("log").alias("n_logs")).filter("n_logs > 1")


def allowed_folders(metafiles: DataFrame, signatures: DataFrame) -> DataFrame:
    """Metafiles whose top folder the signatures know."""
    return metafiles.join(signatures.select("folder").distinct(), "folder", "left_semi")


def match_names(annotations: DataFrame, tokens: DataFrame, gram: int = 6) -> DataFrame:
    """Annotations(folder, meta, comment, ..) with annotation_name: the first name of the longest token found in a form
    of the comment (ties: the token met first); rows without a match are dropped, and of repeated rows each stays.

    A token can only be in a comment that holds the token's rarest piece of ``gram`` characters (all of a shorter token),
    so distinct comments are cut into pieces and joined on folder, meta and piece; what meets is checked and reduced by a
    combining maximum. A busy metafile is spread over the pieces of its comments.
    """
    key = ["folder", "meta"]
    pieces = lambda text, n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    size = F.least(F.length("token"), F.lit(gram))
    cut = tokens.select(*key, "token", F.element_at("names", 1).alias("_name"), "first", F.explode(F.array_distinct(pieces(F.col("token"), size))).alias("_piece"))
    often = cut.groupBy(*key, "_piece").agg(F.count("*").alias("_often"))
    rarest = F.min(F.struct("_often", "_piece"))["_piece"].alias("_piece")
    wanted = cut.join(often, [*key, "_piece"]).groupBy(*key, "token").agg(F.first("_name").alias("_name"), F.first("first").alias("first"), rarest)
    sizes = wanted.groupBy(*key).agg(F.collect_set(F.length("_piece")).alias("_sizes"))
    comments = annotations.select(*key, "comment").filter(F.trim("comment") != "").distinct()
    forms = comment_forms(F.col("comment"))
    own = F.transform(forms, lambda f: F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(f)), lambda n: pieces(f, n))))
    met = comments.join(sizes, key).select(*key, "comment", F.explode(F.array_distinct(F.flatten(own))).alias("_piece"))
    met = met.join(wanted, [*key, "_piece"]).filter(F.exists(forms, lambda f: F.contains(f, F.col("token"))))
    rank = F.struct(F.length("token").alias("n"), (-F.col("first.seq")).alias("s"), (-F.col("first.k")).alias("k"))
    found = met.groupBy(*key, "comment").agg(F.max_by("_name", rank).alias("annotation_name"))
    return annotations.join(found, [*key, "comment"]).select(*annotations.columns, "annotation_name")


def match_signature_key(metafiles: DataFrame, signatures: DataFrame) -> DataFrame:
    """metafiles(metafile, top, name, stem) with the signature key of the first that exists: (top, stem), (top, name),
    (top, stem.txt), top being the metafile's top folder; and the log that the key's first signature names."""
    tries = F.posexplode(F.array_distinct(F.array("stem", "name", F.concat("stem", F.lit(".txt"))))).alias("rank", "meta")
    full = signatures.filter("folder <> '' and meta <> '' and log <> ''")
    keys = full.groupBy("folder", "meta").agg(F.min_by("log", "seq").alias("log"))
    hits = metafiles.select("metafile", F.col("top").alias("folder"), tries).join(keys, ["folder", "meta"])
    return hits.groupBy("metafile").agg(F.min(F.struct("rank", "folder", "meta", "log")).alias("key")).select("metafile", "key.folder", "key.meta", "key.log")


def first_existing(wanted: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """wanted(key, candidates: array of paths) -> (key, path): the first candidate that catalog(path) has."""
    tries = wanted.select(key, F.posexplode("candidates").alias("rank", "path"))
    return tries.join(catalog.select("path"), "path").groupBy(key).agg(F.min_by("path", "rank").alias("path"))


def resolve_entries(entries: DataFrame, catalog: DataFrame, audio_dir: Column) -> DataFrame:
    """entries(entry_id, entry_name) with path and status: ``exact`` for the first of the name as written, in either slash
    style, and its base name, all below the row's audio folder (a path that is absolute stands for itself); else by base
    name anywhere in the catalogue: ``found`` if there is one, ``ambiguous`` or ``missing``. A hot base name only meets
    rows that have no exact path, and counts as one row."""
    name = F.col("entry_name")
    forms = F.transform(F.concat(slash_variants(name), F.array(basename(name))), lambda n: path_below(audio_dir, n))
    exact = first_existing(entries.select("entry_id", F.array_distinct(forms).alias("candidates")), catalog, "entry_id")
    names = catalog.groupBy(basename(F.col("path")).alias("_base")).agg(F.min("path").alias("_least"), F.count_distinct("path").alias("_n"))
    out = entries.join(exact, "entry_id", "left").withColumn("_want", F.when(F.col("path").isNull(), basename(name)))
    out = out.join(names, F.col("_want") == F.col("_base"), "left")
    status = F.when(F.col("path").isNotNull(), "exact").when(F.col("_n") == 1, "found").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return out.select(*entries.columns, F.coalesce("path", F.when(F.col("_n") == 1, F.col("_least"))).alias("path"), status.alias("status"))


def _by_parts(asks: DataFrame, files: DataFrame) -> DataFrame:
    """asks(ask, base, parts, sound) with the files of their base name whose paths have all of parts: n, least, and n_end,
    least_end of those that end with sound. An inverted index: an ask only meets the files of the part of its own that
    fewest files of that name have."""
    index = files.select("base", F.explode("held").alias("part"), "path", "held")
    often = index.groupBy("base", "part").agg(F.count("*").alias("often"))
    own = asks.filter(F.size("parts") > 0)
    rare = own.select("ask", "base", F.explode("parts").alias("part")).join(often, ["base", "part"], "left")
    rare = rare.groupBy("ask").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "part")).alias("rare"))
    met = own.join(rare.filter("rare.often > 0").select("ask", F.col("rare.part").alias("part")), "ask").join(index, ["base", "part"])
    met = met.filter(F.forall("parts", lambda p: F.array_contains("held", p))).withColumn("end", F.endswith("path", "sound"))
    return met.groupBy("ask").agg(F.count("*").alias("n"), F.min("path").alias("least"), F.count_if("end").alias("n_end"), F.min(F.when(F.col("end"), F.col("path"))).alias("least_end"))


def _by_name(asks: DataFrame, files: DataFrame) -> DataFrame:
    """asks(ask, base, sound) with the files of their base name: n, least, and n_end, least_end of those that end with sound.
    Files are counted by name, and by their ends of the lengths that asks of the name have, so no pairs are made."""
    names = files.groupBy("base").agg(F.count("*").alias("n"), F.min("path").alias("least"))
    sizes = asks.groupBy("base").agg(F.collect_set(F.length("sound")).alias("sizes"))
    ends = files.join(sizes, "base").select("base", "path", F.explode("sizes").alias("size")).filter(F.length("path") >= F.col("size"))
    ends = ends.groupBy("base", F.expr("right(path, size)").alias("sound")).agg(F.count("*").alias("n_end"), F.min("path").alias("least_end"))
    return asks.select("ask", "base", "sound").join(names, "base").join(ends, ["base", "sound"], "left").drop("base", "sound")


def resolve_audio(annotations: DataFrame, catalog: DataFrame, root: str = "", key: str = "id") -> DataFrame:
    """annotations(key, folder, audio_path, soundfile, ..) with path and ``ambiguous``.

    The first of these that the catalogue has: an absolute audio_path; folder/audio_path and audio_path below root;
    folder/soundfile and soundfile below root. Else files of the base name (audio_path's, or soundfile's): those whose path
    has all parts of folder and of a relative audio_path's folder, if there are any, or all of them; of several the only
    one that ends with soundfile, or the least (``ambiguous``). Annotations of one recording ask once, and a name that
    every folder has meets an ask by the ask's rarest part.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    ask = F.struct(text("folder").alias("f"), text("audio_path").alias("a"), text("soundfile").alias("s"))
    rows = annotations.withColumn("_ask", ask)
    f, a, s = (F.col(f"ask.{c}") for c in "fas")
    asks = rows.select(F.col("_ask").alias("ask")).distinct()
    below = lambda *names: F.concat_ws("/", F.lit(root), *names)
    relative = (a != "") & ~is_absolute(a)
    tries = F.array(
        F.when((a != "") & is_absolute(a), a), F.when(relative & (f != ""), below(f, a)), F.when(relative, below(a)), F.when(f != "", below(f, s)), below(s)
    )
    tries = F.transform(F.array_compact(tries), lambda p: path_below(F.lit(root), p))
    exact = first_existing(asks.select("ask", tries.alias("candidates")), catalog, "ask")
    parts = F.array_union(path_parts(f), F.when(relative, path_parts(parent(a))).otherwise(F.array().cast("array<string>")))
    rest = asks.join(exact, "ask", "left_anti").select("ask", basename(F.when(a != "", a).otherwise(s)).alias("base"), parts.alias("parts"), s.alias("sound"))
    files = catalog.select("path").distinct().select("path", basename(F.col("path")).alias("base"), path_parts(F.col("path")).alias("held"))
    near = _by_parts(rest, files)
    near = near.unionByName(_by_name(rest.join(near, "ask", "left_anti"), files))
    only = (F.col("n") > 1) & (F.col("n_end") == 1)
    near = near.select("ask", F.when(only, F.col("least_end")).otherwise(F.col("least")).alias("path"), ((F.col("n") > 1) & ~F.coalesce(only, F.lit(False))).alias("ambiguous"))
    found = exact.withColumn("ambiguous", F.lit(False)).unionByName(near).withColumnRenamed("ask", "_ask")
    return rows.join(found, "_ask", "left").drop("_ask")


def missing_audio_report(resolved: DataFrame) -> DataFrame:
    """The rows without a path, and where the audio was expected."""
    return resolved.filter("path is null").withColumn("expected", F.concat_ws("/", F.nullif("folder", F.lit("")), "soundfile"))


def resolve_log(metafiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """metafiles(metafile, folder, log_ref) with log_path: the log, log.log or log.txt in the metafile's folder, the
    first there is; null if none."""
    at = path_below(F.col("folder"), F.col("log_ref"))
    wanted = metafiles.select("metafile", F.array(at, F.concat(at, F.lit(".log")), F.concat(at, F.lit(".txt"))).alias("candidates"))
    return metafiles.join(first_existing(wanted, catalog, "metafile").withColumnRenamed("path", "log_path"), "metafile", "left")


def match_overrides(metafiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """metafiles(metafile, file, folder) -> (metafile, name, seconds) of the first candidate that overrides(name, seconds) have.

    The candidates, a dozen a metafile, look small by the bytes of the file that metafiles are read from; in joins to the
    left they are never what is broadcast."""
    tries = metafiles.select("metafile", F.posexplode(metafile_candidates(F.col("file"), F.col("folder"))).alias("rank", "name"))
    hits = tries.join(overrides.select("name"), "name", "left_semi").join(overrides, "name", "left")
    return hits.groupBy("metafile").agg(F.min(F.struct("rank", "name", "seconds")).alias("o")).select("metafile", "o.name", "o.seconds")


def unused_overrides(overrides: DataFrame, matched: DataFrame) -> DataFrame:
    """The overrides that none of matched(name) has, by name; their distinct names are joined, not a row a metafile."""
    return overrides.join(matched.select("name").distinct(), "name", "left_anti").orderBy("name")


def sequence_index(rows: DataFrame, key: str = "metafile", order: str = "line_no") -> DataFrame:
    return rows.withColumn("sequence_index", F.row_number().over(Window.partitionBy(key).orderBy(order)))
