"""Names, paths and match tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SUFFIXES = (".txt", " metafile", "_metafile", "-metafile")  # fixed values of metafile names


def match_tokens(name: Column) -> Column:
    """Forms under which a name may occur in a comment: as it is, with ``-`` as ``_``, with ``_`` as a space, and the part
    after the first ``_`` in both spellings. Ordered, distinct, non-empty."""
    base = F.lower(F.trim(name))
    plain = F.replace(base, F.lit("-"), F.lit("_"))
    cut = F.instr(plain, "_")
    tail = F.when(cut > 0, F.substring(plain, cut + 1, F.length(plain)))
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    forms = F.transform(F.array(base, plain, spaced(plain), tail, spaced(tail)), lambda t: F.trim(t))
    return F.array_distinct(F.filter(forms, lambda t: t.isNotNull() & (t != "")))


def comment_forms(comment: Column) -> Column:
    """A comment lower-cased, and with ``-``, ``_`` or spaces replaced, each on its own."""
    low = F.lower(F.trim(F.coalesce(comment, F.lit(""))))
    swap = lambda a, b: F.replace(low, F.lit(a), F.lit(b))
    return F.array(low, swap("-", "_"), swap("_", " "), swap(" ", "_"))


def override_candidates(*names: Column) -> Column:
    """Lower-cased names with up to three metafile suffixes taken off, in order of rank."""
    def strip(c: Column) -> list[Column]:
        cut = lambda n: F.trim(F.substring(c, F.lit(1), F.length(c) - n))
        return [F.when(F.endswith(c, F.lit(x)) & (F.length(c) > len(x)), cut(len(x))) for x in SUFFIXES]

    level = F.array(*[F.lower(F.trim(n)) for n in names])
    out = level
    for _ in range(3):
        level = F.flatten(F.transform(level, lambda c: F.array(*strip(c))))
        level = F.filter(level, lambda c: c.isNotNull() & (c != ""))
        out = F.concat(out, level)
    return F.array_distinct(F.filter(out, lambda c: c.isNotNull() & (c != "")))


def metafile_candidates(file: Column, folder: Column) -> Column:
    """Override keys of a metafile: its file name, its stem, its folder, the folder with each suffix."""
    return override_candidates(file, stem(file), folder, *[F.concat(folder, F.lit(s)) for s in SUFFIXES[1:]])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def slash_variants(path: Column) -> Column:
    return F.array_distinct(F.array(path, F.replace(path, F.lit("\\"), F.lit("/")), F.replace(path, F.lit("/"), F.lit("\\"))))


def sanitize(name: Column) -> Column:
    """Runs of what is neither a word character (of any script) nor ``-`` as ``_``; ``item`` if nothing is left."""
    safe = F.regexp_replace(name, r"(?U)[^\w\-]+", "_")
    return F.coalesce(F.nullif(F.trim(safe, F.lit("_")), F.lit("")), F.lit("item"))


def sanitize_audio(name: Column) -> Column:
    safe = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.trim(safe, F.lit("_")), F.lit("")), F.lit("audio"))


def local_path(path: Column) -> Column:
    """A local path without its scheme; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def is_absolute(path: Column) -> Column:
    return F.rlike(path, F.lit(r"^(/|[A-Za-z][A-Za-z0-9+.-]*://)"))


def normal_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``; what stands before its first part (``/``, a scheme and host) stays."""
    head = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/?|/)?", 0)
    parts = F.split(F.substring(path, F.length(head) + 1, F.length(path)), "/")
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p.isin("", "."), out).when(p == "..", up(out)).otherwise(F.concat(out, F.array(p))))
    return F.concat(head, F.array_join(kept, "/"))


def path_below(folder: Column, name: Column) -> Column:
    """folder/name, or name where it is absolute."""
    return normal_path(F.when(is_absolute(name), name).otherwise(F.concat(folder, F.lit("/"), name)))


def path_parts(path: Column) -> Column:
    """The distinct parts of a path, its file name included."""
    return F.array_distinct(F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", ".")))


def parent(path: Column) -> Column:
    """What stands before a path's last part; empty if it has one part alone."""
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def folder_name(path: Column, root: str) -> Column:
    """The folder of a file below root; of a file in root itself, and of one outside it, its folder's own name."""
    top, own = root.rstrip("/") + "/", parent(path)
    inside = F.startswith(own, F.lit(top))
    return F.when(inside, F.substring(own, F.lit(len(top) + 1), F.length(own))).otherwise(basename(own))


def relative_to(path: Column, root: str) -> Column:
    """The part of a path below root; the base name of a path that isn't below it."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(basename(path))


def output_stem(path: Column, root: str) -> Column:
    parts = F.transform(F.split(relative_to(path, root), "/"), lambda p: sanitize(F.regexp_replace(p, r"\.[^.]*$", "")))
    return F.array_join(parts, "__")


def top_level_folder(path: Column, root: str) -> Column:
    """The first part below root (a file in root itself: its own name); outside root the parent's name."""
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return F.when(inside, F.element_at(F.split(relative_to(path, root), "/"), 1)).otherwise(F.get(F.reverse(F.split(path, "/")), F.lit(1)))


def sample_name(path_stem: Column, index: Column, kind: Column, variant: Column) -> Column:
    """``{stem}_ann_{00000}`` with the variant's suffix."""
    base = F.format_string("%s_ann_%05d", path_stem, index)
    suffix = F.when(kind == "base", F.lit("")).otherwise(F.concat(F.lit("__"), kind, F.coalesce(variant.cast("string"), F.lit(""))))
    return F.concat(base, suffix)


def detection_name(audio_stem: Column, index: Column, start: Column, end: Column, confidence: Column) -> Column:
    return F.format_string("%s_det%04d_start%07.2fs_end%07.2fs_conf%.2f", sanitize_audio(audio_stem), index, start, end, confidence)


def param_suffix(slice_seconds: float, hop_seconds: float, confidence: float) -> str:
    return f"s{slice_seconds:.2f}_h{hop_seconds:.2f}_c{confidence:.2f}"


def parse_override(text: Column) -> Column:
    """``NAME=SECONDS`` -> struct(name, seconds); null if it isn't one with a non-negative number."""
    name = F.lower(F.trim(F.substring_index(text, "=", 1)))
    seconds = F.trim(F.substring(text, F.instr(text, "=") + 1, F.length(text))).try_cast("double")
    fine = F.contains(text, F.lit("=")) & (name != "") & (seconds >= 0)
    return F.when(fine, F.struct(name.alias("name"), seconds.alias("seconds")))
