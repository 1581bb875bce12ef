"""Benchmark decontamination by a prefix-filtered containment join."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .likely import without
from .store import Tables, own_name

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SQL_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_WINDOWS = 200_000


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, words): the distinct windows of every item, of ``size`` words or of all its words if fewer."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(text, F.lit(SQL_WORDS), 0).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    items = items.filter(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at"))
    return items.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("words")).distinct()


def shingle_hits(docs: DataFrame, shingles: dict[tuple, int], width: int) -> DataFrame:
    """(doc_id, text_hash, n_words, at, id): each document's positions at which a known shingle starts, by width."""
    widths = sorted({len(s) for s in shingles})
    known = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches):
        ids = known.value
        for b in batches:
            n, at, found = [], [], []
            for text in b.column(2).to_pylist():
                w = WORDS.findall((text or b"").lower())
                hits = [(i, ids[s]) for k in widths for i, s in enumerate(zip(*(w[j:] for j in range(k)))) if s in ids]
                n.append(len(w))
                at.append([h[0] for h in hits])
                found.append([h[1] for h in hits])
            ints = pa.list_(pa.int32())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(at, ints), pa.array(found, ints)], names=["doc_id", "text_hash", "n_words", "at", "id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, at array<int>, id array<int>")


def block_matches(hits: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """(text_hash, n_words, start, length, items): where windows(window_id, ids, length, items) occur in hits.

    ``ids`` are a window's shingles in order, ``span`` of them at most. Shingles are ranked by how often the documents have them; a window can
    only occur where its rarest shingle does, the prefix for a containment of all. Candidates are cut by the window's
    length and the shingle's place in it and then verified: equal shingles at consecutive places are equal words. A hit
    takes only those along that a window round it can have, so a text's rows grow with its hits, not with their square.
    """
    found = hits.filter(F.size("id") > 0)
    counts = found.select(F.explode("id").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    tokens = windows.select("window_id", F.posexplode("ids").alias("place", "token")).join(counts, "token")
    prefix = tokens.groupBy("window_id").agg(F.min(F.struct("df", "place", "token")).alias("rarest"), F.count("*").alias("known"))
    prefix = prefix.join(windows, "window_id").filter(F.col("known") == F.size("ids"))
    prefix = prefix.select("rarest.token", "rarest.place", "ids", "length", "items")
    lo = lambda k: F.greatest(k - span + 1, F.lit(0))
    near = F.transform("id", lambda t, k: F.struct((k - lo(k)).alias("k"), t.alias("token"), F.slice("at", lo(k) + 1, F.lit(2 * span - 1)).alias("at"), F.slice("id", lo(k) + 1, F.lit(2 * span - 1)).alias("id")))
    each = found.select("text_hash", "n_words", F.inline(near))
    out = each.join(F.broadcast(prefix), "token")  # at most BLOCK_WINDOWS rows
    first, last = F.col("k") - F.col("place") + 1, F.col("k") - F.col("place") + F.size("ids")
    out = out.filter((first >= 1) & (last <= F.size("id")))
    out = out.withColumns({"start": F.get("at", first - 1), "end": F.get("at", last - 1)})
    out = out.filter((F.col("end") - F.col("start") == F.size("ids") - 1) & (F.col("start") + F.col("length") <= F.col("n_words")))
    out = out.filter(F.slice("id", first, F.size("ids")) == F.col("ids"))
    return out.select("text_hash", "n_words", "start", "length", "items").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, width: int = 3, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated) for every row of documents.

    A-Z are lower-cased, words are runs of digits, letters and non-ASCII characters; a window is ``size`` consecutive
    words of a benchmark item, or all of a shorter one. Words inside an occurring window are hit. A document is
    contaminated if a word is hit and 20 * n_hit >= n_words. Null and empty texts have no words; null item_ids hit but
    are not listed; null doc_ids and repeated rows are rows like others; an empty benchmark hits nothing.

    The benchmark is the stated query set: windows go to the executors in blocks of at most ``block``, one pass over
    the documents each, so nothing broadcast grows with either table. The digest is by text, so copies are joined once.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "decontaminate")
    texts = benchmark_windows(benchmark, size).groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    texts = tables.write(texts.withColumn("part", F.xxhash64("words")))
    blocks = -(-texts.count() // block) or 1
    matches, rows = [], None
    for b in range(blocks):
        of = texts.filter(F.pmod("part", F.lit(blocks)) == b).select("words", "items").collect()
        shingles: dict[tuple, int] = {}
        windows = []
        for n, (words, items) in enumerate(sorted(of)):
            w, k = [x.encode() for x in words], min(width, len(words))
            ids = [shingles.setdefault(tuple(w[i : i + k]), len(shingles)) for i in range(len(w) - k + 1)]
            windows.append((n, ids, len(words), items))
        hits = tables.write(shingle_hits(docs, shingles, width))
        rows = rows or hits
        schema = "window_id int, ids array<int>, length int, items array<string>"
        matches.append(block_matches(hits, spark.createDataFrame(windows, schema), max(size - width + 1, 1)))
    found = matches[0]
    for m in matches[1:]:
        found = found.unionAll(m)
    found = tables.write(found)
    by = ["text_hash", "n_words"]
    before = Window.partitionBy(*by).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = found.groupBy(*by, "start").agg(F.max("length").alias("length"))
    spans = spans.select(*by, "start", end.alias("end"), F.coalesce(F.max(end).over(before), F.lit(0)).alias("done"))
    hit = spans.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).cast("long").alias("n_hit"))
    items = found.select(*by, F.explode("items").alias("item")).distinct()
    items = items.groupBy(*by).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("list"))
    found = tables.write(hit.join(items, by, "left"))
    out = rows.select("doc_id", *by).join(found, by, "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0))})
    out = out.withColumn("items_sha256", F.sha2(F.coalesce("list", F.lit("")), 256))
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    tables.keep_only(rows, found)
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", dirty.alias("contaminated"))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text is contaminated."""
    digest = own_name(docs, "_digest")
    dirty = contamination(docs, benchmark).filter("contaminated").select(F.col("text_hash").alias(digest)).distinct()
    dirty = Tables(docs.sparkSession, "contaminated").write(dirty)
    return without(docs, dirty, F.xxhash64("text") == F.col(digest), digest)


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS k, least(len(w), 13) AS n FROM starts),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
occ AS (SELECT doc_id, s, win.n, item_id FROM dp JOIN win ON win.n = dp.n AND array_to_string(w[s:s + dp.n - 1], ' ') = k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l
          FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
