"""Shards of near equal bytes by sampled splitters; DataFrame operations only."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window, functions as F

from .store import Tables

SHARDS = 16
RANGES_PER_SHARD = 128
SAMPLE_PER_RANGE = 8
UNIT = 2.0**63


def _sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    ids = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ids, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row_id"))


def _at_or_under(bounds: list[int], value) -> F.Column:
    """How many of the sorted bounds are <= value, by a block of bounds and then a place within it."""
    def array(x):
        return F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") if x else F.array().cast("array<bigint>")

    step = int(len(bounds) ** 0.5) + 1
    block = F.size(F.filter(array(bounds[::step]), lambda b: b <= value))
    rest = F.filter(F.slice(array(bounds), F.greatest((block - 1) * step, F.lit(0)) + 1, F.lit(step)), lambda b: b <= value)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + F.size(rest))


def with_units(rows: DataFrame, shards: int, ranges: int, sample: int) -> DataFrame:
    """rows with ``unit``: a range of keys between splitters, or a part of an overfull range.

    The splitters are quantiles of a sample of about ``sample`` keys, drawn in proportion to size by a hash of the row.
    A key (a text) over a range's share is a range of its own, parted by row, whose parts stay ``together`` unless the
    key has over an eighth of a shard; another range over twice its share is parted by key.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(total / ranges, 1.0)
    weight = F.col("size") * F.lit(sample / max(total, 1))
    chance = F.abs(F.xxhash64("row_id", "key", F.lit("draw")).cast("double")) / UNIT
    drawn = rows.select("key", F.floor(weight + chance).cast("int").alias("n")).filter("n > 0")
    drawn = drawn.select("key", F.explode(F.sequence(F.lit(1), "n")))
    cuts = F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 4 * sample)
    bounds = sorted(set(drawn.agg(cuts).first()[0] or []))  # at most ranges - 1 numbers
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > share)
    heavy = heavy.select("key", F.ceil(F.col("bytes") / share).alias("parts"), (F.col("bytes") <= total / shards / 8).alias("whole"))  # under ``ranges`` rows, as each holds a share
    rows = rows.join(F.broadcast(heavy), "key", "left").withColumn("range", _at_or_under(bounds, F.col("key")))
    full = rows.filter("parts is null").groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 2 * share)
    full = full.select("range", F.ceil(F.col("bytes") / share).alias("range_parts"))  # at most ``ranges`` rows
    rows = rows.join(F.broadcast(full), "range", "left")
    part = F.when(F.col("parts").isNotNull(), F.struct(F.col("key").alias("a"), F.pmod(F.xxhash64("row_id"), "parts").alias("b"), F.col("whole").alias("together")))
    part = part.otherwise(F.struct(F.lit(None).cast("long").alias("a"), F.pmod(F.xxhash64("key"), F.coalesce("range_parts", F.lit(1))).alias("b"), F.lit(False).alias("together")))
    return rows.withColumn("unit", F.struct("range", part.alias("part"))).drop("parts", "whole", "range_parts", "range")


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of documents, by the law ``bytes``.

    size is the UTF-8 length of the text (null: none) plus 1. Rows are dealt into ranges of text hashes between sampled
    splitters, many to a shard, and overfull ranges are parted. The ranges' exact bytes, at most three times
    shards * ranges_per_shard numbers, go largest first to the shard with least; equal texts go together unless they
    have over an eighth of a shard. A slot is a row's place in its range
    plus the rows of the shard's ranges before, so no task sorts more than a range. Null doc_ids and repeated rows are
    rows like others; an empty table gives no rows; other columns are ignored.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "shards")
    rows = tables.write(_sizes(docs))
    ranges = shards * ranges_per_shard
    rows = tables.write(with_units(rows, shards, ranges, ranges * SAMPLE_PER_RANGE))
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    alone = F.when(F.col("unit.part.together"), F.col("unit.part.a"))
    units = units.select(F.to_json("unit").alias("unit"), alone.alias("text"), "bytes", "n").collect()  # bounded by ``ranges``
    bundles = defaultdict(list)  # what goes to one shard: a range, or all parts of a text
    for u in units:
        bundles[u.unit if u.text is None else u.text].append(u)
    load, used, placed = [(0, s) for s in range(shards)], [0] * shards, []
    for _, _, own in sorted((-sum(u.bytes for u in own), str(k), own) for k, own in bundles.items()):
        filled, s = heapq.heappop(load)
        for u in sorted(own, key=lambda u: u.unit):
            placed.append((u.unit, s, used[s]))
            used[s] += u.n
            filled += u.bytes
        heapq.heappush(load, (filled, s))
    places = spark.createDataFrame(placed, "unit_name string, shard int, first long")
    order = Window.partitionBy("unit").orderBy("key", "doc_id", "row_id")
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("unit_name", F.to_json("unit"))
    out = rows.join(F.broadcast(places), "unit_name")
    slot = (F.col("first") + F.col("place")).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_id")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes documents(doc_id, text, ...) as one folder a shard, rows in slot order within each file. Rows that share an id
    and a text are paired with their places one by one, so every row is written once."""
    same = ["doc_id", "size", "text_crc32"]
    nth = F.row_number().over(Window.partitionBy(*[F.col(f"_{c}") for c in same]).orderBy("_row"))
    names = [F.col(c).alias(f"_{c}") for c in same]
    places = shard(docs, shards).select(*names, F.col("row_id").alias("_row"), "shard", "slot").withColumn("_nth", nth).drop("_row")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = docs.select("*", F.col("doc_id").cast("long").alias("_doc_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text).alias("_text_crc32"), F.monotonically_increasing_id().alias("_row"))
    own, keys = own.withColumn("_nth", nth), [f"_{c}" for c in same] + ["_nth"]
    places = places.withColumnsRenamed({k: f"{k}_" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"{k}_"))
    out = own.join(places, met).drop(*keys, *[f"{k}_" for k in keys], "_row")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
