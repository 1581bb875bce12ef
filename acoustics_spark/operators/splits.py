"""Statistics, exact splits and global numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import require_ratios
from ..store import cut


def duration_stats(annotations: DataFrame, least: float, deviations: float = 4.0) -> DataFrame:
    """One row: n, mean, std (population) of positive durations, and the slice length max(least, 1, round(mean +
    deviations * std)), half to even. No row if there is no annotation."""
    d = F.greatest(F.col("right") - F.col("left"), F.lit(0.0))
    out = annotations.select(d.alias("d")).filter("d > 0").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))
    length = F.greatest(F.lit(float(least)), F.lit(1.0), F.bround(F.col("mean") + deviations * F.col("std"), 0))
    return out.filter("n > 0").withColumn("slice_seconds", length)


def global_index(df: DataFrame, *order: str, name: str = "global_index") -> DataFrame:
    """df with 1..n over all rows in order, by range partitions: each numbers its own rows, and offsets come from the
    partitions' counts (one small row each), so no task sorts everything. The partitioned rows are checkpointed, as another run might sample other bounds."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def hash_key(seed: int, key: str) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def assign_splits(df: DataFrame, train: float, val: float, test: float, seed: int = 0, key: str = "id", mode: str = "exact") -> DataFrame:
    """df with split: rows in the order of a keyed hash; round(n * train) train, the next round(n * val) val, the rest test.

    ``exact`` ranks by ranges of hash prefixes: rows are counted by prefix (65536 at most), and only a row's place within
    its prefix is sorted. ``hash`` compares the hash with the ratios: no shuffle, sizes are approximate. Rows that share a
    key may fall into different splits in ``exact`` mode; pass a recording as key with ``hash`` to keep them together.
    """
    require_ratios(train, val, test)
    h = hash_key(seed, key)
    if mode == "hash":
        u = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)
        return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))
    rows = df.withColumns({"_h": h, "_prefix": F.substring(h, 1, 4)})
    counts = rows.groupBy("_prefix").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_prefix")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_prefix", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_prefix").orderBy("_h", key)) + F.col("_before")
    n_train = F.bround(F.col("_all") * train)
    n_val = F.least(F.bround(F.col("_all") * val), F.col("_all") - n_train)
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    out = rows.join(F.broadcast(offsets), "_prefix").withColumn("_rank", rank)
    return out.withColumn("split", split).select(*df.columns, "split")


def assign_group_splits(df: DataFrame, train: float, val: float, test: float, group: str, seed: int = 0) -> DataFrame:
    """df with split, the same for all rows of a group: groups in the order of a keyed hash, each to the split that the rows
    before it haven't filled, so a split has its share of rows but for one group at most (a null group is one group).

    Groups are counted first and summed by hash prefix (65536 at most); only groups of one prefix are put in order.
    """
    require_ratios(train, val, test)
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit(""))))).withColumn("_prefix", F.substring("_h", 1, 4))
    order = Window.orderBy("_prefix")
    offsets = sizes.groupBy("_prefix").agg(F.sum("_n").alias("_own"))
    offsets = offsets.select("_prefix", F.coalesce(F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy()).alias("_all"))
    within = Window.partitionBy("_prefix").orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    n_train, n_val = F.bround(F.col("_all") * train), F.bround(F.col("_all") * val)
    split = F.when(F.col("_start") < n_train, "train").when(F.col("_start") < n_train + n_val, "val").otherwise("test")
    chosen = sizes.join(F.broadcast(offsets), "_prefix").withColumn("_start", start).select(F.col(group).alias("_group"), split.alias("split"))
    return df.join(chosen, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, "split")


def sample_counts(samples: DataFrame) -> DataFrame:
    """Samples by split, by kind and in all, in one pass over grouping sets."""
    level = F.grouping_id("split", "kind")
    return samples.groupingSets([["split"], ["kind"], []], "split", "kind").agg(F.count("*").alias("n"), level.alias("level"))
