"""Connected components of a graph whose nodes and edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Tables


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _to_least(pairs: DataFrame) -> DataFrame:
    """Adds to every (u, v) the least of u and its v. The minimum is combined before the shuffle and joined back, so
    that a hub's rows may be split over tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least.select("u", F.least("u", "least").alias("m")), "u")


def connected_components(edges: DataFrame, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """(u, v) links of comparable ids -> (node, root), root the least id that node reaches; only nodes with a link.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stop changing, which takes a
    logarithmic number of rounds. Self links and nulls are ignored; repeated links count once.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = tables.write(e), None
    for _ in range(most_rounds):
        large = _to_least(_neighbours(e)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _to_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        new = tables.write(small.filter("u <> v").distinct())
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        tables.drop(e)
        e = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
