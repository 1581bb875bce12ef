"""Plans of augmented samples: ids, offsets and rectangles, without their samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.boxes import center_bounds, flip_box, shift_offsets, unit, window_start_for


def shift_plans(samples: DataFrame, window: float, step: float, least: float, most: float | None, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """samples(left, right, audio_duration, window_start, ..) -> base rows and up to n shifted ones, as kind, variant and
    window_start. A shifted window that clamping brings back to under ``least`` from the base is dropped."""
    left, right, duration = F.col("left"), F.col("right"), F.col("audio_duration")
    bounds = center_bounds(left, right, window, duration)
    offsets = shift_offsets(left, right, bounds, step, least, most, n, F.col(key), seed)
    def at(o):
        return window_start_for(left, right, window, duration, o)

    plan = lambda kind, i, start: F.struct(kind.alias("kind"), i.cast("int").alias("variant"), start.alias("window_start"))
    shifts = F.transform(offsets, lambda o, i: plan(F.when(o < 0, "shiftneg").otherwise("shift"), i + 1, at(o)))
    moved = F.filter(shifts, lambda s: F.abs(s["window_start"] - F.col("window_start")) >= least - 1e-6)
    base = F.array(plan(F.lit("base"), F.lit(None), F.col("window_start")))
    plans = F.when(bounds.isNotNull(), F.concat(base, moved)).otherwise(base)
    out = samples.select(*[c for c in samples.columns if c != "window_start"], F.explode(plans).alias("p"))
    return out.select("*", "p.kind", "p.variant", "p.window_start").drop("p")


def coarse(key: Column, n: int = 3, seed: int = 0) -> Column:
    """n relative rectangles (x, y, width, height) with sides of 5 to 20 %, from a keyed hash."""
    def one(i: int):
        w, h = (0.05 + 0.15 * unit(seed, key, f"{i}{side}") for side in "wh")
        return F.struct((unit(seed, key, f"{i}x") * (1 - w)).alias("x"), (unit(seed, key, f"{i}y") * (1 - h)).alias("y"), w.alias("width"), h.alias("height"))

    return F.array(*[one(i) for i in range(n)])


def strips(key: Column, most: float = 0.1, seed: int = 0) -> Column:
    """An upright and a level strip, each up to ``most`` of the side thick, from a keyed hash."""
    w, h = (most * unit(seed, key, f"strip{side}") for side in "wh")
    x, y = (unit(seed, key, f"strip{at}") * (1 - side) for at, side in (("x", w), ("y", h)))
    strip = lambda x, y, w, h: F.struct(*[c.alias(n) for c, n in zip((x, y, w, h), ("x", "y", "width", "height"))])
    return F.array(strip(x, F.lit(0.0), w, F.lit(1.0)), strip(F.lit(0.0), y, F.lit(1.0), h))


def variants(samples: DataFrame, drops: int = 1, masks: int = 1, flip: bool = True, seed: int = 0, key: str = "sample") -> DataFrame:
    """Samples(key, split, kind, variant, boxes, ..) with derived ones: of every base and shifted training sample a flip,
    drops and masks, by one explode of an array of plans, each with its rectangles: :func:`coarse` ones of a drop,
    :func:`strips` of a mask, none of others, drawn by the key (where there is none by all columns). ``source`` keeps the
    kind it derives from."""
    none = F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")

    def plan(kind, i, rectangles=none):
        return F.struct(F.lit(kind).alias("derived"), F.lit(i).cast("int").alias("derived_variant"), rectangles.alias("rectangles"))

    name = F.col(key).cast("string") if key in samples.columns else F.xxhash64(*samples.columns).cast("string")
    own = lambda kind, i: F.concat_ws("#", name, F.lit(f"{kind}{i}"))
    extra = [plan("flip", None)] * flip + [plan("drop", i + 1, coarse(own("drop", i + 1), seed=seed)) for i in range(drops)]
    extra += [plan("mask", i + 1, strips(own("mask", i + 1), seed=seed)) for i in range(masks)]
    plans = F.when(F.col("split") == "train", F.array(plan(None, None), *extra)).otherwise(F.array(plan(None, None)))
    out = samples.select("*", F.explode(plans).alias("p")).select("*", "p.derived", "p.derived_variant", "p.rectangles").drop("p")
    out = out.withColumn("boxes", F.when(F.col("derived") == "flip", flip_box(F.col("boxes"))).otherwise(F.col("boxes")))
    return out.withColumn("source", F.col("kind")).withColumn("kind", F.coalesce("derived", "kind"))


def plan_masks(samples: DataFrame, n: int = 3, seed: int = 0, key: str = "id") -> DataFrame:
    """samples with ``rectangles``, see :func:`coarse`."""
    return samples.withColumn("rectangles", coarse(F.col(key), n, seed))


def plan_strips(samples: DataFrame, most: float = 0.1, seed: int = 0, key: str = "id") -> DataFrame:
    """samples with ``rectangles``, see :func:`strips`."""
    return samples.withColumn("rectangles", strips(F.col(key), most, seed))
