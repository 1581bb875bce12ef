"""Keeping rows out of a shuffle that have no partner: a bitmap of hashes, of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PLACES = 1 << 24  # bits of the filter: what is broadcast is 2 MB, whatever the size of either table
CHUNK = 1 << 15  # bits of one bitmap


def _bit(key: Column) -> tuple[Column, Column]:
    place = F.pmod(key, F.lit(PLACES))
    return F.shiftright(place, 15), place.bitwiseAND(CHUNK - 1)


def likely(rows: DataFrame, wanted: DataFrame, how: str, key: str = "text_hash", of: Column | None = None) -> DataFrame:
    """rows whose hash (the long ``of``, else their column ``key``) falls on a place, of PLACES, that a ``key`` of wanted
    has (left_semi), or doesn't (left_anti; nulls, too). left_semi loses no row that wanted has; a few others pass, and
    all of them once wanted has many more keys than PLACES."""
    chunk, bit = _bit(F.col(key))
    maps = wanted.select(chunk.alias("_chunk"), bit.alias("_bit")).distinct().groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    chunk, bit = _bit(rows[key] if of is None else of)
    byte = F.conv(F.hex(F.substring(maps["_map"], (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (chunk == maps["_chunk"]) & (F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1), how)


def without(docs: DataFrame, gone: DataFrame, same: Column, key: str) -> DataFrame:
    """docs without the rows that have a partner in gone by ``same``, a condition on column names, of which those of gone
    are its own, and which implies that the text's hash is gone's ``key``. Only rows that may have one are shuffled."""
    near, far = (likely(docs, gone, how, key, F.xxhash64(docs["text"])) for how in ("left_semi", "left_anti"))
    return near.join(gone, same, "left_anti").unionAll(far)
