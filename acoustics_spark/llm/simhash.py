"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components
from .likely import likely
from .store import Tables, own_name

BITS = 64
SEED = 42


def shingle_digests(text: bytes | None, width: int) -> bytes:
    """The 8-byte hashes of a UTF-8 text's shingles in order, repeats included: A-Z lower-cased, words between ASCII white
    space, ``width`` words each (fewer words: one shingle of all; none: no shingle)."""
    words = (text or b"").lower().split()  # bytes.lower and bytes.split know ASCII alone
    if not words:
        return b""
    join, digest = b" ".join, xxhash.xxh64_digest
    if len(words) <= width:
        return digest(join(words), SEED)
    return b"".join([digest(join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)])


def majority(digests: bytes) -> int:
    """The number whose bit is 1 if it is set in over half the digests; 0 for none."""
    n = len(digests) // 8
    raw, votes = np.frombuffer(digests, np.uint8).reshape(n, 8), np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):  # a long text's bits are counted in slices
        votes += np.unpackbits(raw[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text over its shingles, see :func:`shingle_digests`."""
    return majority(shingle_digests(text, width))


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of documents(doc_id, text), fp the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(2).to_pylist()), np.uint64, len(b))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v), v < u: links between distinct fingerprints that hold each set of fps within ``radius`` bits together.

    Every fingerprint goes to all variants within half the radius (65 of them at radius 2), so two within the radius
    meet in a variant. For an even radius those who meet are all within it of one another, so a link of each to the
    least of its variant links what all pairs would. A variant has at most as many members as the ball, whatever the
    size of a group of copies, as fps are distinct. An odd radius goes by the next even ball, pair by pair.
    """
    half, signed = (radius + 1) // 2, lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    masks = [signed(sum(1 << i for i in c)) for k in range(half + 1) for c in combinations(range(BITS), k)]
    out = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
    out = out.select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    if radius % 2 == 0:
        out = out.select(F.col("fp").alias("u"), F.min("fp").over(Window.partitionBy("variant")).alias("v"))
    else:
        meet = out.groupBy("variant").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
        meet = meet.select("fps", F.posexplode("fps").alias("i", "v"))
        out = meet.select("v", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("u"))
    return out.filter(F.col("u") != F.col("v")).distinct().filter(near)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, fingerprint, component_id) for every row of documents.

    component_id is the least doc_id that links of ``radius`` bits or fewer reach. Texts that are null or without words
    have fingerprint 0 and link like others. Rows of equal fingerprints are one node, so a group of copies, however
    large, costs one node. Null doc_ids stay as rows and never name a component (null only if no member has an id).
    An empty table gives an empty result; other columns are ignored.
    """
    tables = Tables(docs.sparkSession, "simhash")
    rows = tables.write(with_fingerprints(docs, width))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(ball_links(nodes.select("fp"), radius), tables)
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    nodes = tables.write(nodes.join(ids, "root").select("fp", "component_id"))
    tables.keep_only(rows, nodes)
    out = rows.join(nodes, "fp")
    return out.select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "fingerprint", "component_id")


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each component of groups(doc_id, text_hash, component_id): that of its least doc_id; of
    repeated rows with that id, one. Rows with a null doc_id stay, as nothing names them. Only rows that may go are
    shuffled."""
    at, digest, times = (own_name(docs, n) for n in ("_id", "_digest", "_times"))
    rows = groups.filter("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.count("*").alias("times"))
    least = rows.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("least"))
    stays = F.col("component_id").eqNullSafe(F.col("doc_id")) & F.col("least").eqNullSafe(F.col("text_hash"))
    rows = rows.join(least, "doc_id", "left").select(F.col("doc_id").alias(at), F.col("text_hash").alias(digest), F.when(stays, F.col("times")).otherwise(0).alias(times))
    rows = Tables(docs.sparkSession, "least").write(rows.filter(F.col(times) != 1))
    near, far = (likely(docs, rows, how, digest, F.xxhash64(docs["text"])) for how in ("left_semi", "left_anti"))
    near = near.join(rows, (F.col("doc_id").cast("long") == F.col(at)) & (F.xxhash64("text") == F.col(digest)), "left")
    alone = near.filter(F.col(times).isNull()).select(docs.columns)
    once = near.filter(F.col(times) > 1).dropDuplicates([at]).select(docs.columns)
    return far.unionAll(alone).unionAll(once)


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each component of fingerprints; see :func:`keep_least`."""
    return keep_least(docs, near_duplicates(docs, width, radius))
