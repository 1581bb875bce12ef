"""Exact substring dedup by bucket refinement over sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .likely import likely
from .store import Tables

LENGTH = 400
CELL = 16  # starts refined together
SLAB = 1 << 18  # starts worked on at once; longer documents are cut into slabs that overlap by LENGTH
FLUSH = 1 << 16  # rows that a task gathers before it gives them
ROWS = 500  # documents whose kept texts a task gives at once
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that don't begin a code point
BASE = 0x9E3779B97F4A7C15 | 1


class Buckets:
    """Bucket identifiers of all q-grams of a byte array: 64-bit polynomial hashes, mixed."""

    def __init__(self, most: int):
        base = np.full(most, BASE, np.uint64)
        base[0] = 1
        self.up = np.multiply.accumulate(base)
        base[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        self.down = np.multiply.accumulate(base)

    def of(self, data: np.ndarray, q: int) -> np.ndarray:
        n = len(data) - q + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        out = (sums[q:] - sums[:n]) * self.down[:n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out


def leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` keys the place of its least key, the leftmost of equals."""
    n, bits = len(keys), np.uint64(len(keys).bit_length())
    packed = (keys >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = packed
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def _slabs(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document, its place in the bytes, that place's offset in the document): texts together, long ones cut."""
    data, parts = [], []
    size = 0
    for d, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), SLAB):
            piece = t if len(t) <= SLAB + length else t[at : at + SLAB + length - 1]
            if size and size + len(piece) > SLAB + length:
                yield b"".join(data), *map(np.array, zip(*parts))
                data, parts, size = [], [], 0
            data.append(piece)
            parts.append((d, size, at))
            size += len(piece)
            if piece is t:
                break
    if data:
        yield b"".join(data), *map(np.array, zip(*parts))


def sampled_runs(texts: list[bytes], buckets: Buckets, length: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, lo, n, place, bucket, context) arrays. Each start of a ``length``-byte string samples the q-gram in it with
    the least bucket identifier, so equal strings sample the same place in themselves. Neighbouring starts lo..lo+n that
    sample one q-gram are a run; place is the q-gram's offset from lo, bucket identifies it, and context the bytes from lo
    to the end of the last string."""
    for data, docs, places, offsets in _slabs(texts, length):
        raw = np.frombuffer(data, np.uint8)
        ids = buckets.of(raw, q)
        chosen = leftmost_least(ids, length - q + 1)
        ends = np.append(places[1:], len(raw))
        owner = np.repeat(np.arange(len(docs)), ends - places)[: len(chosen)]
        starts = np.flatnonzero(np.arange(len(chosen)) + length <= ends[owner])
        if not len(starts):
            continue
        at = chosen[starts]
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
        lo, hi = starts[np.append(0, cut)], starts[np.append(cut, len(starts)) - 1]
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(view[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
        own = owner[lo]
        yield docs[own], lo - places[own] + offsets[own], hi - lo, chosen[lo] - lo, ids[chosen[lo]].view(np.int64), context.view(np.int64)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def find_runs(docs: DataFrame, length: int, q: int) -> DataFrame:
    def run(batches):
        buckets = Buckets(SLAB + 2 * length)
        for b in batches:
            ids, hashes, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            for d, lo, n, place, bucket, context in sampled_runs(texts, buckets, length, q):
                take, short = pa.array(d), [pa.array(x.astype(np.int32)) for x in (lo, n, place)]
                yield pa.record_batch([ids.take(take), hashes.take(take), pa.array(bucket), pa.array(context), *short], names=["doc_id", "text_hash", "bucket", "context", "lo", "n", "place"])

    rows = _named(docs).filter(F.octet_length("text") >= length)
    return rows.mapInArrow(run, "doc_id long, text_hash long, bucket long, context long, lo int, n int, place int")


def _with_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, text, of) of the documents in wanted(doc_id, text_hash, of); few other texts are shuffled."""
    rows = likely(_named(docs).filter(F.octet_length("text") >= length), wanted, "left_semi")
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])
    return rows.join(wanted, same).select(rows["doc_id"], rows["text_hash"], "text", "of")


def find_cells(docs: DataFrame, wanted: DataFrame, length: int, cell: int) -> DataFrame:
    """(doc_id, text_hash, a, b, open, core, hull) of the wanted runs' cells: starts a..b, whose places relative to the
    run's q-gram fall into one block of ``cell``. core identifies the bytes that all the block's strings share, hull those
    that any of them has (null if the text ends before), both with the block's place: equal strings have equal places, and blocks of two runs
    that lie on the same bytes don't."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest

        def rows(b, take, out):
            names = ["doc_id", "text_hash", "a", "b", "open", "core", "hull"]
            ids = [b.column(j).take(pa.array(take, pa.int32())) for j in (0, 1)]
            own = [pa.array([o[j] for o in out], k) for j, k in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
            hashes = [pa.array([o[j] for o in out], pa.uint64()).view(pa.int64()) for j in (3, 4)]
            return pa.record_batch([*ids, *own, *hashes], names=names)

        for b in batches:
            take, out = [], []
            for i in range(len(b)):
                text = b.column(2)[i].as_py()
                for r in b.column(3)[i].as_py():
                    lo, hi, at = r["lo"], r["lo"] + r["n"], r["lo"] + r["place"]
                    for block in range((at - hi) // cell, (at - lo) // cell + 1):
                        first, last = at - block * cell - cell + 1, at - block * cell
                        seed = block & 0xFFFFFFFF
                        whole = first >= 0 and last + length <= len(text)
                        whole = whole and not (first < lo and lo % SLAB == 0)  # a run cut at a slab: its other part has the block
                        take.append(i)
                        out.append((max(first, lo), min(last, hi), r["open"], digest(text[last : first + length], seed), digest(text[first : last + length], seed) if whole else None))
                    if len(out) >= FLUSH:
                        yield rows(b, take, out)
                        take, out = [], []
            yield rows(b, take, out)

    return _with_texts(docs, wanted, length).mapInArrow(run, "doc_id long, text_hash long, a int, b int, open boolean, core long, hull long")


def find_strings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, start, open, b0, b1) of every start in the wanted cells: the identifiers of the buckets that
    the string's first and last q-gram of half its length are in."""
    q = (length + 1) // 2

    def run(batches):
        buckets = Buckets(SLAB + 2 * length)

        def rows(b, parts):
            at = pa.array(np.concatenate([p[0] for p in parts]))
            cols = [b.column(0).take(at), b.column(1).take(at), *(pa.array(np.concatenate([p[j] for p in parts])) for j in range(1, 5))]
            return pa.record_batch(cols, names=["doc_id", "text_hash", "start", "open", "b0", "b1"])

        for b in batches:
            parts, size = [], 0
            for i in range(len(b)):
                data = np.frombuffer(b.column(2)[i].as_py(), np.uint8)
                for r in b.column(3)[i].as_py():
                    n = r["b"] - r["a"] + 1
                    ids = buckets.of(data[r["a"] : r["b"] + length], q).view(np.int64)
                    parts.append((np.full(n, i, np.int32), np.arange(r["a"], r["b"] + 1, dtype=np.int32), np.full(n, r["open"]), ids[:n], ids[length - q : length - q + n]))
                    size += n
                    if size >= FLUSH:
                        yield rows(b, parts)
                        parts, size = [], 0
            if parts:
                yield rows(b, parts)

    return _with_texts(docs, wanted, length).mapInArrow(run, "doc_id long, text_hash long, start int, open boolean, b0 long, b1 long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, cell: int = CELL) -> DataFrame:
    """(doc_id, text_hash, spans): spans of bytes covered by strings of ``length`` bytes that start elsewhere, too.

    Buckets are refined until they are decided; what is decided is used and never refined again.
    0: the q-gram that each string samples. A bucket of one run is done: nothing else can equal its strings.
    1: the run's context. Runs alike in it repeat with all their strings, and one of them stands for them from there on.
    2: in buckets that also hold a run without a twin, cells of strings. Cells alike in their hull repeat with all their
    strings; cells without a like in their core are done.
    3: in the cells that are left, string by string, on the identifiers of the first half's bucket and of that at the
    later offset where the second half begins.
    Counts are combined before shuffles and written before they are joined back. Both sides of such a join are then plain
    shuffles of tables, so Spark splits the rows of a passage that a third of all documents share over many tasks.
    """
    tables, q = Tables(docs.sparkSession, "substrings"), max(length * 8 // 25, 1)
    key = ["doc_id", "text_hash"]
    runs = tables.write(find_runs(docs, length, q))
    shared = tables.write(runs.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket"))
    left = tables.write(runs.join(shared, "bucket"))
    tables.drop(runs)
    contexts = left.groupBy("bucket", "context").agg(F.count("*").alias("times"), F.min(F.struct(*key, "lo", "n", "place")).alias("one"))
    contexts = tables.write(contexts)
    twins = left.join(contexts.filter("times > 1").select("bucket", "context"), ["bucket", "context"])
    mixed = contexts.groupBy("bucket").agg(F.count("*").alias("_kinds"), F.min("times").alias("_least")).filter("_kinds > 1 and _least = 1")
    asked = contexts.join(tables.write(mixed), "bucket").select("one.*", (F.col("times") == 1).alias("open"))
    asked = tables.write(asked.groupBy(*key).agg(F.collect_list(F.struct("lo", "n", "place", "open")).alias("of")))
    cells = tables.write(find_cells(docs, asked, length, cell))
    hulls = cells.filter("hull is not null").groupBy("core", "hull").agg(F.sum(F.when(F.col("open"), 1).otherwise(2)).alias("_n")).filter("_n > 1")
    cells = tables.write(cells.join(tables.write(hulls), ["core", "hull"], "left").withColumn("open", F.col("open") & F.col("_n").isNull()).withColumn("alike", F.col("_n").isNotNull()).drop("_n", "hull"))
    cores = cells.groupBy("core").agg(F.count("*").alias("_n"), F.max("open").alias("_open")).filter("_n > 1 and _open")
    wanted = cells.join(tables.write(cores), "core").groupBy(*key).agg(F.collect_list(F.struct("a", "b", "open")).alias("of"))
    strings = tables.write(find_strings(docs, tables.write(wanted), length))
    again = strings.groupBy("b0", "b1").agg(F.count("*").alias("_n"), F.max("open").alias("_open")).filter("_n > 1 and _open").select("b0", "b1")
    single = strings.filter("open").join(tables.write(again), ["b0", "b1"])
    spans = twins.select(*key, F.col("lo").alias("a"), (F.col("lo") + F.col("n") + length).alias("b"))
    spans = spans.unionAll(cells.filter("alike").select(*key, "a", (F.col("b") + length).alias("b")))
    spans = spans.unionAll(single.select(*key, F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    out = tables.write(spans.groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    tables.keep_only(out)
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_chars, spans (and kept, binary, if with_text) of every row of
    documents; n_chars counts the code points that begin in what is kept.

    Every byte covered by a ``length``-byte string that also starts anywhere else, in the same text or another, goes;
    strings are judged on the input. Null and empty texts have no bytes. Rows alike in doc_id and text are copies of
    each other like any; null doc_ids are rows like others; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = merged(spans)
                edges = [0, *(x for s in gone for x in s), len(text)]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(kept.translate(None, FOLLOWING)), [{"a": x, "b": y} for x, y in gone], kept if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_chars", "spans", "kept"]
            yield pa.record_batch([b.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    spans, rows = repeated_spans(docs, length), _named(docs)
    near, far = likely(rows, spans, "left_semi"), likely(rows, spans, "left_anti")
    same = near["doc_id"].eqNullSafe(spans["doc_id"]) & (near["text_hash"] == spans["text_hash"])
    near = near.join(spans, same, "left").select(near["doc_id"], "text", "spans")
    rows = near.unionByName(far.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_chars long, spans array<struct<a:int,b:int>>, kept binary")
    return out if with_text else out.drop("kept")


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    """remove_repeats with what is kept as text: U+FFFD stands there for a code point of which only some bytes went."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("text", F.make_valid_utf8(out["kept"].cast("string"))).drop("spans", "kept")
