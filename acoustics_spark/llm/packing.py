"""Packing token sequences by the sum-of-squares rule, one packer a partition."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

WINDOW = 2048
END_ID = 1
CACHED_WORDS = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Byte-level BPE ids as little-endian 32-bit numbers.

    The vocabulary splits before every single space, so a text without runs of white space is the words between its
    spaces, each a look-up in a bounded cache. Other texts are encoded whole, as are those with the string of a special
    token, which is that token wherever it stands.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding, self.special = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), tuple(special)
        self.run, self.cache = regex.compile(r"[\s\x1c-\x1f\x85]{2}").search, {}

    def raw(self, text: str) -> bytes:
        return np.array(self.coding.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.coding.encode(text, allowed_special="all"), "<u4").tobytes()
        if self.run(text) or text[-1:].isspace():
            return self.raw(text)
        first, *words = text.split(" ")
        cache, raw, out = self.cache, self.raw, [self.raw(first)]
        for w in words:
            got = cache.get(w)
            if got is None:
                got = raw(" " + w)
                if len(w) < 64:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[w] = got
            out.append(got)
        return b"".join(out)


class Packer:
    """Online packing into windows of ``size`` ids. ``count[h]`` is the number of open windows filled to level h; an
    item goes to the level at which the sum of squared counts of partly filled windows ends least (ties: the fullest).
    Sizes that don't go together would leave ever more windows open; at ``most_open`` they are flushed."""

    def __init__(self, size: int, first_id: int = 0, most_open: int = 4096):
        self.size, self.next, self.most_open = size, first_id, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def add(self, key: tuple, ids: bytes) -> Iterator[tuple]:
        """(key, start, ids, sequence, offset) of each piece whose window got full."""
        n, size = len(ids) // 4, self.size
        whole = n - n % size
        for at in range(0, whole, size):
            yield key, at, ids[4 * at : 4 * (at + size)], self.next, 0
            self.next += 1
        if whole == n:
            return
        s, count = n - whole, self.count
        levels = np.nonzero(count[: size - s + 1])[0]
        after = levels + s
        change = np.where(after < size, 2 * count[np.minimum(after, size - 1)] + 2, 1) - 2 * count[levels]
        level = 0  # a new window
        if len(levels) and change.min() <= 2 * count[s] + 1:
            level = int(levels[np.nonzero(change == change.min())[0][-1]])
        window = self.open[level].pop() if level else []
        if level:
            count[level] -= 1
        window.append((key, whole, ids[4 * whole :]))
        if level + s == size:
            yield from self.close(window)
        else:
            count[level + s] += 1
            self.open.setdefault(level + s, []).append(window)
            if not level and count.sum() > self.most_open:
                yield from self.flush()

    def close(self, window: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids in window:
            yield key, start, ids, self.next, at
            at += len(ids) // 4
        self.next += 1

    def flush(self) -> Iterator[tuple]:
        """The open windows: the emptiest are cut to fill the fullest, so at most one stays partly filled."""
        left = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        spare: list[tuple] = []  # pieces taken from the emptiest window
        while left:
            level, window = left.pop()
            while level < self.size and (spare or left):
                if not spare:
                    spare = left.pop(0)[1][::-1]
                key, start, ids = spare.pop()
                take = min(self.size - level, len(ids) // 4)
                window.append((key, start, ids[: 4 * take]))
                level += take
                if 4 * take < len(ids):
                    spare.append((key, start + take, ids[4 * take :]))
            yield from self.close(window)
        level, window = 0, []
        for piece in reversed(spare):  # under one window's worth
            window.append(piece)
        if window:
            yield from self.close(window)
        self.open, self.count = {}, np.zeros(self.size + 1, np.int64)


def default_tokens() -> tuple[str, str, dict[str, int]]:
    """The installed vocabulary's file, its pattern and its special token. Ids equal those of the vocabulary's JSON form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def pack(docs: DataFrame, size: int = WINDOW, end_id: int = END_ID, vocabulary: tuple[str, str, dict[str, int]] | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids).

    Every partition is packed on its own, in order and without a shuffle: texts are never moved, a hot source or group
    of copies costs nothing more, and a lost task is packed again to the same rows. Each partition leaves at most one
    window partly filled, so padding is under one window a partition. sequence_id holds the partition in its upper
    bits. Null and empty texts are the end id alone; null doc_ids and repeated rows are documents like others; an empty
    table gives no rows; other columns are ignored. A task holds one document, its batch and the few open windows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*(vocabulary or default_tokens()))
        packer = Packer(size, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4").tobytes()

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            cols = [[key[0] for key, *_ in pieces], [p[1] for p in pieces], [len(p[2]) // 4 for p in pieces]]
            cols += [[zlib.crc32(p[2]) for p in pieces], [key[1] for key, *_ in pieces], [p[3] for p in pieces], [p[4] for p in pieces]]
            cols = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                cols.append(pa.array([np.frombuffer(p[2], "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            return pa.record_batch(cols, names=[x.split()[0] for x in schema.split(", ")])

        pieces: list[tuple] = []
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for i, doc_id in enumerate(ids):
                raw = tokens.ids(texts[i].as_py() or "") + end
                pieces += packer.add((doc_id, len(raw) // 4), raw)
                if len(pieces) >= 4096:
                    yield out(pieces)
                    pieces = []
        pieces += packer.flush()
        yield out(pieces)

    schema = SCHEMA + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
