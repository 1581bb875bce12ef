"""Phrase collocations: merged count-min sketches say what may be frequent, two last passes count that alone and name it."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Tables

LONGEST, LEAST, MOST = 5, 100, 2000  # words of a phrase, its occurrences, phrases of a language
ROWS = 2  # of the sketch
LEVELS = ((1,), (2,), (3, 4, 5))  # sizes of phrases that one sketch is made of, after those before have said which may be frequent
BYTES_PER_CELL, LEAST_CELLS, MOST_CELLS = 64, 16, 23  # of text; powers of two of a row's cells
CHUNK = 1 << 14  # cells of a sketch that travel as one row
AT_ONCE = 1 << 20  # words that a task holds before it counts them
HELD = 1 << 19  # phrases that a task adds up before it gives them
PART = 1 << 12  # cells whose counts travel as one row
MOST_COUNTED = 1 << 22  # set cells that are counted as such; a task holds 20 bytes each
SALTS = 32  # parts that a language's phrases are ranked in first
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers of the hashes
MULTIPLIERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_SPACES = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text with A-Z lower-cased, ``.`` where a piece ends; no word holds one."""
    return (text or b"").lower().translate(_SPACES).replace(b".", b" . ").split(b" ")


class Words:
    """Words of one language as numbers, from 1; 0 is the end of a piece."""

    def __init__(self, lang: str):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.lang, self.seen, self.hashed = lang, [], []
        self.number[b"."], self.n = 0, 0

    def add(self, text: bytes | None) -> None:
        if words := [x for x in tokens(text) if x]:
            number = self.number
            self.seen.append(np.fromiter((number[x] for x in words), np.int64, len(words)))
            self.seen.append(np.zeros(1, np.int64))
            self.n += len(words)
            self.hashed.append((len(words) + 1, max(xxhash.xxh32_intdigest(text), 1)))

    def texts(self) -> np.ndarray:
        """By place, a hash of its text that is not 0."""
        many, hashes = zip(*self.hashed) if self.hashed else ((), ())
        return np.repeat(np.array(hashes, np.uint32), many)

    def sequence(self) -> np.ndarray:
        return np.concatenate(self.seen) if self.seen else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.number), np.uint64, len(self.number))


def grams(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, inside) for k of 1 .. LONGEST: by place, the hash of the k words from there, and whether they are of one
    piece. What depends on k alone in a hash is left out, as counts of a cell may add up whatever shares it."""
    at = words.sequence()
    one, inside = words.hashes()[at], at > 0
    h, ok = one, inside
    for k in range(1, LONGEST + 1):
        if k > 1:
            n = len(at) - k + 1
            if n <= 0:
                return
            h = (h[:n] ^ (h[:n] >> np.uint64(29))) * STEP + one[k - 1 :]
            ok = ok[:n] & inside[k - 1 :]
        yield k, h, ok


def cells(h: np.ndarray, row: int, power: int) -> np.ndarray:
    return ((h * MULTIPLIERS[row]) >> np.uint64(64 - power)).astype(np.int64)


def survivors(words: Words, bitmaps: list[np.ndarray], power: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, places) of the k-word phrases of one piece whose beginning and end, one word shorter, are places of the
    size before, and whose cells are set in the bitmap of their level if there is one; as far as the next level's sizes."""
    kept = np.zeros(0, bool)
    for k, h, ok in grams(words):
        level = next(i for i, sizes in enumerate(LEVELS) if k in sizes)
        if level > len(bitmaps):
            return
        if k > 1:
            ok = ok & kept[: len(h)] & kept[1 : len(h) + 1]
        where = np.flatnonzero(ok)
        if level < len(bitmaps):
            for row in range(ROWS):
                c = cells(h[where], row, power)
                where = where[(bitmaps[level][row, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1]
        kept = np.zeros(len(h), bool)
        kept[where] = True
        yield k, h, where


def _gathered(batches) -> Iterator[Words]:
    """Texts of batches(lang, text) as words, AT_ONCE of a language at a time (or one text), those of all at the end."""
    held: dict[str, Words] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = held.setdefault(lang, Words(lang))
            before = own.n
            own.add(text)
            total += own.n - before
            if total >= AT_ONCE:
                yield from held.values()
                held, total = {}, 0
    yield from held.values()


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a chunk of cells, a byte each, or where few are not zero their places and counts, which is shorter."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].tobytes() if 3 * len(at) < CHUNK else counts.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == CHUNK:
        return np.frombuffer(data, np.uint8)
    n = len(data) // 3
    out = np.zeros(CHUNK, np.uint8)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, np.uint8, n, 2 * n)
    return out


def frequent_cells(rows: DataFrame, bitmaps: list[np.ndarray], power: int, least: int) -> np.ndarray:
    """A bit a cell of the merged sketch of the next level's phrases, set if it counts ``least`` or more.

    Only phrases whose parts may be frequent by the levels before come into a sketch, so it is sparse. A task's sketch holds
    what it read, each count cut at ``least`` (at most 255), which sums cut there can't tell from the whole; chunks of
    cells meet by number and are added one after another. What comes to the driver is a bit a cell, 2 MB at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bitmaps)
    sizes = LEVELS[len(bitmaps)]

    def run(batches):
        sketch = np.zeros((ROWS, 1 << power), np.uint32)
        for words in _gathered(batches):
            for k, h, where in survivors(words, shared.value, power):
                if k in sizes:
                    for row in range(ROWS):
                        np.add.at(sketch[row], cells(h[where], row, power), np.uint32(1))
        chunks = sketch.reshape(-1, CHUNK)
        for i in np.flatnonzero(chunks.any(1)):
            data = _packed(np.minimum(chunks[i], least).astype(np.uint8))
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "counts"])

    def merge(batches):
        at, total = None, None

        def given():
            bits = np.packbits(total >= least)
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["chunk", "bits"])

        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if chunk != at:
                    if at is not None and (total >= least).any():
                        yield given()
                    at, total = chunk, np.zeros(CHUNK, np.int64)
                total += _unpacked(data)
        if at is not None and (total >= least).any():
            yield given()

    partial = rows.mapInArrow(run, "chunk int, counts binary")
    merged = partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
    out = np.zeros(((ROWS << power) // CHUNK, CHUNK // 8), np.uint8)
    for chunk, bits in merged.collect():
        out[chunk] = np.frombuffer(bits, np.uint8)
    return out.reshape(ROWS, -1)


class Survivors:
    """Numbers of the cells that are set in the first row of the bitmaps, those of all levels in one sequence."""

    def __init__(self, bitmaps: list[np.ndarray], power: int):
        self.set, self.power = [np.flatnonzero(np.unpackbits(b[0])) for b in bitmaps], power
        self.start = np.cumsum([0, *map(len, self.set)])
        self.level = {k: i for i, sizes in enumerate(LEVELS) for k in sizes}

    def __len__(self) -> int:
        return int(self.start[-1])

    def of(self, k: int, h: np.ndarray) -> np.ndarray:
        i = self.level[k]
        return self.start[i] + np.searchsorted(self.set[i], cells(h, 0, self.power))


def cell_totals(rows: DataFrame, bitmaps: list[np.ndarray], power: int) -> DataFrame:
    """(part, totals, chosen): by PART cells of Survivors how often their phrases occur (int64), and the least hash of a text
    that has one (uint32), or 0 where phrases of several 64-bit hashes share the cell, in one task or between tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmaps)
    kind = np.dtype([("at", "<u2"), ("hash", "<u8"), ("n", "<i8"), ("text", "<u4")])

    def add(into, at, h, n, text):
        """Texts of 0 stand for several phrases; places may repeat, those with unlike hashes do as well."""
        old = into["n"][at] > 0
        several = at[(text == 0) | old & (into["hash"][at] != h)]
        into["text"][at[~old]] = np.iinfo(np.uint32).max
        into["hash"][at] = h
        several = np.append(several, at[into["hash"][at] != h])
        np.add.at(into["n"], at, n)
        np.minimum.at(into["text"], at, text)
        into["text"][several] = 0

    def run(batches):
        numbers = Survivors(shared.value, power)
        found = {x: np.zeros(len(numbers), kind[x]) for x in ("hash", "n", "text")}
        for words in _gathered(batches):
            texts = words.texts()
            for k, h, where in survivors(words, shared.value, power):
                one, first, times = np.unique(h[where], return_index=True, return_counts=True)
                add(found, numbers.of(k, one), one, times, texts[where[first]])
        for part in range(-(-len(numbers) // PART)):
            own = {x: v[part * PART : (part + 1) * PART] for x, v in found.items()}
            if len(at := np.flatnonzero(own["n"])):
                out = np.zeros(len(at), kind)
                out["at"] = at
                for x, v in own.items():
                    out[x] = v[at]
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "cells"])

    def merge(batches):
        last, total = None, {}

        def given():
            data = [pa.array([total[x].tobytes()], pa.binary()) for x in ("n", "text")]
            return pa.record_batch([pa.array([last], pa.int32()), *data], names=["part", "totals", "chosen"])

        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != last:
                    if last is not None:
                        yield given()
                    last, total = part, {x: np.zeros(PART, kind[x]) for x in ("hash", "n", "text")}
                new = np.frombuffer(data, kind)
                add(total, new["at"].astype(np.int64), *(new[x] for x in ("hash", "n", "text")))
        if last is not None:
            yield given()

    partial = rows.mapInArrow(run, "part int, cells binary")
    return partial.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, totals binary, chosen binary")


def exact_counts(rows: DataFrame, bitmaps: list[np.ndarray], power: int, tables: Tables | None = None) -> DataFrame:
    """(lang, size, phrase, n): exact counts of the phrases whose cells are all set, and of all words as size 0.

    Cells are counted first, in arrays that tasks add up whatever the number of their phrases. A cell of one phrase then has its
    count, and only the text chosen for it (or its copies) names the phrase, so names are not given once a task. Where
    phrases share a cell, or beyond MOST_COUNTED cells, every task gives its counts of them. To the driver come four bytes a
    set cell, 16 MB at most.
    """
    tables, chosen = tables or Tables(rows.sparkSession, "phrases"), None
    if (many := len(Survivors(bitmaps, power))) <= MOST_COUNTED:
        totals = tables.write(cell_totals(rows, bitmaps, power))
        chosen = np.zeros((-(-many // PART), PART), np.uint32)
        for part, data in totals.select("part", "chosen").collect():
            chosen[part] = np.frombuffer(data, np.uint32)
        chosen = chosen.ravel()
    shared = rows.sparkSession.sparkContext.broadcast((bitmaps, chosen))

    def run(batches):
        bitmaps, chosen = shared.value
        numbers = Survivors(bitmaps, power)
        named: dict[tuple[str, bytes], int] = {}
        held: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

        def given():
            rows = [(lang, x, n, None) for lang, found in held.items() for x, n in found.items()]
            rows += [(lang, x, None, cell) for (lang, x), cell in named.items()]
            for i in range(0, len(rows), 1 << 16):
                langs, part, n, cell = zip(*rows[i : i + (1 << 16)])
                sizes = [x.count(b" ") + 1 if x else 0 for x in part]
                columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(part, pa.binary()), pa.array(n, pa.int64()), pa.array(cell, pa.int64())]
                yield pa.record_batch(columns, names=["lang", "size", "phrase", "n", "cell"])
            held.clear()
            named.clear()

        for words in _gathered(batches):
            at, texts, lang = words.sequence(), words.texts(), words.lang
            names, own = list(words.number), held[lang]
            own[b""] += int((at > 0).sum())
            for k, h, where in survivors(words, bitmaps, power):
                phrase = lambda i: b" ".join([names[j] for j in at[i : i + k]])  # noqa: B023, E731
                several = where
                if chosen is not None:
                    cell = numbers.of(k, h[where])
                    here = np.flatnonzero(chosen[cell] == texts[where])
                    _, first = np.unique(cell[here], return_index=True)
                    for j in here[first].tolist():
                        named[lang, phrase(where[j])] = int(cell[j])
                    several = where[chosen[cell] == 0]
                _, first, times = np.unique(at[several[:, None] + np.arange(k)], axis=0, return_index=True, return_counts=True)
                for i, m in zip(several[first].tolist(), times.tolist()):
                    own[phrase(i)] += m
            if len(named) + sum(map(len, held.values())) >= HELD:
                yield from given()
        yield from given()

    def spread(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.frombuffer(data, np.int64)
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array(part * PART + at, pa.int64()), pa.array(n[at])], names=["cell", "total"])

    found = rows.mapInArrow(run, "lang string, size int, phrase binary, n long, cell long")
    found = tables.write(found.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"), F.max("cell").alias("cell")))
    several = found.filter("cell is null").select("lang", "size", "phrase", "n")
    if chosen is None:
        return several
    whole = found.filter("cell is not null").join(totals.select("part", "totals").mapInArrow(spread, "cell long, total long"), "cell")
    return several.unionAll(whole.select("lang", "size", "phrase", F.col("total").alias("n")))


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)); counts are under 10 ** 16, so that no product passes a decimal's 38 digits."""
    whole = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(a) * whole(n), whole(left) * whole(right))


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """counts(lang, size, phrase, n) -> the phrases of two words or more with ``least`` occurrences: (lang, size, phrase, a,
    l, r, n, score) by the cut of the least score (ties: the first)."""
    parts = counts.filter((F.col("size") > 0) & (F.col("n") >= least)).select("lang", "size", "phrase", "n")
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    phrases = parts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("words"))
    cuts = phrases.select("lang", "size", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    joined = lambda first, many: F.array_join(F.slice("words", first, many), " ")
    cuts = cuts.select("lang", "size", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    rows = cuts.select("lang", "size", "phrase", "a", F.struct(exact_score(F.col("a"), F.col("total"), F.col("l"), F.col("r")).cast("long").alias("score"), "k", "l", "r", F.col("total").alias("n")).alias("cut"))
    return rows.groupBy("lang", "size", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def subsumed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) of the phrases(lang, size, phrase, a) whose words lie in a longer one as often as they occur at all."""
    words = F.split("phrase", " ", -1)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    inner = phrases.filter("size > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(most, ["lang", "phrase"]).filter(F.col("longer") >= F.col("a")).select("lang", "phrase")


def first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """rows(lang, phrase, a, score, ..) with rank up to ``most`` in their language; ranked in SALTS parts of it before."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, power: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of documents(text, lang): each language's best phrases.

    ``least`` is at most 255. A row of the sketch has 2 ** power cells, by default one for BYTES_PER_CELL bytes of text, at
    most 2 ** MOST_CELLS; a smaller one lets more phrases into the last pass, which drops those below ``least``, and
    changes no result. A null lang is ``und``, as is one of that name; a null or empty text has no words; repeated rows
    count as often as they occur; a word may be of any length; a table without phrases gives an empty result.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    if power is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        power = min(max((size // BYTES_PER_CELL).bit_length(), LEAST_CELLS), MOST_CELLS)
    bitmaps: list[np.ndarray] = []
    for _ in LEVELS:
        bitmaps.append(frequent_cells(rows, bitmaps, power, least))
    counts = tables.write(exact_counts(rows, bitmaps, power, tables).filter((F.col("size") == 0) | (F.col("n") >= least)))
    phrases = tables.write(scored(counts, least))
    left = phrases.join(subsumed(phrases), ["lang", "phrase"], "left_anti")
    out = tables.write(first_of_each(left, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    tables.keep_only(out)
    return out


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(least: int = LEAST, most: int = MOST) -> str:
    sub = "\n  UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {m - 1}], ' ') AS phrase, a FROM (SELECT lang, w, a, unnest(range(1, size - {m} + 2)) AS i FROM f WHERE size > {m})" for m in range(2, LONGEST))
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
sizes AS (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS size FROM words),
grams AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM sizes WHERE len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, any_value(w[i:i + size - 1]) AS w, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, 1000 * c.a * t.n // (x.a * y.a) AS score
  FROM cuts c JOIN totals t USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (
  {sub}) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {most}
"""
