"""Spelling variants: words one edit apart, by a trie self-join with active-node sets, and the forms that they stem from."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import Tables

RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS, LEAST_TIMES, RATIO = 6, 5, 5
EDITED = 199  # one run in so many loses a letter, by its checksum
GATHERED = 200_000  # words that a task counts before it gives them
LARGEST_GROUP = 1 << 14  # words of a trie; a larger group is parted
DOUBLINGS = 5  # a form has RATIO times the occurrences, so a chain of forms has under 5 ** 28 > 2 ** 63, 27 links


def runs(doc_id: str | None, text: bytes | None) -> Iterator[tuple[str, int]]:
    """(word, times) of a UTF-8 text, of LETTERS code points at least: its runs of letters with A-Z lower-cased, one in
    EDITED of them without the letter that its checksum with the document's id names."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = Counter(RUN.findall((text or b"").lower().decode(errors="replace")))  # bytes.lower knows ASCII alone
    for run, n in found.items():
        if len(run) < LETTERS:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % EDITED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LETTERS:
                continue
        yield run, n


def vocabulary(docs: DataFrame, least: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the distinct words of documents(doc_id, text) with ``least`` occurrences or more. A task adds up what it
    reads before rows are shuffled."""

    def run(batches):
        counts: dict[str, int] = defaultdict(int)

        def given():
            out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in runs(doc_id, text):
                    counts[word] += n
                if len(counts) >= GATHERED:
                    yield given()
        yield given()

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Trie:
    """Words under their common prefix. Nodes are numbers, the root is 0."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}  # of a node that ends one, its place
        for k, w in enumerate(words):
            node = 0
            for x in w:
                if x not in self.children[node]:
                    self.children[node][x] = len(self.children)
                    self.children.append({})
                node = self.children[node][x]
            self.word[node] = k

    def advanced(self, active: dict[int, int], x: str) -> dict[int, int]:
        """The nodes within one edit of a child by letter x, from those within one edit of its parent, each with its edits."""
        out: dict[int, int] = {}
        for v, d in active.items():
            if d:
                if (w := self.children[v].get(x)) is not None:
                    out.setdefault(w, 1)
                continue
            out.setdefault(v, 1)
            for y, w in self.children[v].items():
                if y != x:
                    out.setdefault(w, 1)
                    continue
                out[w] = 0
                for below in self.children[w].values():
                    out.setdefault(below, 1)
        return out

    def near(self) -> Iterator[tuple[int, int]]:
        """Places a < b of the words that are one edit apart: sets of active nodes are handed down from the root."""
        todo = [(0, {0: 0, **dict.fromkeys(self.children[0].values(), 1)})]
        while todo:
            node, active = todo.pop()
            if node in self.word:
                a = self.word[node]
                for v, d in active.items():
                    if d and (b := self.word.get(v, -1)) > a:
                        yield a, b
            for x, child in self.children[node].items():
                todo.append((child, self.advanced(active, x)))


def _first_difference(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def near_in_group(words: list[str], longest: int, head: int, tail: int) -> Iterator[tuple[int, int]]:
    """Places of the words one edit apart, of a group that shares its first ``head`` and last ``tail`` letters, with
    ``longest`` or one letter less; only pairs of which one has ``longest``, and whose first difference lies between what
    is shared: each pair is in one group so."""
    for a, b in Trie([w[head : len(w) - tail] for w in words]).near():
        if max(len(words[a]), len(words[b])) == longest and head <= _first_difference(words[a], words[b]) < longest - tail:
            yield a, b


def _keyed(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """rows(word, n, longest, head, tail) in the two groups of which one shares ``first`` more letters, one ``last`` more."""
    places = F.array(F.struct((F.col("head") + first).alias("_h"), F.col("tail").alias("_t")), F.struct(F.col("head").alias("_h"), (F.col("tail") + last).alias("_t")))
    out = rows.select("word", "n", "longest", F.inline(places)).withColumnsRenamed({"_h": "head", "_t": "tail"})
    return out.withColumn("key", F.concat_ws(":", "longest", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)")))


def _halved(rows: DataFrame) -> DataFrame:
    """Between what a group shares lie ``open`` letters of its longest words; an edit there is in the first half, and the
    second is shared, or the other way round."""
    left = F.expr("longest - head - tail")
    half = F.floor(left / 2).cast("int")
    return _keyed(rows, half, left - half)


def groups(words: DataFrame, tables: Tables, largest: int = LARGEST_GROUP) -> DataFrame:
    """(word, n, longest, head, tail, key): words in groups by prefix or suffix, so that any two one edit apart are together
    in one. Groups of over ``largest`` words are parted again until what is open is one letter: then a group holds no more
    words than there are letters, and one."""
    n = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(n, n + 1)).alias("longest"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    rows, done = _halved(rows), []
    while True:
        big = rows.filter("longest - head - tail > 1").groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > largest)
        big = tables.write(big.select("key"))
        if big.isEmpty():
            break
        done.append(rows.join(big, "key", "left_anti"))
        rows = _halved(rows.join(big, "key", "left_semi"))
    for d in done:
        rows = rows.unionByName(d)
    return rows


def near_words(words: DataFrame, tables: Tables, largest: int = LARGEST_GROUP) -> DataFrame:
    """(word, near, near_n): every two words(word, n) one edit apart, in both directions, each once.

    The trie of all words is parted by prefixes (and, for edits within a prefix, by what follows it), each part is one
    task's trie, of ``largest`` words at most, and active nodes are handed down in it.
    """

    def run(batches):
        out: list[tuple[str, str, int]] = []

        def given():
            b = pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])
            out.clear()
            return b

        def found(held):
            own = [h[1] for h in held]
            for a, b in near_in_group(own, *held[0][3:]):
                out.append((own[a], own[b], held[b][2]))
                out.append((own[b], own[a], held[a][2]))

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        found(held)
                    held = []
                held.append(row)
            if len(out) >= 1 << 14:
                yield given()
        if len(held) > 1:
            found(held)
        yield given()

    rows = groups(words, tables, largest).select("key", "word", "n", "longest", "head", "tail")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, near string, near_n long")


def with_roots(links: DataFrame, tables: Tables) -> DataFrame:
    """links(word, form) -> (word, form, root): the last of the forms that follow. Each round doubles what is followed."""
    out = tables.write(links.withColumn("root", F.col("form")))
    for _ in range(DOUBLINGS):
        before, ahead = out, out.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        out = tables.write(out.join(ahead, F.col("root") == F.col("_at"), "left").select("word", "form", F.coalesce("_next", "root").alias("root")))
        tables.drop(before)
    return out


def spelling_variants(docs: DataFrame, least: int = LEAST_TIMES, ratio: int = RATIO, largest: int = LARGEST_GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of documents(doc_id, text), see :func:`vocabulary`.

    form is the near word of most occurrences (ties: the least in code-point order) if it has ``ratio`` times the word's,
    root the last of the forms that follow (the word itself if it has none). A null or empty text has no words; a null
    doc_id counts as an empty one in the checksums; repeated rows count as often as they occur; a run of any length is one
    word; an empty table gives an empty result; other columns are ignored.
    """
    tables = Tables(docs.sparkSession, "spelling")
    words = tables.write(vocabulary(docs, least))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, tables, largest).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    rows = tables.write(rows)
    roots = with_roots(rows.filter("form is not null").select("word", "form"), tables).select("word", "root")
    out = tables.write(rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    tables.keep_only(out)
    return out


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
