"""Collocations against their SQL, and the sketch against plain counts."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from acoustics_spark.llm import phrases

DOCS = "doc_id long, text string, lang string, size int, n long, phrase string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    words = ["the", "of", "Red", "fox", "é-la", "ou\x00x", "runs", "a'b", "x" * 400, *(f"w{k}" for k in range(30))]
    weights = [30, 20, 9, 9, 9, 5, 5, 5, 2, *[1] * 30]
    ends = [" ", " ", "\t ", "  ", " ", ". ", ",", "\n", "\x0b", ";x "]
    out = []
    for k in range(150):
        text = "".join(draw.choices(words, weights)[0] + draw.choice(ends) for _ in range(draw.randrange(0, 120)))
        if k % 3 == 0:
            text += " new york city hall " * 3
        out.append((k, text, draw.choice(["en", "en", "de", None, "und"])))
    return [*out, out[0], (None, out[3][1], "en"), (900, None, "en"), (901, "", None), (902, "..!", "xx"), (903, "the the the the the the the", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 2, "clash") for i, t, g in rows], DOCS)


@pytest.mark.parametrize(("least", "most", "power"), [(5, 40, None), (2, 2000, 14), (12, 3, 20)])
def test_collocations_equal_sql(spark, rows, monkeypatch, least, most, power):
    monkeypatch.setattr(phrases, "AT_ONCE", 500)
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), least, most, power).collect()))
    documents = frame(spark, rows).toPandas()  # noqa: F841
    want = sorted(duckdb.sql(phrases.oracle_sql(least, most)).fetchall())
    assert want and got == want and any(" york city" in r[2] for r in got)


def test_the_sketch_loses_nothing_frequent_and_leaves_out_most(spark, rows):
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "cast(text AS binary) AS text")
    power, least = 16, 20
    bitmaps = []
    for _ in phrases.LEVELS:
        bitmaps.append(phrases.frequent_cells(docs, bitmaps, power, least))
    found = {(r.lang, r.phrase): r.n for r in phrases.exact_counts(docs, bitmaps, power).collect()}
    every = Counter()
    for _, text, lang in rows:
        for piece in b" ".join(phrases.tokens((text or "").encode())).split(b"."):
            words = piece.decode().split(" ")
            words = [w for w in words if w]
            every.update((lang or "und", " ".join(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert all(found[p] == n for p, n in every.items() if n >= least)
    assert len(found) < len(every) / 4


def partial_rows(spark, docs, bitmaps, power, monkeypatch):
    """Rows that the tasks of the last pass give, and exact_counts by language and phrase."""
    given, plain = [], type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda df, *by: given.append(df.count()) or plain(df, *by))
    counts = {(r.lang, r.phrase): r.n for r in phrases.exact_counts(docs, bitmaps, power).collect()}
    monkeypatch.setattr(type(docs), "groupBy", plain)
    return given[0], counts


def test_names_are_given_once_however_many_tasks(spark, rows, monkeypatch):
    power = 20
    docs = frame(spark, [(i, f"{t} n{j}", g) for j, (i, t, g) in enumerate(rows * 3)]).selectExpr("coalesce(lang, 'und') AS lang", "cast(text AS binary) AS text")
    bitmaps = []
    for _ in phrases.LEVELS:
        bitmaps.append(phrases.frequent_cells(docs, bitmaps, power, 20))
    few, counts = partial_rows(spark, docs.repartition(2), bitmaps, power, monkeypatch)
    many, again = partial_rows(spark, docs.repartition(16), bitmaps, power, monkeypatch)
    assert counts == again and len(counts) > 300
    monkeypatch.setattr(phrases, "MOST_COUNTED", 300)
    assert partial_rows(spark, docs.repartition(4), bitmaps, power, monkeypatch)[1] == counts
    assert many < 2 * len(counts)  # before, up to 16 times as many: a row a phrase and task


def test_phrases_that_share_a_cell_are_told_apart(spark, rows):
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "cast(text AS binary) AS text").repartition(5)
    every = np.zeros((phrases.ROWS, 1 << 11), np.uint8)
    every[:, ::512] = 255  # all cells of 32 groups of eight are set, so that each holds several words
    bitmaps = [every, every, every]
    kept = {(r.lang, r.phrase): r.n for r in phrases.exact_counts(docs, bitmaps, 14).collect()}
    words = Counter((lang or "und", w.decode()) for _, t, lang in rows for w in phrases.tokens((t or "").encode()) if w not in (b"", b"."))
    full = [np.full((phrases.ROWS, 1 << 11), 255, np.uint8)] * 3
    found = {(r.lang, r.phrase): r.n for r in phrases.exact_counts(docs, full, 3 + 11).collect()}
    assert all(found[w] == n for w, n in words.items()) and all(found[p] == n for p, n in kept.items())


def test_products_past_64_bits(spark):
    counts = [("en", 0, "", 9 * 10**14), ("en", 1, "a", 7 * 10**13), ("en", 1, "b", 3 * 10**13 + 1), ("en", 2, "a b", 10**13 + 3)]
    row = phrases.scored(spark.createDataFrame(counts, "lang string, size int, phrase string, n long")).first()
    assert row.score == 1000 * (10**13 + 3) * 9 * 10**14 // (7 * 10**13 * (3 * 10**13 + 1))


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
