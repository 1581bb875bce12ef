"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import pytest

from acoustics_spark.llm import spelling
from acoustics_spark.llm.store import Tables


def brute(rows, least=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= least}

    def one_apart(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    bases = ["reading", "reader", "aaaaaaab", "straße", "ÉCOLES", "x" * 300]
    words = []
    for k in range(1500):
        w = draw.choice(bases)
        for _ in range(draw.choice([0, 0, 1, 2])):
            i = draw.randrange(len(w))
            w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("abé") + w[i + 1 :], w[:i] + draw.choice("abé") + w[i:]])
        words.append(w.upper() if k % 7 == 0 else w)
    rows = [(k, draw.choice([" ", ", ", "9"]).join(words[k * 30 : k * 30 + 30])) for k in range(50)]
    return rows + [rows[0], (None, rows[1][1]), (90, None), (91, ""), (92, "a1b2 short")]


def test_variants_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(a, b, 0, "x") for a, b in texts], "doc_id long, text string, n long, word string")
    want = brute(texts, 2, 3)
    assert len(want) > 50 and any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1])
    assert found(spelling.spelling_variants(docs, 2, 3)) == want
    assert found(spelling.spelling_variants(docs, 2, 3, largest=2)) == want  # every group is parted as far as it goes


def test_a_hot_prefix_is_parted_and_each_pair_comes_once(spark, tmp_path):
    draw = random.Random(5)
    words = sorted({"prefix" + "".join(draw.choice("ab") for _ in range(draw.randrange(1, 8))) for _ in range(300)})
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    tables = Tables(spark, "test")
    assert spelling.groups(rows, tables, 10).groupBy("key").count().agg({"count": "max"}).first()[0] <= 10
    pairs = [tuple(r) for r in spelling.near_words(rows, tables, 10).select("word", "near").collect()]
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or a in cut(b) or b in cut(a)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
