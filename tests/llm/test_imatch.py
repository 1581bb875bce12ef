"""I-Match fingerprints against their SQL and a slow version of the edited texts."""

import hashlib
import random

import duckdb
import pytest

from acoustics_spark.llm import imatch

DOCS = "doc_id long, text string, _guest int, next_text string, n_chars long"


def edited(texts):
    out = []
    for k, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[: len(t) - half] + texts[(k + 1) % len(texts)][:half])
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(3, 9))) for _ in range(900)]
    out = [" ".join(draw.choice(words).title() for _ in range(draw.randrange(1, 90))) for _ in range(260)]
    return [*out, out[3], "", None, "?", "é", "x" * 5000, "🙂 ab " * 40, out[3]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], DOCS)


def test_fingerprints_equal_sql(spark, texts, monkeypatch):
    monkeypatch.setattr(imatch, "DOCS_PER_RANGE", 20)
    ids = random.Random(1).sample(range(-500, 5000), len(texts))
    rows = list(zip(ids, texts))
    got = imatch.fingerprints(frame(spark, rows)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    documents = frame(spark, rows).select("doc_id", "text").toPandas()  # noqa: F841
    want = con.sql(imatch.oracle_sql()).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c
    in_order = [t or "" for _, t in sorted(rows)]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited(in_order)]
    by_text = {}
    for t, f in zip(in_order, got.fingerprint):
        assert by_text.setdefault(t, f) == f
    assert got.near_edited.mean() > 10 * got.near_next.mean() and got.near_edited.between(0, 1).all()


def test_repeated_and_null_ids_and_a_single_row(spark):
    rows = [(1, "a bc def"), (1, "a bc def"), (None, "nothing at all"), (2, "gh ij kl mn")]
    out = imatch.fingerprints(frame(spark, rows)).collect()
    in_order = ["nothing at all", "a bc def", "a bc def", "gh ij kl mn"]
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for t in edited(in_order))
    assert sorted(r.edited_sha256 for r in out) == want and sum(r.near_next == 1 for r in out) == 1
    only = imatch.fingerprints(frame(spark, [(5, "alone here")])).first()
    assert only.near_next == 1 and only.edited_sha256 == hashlib.sha256(b"alonealone").hexdigest()
    assert imatch.fingerprints(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = imatch.op12_imatch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
