"""Each stage of the pipeline against a brute-force version of it."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_corpus_operators import slow_distances, slow_quality
from test_similar import slow_groups
from test_text_operators import slow_contamination

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from acoustics_spark.llm import packing as packing_operator  # noqa: E402
from acoustics_spark.llm import pii, quality  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents, and the rows after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name != "packing":
            assert got.columns == COLUMNS
        out.append(got.collect())
        docs = spark.createDataFrame(out[-1], got.schema)
    return out


def test_quality_stage(spark, sf, stages):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    x = {r.doc_id: [r[f"x{i}"] for i in range(4)] for r in quality.with_counts(rows).select("doc_id", *quality._features()).collect()}
    passed = [r for r in stages[0] if not slow_quality(r.text)[5]]
    fine, coarse = defaultdict(list), defaultdict(list)
    for r in passed:
        fine[r.lang, r.source].append(r.doc_id)
    for (lang, _), ids in fine.items():
        if len(ids) < 50:
            coarse[lang] += ids
    groups = [ids for ids in fine.values() if len(ids) >= 50] + [ids for ids in coarse.values() if len(ids) >= 50]
    groups.append([d for ids in coarse.values() if len(ids) < 50 for d in ids])
    want = set()
    for ids in filter(None, groups):
        want |= {d for d, far in zip(ids, slow_distances(np.array([x[d] for d in ids], float))) if far <= quality.CUTOFF}
    assert {r.doc_id for r in stages[1]} == want and len(want) > 150


def test_near_duplicate_stage(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1])
    assert sorted(r.doc_id for r in stages[2]) == sorted(set(slow_groups(rows).values())) and len(stages[2]) < len(rows)


def test_decontamination_stage(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = [w[4] for w in slow_contamination([r.text for r in stages[2]], items)]
    assert {r.doc_id for r in stages[3]} == {r.doc_id for r, d in zip(stages[2], dirty) if not d}


def test_personal_data_stage(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == set(before)
    for r in stages[4]:
        assert r.text == pii.redact(before[r.doc_id].text, pii.find(before[r.doc_id].text)[1]) and r.n_chars == len(r.text)
        assert not pii.base_spans(r.text)


def test_packing_stage(stages):
    tokens, pieces = packing_operator.Tokens(*packing_operator.default_tokens()), defaultdict(list)
    for r in stages[5]:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {r.doc_id for r in stages[4]}
    for r in stages[4]:
        ids = tokens.ids(r.text) + np.array([1], "<u4").tobytes()
        assert all(zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in pieces[r.doc_id])
        assert sum(p.length for p in pieces[r.doc_id]) == len(ids) // 4


def test_run_gives_the_stages_in_turn(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in stages[5] if r.start == 0)


def test_stages_take_empty_and_null_rows(spark, sf):
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, some, sf).collect()
            assert len(got) == {"quality": 0, "near_dedup": 2 if some is rows else 0}.get(name, 3 if some is rows else 0)
