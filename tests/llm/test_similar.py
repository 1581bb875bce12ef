"""The pipeline's near-duplicate groups against all pairs."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from acoustics_spark.llm import similar, simhash  # noqa: E402


def slow_groups(rows):
    """The least doc_id that pairs of five-word Jaccard similarity 0.8 or more reach."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def texts():
    """Copies, chains of near copies, copies at the bound, a shared license line, short and empty texts."""
    r, out = random.Random(5), []
    word = lambda: f"w{r.randrange(3000)}"
    for _ in range(25):
        base = [word() for _ in range(r.choice([4, 5, 9, 30, 104, 250]))]
        for _ in range(r.choice([1, 2, 5])):
            out.append(base + r.choice([[], "all rights reserved under the terms of this free license".split()]))
            base = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                base[r.randrange(len(base))] = word()
    fixed = [f"x{i}" for i in range(94)]  # 90 shingles: 80 of 100 in common, and one fewer
    out += [fixed, fixed[:84] + [f"z{i}" for i in range(10)], fixed[:83] + [f"v{i}" for i in range(11)]]
    hot = [f"h{i}" for i in range(150)]
    for i in range(40):
        out.append(list(hot))
        for _ in range(2):
            out[-1][r.randrange(150)] = f"k{r.randrange(9999)}"
    return list(enumerate([*(" ".join(w) for w in out), "", None, "One", "one"]))


def test_groups_equal_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert got == slow_groups(rows) and len(set(got.values())) < len(rows) - 40


def passages(n=70):
    """Unlike texts that share a passage, some of them with near copies."""
    r, out = random.Random(9), []
    passage = [f"p{i}" for i in range(25)]
    for k in range(n):
        base = [f"q{r.randrange(9999)}" for _ in range(r.choice([40, 60, 90]))] + passage
        out.append(list(base))
        if k % 5 == 0:
            base[r.randrange(30)] = f"k{k}"
            out.append(base)
    return list(enumerate(" ".join(w) for w in out))


@pytest.mark.parametrize("block", [2, 8])
def test_large_buckets_meet_by_parts(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    for rows in (texts(), passages()):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()} == slow_groups(rows)


def test_pairs_that_share_many_parts_are_made_once(spark, tmp_path):
    """Near copies that are all components of their own, each in 40 buckets with all others."""
    tables = similar.Tables(spark, "test")
    left = tables.write(spark.range(30).selectExpr("id as node", "100 as n", "0 as at", "id as root").crossJoin(spark.range(40).selectExpr("id * 7 - 100 as token")))
    near = tables.write(spark.range(30).selectExpr("id as node", *[f"0L as w{i}" for i in range(similar.WORDS)]))
    pairs = similar._across(left, tables.write(similar._mixed(left)), near, tables, similar.FIRST).collect()
    assert len(pairs) == 30 * 29 // 2 == len({tuple(p) for p in pairs})


@pytest.mark.parametrize("order", ["none", "backwards"])
def test_counts_of_shingles_change_no_group(spark, monkeypatch, order):
    """They order shingles alone: the groups are the same without any, and with the frequent ones held for the rarest."""
    rows, real = texts(), similar.common_shingles

    def common(docs, tables, width):
        h, n = real(docs, tables, width)
        return (h[:0], n[:0]) if order == "none" else (h, n.max() + 1 - n)

    monkeypatch.setattr(similar, "common_shingles", common)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()} == slow_groups(rows)


def test_similar_sets_share_a_part_and_unlike_ones_hardly_do():
    r, met = np.random.default_rng(4), 0
    for _ in range(3000):
        n = int(r.integers(1, 400)) if r.random() < 0.7 else int(r.integers(1, 12))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        keep = int(r.integers(int(np.ceil(0.8 * len(a))), len(a) + 1))
        more = r.integers(0, 2**63, int(r.integers(0, max(len(a) // 4, 1) + 1)), dtype=np.uint64)
        b = np.unique(np.concatenate([r.choice(a, keep, replace=False), more]))
        same, both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 5 * same >= 4 * both:
            met += 1
            assert set(similar.part_keys(a).tolist()) & set(similar.part_keys(b).tolist())
    assert met > 1000
    shared = r.integers(0, 2**63, 12, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, r.integers(0, 2**63, 108, dtype=np.uint64)])) for _ in range(60)]
    keys = [set(similar.part_keys(x).tolist()) for x in sets]
    assert sum(bool(keys[i] & keys[j]) for i in range(60) for j in range(i)) < 0.2 * 60 * 59 / 2


def test_parities_never_exceed_the_difference(spark):
    """Neither in full nor folded to fewer places, for sizes up to the bound apart; and they do turn far pairs away."""
    r, rows = np.random.default_rng(3), []
    for _ in range(300):
        n = int(r.integers(1, 900))
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - int(r.integers(0, n // 9 + 2))], r.integers(0, 2**63, int(r.integers(0, n // 9 + 2)), dtype=np.uint64)])
        far = np.concatenate([a[n // 2 :], r.integers(0, 2**63, n - n // 2, dtype=np.uint64)])
        for x in (b, far):
            same, both = len(np.intersect1d(a, x)), len(np.union1d(a, x))
            rows.append((len(a), similar.parities(a).tolist(), len(x), similar.parities(x).tolist(), 5 * same >= 4 * both, same < 0.4 * both))
    df = spark.createDataFrame(rows, "nu int, u_bits array<long>, nv int, v_bits array<long>, similar boolean, far boolean")
    for at in "uv":
        df = df.select("*", *[w.alias(f"{at}_w{i}") for i, w in enumerate(similar.few_words(df[f"{at}_bits"]))])
    got = df.select("similar", "far", similar._near("nu", "u_", "nv", "v_").alias("near")).collect()
    assert all(x.near for x in got if x.similar) and sum(x.similar for x in got) > 50
    assert not any(x.near for x in got if x.far) and sum(x.far for x in got) > 250


def test_stage_drops_near_copies_beyond_the_fingerprint_radius(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert bin(simhash.fingerprint(text[6].encode()) ^ simhash.fingerprint(text[145].encode())).count("1") > 2
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert kept == set(slow_groups(sorted(text.items())).values()) and 145 not in kept and 6 in kept
