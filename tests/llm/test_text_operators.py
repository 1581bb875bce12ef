"""SimHash, packing, personal data and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from acoustics_spark.llm import decontaminate, packing, pii, simhash
from acoustics_spark.llm.components import connected_components
from acoustics_spark.llm.store import Tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, _text_hash string, token string"
ODD = [None, "", "   ", "word", "A b", "one two three", "one two three", "ONE two\tthree", "x" * 5000, "é " * 3000, "a\x0bb\x0cc\x1fd"]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "clash", "clash") for i, t in zip(ids, texts)], DOCS)


def near_texts(n=40, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        t = rng.choices(vocab, k=rng.choice([5, 60, 200]))
        out.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 3])):
            u = list(t)
            u[rng.randrange(len(u))] = rng.choice(vocab)
            out.append(" ".join(u))
    return out


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, ids, radius=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        least[root(i)] = d if least[root(i)] is None else min(least[root(i)], d)
    return [least[root(i)] for i in range(len(fps))]


def test_simhash_matches_all_pairs(spark):
    texts = ODD + near_texts() + ["one two three"] * 5
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps, range(len(texts)))
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 10


def test_simhash_of_synthetic_chains(spark):
    rng = random.Random(1)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(8):
            fps.append(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius in (2, 3):
        tables = Tables(spark, "t")
        got = dict(connected_components(simhash.ball_links(df, radius), tables).collect())
        want = slow_components([f & (2**64 - 1) for f in signed], signed, radius)
        groups = defaultdict(set)
        for f, w in zip(signed, want):
            groups[w].add(f)
        assert all(len({got.get(f, f) for f in g}) == 1 for g in groups.values())
        assert len({got.get(f, f) for f in signed}) == len(groups)


def test_drop_near_duplicates_keeps_one_row_of_each(spark):
    texts = ["a b c d", "a b c d", "A b c d", "other words are here", "null id", "a b c d"]
    out = simhash.drop_near_duplicates(table(spark, texts, [3, 5, 4, 7, None, 3]))
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(-1, "null id"), (3, "a b c d"), (7, "other words are here")]
    assert out.columns == table(spark, ["x"]).columns
    assert simhash.drop_near_duplicates(table(spark, [])).count() == 0


def test_components_of_paths_stars_and_null_links(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 199), (200, 199)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), Tables(spark, "t")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 160)} == {100} and got[200] == 199
    assert connected_components(spark.createDataFrame([], "u long, v long"), Tables(spark, "t")).count() == 0


@pytest.fixture(scope="module")
def slow_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


WHITE = [" a  b\n\nc ", "a \n b", "tab\tand nbsp 　 wide", "it's we'll  don't", "x ", " ", "\n", "12 345\n6 ½ ²", "<|endoftext|> a", "<|endoftext|>", "a <|endoftext|><|endoftext|>b  <|endoftext| >", "é́ ß 中文 字 ..,,!! a.b"]


def test_packing_is_whole_and_tight(spark, sf, slow_ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = table(spark, ODD + WHITE + ["word " * 9000], range(10_000, 10_001 + len(ODD + WHITE))).select("doc_id", "text")
    both = docs.unionByName(extra).coalesce(1)
    rows = packing.pack(both, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in both.collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for d, text in texts.items():
        own = sorted(pieces[d], key=lambda r: r.start)
        assert sum((r.ids for r in own), []) == slow_ids(text)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert {r.doc_tokens for r in own} == {sum(r.length for r in own)}
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == [sum(x.length for x in w[:i]) for i in range(len(w))]
        assert sum(r.length for r in w) <= 2048
    assert sum(sum(r.length for r in w) < 2048 for w in windows.values()) <= 1


def test_packing_of_nulls_and_nothing(spark):
    assert packing.pack(table(spark, [])).count() == 0
    rows = packing.pack(table(spark, [None, "", "a"], [None, 2, 2]).coalesce(1)).collect()
    assert [(r.doc_id, r.length, r.offset) for r in rows] == [(None, 1, 0), (2, 1, 1), (2, 2, 2)]


def test_sum_of_squares_keeps_few_windows_open():
    rng, packer, closed = random.Random(5), packing.Packer(100), 0
    for i in range(5000):
        closed += len(list(packer.add((i, 0), b"abcd" * rng.randint(1, 99))))
        assert packer.count.sum() == sum(map(len, packer.open.values()))
    assert packer.count.sum() < 500
    packer = packing.Packer(100, most_open=50)
    for i in range(500):
        list(packer.add((i, 0), b"abcd" * 70))
        assert packer.count.sum() <= 50


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_patterns_equal_plain_regular_expressions(sf):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t]
    rng = random.Random(2)
    texts += ["".join(rng.choices("a1.@+-% 0249()é\n", k=60)) for _ in range(3000)]
    assert all(pii.base_spans(t) == slow_base(t) for t in texts)
    assert sum(len(slow_base(t)) for t in texts) > 100


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to jane.doe [at] mail [dot] example [dot] com today", "email", "jane.doe [at] mail [dot] example [dot] com"),
        ("write to jane(at)example(dot)org.", "email", "jane(at)example(dot)org"),
        ("write to jane at example dot com now", "email", "jane at example dot com"),
        ("x jane&#64;example.com y", "email", "jane&#64;example.com"),
        ("x jane@example[.]com y", "email", "jane@example[.]com"),
        ("x jаne@exаmple.com y", "email", "jаne@exаmple.com"),
        ("x ｊａｎｅ＠example.com y", "email", "ｊａｎｅ＠example.com"),
        ("x jane​@example.com y", "email", "jane​@example.com"),
        ("host 192 dot 168 dot 1 dot 77 up", "ip", "192 dot 168 dot 1 dot 77"),
        ("host 10[.]20[.]30[.]40 up", "ip", "10[.]20[.]30[.]40"),
        ("call plus one five five five two three four nine eight seven six now", "phone", "plus one five five five two three four nine eight seven six"),
        ("call +1 (988) five five five 2 4 eight 5 now", "phone", "+1 (988) five five five 2 4 eight 5"),
        ("call five five five one two three four nine zero now", "phone", "five five five one two three four nine zero"),
        ("card ４３８７ 5130 3523 7269 x", "card", "４３８７ 5130 3523 7269"),
        ("card 4387.5130.3523.7269 x", "card", "4387.5130.3523.7269"),
        ("card 4387 5l30 3523 7269 x", "card", "4387 5l30 3523 7269"),
        ("call +l (988) 5SS-2485 x", "phone", "+l (988) 5SS-2485"),
        ("x jane_at_mail_dot_example_dot_com y", "email", "jane_at_mail_dot_example_dot_com"),
        ("mail jane dot doe at example dot com now", "email", "jane dot doe at example dot com"),
        ("mail jane@exαmple·cοm now", "email", "jane@exαmple·cοm"),
        ("host one nine two dot one six eight dot one dot 7 up", "ip", "one nine two dot one six eight dot one dot 7"),
        ("call plus one (nine eight eight) double five 5 two four eight six.", "phone", "plus one (nine eight eight) double five 5 two four eight six"),
        ("card ④③⑧⑦ 5130 3523 ⁷²⁶⁹ x", "card", "④③⑧⑦ 5130 3523 ⁷²⁶⁹"),
        ("card four three eight seven 5130 3523 7269 x", "card", "four three eight seven 5130 3523 7269"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, spans = pii.find(text)
    at = text.index(span)
    assert (kind, at, at + len(span)) in spans
    assert set(base) <= set(spans)


def test_clean_prose_has_no_hidden_spans(sf):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t]
    texts += ["un un un un un un un un un un un un un un", "they met at noon. dot com was one two three", "at the house, at the dot", "Привет мир, 2024 год"]
    for t in texts:
        base, spans = pii.find(t)
        assert spans == base, set(spans) - set(base)


def test_pii_query_and_redaction(spark):
    texts = ODD + ["mail a@b.co or c@d.e, ip 1.2.3.4 and 1.2.3.999", "jane at example dot com"]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(texts) and got[0].redacted is None and got[1].redacted == ""
    clean = {r.doc_id: r for r in pii.redact_documents(docs).collect()}
    assert clean[len(ODD)].text == "mail <EMAIL> or <EMAIL>, ip <IP> and 1.2.3.999"
    assert clean[len(ODD) + 1].text == "<EMAIL>" and clean[len(ODD) + 1].n_chars == 7
    assert pii.redact_documents(docs).columns == docs.columns


def slow_contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = defaultdict(set)
    for item, text in items:
        b = words(text)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            known[tuple(b[i : i + n])].add(str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in known:
                    hit |= set(range(j, j + n))
                    found |= known[tuple(w[j : j + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [3, 10_000])
def test_contamination_matches_brute_force(spark, block):
    rng = random.Random(8)
    vocab = ["the", "of", "a", "é", "Zürich", "x1", "b"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 13, 20, 30])))) for i in range(12)]
    items += [(50, None), (51, "..."), (7, "repeat me"), (60, items[3][1])]
    texts = list(ODD)
    for _ in range(60):
        t = " ".join(rng.choices(["Q", "the", "of", "w", "v"], k=rng.randint(0, 60)))
        if rng.random() < 0.6:
            t += "; " + rng.choice([x for _, x in items if x]).upper().replace("É", "é") + " " + t[:40]
        texts.append(t)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(table(spark, texts), bench, block=block).collect()}
    want = slow_contamination(texts, items)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for _, r in sorted(got.items())] == want
    assert 10 < sum(w[4] for w in want)


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id int, text string")
    assert {r.n_hit for r in decontaminate.contamination(table(spark, ODD), bench).collect()} == {0}
    assert decontaminate.contamination(table(spark, []), bench).count() == 0
    one = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    assert decontaminate.drop_contaminated(table(spark, ODD), one).count() == len(ODD) - 3
