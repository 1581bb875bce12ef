"""Texts without a sign of a disguise have none: with and without the look for signs the spans are the same."""

import random

import pyarrow.parquet as pq
import pytest

from acoustics_spark.llm import pii

FORMS = [
    "fiveonetwothreefourfivesixseven90", "oneone two three four five six seven eight", "call plus 44 20 7946 0958 now", "PLUS 49 30 1234 5678", "double five one two three four five six seven",
    "fivedouble two one three four nine eight seven", "five1two3four5six7eight9", "null eins zwei drei vier fünf sechs sieben acht neun", "a.b at c dot org", "a_at_b_dot_com", "a [at] b [dot] com",
    "a&#64;b&period;com", "a @ b.com", "a@ b.org", "ten dot one dot two dot three", "one two dot zero dot zero dot one", "l23-456-7890 and +l 2O2 555 O1O0", "4111/1111/1111/1111", "４１１１ 1111 1111 1111",
    "аlice@example.com", "a​b@example.com", "ONE TWO THREE FOUR FIVE SİX SEVEN EİGHT NİNE", "ſix ſeven five four three two one nine eight", "pluſ 44 20 7946 0958", "a klammeraffe b punkt de", "a Klammeraffe b punKt de",
    "one", "1", "dot", "at", "@", "plus", "double", "un", "oh 7", "+", "_", "-", ", ", "(", "4111 1111", "word", "x.org",
]


@pytest.mark.parametrize(("text", "kinds"), [
    ("ring onefivetwothreefourfivesixseveneight today", ["phone"]), ("call plus 44 20 7946 0958 now", ["phone"]), ("at FIVEONETWO threefour fivesixseveneight nine", ["phone"]),
])
def test_disguises_that_had_no_sign(text, kinds):
    assert [k for k, _, _ in pii.find(text)[1]] == kinds


@pytest.mark.parametrize(("text", "spans"), [
    ("write to bob dot smith at example dot me", [(9, 40)]), ("mail sales at acme dot it, please", [(5, 25)]), ("see a dot b dot c dot d dot e dot f at x dot com", [(4, 48)]),
    ("look at this dot it is red", []), ("sales at acme dot it is", []), ("we met at noon dot it was", []), ("a dot " * 30_000 + "b", []),
])
def test_spoken_addresses_of_any_length_and_ends_that_are_words(text, spans):
    assert [(a, b) for _, a, b in pii.find(text)[1]] == spans


def test_signs_are_wider_than_rewritings(sf):
    r = random.Random(3)
    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()]
    texts += FORMS + [f"{a}{sep}{b}" for a in FORMS for b in FORMS for sep in (" ", "")]
    texts += [r.choice(("", " ")).join(r.choices([*FORMS, *pii.SPELLED], k=r.randrange(2, 14))) for _ in range(4000)]
    assert [t for t in texts if pii.hidden_spans(t) != pii.undone_spans(t)] == []
    assert sum(not pii.disguised(t) for t in texts) > 200
    assert all(pii.FOREIGN.search(c) for c in [*map(chr, pii._SAME), *pii.INVISIBLE])
