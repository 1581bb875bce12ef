"""The spans that disguises add: against a slow version, and recall and precision on made-up text."""

import random
import re

import pyarrow.parquet as pq
import pytest
from test_text_operators import slow_base

from acoustics_spark.llm import pii


def slow_hidden(text):
    """Every character is carried with its place in the source; each rewriting makes a new list of them."""
    chars = [(c, i, i + 1) for i, c in enumerate(text)]

    def rewrite(pattern, put):
        nonlocal chars
        said, out, at = "".join(c for c, _, _ in chars), [], 0
        for m in re.finditer(pattern, said):
            new = put(m)
            if new is not None and new != m[0]:
                out += chars[at : m.start()] + [(c, chars[m.start()][1], chars[m.end() - 1][2]) for c in new]
                at = m.end()
        chars = out + chars[at:]

    rewrite(pii.LOOKALIKE, lambda m: "" if m[0] in pii.INVISIBLE else pii._SAME[ord(m[0])])
    rewrite(pii.ENTITY, lambda m: "@" if m[1] is None else ".")
    rewrite(pii.BRACKETED, lambda m: "@" if m[1] else ".")
    rewrite(pii.SPOKEN_IP, pii._spoken_ip)
    rewrite(pii.SPOKEN, pii._spoken)
    rewrite(pii.PLUS, lambda m: "+")
    rewrite(pii.LETTERED, pii._lettered)
    rewrite(pii.GROUPED, lambda m: re.sub("[^0-9]", "", m[0]) if pii._luhn(re.sub("[^0-9]", "", m[0])) else None)
    rewrite(pii.JOINED, lambda m: re.sub("(?i)[_-]at[_-]", "@", re.sub("(?i)[_-]dot[_-]", ".", m[0])))
    rewrite(pii.WORDED, pii._worded)
    rewrite(pii.SPACED, lambda m: pii._tight(m[0]))
    said = "".join(c for c, _, _ in chars)
    place = lambda a, b: (chars[a][1], chars[b - 1][2])
    out = [(k, *place(a, b)) for k, a, b in slow_base(said) if said[a:b] != text[slice(*place(a, b))]]
    bare = []
    for m in re.finditer("[0-9]+", said):
        s, e = place(*m.span())
        if 9 <= len(m[0]) <= 15 and m[0] not in "01234567890123456789" * 2 and said[m.start() - 1 : m.start()] != "+" and not any(c in "0123456789" or ord(c) in pii._SAME or c in pii.INVISIBLE for c in text[s:e]) and pii.CUE.search(text[max(0, s - 80) : s]):
            bare.append((s, e))
    return out + [("phone", *x) for x in bare if not any(s < x[1] and x[0] < e for _, s, e in out)]


NAMES = "jane bob.smith m_lee anna-k x.y.z info sales dr.who tom7".split()
HOSTS = "example.com mail.example.org shop-a.net uni.edu firma.de example.co.uk".split()
DIGITS = "zero one two three four five six seven eight nine".split()
HOMOGLYPHS = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "x": "х"}
BEFORE = ["Write to ", "Please contact ", "My address: ", "", "Or try ", "Anna said "]
AFTER = [" today.", ", thanks", " and wait", "", " (work)"]
PROSE = """look at example dot com for more|we met at noon dot com too|bob at work dot the end|room one zero one two five seven eight nine three two|they arrived at one dot and left
the dot com boom ended at last|count one two three four five six seven eight nine ten|a plus b is c plus two|he was good at maths dot why not|version 1.2.3 of 2019-05-06 at 10:30
take one or two of five, then three of four|at the house, at the dot|un deux trois, nous irons au bois|eins zwei drei vier fünf sechs sieben acht neun zehn|open at nine dot closed at five dot net loss
see page (at) home|the score was 12-3 at half time|see us at example dot org now|visit at example dot net|ISBN 0-306-40615-2 and 3.14159 26535|sold out at last dot com is dead|12 345 678 people [at] most
buy more at example dot com today|step one two three four five six seven eight nine of the dance|one one one one one one one one one one|Il est resté à la maison point final|order 66 items at 5.50 each dot""".replace("\n", "|").split("|")


def disguised(r):
    """(kind, plain, disguised)."""
    kind = r.choice(pii.KINDS)
    if kind == "email":
        plain = f"{r.choice(NAMES)}@{r.choice(HOSTS)}"
        local, host = plain.split("@")
        at, dot = r.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", "[.]"), ("&#64;", "."), (" AT ", " DOT "), ("{at}", ".")])
        if r.random() < 0.3:
            return kind, plain, "".join(HOMOGLYPHS.get(c, c) if r.random() < 0.5 else c for c in local) + r.choice("@＠") + host.replace("e", "е", 1).replace("u", "u\u200b", 1)
        return kind, plain, local.replace(".", dot if " dot" in dot.lower() else ".") + at + host.replace(".", dot)
    if kind == "ip":
        parts = [str(r.randrange(256)) for _ in range(4)]
        dot = r.choice([" dot ", "[.]", "(dot)", " [dot] ", "．"])
        if dot == " dot " and r.random() < 0.5:
            parts = [" ".join(DIGITS[int(c)] for c in p) for p in parts]
        return kind, ".".join(parts), dot.join(parts)
    if kind == "card":
        body = [r.randrange(10) for _ in range(15)]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(body[::-1]))
        groups = re.findall("....", "".join(map(str, [*body, -total % 10])))
        way = r.randrange(4)
        if way == 0:
            return kind, " ".join(groups), r.choice([".", "/", " - ", "_"]).join(groups)
        if way == 1:
            return kind, " ".join(groups), " ".join(groups).translate({ord(c): 0xFF10 + int(c) for c in r.sample("0123456789", 6)})
        if way == 2:
            return kind, " ".join(groups), " ".join(" ".join(DIGITS[int(c)] for c in g) for g in groups)
        return kind, " ".join(groups), "\u200b".join(groups)
    digits = "".join(r.choice("0123456789") for _ in range(r.randint(10, 12)))
    if len(set(digits)) < 3:
        digits = "1234567890"
    spelled = " ".join(DIGITS[int(c)] for c in digits)
    return kind, digits, r.choice(["plus " + spelled, "call " + spelled, "call plus " + digits, "+" + digits.translate({ord(c): 0xFF10 + int(c) for c in "02468"}), "＋" + digits, "phone: " + spelled.upper()])


def test_added_spans_equal_a_slow_version(sf):
    r = random.Random(12)
    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()][::3]
    texts += [" ".join(x for _ in range(3) for x in (r.choice(PROSE), r.choice(BEFORE) + disguised(r)[2] + r.choice(AFTER))) for _ in range(1500)]
    texts += ["".join(r.choices([*"a1.@+-% 0(", " at ", " dot ", "one", "two", "plus ", "[at]", "\u200b", "４", "а", "call "], k=25)) for _ in range(3000)]
    assert [t for t in texts if pii.hidden_spans(t) != slow_hidden(t)] == []
    assert sum(bool(slow_hidden(t)) for t in texts) > 1000


@pytest.mark.parametrize("kind", pii.KINDS)
def test_recall_and_precision_of_disguises(kind):
    """What is counted: a span of the kind that lies within what was put in, and all that text has besides."""
    r = random.Random(3)
    found = true = said = 0
    while true < 500:
        own, _, hidden = disguised(r)
        if own != kind:
            continue
        true += 1
        text = (head := f"{r.choice(PROSE)}. {r.choice(BEFORE)}") + hidden + r.choice(AFTER) + f". {r.choice(PROSE)}"
        spans = pii.find(text)[1]
        good = [x for x in spans if x[0] == kind and len(head) <= x[1] and x[2] <= len(head) + len(hidden)]
        found += bool(good)
        said += len(spans) > len(good)
    print(kind, "recall", found / true, "texts with another span", said / true)
    assert found >= 0.97 * true and said <= 0.02 * true


def test_prose_has_no_spans():
    assert [(t, pii.find(t)) for t in PROSE if pii.find(t)[1]] == []
