"""Personal data: plain patterns, and disguised identifiers found through offset-preserving normalisation."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run that fails at its start fails later, too
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@DOMAIN, found from each @ outwards: linear also in long runs without an @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        end = DOMAIN.match(text, at + 1)
        start = at
        while end and start > done and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        if end and start < at:
            out.append((start, end.end()))
            done = end.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, in code points, by kind as in KINDS and then start."""
    out = [("email", *s) for s in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# Look-alikes of Latin letters and signs. Full-width ASCII and decimal digits of other scripts follow by rule.
CYRILLIC_GREEK = "АВЕКМНОРСТУХЅІЈаеорсухѕіјԁһԛԝкмтӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρκτυεχγωıɑɡ"
AS_LATIN = "ABEKMHOPCTYXSIJaeopcyxsijdhqwkmtlABEZHIKMNOPTYXoaivpktuexywiag"
SIGNS, AS_ASCII = "。․·‐‑‒–—−﹫ⓐ﹢", "...------@@+"
SMALL, AS_SMALL = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉⓪①②③④⑤⑥⑦⑧⑨", "012345678901234567890123456789"
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits of the languages at hand.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# Ends of domains that are said with a spoken dot; those that are common words count where a sentence or its part ends.
TOP_LEVEL = (
    "com org net edu gov mil int info biz name dev app ai io co uk de fr es pt nl eu ch jp cn ru br ca au nz se dk fi pl cz ie kr mx ar cl ro gr hu tr za il tv cc xyz online site shop tech cloud"
).replace(" ", "|") + r"|(?:it|is|me|us)(?=\s*(?:[.,;:!?)\]\n]|\Z))"
# Words before "at" in ordinary prose, which are nobody's mailbox.
NO_MAILBOX = set(
    "look looked looking looks met meet meets meeting arrive arrived arrives stay stayed staying live lives lived living work works worked working be is was are were been being am not good bad best better "
    "here there back again up down out home now later early late start started starts begin began begins end ended ends stop stopped located based found find available open opened closed hosted held "
    "see seen saw watch read visit buy sold sell order ordered online page website store only one all them us me him her it you they we he she that this these those and or but then just right even still "
    "once twice laugh laughed smile smiled stare stared shout glance point pointed aim aimed throw sat sit sitting stood stand standing eat ate dinner lunch breakfast school class party people someone "
    "anyone everyone everything something nothing day night noon morning evening time year years hour hours more register registered log sign signed join joined listed posted published shown".split()
)
# Words in whose sentence a bare spelled number is a phone's.
PHONES = (
    "call|calls|called|calling|phone|phones|telephone|tel|mobile|cell|fax|dial|ring|text|texted|sms|whatsapp|number|reach|contact|hotline|voicemail|"
    "ruf|rufe|rufen|anruf|anrufen|telefon|handy|nummer|appel|appelez|appeler|téléphone|numéro|portable|llama|llame|llamar|teléfono|número|móvil|celular"
)

_SAME = {ord(a): b for a, b in zip(CYRILLIC_GREEK + SIGNS + SMALL, AS_LATIN + AS_ASCII + AS_SMALL)}
_SAME |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
_SAME |= {zero + i: str(i) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_AT, _DOT = "at|arroba|arobase|klammeraffe|ät", "dot|punkt|point|punto"
_GAP = r"(?:[\s,;/()-]{0,3}|\.)"  # a full stop and a space end a number
_NUMBER = rf"(?:(?:double|triple)\s+)?(?:{_WORD})"
LOOKALIKE = re.compile("[" + re.escape("".join(map(chr, _SAME)) + INVISIBLE) + "]")
SPOKEN = re.compile(rf"(?<!\w){_NUMBER}(?:{_GAP}(?:{_NUMBER}|[0-9]))+(?!\w)", re.I)
_PART = rf"(?:{_WORD}|[0-9]{{1,3}})(?:[\s-]{{1,2}}(?:{_WORD})){{0,2}}"
SPOKEN_IP = re.compile(rf"(?<![\w.]){_PART}(?:\s+(?:{_DOT})\s+{_PART}){{3}}(?!\w)", re.I)
BRACKETED = re.compile(rf"\s*[\[({{<]\s*(?:({_AT}|@)|({_DOT}|\.))\s*[\])}}>]\s*", re.I)
ENTITY = re.compile(r"&(?:#0*64|#x0*40|commat);|(&(?:#0*46|#x0*2e|period);)", re.I)
WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?<!dot\s)(?<!punkt\s)(?<!point\s)(?<!punto\s)(?:[A-Za-z0-9_%+-]+\s+(?:{_DOT})\s+)*+[A-Za-z0-9._%+-]+(?:\s+(?:{_AT})\s+|\s*@\s*)[A-Za-z0-9-]+(?:(?:\s+(?:{_DOT})\s+|\s*\.\s*)[A-Za-z0-9-]+)*(?:\s+(?:{_DOT})\s+)(?:{TOP_LEVEL})(?!\w)", re.I)
SAID_AT = re.compile(rf"\s+(?:{_AT})\s+", re.I)
SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: @ ?| ?@ )[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)*?\.[A-Za-z]{2,}(?!\w)")
HINT = re.compile(rf"[_-]dot[_-]|[\[({{<]\s*(?:{_AT}|{_DOT}|[@.])\s*[\])}}>]|&(?:#|commat|period)|\s(?:{_DOT})\s|\s@|@\s")  # of lower-cased text
JOINED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+]+[_-]at[_-][A-Za-z0-9]+(?:(?:[_-]dot[_-]|\.)[A-Za-z0-9]+)*[_-]dot[_-][A-Za-z]{2,}(?!\w)", re.I)
GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[^0-9A-Za-z]{1,3}[0-9]{4}){3}(?![0-9])")
LETTERED = re.compile(r"(?<![A-Za-z0-9])[+]?[0-9OolI(][0-9OolISB\x20().-]{7,30}[0-9OolISB](?![A-Za-z0-9])")
AS_DIGITS = str.maketrans("OolISB", "001158")
DIGIT = re.compile("[0-9]")
FOREIGN = re.compile("[\u00ad\u00b2\u00b3\u00b7\u00b9\u0131\u0251\u0261\u0370-\U0010ffff]")  # all of LOOKALIKE is here
LETTERS = re.compile(r"[^\W\d_]+")
PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9])", re.I)
CUE = re.compile(rf"(?<!\w)(?:{PHONES})(?!\w)[^.!?\n]*$|(?<!\w)at\W*$", re.I)
CUE_REACH = 80  # characters before a number in which a cue counts
NUMERALS = re.compile(rf"(?:{_WORD}|double|triple)+")
FOLDS = re.compile("[\u0130\u017f\u212a]")  # match ASCII letters where case is ignored, but str.lower doesn't give these


class Normalised:
    """A text after some rewriting, with the span of the source that each of its characters stands for."""

    def __init__(self, text: str):
        self.text, self.start = text, np.arange(len(text))
        self.end = self.start + 1

    def rewrite(self, pattern: re.Pattern, put) -> bool:
        """Replaces every match by put(match) (None: no change). All characters put stand for the whole match."""
        parts, starts, ends, at, changed = [], [], [], 0, False
        for m in pattern.finditer(self.text):
            new = put(m)
            if new is None or new == m[0]:
                continue
            a, b = m.span()
            parts += [self.text[at:a], new]
            starts += [self.start[at:a], np.repeat(self.start[a : a + 1], len(new))]
            ends += [self.end[at:a], np.repeat(self.end[b - 1 : b], len(new))]
            at, changed = b, True
        if changed:
            self.text = "".join([*parts, self.text[at:]])
            self.start = np.concatenate([*starts, self.start[at:]])
            self.end = np.concatenate([*ends, self.end[at:]])
        return changed

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _said(text: str) -> str:
    """The digits of a spelled or written number; double and triple repeat the next."""
    out, times = "", 1
    for w in re.findall(rf"double|triple|{_WORD}|[0-9]", text, re.I):
        w = w.lower()
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out, times = out + SPELLED.get(w, w) * times, 1
    return out


def _spoken(m: re.Match) -> str | None:
    """Digits for a run of spelled ones: three words at least and, so that a repeated word isn't a number, not all the
    same."""
    digits = _said(m[0])
    return digits if len(re.findall(_WORD, m[0], re.I)) >= 3 and len(set(digits)) >= 3 else None


def _spoken_ip(m: re.Match) -> str | None:
    parts = [_said(x) for x in re.split(rf"\s(?:{_DOT})\s", m[0], flags=re.I)]
    return ".".join(parts) if all(len(x) <= 3 and int(x) <= 255 for x in parts) else None


def _lettered(m: re.Match) -> str | None:
    """Letters that look like digits as such, in a number that is mostly digits and in each of whose groups one is."""
    groups = re.findall("[0-9OolISB]+", m[0])
    letters = sum(map(len, groups)) - len(_digits(m[0]))
    if m[0][0] == "+":
        groups = groups[1:]
    return m[0].translate(AS_DIGITS) if 0 < letters <= len(_digits(m[0])) // 2 and all(map(DIGIT.search, groups)) else None


@lru_cache(1 << 16)
def _numeral(word: str) -> bool:
    """Whether a run of letters is nothing but spelled digits."""
    return NUMERALS.fullmatch(word) is not None


def disguised(text: str) -> bool:
    """Whether some rewriting may change the text: False only if none does, as each one's matches hold one of the signs
    (a spoken number takes in whole runs of letters, all of them spelled digits)."""
    low = text.lower()
    if HINT.search(low) or FOLDS.search(text) or FOREIGN.search(text) and LOOKALIKE.search(text) or "plus" in low and PLUS.search(text):
        return True
    if DIGIT.search(text) and (GROUPED.search(text) or any(map(_lettered, LETTERED.finditer(text)))):
        return True
    return any(map(_numeral, LETTERS.findall(low))) and SPOKEN.search(text) is not None


def hidden_spans(text: str) -> list[tuple[str, int, int]]:
    """Identifiers that show only once disguises are undone, as spans of the source; only texts with a sign of one are
    rewritten."""
    return undone_spans(text) if disguised(text) else []


def undone_spans(text: str) -> list[tuple[str, int, int]]:
    """:func:`hidden_spans` of any text, whatever signs it has.

    The transducers run in turn: look-alikes to ASCII and invisible characters away, spelled digits and letters among
    digits to digits, bracketed, encoded, joined and spoken at/dot signs to @ and a dot. A match of a base pattern in the result counts if a rewriting took
    part in it; a bare spelled number of 9 to 15 digits counts as a phone after a word that tells of one (PHONES), unless
    it only counts up.
    """
    out: list[tuple[str, int, int]] = []
    n = Normalised(text)
    n.rewrite(LOOKALIKE, lambda m: "" if m[0] in INVISIBLE else _SAME[ord(m[0])])
    n.rewrite(ENTITY, lambda m: "." if m[1] else "@")
    n.rewrite(BRACKETED, lambda m: "." if m[2] else "@")
    bare: list[tuple[int, int]] = []
    n.rewrite(SPOKEN_IP, _spoken_ip)
    n.rewrite(SPOKEN, _spoken)
    n.rewrite(PLUS, lambda m: "+")
    n.rewrite(LETTERED, _lettered)
    n.rewrite(GROUPED, lambda m: d if _luhn(d := _digits(m[0])) else None)
    n.rewrite(JOINED, lambda m: re.sub("[_-]at[_-]", "@", re.sub("[_-]dot[_-]", ".", m[0], flags=re.I), flags=re.I))
    n.rewrite(WORDED, _worded)
    n.rewrite(SPACED, lambda m: _tight(m[0]))
    for kind, a, b in base_spans(n.text):
        s, e = n.source(a, b)
        if n.text[a:b] != text[s:e]:
            out.append((kind, s, e))
    for m in re.finditer(r"(?<![0-9+])[0-9]{9,15}(?![0-9])", n.text):
        s, e = n.source(*m.span())
        if not _counting(m[0]) and not DIGIT.search(text[s:e]) and LOOKALIKE.search(text[s:e]) is None and CUE.search(text[max(s - CUE_REACH, 0) : s]):
            bare.append((s, e))
    return out + [("phone", *x) for x in bare if not any(s < x[1] and x[0] < e for _, s, e in out)]


def _counting(digits: str) -> bool:
    return all((int(b) - int(a)) % 10 == 1 for a, b in zip(digits, digits[1:]))


def _worded(m: re.Match) -> str | None:
    """A spoken address as a written one, unless what stands for a mailbox ends in a word that prose has before "at"."""
    return None if SAID_AT.search(m[0]) and SAID_AT.split(m[0], maxsplit=1)[0].split()[-1].lower() in NO_MAILBOX else _tight(m[0])


def _tight(s: str) -> str:
    s = re.sub(rf"\s+(?:{_AT})\s+|\s*@\s*", "@", s, flags=re.I)
    return re.sub(rf"\s+(?:{_DOT})\s+|\s*\.\s*", ".", s, flags=re.I)


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans). A hidden span is added unless a base span of its kind already covers it."""
    base = base_spans(text)
    more = [h for h in hidden_spans(text) if not any(k == h[0] and s <= h[1] and h[2] <= e for k, s, e in base)]
    return base, sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else base


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span (overlapping ones as one, by the first's kind) replaced by <KIND>."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans, redacted): arrays of (kind, start, end) structs and the text without them, row by row.

    Nulls stay null in ``redacted`` and have no spans, as empty texts have none; repeated rows and null ids are rows
    like others. There is no shuffle, and a task holds one batch of whole texts.
    """
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            base, spans, clean = [], [], []
            for t in b.column(1).to_pylist():
                x, y = find(t or "")
                base.append([dict(zip(("kind", "start", "end"), s)) for s in x])
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in y])
                clean.append(redact(t, y) if y else t)
            yield pa.record_batch([b.column(0), pa.array(base, kind), pa.array(spans, kind), pa.array(clean, pa.string())], names=["doc_id", "base", "spans", "redacted"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {span}, spans {span}, redacted string")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced by <KIND> and ``n_chars`` counted anew (where there is one)."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            clean = [redact(t, find(t)[1]) if t else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
