"""Hierarchical language identification: the family first, then one-versus-one support vector machines within it."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Families of language codes. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMENSIONS = 1 << 12
SAMPLE_PER_LANGUAGE = 500
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
SLAB = 1 << 19


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))  # the pattern also has numerals such as a half


def grams(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """The places, in a hashed feature space, of all 1- to 4-grams of the lower-cased code points; None if there is no
    letter. Runs of anything but letters count as one space."""
    if not has_letter(text):
        return None
    clean = NOT_LETTERS.sub(" ", f" {text.lower()} ")
    points = np.frombuffer(clean.encode("utf-32-le"), np.uint32).astype(np.uint64)
    shift, out, mixed = np.uint64(64 - dimensions.bit_length() + 1), [], None
    for k, m in enumerate(MULTIPLIERS):
        own = points[k:] * np.uint64(m)
        mixed = own if mixed is None else (mixed[: len(own)] ^ (mixed[: len(own)] >> np.uint64(31))) * np.uint64(MULTIPLIERS[0]) + own
        out.append((mixed * np.uint64(MULTIPLIERS[3]) >> shift).astype(np.int32))
    return np.concatenate(out)


NOT_LETTERS = re.compile(r"[\W\d_]+")


def vector(places: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of the grams' shares: a vector of length 1."""
    counts = np.bincount(places, minlength=dimensions)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last a bias) of the squared-hinge support vector machine of rows x and y in -1, 1, each class of
    equal weight, by Newton steps whose systems are solved by conjugate gradients."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)).astype(np.float32) * np.float32(len(y) * c)
    w = np.zeros(x.shape[1], np.float32)
    cost = lambda w: 0.5 * float(w @ w) + 0.5 * float((weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        on = margin > 0
        xs, ws = x[on], weight[on]
        gradient = w - xs.T @ (ws * y[on] * margin[on])
        if np.linalg.norm(gradient) < 1e-3 * max(1.0, float(np.linalg.norm(w))):
            break
        step, r = np.zeros_like(w), -gradient
        p, rr = r.copy(), float(r @ r)
        for _ in range(30):
            hp = p + xs.T @ (ws * (xs @ p))
            a = np.float32(rr / float(p @ hp))
            step += a * p
            r = r - a * hp
            new = float(r @ r)
            if new < 1e-4 * float(gradient @ gradient):
                break
            p, rr = r + np.float32(new / rr) * p, new
        size, now = 1.0, cost(w)
        while size > 1e-3 and cost(w + np.float32(size) * step) > now:
            size /= 2
        if size <= 1e-3:
            break
        w = w + np.float32(size) * step
    return w


class Model:
    """A machine for each family against the rest, and one for each pair of a family's languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = {lang: FAMILY.get(lang, lang) for lang in self.langs}
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(family[lang], []).append(lang)
        labels, self.machines = np.array(langs), {}
        if len(self.members) > 1:
            for f, own in self.members.items():
                self.machines[f] = linear_svm(x, np.where(np.isin(labels, own), 1.0, -1.0))
        for own in self.members.values():
            for a, b in combinations(own, 2):
                of = np.isin(labels, [a, b])
                self.machines[a, b] = linear_svm(x[of], np.where(labels[of] == a, 1.0, -1.0))

    @classmethod
    def of(cls, parts: dict | None) -> Model | None:
        """The model with these attributes: plain data, which executors can read without this package."""
        out = cls.__new__(cls)
        out.__dict__.update(parts or {})
        return out if parts else None

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """(language, score): the family of largest margin, then the language with most pairwise votes (ties: the
        larger sum of margins). The score is the product of the two decisions' logistic margins."""
        margin = lambda k: float(v @ self.machines[k][:-1] + self.machines[k][-1])
        sigmoid = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        family, score = next(iter(self.members)), 1.0
        if len(self.members) > 1:
            margins = {f: margin(f) for f in self.members}
            family = max(margins, key=margins.get)
            score = sigmoid(margins[family])
        own = self.members[family]
        if len(own) == 1:
            return own[0], float(score)
        votes = {a: [0, 0.0, 1.0] for a in own}
        for a, b in combinations(own, 2):
            m = margin((a, b))
            for lang, s in ((a, m), (b, -m)):
                votes[lang][0] += s > 0
                votes[lang][1] += s
                votes[lang][2] = min(votes[lang][2], sigmoid(s))
        best = max(own, key=lambda a: (votes[a][0], votes[a][1]))
        return best, float(score * votes[best][2])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> Model | None:
    """Fits the machines on about ``sample`` labelled documents of each language (all, if there are fewer), chosen by a
    hash of their id and text among those that aren't held out; whole texts. None if there are none. What reaches the
    driver is a sparse vector a sampled document: ``sample`` * ``dimensions`` numbers a language at most."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.abs(F.xxhash64("doc_id", F.xxhash64("text")) % 1_000_003) / 1_000_003.0
    chosen = own.join(F.broadcast(sizes), "lang").filter(draw * F.col("n") < sample)  # one row a language

    def run(batches):
        for b in batches:
            langs, places, values = [], [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = grams(text, dimensions)
                if g is not None:
                    v = vector(g, dimensions)
                    at = np.flatnonzero(v)
                    langs.append(lang)
                    places.append(at.astype(np.int32))
                    values.append(v[at])
            cols = [pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.record_batch(cols, names=["lang", "at", "v"])

    rows = chosen.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, at array<int>, v array<float>").toArrow().to_pylist()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], len(r["at"]), r["at"][:50], r["v"][:50]))  # the same model whatever the order of tasks
    x = np.zeros((len(rows), dimensions), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["v"]
    return Model(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents, from whole texts alone.

    ``und`` with score 0 for null texts, texts without letters and where nothing was learned. Null doc_ids count as
    not held out and are rows like others; an empty table gives no rows; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # languages and pairs times ``dimensions`` numbers

    def run(batches):
        own = Model.of(known.value)
        for b in batches:
            langs, scores = [], []
            for text in b.column(2):
                t = text.as_py() or ""
                lang, score = "und", 0.0
                if own is not None and has_letter(t):
                    counts = np.zeros(dimensions, np.int64)
                    for at in range(0, len(t), SLAB):
                        g = grams(t[at : at + SLAB], dimensions)
                        if g is not None:
                            counts += np.bincount(g, minlength=dimensions)
                    lang, score = own.predict(np.sqrt(counts / counts.sum()))
                langs.append(lang)
                scores.append(score)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
