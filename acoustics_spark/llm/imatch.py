"""Document fingerprints by I-Match with randomised lexicons; DataFrame operations only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sharding import _at_or_under
from .store import Tables

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # terms, which are what lies between
PLACE_BITS = 24  # terms are told apart by as many bits where documents are counted: the lexicon is 2 MB, whatever the corpus
LEAST_DOCS, MOST_SHARE = 2, 50  # the band: terms of LEAST_DOCS documents or more, and of at most one in MOST_SHARE
SCALES, CLASS_BITS = 6, 4  # 16 lexicons a scale, each of 1/16 of the terms, 1/64 .. 1/16384: long and short texts have some of few terms
CLASSES = 1 << CLASS_BITS
WHOLE, PART, NONE = 16, 4, "----"  # hex digits of the band's hash and of a lexicon's; a lexicon without a term of the text
DOCS_PER_RANGE, MOST_RANGES = 2000, 1 << 14


def term_numbers(text: Column) -> Column:
    """The distinct lower-cased terms of a text, sorted, each as the 60-bit number that its MD5 begins with."""
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("long")
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN)), "")
    return F.sort_array(F.transform(words, number))


def _bits(number: Column, first: int, n: int) -> Column:
    return F.shiftright(number, first).bitwiseAND((1 << n) - 1)


def lexicon(docs: DataFrame) -> DataFrame:
    """One row with ``lexicon``: a bit for each place of terms, set if the documents with a term there are in the band. The
    counts are combined before the shuffle; the array has 2 ** (PLACE_BITS - 6) longs."""
    places = F.array_distinct(F.transform(term_numbers(F.coalesce("text", F.lit(""))), lambda t: _bits(t, 0, PLACE_BITS)))
    total = docs.count()
    found = docs.select(F.explode(places).alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    found = found.filter((F.col("n") >= LEAST_DOCS) & (F.col("n") * MOST_SHARE <= total))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS INT))")
    longs = found.select(F.shiftright("place", 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = docs.sparkSession.range(1 << (PLACE_BITS - 6)).withColumnRenamed("id", "at").join(longs, "at", "left")
    sorted_ = F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(F.transform(sorted_, lambda x: x["bits"]).alias("lexicon"))


def with_fingerprint(rows: DataFrame, words: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the fingerprint of a text column: WHOLE digits for all its terms in the band, then PART digits for the terms
    in each randomised lexicon. A text without a term in the band has all its terms hashed, one without terms itself."""
    at = lambda t: F.get(F.col("_lexicon"), _bits(t, 6, PLACE_BITS - 6).cast("int"))
    rows = rows.withColumn("_all", term_numbers(F.col(text))).withColumn("_lexicon", words.scalar())
    rows = rows.withColumn("_0", F.filter("_all", lambda t: F.getbit(at(t), _bits(t, 0, 6).cast("int")) == 1)).drop("_lexicon")
    rows = rows.withColumn("_0", F.when(F.size("_0") > 0, F.col("_0")).otherwise(F.col("_all")))
    for s in range(1, SCALES):
        rows = rows.withColumn(f"_{s}", F.filter(f"_{s - 1}", lambda t: _bits(t, PLACE_BITS + 2 * s - 2, 2) == 0))  # noqa: B023
    field = PLACE_BITS + 2 * (SCALES - 1)
    digest = lambda terms, n: F.left(F.md5(F.array_join(terms.cast("array<string>"), ",")), F.lit(n))
    parts = [F.filter(f"_{s}", lambda t: _bits(t, field + CLASS_BITS * s, CLASS_BITS) == c) for s in range(SCALES) for c in range(CLASSES)]  # noqa: B023
    rows = rows.withColumn("_parts", F.array(*parts))
    whole = F.when(F.size("_all") > 0, digest(F.col("_0"), WHOLE)).otherwise(F.left(F.md5(text), F.lit(WHOLE)))
    lexicons = F.transform("_parts", lambda p: F.when(F.size(p) > 0, digest(p, PART)).otherwise(NONE))
    return rows.withColumn(name, F.concat(whole, F.array_join(lexicons, ""))).drop("_all", "_parts", *[f"_{s}" for s in range(SCALES)])


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes among the band's and those of the lexicons that either text has a term of."""
    def part(c: str, k: int) -> Column:
        return F.substring(c, WHOLE + PART * k + 1, PART)

    whole = (F.left(a, F.lit(WHOLE)) == F.left(b, F.lit(WHOLE))).cast("int")
    pairs = [(part(a, k), part(b, k)) for k in range(SCALES * CLASSES)]
    same = reduce(add, [((x == y) & (x != NONE)).cast("int") for x, y in pairs], whole)
    return same / reduce(add, [((x != NONE) | (y != NONE)).cast("int") for x, y in pairs], F.lit(1))


def with_next(docs: DataFrame, each: list[str]) -> DataFrame:
    """docs(doc_id, text, ..) with ``next_`` columns of ``each``: those of the next document in the order of doc_id (nulls
    first; ties by the text's hash), of the first after the last.

    Ids are parted into ranges by quantiles, at most MOST_RANGES numbers on the driver. A range's first row goes to the
    range before it as a guest, so texts are shuffled once, to ranges that windows then run over.
    """
    key = lambda c: F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("id"))
    ids = docs.select("doc_id")
    n = min(-(-ids.count() // DOCS_PER_RANGE) or 1, MOST_RANGES)
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []))
    rows = docs.withColumn("_range", _at_or_under(bounds, F.col("doc_id")))
    firsts = rows.select("doc_id", "_range").groupBy("_range").agg(F.min(key("doc_id")).alias("first"))
    order = Window.orderBy("_range")  # over one row a range
    before = F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy()))
    guests = firsts.select(F.col("first.id").alias("_id"), before.alias("_to"))
    rows = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    to = F.when(F.col("_to").isNull(), F.array("_range")).otherwise(F.array("_range", "_to"))
    rows = rows.select(*docs.columns, F.posexplode(to).alias("_guest", "_range"))
    own = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.select(*docs.columns, "_guest", *[F.lead(c).over(own).alias(f"next_{c}") for c in each]).filter("_guest = 0").drop("_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents(doc_id, text).

    The lexicon is of the terms of all documents. A null text is an empty one; a text of one code point or none is its own
    edited text; repeated rows and ids are rows, each the next of another; of a single row the next is itself; an empty
    table gives an empty result; other columns are ignored.
    """
    tables = Tables(docs.sparkSession, "imatch")
    words = tables.write(lexicon(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, words, "text", "fingerprint"), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"), "fingerprint", "next_fingerprint")
    rows = with_fingerprint(rows, words, "edited", "edited_fingerprint")
    near = likeness("fingerprint", "edited_fingerprint"), likeness("fingerprint", "next_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"))


def op12_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    def numbers(text: str) -> str:
        return rf"list_sort(list_transform(list_distinct(regexp_extract_all(lower({text}), '{BETWEEN.replace('[', '[^')}')), lambda w: ('0x' || md5(w)[1:15])::BIGINT))"

    band = f"(SELECT coalesce(list(place), []) FROM (SELECT place, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(t, lambda x: x & {(1 << PLACE_BITS) - 1}))) AS place FROM terms) GROUP BY place) WHERE n >= {LEAST_DOCS} AND n * {MOST_SHARE} <= (SELECT count(*) FROM documents))"
    field = PLACE_BITS + 2 * (SCALES - 1)
    parts = []
    for s in range(SCALES):
        for c in range(CLASSES):
            own = f"list_filter(b, lambda x: (x >> {PLACE_BITS}) & {(1 << 2 * s) - 1} = 0 AND (x >> {field + CLASS_BITS * s}) & {CLASSES - 1} = {c})"
            parts.append(f"CASE WHEN len({own}) > 0 THEN md5(array_to_string({own}, ','))[1:{PART}] ELSE '{NONE}' END")
    digest = f"CASE WHEN len(b) > 0 THEN md5(array_to_string(b, ','))[1:{WHOLE}] ELSE md5(text)[1:{WHOLE}] END || " + " || ".join(parts)

    def near(x: str, y: str) -> str:
        pair = [(f"{x}[{WHOLE + PART * k + 1}:{WHOLE + PART * (k + 1)}]", f"{y}[{WHOLE + PART * k + 1}:{WHOLE + PART * (k + 1)}]") for k in range(SCALES * CLASSES)]
        same = " + ".join([f"({x}[1:{WHOLE}] = {y}[1:{WHOLE}])::INT"] + [f"({a} = {b} AND {a} <> '{NONE}')::INT" for a, b in pair])
        return f"({same})::DOUBLE / (1 + " + " + ".join(f"({a} <> '{NONE}' OR {b} <> '{NONE}')::INT" for a, b in pair) + ")"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
pairs AS (SELECT *, coalesce(lead(text) OVER o, first(text) OVER (ORDER BY doc_id)) AS after, coalesce(lead(doc_id) OVER o, first(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d WINDOW o AS (ORDER BY doc_id)),
terms AS (SELECT {numbers('text')} AS t FROM d),
band AS (SELECT DISTINCT unnest({band}) AS place),
texts AS (SELECT doc_id, 0 AS edited, text FROM d UNION ALL SELECT doc_id, 1, text[1:n - n // 2] || after[1:n // 2] FROM pairs),
own AS (SELECT doc_id, edited, text, {numbers('text')} AS t FROM texts),
held AS (SELECT doc_id, edited, list_sort(list(x)) AS b FROM (SELECT doc_id, edited, unnest(t) AS x FROM own) JOIN band ON x & {(1 << PLACE_BITS) - 1} = place GROUP BY ALL),
hashed AS (SELECT own.doc_id, own.edited, text, coalesce(b, t) AS b FROM own LEFT JOIN held ON own.doc_id = held.doc_id AND own.edited = held.edited),
f AS (SELECT doc_id, edited, sha256(text) AS sha, {digest} AS fp FROM hashed)
SELECT p.doc_id, n::BIGINT AS n_chars, e.sha AS edited_sha256, a.fp AS fingerprint, e.fp AS edited_fingerprint, {near('a.fp', 'e.fp')} AS near_edited, {near('a.fp', 'x.fp')} AS near_next
FROM pairs p JOIN f a ON a.doc_id = p.doc_id AND a.edited = 0 JOIN f e ON e.doc_id = p.doc_id AND e.edited = 1 JOIN f x ON x.doc_id = next_id AND x.edited = 0
"""
