"""Quality rules and robust multivariate outliers; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .likely import without
from .store import Tables, own_name

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SCALE = 512  # features are whole numbers of 1/512, so sums are exact in any order
MIN_ROWS = 50
STEPS = 3
HALF = 0.5  # the share of rows in the determinant's subset: the highest breakdown point
CONSISTENCY = 2.11  # of that subset's covariance for 4 normal variables
CUTOFF = 23.51  # 0.9999 quantile of chi-square with 4 degrees of freedom
PRIOR_WORDS, PRIOR_LENGTH = 40, 5.0
BROADCAST_ROWS, SALTS = 50_000, 16  # a row of estimates has 15 numbers, so 6 MB at most are sent to all
#: Least standard deviation of each feature: most texts have no symbols or repeats at all, whose own spread is 0.
FLOORS = {"symbols": 0.04, "length": 0.06, "lines": 0.15, "repeats": 0.18}


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window that occurs at least twice among the words' windows. Windows are compared by
    64-bit hash; positions are sorted only in texts that repeat one."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            at = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
            return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"))
        return F.aggregate(let(pairs, twice), start, step, lambda a: a["n"])

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= window, 0).otherwise(count)


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash and the base counts of every row of documents; null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda s: F.translate(s, WHITE, "") != ""
    lines = F.filter(F.split(text, "\n", -1), has_word)
    words = F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text_hash"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("rep"))).alias("w"),
    )
    out = out.select("*", F.col("w.n").alias("n_words"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines")).drop("l", "w")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _features() -> list[Column]:
    """The transformed statistic vector: shares under a square root (small ones spread, large ones don't dominate) and
    the log of the mean word length; all drawn to the usual value where a text is short."""
    length = (F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS)
    out = {
        "symbols": F.asin(F.sqrt(F.least(F.col("n_symbols") / (F.col("word_chars") + 1), F.lit(1.0)))),
        "length": F.log(length),
        "lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)),
        "repeats": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50)),
    }
    return [F.round(out[k] * SCALE).cast("long").alias(f"x{i}") for i, k in enumerate(FLOORS)]


P = range(len(FLOORS))
CELLS = [(i, j) for i in P for j in P if j <= i]


def _whiten(mean: list[Column], cov: dict[tuple[int, int], Column]) -> list[Column]:
    """Columns m_i and w_ij: the mean and the inverse of the covariance's Cholesky factor, written out."""
    low: dict[tuple[int, int], Column] = {}
    for i, j in CELLS:
        rest = reduce(lambda a, k: a - low[i, k] * low[j, k], range(j), cov[i, j])
        low[i, j] = F.sqrt(rest) if i == j else rest / low[j, j]
    inv: dict[tuple[int, int], Column] = {}
    for j in P:
        for i in range(j, len(P)):
            inv[i, j] = 1 / low[i, i] if i == j else -reduce(lambda a, k: a + low[i, k] * inv[k, j], range(j + 1, i), low[i, j] * inv[j, j]) / low[i, i]
    return [m.alias(f"m{i}") for i, m in enumerate(mean)] + [inv[c].alias(f"w{c[0]}{c[1]}") for c in CELLS]


def _distance() -> Column:
    """The squared Mahalanobis distance of x0.. under m_i and w_ij."""
    z = [reduce(lambda a, b: a + b, [F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in P]
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _floor(i: int) -> float:
    return (list(FLOORS.values())[i] * SCALE) ** 2


def with_small(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a written table of one row a key, without moving a key's rows into one task: sent to all where it
    has BROADCAST_ROWS at most, else repeated for each of SALTS parts of every key."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.spark_partition_id() % SALTS).join(parts, [key, "_salt"], how).drop("_salt")


def minimum_covariance(rows: DataFrame, tables: Tables, steps: int = STEPS) -> DataFrame:
    """(grp, m_i, w_ij) from rows(grp, x0..): regularised minimum-covariance-determinant estimates of each group.

    Starts from medians and median absolute deviations; each concentration step takes the half of the rows that lie
    nearest and estimates from them, which never enlarges the determinant. All steps are combining aggregations with
    bounded state: percentiles are of rounded values, so a group of any size holds few distinct ones.
    """
    mid = tables.write(rows.groupBy("grp").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in P]))
    off = with_small(rows, mid, "grp").groupBy("grp").agg(*[F.percentile(F.abs(F.round(F.col(f"x{i}") - F.col(f"m{i}"))), F.lit(0.5)).alias(f"d{i}") for i in P])
    start = mid.join(off, "grp")
    cov = {(i, j): F.pow(1.4826 * F.col(f"d{i}"), 2) + _floor(i) if i == j else F.lit(0.0) for i, j in CELLS}
    est = tables.write(start.select("grp", *_whiten([F.col(f"m{i}") for i in P], cov)))
    for _ in range(steps):
        far = F.round(F.log2(1 + _distance()) * 64).cast("long")
        near = with_small(rows, est, "grp").select("grp", *[f"x{i}" for i in P], far.alias("far"))
        half = tables.write(near.groupBy("grp").agg(F.percentile("far", F.lit(HALF)).alias("most")))
        near = with_small(near, half, "grp").filter("far <= most")
        x = lambda i: F.col(f"x{i}").cast("double")  # noqa: E731  whole numbers: exact sums up to 2**53
        sums = near.groupBy("grp").agg(F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in P], *[F.sum(x(i) * x(j)).alias(f"s{i}{j}") for i, j in CELLS])
        mean = [F.col(f"s{i}") / F.col("n") for i in P]
        cov = {(i, j): CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j]) + (_floor(i) if i == j else 0.0) for i, j in CELLS}
        named = sums.select("grp", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[cov[c].alias(f"c{c[0]}{c[1]}") for c in CELLS])
        est = tables.write(named.select("grp", *_whiten([F.col(f"m{i}") for i in P], {(i, j): F.col(f"c{i}{j}") for i, j in CELLS})))
    return est


def _fine(lang: Column, source: Column) -> Column:
    """The group of a language and source, nulls being values of their own."""
    return F.xxhash64(lang.cast("string"), F.lit("/"), source.cast("string"), F.lit(2))


def quality(docs: DataFrame, min_rows: int = MIN_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, text_hash, fine, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of
    every row of documents.

    Rows that pass the base rules are judged in their group of language and source: those whose squared robust distance
    exceeds ``cutoff`` are not kept. Groups under ``min_rows`` rows are pooled by language, pools under it into one.
    Null languages and sources are values of their own; null and empty texts fail the base rules; null doc_ids and
    repeated rows are rows like others; an empty table gives no rows; other columns are ignored.
    """
    tables = Tables(docs.sparkSession, "quality")
    rows = with_counts(docs).select("*", *_features(), _fine(F.col("lang"), F.col("source")).alias("fine"), F.xxhash64("lang", F.lit(1)).alias("coarse"))
    rows = tables.write(rows.drop("lang", "source"))
    sizes = rows.filter("not base_failed").groupBy("fine", "coarse").agg(F.count("*").alias("n"))
    pools = sizes.filter(F.col("n") < min_rows).groupBy("coarse").agg(F.sum("n").alias("pool"))
    groups = sizes.join(pools, "coarse", "left")
    grp = F.when(F.col("n") >= min_rows, F.col("fine")).when(F.col("pool") >= min_rows, F.col("coarse")).otherwise(F.lit(0))
    groups = tables.write(groups.select("fine", grp.cast("long").alias("grp")))
    judged = with_small(rows.filter("not base_failed"), groups, "fine")
    est = minimum_covariance(judged.select("grp", *[f"x{i}" for i in P]), tables)
    out = with_small(rows, tables.write(groups.join(est, "grp")), "fine", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select("doc_id", "text_hash", "fine", *counts, kept.alias("kept"), "distance")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "fine", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that :func:`quality` rejects. The verdict hangs on text, language and source alone, so it
    is joined back by these, each distinct rejection once."""
    names = [own_name(docs, n) for n in ("_text", "_fine")]
    bad = quality(docs).filter("not kept").select(F.col("text_hash").alias(names[0]), F.col("fine").alias(names[1])).distinct()
    same = (F.xxhash64("text") == F.col(names[0])) & (_fine(F.col("lang"), F.col("source")) == F.col(names[1]))
    return without(docs, Tables(docs.sparkSession, "rejected").write(bad), same, names[0])


def oracle_sql(min_rows: int = MIN_ROWS, cutoff: float = CUTOFF, steps: int = STEPS) -> str:
    """The query op5_quality in DuckDB's SQL, in which a select may use its own aliases."""
    x, cells, floors = [f"x{i}" for i in P], [(i, j) for j in P for i in P if i >= j], [_floor(i) for i in P]
    whiten = []
    for i, j in cells:  # column by column, each from those before
        rest = f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + ")"
        whiten.append(f"sqrt({rest}) AS l{i}{j}" if i == j else f"{rest} / l{j}{j} AS l{i}{j}")
    for i, j in sorted(cells, key=lambda c: (c[0] - c[1], c)):
        sums = " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i))
        whiten.append(f"1 / l{i}{i} AS w{i}{j}" if i == j else f"-({sums}) / l{i}{i} AS w{i}{j}")
    distance = " + ".join("pow(" + " + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) + ", 2)" for i in P)
    zero = ", ".join(f"pow(1.4826 * d{i}, 2) + {floors[i]} AS c{i}{i}" if i == j else f"0.0 AS c{i}{j}" for i, j in cells)
    ctes = [
        r"""d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)""",
        r"""lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d)""",
        f"""win AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}))""",
        f"""rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1) GROUP BY rid)""",
        f"""counts AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN lines USING (rid) LEFT JOIN rep USING (rid))""",
        f"""feat AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  round(asin(sqrt(least(n_symbols / (word_chars + 1.0), 1.0))) * {SCALE})::BIGINT AS x0, round(ln((word_chars + {PRIOR_WORDS * PRIOR_LENGTH}) / (n_words + {PRIOR_WORDS}.0)) * {SCALE})::BIGINT AS x1,
  round(sqrt(n_dup_lines / (n_lines + 10.0)) * {SCALE})::BIGINT AS x2, round(sqrt(n_repeat_words / (n_words + 50.0)) * {SCALE})::BIGINT AS x3 FROM counts)""",
        """fine AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n FROM feat WHERE NOT base_failed)""",
        f"""judged AS (SELECT *, CASE WHEN n >= {min_rows} THEN concat('f', lang, '/', source) WHEN sum(CASE WHEN n < {min_rows} THEN 1 ELSE 0 END) OVER (PARTITION BY lang) >= {min_rows} THEN concat('c', lang) ELSE 'all' END AS grp FROM fine)""",
        f"""mid AS (SELECT grp, {", ".join(f"quantile_cont({c}, 0.5) AS m{i}" for i, c in enumerate(x))} FROM judged GROUP BY grp)""",
        f"""off AS (SELECT grp, {", ".join(f"quantile_cont(abs(round({c} - m{i})), 0.5) AS d{i}" for i, c in enumerate(x))} FROM judged JOIN mid USING (grp) GROUP BY grp)""",
        f"""e0 AS (SELECT *, {zero}, {", ".join(whiten)} FROM mid JOIN off USING (grp))""",
    ]
    for s in range(steps):
        sums = ", ".join([f"sum({c})::DOUBLE / count(*) AS m{i}" for i, c in enumerate(x)] + [f"sum(x{i} * x{j})::DOUBLE / count(*) AS q{i}{j}" for i, j in cells])
        cov = ", ".join(f"{CONSISTENCY} * (q{i}{j} - m{i} * m{j}) + {floors[i] if i == j else 0.0} AS c{i}{j}" for i, j in cells)
        ctes += [
            f"far{s} AS (SELECT j.grp, {', '.join(x)}, round(log2(1 + {distance}) * 64)::BIGINT AS far FROM judged j JOIN e{s} USING (grp))",
            f"near{s} AS (SELECT * FROM (SELECT *, quantile_cont(far, {HALF}) OVER (PARTITION BY grp) AS most FROM far{s}) WHERE far <= most)",
            f"s{s} AS (SELECT grp, {sums} FROM near{s} GROUP BY grp)",
            f"e{s + 1} AS (SELECT *, {cov}, {', '.join(whiten)} FROM s{s})",
        ]
    good = f"good AS (SELECT rid FROM judged JOIN e{steps} USING (grp) WHERE {distance} <= {cutoff})"
    named = ", ".join(f"{c}::BIGINT AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return f"WITH {', '.join([*ctes, good])} SELECT doc_id, {named}, base_failed, rid IN (SELECT rid FROM good) AS kept FROM feat"
