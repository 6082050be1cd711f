"""Operator 1: quality rules with adaptive thresholds.

Every document gets integer measures.  For each language and source the measures
of the documents that pass the base rules go into a mergeable quantile sketch: a
histogram whose buckets keep six significant bits, so a quantile is off by at most
1/32 of its value, two sketches merge by adding counts, and the result does not
depend on the order of merging.

No cutoff is fixed.  The limit of a measure in a group is a high (or low) quantile of
the group's sketch plus ``REACH`` times its mean deviation from the median, which is
positive as soon as any document differs.  ``LEVELS`` holds the quantiles.  A group's
sketch is merged with ``PRIOR`` documents' worth of its language's sketch and as much
of the one over all, so that a small group follows its parents and a large one
itself, without a switch between them.  The limits are joined to the documents and
the filter applied.

Defined results: null or empty text has no words and fails the base rule; null
``lang`` or ``source`` is a group of its own; repeated rows each get a row and count
each; ties at a limit are kept; texts are read whole, whatever their length; extra
columns of any name pass through ``filter_documents`` untouched; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, prepare, scratch, small, table

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Per sketched measure: the quantile (in thousandths) that an upper or a lower limit starts from.
LEVELS = {"symbol_bp": (900, None), "dup_bp": (995, None), "repeat_bp": (995, None), "word_len": (950, 50)}
REACH = 3
#: Documents that each parent sketch counts for in a group's, and the fractions that counts are held in.
PRIOR = 100
UNIT = 1024

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, lines with a word, repeated lines, words in repeated 3-word windows."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, last = Counter(windows), -1
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return (n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated)


@F.pandas_udf(MEASURES)
def _measures(text):
    import pandas as pd

    return pd.DataFrame([measure(x) for x in text], columns=MEASURES.names)


#: Not to be repeated: else filters on the measures are pushed below them and take each one again.
_measures = _measures.asNondeterministic()


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_m``: the counts and the integer rates derived from them."""
    return docs.withColumn("_m", _measures("text"))


def _rates(df: DataFrame) -> DataFrame:
    rate = lambda a, b, k: F.expr(f"CASE WHEN _m.{b} > 0 THEN ({k} * _m.{a}) div _m.{b} ELSE 0 END")
    return (
        df.withColumn("_base_failed", F.expr(f"_m.n_words < {MIN_WORDS} OR 100 * _m.n_repeat_words > 50 * _m.n_words"))
        .withColumn("_symbol_bp", rate("n_symbols", "word_chars", 10000))
        .withColumn("_dup_bp", rate("n_dup_lines", "n_lines", 10000))
        .withColumn("_repeat_bp", rate("n_repeat_words", "n_words", 10000))
        .withColumn("_word_len", rate("word_chars", "n_words", 100))
    )


def sketches(rated: DataFrame) -> DataFrame:
    """One row per (lang, source, measure, bucket) with its count; sketches merge by summing ``n``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_{m}").alias("v")) for m in LEVELS]))
    step = "CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT)"
    return (
        rated.filter("NOT _base_failed").select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*")
        .withColumn("bucket", F.expr(f"v - v % {step}"))
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    )


def blended(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, measure, bucket, w): each group's sketch merged with its share of its parents', in UNITs of a document."""
    groups = sketch.groupBy("lang", "source", "measure").agg(F.sum("n").alias("total"))
    own = sketch.select("lang", "source", "measure", "bucket", (F.col("n") * UNIT).alias("w"))
    parts = [own]
    for keys in (["lang"], []):
        sums = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        totals = sketch.groupBy(*keys, "measure").agg(F.sum("n").alias("t"))
        totals = totals.select(*[F.col(k).alias(f"t_{k}") for k in keys], F.col("measure").alias("t_measure"), "t")
        on = sums.measure == totals.t_measure
        for k in keys:
            on = on & sums[k].eqNullSafe(totals[f"t_{k}"])
        share = F.expr(f"({UNIT} * least({prior}, t) * n) div t").alias("w")
        up = sums.join(totals, on).select(*[F.col(k).alias(f"u_{k}") for k in keys], F.col("measure").alias("u_measure"), "bucket", share)
        on = groups.measure == up.u_measure
        for k in keys:
            on = on & groups[k].eqNullSafe(up[f"u_{k}"])
        parts.append(groups.join(up, on).select("lang", "source", "measure", "bucket", "w"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("lang", "source", "measure", "bucket").agg(F.sum("w").alias("w"))


def quantile(level: int, at: str = "h", total: str = "total") -> Column:
    """The least bucket of the list ``at`` of (bucket, w) that has ``level`` thousandths of the weight at or below it."""
    return F.expr(
        f"aggregate({at}, named_struct('c', 0L, 'q', CAST(NULL AS BIGINT)), (a, x) -> named_struct("
        f"'c', a.c + x.w, 'q', CASE WHEN a.q IS NULL AND a.c + x.w >= ({level} * {total} + 999) div 1000 THEN x.bucket ELSE a.q END), a -> a.q)"
    )


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Per (lang, source): ``hi_<measure>`` and ``lo_<measure>``; a group's list has at most a few hundred buckets a measure."""
    x = blended(sketch, prior).groupBy("lang", "source", "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("h"), F.sum("w").alias("total"))
    x = x.withColumn("mid", quantile(500))
    x = x.withColumn("spread", F.expr("aggregate(h, 0L, (a, y) -> a + y.w * abs(y.bucket - mid)) div total"))
    limits = []
    for m, (hi, lo) in LEVELS.items():
        of = lambda c: F.max(F.when(F.col("measure") == m, c))  # noqa: B023, E731
        limits.append(of(quantile(hi) + REACH * F.col("spread")).alias(f"hi_{m}"))
        if lo is not None:
            limits.append(of(quantile(lo) - REACH * F.col("spread")).alias(f"lo_{m}"))
    return x.groupBy("lang", "source").agg(*limits)


def _judged(rated: DataFrame, limits: DataFrame) -> DataFrame:
    t = small(limits.select(F.col("lang").alias("_t_lang"), F.col("source").alias("_t_source"), *[F.col(c).alias(f"_{c}") for c in limits.columns if c[:3] in ("hi_", "lo_")]))
    ok = F.lit(True)
    for m, (_, lo) in LEVELS.items():
        ok = ok & (F.col(f"_{m}") <= F.col(f"_hi_{m}"))
        if lo is not None:
            ok = ok & (F.col(f"_{m}") >= F.col(f"_lo_{m}"))
    joined = rated.join(t, rated.lang.eqNullSafe(t._t_lang) & rated.source.eqNullSafe(t._t_source), "left")
    return joined.withColumn("_kept", F.when(F.col("_base_failed"), False).otherwise(ok))  # a group without limits has failed documents only


def assess(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` for every row of ``docs``."""
    prepare(docs.sparkSession)
    rated = keep(_rates(with_measures(docs.select("doc_id", "lang", "source", "text")).drop("text")))
    with scratch() as stay:
        limits = stay(keep(thresholds(keep(sketches(rated)), prior)))
    judged = _judged(rated, limits)
    return judged.select("doc_id", "_m.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def filter_documents(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The thresholds are fixed first; the measures are then taken again while the
    rows stream by, which is cheaper than shuffling or storing the texts.
    """
    prepare(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns of any name, clashing ones included
    wide = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in ("lang", "source", "text")}
    rated = _rates(with_measures(wide.select(*[F.col(at[c]).alias(c) for c in at])).drop("text"))
    with scratch() as stay:
        limits = stay(keep(thresholds(keep(sketches(rated)), prior)))
    row = wide.select(F.struct(*names).alias("_row"), *[F.col(at[c]).alias(c) for c in at])
    out = _judged(_rates(with_measures(row)).drop("text"), limits).filter("_kept")
    return out.select("_row.*").toDF(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: From the table ``r`` of rated documents to each group's limits ``lim``.
_LIMITS = f"""v AS (
  SELECT lang, source, unnest([{", ".join(f"'{m}'" for m in LEVELS)}]) AS measure, unnest([{", ".join(LEVELS)}]) AS v FROM r WHERE NOT base_failed),
sk AS (SELECT lang, source, measure, v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS bucket, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT DISTINCT lang, source, measure FROM sk),
l AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure) AS t FROM (SELECT lang, measure, bucket, sum(n) AS n FROM sk GROUP BY ALL)),
e AS (SELECT *, sum(n) OVER (PARTITION BY measure) AS t FROM (SELECT measure, bucket, sum(n) AS n FROM sk GROUP BY ALL)),
mixed AS (SELECT lang, source, measure, bucket, sum(w) AS w FROM (
    SELECT lang, source, measure, bucket, {UNIT} * n AS w FROM sk
    UNION ALL SELECT g.lang, g.source, g.measure, bucket, {UNIT} * least({PRIOR}, t) * n // t FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure
    UNION ALL SELECT g.lang, g.source, g.measure, bucket, {UNIT} * least({PRIOR}, t) * n // t FROM g JOIN e ON g.measure = e.measure)
  GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS c, sum(w) OVER (PARTITION BY lang, source, measure) AS total FROM mixed),
p AS (SELECT *, min(bucket) FILTER (WHERE c >= (500 * total + 999) // 1000) OVER (PARTITION BY lang, source, measure) AS mid FROM c),
s AS (SELECT lang, source, measure, sum(w * abs(bucket - mid)) // max(total) AS spread FROM p GROUP BY ALL),
lim AS (SELECT lang, source, {{limits}} FROM p JOIN s USING (measure) WHERE p.lang IS NOT DISTINCT FROM s.lang AND p.source IS NOT DISTINCT FROM s.source GROUP BY lang, source)"""


def _sql_limits() -> str:
    at = lambda m, level, sign: f"min(bucket) FILTER (WHERE measure = '{m}' AND c >= ({level} * total + 999) // 1000) {sign} {REACH} * max(spread) FILTER (WHERE measure = '{m}')"
    out = [f"{at(m, hi, '+')} AS hi_{m}" for m, (hi, _) in LEVELS.items()]
    out += [f"{at(m, lo, '-')} AS lo_{m}" for m, (_, lo) in LEVELS.items() if lo is not None]
    return _LIMITS.format(limits=",\n  ".join(out)).replace("SELECT lang, source, min(bucket)", "SELECT p.lang, p.source, min(bucket)").replace("GROUP BY lang, source)", "GROUP BY p.lang, p.source)")


_OK = " AND ".join([f"{m} <= hi_{m}" for m in LEVELS] + [f"{m} >= lo_{m}" for m, (_, lo) in LEVELS.items() if lo is not None])

SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
w3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM (
  SELECT doc_id, i, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w) WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM w3 WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k > 1) AS n_dup_lines FROM ln GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbol_bp, CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS dup_bp,
  CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS repeat_bp, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_len FROM m),
{_sql_limits()}
SELECT r.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE {_OK} END AS kept
FROM r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source
"""
