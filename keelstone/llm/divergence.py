"""Operator 12: how far the sources of a language are from each other, by term frequencies.

Terms are runs of ASCII letters and non-ASCII characters, of which only A-Z are lowered.
One ``bytes.translate`` lowers the letters and blanks everything else, ``bytes.split``
cuts the terms, and a ``Counter`` per document gives occurrences and, by its keys, the
document counts.  Each task adds the counters of a (language, source) up and hands on
sums (at most ``ENTRIES`` terms at a time), so a hot source or word costs a row per task.

A language keeps the terms in at least ``MIN_DOCS`` of its documents.  Every group, and
the language as a whole, gives a kept term with ``count`` of its N kept occurrences the
smoothed share ``1 + floor(1e9 (count + 5) / (N + 5 V))``.  Shares are computed only
where a term occurs; the others of a group share one value.  Distances between sources
are summed over buckets of ``TERMS`` terms, each a small matrix of terms by sources, so
neither a language nor a source is ever one task's work.

Arithmetic is exact 64-bit division in two steps (``share``), good to 2.8e14
occurrences in a language; beyond that it raises an overflow.

Defined results: null text, lang and source count as ''; repeated rows are documents of
their own; a group without terms has distances like any other, 0 where nothing is kept;
ties rank by the UTF-8 order of the item; other columns are ignored whatever their names;
texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare, small, table

MIN_DOCS = 30
TOP = 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Distinct (group, term) sums that a task holds, terms of a bucket, and cells of a matrix.
ENTRIES = 500_000
TERMS = 512
CELLS = 1 << 20
#: One pass over the bytes: letters lowered, bytes of non-ASCII characters as they are, all else blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A sum's documents stand above its occurrences.
DOC = 1 << 44
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of a text."""
    return Counter(text.translate(TERM_BYTES).split())


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; every group has a row with the empty term."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple[str, str], dict[bytes, int]] = {}

        def flush():
            for (lang, source), s in sums.items():
                s[b""] = 0
                terms, packed = list(s), list(s.values())
                for k in range(0, len(terms), 1 << 16):
                    t, p = terms[k : k + (1 << 16)], packed[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t)), pa.array([source] * len(t)), pa.array([x.decode() for x in t]), pa.array([x % DOC for x in p], pa.int64()), pa.array([x // DOC for x in p], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            sums.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = sums.setdefault((lang, source), {})
                before, get = len(s), s.get
                for t, n in term_counts(text).items():
                    s[t] = get(t, 0) + n + DOC
                held += len(s) - before
                if held >= ENTRIES:
                    yield from flush()
                    held = 0
        yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH kept)), by long division in two steps that do not overflow; 0 where nothing is kept."""
    first, second = 32_000, SCALE // 32_000
    down = total + SMOOTH * kept
    up = (count + SMOOTH) * first
    div = lambda a, b: F.call_function("div", a, b)
    return F.when(down > 0, div(up, down) * second + div((up % down) * second, down) + 1).otherwise(F.lit(0)).cast("bigint")


def _distances(terms, sources):
    """Sums of the distances of every two sources over one bucket of terms."""
    import numpy as np
    import pandas as pd

    names = sources.sort_values("source", kind="stable").reset_index(drop=True)
    at = {s: k for k, s in enumerate(names["source"])}
    rest, n = names["rest"].to_numpy(dtype=np.int64), len(names)
    row, order = np.unique(terms["term"].to_numpy(dtype=object), return_inverse=True) if len(terms) else (np.empty(0), np.empty(0, int))
    col = terms["source"].map(at).to_numpy(dtype=np.int64)
    p = terms["p"].to_numpy(dtype=np.int64)
    total = np.zeros((n, n), np.int64)
    step = max(1, CELLS // max(1, n))
    for lo in range(0, len(row), step):
        here = (order >= lo) & (order < lo + step)
        shares = np.tile(rest, (min(step, len(row) - lo), 1))
        shares[order[here] - lo, col[here]] = p[here]
        for a in range(n):
            total[a, a + 1 :] += np.abs(shares[:, a + 1 :] - shares[:, a : a + 1]).sum(axis=0)
    a, b = np.triu_indices(n, 1)
    lang = sources["lang"].iloc[0] if n else ""
    s = names["source"].to_numpy(dtype=object)
    return pd.DataFrame({"lang": [lang] * len(a), "a": s[a], "b": s[b], "value": total[a, b]}).astype({c: object for c in ("lang", "a", "b")})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    by_term = counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = keep(by_term.filter((F.col("docs") >= min_docs) | (F.col("term") == "")))  # the empty term lists a language's groups
    cells = kept.select("lang", "term", "total", F.explode("by_source").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    sizes = kept.groupBy("lang").agg((F.count("*") - 1).alias("v"), F.sum("total").alias("all_n"))
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n")).join(small(sizes), "lang")
    groups = keep(groups.withColumn("rest", share(F.lit(0).cast("bigint"), F.col("group_n"), F.col("v"))).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("bigint")))
    known = cells.filter("term <> ''").join(small(groups), ["lang", "source"])
    known = known.withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v"))).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))

    sources = groups.select("lang", "source", "rest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"))
    sums = known.select("lang", "bucket", "term", "source", "p").groupBy("lang", "bucket").cogroup(sources.groupBy("lang", "bucket")).applyInPandas(_distances, "lang string, a string, b string, value bigint")
    both = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    pairs = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    above = known.withColumn("value", F.col("p") - share(F.col("total"), F.col("all_n"), F.col("v"))).filter("value > 0")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(w))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_P = lambda n, total: f"1 + (1000000000 * ({n} + 5)) // ({total} + 5 * v)"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS m, (SELECT count(*) FROM k WHERE k.lang = x.lang) AS v, (SELECT sum(total) FROM k WHERE k.lang = x.lang) AS l FROM (SELECT DISTINCT lang, source FROM d) x),
s AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P("coalesce(c.n, 0)", "m")} AS p, {_P("total", "l")} AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
