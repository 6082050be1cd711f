"""Source distances against plain counting."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from keelstone.llm import divergence

from .test_operators import DOCS, SF, docs, empty  # noqa: F401

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(table, min_docs, top=50):
    """(lang, source, text) rows -> result rows."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    table = [tuple(x or "" for x in r) for r in table]
    out = []
    for lang in {r[0] for r in table}:
        in_docs, n = Counter(), defaultdict(Counter)
        for _, source, text in (r for r in table if r[0] == lang):
            terms = TERM.findall(low(text))
            in_docs.update(set(terms))
            n[source].update(terms)
        kept = [t for t in in_docs if in_docs[t] >= min_docs]
        share = lambda c, total: 1 + 1_000_000_000 * (c + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        total = {s: sum(c[t] for t in kept) for s, c in n.items()}
        p = {s: {t: share(c[t], total[s]) for t in kept} for s, c in n.items()}
        q = {t: share(sum(c[t] for c in n.values()), sum(total.values())) for t in kept}
        for s in n:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in n if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def result(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_terms():
    assert divergence.term_counts("Ab1cÉé ÀB_ab\x00Z Œœ".encode()) == Counter({b"ab": 2, "cÉé".encode(): 1, "Àb".encode(): 1, b"z": 1, "Œœ".encode(): 1})


def test_cases(spark, docs, empty):  # noqa: F811
    table = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    for least in (1, 2, 30):
        assert result(docs, min_docs=least) == plain(table, least)
    assert result(empty) == []


def test_many_buckets_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 7)
    monkeypatch.setattr(divergence, "CELLS", 20)
    df = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(1, "", "xx", "a", 0), (2, None, "xx", None, 0), (3, "12 3", "xx", "b", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    table = [tuple(r) for r in df.select("lang", "source", "text").collect()]
    want = plain(table, 30)
    assert result(df) == want and len(want) > 300
    monkeypatch.setattr(divergence, "ENTRIES", 100)
    assert result(df) == want
    both = spark.createDataFrame([tuple(x) for x in table] * 2, "lang string, source string, text string")
    assert result(both, min_docs=31) == plain(table * 2, 31)


def test_share_is_exact_beyond_doubles(spark):
    rows = [(c, t, v) for c in (0, 1, 10**9 + 7, 280 * 10**12) for t in (c, c + 10**6, 280 * 10**12) for v in (1, 10**7)] + [(0, 0, 0)]
    df = spark.createDataFrame(rows, "c bigint, t bigint, v bigint")
    for r in df.select("*", divergence.share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect():
        assert r.p == (1 + 10**9 * (r.c + 5) // (r.t + 5 * r.v) if r.v else 0 if not r.t else r.p)
