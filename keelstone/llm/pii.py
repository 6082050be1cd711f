"""Operator 4 [native]: personal data by patterns and bootstrapped contexts.

Base kinds are fixed patterns with checks.  Their matches are the seeds of a
bootstrap.  Instances are the base spans and every other identifier-like token (one
with two digits or an ``@``); the words next to an instance are its patterns (left
word, right word, two left words), a word with a digit or an ``@`` as its shape
(``<num>``, ``<at>``).  On the graph of patterns and distinct instance values
confidence flows back and forth, in millionths: a pattern's is the mean belief of its
instances, one unbelieved instance added; an instance's that of its best trusted
pattern; seeds stay at 1.  A pattern is trusted from a confidence of ``TRUST`` on if the beliefs of
its instances add up to ``SUPPORT``, so instances found in one round support new
patterns in the next, without any seed of their own.  After ``ROUNDS`` rounds, tokens
in the context of a trusted pattern are reported as kind ``context``, unless they
overlap a base span.

The possessive forms of the base patterns match the same strings as the plain ones
but do not backtrack, and start only where a run of their characters starts (or
where the last match ended), so long runs cost linear time.  The texts are read once;
positions come from one fold over lengths, kept in chunks so that a step copies little.

Defined results: null text is empty; spans are code points, end exclusive; rows that
agree in doc_id and text get the same spans; copies of an instance in a context count
once; ties do not matter, as scores are exact integers; texts are read whole, in work
linear in their length and number of matches; other columns of any name are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_hash, keep, prepare, scratch, small, table

#: Kind, what the text must contain for the pattern to be tried, the pattern.
KINDS = (
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
EDGE = r"^[^A-Za-z0-9@+\x{80}-\x{10FFFF}]+|[^A-Za-z0-9@\x{80}-\x{10FFFF}]+$"
ROUNDS = 4
ONE = 1_000_000
TRUST = 600_000
SUPPORT = 4 * ONE
AROUND = 80
CHUNK = 64


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes(kind: str, c: Column) -> Column:
    if kind == "ip":
        return F.rlike(c, F.lit(OCTETS))
    if kind == "card":
        return F.length(_digits(c)).between(16, 19) & F.call_function("luhn_check", _digits(c))
    if kind == "phone":
        return F.length(_digits(c)).between(8, 15)
    return F.lit(True)


def _keeper(kind: str):
    return lambda m: _passes(kind, m.v)


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of ``pattern``, and the pieces of text before each and after the last."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _starts(hits: str, pieces: str) -> Column:
    """The code point at which each match starts: a fold over the lengths of what stands before it."""
    lengths = F.zip_with(F.slice(pieces, 1, F.size(hits)), F.col(hits), lambda p, h: F.struct(F.length(p).alias("p"), F.length(h).alias("h")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("part"), F.array().cast("array<array<int>>").alias("done"))

    def step(a, x):
        full, start = F.size(a.part) >= CHUNK, a.at + x.p
        part = F.when(full, F.array(start)).otherwise(F.array_append(a.part, start))
        return F.struct((start + x.h).alias("at"), part.alias("part"), F.when(full, F.array_append(a.done, a.part)).otherwise(a.done).alias("done"))

    return F.aggregate(lengths, first, step, lambda a: F.flatten(F.array_append(a.done, a.part)))


def _with_spans(x: DataFrame, name: str, pattern: str, only: Column) -> DataFrame:
    """Column ``name``: array of (s, e, v, left, right) of the matches of ``pattern`` in ``text`` where ``only`` holds, with what stands beside them."""
    hits, pieces = _found(F.col("text"), pattern)
    none = F.array().cast("array<string>")
    x = x.withColumn("_h", F.when(only, hits).otherwise(none)).withColumn("_p", F.when(only, pieces).otherwise(none)).withColumn("_s", _starts("_h", "_p"))
    # words longer than the cut are folded, so that no part of a word passes for one
    tail = lambda p: F.when(F.length(p) > AROUND, F.regexp_replace(F.right(p, F.lit(AROUND + 1)), r"^[^\x20\x09-\x0D]+", " <long>")).otherwise(p)
    head = lambda p: F.when(F.length(p) > AROUND, F.regexp_replace(F.substring(p, 1, AROUND + 1), r"[^\x20\x09-\x0D]+$", "<long> ")).otherwise(p)
    of = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    x = x.withColumn("_b", F.transform("_p", tail)).withColumn("_a", F.transform("_p", head))
    x = x.withColumn("_hb", F.transform("_h", tail)).withColumn("_ha", F.transform("_h", head))
    before = lambda i: F.concat(of("_hb", i - 2), of("_b", i - 1), of("_hb", i - 1), of("_b", i))
    after = lambda i: F.concat(of("_a", i + 1), of("_ha", i + 1))
    spans = F.transform(F.col("_h"), lambda h, i: F.struct(
        F.get("_s", i).cast("long").alias("s"), (F.get("_s", i) + F.length(h)).cast("long").alias("e"), h.alias("v"), before(i).alias("left"), after(i).alias("right"),
    ))
    return x.withColumn(name, spans).drop("_h", "_p", "_s", "_b", "_a", "_hb", "_ha")


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) and, per kind, an array column of its spans; ``_t`` has the identifier-like tokens, base spans included."""
    x = docs
    for kind, need, pattern in KINDS:
        only = F.contains("text", F.lit(need)) if need == "@" else F.rlike("text", F.lit(need))
        x = _with_spans(x, f"_{kind}", pattern, only)
        x = x.withColumn(f"_{kind}", F.filter(f"_{kind}", _keeper(kind)))
    return _with_spans(x, "_t", TOKEN, F.rlike("text", F.lit("[0-9@]")))


def _word(c: str, pattern: str) -> Column:
    """The words that ``pattern`` finds, those with a digit or an ``@`` as their shape."""
    w = F.regexp_replace(F.lower(F.regexp_extract(c, pattern, 1)), r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*", "<at>")
    return F.regexp_replace(w, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<num>")


def candidates(spanned: DataFrame) -> DataFrame:
    """doc_id, h, (s, e, v) of the base spans (``seed``) and of the identifier-like tokens beside them, with their patterns."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    mark = lambda c, seed: F.transform(c, lambda m: F.struct(F.lit(seed).alias("seed"), m.alias("m")))
    x = spanned.select("doc_id", "h", F.explode(F.concat(*[mark(f"_{k}", True) for k, *_ in KINDS], mark("_t", False))).alias("t")).select("doc_id", "h", "t.seed", "t.m.*")
    trimmed = F.when(F.col("seed"), F.col("v")).otherwise(F.regexp_replace("v", EDGE, ""))
    lead = F.when(F.col("seed"), 0).otherwise(F.length("v") - F.length(F.regexp_replace("v", EDGE.split("|")[0], "")))
    x = x.withColumn("s", F.col("s") + lead).withColumn("v", trimmed).withColumn("e", F.col("s") + F.length("v"))
    x = x.filter(F.col("seed") | (F.length("v") >= 4) & F.rlike("v", F.lit("@|[0-9].*[0-9]")))
    # a token overlaps a base span if one that starts before its end reaches beyond its start
    upto = lambda order: Window.partitionBy("doc_id", "h").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_to", F.max(F.when(F.col("seed"), F.col("e"))).over(upto(F.asc("s"))))
    x = x.withColumn("_from", F.min(F.when(F.col("seed"), F.col("s"))).over(upto(F.desc("s"))))  # frames that only grow: one pass each
    x = x.filter(F.col("seed") | ~(F.coalesce(F.col("_to") > F.col("s"), F.lit(False)) | F.coalesce(F.col("_from") < F.col("e"), F.lit(False))))
    # a word that touches an instance without white space is no context of its own
    left, two, right = _word("left", f"(?:^|{space})({word}+){space}+$"), _word("left", f"(?:^|{space})({word}+{space}+{word}+){space}+$"), _word("right", f"^{space}+({word}+)")
    names = lambda kind, c: F.when(c != "", F.concat(F.lit(kind), F.regexp_replace(c, f"{space}+", " ")))
    pats = F.array_compact(F.array(names("L:", left), names("R:", right), names("LL:", two)))
    return x.select("doc_id", "h", "s", "e", F.lower("v").alias("v"), "seed", pats.alias("pats"))


def trusted(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pat, conf): the patterns trusted after the last round."""
    edges = keep(found.select("v", "seed", F.explode("pats").alias("pat")).groupBy("pat", "v").agg(F.max("seed").alias("seed")))
    belief = F.when(F.col("seed"), ONE).otherwise(0)
    scored = edges.withColumn("belief", belief)
    for k in range(rounds):
        pats = scored.groupBy("pat").agg(F.sum("belief").alias("support"), F.count("*").alias("n")).withColumn("conf", F.expr("support div (n + 1)"))
        pats = keep(pats.filter((F.col("conf") >= TRUST) & (F.col("support") >= SUPPORT)).select("pat", "conf"))
        if k + 1 < rounds:
            best = edges.join(small(pats), "pat").groupBy("v").agg(F.max("conf").alias("conf"))
            scored = keep(edges.join(best, "v", "left").withColumn("belief", F.greatest(belief, F.coalesce("conf", F.lit(0)))).drop("conf"))
    return pats


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the base kinds' spans as arrays, and ``context``: array of (s, e) that the trusted patterns add."""
    prepare(docs.sparkSession)
    x = docs.select("doc_id", doc_hash().alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [k for k, *_ in KINDS]
    spanned = keep(base_spans(x).select("doc_id", "h", *[f"_{k}" for k in kinds], "_t"))
    found = keep(candidates(spanned))
    with scratch() as stay:
        pats = stay(trusted(found, rounds))
    pats = small(pats)
    more = found.filter("NOT seed").select("doc_id", "h", "s", "e", F.explode("pats").alias("pat")).join(pats, "pat", "left_semi")
    more = more.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("context")).withColumnsRenamed({"doc_id": "_d", "h": "_k"})
    base = spanned.select("doc_id", "h", *[F.transform(f"_{k}", lambda m: F.struct(m.s.alias("s"), m.e.alias("e"))).alias(k) for k in kinds])
    x = base.join(small(keep(more)), base.doc_id.eqNullSafe(F.col("_d")) & (base.h == F.col("_k")), "left")
    return x.select("doc_id", *kinds, F.coalesce("context", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("context"))


def query(spark, sf_dir) -> DataFrame:
    x = find(table(spark, sf_dir, "documents"))
    say = lambda k: F.transform(k, lambda m: F.concat_ws(":", F.lit(k), m.s, m.e))
    kinds = [k for k, *_ in KINDS]
    base = F.concat(*map(say, kinds))
    return x.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, say("context")), ",").alias("spans"), F.size("context").cast("long").alias("n_context"),
    )
