"""Operator 6: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

An item's grams are its runs of ``SEED`` words (a shorter item is one gram).  They are
a table keyed by hash; so are their counts in all documents.  An item's seeds are its
grams that occur at most ``RARE`` times, and in any case the rarer half, ties
included, so a passage that leaked into many documents keeps its seeds.  The documents'
seed occurrences are joined to the seeds on the hash, those of one item that lie about
as far apart as in the item make up a passage, and passages are aligned to the items.  The score is that of the best local alignment
(+1 for an equal word, -1/2 for a changed, missing or added one) over the item's
words; a pair with at least ``SCORE``, or whose alignment itself reaches ``LONG`` words
whatever the item's length, is contamination.

Words are lower-cased and stripped of leading and trailing ASCII punctuation.

The documents are hashed once, however large the benchmark is: a bitmap of the items'
grams, of at most ``BITS`` bits, keeps most other grams from leaving a task, and what it
lets through is stored as (gram, place), counted and joined exactly on the hash.  The words of
documents with passages, and no others, are then read once more.  With more than about 10^8 grams over half of the largest bitmap is set, and more of the
documents' other grams reach the join, which then drops them.
A passage spans at most about four times its item's words, and pairs are aligned in
batches of at most ``CELLS`` cells a row, so a worker's memory depends on the longest
item only.

Defined results: null text has no words; an item without words matches nothing; an
item of one or two words matches where they stand; items with the same id are aligned
as separate texts and their best score counts, ties going to the earliest passage; rows that agree in doc_id and text
give one result; texts are read whole, whatever their length; extra columns of any name
pass through ``drop_contaminated``; empty tables give no rows (or all documents, when
filtering).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_hash, keep, map_rows, prepare, scratch, small, table

SEED = 3
RARE = 16
SCORE = 0.5
LONG = 13
EDIT = 0.5
BITS = (24, 27)
CELLS = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str | None) -> list[bytes]:
    w = [x.strip(_EDGE) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()]
    return [x for x in w if x]


def grammer(lengths: list[int]):
    """text -> (number of words, a gram hash for every run of k words, for each k of ``lengths``)."""
    import numpy as np
    import xxhash

    ids: dict[bytes, int] = {}  # of words as they stand in texts; 0: nothing but punctuation
    mult = [np.uint64(pow(_ODD, i + 1, 1 << 64)) for i in range(SEED + 1)]

    def hashes(raw):
        try:
            return np.fromiter(map(ids.__getitem__, raw), np.uint64, len(raw))
        except KeyError:
            if len(ids) > 500_000:
                ids.clear()
            for x in set(raw):
                if x not in ids:
                    w = x.strip(_EDGE)
                    ids[x] = (xxhash.xxh3_64_intdigest(w) or 1) if w else 0
            return np.fromiter(map(ids.__getitem__, raw), np.uint64, len(raw))

    def grams(text):
        h = hashes((text or "").lower().encode("utf-8", "surrogatepass").split())
        h = h[h != 0]
        h = h ^ (h >> np.uint64(29))
        out = []
        for k in lengths:
            n = max(0, len(h) - k + 1)
            g = np.full(n, k, np.uint64) * mult[SEED]
            for i in range(k if n else 0):
                g += h[i : i + n] * mult[i]
                g ^= g >> np.uint64(32)
                g *= mult[0]
            out.append(g)
        return len(h), out

    return grams


def item_grams(items: DataFrame) -> DataFrame:
    """item, n (its words), place, gram, of all items."""

    def make():
        grams = grammer(list(range(1, SEED + 1)))

        def one(item, text):
            n, found = grams(text)
            for p, g in enumerate(found[min(n, SEED) - 1].view("int64").tolist() if n else ()):
                yield item, n, p, g

        return one

    return map_rows(items.select("item", "text"), make, "item bigint, n bigint, place bigint, gram bigint")


def bitmap(grams: DataFrame):
    """A broadcast bitmap of the hashes in ``grams``, of 2^24 to 2^27 bits; Spark makes its 64-bit words."""
    import numpy as np

    n = grams.count()
    bits = min(max(BITS[0], (2048 * n).bit_length()), BITS[1])
    at = F.col("gram").bitwiseAND((1 << bits) - 1)
    words = grams.select(F.shiftright(at, 6).cast("int").alias("i"), F.expr(f"shiftleft(1L, CAST((gram & {(1 << bits) - 1}) & 63 AS INT))").alias("w")).groupBy("i").agg(F.bit_or("w").alias("w"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in words.toLocalIterator():  # at most 2^21 words, whatever the benchmark
        table[r.i] = r.w
    return grams.sparkSession.sparkContext.broadcast((bits, table.view(np.uint64)))


def may_hold(shared):
    """Hashes -> which of them the bitmap holds."""
    import numpy as np

    bits, table = shared.value
    mask, low = np.uint64((1 << bits) - 1), np.uint64(63)

    def check(g):
        at = g & mask
        return (table[at >> np.uint64(6)] >> (at & low)) & np.uint64(1) != 0

    return check


def seeds_of(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """item, n, place, gram of the grams that are rare, or among the rarer half of their item's."""
    c = counts.select(F.col("gram").alias("_g"), "count")
    x = grams.join(c, grams.gram == c._g, "left").withColumn("count", F.coalesce("count", F.lit(0))).drop("_g")
    half = F.percentile_approx("count", 0.5, 10_000).over(Window.partitionBy("item"))
    return x.withColumn("half", half).filter((F.col("count") <= RARE) | (F.col("count") <= F.col("half"))).select("item", "n", "place", "gram")


def documents_with_grams(docs: DataFrame, shared, lengths: list[int]) -> DataFrame:
    """doc_id, h, hits (gram and place) of the documents in which the bitmap finds any gram of an item."""

    def make():
        grams, check = grammer(lengths), may_hold(shared)

        def one(doc_id, h, text):
            _, found = grams(text)
            hits = [{"gram": x, "at": p} for g in found for ok in [check(g)] if ok.any() for p, x in zip(ok.nonzero()[0].tolist(), g[ok].view("int64").tolist())]
            if hits:
                yield doc_id, h, hits

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", doc_hash().alias("h"), "text"), make, f"doc_id {kind}, h bigint, hits array<struct<gram:bigint,at:bigint>>")


def words_in(docs: DataFrame, near: DataFrame) -> DataFrame:
    """_d, _h, words (joined by spaces) of the documents that ``near`` names, each once."""
    need = small(near.select(F.col("doc_id").alias("_d"), F.col("h").alias("_k")).distinct())
    x = docs.select("doc_id", doc_hash().alias("h"), "text")
    x = x.join(need, x.doc_id.eqNullSafe(need._d) & (x.h == need._k), "left_semi").dropDuplicates(["doc_id", "h"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(x, lambda: lambda doc_id, h, text: [(doc_id, h, b" ".join(words_of(text)).decode("utf-8", "surrogatepass"))], f"_d {kind}, _h bigint, words string")


def passages(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, h, item, start, end, n_seeds: per document and item the stretches of words around seeds that lie as in the item."""
    at = found.select("doc_id", "h", F.explode("hits").alias("x")).select("doc_id", "h", "x.gram", "x.at")
    x = at.join(small(seeds), "gram").select("doc_id", "h", "item", "n", (F.col("at") - F.col("place")).alias("shift"))
    x = x.groupBy("doc_id", "h", "item", "n", "shift").agg(F.count("*").alias("k")).withColumn("slack", F.expr("n div 4 + 2"))
    # the shifts of one stretch make up a passage; as each passage reaches the slack beyond its shifts, it holds all of a leak whose other shifts fell into the next stretch
    x = x.withColumn("cell", F.expr("floor(shift / (n + slack))"))
    part = x.groupBy("doc_id", "h", "item", "n", "slack", "cell").agg(F.min("shift").alias("a"), F.max("shift").alias("b"), F.sum("k").alias("n_seeds"))
    start, end = F.greatest(F.lit(0), F.col("a") - F.col("slack")), F.col("b") + F.col("n") + F.col("slack")
    return part.select("doc_id", "h", "item", start.alias("start"), end.alias("end"), "n_seeds")


def align(pairs: list[tuple[list[bytes], list[bytes]]]) -> list[float]:
    """Best local alignment score of each (item, passage), for many pairs at a time."""
    import numpy as np

    ids: dict[bytes, int] = {}
    code = lambda x, n, pad: [ids.setdefault(w, len(ids)) for w in x] + [pad] * (n - len(x))
    m, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item = np.array([code(a, m, -1) for a, _ in pairs], np.int32)
    text = np.array([code(b, n, -2) for _, b in pairs], np.int32)
    gap = np.arange(n + 1, dtype=np.float32) * EDIT
    row = np.zeros((len(pairs), n + 1), np.float32)
    best = np.zeros(len(pairs), np.float32)
    for i in range(m):
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(item[:, i, None] == text, np.float32(1), np.float32(-EDIT)), row[:, 1:] - EDIT)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + gap, axis=1) - gap  # words added in the passage
        best = np.maximum(best, row.max(axis=1))
    return best.tolist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, h, item_id, score, n_seeds, start, end: the best passage of every contaminated (document, item)."""
    prepare(docs.sparkSession)
    items = keep(benchmark.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    grams = keep(item_grams(items))
    lengths = sorted(r.k for r in grams.select(F.least("n", F.lit(SEED)).cast("int").alias("k")).distinct().collect())  # 1, 2 or SEED
    found = keep(documents_with_grams(docs, bitmap(grams.select("gram").distinct()), lengths))
    counts = found.select(F.explode("hits.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("count"))
    seeds = keep(seeds_of(grams, counts))
    near = keep(passages(found, seeds))

    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    mine = words_in(docs, near)
    # the words of a passage are cut out once per document; the passages of a hot item or document then spread evenly
    rows = near.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item", "start", "end", "n_seeds")).alias("p"))
    rows = rows.join(mine, rows.doc_id.eqNullSafe(mine._d) & (rows.h == mine._h)).withColumn("w", F.split("words", " "))
    cut = F.transform("p", lambda p: F.struct(p.item.alias("item"), p.start.alias("start"), F.least(p.end, F.size("w").cast("long")).alias("end"), p.n_seeds.alias("n_seeds"), F.array_join(F.slice("w", (p.start + 1).cast("int"), F.greatest((p.end - p.start).cast("int"), F.lit(0))), " ").alias("passage")))
    rows = rows.select("doc_id", "h", F.explode(cut).alias("p")).select("doc_id", "h", "p.*").repartition(F.xxhash64("doc_id", "h", "item", "start"))
    rows = rows.join(small(items.select("item", "item_id", F.col("text").alias("item_text"))), "item").select("doc_id", "h", "item_id", "start", "end", "n_seeds", "passage", "item_text")

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            pairs = [(words_of(r["item_text"]), r["passage"].encode("utf-8", "surrogatepass").split()) for r in rows]
            order = sorted(range(len(rows)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
            got, raw, part = [0.0] * len(rows), [0.0] * len(rows), []
            for k in [*order, None]:
                if part and (k is None or (len(part) + 1) * (len(pairs[k][1]) + 1) > CELLS or len(part) == 128):
                    for j, s in zip(part, align([pairs[j] for j in part])):
                        got[j], raw[j] = s / max(1, len(pairs[j][0])), s
                    part = []
                part.append(k)
            out = batch.select(["doc_id", "h", "item_id", "start", "end", "n_seeds"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(got, pa.float64()), pa.array(raw, pa.float64())], names=[*out.schema.names, "score", "raw"])

    done = rows.mapInArrow(scored, f"doc_id {kind}, h bigint, item_id {item_kind}, start bigint, end bigint, n_seeds bigint, score double, raw double").filter((F.col("score") >= score) | (F.col("raw") >= LONG))
    best = F.max_by(F.struct("start", "end", "n_seeds"), F.struct("score", -F.col("start"))).alias("b")
    return done.groupBy("doc_id", "h", "item_id").agg(F.max("score").alias("score"), best).select("doc_id", "h", "item_id", "score", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """The rows of ``docs`` without contamination."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    ids, texts = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    with scratch() as stay:
        leaks = find_leaks(wide.select(F.col(ids).alias("doc_id"), F.col(texts).alias("text")), benchmark, score)
        gone = stay(keep(leaks.select(F.col("doc_id").alias("_d"), F.col("h").alias("_k")).distinct()))
    gone = small(gone)
    x = wide.withColumn("_h", F.xxhash64(F.col(ids), F.col(texts)))
    return x.join(gone, x[ids].eqNullSafe(gone._d) & (x._h == gone._k), "left_anti").drop("_h").toDF(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    x = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "item_id", "score", "n_seeds", F.col("start").alias("start_word"), F.col("end").alias("end_word"))
