"""Operator 10: n-gram Jaccard join by MinHash banding.

A document's shingles are its runs of ``WORDS`` words (a shorter text is one
shingle; a text without words has none).  Equal texts are one class and take part
once.  ``bands(similarity, recall)`` picks the number of bands and rows per band: the
fewest hashes with which a pair at the threshold meets in some band with
probability ``recall``.  Classes shuffle on their band hashes; every bucket links
its members to its smallest one only, so a bucket of any size gives one row per
member, and connected components of these links are the candidate groups.

Within a group all pairs are verified on the full shingle sets, in blocks: a group
of more than ``SIDE`` classes is cut into blocks, each pair of blocks is a task
unit of its own, and products of 0/1 matrices give the sizes of all intersections.
What leaves a unit is a row per class (its links, its best partner, its root in
the unit's spanning forest), never a row per pair.

``similarity``'s numerator and denominator are integers, so the comparison is exact.

Results, a row per input row: ``class_id`` (smallest doc_id with the same text),
``n_links`` (classes with other text at or above the threshold), ``n_linked_docs`` (the
documents in them), ``best_id`` and ``best_similarity`` (most similar other class, ties go to
the largest class key), ``group_id`` (smallest doc_id reachable by links, own class included).

Defined results: null or empty text is a class like any other, without links; a
null doc_id is the class_id only where a class has no other; repeated rows each get a
row; texts are read whole, whatever
their length; extra columns of any name pass through ``drop_near_copies``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_hash, keep, map_rows, prepare, scratch, small, table
from .graph import components

WORDS = 5
SIMILARITY = (4, 5)
RECALL = 0.9995
#: Classes of a block: a group of n classes ships each text n / SIDE times.
SIDE = 1024
#: Distinct texts that a task remembers as signed, and shingles that a unit's matrices hold at a time.
SIGNED = 500_000
WIDE = 4096
_ODD = 0x9E3779B97F4A7C15


def bands(similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): rows as many as keep bands x rows within 128 hashes, for the fewest chance meetings."""
    s = similarity[0] / similarity[1]
    for rows in range(16, 0, -1):
        need = math.ceil(math.log(1 - recall) / math.log(1 - s**rows))
        if need * rows <= 128:
            return need, rows
    raise ValueError("no banding reaches this recall")


def shingler(words: int = WORDS):
    """text -> sorted distinct 64-bit shingle hashes."""
    import numpy as np
    import xxhash

    ids: dict[bytes, int] = {}
    mult = [np.uint64(pow(_ODD, i + 1, 1 << 64)) for i in range(words)]

    def shingles(text):
        w = (text or "").encode("utf-8", "surrogatepass").split()
        if len(ids) > 500_000:
            ids.clear()
        for x in set(w):
            if x not in ids:
                ids[x] = xxhash.xxh3_64_intdigest(x)
        h = np.fromiter(map(ids.__getitem__, w), np.uint64, len(w))
        k = min(words, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * mult[i]
            out ^= out >> np.uint64(32)
            out *= mult[0]
        return np.unique(out)

    return shingles


def signer(n_bands: int, rows: int):
    """Shingle hashes -> one hash per band of the minima of ``rows`` hash functions."""
    import numpy as np

    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(1, 1 << 63, n_bands, dtype=np.uint64)

    def sign(s):
        if not len(s):
            return []
        least = np.full(n_bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for part in range(0, len(s), 2048):
            np.minimum(least, np.multiply.outer(a, s[part : part + 2048]).min(axis=1), out=least)  # a times well-mixed hashes, mod 2^64, is a permutation of them
        out = salt.copy()
        for i in range(rows):
            out = (out ^ least[i::rows][:n_bands]) * np.uint64(_ODD)
            out ^= out >> np.uint64(29)
        return out.view(np.int64).tolist()

    return sign


def class_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _classes(docs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """key, class_id, h (which row stands for the class), n_docs, sig: one row per distinct text."""

    def make():
        shingles, sign, signed = shingler(), signer(n_bands, rows), set()

        def one(doc_id, h, key, text):
            """A text is signed where a task first meets it."""
            if key in signed:
                return [(doc_id, h, key, None)]
            if len(signed) >= SIGNED:
                signed.clear()
            signed.add(key)
            return [(doc_id, h, key, sign(shingles(text)))]

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    x = map_rows(docs.select("doc_id", doc_hash().alias("h"), class_key(F.col("text")).alias("key"), "text"), make, f"doc_id {kind}, h bigint, key binary, sig array<bigint>")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")  # a null id only where there is no other
    x = x.groupBy("key").agg(F.min(first).alias("f"), F.count("*").alias("n_docs"), F.first("sig", ignorenulls=True).alias("sig"))
    return keep(x.select("key", F.col("f.doc_id").alias("class_id"), F.col("f.h").alias("h"), "n_docs", "sig"))


def _verify(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """members: unit, side (0 or 1 for the first or second block; 2: both), key, n_docs, text, sorted by unit within partitions."""
    num, den = similarity

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingles, memo = shingler(), {}
        schema = pa.schema([("key", pa.binary()), ("unit", pa.string()), ("links", pa.int64()), ("linked_docs", pa.int64()), ("best", pa.float64()), ("best_key", pa.binary()), ("root", pa.binary())])

        def unit(name, rows):
            rows = list({(r["side"], r["key"]): r for r in rows}.values())
            left = sorted((r for r in rows if r["side"] in (0, 2)), key=lambda r: r["key"])
            right = sorted((r for r in rows if r["side"] in (1, 2)), key=lambda r: r["key"])
            if not left or not right:
                return
            within = rows[0]["side"] == 2
            sets = {r["key"]: memo[r["key"]] if r["key"] in memo else shingles(r["text"]) for r in rows}
            memo.clear()
            memo.update(sets)
            la, lb = [np.array([len(sets[r["key"]]) for r in x], np.int64) for x in (left, right)]
            both = np.concatenate([sets[r["key"]] for r in rows])
            seen, counts = np.unique(both, return_counts=True)
            shared = seen[counts > 1]
            inter = np.zeros((len(left), len(right)), np.float32)
            places = [[np.searchsorted(shared, np.intersect1d(sets[r["key"]], shared, assume_unique=True)) for r in x] for x in (left, right)]
            for at in range(0, len(shared), WIDE):
                m = []
                for x in places:
                    z = np.zeros((len(x), min(WIDE, len(shared) - at)), np.float32)
                    for i, p in enumerate(x):
                        z[i, p[(p >= at) & (p < at + WIDE)] - at] = 1
                    m.append(z)
                inter += m[0] @ m[1].T
            inter = inter.astype(np.int64)
            union = la[:, None] + lb[None, :] - inter
            ok = (den * inter >= num * union) & (union > 0)
            sim = np.where(union > 0, inter / np.maximum(union, 1), 0.0)
            if within:
                np.fill_diagonal(ok, False)
                np.fill_diagonal(sim, -1.0)
            # a spanning forest of the links: every node takes the smallest label next to it until none changes
            nl = len(left)
            label = np.arange(nl) if within else np.arange(nl + len(right))
            while True:
                old = label.copy()
                if within:
                    label = np.minimum(label, np.where(ok, label[None, :], nl).min(axis=1))
                else:
                    a, b = label[:nl], label[nl:]
                    a = np.minimum(a, np.where(ok, b[None, :], len(label)).min(axis=1))
                    b = np.minimum(b, np.where(ok, a[:, None], len(label)).min(axis=0))
                    label = np.concatenate([a, b])
                label = np.minimum(label, label[label])
                if (label == old).all():
                    break
            every = left if within else left + right
            w = [np.array([r["n_docs"] for r in x], np.int64) for x in (left, right)]
            for mine, other, s, o, wt, base in ((left, right, sim, ok, w[1], 0),) if within else ((left, right, sim, ok, w[1], 0), (right, left, sim.T, ok.T, w[0], nl)):
                n, docs, best = o.sum(axis=1), o @ wt, s.shape[1] - 1 - s[:, ::-1].argmax(axis=1)
                for i, r in enumerate(mine):
                    if n[i]:
                        yield {"key": r["key"], "unit": name, "links": int(n[i]), "linked_docs": int(docs[i]), "best": float(s[i, best[i]]), "best_key": other[best[i]]["key"], "root": every[label[base + i]]["key"]}

        name, rows, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["unit"] != name:
                    out += unit(name, rows)
                    name, rows = r["unit"], []
                rows.append(r)
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        out += unit(name, rows)
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return members.mapInArrow(run, "key binary, unit string, links bigint, linked_docs bigint, best double, best_key binary, root binary")


def _linked(docs: DataFrame, similarity: tuple[int, int], recall: float, side: int) -> tuple[DataFrame, DataFrame]:
    """The classes, and per linked class: key, n_links, n_linked_docs, best, best_key, group (a class key)."""
    prepare(docs.sparkSession)
    classes = _classes(docs, *bands(similarity, recall))
    hashes = classes.select("key", F.explode("sig").alias("bucket"))
    least = hashes.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").drop("z")
    edges = hashes.join(least, "bucket").filter("key <> a").select("a", F.col("key").alias("b"))
    group = components(edges)
    sizes = group.groupBy("root").agg(F.count("*").alias("n"))
    member = keep(group.join(sizes, "root").join(classes.drop("sig").withColumnRenamed("key", "id"), "id").withColumn("blocks", F.expr(f"CAST(ceil(n / {side}) AS INT)")))
    m = member.select(F.col("id").alias("key"), F.col("class_id").alias("_c"), F.col("h").alias("_h"), "root", "blocks", "n_docs", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    text = docs.select("doc_id", doc_hash().alias("h"), "text").join(m, F.col("doc_id").eqNullSafe(m._c) & (F.col("h") == m._h))
    # block b meets the blocks before it as their second side, those after it as their first, and itself
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = text.select("key", "n_docs", "root", "block", "text", other)
    units = units.select(
        F.concat_ws(":", F.hex("root"), F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "key", "n_docs", "text",
    )
    found = keep(_verify(units.repartition("unit").sortWithinPartitions("unit"), similarity))
    best = F.max_by(F.struct("best", "best_key"), F.struct("best", F.hex("best_key")))
    links = keep(found.groupBy("key").agg(F.sum("links").alias("n_links"), F.sum("linked_docs").alias("n_linked_docs"), best.alias("best"), F.min("root").alias("root"), F.count("*").alias("units")))
    # groups of one unit have their root; the forests of the others are joined up
    many = found.filter("root <> key").select(F.col("root").alias("a"), F.col("key").alias("b"))
    joined = components(many)
    links = links.join(joined.select(F.col("id").alias("_i"), F.col("root").alias("_r")), F.col("key") == F.col("_i"), "left")
    return classes, links.select("key", "n_links", "n_linked_docs", "best.best", "best.best_key", F.coalesce("_r", "key").alias("group"))


def _per_class(docs: DataFrame, similarity: tuple[int, int], recall: float, side: int) -> DataFrame:
    classes, links = _linked(docs, similarity, recall, side)
    links = keep(links)
    ids = classes.select(F.col("key").alias("_k"), F.col("class_id").alias("_id"))
    x = links.join(ids.withColumnRenamed("_id", "best_id"), links.best_key == F.col("_k"), "left").drop("_k")
    x = x.join(ids.withColumnRenamed("_id", "_own"), x.key == F.col("_k"), "left").drop("_k")
    first = x.groupBy("group").agg(F.min("_own").alias("group_id"))
    x = x.join(first, "group").select(F.col("key").alias("_k"), "n_links", "n_linked_docs", "best_id", F.col("best").alias("best_similarity"), "group_id", "group")
    out = classes.select("key", "class_id", "n_docs", "h").join(x, F.col("key") == F.col("_k"), "left").drop("_k")
    return out.withColumn("group", F.coalesce("group", "key"))


def join_documents(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL, side: int = SIDE) -> DataFrame:
    with scratch() as stay:
        per = stay(keep(_per_class(docs, similarity, recall, side)))
    per = per.withColumnRenamed("key", "_key").drop("h", "group")
    x = docs.select("doc_id", class_key(F.col("text")).alias("key"))
    x = x.join(per, x.key == per._key)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select("doc_id", "class_id", zero("n_links"), zero("n_linked_docs"), "best_id", "best_similarity", F.coalesce("group_id", "class_id").alias("group_id"))


def _row_key(doc_id: Column, h: Column) -> Column:
    """A doc_id, null included, and a hash as one key."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull().cast("string"), h)


def drop_near_copies(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL, side: int = SIDE) -> DataFrame:
    """One row of ``docs`` for each group of linked or equal texts: the one of smallest doc_id (then text hash)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    ids, texts = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    two = wide.select(F.col(ids).alias("doc_id"), F.col(texts).alias("text"))
    # one class of each group stays, by its representative row; groups are named by class keys, as doc_ids may repeat or be null
    first = F.struct(F.col("class_id").isNull().alias("none"), "class_id", "h")
    with scratch() as stay:
        stays = _per_class(two, similarity, recall, side).groupBy("group").agg(F.min(first).alias("s"))
        stays = stay(keep(stays.select(_row_key(F.col("s.class_id"), F.col("s.h")).alias("_key"))))
    stays = small(stays)
    x = wide.withColumn("_key", _row_key(F.col(ids), F.xxhash64(F.col(ids), F.col(texts))))
    # one key, so that the join and the dropping of repeated rows share one shuffle of the texts
    return x.join(stays, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key").toDF(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE c AS (SELECT coalesce(text, '') AS text, min(doc_id) AS class_id, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT class_id, n, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM c),
g AS (SELECT DISTINCT class_id, g FROM (SELECT class_id, unnest(list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS g FROM w WHERE len(w) > 0)),
k AS (SELECT class_id, count(*) AS k FROM g GROUP BY class_id),
i AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL),
e AS (SELECT a, b, i.i / (x.k + y.k - i.i) AS s FROM i JOIN k x ON x.class_id = a JOIN k y ON y.class_id = b WHERE {SIMILARITY[1]} * i.i >= {SIMILARITY[0]} * (x.k + y.k - i.i)),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
grp AS (SELECT id, min(root) AS group_id FROM r GROUP BY id),
l AS (SELECT a, count(*) AS n_links, CAST(sum(c.n) AS BIGINT) AS n_linked_docs, arg_max(b, (s, md5(c.text))) AS best_id, max(s) AS best_similarity FROM e JOIN c ON c.class_id = b GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(n_links, 0) AS n_links, coalesce(n_linked_docs, 0) AS n_linked_docs, best_id, best_similarity, coalesce(group_id, c.class_id) AS group_id
FROM documents d JOIN c ON coalesce(d.text, '') = c.text LEFT JOIN l ON l.a = c.class_id LEFT JOIN grp ON grp.id = c.class_id
"""
