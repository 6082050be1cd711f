"""Operator 13: hard negatives by rotated one-bit codes and exact integer scores.

Vectors become integers (``floor(256 x)``).  A random sign flip and a Hadamard transform
rotate them; the signs are a row's code b (components +1 and -1), and the alignment
``a = <b, u> / d`` is stored with it.  What ``a b`` leaves of the rotated vector u is rotated
and coded again, ``LEVELS`` times, and the length of the last residual is stored too.

An anchor estimates its score with a row from the codes alone: on each level its rotated
vector w is cut into ``PLANES`` bit planes, and popcounts of planes against codes give
``<b, w>`` up to the cut-off remainder.  The product of w with the last residual, which is
orthogonal to the last code, is at most ``|residual| * |part of w across b|`` by
Cauchy-Schwarz, so each score lies in an interval for certain.  Only rows whose interval
can reach the wanted places are scored, in exact integers; nothing depends on chance but
how many those are.

Work is dealt as blocks of anchors against blocks of rows, both of bounded size, and each
cell hands on its own best rows; every anchor meets every row.  Positives come first, then
negatives in the range that each positive's score sets.

Defined results: rows with a null label or vector, or with a null or non-finite component,
take no part; shorter vectors count as padded with zeros, an empty one as zeros; repeated
rows are rows of their own, also as anchors; ties go by vec_id, a null one last (such a row
can be a positive or negative, never an anchor); other columns are ignored whatever their
names; an empty table gives no rows; a reported score that is no 64-bit number is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare, table

EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
LEVELS, PLANES = 5, 8
SEED = 13
#: Rows and anchors of a block.
ROWS = 16_384
ANCHORS = 512
_CODES = "uid bigint, vec_id bigint, none boolean, label bigint, vector binary, code binary, aligned binary, rest double"


def numbered(embeddings: DataFrame) -> DataFrame:
    """uid, vec_id (0 where ``none``), label and the components as doubles of the rows that take part."""
    x = embeddings.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("vec_id").cast("bigint"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("none"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    moved = F.when(~F.col("none") & (F.col("vec_id") % 7 == 0), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return x.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad).withColumn("label", moved)


def rotate(v, level: int):
    """Rows of ``v`` with flipped signs, through a Hadamard transform; lengths stay."""
    import numpy as np

    d = v.shape[1]
    u, half = v * (np.random.default_rng([SEED, level]).integers(0, 2, d) * 2 - 1), 1
    while half < d:
        pair = u.reshape(len(u), -1, 2, half)
        u = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(u), -1)
        half *= 2
    return u / np.sqrt(d)


def _pack(bits):
    """Rows of bits as 64-bit words."""
    import numpy as np

    b = np.packbits(bits, axis=1)
    if b.shape[1] % 8:
        b = np.concatenate([b, np.zeros((len(b), -b.shape[1] % 8), np.uint8)], axis=1)
    return b.view(np.uint64)


def encoder(dim: int):
    """Maps rows of ``numbered`` to integer vectors, the codes and alignments of all levels, and the length of what they leave."""
    d = 1 << max(0, dim - 1).bit_length()

    def run(batches):
        import numpy as np
        import pandas as pd

        for x in batches:
            v = np.zeros((len(x), d))
            for k, row in enumerate(x["x"]):
                v[k, : len(row)] = row
            v = np.floor(256 * v)
            left, codes, aligned = v, [], []
            for level in range(LEVELS):
                left = rotate(left, level)
                codes.append(_pack(left >= 0))
                aligned.append(np.abs(left).mean(axis=1))
                left = left - aligned[-1][:, None] * np.where(left >= 0, 1, -1)
            yield pd.DataFrame({
                "uid": x["uid"], "vec_id": x["vec_id"], "none": x["none"], "label": x["label"], "vector": [r.tobytes() for r in v],
                "code": [r.tobytes() for r in np.stack(codes, axis=1)], "aligned": [r.tobytes() for r in np.stack(aligned, axis=1)], "rest": np.sqrt((left * left).sum(axis=1)),
            })

    return run


class Block:
    """Rows of a cell: vectors, codes and what goes with them."""

    def __init__(self, x):
        import numpy as np

        self.uid, self.label = x["uid"].to_numpy(np.int64), x["label"].to_numpy(np.int64)
        self.vec_id, self.none = x["vec_id"].to_numpy(np.int64), x["none"].to_numpy(bool)
        self.v = np.stack([np.frombuffer(b) for b in x["vector"]])
        self.d = self.v.shape[1]
        codes = np.stack([np.frombuffer(b, np.uint64).reshape(LEVELS, -1) for b in x["code"]])
        self.codes = np.ascontiguousarray(codes.transpose(1, 2, 0))  # level, word, row
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)
        self.aligned, self.rest = np.ascontiguousarray(np.stack([np.frombuffer(b) for b in x["aligned"]]).T), x["rest"].to_numpy(float)
        self.most, self.long = float(np.abs(self.v).max(initial=0)), np.sqrt((self.v * self.v).sum(axis=1))

    def _met(self, level: int, w):
        """Products of the codes of a level with ``w``, by bit planes, and how far off they can be."""
        import numpy as np

        least = w.min()
        step = (w.max() - least) / ((1 << PLANES) - 0.5) or 1.0
        cut = np.floor((w - least) / step)
        on = np.zeros(len(self.v), np.uint16 if self.d << PLANES < 1 << 16 else np.uint64)  # sum of the cut components where the code is 1
        for k in reversed(range(PLANES)):
            (plane,) = _pack((cut.astype(np.int64)[None, :] >> k) & 1)
            np.left_shift(on, 1, out=on)
            for code, word in zip(self.codes[level], plane):
                np.add(on, np.bitwise_count(code & word), out=on)
        # w = least + cut * step + remainder
        return least * (2.0 * self.ones[level] - self.d) + step * (2.0 * on - cut.sum()), np.abs(w - least - cut * step).sum()

    def intervals(self, q):
        """Lowest and highest possible score of every row with the integer vector ``q``."""
        import numpy as np

        middle, wide, w = np.zeros(len(self.v)), np.zeros(len(self.v)), q[None, :]
        for level in range(LEVELS):
            w = rotate(w, level)
            met, left = self._met(level, w[0])
            middle += self.aligned[level] * met
            wide += self.aligned[level] * left
        length = np.sqrt((q * q).sum())
        across = np.sqrt(np.maximum(0, length**2 - np.maximum(0, np.abs(met) - left) ** 2 / self.d))
        wide += self.rest * across + 1 + 1e-9 * self.long * length  # the last two for the rounding of doubles
        return middle - wide, middle + wide

    def scores(self, at, q):
        """Exact scores of the rows ``at``, as 64-bit integers or, where these might not do, Python's."""
        import numpy as np

        most = self.d * max(1.0, self.most) * max(1.0, float(np.abs(q).max(initial=0)))
        if most < 2.0**53:
            return (self.v[at] @ q).astype(np.int64)
        kind = (lambda a: a.astype(np.int64)) if most < 2.0**62 else lambda a: np.array([int(x) for x in a.ravel()], object).reshape(a.shape)
        return (kind(self.v[at]) * kind(q)).sum(axis=1)

    def first(self, at, score, k: int):
        """The first ``k`` of the rows ``at``: by score downwards, then vec_id, null ids last."""
        return sorted(range(len(at)), key=lambda i: (-score[i], self.none[at[i]], self.vec_id[at[i]], self.uid[at[i]]))[:k]


def _top(values, k: int):
    """The k-th largest value, or minus infinity."""
    import numpy as np

    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _best(block: Block, allowed, low, high, q, ranges: list[tuple[object, object]], k: int):
    """For each (a, b) of ``ranges``: the first ``k`` allowed rows with a <= 100 score <= b, as (row, score).  Intervals discard, integers decide."""
    import numpy as np

    low, high = 100 * low, 100 * high
    some = np.flatnonzero(allowed & (high >= float(min(a for a, _ in ranges)) - 1) & (low <= float(max(b for _, b in ranges)) + 1)) if ranges else []
    low, high = low[some], high[some]
    picked = []
    for a, b in ranges:
        can = (high >= float(a) - 1) & (low <= float(b) + 1)
        sure = low[(low >= float(a) + 1) & (high <= float(b) - 1)]
        picked.append(some[can & (high >= _top(sure, k))])
    at = np.unique(np.concatenate(picked)) if picked else np.empty(0, int)
    score = block.scores(at, q)  # each surviving row once
    wide = score.dtype == object or len(score) and int(np.abs(score).max()) > 1 << 56  # 100 times a score may leave 64 bits
    for (a, b), mine in zip(ranges, picked):
        s = score[np.searchsorted(at, mine)]
        inside = [i for i in range(len(s)) if a <= 100 * int(s[i]) <= b] if wide else np.flatnonzero((100 * s >= a) & (100 * s <= b))
        mine, s = mine[inside], s[inside]
        if not wide and len(s) > k:
            reach = s >= _top(s, k)
            mine, s = mine[reach], s[reach]
        s = [int(x) for x in s]
        yield [(int(mine[i]), s[i]) for i in block.first(mine, s, k)]


_FOUND = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, uid bigint, vec_id bigint, score bigint"


def _positives(anchors, rows):
    """A cell of the first pass: each anchor's best rows of its label."""
    import pandas as pd

    out = []
    for label, those in anchors.groupby("label"):
        same = rows[rows["label"] == label]
        if not len(same):
            continue
        b, a = Block(same), Block(those)
        for i in range(len(a.uid)):
            low, high = b.intervals(a.v[i])
            (best,) = _best(b, b.uid != a.uid[i], low, high, a.v[i], [(float("-inf"), float("inf"))], POSITIVES)
            out += [(int(a.uid[i]), int(a.vec_id[i]), None, None, None, int(b.uid[j]), None if b.none[j] else int(b.vec_id[j]), s) for j, s in best]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")], dtype=object)


def _negatives(anchors, rows):
    """A cell of the second pass: for each anchor and positive, the best rows of other labels in the positive's range."""
    import pandas as pd

    out = []
    if len(anchors) and len(rows):
        b, a = Block(rows), Block(anchors)
        for i, found in enumerate(anchors["positives"]):
            low, high = b.intervals(a.v[i])
            ranges = [(LOW * int(p["score"]), HIGH * int(p["score"])) for p in found]
            for p, best in zip(found, _best(b, b.label != a.label[i], low, high, a.v[i], ranges, NEGATIVES)):
                out += [(int(a.uid[i]), int(a.vec_id[i]), p["uid"], p["vec_id"], p["score"], int(b.uid[j]), None if b.none[j] else int(b.vec_id[j]), s) for j, s in best]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")], dtype=object)


def mine(embeddings: DataFrame, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    prepare(spark)
    valid = keep(numbered(embeddings))
    is_anchor = ~F.col("none") & (F.col("vec_id") % EVERY == 0)
    n, n_anchors, dim = valid.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    parts, groups = -(-n // rows) or 1, -(-n_anchors // anchors) or 1
    codes = keep(valid.mapInPandas(encoder(dim), _CODES))
    # every row meets every block of anchors, every anchor every block of rows
    all_of = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    one_of = lambda count: F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
    table = codes.select("*", one_of(parts).alias("part"), all_of(groups, "side"))
    ask = spark.read.schema(codes.schema).parquet(codes.kept_path).filter(is_anchor).withColumn("side", one_of(groups))  # read anew: a cell's two sides need columns of their own
    meet = lambda a, cell: a.select("*", all_of(parts, "part")).groupBy("side", "part").cogroup(table.groupBy("side", "part")).applyInPandas(cell, _FOUND)
    order = (F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")

    w = Window.partitionBy("anchor").orderBy(*order)
    best = meet(ask, _positives).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= POSITIVES)
    found = best.groupBy("anchor").agg(F.collect_list(F.struct("uid", "vec_id", "score")).alias("positives"))
    asked = keep(ask.join(found, ask.uid == found.anchor).drop("anchor"))
    w = Window.partitionBy("anchor", "positive").orderBy(*order)
    far = meet(asked, _negatives).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= NEGATIVES)
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT a.uid, a.vec_id AS anchor_id, a.label, a.v, b.uid AS positive, b.vec_id AS positive_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS positive_score FROM e a JOIN e b ON a.label = b.label AND a.uid <> b.uid WHERE a.vec_id % {EVERY} = 0
  QUALIFY row_number() OVER (PARTITION BY a.uid ORDER BY positive_score DESC, b.vec_id, b.uid) <= {POSITIVES}),
n AS MATERIALIZED (SELECT a.uid, b.uid AS other, b.vec_id AS negative_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS negative_score FROM e a JOIN e b ON a.label <> b.label WHERE a.vec_id % {EVERY} = 0)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY uid, positive ORDER BY negative_score DESC, negative_id, other) AS INT) AS rank, negative_id, positive_score, negative_score
FROM p JOIN n USING (uid) WHERE {LOW} * positive_score <= 100 * negative_score AND 100 * negative_score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}
"""
