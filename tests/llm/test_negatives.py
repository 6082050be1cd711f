"""Hard negatives against scoring every pair with Python integers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelstone.llm import negatives

from .test_operators import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, part string, score string"


def plain(table):
    """(vec_id, components, label) rows -> result rows."""
    rows = []
    for vec_id, v, label in table:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((vec_id, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other) for j, (b, w, other) in enumerate(rows) if j != i]
        for score, b, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            near = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)[:10]
            out += [(a, b, k + 1, n, score, s) for k, (s, n, _) in enumerate(near)]
    return out


def result(df, **options):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in negatives.mine(df, **options).select(*names).collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def frame(spark, table):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y, "u", "p", "s") for i, v, y in table], SCHEMA)


def vectors(n, dim, seed, spread=0.35):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(10, dim))
    return [(i, (middle[i % 10] * spread + r.normal(size=dim) * 0.2).astype(np.float32).tolist(), i % 10) for i in range(n)]


@pytest.mark.parametrize("rows,anchors", [(16_384, 512), (37, 2), (1, 1)])
def test_blocks_of_any_size(spark, rows, anchors):
    table = vectors(300, 12, 4)
    assert sorted(result(frame(spark, table), rows=rows, anchors=anchors), key=key) == sorted(plain(table), key=key)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    table = vectors(220, 5, 7)
    table += [(400, None, 1), (500, [1.0, None, 2.0, 0.0, 0.0], 2), (600, [1.0, nan, 0.0, 0.0, 0.0], 3), (700, [inf, 0.0, 0.0, 0.0, 0.0], 3), (800, [0.5] * 5, None), (None, [0.4, 0.1, 0.0, 0.2, 0.1], 3)]
    table += [(900, [], 4), (1000, [0.0] * 5, 4), (1100, [3.0], 5), *[(1200, [0.3, 0.2, -0.1, 0.5, 0.4], 6)] * 3, *[(1201 + i, [0.3, 0.2, -0.1, 0.5, 0.4], 7) for i in range(30)]]
    table += [(1300, [3e6, 1e6, 0.0, 1.0, 0.0], 8), (1301, [2e6, -1e5, 5.0, 1.0, 0.0], 8), (1302, [1e6, 1e4, 0.0, 1.0, 3.0], 9)]
    got = result(frame(spark, table).repartition(3), rows=50, anchors=3)
    want = plain(table)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {1200, 1300} <= {r[0] for r in got} and any(r[3] is None or r[1] is None for r in got) == any(r[3] is None or r[1] is None for r in want)
    assert result(frame(spark, table).filter("false")) == [] and result(frame(spark, table).filter("vec_id % 100 <> 0")) == []


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(result(df), key=key) == sorted(plain(table), key=key)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.integers(0, 10**6), st.sampled_from([1, 30, 10_000, 10**9]))
def test_intervals_hold_the_score(dim, seed, size):
    """Every interval holds its score, whatever the vectors."""
    import pandas as pd

    r = np.random.default_rng(seed)
    v = r.integers(-size, size + 1, (40, dim)) * r.integers(0, 2, (40, 1))
    x = pd.DataFrame({"uid": range(40), "vec_id": range(40), "none": False, "label": 0, "x": [(row / 256).tolist() for row in v]})
    (codes,) = negatives.encoder(dim)([x])
    block = negatives.Block(codes)
    q = np.pad(v[0].astype(float), (0, block.d - dim))
    low, high = block.intervals(q)
    exact = [sum(int(a) * int(b) for a, b in zip(row, v[0])) for row in v]
    assert all(lo <= s <= hi for lo, s, hi in zip(low, exact, high))
    assert block.scores(np.arange(40), q).tolist() == exact


def test_intervals_discard_rows(spark):
    """Vectors without any structure: few rows need an exact score."""
    import pandas as pd

    r = np.random.default_rng(1)
    v = [(x / np.linalg.norm(x)).tolist() for x in r.normal(size=(5000, 64))]
    (codes,) = negatives.encoder(64)([pd.DataFrame({"uid": range(5000), "vec_id": range(5000), "none": False, "label": 0, "x": v})])
    block = negatives.Block(codes)
    low, high = block.intervals(block.v[0])
    assert 5 <= (high >= negatives._top(low[1:], 5))[1:].sum() < 750
