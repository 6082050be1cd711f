import datetime as dt
from decimal import Decimal

import random

import pytest
from pyspark.sql import functions as F

from keelstone.operators import asof, delta, merge, select
from keelstone.registry import ENTITIES, entity
from keelstone.tables import VersionedTable, shared_folder


def test_registry_is_declared(spark):
    assert len(ENTITIES) == 11
    for e in ENTITIES.values():
        assert set(e.key) <= set(e.columns) and {c for c, _ in e.total_order} >= set(e.key)
    assert entity("positions").schema["quantity"].dataType.simpleString() == "decimal(18,4)"
    with pytest.raises(ValueError):
        entity("nothing")
    with pytest.raises(ValueError):
        entity("accounts", tier="raw")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


STATE = "k string, ts string, v string"


def test_guarded_merge(spark):
    cur = spark.createDataFrame([("a", "2020", "old"), ("b", None, "unstamped"), ("c", "2020", "tie"), ("e", "2020", "kept")], STATE)
    new = spark.createDataFrame([("a", "2099", "new", 1), ("b", "2020", "stamped", 2), ("c", "2020", "same", 3), ("d", None, "first", 4), ("e", None, "undated", 5), ("d", None, "second", 6)], STATE + ", _arrival long")
    want = [("a", "2099", "new"), ("b", "2020", "stamped"), ("c", "2020", "tie"), ("d", None, "first"), ("e", "2020", "kept")]
    once = merge.merge(cur, new, ["k"], "ts")
    assert rows(once) == want
    assert rows(merge.merge(once, new, ["k"], "ts")) == want  # a replay changes nothing


def test_stale_never_wins_in_any_order(spark):
    none = spark.createDataFrame([], STATE)
    a = spark.createDataFrame([("x", "2099", "fresh", 1)], STATE + ", _arrival long")
    b = spark.createDataFrame([("x", "2020", "stale", 1)], STATE + ", _arrival long")
    for p, q in ((a, b), (b, a)):
        assert rows(merge.merge(merge.merge(none, p, ["k"], "ts"), q, ["k"], "ts")) == [("x", "2099", "fresh")]


def test_upsert_replaces_and_keeps_created(spark):
    cur = spark.createDataFrame([("a", "v1", 1)], "k string, v string, createdAt long")
    new = spark.createDataFrame([("a", "v2", 9, 5), ("b", "w1", 8, 6), ("b", "w2", 9, 7)], "k string, v string, createdAt long, _arrival long")
    assert rows(merge.merge(cur, new, ["k"])) == [("a", "v2", 1), ("b", "w2", 8)]


def test_delta(spark):
    a = delta.index_of(spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string"), "id")
    b = delta.index_of(spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "id int, v string"), "id")
    assert sorted((r.key, r.change) for r in delta.delta(a, b).collect()) == [(1, "REMOVED"), (2, "CHANGED"), (3, "UNCHANGED"), (4, "ADDED")]
    s = delta.statistics(delta.delta(a, b)).first()
    assert (s.added, s.changed, s.removed, s.unchanged, s.emitted, s.suppression_ratio) == (1, 1, 1, 1, 3, 0.0)
    assert {r.change for r in delta.delta(a.filter("false"), b).collect()} == {"ADDED"}  # a lost index never removes
    with pytest.raises(ValueError):
        delta.delta(a.union(a), b)
    assert delta.statistics(delta.delta(a.filter("false"), b.filter("false"))).first().suppression_ratio == 0.0


def test_page_walk_has_no_gap(spark):
    x = spark.range(57).select((F.col("id") % 5).alias("g"), "id")
    order = [("g", False), ("id", True)]
    seen, after = [], None
    while True:
        got, more = select.page(x, order, 10, after)
        seen += [(r.g, r.id) for r in got]
        if not more:
            break
        after = list(seen[-1])
    assert seen == sorted(((i % 5, i) for i in range(57)), key=lambda r: (-r[0], r[1]))
    n = {r.id: (r.rn, r.page) for r in select.pages(x, order, 10).collect()}
    assert [n[i] for _, i in seen] == [(k + 1, k // 10 + 1) for k in range(57)]


def test_limits_and_dates():
    assert [select.clamp_limit(x) for x in (-1, 0, 5, 10**6)] == [1, 1, 5, 200]
    with pytest.raises(ValueError, match="INVALID_DATE"):
        select.day_range("d", "2024-02-30")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_day_filter_reaches_the_scan(spark, tmp_path, kind):
    x = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59),), (dt.datetime(2024, 1, 2),)], f"d {kind}")
    x.write.parquet(str(tmp_path / "t"))
    y = spark.read.parquet(str(tmp_path / "t")).filter(select.day_range("d", "2024-01-01"))
    assert y.count() == 1
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d" in y._jdf.queryExecution().toString()


def test_as_of_is_strict(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 2)], "k string, t int")
    s = spark.createDataFrame([("a", 2, Decimal("7.00")), ("a", 4, Decimal("9.00"))], "k string, t int, v decimal(18,2)")
    got = {(r.k, r.t): r.o for r in asof.last_before(p, s, ["k"], "t", "v", "o").collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 5): Decimal("9.00"), ("b", 2): None}


def test_versioned_table(spark):
    t = VersionedTable(spark, shared_folder(spark))
    assert t.read() is None
    assert t.write(spark.range(3), 0) and t.write(spark.range(5), 1)
    assert not t.write(spark.range(9), 1)  # the batch was written before
    assert t.read().count() == 5


def test_find_raw_rejects(spark):
    x = spark.createDataFrame([], ENTITIES["raw_cash_movements"].schema)
    with pytest.raises(ValueError, match="UNKNOWN_FIELD"):
        select.find_raw(x, "raw_cash_movements", "NOPE", "1")
    with pytest.raises(ValueError, match="NOT_A_RAW_TABLE"):
        select.find_raw(x, "accounts", "accountId", "1")


def test_pages_keep_rows_with_null_keys(spark):
    """Walking by keyset pages returns every row once, nulls first going up and last going down, in any column of the order."""
    rows = [(i, None if i % 3 == 0 else i % 4, None if i % 5 == 0 else f"n{i % 2}") for i in range(14)]
    x = spark.createDataFrame(rows, "id bigint, a int, b string")
    for order in ([("a", True), ("id", True)], [("a", False), ("id", True)], [("b", False), ("a", True), ("id", False)]):
        names = [n for n, _ in order]
        seen, after, more = [], None, True
        while more:
            got, more = select.page(x, order, 3, after)
            seen += [r.id for r in got]
            after = [got[-1][n] for n in names]
        assert seen == [r.id for r in select.ordered(x, order).collect()]


def test_retained_side_of_a_delta_is_not_exchanged(spark):
    from keelstone.operators import delta
    from keelstone.tables import shared_folder

    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("wide"), (F.col("id") % 7).alias("v"))
    index = delta.Retained(spark, shared_folder(spark), "k", buckets=8)
    assert index.read(rows.schema).count() == 0
    index.replace(rows)
    new = rows.filter("k % 10 <> 3").withColumn("v", F.when(F.col("k") % 10 == 4, 100).otherwise(F.col("v")))
    x = delta.delta(delta.retained_index(index.read(rows.schema), "k"), delta.index_of(new, "k"), retained=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.change: r.n for r in x.groupBy("change").agg(F.count("*").alias("n")).collect()} == {"REMOVED": 100, "CHANGED": 100, "UNCHANGED": 800}
        plan = x._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Bucketed: true" in plan
    scan = next(line for line in plan.splitlines() if "Bucketed: true" in line)
    assert "wide" not in scan and "content_hash" in scan


@pytest.mark.parametrize("hot", [10_000, 0])
def test_as_of_of_one_hot_key(spark, hot):
    """Time ranges or one window: the same result, also with ties, nulls and null keys."""
    from keelstone.operators import asof

    r = random.Random(2)
    keys = ["hot"] * 20 + ["a", "b", None]
    probe = [(i, r.choice(keys), r.randrange(200)) for i in range(1500)]
    snaps = [(r.choice(keys), t, None if t % 11 == 0 else t * 10) for t in r.sample(range(200), 120)] + [("only", 5, 1)]
    p, s = spark.createDataFrame(probe, "i int, k string, t int"), spark.createDataFrame(snaps, "k string, t int, v int")
    got = {x.i: x.out for x in asof.last_before(p, s, ["k"], "t", "v", "out", F.lit(-1), hot_rows=hot).collect()}
    assert got == {i: max(((t2, v) for k2, t2, v in snaps if k2 == k and t2 < t and v is not None), default=(0, -1))[1] for i, k, t in probe}


def test_a_hot_key_is_shared_by_many_tasks(spark):
    from keelstone.operators import asof

    both = spark.range(0, 20_000, 1, 8).select(F.lit("hot").alias("k"), F.col("id").alias("_at"), F.struct("id").alias("_row"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("_value"), (F.col("id") % 3 == 0).cast("int").alias("_side"))
    x = asof._by_ranges(both, ["k"])
    assert x.filter("_last <> _row.id - _row.id % 3").count() == 0 and x.count() == 13_333
    from keelstone.tables import stored

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with rows beyond the advisory size
    try:
        parts = stored(both.repartitionByRange("k", "_at", "_side").withColumn("_part", F.spark_partition_id())).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 7_000


def test_walk_meets_every_row_once(spark):
    from keelstone.operators import select

    rows = [(None if i % 5 == 0 else i % 4, i) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, i int")
    for limit in (1, 7, 8, 40, 200):
        pages = [([r.i for r in x.collect()], more) for x, more in select.walk(df, [("a", False), ("i", True)], limit)]
        assert [i for p, _ in pages for i in p] == [i for _, i in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
        assert [more for _, more in pages] == [True] * (len(pages) - 1) + [False] and len(pages) == -(-40 // limit)
    assert [(x.collect(), more) for x, more in select.walk(df.filter("false"), [("a", False), ("i", True)], 3)] == [([], False)]


def test_a_side_is_broadcast_by_rows_and_bytes(spark):
    from keelstone.tables import small

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    x = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("a.b"), F.array("id").alias("c"), F.lit(None).alias("d"), F.encode(F.lit("y"), "utf-8").alias("e"))
    assert hinted(small(x)) and hinted(small(x, 100)) and not hinted(small(x, 99))
    assert not hinted(small(x, size=100_000)) and hinted(small(x, size=110_000))
    assert hinted(small(x.filter("false"))) and hinted(small(spark.range(3).select()))


def test_counts_come_from_footers(spark, tmp_path):
    from keelstone.plans import ops

    for name, n in (("a", 1000), ("b", 0)):
        spark.range(n).select("id", F.col("id").cast("string").alias("s")).write.parquet(str(tmp_path / name))
    x = ops.footer_counts(spark, {n: str(tmp_path / n) for n in "ab"})
    assert {r.table: r.rows for r in x.collect()} == {"a": 1000, "b": 0}
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") >= 2
    assert "FileScan" in spark.read.parquet(str(tmp_path / "a"))._jdf.queryExecution().executedPlan().toString()


def test_walked_is_the_walk(spark):
    from keelstone.operators import select

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(40)], "i int, a int")
    order = [("a", False), ("i", True)]
    for limit in (1, 7, 40):
        want = sorted((r.i, n + 1, more) for n, (x, more) in enumerate(select.walk(df, order, limit)) for r in x.collect())
        assert sorted((r.i, r.page, r.has_more) for r in select.walked(df, order, limit).collect()) == want
    assert select.walked(df.filter("false"), order, 3).collect() == []


def test_the_walk_of_all_accounts_is_one_plan(spark):
    """Its jobs do not grow with the pages: 1,500 accounts in 8 pages took 8 further jobs and a union of 8 plans."""
    from keelstone.queries import reads

    df = reads.k2_walk(spark, "/root/testdata/sf0.01")
    assert df.count() == 1500 and "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_listings_are_counted_per_identifier(spark):
    from keelstone.plans import quality

    one = lambda primary: [{"primaryListing": p} for p in primary]
    rows = [("a", "EQUITY", one([True])), ("a", "EQUITY", one([True, False])), ("b", "EQUITY", one([True])), ("b", "EQUITY", one([False])), ("c", "CORP_BOND", one([True])), ("d", "EQUITY", []), ("e", None, one([False])), ("f", None, one([True]))]
    x = quality.primary_listings(spark.createDataFrame(rows, "securityId string, assetClass string, listings array<struct<primaryListing: boolean>>"))
    assert sorted(map(tuple, x.collect())) == [("a", 3, 2), ("c", 1, 1), ("e", 1, 0)]


def test_identifiers_are_looked_up_without_sorting_rows(spark, monkeypatch):
    """Blank, null, unknown and repeated values against a map too large to broadcast; the rows are neither sorted nor aggregated."""
    from keelstone.operators import resolve

    monkeypatch.setattr("keelstone.tables.small", lambda df: df)
    ids = spark.createDataFrame([("cusip", "c1", "S1"), ("isin", "i1", "S2"), ("isin", "i2", "S3")], "id_type string, id_value string, securityId string")
    rows = [(0, "c1", "i2"), (1, "", "i2"), (2, None, "i1"), (3, "", ""), (4, "zz", "i1"), (5, "zz", None)] + [(i, "", "") for i in range(6, 400)]
    x = spark.createDataFrame(rows, "rn int, POS_CUSIP_NBR string, POS_ISIN_NBR string")
    y = resolve.resolve_securities(x, ids, resolve.custody_candidates(), ["rn"])
    assert dict(y.select("rn", "securityId").collect()) == {0: "S1", 1: "S3", 2: "S2", 4: "S2"} | {i: None for i in (3, 5, *range(6, 400))}
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_daily_totals_and_vendor_rows_are_spread(spark):
    """Totals are summed by hash, and a table of one split is parsed by more than one task."""
    from keelstone.plans import cash
    from keelstone.queries import standins as S

    x = cash.totals(cash.outcomes(S.movements(spark, "/root/testdata/sf0.001")).filter("outcome = 'CURATED'"))
    assert "SortAggregate" not in x._jdf.queryExecution().executedPlan().toString()
    assert S.vendor_rows(spark, "/root/testdata/sf0.001", 0).rdd.getNumPartitions() > 1
