"""As-of join: the latest earlier value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Rows of one key (probes and snapshots) up to which one task takes them all.
HOT_ROWS = 1_000_000


def last_before(probe: DataFrame, snapshots: DataFrame, key: list[str], at: str, value: str, out: str, default: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``out``: ``value`` of the latest snapshot strictly before ``at``, per key.

    Both sides go through one window; snapshots sort after the probes of the same
    instant, which makes the comparison strict.  Where a key has more than ``hot_rows``
    rows, the rows are cut into time ranges first (``_by_ranges``), so that many tasks share it.
    """
    names = probe.columns
    p = probe.select(*key, F.col(at).alias("_at"), F.struct(*names).alias("_row"), F.lit(None).cast(snapshots.schema[value].dataType).alias("_value"), F.lit(0).alias("_side"))
    s = snapshots.select(*key, F.col(at).alias("_at"), F.lit(None).cast(probe.select(F.struct(*names).alias("r")).schema["r"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(1).alias("_side"))
    both = p.unionByName(s)
    most = both.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > hot_rows:
        x = _by_ranges(both, key)
    else:
        x = both.withColumn("_last", F.last("_value", ignorenulls=True).over(_upto(*key))).filter("_side = 0")
    last = F.col("_last") if default is None else F.coalesce("_last", default)
    return x.select("_row.*", last.alias(out))


def _upto(*key: str) -> Window:
    return Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _by_ranges(both: DataFrame, key: list[str]) -> DataFrame:
    """The probes with ``_last``, in two levels.

    Rows are range-partitioned by key and time and stored, each with the number of its
    range.  A row per key and range then carries the last value of the ranges before it,
    and within a range the window runs as usual.  Rows of one instant stay together.
    """
    x = stored(both.repartitionByRange(*key, "_at", "_side").withColumn("_part", F.spark_partition_id()))
    ends = x.groupBy(*key, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a key
    carried = ends.select(*key, "_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    on = F.lit(True)
    for c in (*key, "_part"):
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"c.{c}"))
    y = x.withColumn("_last", F.last("_value", ignorenulls=True).over(_upto(*key, "_part"))).filter("_side = 0")
    y = y.alias("x").join(carried.alias("c"), on, "left")
    return y.select("x._row", F.coalesce("x._last", "c._carried").alias("_last"))
