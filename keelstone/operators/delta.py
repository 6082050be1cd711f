"""Full-population snapshot delta."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import content_hash
from ..tables import VersionedTable

#: Buckets of a retained population; fixed for its life.
BUCKETS = 64


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def index_of(df: DataFrame, key: str, stamp: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The retained index: key, source_timestamp, content_hash."""
    ts = F.col(stamp) if stamp else F.lit(None).cast("string")
    return df.select(F.col(key).alias("key"), ts.alias("source_timestamp"), content_hash(df.columns, exclude).alias("content_hash"))


class Retained:
    """The last full snapshot of a feed with its content hashes, bucketed and sorted by key.

    A delta joins it where it lies: only the incoming side is shuffled, into its buckets,
    and only the key, the source timestamp and the hash are read; whole records are read for the keys
    that were removed.  Each cycle is a bucketed table of its own, and a one-row control table
    names the latest; the folder of an earlier cycle may go at any time after that.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, stamp: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.stamp, self.buckets = spark, path, key, stamp, buckets
        self._marks = VersionedTable(spark, f"{path}/marks")

    def _name(self, cycle: int) -> str:
        return f"retained_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{cycle}"

    def cycle(self) -> int:
        """The latest cycle; 0 before the first."""
        return self._marks.version()[0]

    def read(self, schema: T.StructType) -> DataFrame:
        """The retained records and ``content_hash``."""
        n, full = self.cycle(), T.StructType([*schema.fields, T.StructField("content_hash", T.StringType())])
        if not n:
            return self.spark.createDataFrame([], full)
        if not self.spark.catalog.tableExists(self._name(n)):  # another session wrote it
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full)
            self.spark.sql(f"CREATE TABLE {self._name(n)} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/cycle={n}'")
        return self.spark.table(self._name(n))

    def replace(self, rows: DataFrame) -> None:
        """Retain ``rows``, a whole population."""
        n = self.cycle() + 1
        x = rows.withColumn("content_hash", content_hash(rows.columns)).repartition(self.buckets, self.key)  # one file a bucket
        x.write.mode("overwrite").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/cycle={n}").saveAsTable(self._name(n))
        self._marks.write(self.spark.createDataFrame([(n,)], "cycle bigint"))


def retained_index(rows: DataFrame, key: str, stamp: str | None = None) -> DataFrame:
    """The index of a retained population; hashes that are stored with it are not made again."""
    if "content_hash" not in rows.columns:
        return index_of(rows, key, stamp)
    ts = F.col(stamp) if stamp else F.lit(None).cast("string")
    return rows.select(F.col(key).alias("key"), ts.alias("source_timestamp"), "content_hash")


def delta(previous: DataFrame, incoming: DataFrame, check: bool = True, retained: bool = False) -> DataFrame:
    """key and change (ADDED, REMOVED, CHANGED, UNCHANGED) between two indexes: one full outer join on the key.

    A ``retained`` previous index was checked for duplicate keys when it came in.
    """
    if check:
        for label, x in (("previous", previous), ("incoming", incoming))[retained:]:
            if not duplicate_keys(x, "key").isEmpty():
                raise ValueError(f"{label} snapshot has duplicate keys")
    a = previous.select("key", F.col("content_hash").alias("_old"), F.col("source_timestamp").alias("old_timestamp"))
    b = incoming.select("key", F.col("content_hash").alias("_new"), F.col("source_timestamp").alias("new_timestamp"))
    change = F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "REMOVED").when(F.col("_old") != F.col("_new"), "CHANGED").otherwise("UNCHANGED")
    return a.join(b, "key", "full_outer").select("key", change.alias("change"), "old_timestamp", "new_timestamp")


def statistics(changes: DataFrame) -> DataFrame:
    """added, changed, removed, unchanged, in_snapshot, emitted, suppression_ratio (4 places; negative if removals exceed unchanged)."""
    n = lambda c: F.coalesce(F.sum((F.col("change") == c).cast("bigint")), F.lit(0)).alias(c.lower())
    x = changes.agg(*[n(c) for c in ("ADDED", "CHANGED", "REMOVED", "UNCHANGED")])
    x = x.withColumn("in_snapshot", F.expr("added + changed + unchanged")).withColumn("emitted", F.expr("added + changed + removed"))
    ratio = F.when(F.col("in_snapshot") > 0, F.round(1 - F.col("emitted") / F.col("in_snapshot"), 4)).otherwise(0.0)
    return x.withColumn("suppression_ratio", ratio)
