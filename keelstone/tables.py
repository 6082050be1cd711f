"""Shared folder, broadcast guard and versioned table directories."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and the session local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: its rows and their order no longer change."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of at most ``size`` bytes together, otherwise as it is.

    Both are measured, by one job over at most ``rows`` + 1 rows.
    """
    width = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        bytes_of = F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if kind in ("array", "map", "struct") else F.lit(8)
        width = width + F.coalesce(bytes_of, F.lit(0))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("size")).first()
    return F.broadcast(df) if got.n <= rows and (got.size or 0) <= size else df


def lookup(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as the right side of a join that only looks values up: broadcast if it is small, else hashed by partition, so the rows that are looked up are shuffled but never sorted, however wide they are or however many share a key."""
    x = small(df) if rows is None else small(df, rows)
    return df.hint("shuffle_hash") if x is df else x


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: each job's are deleted as it ends (Spark 4.1), not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: fixed like a checkpoint, and read by column.  Zstandard takes some two thirds of the default codec's bytes."""
    path = shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote (or ``places``) and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a task sorts or writes where the number of tasks follows the table.
TASK_ROWS = 500_000


def shares(df: DataFrame, rows: int | None = None) -> int:
    """The number of partitions in which no task has much more than ``TASK_ROWS`` rows of ``df``; the session's own number at least.  ``rows``: how many there are, else they are counted."""
    n = df.count() if rows is None else rows
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))


class VersionedTable:
    """A table as numbered version folders and a pointer file that is replaced in one step.

    A writer never touches what a reader resolves: it writes ``v=<n+1>`` and then moves
    the pointer.  ``write(df, batch)`` with a batch already recorded does nothing, so a
    retried micro-batch has no further effect.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
        self._fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, int]:
        """(version, last batch); (0, -1) before the first write."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))] if self._fs.exists(self._p(self.path)) else []
        found = [tuple(map(int, n.split("-", 2)[1:])) for n in names if n.startswith("pointer-")]
        return max(found, default=(0, -1)) if found else (0, -1)

    def read(self, schema=None) -> DataFrame | None:
        n, _ = self.version()
        if n:
            return self.spark.read.parquet(f"{self.path}/v={n}")
        return self.spark.createDataFrame([], schema) if schema else None

    def write(self, df: DataFrame, batch: int | None = None) -> bool:
        n, last = self.version()
        if batch is not None and batch <= last:
            return False
        df.write.mode("overwrite").parquet(f"{self.path}/v={n + 1}")
        # creating the next pointer is the commit; readers take the largest
        self._fs.create(self._p(f"{self.path}/pointer-{n + 1}-{last if batch is None else batch}"), False).close()
        return True
