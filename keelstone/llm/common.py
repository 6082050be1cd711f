"""Helpers shared by the training-data operators.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``: splitting the UTF-8 bytes
on ASCII white space gives exactly these, because no byte of a multi-byte
character is an ASCII byte.

Rows that agree in ``doc_id`` and ``text`` are one document: ``doc_key`` names a
document by its ``doc_id`` (null included) and a 64-bit hash of both columns.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables

WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch: a task holds one batch of texts, whatever the table's size.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

#: Rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make sure that checkpoints have a shared folder.

    The folder is ``spark.checkpoint.dir``.  A temporary folder is used only where
    that is unset and the session is local, as in tests.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)


#: The folders that ``keep`` has written in the innermost ``scratch`` of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """Tables that ``keep`` writes inside are deleted at the end, but for those handed to ``stay``: they pass to the scope around this one, or stay where there is none."""
    mine: list[str] = []
    staying: set[str] = set()

    def stay(df: DataFrame) -> DataFrame:
        staying.add(df.kept_path)
        return df

    token = _SCOPE.set(mine)
    try:
        yield stay
    finally:
        _SCOPE.reset(token)
        if (outer := _SCOPE.get()) is not None:
            outer.extend(staying)
        forget(*[p for p in mine if p not in staying])


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder, as Parquet, and read it again.

    Lineage ends there, and later plans know the table's size; a checkpoint would hand
    on the estimate of its plan, which loops of joins multiply without bound.
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return kept


def forget(*tables: DataFrame | str) -> None:
    """Delete tables that ``keep`` wrote (or folders) and that nothing reads any more."""
    from pyspark.sql import SparkSession

    sc = SparkSession.active().sparkContext
    for t in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.kept_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_hash() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and 64 MB; otherwise as it is."""
    return tables.small(df, rows)


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality on the named columns."""
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[n])
    return on


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows made by ``fn = make()`` (once a task): ``fn(*row)`` yields output tuples.  One Arrow batch is held at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        fn = make()
        table = lambda rows: pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in rows], schema=arrow)
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for x in fn(*row):
                    out.append(x)
                    size += sum(len(v) for v in x if isinstance(v, str | bytes))
                if len(out) >= 4096 or size > 8 << 20:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    return df.mapInArrow(run, schema)
