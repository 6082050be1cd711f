"""Delimited drops, full snapshots, completed-file discovery, watermarked extracts and change events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import iso, vendor_timestamp
from ..registry import CASH_FIELDS, VENDOR_FIELDS
from ..tables import VersionedTable, fixed
from .fixed_width import read_lines

OVERLAP = dt.timedelta(seconds=60)
EPOCH = dt.datetime(1970, 1, 1)


def discover(spark: SparkSession, landing: str, pattern: str) -> DataFrame:
    """Completed files of a feed, oldest name first, a delivery in ``part-`` files as its folder; names being written (``.tmp``) do not match a feed's pattern."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(landing).select("path", "length")
    folder = F.when(F.rlike("path", F.lit(r"\.(dat|csv)/part-[^/]*$")), F.regexp_replace("path", "/part-[^/]*$", "")).otherwise(F.col("path"))
    return x.filter(~F.endswith("path", F.lit(".tmp"))).groupBy(folder.alias("path")).agg(F.sum("length").alias("length")).orderBy("path")


def read_drops(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Cash drops: trimmed strings, null -> "", date and time from the file name, MOVEMENT_ID from the place in the file.

    The header must hold the required columns and the name must have a date and time; anything else is an error.
    """
    lines = read_lines(spark, path, pattern)
    first = F.first("line").over(Window.partitionBy("path", "block").orderBy("at"))
    schema = ", ".join(f"{c} string" for c in CASH_FIELDS)
    head = ",".join(CASH_FIELDS)
    x = lines.withColumn("_head", F.when(F.col("block.start") == 0, first)).withColumn("_is", F.col("line") == head)
    x = x.withColumn("_ok", F.assert_true(F.rlike("file", F.lit("^[A-Z]+_[0-9]{8}_[0-9]{4}$")), F.lit("BAD_FILE_NAME")).isNull() & F.assert_true(F.col("_head").isNull() | (F.col("_head") == head), F.lit("MISSING_COLUMN")).isNull())
    rows = x.filter("_ok AND NOT _is").withColumn("kind", F.lit("detail"))
    from .fixed_width import with_sequence

    rows = with_sequence(rows.select("path", "file", "block", "at", "line", "kind")).withColumn("r", F.from_csv("line", F.lit(schema)))
    rows = rows.withColumns({"MOV_FILE_DATE": F.split("file", "_")[1], "MOV_FILE_TIME": F.split("file", "_")[2]})
    out = rows.select("file", "seq", "MOV_FILE_DATE", "MOV_FILE_TIME", *[F.coalesce(F.trim(f"r.{c}"), F.lit("")).alias(c) for c in CASH_FIELDS])
    return out.withColumn("MOVEMENT_ID", F.concat_ws("-", "file", F.lpad(F.col("seq").cast("string"), 5, "0")))


def read_snapshot(spark: SparkSession, path: str, pattern: str = "*", columns: tuple[str, ...] = VENDOR_FIELDS) -> DataFrame:
    """A full snapshot, refused as a whole unless its trailer declares exactly the rows that it has."""
    lines = read_lines(spark, path, pattern)
    head = ",".join(columns)
    rows = lines.filter((F.col("line") != head) & ~F.startswith("line", F.lit("TRAILER,")))
    gate = lines.agg(
        F.sum((F.col("line") == head).cast("int")).alias("heads"),
        F.max(F.when(F.startswith("line", F.lit("TRAILER,")), F.substring_index("line", ",", -1).try_cast("bigint"))).alias("declared"),
        F.sum(F.when((F.col("line") != head) & ~F.startswith("line", F.lit("TRAILER,")), 1).otherwise(0)).alias("rows"),
    ).first()
    if not gate.heads:
        raise ValueError("MISSING_COLUMN: the header is not the declared one")
    if gate.declared is None:
        raise ValueError("NO_TRAILER")
    if gate.declared != gate.rows:
        raise ValueError(f"COUNT_MISMATCH: declared {gate.declared}, found {gate.rows}")
    schema = ", ".join(f"{c} string" for c in columns)
    return rows.select(F.from_csv("line", F.lit(schema)).alias("r")).select("r.*")


def stamp(df: DataFrame) -> DataFrame:
    """SRC_UPDATED_AT: LAST_UPD_TS in ISO form, else ``updated_at`` if there is one, else null."""
    t = vendor_timestamp(F.col("LAST_UPD_TS"))
    if "updated_at" in df.columns:
        t = F.coalesce(t, vendor_timestamp(F.col("updated_at")))
    return df.withColumn("SRC_UPDATED_AT", iso(t))


def incremental(source: DataFrame, column: str, watermark: dt.datetime | None, overlap: dt.timedelta = OVERLAP) -> DataFrame:
    """Rows changed since the watermark less an overlap; no watermark means everything.  The filter reaches the source."""
    start = EPOCH if watermark is None else watermark - overlap
    return source.filter(F.col(column) >= F.lit(start.isoformat(sep=" ")))  # as text, so the column keeps its type and the filter is pushed


def poll(source: DataFrame, column: str, marks: VersionedTable, name: str, write, full: bool = False) -> dt.datetime | None:
    """One poll: read from the watermark, write the target, and only then advance the watermark.

    The rows are fixed before they are written, and the watermark comes from them: what
    arrives during the write is beyond the watermark, for the next poll.
    """
    known = marks.read("source string, value timestamp, recordsTotal bigint, polls bigint").filter(F.col("source") == name).first()
    rows = fixed(incremental(source, column, None if full or known is None else known.value))
    write(rows)
    got = rows.agg(F.max(column).alias("m"), F.count("*").alias("n")).first()
    value = max([x for x in (got.m, known.value if known and not full else None) if x is not None], default=None)
    spark = source.sparkSession
    row = spark.createDataFrame([(name, value, (known.recordsTotal if known else 0) + got.n, (known.polls if known else 0) + 1)], "source string, value timestamp, recordsTotal bigint, polls bigint")
    rest = marks.read("source string, value timestamp, recordsTotal bigint, polls bigint").filter(F.col("source") != name)
    marks.write(rest.unionByName(row))
    return value


def unwrap(records: DataFrame, image: tuple[str, ...], key: str, table: str, value: str = "value") -> DataFrame:
    """Change envelopes (JSON strings) -> EVENT_ID, OP, PK, LSN, TS_MS, SOURCE_TABLE, BEFORE, AFTER and ``reject``.

    All values are strings.  Without an image or a key the row is a reject; tombstones
    (null payload) are skipped.
    """
    side = ", ".join(f"{c}: string" for c in image)
    schema = f"op string, before struct<{side}>, after struct<{side}>, source struct<lsn: bigint, ts_ms: bigint>, ts_ms bigint"
    x = records.filter(F.col(value).isNotNull()).withColumn("e", F.from_json(value, schema))
    pk = F.coalesce(F.col(f"e.after.{key}"), F.col(f"e.before.{key}"))
    ts = F.coalesce("e.source.ts_ms", "e.ts_ms").cast("string")
    lsn = F.coalesce(F.col("e.source.lsn").cast("string"), F.concat(F.lit("snapshot-"), ts))
    reject = F.when(F.col("e.before").isNull() & F.col("e.after").isNull(), "NO_IMAGE").when(F.coalesce(pk, F.lit("")) == "", "NO_KEY")
    return x.select(
        F.concat_ws("-", lsn, F.lit(table), pk).alias("EVENT_ID"), F.coalesce("e.op", F.lit("r")).alias("OP"), pk.alias("PK"), lsn.alias("LSN"), ts.alias("TS_MS"),
        F.lit(table).alias("SOURCE_TABLE"), F.col("e.before").alias("BEFORE"), F.col("e.after").alias("AFTER"), reject.alias("reject"),
        *[c for c in records.columns if c != value],
    )


def lineage(df: DataFrame, system: str, adapter: str, version: str, extracted_at: Column, batch: Column | None = None, seq: Column | None = None) -> DataFrame:
    """The lineage columns; those that do not apply are null."""
    return df.withColumns({"sourceSystem": F.lit(system), "adapterId": F.lit(adapter), "adapterVersion": F.lit(version), "batchId": batch if batch is not None else F.lit(None).cast("string"), "recordSeq": (seq if seq is not None else F.lit(None)).cast("bigint"), "extractedAt": extracted_at})
