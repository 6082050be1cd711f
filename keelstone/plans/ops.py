"""Operational state and reports.  ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import last_k
from ..operators.select import OPS_LIMIT, clamp_limit
from ..registry import FEED_HOURS

SAMPLES, SHOWN = 10, 3
ERROR_CHARS = 1000


def dead_letter_state(letters: DataFrame) -> DataFrame:
    """Per topic: count, last error and the last ten samples (newest last)."""
    totals = letters.groupBy("topic").agg(F.count("*").alias("count"), F.max_by("error", F.struct("at", "offset")).alias("lastError"), F.max("at").alias("lastErrorAt"))
    kept = last_k(letters, ["topic"], F.struct("at", "offset"), SAMPLES)
    samples = kept.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("at", "offset", "error"))).alias("samples"))
    return totals.join(samples, "topic", "left")


def dead_letter_summary(state: DataFrame) -> DataFrame:
    """Topics by count, with the last three samples and the grand total."""
    x = state.withColumn("samples", F.slice("samples", F.greatest(F.size("samples") - SHOWN + 1, F.lit(1)), SHOWN))
    return x.withColumn("totalDeadLettered", F.sum("count").over(Window.partitionBy())).orderBy(F.desc("count"), "topic")  # a row per topic


def progress(heartbeats: DataFrame) -> DataFrame:
    """Landing heartbeats (topic, collection, n, at) -> recordsLanded, lastLandedAt."""
    return heartbeats.groupBy("topic").agg(F.max("collection").alias("collection"), F.sum("n").alias("recordsLanded"), F.max("at").alias("lastLandedAt"))


def feed_specs(spark: SparkSession, hours: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame(list((hours or FEED_HOURS).items()), "topic string, maxAgeHours int")


def freshness(specs: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Every declared feed, also those that never landed."""
    x = specs.join(state, "topic", "left")
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("lastLandedAt").cast("timestamp"))) / 3.6e9
    status = F.when(F.col("lastLandedAt").isNull(), "NEVER_LANDED").when(hours > F.col("maxAgeHours"), "STALE").otherwise("CURRENT")
    return x.select("topic", F.coalesce("recordsLanded", F.lit(0)).cast("bigint").alias("recordsLanded"), "lastLandedAt", F.round(hours, 2).alias("ageHours"), "maxAgeHours", status.alias("status"))


def table_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, rows, lastInsert over the registry."""
    out = None
    for name, (df, at) in tables.items():
        x = df.agg(F.count("*").alias("rows"), F.max(at).alias("lastInsert")).select(F.lit(name).alias("table"), "rows", "lastInsert")
        out = x if out is None else out.unionByName(x)
    return out


def footer_counts(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """table, rows of Parquet tables by path, from the files' footers: the count is pushed into the scan, and no row group is read.

    Spark pushes aggregates down only for Parquet read as a version 2 source, so these readers
    are made as such; other readers of the session stay as they are.  A table without row
    groups gives no partial count, although a count is never null to the optimizer.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")  # concerns version 2 sources alone
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        found = [spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.coalesce(F.nullif("rows", F.lit(-1)), F.lit(0)).alias("rows")) for name, path in tables.items()]
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def write_outcomes(judged: DataFrame, path: str, known: tuple[str, ...]) -> DataFrame:
    """Write judged rows as Parquet partitioned by ``outcome`` and return outcome, n, counted by that write.

    The counts are observed directly below the write, by the tasks of its last stage, of
    which Spark counts each once even where it is tried again; rows are neither read nor
    judged a second time, nor sorted by outcome: a task keeps a file of each open.  ``known`` are the outcomes of the curator; a row with another
    one (or none) is an error, as curated and skipped must add up to seen.
    """
    seen = Observation()
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(f"n_{i}") for i, o in enumerate(known)]
    spark = judged.sparkSession
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", len(known) + 1)
    try:
        judged.observe(seen, F.count(F.lit(1)).alias("seen"), *counts).write.mode("overwrite").option("compression", "zstd").partitionBy("outcome").parquet(path)
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", before)
    got = seen.get
    found = [(o, got[f"n_{i}"]) for i, o in enumerate(known)]
    if got["seen"] != sum(n for _, n in found):
        raise ValueError(f"{got['seen']} rows seen, {found} judged")
    return judged.sparkSession.createDataFrame([x for x in found if x[1]], "outcome string, n bigint")


def batch_history(ledger: DataFrame, limit: int = 10) -> DataFrame:
    return ledger.orderBy(F.desc("extractedAt"), F.desc("batchId")).limit(clamp_limit(limit, OPS_LIMIT))


def release_checks(counts: DataFrame, recon: DataFrame, cycle: DataFrame, feeds: DataFrame, letters: DataFrame, now: Column) -> DataFrame:
    """check, status and the overall status (the worst) of the populated-tables, freshness, reconciliation, feed and dead-letter checks.

    ``recon``: one row (records, matched, unmatched); ``cycle``: one row (cycleDate).
    """
    one = lambda df, name, status: df.select(F.lit(name).alias("check"), status.alias("status"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    empty = counts.agg(n(F.col("rows") == 0).alias("e"))
    age = F.datediff(now.cast("date"), F.to_date(F.col("cycleDate"), "yyyyMMdd"))
    f = feeds.agg(n(F.col("status") == "STALE").alias("stale"), n(F.col("status") == "NEVER_LANDED").alias("never"), F.count("*").alias("n"))
    dead = letters.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    x = (
        one(empty, "tables_populated", F.when(F.col("e") == 0, "PASS").otherwise("FAIL"))
        .unionByName(one(cycle, "custody_feed_freshness", F.when(F.col("cycleDate").isNull(), "FAIL").when(age <= 3, "PASS").otherwise("WARN")))
        .unionByName(one(recon, "custody_reconciliation", F.when(F.col("records") == 0, "FAIL").when(F.col("unmatched") == 0, "PASS").otherwise("WARN")))
        .unionByName(one(f, "feed_freshness", F.when(F.col("stale") > 0, "WARN").when((F.col("never") > 0) & (F.col("never") == F.col("n")), "FAIL").otherwise("PASS")))
        .unionByName(one(dead, "dead_letters_empty", F.when(F.col("n") == 0, "PASS").otherwise("WARN")))
    )
    severity = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    worst = F.max(severity).over(Window.partitionBy())  # five rows
    return x.withColumn("overall", F.when(worst == 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS"))
