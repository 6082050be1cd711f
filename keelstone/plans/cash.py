"""Cash movements -> daily balances, rebuilt from all landed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import account_id, balance_id, ccyymmdd, plain_decimal
from ..operators.asof import last_before
from ..operators.merge import merge
from ..tables import shares, small

MONEY = "decimal(18,2)"
KEY = ["accountId", "currency", "asOfDate"]
OUTCOMES = ("UNKNOWN_ACCOUNT", "MALFORMED_VALUE", "CURATED")


def outcomes(raw: DataFrame) -> DataFrame:
    """accountId (not checked for existence), currency, asOfDate and ``outcome`` of every movement."""
    x = raw.withColumn("accountId", account_id(F.col("MOV_ACCT_NBR"))).withColumn("currency", F.col("MOV_CCY_CD")).withColumn("asOfDate", ccyymmdd(F.col("MOV_FILE_DATE")))
    bad = (F.coalesce("currency", F.lit("")) == "") | F.col("asOfDate").isNull()
    return x.withColumn("outcome", F.when(F.col("accountId").isNull(), "UNKNOWN_ACCOUNT").when(bad, "MALFORMED_VALUE").otherwise("CURATED"))


def land(movements: DataFrame, path: str) -> None:
    """Append raw movements to their table, which is partitioned by file date."""
    x = movements.repartitionByRange(shares(movements), "MOV_FILE_DATE", "MOVEMENT_ID")  # a day may take several tasks, and few tasks write a day
    x.write.mode("append").partitionBy("MOV_FILE_DATE").parquet(path)


def landed(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The landed movements, with the columns of ``like``; file dates stay text."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def touched(raw: DataFrame, batch: DataFrame) -> DataFrame:
    """All landed movements of the (account, currency, date) keys that occur in ``batch``.

    The batch's file dates are joined first: where ``raw`` is partitioned by file date,
    only the partitions of those dates are read (dynamic partition pruning).
    """
    curated = outcomes(batch).filter("outcome = 'CURATED'")
    days = small(curated.select("MOV_FILE_DATE").distinct())  # a row per day
    return outcomes(raw.join(days, "MOV_FILE_DATE", "left_semi")).filter("outcome = 'CURATED'").join(curated.select(*KEY).distinct(), KEY, "left_semi")


def totals(movements: DataFrame) -> DataFrame:
    """credits and debits per key; amounts that are blank or unparseable add nothing but keep their group."""
    amount = plain_decimal(F.col("MOV_AMT"))
    x = movements.withColumn("_a", amount)
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)
    return x.groupBy(*KEY).agg(add(F.when(F.col("_a") >= 0, F.col("_a"))).alias("credits"), add(F.when(F.col("_a") < 0, -F.col("_a"))).alias("debits"))


def balances(movements: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Rebuilt balances; the opening one is the closing of the latest EOD snapshot strictly before."""
    eod = current.filter("snapshotType = 'EOD'").select(*KEY, "closingBalance")
    x = last_before(totals(movements), eod, ["accountId", "currency"], "asOfDate", "closingBalance", "openingBalance", F.lit(0).cast(MONEY))
    closing = (F.col("openingBalance") + F.col("credits") - F.col("debits")).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    return x.select(
        balance_id(F.col("accountId"), F.col("currency"), F.date_format("asOfDate", "yyyyMMdd")).alias("balanceId"), *KEY, "openingBalance", "credits", "debits", closing.alias("closingBalance"),
        zero.alias("pendingCredits"), zero.alias("pendingDebits"), closing.alias("projectedBalance"), F.lit("INTRADAY").alias("snapshotType"), now.alias("createdAt"), now.alias("updatedAt"), F.lit(1).cast("bigint").alias("_arrival"),
    )


def curate(raw: DataFrame, batch: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """The new balances table after a batch has landed in ``raw``."""
    rebuilt = balances(touched(raw, batch), current, now)
    return merge(current, rebuilt, KEY, rows=current.count() + batch.count())
