"""Custody records -> positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ccyymmdd, julian, optional_date, position_id, zoned
from ..operators.merge import merge
from ..operators.resolve import custody_candidates, identifier_map, resolve_accounts, resolve_small
from ..sources import fixed_width

OUTCOMES = ("UNKNOWN_ACCOUNT", "UNKNOWN_SECURITY", "MALFORMED_VALUE", "CURATED")


def decode(raw: DataFrame) -> DataFrame:
    """Typed columns; what cannot be decoded is null."""
    return raw.withColumns(
        {
            "quantity": zoned(F.col("POS_SHR_QTY"), 4), "marketPrice": zoned(F.col("POS_MKT_PRICE"), 12), "marketValue": zoned(F.col("POS_MKT_VALUE"), 2),
            "accruedInterest": zoned(F.col("POS_ACCR_INT"), 2, signed=True), "asOfDate": ccyymmdd(F.col("POS_BUS_DATE")),
            "priceDate": julian(F.col("POS_PRICE_DT")), "lastActivity": optional_date(F.col("POS_LAST_ACTVY_DT")),
        }
    )


def outcomes(raw: DataFrame, accounts: DataFrame, securities: DataFrame) -> DataFrame:
    """Every raw row with its identifiers, decoded values and ``outcome``, in the fixed order of reasons."""
    x = resolve_accounts(raw, accounts, "POS_ACCT_NBR", ["REC_ID"])
    return _judged(resolve_small(x, identifier_map(securities), custody_candidates(), ["REC_ID"]))


def outcomes_of_lines(lines: DataFrame, accounts: DataFrame, securities: DataFrame) -> DataFrame:
    """The same from classified detail lines (``fixed_width.with_sequence``): where lookups shuffle, they shuffle the lines as they came, which are a fraction of their fields and decoded values."""
    key, x = ["path", "seq"], lines.select("path", "file", "seq", "line")
    x = resolve_accounts(x, accounts, fixed_width.detail("POS_ACCT_NBR"), key)
    x = resolve_small(x, identifier_map(securities), [(kind, fixed_width.detail(c)) for kind, c in custody_candidates()], key)
    return _judged(fixed_width.detail_fields(x, "accountId", "securityId"))


def _judged(resolved: DataFrame) -> DataFrame:
    x = decode(resolved)
    bad = F.col("asOfDate").isNull() | F.col("quantity").isNull() | F.col("marketPrice").isNull() | F.col("marketValue").isNull()
    return x.withColumn("outcome", F.when(F.col("accountId").isNull(), "UNKNOWN_ACCOUNT").when(F.col("securityId").isNull(), "UNKNOWN_SECURITY").when(bad, "MALFORMED_VALUE").otherwise("CURATED"))


def positions(judged: DataFrame, now: Column, arrival: str = "REC_ID") -> DataFrame:
    """The curated rows as positions; ``_arrival`` orders deliveries of one key."""
    x = judged.filter("outcome = 'CURATED'")
    return x.select(
        position_id(F.col("accountId"), F.col("securityId"), F.col("POS_BUS_DATE")).alias("positionId"), "accountId", "securityId", "asOfDate", "quantity",
        F.when(F.col("POS_CCY_CD") != "", F.col("POS_CCY_CD")).otherwise("USD").alias("currency"), F.col("marketValue").alias("costBasis"), "marketPrice", "marketValue",
        F.lit(0).cast("decimal(18,2)").alias("unrealizedPnL"), F.when(F.col("quantity") < 0, "SHORT").otherwise("LONG").alias("positionType"), F.lit("EOD").alias("snapshotType"),
        now.alias("createdAt"), now.alias("updatedAt"), F.substring_index(arrival, "-", -1).cast("bigint").alias("_arrival"),
    )


def statistics(judged: DataFrame) -> DataFrame:
    """outcome, n: curated and skipped add up to seen."""
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


def upsert(current: DataFrame, incoming: DataFrame, rows: int | None = None) -> DataFrame:
    return merge(current, incoming, ["accountId", "securityId", "asOfDate"], rows=rows)
