"""Reason-coded reconciliations.  Each returns every row with its reason; ``summary`` rolls it up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import custody_candidates, identifier_map, resolve_accounts, resolve_small, spread
from ..tables import shares
from . import crm, vendor

ISSUES = 20


def custody(raw: DataFrame, accounts: DataFrame, securities: DataFrame, positions: DataFrame, cycle: str | None = None, rows: int | None = None) -> DataFrame:
    """Rows of one cycle (the latest by default): UNKNOWN_ACCOUNT, UNKNOWN_SECURITY, NO_CURATED_POSITION or matched.

    Rows and positions meet by account and security in as many tasks as they need; ``rows``: how
    many positions there are at most, else they are counted.  Rows that lack either match nothing and are spread.
    """
    tasks = max(shares(raw), shares(positions, rows))
    if cycle is None:
        newest = raw.agg(F.max("POS_BUS_DATE").alias("POS_BUS_DATE"))
        raw = raw.join(F.broadcast(newest), "POS_BUS_DATE", "left_semi")  # one row
    else:
        raw = raw.filter(F.col("POS_BUS_DATE") == cycle)
    x = resolve_accounts(raw, accounts, "POS_ACCT_NBR", ["REC_ID"])
    x = resolve_small(x, identifier_map(securities), custody_candidates(), ["REC_ID"])
    pairs = positions.select(F.col("accountId").alias("_a"), F.col("securityId").alias("_s")).repartition(tasks, "_a", "_s").distinct().withColumn("_has", F.lit(True))
    x = x.withColumn("_of", F.when(F.col("accountId").isNull() | F.col("securityId").isNull(), spread(["REC_ID"])).otherwise(F.col("accountId")))
    x = x.repartition(tasks, "_of", "securityId").join(pairs, (F.col("_of") == F.col("_a")) & (F.col("securityId") == F.col("_s")), "left")
    reason = F.when(F.col("accountId").isNull(), "UNKNOWN_ACCOUNT").when(F.col("securityId").isNull(), "UNKNOWN_SECURITY").when(F.col("_has").isNull(), "NO_CURATED_POSITION").otherwise("MATCHED")
    return x.select("REC_ID", F.col("POS_BUS_DATE").alias("cycleDate"), "accountId", "securityId", F.col("POS_CUSIP_NBR").alias("cusip"), reason.alias("reason"))


def crm_accounts(account_events: DataFrame, client_events: DataFrame, accounts: DataFrame) -> DataFrame:
    """The newest event of every account against the curated one."""
    e = crm.latest_accounts(account_events).select(F.col("PK").alias("accountNbr"), "OP", "AFTER")
    names = crm.last_names(client_events).select(F.col("PK").alias("_c"), F.col("client_name").alias("_name"))
    cur = accounts.select(F.col("accountId").alias("_id"), F.col("status").alias("curated"), F.col("client.clientId").alias("clientId"), F.col("client.clientName").alias("clientName"))
    x = e.join(cur, F.col("accountNbr") == F.col("_id"), "left").join(names, F.col("clientId") == F.col("_c"), "left")
    from ..functions.columns import code

    expected = F.when((F.col("OP") == "d") | F.col("AFTER").isNull(), "CLOSED").otherwise(code(F.col("AFTER.status"), crm.ACCOUNT_STATUS, "ACTIVE"))
    reason = F.when(F.col("_id").isNull(), "MISSING").when(~F.col("curated").eqNullSafe(expected), "STATUS_MISMATCH").when(F.col("_name").isNotNull() & ~F.col("clientName").eqNullSafe(F.col("_name")), "STALE_CLIENT_EMBED").otherwise("MATCHED")
    return x.select("accountNbr", F.col("OP").alias("lastOp"), "curated", expected.alias("expected"), "clientId", reason.alias("reason"))


def vendor_securities(raw: DataFrame, securities: DataFrame) -> DataFrame:
    x = vendor.resolved(raw, securities)
    return x.select(F.col("Vendor_Ref").alias("vendorRef"), "securityId", F.col("SecurityDesc").alias("description"), F.when(F.col("securityId").isNull(), "UNMATCHED_VENDOR_RECORD").otherwise("MATCHED").alias("reason"))


def summary(rows: DataFrame) -> DataFrame:
    """records, matched, unmatched: the last two add up to the first."""
    hit = (F.col("reason") == "MATCHED").cast("bigint")
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum(hit), F.lit(0)).alias("matched"), F.coalesce(F.sum(1 - hit), F.lit(0)).alias("unmatched"))


def issues(rows: DataFrame, key: str, limit: int = ISSUES) -> DataFrame:
    return rows.filter("reason <> 'MATCHED'").orderBy(key).limit(limit)
