"""Curation jobs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import cash, crm, custody, ops, vendor
from ..sources import feeds, fixed_width as fw
from ..tables import shared_folder, stored
from . import standins as S
from .joins import account_events, client_events, now
from .standins import sql


def _judged_rows(spark, d):
    """The judged details of complete batches, and how many there are, by the batches' own counts."""
    lines = fw.scanned_lines(fw.scan(spark, S.wire_files(spark, d, packed=True)))
    verdicts = stored(fw.controls(lines))
    n = verdicts.filter("status = 'COMPLETE'").agg(F.sum("recordCount")).first()[0] or 0
    return custody.outcomes_of_lines(fw.accepted(fw.with_sequence(lines), verdicts), S.accounts(spark, d), S.securities(spark, d)), n


def _judged(spark, d):
    return _judged_rows(spark, d)[0]


def c1(spark, d):
    """Wire files -> accepted details -> positions, merged into an empty table."""
    judged, n = _judged_rows(spark, d)
    p = custody.positions(judged, now())
    x = custody.upsert(p.filter("false").drop("_arrival"), p, n)
    return x.select("positionId", "accountId", "securityId", F.col("asOfDate").cast("date").alias("asOfDate"), "quantity", F.col("marketPrice").cast("decimal(18,2)").alias("marketPrice"), "marketValue", "costBasis", "positionType", "snapshotType")


def a2(spark, d):
    m = cash.outcomes(S.movements(spark, d)).filter("outcome = 'CURATED'")
    x = cash.balances(m, S.openings(spark, d), now())
    return x.select("balanceId", "accountId", "currency", F.col("asOfDate").cast("date").alias("asOfDate"), "openingBalance", "credits", "debits", "closingBalance")


def _landed(spark, d):
    """All movements, landed by file date."""
    m, path = S.movements(spark, d), f"{shared_folder(spark)}/movements"
    cash.land(m, path)
    return cash.landed(spark, path, m)


def a3(spark, d):
    """The landed movements of a batch's keys; only the days of the batch are read."""
    raw = _landed(spark, d)
    batch = raw.filter(F.substring("MOVEMENT_ID", 3, 20).cast("bigint") % 97 == 0)
    x = cash.totals(cash.touched(raw, batch))
    return x.select("accountId", "currency", F.col("asOfDate").cast("date").alias("asOfDate"), "credits", "debits")


def c2(spark, d):
    """A batch of movements lands, and the balances table takes the rebuilt days."""
    raw = _landed(spark, d)
    x = cash.curate(raw, raw.filter("MOV_FILE_DATE >= '20240114' AND MOV_FILE_DATE <= '20240116'"), S.openings(spark, d), now())
    return x.select("accountId", "currency", F.col("asOfDate").cast("date").alias("asOfDate"), "openingBalance", "closingBalance", "snapshotType")


def c3(spark, d):
    x = crm.accounts(account_events(spark, d), client_events(spark, d), now())
    return x.select("accountId", "accountName", "accountType", "client.clientId", "baseCurrency", "status", F.col("openDate").cast("date").alias("openDate"), F.unix_millis("closeDate").alias("closeMs"), "custodianBranch")


def c4(spark, d):
    x = client_events(spark, d).filter("AFTER IS NOT NULL").select("LSN", crm.client_master("AFTER").alias("c"))
    return x.select("LSN", "c.clientId", "c.clientName", "c.countryOfDomicile", "c.countryOfIncorporation", F.array_join("c.taxResidencies", ",").alias("homes"), "c.classification", "c.kycStatus", "c.riskRating", "c.legalEntityType")


def _channels(spark, d):
    return feeds.stamp(S.vendor_rows(spark, d, 0)).unionByName(feeds.stamp(S.vendor_rows(spark, d, 1)))


def c5(spark, d):
    x = vendor.enrich(_channels(spark, d), S.securities(spark, d))
    return x.select("securityId", "issuer", "status", "vendorUpdatedAt")


def t5(spark, d):
    """Poll rows and snapshot deltas meet in one table: both orders of arrival give the same rows."""
    a, b = [feeds.stamp(S.vendor_rows(spark, d, c)).withColumn("_arrival", F.substring("Vendor_Ref", 2, 7).cast("bigint")) for c in (0, 1)]
    none = a.filter("false").drop("_arrival")
    x, y = [vendor.land(vendor.land(none, p), q).filter("SRC_UPDATED_AT IS NOT NULL").select("Vendor_Ref", "SRC_UPDATED_AT") for p, q in ((a, b), (b, a))]
    return x.join(y.withColumnRenamed("SRC_UPDATED_AT", "other"), "Vendor_Ref").select("Vendor_Ref", "SRC_UPDATED_AT", (F.col("SRC_UPDATED_AT") == F.col("other")).alias("same"))


def c8(spark, d):
    from ..functions.columns import clean

    x = S.vendor_rows(spark, d, 0)
    return x.select("Vendor_Ref", clean(F.col("Cusip")).alias("cusip"), clean(F.col("ISIN_CODE")).alias("isin"))


def a6(spark, d):
    x = custody.statistics(_judged(spark, d)).withColumn("feed", F.lit("custody"))
    y = cash.outcomes(S.movements(spark, d)).groupBy("outcome").agg(F.count("*").alias("n")).withColumn("feed", F.lit("cash"))
    z = crm.event_outcomes(account_events(spark, d), "accounts").groupBy("outcome").agg(F.count("*").alias("n")).withColumn("feed", F.lit("crm"))
    return x.unionByName(y).unionByName(z)


def a6_write(spark, d):
    """The same figures from the writes of the three curators' judged rows."""
    feeds_ = (("custody", _judged(spark, d), custody.OUTCOMES), ("cash", cash.outcomes(S.movements(spark, d)), cash.OUTCOMES), ("crm", crm.event_outcomes(account_events(spark, d), "accounts"), crm.OUTCOMES))
    root, out = shared_folder(spark), None
    for feed, judged, known in feeds_:
        x = ops.write_outcomes(judged, f"{root}/{feed}", known).withColumn("feed", F.lit(feed))
        out = x if out is None else out.unionByName(x)
    return out



QUERIES = {"c1_custody_positions": c1, "a2_cash_balances": a2, "a3_touched_keys": a3, "c2_cash_curation": c2, "c3_crm_accounts": c3, "c4_client_master": c4, "c5_vendor_enrichment": c5, "c8_sentinels": c8, "t5_two_channels": t5, "a6_curation_statistics": a6, "a6_written_outcomes": a6_write}

_C1 = "SELECT *, '2024011' || f AS cycle, row_number() OVER (PARTITION BY accountId, securityId, f ORDER BY seq DESC) AS newest FROM wres WHERE f IN (0, 1) AND accountId IS NOT NULL AND securityId IS NOT NULL"
_BAL = "SELECT accountId, currency, asOfDate, CAST(openingBalance AS DECIMAL(18,2)) AS openingBalance, credits, debits, CAST(openingBalance + credits - debits AS DECIMAL(18,2)) AS closingBalance FROM bal"
_ACCOUNTS = """SELECT a.pk AS accountId, account_name AS accountName, 'CUSTODY' AS accountType, a.client_id AS clientId, 'USD' AS baseCurrency, CASE WHEN own OR byc THEN 'CLOSED' ELSE status END AS status, open_date AS openDate,
  CASE WHEN own AND byc THEN greatest(d_ms, c_ms) WHEN own THEN d_ms WHEN byc THEN c_ms END AS closeMs, '' AS custodianBranch
  FROM (SELECT a.*, coalesce(d.lsn > a.lsn, FALSE) AS own, coalesce(c.lsn > a.lsn, FALSE) AS byc, d.ms AS d_ms, c.ms AS c_ms FROM
    (SELECT pk, max(lsn) AS lsn, arg_max(client_id, lsn) AS client_id, arg_max(account_name, lsn) AS account_name, arg_max(status, lsn) AS status, arg_max(open_date, lsn) AS open_date FROM ace WHERE op <> 'd' AND client_id IS NOT NULL GROUP BY pk) a
    LEFT JOIN (SELECT pk, max(lsn) AS lsn, arg_max(ms, lsn) AS ms FROM ace WHERE op = 'd' GROUP BY pk) d ON a.pk = d.pk
    LEFT JOIN (SELECT pk, max(lsn) AS lsn, arg_max(ms, lsn) AS ms FROM cli WHERE op = 'd' GROUP BY pk) c ON a.client_id = c.pk) a"""
SQL = {
    "c1_custody_positions": sql(f"SELECT 'POS-' || replace(accountId, '-', '') || '-' || replace(securityId, '-', '') || '-' || cycle AS positionId, accountId, securityId, CAST(strptime(cycle, '%Y%m%d') AS DATE) AS asOfDate, qty AS quantity, price AS marketPrice, val AS marketValue, val AS costBasis, 'LONG' AS positionType, 'EOD' AS snapshotType FROM ({_C1}) WHERE newest = 1", "wres"),
    "a2_cash_balances": sql(f"SELECT 'BAL-' || replace(accountId, '-', '') || '-' || currency || '-' || strftime(asOfDate, '%Y%m%d') AS balanceId, * FROM ({_BAL})", "bal"),
    "a3_touched_keys": sql("SELECT accountId, currency, asOfDate, credits, debits FROM bal SEMI JOIN (SELECT 'ACC-' || lpad(CAST(acct AS VARCHAR), 6, '0') AS accountId, ccy AS currency, day AS asOfDate FROM mov WHERE event_id % 97 = 0 AND acct IS NOT NULL AND ccy <> '') t USING (accountId, currency, asOfDate)", "bal"),
    "c2_cash_curation": sql(f"SELECT coalesce(b.accountId, o.accountId) AS accountId, coalesce(b.currency, o.currency) AS currency, coalesce(b.asOfDate, o.asOfDate) AS asOfDate, CAST(coalesce(b.openingBalance, 0) AS DECIMAL(18,2)) AS openingBalance, coalesce(b.closingBalance, o.closingBalance) AS closingBalance, CASE WHEN b.accountId IS NULL THEN 'EOD' ELSE 'INTRADAY' END AS snapshotType FROM (SELECT * FROM ({_BAL}) WHERE asOfDate BETWEEN '2024-01-14' AND '2024-01-16') b FULL JOIN opn o ON b.accountId = o.accountId AND b.currency = o.currency AND b.asOfDate = o.asOfDate", "bal"),
    "c3_crm_accounts": sql(_ACCOUNTS, "ace", "cli"),
    "c4_client_master": sql("""SELECT CAST(lsn AS VARCHAR) AS LSN, pk AS clientId, CASE client_name WHEN '' THEN pk ELSE client_name END AS clientName, upper(dom) AS countryOfDomicile, upper(dom) AS countryOfIncorporation,
      CASE WHEN len(r) = 0 THEN upper(dom) WHEN dom <> '' AND NOT list_contains(r, upper(dom)) THEN upper(dom) || ',' || array_to_string(r, ',') ELSE array_to_string(r, ',') END AS homes, classification, 'PENDING_REVIEW' AS kycStatus, 'MEDIUM' AS riskRating, 'CORPORATION' AS legalEntityType
      FROM (SELECT *, list_filter(list_transform(string_split(res, ','), lambda x: trim(x)), lambda x: x <> '') AS r FROM cli WHERE op <> 'd')""", "cli"),
    "c5_vendor_enrichment": sql("SELECT s.securityId, coalesce(i, s.issuer) AS issuer, coalesce(st, s.status) AS status, t AS vendorUpdatedAt FROM sec s LEFT JOIN (SELECT securityId, arg_max(issuer, (coalesce(stamp, ''), Vendor_Ref)) FILTER (WHERE issuer IS NOT NULL) AS i, arg_max(status, (coalesce(stamp, ''), Vendor_Ref)) FILTER (WHERE status IS NOT NULL) AS st, max(stamp) AS t FROM vres WHERE securityId IS NOT NULL GROUP BY securityId) v USING (securityId)", "vres"),
    "c8_sentinels": sql("SELECT Vendor_Ref, cusip, isin FROM vend WHERE channel = 0", "vend"),
    "t5_two_channels": sql("SELECT Vendor_Ref, max(stamp) AS SRC_UPDATED_AT, TRUE AS same FROM vend GROUP BY Vendor_Ref HAVING max(stamp) IS NOT NULL", "vend"),
    "a6_curation_statistics": sql("""SELECT 'custody' AS feed, CASE WHEN accountId IS NULL THEN 'UNKNOWN_ACCOUNT' WHEN securityId IS NULL THEN 'UNKNOWN_SECURITY' ELSE 'CURATED' END AS outcome, count(*) AS n FROM wres WHERE f IN (0, 1) GROUP BY ALL
      UNION ALL SELECT 'cash', CASE WHEN acct IS NULL THEN 'UNKNOWN_ACCOUNT' WHEN ccy = '' THEN 'MALFORMED_VALUE' ELSE 'CURATED' END, count(*) FROM mov GROUP BY ALL
      UNION ALL SELECT 'crm', CASE WHEN op <> 'd' AND client_id IS NULL THEN 'MISSING_CLIENT' ELSE 'CURATED' END, count(*) FROM ace GROUP BY ALL""", "wres", "mov", "ace"),
}
SQL["a6_written_outcomes"] = SQL["a6_curation_statistics"]
