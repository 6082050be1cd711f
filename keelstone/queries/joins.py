"""Resolution, as-of joins, merges and latest-per-key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, merge, resolve
from ..plans import cash, crm
from ..registry import ACCOUNT_IMAGE, CLIENT_IMAGE
from ..sources import feeds
from ..tables import load
from . import standins as S
from .standins import sql


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def client_events(spark, d):
    return feeds.unwrap(S.change_records(spark, d, "clients"), CLIENT_IMAGE, "client_id", "clients")


def account_events(spark, d):
    return feeds.unwrap(S.change_records(spark, d, "accounts"), ACCOUNT_IMAGE, "account_nbr", "accounts")


def j1(spark, d):
    x = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("A"), "user_id")).when(F.col("event_id") % 9 == 1, F.lpad(F.col("user_id").cast("string"), 12, "0")).when(F.col("event_id") % 9 == 2, "900001").otherwise(F.col("user_id").cast("string")).alias("nbr"))
    return resolve.resolve_accounts(x, S.accounts(spark, d), "nbr", ["event_id"]).select("event_id", "accountId")


def j3(spark, d):
    k = F.col("l_partkey")
    x = S.numbered_lines(spark, d).select("rn", F.when((F.col("rn") % 40 != 1) & (k % 4 != 0), F.lpad(k.cast("string"), 9, "0")).otherwise("").alias("POS_CUSIP_NBR"), F.when(F.col("rn") % 40 != 1, F.concat(F.lit("US"), F.lpad(k.cast("string"), 9, "0"), (k % 10).cast("string"))).otherwise("").alias("POS_ISIN_NBR"))
    return resolve.resolve_securities(x, resolve.identifier_map(S.securities(spark, d)), resolve.custody_candidates(), ["rn"]).select("rn", "securityId")


def j4(spark, d):
    x, c = resolve.with_vendor_candidates(S.vendor_rows(spark, d, 0))
    return resolve.resolve_securities(x, resolve.identifier_map(S.securities(spark, d)), c, ["Vendor_Ref"]).select("Vendor_Ref", "securityId")


def j5(spark, d):
    t = cash.totals(cash.outcomes(S.movements(spark, d)).filter("outcome = 'CURATED'")).select("accountId", "currency", "asOfDate")
    x = asof.last_before(t, S.openings(spark, d), ["accountId", "currency"], "asOfDate", "closingBalance", "openingBalance", F.lit(0).cast("decimal(18,2)"))
    return x.select("accountId", "currency", F.col("asOfDate").cast("date").alias("asOfDate"), "openingBalance")


def j5_hot(spark, d):
    """Every movement's latest earlier balance in its currency, whosever it is: two keys hold all rows, which are cut into time ranges."""
    e = S.movements(spark, d)
    m = cash.outcomes(e).filter("outcome = 'CURATED'").select("MOVEMENT_ID", "currency", "asOfDate")
    top = S.openings(spark, d).groupBy("currency", "asOfDate").agg(F.max("closingBalance").alias("best"))
    x = asof.last_before(m, top, ["currency"], "asOfDate", "best", "best", hot_rows=100)
    return x.select("currency", F.col("asOfDate").cast("date").alias("asOfDate"), "best").groupBy("currency", "asOfDate", "best").agg(F.count("*").alias("n"))


def j6(spark, d):
    x = crm.accounts(account_events(spark, d), client_events(spark, d), now())
    return x.select("accountId", "client.clientId", "client.clientName", F.col("client.countryOfDomicile").alias("domicile"), F.array_join("client.taxResidencies", ",").alias("homes"))


def j9(spark, d):
    e = load(spark, d, "events").select("event_id")
    return e.join(e.filter("event_id % 3 = 0"), "event_id", "left_anti")


def j10(spark, d):
    p = S.positions(spark, d).select("accountId", "securityId").distinct().withColumn("has", F.lit(True))
    x = S.accounts(spark, d).select("accountId").withColumn("securityId", S.sec(F.substring("accountId", 5, 6).cast("bigint") % 50))
    return x.join(p, ["accountId", "securityId"], "left").select("accountId", "securityId", F.coalesce("has", F.lit(False)).alias("has_position"))


def l2(spark, d):
    """Events replayed by user: the last arrival replaces, createdAt survives."""
    e = load(spark, d, "events").select("user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), F.col("event_id").alias("createdAt"), F.col("event_id").alias("_arrival"))
    cur = merge.merge(e.filter("false").drop("_arrival"), e.filter("_arrival < 4000"), ["user_id"])
    return merge.merge(cur, e.filter("_arrival >= 3000"), ["user_id"])


def l3(spark, d):
    """Two channels of vendor rows through the ordering guard."""
    a, b = [feeds.stamp(S.vendor_rows(spark, d, c)).withColumn("_arrival", F.substring("Vendor_Ref", 2, 7).cast("bigint")) for c in (0, 1)]
    cur = merge.merge(a.filter("false").drop("_arrival"), a, ["Vendor_Ref"], "SRC_UPDATED_AT")
    return merge.merge(cur, b, ["Vendor_Ref"], "SRC_UPDATED_AT").select("Vendor_Ref", "SRC_UPDATED_AT", F.substring("Issuer_Name", 1, 7).alias("issuer"), "ISSUE_STATUS")


def l8(spark, d):
    x = feeds.lineage(load(spark, d, "events").select("event_id", "user_id"), "CORE", "cash-drop", "1", F.lit("2024-01-31"), F.concat(F.lit("b"), F.col("event_id") % 3), F.col("event_id"))
    return x.select("event_id", "sourceSystem", "adapterId", "adapterVersion", "batchId", "recordSeq", "extractedAt")


QUERIES = {
    "j1_account_resolution": j1,
    "j2_identifier_map": lambda s, d: resolve.identifier_map(S.securities(s, d)),
    "j3_custody_resolution": j3,
    "j4_vendor_resolution": j4,
    "j5_as_of": j5,
    "j5_hot_key": j5_hot,
    "j6_client_embed": j6,
    "j7_client_fan_out": lambda s, d: j6(s, d).groupBy("clientId", "clientName").agg(F.count("*").alias("accounts")),
    "j9_anti": j9,
    "j10_positions_exist": j10,
    "a4_distinct_pairs": lambda s, d: S.positions(s, d).select("accountId", "securityId").distinct(),
    "l2_keyed_upsert": l2,
    "l3_guarded_upsert": l3,
    "l8_lineage": l8,
    "l9_created_at": lambda s, d: l2(s, d).select("user_id", "createdAt"),
    "w1_latest_client": lambda s, d: crm.latest_clients(client_events(s, d)).select("PK", F.col("AFTER.client_name").alias("client_name")),
    "w2_latest_account_event": lambda s, d: crm.latest_accounts(account_events(s, d)).select("PK", "OP", "LSN"),
    "w3_last_client_name": lambda s, d: crm.last_names(client_events(s, d)),
}

_EMBED = """SELECT a.pk AS accountId, a.client_id AS clientId, CASE WHEN c.pk IS NULL OR c.client_name = '' THEN a.client_id ELSE c.client_name END AS clientName, coalesce(upper(c.dom), '') AS domicile,
  CASE WHEN c.pk IS NULL THEN '' ELSE (SELECT CASE WHEN len(r) = 0 THEN upper(c.dom) WHEN c.dom <> '' AND NOT list_contains(r, upper(c.dom)) THEN upper(c.dom) || ',' || array_to_string(r, ',') ELSE array_to_string(r, ',') END FROM (SELECT list_filter(list_transform(string_split(c.res, ','), lambda x: trim(x)), lambda x: x <> '') AS r)) END AS homes
  FROM (SELECT pk, arg_max(client_id, lsn) AS client_id FROM ace WHERE op <> 'd' AND client_id IS NOT NULL GROUP BY pk) a
  LEFT JOIN (SELECT pk, arg_max(client_name, lsn) AS client_name, arg_max(dom, lsn) AS dom, arg_max(res, lsn) AS res FROM cli WHERE op <> 'd' GROUP BY pk) c ON c.pk = a.client_id"""
_L2 = "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(CAST(value AS DECIMAL(18,2)), event_id) AS value, min(event_id) AS createdAt FROM events GROUP BY user_id"
SQL = {
    "j1_account_resolution": sql("SELECT event_id, a.accountId FROM events e LEFT JOIN acct a ON event_id % 9 NOT IN (0, 2) AND a.accountId = 'ACC-' || lpad(CAST(user_id AS VARCHAR), 6, '0')", "acct"),
    "j2_identifier_map": sql("SELECT * FROM ids", "ids"),
    "j3_custody_resolution": sql("SELECT rn, coalesce(c.securityId, i.securityId) AS securityId FROM lines LEFT JOIN ids c ON c.id_type = 'cusip' AND rn % 40 <> 1 AND l_partkey % 4 <> 0 AND c.id_value = lpad(CAST(l_partkey AS VARCHAR), 9, '0') LEFT JOIN ids i ON i.id_type = 'isin' AND rn % 40 <> 1 AND i.id_value = 'US' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || l_partkey % 10", "lines", "ids"),
    "j4_vendor_resolution": sql("SELECT Vendor_Ref, securityId FROM vres WHERE channel = 0", "vres"),
    "j5_hot_key": sql("""SELECT currency, asOfDate, best, count(*) AS n FROM (SELECT m.currency, m.asOfDate, (SELECT arg_max(o.best, o.asOfDate) FROM (SELECT currency, asOfDate, max(closingBalance) AS best FROM opn GROUP BY ALL) o WHERE o.currency = m.currency AND o.asOfDate < m.asOfDate) AS best
      FROM (SELECT ccy AS currency, day AS asOfDate FROM mov WHERE acct IS NOT NULL AND ccy <> '') m) GROUP BY ALL""", "mov", "opn"),
    "j5_as_of": sql("SELECT accountId, currency, asOfDate, CAST(openingBalance AS DECIMAL(18,2)) AS openingBalance FROM bal", "bal"),
    "j6_client_embed": sql(_EMBED, "ace", "cli"),
    "j7_client_fan_out": sql(f"SELECT clientId, clientName, count(*) AS accounts FROM ({_EMBED}) GROUP BY ALL", "ace", "cli"),
    "j9_anti": "SELECT event_id FROM events WHERE event_id % 3 <> 0",
    "j10_positions_exist": sql("SELECT a.accountId, a.securityId, p.accountId IS NOT NULL AS has_position FROM (SELECT accountId, 'SEC-' || lpad(CAST(CAST(substr(accountId, 5) AS INT) % 50 AS VARCHAR), 6, '0') AS securityId FROM acct) a LEFT JOIN (SELECT DISTINCT accountId, securityId FROM pos) p ON a.accountId = p.accountId AND a.securityId = p.securityId", "acct", "pos"),
    "a4_distinct_pairs": sql("SELECT DISTINCT accountId, securityId FROM pos", "pos"),
    "l2_keyed_upsert": _L2,
    "l3_guarded_upsert": sql("SELECT a.Vendor_Ref, CASE WHEN w THEN b.stamp ELSE a.stamp END AS SRC_UPDATED_AT, coalesce(substr(CASE WHEN w THEN b.issuer ELSE a.issuer END, 1, 7), '') AS issuer, ['A', 'ACT', 'mat''d', 'Delisted', '???'][(k + w::INT) % 5 + 1] AS ISSUE_STATUS FROM (SELECT a.*, b.stamp IS NOT NULL AND (a.stamp IS NULL OR b.stamp > a.stamp) AS w FROM vend a JOIN vend b ON a.Vendor_Ref = b.Vendor_Ref AND a.channel = 0 AND b.channel = 1) a JOIN vend b ON a.Vendor_Ref = b.Vendor_Ref AND b.channel = 1".replace("(k + w", "(a.k + w"), "vend"),
    "l8_lineage": "SELECT event_id, 'CORE' AS sourceSystem, 'cash-drop' AS adapterId, '1' AS adapterVersion, 'b' || event_id % 3 AS batchId, event_id AS recordSeq, '2024-01-31' AS extractedAt FROM events",
    "l9_created_at": f"SELECT user_id, createdAt FROM ({_L2})",
    "w1_latest_client": sql("SELECT pk AS PK, arg_max(client_name, lsn) AS client_name FROM cli WHERE op <> 'd' GROUP BY pk", "cli"),
    "w2_latest_account_event": sql("SELECT pk AS PK, arg_max(op, lsn) AS OP, CAST(max(lsn) AS VARCHAR) AS LSN FROM ace GROUP BY pk", "ace"),
    "w3_last_client_name": sql("SELECT pk AS PK, arg_max(client_name, lsn) AS client_name FROM cli WHERE op <> 'd' AND client_name <> '' GROUP BY pk", "cli"),
}
