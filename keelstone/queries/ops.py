"""Reconciliations, freshness, dead letters and the release rollup.  The instant is fixed at 2024-01-31."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import crm, custody, ops, reconcile
from ..sources import feeds, fixed_width as fw
from ..tables import load, stored
from . import standins as S
from .joins import account_events, client_events, now
from .standins import sql

#: Feeds of the stand-in: event types as topics, and one that never lands.
FEEDS = {"click": 30, "view": 1, "error": 8, "purchase": 26, "signup": 26, "never": 26}


BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _raw(spark, d):
    """The numbered details, stored by column: the reconciliation reads few of them, and twice."""
    return stored(fw.details(fw.scanned_lines(fw.scan(spark, S.wire_files(spark, d, packed=True)))))


def r1(spark, d):
    """The latest cycle against positions curated from all but every seventh record."""
    raw, acc, sec = _raw(spark, d), S.accounts(spark, d), S.securities(spark, d)
    p = custody.positions(custody.outcomes(raw.filter("seq % 7 <> 0"), acc, sec), now())
    return reconcile.custody(raw, acc, sec, p, rows=raw.count()).select("REC_ID", "accountId", "securityId", "reason")


def _crm(spark, d):
    """Accounts as curated before the last events arrived, one in nine missing."""
    a, c = account_events(spark, d), client_events(spark, d)
    early = lambda x: x.filter(F.col("LSN").cast("bigint") < 9000)
    cur = crm.accounts(early(a), early(c), now()).filter(F.col("accountId").cast("bigint") % 9 != 4)
    return reconcile.crm_accounts(a, c, cur)


def r3(spark, d):
    return reconcile.vendor_securities(feeds.stamp(S.vendor_rows(spark, d, 0)), S.securities(spark, d)).select("vendorRef", "securityId", "reason")


def _letters(spark, d):
    return load(spark, d, "events").filter("event_id % 3 = 0").select(F.col("event_type").alias("topic"), F.lit("landing").alias("stage"), F.concat(F.lit("bad "), "event_id").alias("error"), F.col("event_id").alias("offset"), F.col("ts").alias("at"))


def _beats(spark, d):
    return load(spark, d, "events").filter("event_type <> 'signup' OR ts < '2024-01-20'").select(F.col("event_type").alias("topic"), F.lit("events").alias("collection"), F.lit(1).cast("bigint").alias("n"), F.col("ts").alias("at"))


def _feeds(spark, d):
    return ops.freshness(ops.feed_specs(spark, FEEDS), ops.progress(_beats(spark, d)), now())


def _counts(spark, d):
    e = load(spark, d, "events")
    return ops.table_counts({"transactions": (S.transactions(spark, d).withColumnRenamed("tradeDate", "at"), "at"), "events": (e.withColumnRenamed("ts", "at"), "at"), "errors": (e.filter("event_type = 'error'").withColumnRenamed("ts", "at"), "at")})


def l5(spark, d):
    x = ops.dead_letter_state(_letters(spark, d))
    return x.select("topic", "count", "lastError", "lastErrorAt", F.array_join(F.transform("samples", lambda s: s.offset.cast("string")), ",").alias("samples"))


def r5(spark, d):
    x = ops.dead_letter_summary(ops.dead_letter_state(_letters(spark, d)))
    return x.select("topic", "count", "totalDeadLettered", F.array_join(F.transform("samples", lambda s: s.offset.cast("string")), ",").alias("samples"))


def r6(spark, d):
    e = load(spark, d, "events")
    ledger = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("recordCount"), F.max("ts").alias("extractedAt")).select(F.concat(F.lit("B"), F.date_format("day", "yyyyMMdd")).alias("batchId"), "recordCount", "extractedAt", F.when(F.dayofmonth("day") % 7 == 0, "FAILED").otherwise("COMPLETE").alias("status"))
    return ops.batch_history(ledger, 10)


def r7(spark, d):
    raw, acc, sec = _raw(spark, d), S.accounts(spark, d), S.securities(spark, d)
    p = custody.positions(custody.outcomes(raw.filter("seq % 7 <> 0"), acc, sec), now())
    recon = reconcile.summary(reconcile.custody(raw, acc, sec, p, rows=raw.count()))
    cycle = raw.agg(F.max("POS_BUS_DATE").alias("cycleDate"))
    return ops.release_checks(_counts(spark, d), recon, cycle, _feeds(spark, d), ops.dead_letter_state(_letters(spark, d)), now())


QUERIES = {
    "r1_custody_reconciliation": r1,
    "r1_custody_summary": lambda s, d: reconcile.summary(r1(s, d)),
    "r1_first_issues": lambda s, d: reconcile.issues(r1(s, d), "REC_ID"),
    "r2_crm_reconciliation": lambda s, d: _crm(s, d).select("accountNbr", "lastOp", "curated", "expected", "reason"),
    "r3_vendor_reconciliation": r3,
    "r4_freshness": lambda s, d: _feeds(s, d).select("topic", "recordsLanded", "ageHours", "maxAgeHours", "status"),
    "r5_dead_letter_summary": r5,
    "r6_batch_history": r6,
    "r7_release_checks": r7,
    "l5_dead_letter_counters": l5,
    "l6_heartbeats": lambda s, d: ops.progress(_beats(s, d)),
    "a5_table_counts": _counts,
    "a5_footer_counts": lambda s, d: ops.footer_counts(s, {t: f"{d}/{t}.parquet" for t in BASE_TABLES}),
}

_R1 = """SELECT REC_ID, w.accountId, w.securityId, CASE WHEN w.accountId IS NULL THEN 'UNKNOWN_ACCOUNT' WHEN w.securityId IS NULL THEN 'UNKNOWN_SECURITY' WHEN p.accountId IS NULL THEN 'NO_CURATED_POSITION' ELSE 'MATCHED' END AS reason
  FROM (SELECT * FROM s WHERE f = 3) w LEFT JOIN (SELECT DISTINCT accountId, securityId FROM s WHERE q % 7 <> 0 AND accountId IS NOT NULL AND securityId IS NOT NULL) p ON w.accountId = p.accountId AND w.securityId = p.securityId"""
_S = "(SELECT *, '2024011' || f || '-' || lpad(CAST(q AS VARCHAR), 6, '0') AS REC_ID FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY rn) AS q FROM wres WHERE ok))"
_R1 = _R1.replace("FROM s WHERE", f"FROM {_S} WHERE")
_LET = "SELECT event_type AS topic, event_id, ts FROM events WHERE event_id % 3 = 0"
_SAMPLES = "SELECT topic, count(*) AS count, arg_max('bad ' || event_id, (ts, event_id)) AS lastError, max(ts) AS lastErrorAt, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (WHERE k <= {0}) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, event_id DESC) AS k FROM ({1})) GROUP BY topic"
_BEATS = "SELECT event_type AS topic, 'events' AS collection, count(*) AS recordsLanded, max(ts) AS lastLandedAt FROM events WHERE event_type <> 'signup' OR ts < '2024-01-20' GROUP BY event_type"
_FRESH = f"""SELECT topic, coalesce(recordsLanded, 0) AS recordsLanded, round(h, 2) AS ageHours, CAST(maxAgeHours AS INTEGER) AS maxAgeHours, CASE WHEN h IS NULL THEN 'NEVER_LANDED' WHEN h > maxAgeHours THEN 'STALE' ELSE 'CURRENT' END AS status
  FROM (SELECT s.topic, maxAgeHours, recordsLanded, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(lastLandedAt)) / 3.6e9 AS h FROM (VALUES {", ".join(f"('{t}', {h})" for t, h in FEEDS.items())}) s(topic, maxAgeHours) LEFT JOIN ({_BEATS}) b ON b.topic = s.topic)"""
_EARLY_A, _EARLY_C = [f"(SELECT * FROM {n} WHERE lsn < 9000)" for n in ("ace", "cli")]
_CUR = f"""SELECT a.pk, a.client_id, CASE WHEN coalesce(d.lsn > a.lsn, FALSE) OR coalesce(g.lsn > a.lsn, FALSE) THEN 'CLOSED' ELSE status END AS status, CASE WHEN c.pk IS NULL OR c.client_name = '' THEN a.client_id ELSE c.client_name END AS client_name FROM
  (SELECT pk, max(lsn) AS lsn, arg_max(client_id, lsn) AS client_id, arg_max(status, lsn) AS status FROM {_EARLY_A} WHERE op <> 'd' AND client_id IS NOT NULL GROUP BY pk) a LEFT JOIN (SELECT pk, max(lsn) AS lsn FROM {_EARLY_A} WHERE op = 'd' GROUP BY pk) d ON a.pk = d.pk
  LEFT JOIN (SELECT pk, max(lsn) AS lsn FROM {_EARLY_C} WHERE op = 'd' GROUP BY pk) g ON a.client_id = g.pk LEFT JOIN (SELECT pk, arg_max(client_name, lsn) AS client_name FROM {_EARLY_C} WHERE op <> 'd' GROUP BY pk) c ON a.client_id = c.pk WHERE CAST(a.pk AS INT) % 9 <> 4"""
SQL = {
    "r1_custody_reconciliation": sql(_R1, "wres"),
    "r1_first_issues": sql(f"SELECT * FROM ({_R1}) WHERE reason <> 'MATCHED' ORDER BY REC_ID LIMIT 20", "wres"),
    "r1_custody_summary": sql(f"SELECT count(*) AS records, count(*) FILTER (WHERE reason = 'MATCHED') AS matched, count(*) FILTER (WHERE reason <> 'MATCHED') AS unmatched FROM ({_R1})", "wres"),
    "r2_crm_reconciliation": sql(f"""SELECT e.pk AS accountNbr, e.op AS lastOp, c.status AS curated, e.expected, CASE WHEN c.pk IS NULL THEN 'MISSING' WHEN c.status <> e.expected THEN 'STATUS_MISMATCH' WHEN n.client_name IS NOT NULL AND c.client_name <> n.client_name THEN 'STALE_CLIENT_EMBED' ELSE 'MATCHED' END AS reason
      FROM (SELECT pk, arg_max(op, lsn) AS op, CASE WHEN arg_max(op, lsn) = 'd' THEN 'CLOSED' ELSE arg_max(status, lsn) END AS expected FROM ace GROUP BY pk) e LEFT JOIN ({_CUR}) c ON e.pk = c.pk
      LEFT JOIN (SELECT pk, arg_max(client_name, lsn) AS client_name FROM cli WHERE op <> 'd' AND client_name <> '' GROUP BY pk) n ON n.pk = c.client_id""", "ace", "cli"),
    "r3_vendor_reconciliation": sql("SELECT Vendor_Ref AS vendorRef, securityId, CASE WHEN securityId IS NULL THEN 'UNMATCHED_VENDOR_RECORD' ELSE 'MATCHED' END AS reason FROM vres WHERE channel = 0", "vres"),
    "r4_freshness": _FRESH,
    "r5_dead_letter_summary": f"SELECT topic, count, CAST(sum(count) OVER () AS BIGINT) AS totalDeadLettered, samples FROM ({_SAMPLES.format(3, _LET)})",
    "r6_batch_history": "SELECT 'B' || strftime(day, '%Y%m%d') AS batchId, recordCount, extractedAt, CASE WHEN day(day) % 7 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS recordCount, max(ts) AS extractedAt FROM events GROUP BY 1) ORDER BY extractedAt DESC LIMIT 10",
    "r7_release_checks": sql(f"""SELECT "check", status, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) OVER () WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS overall FROM (
      SELECT 'tables_populated' AS "check", CASE WHEN (SELECT count(*) FROM orders) = 0 OR (SELECT count(*) FROM events) = 0 OR (SELECT count(*) FROM events WHERE event_type = 'error') = 0 THEN 'FAIL' ELSE 'PASS' END AS status
      UNION ALL SELECT 'custody_feed_freshness', CASE WHEN DATE '2024-01-31' - max(CAST(strptime('2024011' || f, '%Y%m%d') AS DATE)) <= 3 THEN 'PASS' ELSE 'WARN' END FROM wres WHERE ok
      UNION ALL SELECT 'custody_reconciliation', CASE WHEN count(*) FILTER (WHERE reason <> 'MATCHED') = 0 THEN 'PASS' ELSE 'WARN' END FROM ({_R1})
      UNION ALL SELECT 'feed_freshness', CASE WHEN count(*) FILTER (WHERE status = 'STALE') > 0 THEN 'WARN' ELSE 'PASS' END FROM ({_FRESH})
      UNION ALL SELECT 'dead_letters_empty', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END FROM ({_LET}))""", "wres"),
    "l5_dead_letter_counters": _SAMPLES.format(10, _LET),
    "l6_heartbeats": _BEATS,
    "a5_footer_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in BASE_TABLES),
    "a5_table_counts": "SELECT 'transactions' AS \"table\", count(*) AS rows, max(o_orderdate) AS lastInsert FROM orders UNION ALL SELECT 'events', count(*), max(ts) FROM events UNION ALL SELECT 'errors', count(*), max(ts) FROM events WHERE event_type = 'error'",
}
