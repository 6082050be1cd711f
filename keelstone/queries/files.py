"""Batch files, drops, snapshots and change events, written by Spark from the test tables and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import delta
from ..plans import vendor
from ..sources import feeds, fixed_width as fw
from ..operators.select import places
from ..tables import fixed, load, shared_folder, stored
from . import standins as S
from .standins import sql

AT = dt.datetime(2024, 1, 31)


def _lines(spark, d, packed=False):
    return fw.classify(fw.read_lines(spark, S.wire_files(spark, d, packed)))


def s1(spark, d):
    return _lines(spark, d).groupBy(F.concat("file", F.lit(".dat")).alias("file"), "kind").agg(F.count("*").alias("n"))


def s2(spark, d):
    """Details of compressed files; numbering stores their lines alone."""
    x = fw.details(_lines(spark, d, packed=True))
    return x.select("REC_ID", F.col("POS_ACCT_NBR").cast("bigint").alias("acct"), "POS_ISIN_NBR", "POS_SHR_QTY", "POS_MKT_VALUE")


def s3(spark, d):
    return fw.controls(_lines(spark, d)).select("file", "recordCount", "rejectedCount", "trailerRecordCount", "totalQty", "totalValue", "status", "failReason")


def s4(spark, d):
    """Totals and ids of one pass over the files, of which a row per split stays."""
    summed = fw.summaries(spark, S.wire_files(spark, d))
    x = fw.manifests(fw.controls(summed), fw.batch_ids(summed), F.lit(AT))
    return x.select("batchId", "cycleDate", "fileName", "recordCount", "controlTotalQty", "status", "failReason", "rejectedCount")


def s5(spark, d):
    lines = _lines(spark, d)
    verdicts = stored(fw.controls(lines))  # a row per file, read by both
    good = fw.accepted(lines.filter("kind = 'detail'"), verdicts).groupBy("file").agg(F.count("*").alias("n")).withColumn("what", F.lit("landed"))
    bad = fw.quarantined(lines, verdicts).groupBy("file").agg(F.count("*").alias("n")).withColumn("what", F.lit("quarantined"))
    return good.unionByName(bad)


def s6(spark, d):
    """Of four batches, two are in the ledger under their own ids and one under another content; the ids follow the bytes."""
    ids = fixed(fw.batch_ids(fw.raw_lines(spark, S.wire_files(spark, d))))
    old = ids.filter(F.col("file").isin("CUSTPOS_20240110", "CUSTPOS_20240111")).select("batchId").unionByName(ids.filter("file = 'CUSTPOS_20240112'").select(F.concat("file", F.lit(":000000000000")).alias("batchId")))
    return fw.unseen(ids, old).select("file", "batchId")


def s7(spark, d):
    x = feeds.read_drops(spark, S.drop_files(spark, d))
    return x.select("MOV_FILE_DATE", "MOV_FILE_TIME", "MOVEMENT_ID", "MOV_ACCT_NBR", "MOV_CCY_CD", "MOV_AMT", "MOV_TYPE_CD")


def s8(spark, d):
    """The snapshot passes its gate; the same one with a wrong count is refused."""
    x = feeds.read_snapshot(spark, S.snapshot_file(spark, d))
    try:
        feeds.read_snapshot(spark, S.snapshot_file(spark, d, extra=1))
        refused = False
    except ValueError as e:
        refused = "COUNT_MISMATCH" in str(e)
    return x.select("Vendor_Ref", F.upper(F.trim("ISIN_CODE")).alias("isin"), "SecurityDesc", F.lit(refused).alias("bad_copy_refused"))


def s9(spark, d):
    """The files in the order in which they are found: oldest name first."""
    x = places(feeds.discover(spark, S.wire_files(spark, d), "*.txt"), "place")
    return x.select("place", F.regexp_extract("path", r"(CUSTPOS_[0-9]{8})", 1).alias("file"), F.col("length").alias("bytes"))


def s10(spark, d):
    e = load(spark, d, "events").select("event_id", "ts")
    x = feeds.incremental(e, "ts", dt.datetime(2024, 1, 20))
    return x.agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("ts").alias("watermark"))


def s10_cycle(spark, d):
    """Two polls of a table to which rows are added while the first one writes: together they land every row once or more, and none is skipped."""
    from ..tables import VersionedTable, shared_folder

    e, root = load(spark, d, "events").select("event_id", "ts"), shared_folder(spark)
    half = e.agg(F.percentile_approx("ts", 0.5)).first()[0]
    e.filter(F.col("ts") <= F.lit(half)).write.parquet(f"{root}/source")
    later, marks = e.filter(F.col("ts") > F.lit(half)), VersionedTable(spark, f"{root}/marks")

    def write(rows):
        first = not landed
        landed.append(f"{root}/landed/{len(landed)}")
        rows.write.parquet(landed[-1])
        if first:
            later.write.mode("append").parquet(f"{root}/source")

    landed: list[str] = []
    for _ in range(2):
        feeds.poll(spark.read.parquet(f"{root}/source"), "ts", marks, "events", write)
    return spark.read.parquet(*landed).distinct()


def s11(spark, d):
    from ..registry import ACCOUNT_IMAGE

    x = feeds.unwrap(S.change_records(spark, d, "accounts"), ACCOUNT_IMAGE, "account_nbr", "accounts")
    return x.select("EVENT_ID", "OP", "PK", "LSN", "TS_MS", F.col("AFTER.account_name").alias("after_name"), F.col("BEFORE.account_name").alias("before_name"), "reject")


def s12(spark, d):
    return feeds.stamp(S.vendor_rows(spark, d, 0)).select("Vendor_Ref", "SRC_UPDATED_AT")


def _retained(spark, d) -> tuple[delta.Retained, object, object]:
    """The previous population of parts as retained by an earlier cycle, and the incoming one."""
    a, b = S.snapshots(spark, d)
    index = delta.Retained(spark, shared_folder(spark), "p_partkey")
    index.replace(a)
    return index, a, b


def j8(spark, d):
    """The retained side is bucketed by key: it is joined without an exchange, by its stored hashes."""
    index, a, b = _retained(spark, d)
    return delta.delta(delta.retained_index(index.read(a.schema), "p_partkey"), delta.index_of(b, "p_partkey"), retained=True).select("key", "change")


def a7(spark, d):
    index, a, b = _retained(spark, d)
    return delta.statistics(delta.delta(delta.retained_index(index.read(a.schema), "p_partkey"), delta.index_of(b, "p_partkey"), retained=True))


def c6(spark, d):
    """Three cycles of the true-up against the retained snapshot: the first fills it, a dry run writes nothing, the second emits what changed; a fourth finds nothing more."""
    prev = feeds.stamp(S.vendor_rows(spark, d, 0)).filter("CAST(substr(Vendor_Ref, 2) AS INT) % 50 <> 0")
    cur = feeds.stamp(S.vendor_rows(spark, d, 0)).filter("CAST(substr(Vendor_Ref, 2) AS INT) % 37 <> 0").withColumn("Issuer_Name", F.when(F.expr("CAST(substr(Vendor_Ref, 2) AS INT) % 11 = 0"), "New issuer").otherwise(F.col("Issuer_Name")))
    root, at = shared_folder(spark), F.lit("2026-02-01T00:00:00+00:00")
    index, sent = delta.Retained(spark, f"{root}/index", "Vendor_Ref", "SRC_UPDATED_AT"), []

    def write(rows):
        sent.append(f"{root}/sent/{len(sent)}")
        rows.write.parquet(sent[-1])

    vendor.apply_true_up(index, prev, at, write)
    vendor.apply_true_up(index, cur, at, write, dry_run=True)
    vendor.apply_true_up(index, cur, at, write)
    vendor.apply_true_up(index, cur, at, write)
    second, third = spark.read.parquet(sent[1]), spark.read.parquet(sent[2])
    return second.unionByName(third).select("Vendor_Ref", "change", "SRC_UPDATED_AT", "ISSUE_STATUS", "Cusip")


def c7(spark, d):
    """The hash of every row, whatever the order of its columns, and without one of them."""
    x = S.transactions(spark, d)
    from ..functions.columns import content_hash

    cols = x.columns
    return x.select("transactionId", content_hash(cols).alias("a"), content_hash(cols[::-1]).alias("b"), content_hash(cols, ("status",)).alias("c"))


QUERIES = {"s1_fixed_width_scan": s1, "s2_sequence": s2, "s3_control_totals": s3, "s4_manifests": s4, "s5_quarantine": s5, "s6_unseen_batches": s6, "s7_delimited_drops": s7, "s8_snapshot_gate": s8, "s9_discovery": s9, "s10_incremental": s10, "s10_poll_cycle": s10_cycle, "s11_change_events": s11, "s12_source_stamp": s12, "j8_snapshot_delta": j8, "a7_delta_statistics": a7, "c6_true_up": c6, "c7_content_hash": c7}

_F = "'CUSTPOS_2024011' || f"
_TX = ["accountId", "netAmount", "status", "tradeDate", "transactionId", "transactionType"]
_hash = lambda cols: "substr(sha256(CAST(to_json({" + ", ".join(f"'{c}': CAST({c} AS VARCHAR)" for c in cols) + "}) AS VARCHAR)), 1, 16)"
_DELTA = """SELECT coalesce(a.p_partkey, b.p_partkey) AS key, CASE WHEN a.p_partkey IS NULL THEN 'ADDED' WHEN b.p_partkey IS NULL THEN 'REMOVED' WHEN a.p_partkey % 11 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS change
  FROM (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0) a FULL JOIN (SELECT p_partkey FROM part WHERE p_partkey % 37 <> 0) b ON a.p_partkey = b.p_partkey"""
_CTL = f"""SELECT f, {_F} AS file, count(*) FILTER (WHERE ok) AS recordCount, count(*) FILTER (WHERE NOT ok) AS rejectedCount, count(*) AS trailerRecordCount, CAST(coalesce(sum(qty) FILTER (WHERE ok), 0) AS DECIMAL(28,4)) AS totalQty, CAST(coalesce(sum(val) FILTER (WHERE ok), 0) AS DECIMAL(28,2)) AS totalValue,
  CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 OR f = 3 THEN 'FAILED' ELSE 'COMPLETE' END AS status, CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'REJECTED_LINES' WHEN f = 3 THEN 'VALUE_MISMATCH' END AS failReason FROM wire GROUP BY f"""
_Z = lambda c, n, scale: f"lpad(CAST(CAST({c} * {10**scale} AS BIGINT) AS VARCHAR), {n}, '0')"
_LINE = f"""CASE WHEN NOT ok THEN '03 short line' ELSE '03' || day || '0010001' || lpad(CAST(acct AS VARCHAR), 12, '0') || 'CU' || rpad(CASE WHEN blank OR k % 4 = 0 THEN '' ELSE lpad(CAST(k AS VARCHAR), 9, '0') END, 9, ' ')
  || rpad(CASE WHEN blank THEN '' ELSE 'US' || lpad(CAST(k AS VARCHAR), 9, '0') || k % 10 END, 12, ' ') || rpad('SECURITY', 40, ' ') || 'EQURDTC ' || {_Z('qty', 16, 4)} || repeat('0', 16)
  || lpad(CAST(CAST(CAST(val AS DECIMAL(18,2)) % 1000 * 100 AS BIGINT) AS VARCHAR) || repeat('0', 10), 15, '0') || {_Z('val', 15, 2)} || '0000012345}}202401020240109NUSD' || rpad('MF01', 8, ' ') END"""
#: The wire files line by line, and their content hash: three polynomials modulo 2^31 - 1 by Horner's rule.
_HORNER = ", ".join(f"list_reduce(list(CAST('0x' || substr(h, {1 + 7 * k}, 7) AS BIGINT) + 1 ORDER BY pos DESC), lambda a, x: (a * {base} + x) % {fw.PRIME}) AS d{k}" for k, base in enumerate(fw.BASES))
_BYTES = f"""SELECT f, bytes, {_F} || ':' || substr(sha256(concat_ws(':', bytes, n, d0, d1, d2)), 1, 12) AS batchId FROM (
  SELECT f, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, count(*) AS n, {_HORNER} FROM (SELECT *, md5(line) AS h FROM (
    SELECT f, seq AS pos, {_LINE} AS line FROM (SELECT *, '2024011' || f AS day FROM wire)
    UNION ALL SELECT f, 0, rpad('012024011' || f || 'MF01    20240110000000', 200, ' ') FROM (SELECT DISTINCT f FROM wire)
    UNION ALL SELECT f, 1152921504606846976, rpad('992024011' || f || lpad(CAST(count(*) AS VARCHAR), 9, '0') || {_Z('sum(qty) FILTER (WHERE ok)', 18, 4)} || {_Z('(sum(val) FILTER (WHERE ok) + CASE WHEN f = 3 THEN 1 ELSE 0 END)', 18, 2)}, 200, ' ') FROM wire GROUP BY f)) GROUP BY f)"""
SQL = {
    "s1_fixed_width_scan": sql(f"SELECT {_F} || '.dat' AS file, CASE WHEN ok THEN 'detail' ELSE 'reject' END AS kind, count(*) AS n FROM wire GROUP BY ALL UNION ALL SELECT {_F} || '.dat', unnest(['header', 'trailer']), 1 FROM (SELECT DISTINCT f FROM wire)", "wire"),
    "s2_sequence": sql("SELECT '2024011' || f || '-' || lpad(CAST(row_number() OVER (PARTITION BY f ORDER BY rn) AS VARCHAR), 6, '0') AS REC_ID, acct, CASE WHEN blank THEN '' ELSE 'US' || lpad(CAST(k AS VARCHAR), 9, '0') || k % 10 END AS POS_ISIN_NBR, lpad(CAST(CAST(qty * 10000 AS BIGINT) AS VARCHAR), 16, '0') AS POS_SHR_QTY, lpad(CAST(CAST(val * 100 AS BIGINT) AS VARCHAR), 15, '0') AS POS_MKT_VALUE FROM wire WHERE ok", "wire"),
    "s3_control_totals": sql(f"SELECT * EXCLUDE (f) FROM ({_CTL})", "wire"),
    "s4_manifests": sql(f"SELECT batchId, substr(file, 9) AS cycleDate, file AS fileName, recordCount, totalQty AS controlTotalQty, status, failReason, rejectedCount FROM ({_CTL}) JOIN ({_BYTES}) USING (f)", "wire"),
    "s5_quarantine": sql(f"SELECT file, recordCount AS n, 'landed' AS what FROM ({_CTL}) WHERE status = 'COMPLETE' UNION ALL SELECT file, least(rejectedCount, 100), 'quarantined' FROM ({_CTL}) WHERE status = 'FAILED' AND rejectedCount > 0", "wire"),
    "s6_unseen_batches": sql(f"SELECT {_F} AS file, batchId FROM ({_BYTES}) WHERE f IN (2, 3)", "wire"),
    "s7_delimited_drops": sql("""SELECT strftime(day, '%Y%m%d') AS MOV_FILE_DATE, '1030' AS MOV_FILE_TIME, 'CASHMOV_' || strftime(day, '%Y%m%d') || '_1030-' || lpad(CAST(row_number() OVER (PARTITION BY day ORDER BY event_id) AS VARCHAR), 5, '0') AS MOVEMENT_ID,
      coalesce(CAST(acct AS VARCHAR), 'X1') AS MOV_ACCT_NBR, ccy AS MOV_CCY_CD, CASE event_id % 50 WHEN 7 THEN '' WHEN 8 THEN 'abc' ELSE CAST(amount AS VARCHAR) END AS MOV_AMT, event_type AS MOV_TYPE_CD FROM mov""", "mov"),
    "s8_snapshot_gate": sql("SELECT Vendor_Ref, coalesce(isin, CASE WHEN k % 5 = 2 THEN '#N/A' ELSE '-' END) AS isin, p_name AS SecurityDesc, TRUE AS bad_copy_refused FROM vend WHERE channel = 0", "vend"),
    "s9_discovery": sql(f"SELECT CAST(f + 1 AS BIGINT) AS place, {_F} AS file, bytes FROM ({_BYTES})", "wire"),
    "s10_incremental": "SELECT count(*) AS n, min(event_id) AS first, max(ts) AS watermark FROM events WHERE ts >= TIMESTAMP '2024-01-19 23:59:00'",
    "s10_poll_cycle": "SELECT event_id, ts FROM events",
    "s11_change_events": sql("SELECT lsn || '-accounts-' || pk AS EVENT_ID, op AS OP, pk AS PK, CAST(lsn AS VARCHAR) AS LSN, CAST(ms AS VARCHAR) AS TS_MS, CASE WHEN op <> 'd' THEN account_name END AS after_name, CASE WHEN op = 'd' THEN account_name END AS before_name, NULL AS reject FROM ace", "ace"),
    "s12_source_stamp": sql("SELECT Vendor_Ref, stamp AS SRC_UPDATED_AT FROM vend WHERE channel = 0", "vend"),
    "j8_snapshot_delta": _DELTA,
    "a7_delta_statistics": f"SELECT *, added + changed + unchanged AS in_snapshot, added + changed + removed AS emitted, round(1 - (added + changed + removed) / (added + changed + unchanged), 4) AS suppression_ratio FROM (SELECT count(*) FILTER (WHERE change = 'ADDED') AS added, count(*) FILTER (WHERE change = 'CHANGED') AS changed, count(*) FILTER (WHERE change = 'REMOVED') AS removed, count(*) FILTER (WHERE change = 'UNCHANGED') AS unchanged FROM ({_DELTA}))",
    "c6_true_up": sql("""SELECT Vendor_Ref, CASE WHEN k % 37 = 0 THEN 'REMOVED' WHEN k % 50 = 0 THEN 'ADDED' ELSE 'CHANGED' END AS change, CASE WHEN k % 37 = 0 THEN '2026-02-01T00:00:00+00:00' ELSE stamp END AS SRC_UPDATED_AT,
      CASE WHEN k % 37 = 0 THEN 'DELISTED' ELSE ['A', 'ACT', 'mat''d', 'Delisted', '???'][k % 5 + 1] END AS ISSUE_STATUS, coalesce(cusip, 'N/A') AS Cusip FROM vend WHERE channel = 0 AND ((k % 37 = 0 AND k % 50 <> 0) OR (k % 37 <> 0 AND (k % 50 = 0 OR k % 11 = 0)))""", "vend"),
    "c7_content_hash": sql(f"SELECT transactionId, {_hash(_TX)} AS a, {_hash(_TX)} AS b, {_hash([c for c in _TX if c != 'status'])} AS c FROM tx", "tx"),
}
