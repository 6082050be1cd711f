"""The library's tables, derived from the test tables by Spark (functions) and by SQL (``CTE``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.select import number_rows
from ..tables import TASK_ROWS, discard, load, shared_folder, shares, shuffles_removed, stored

MONEY = "decimal(18,2)"


def transactions(spark, d) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("transactionId"), F.col("o_custkey").alias("accountId"), F.col("o_orderdate").alias("tradeDate"), F.col("o_orderpriority").alias("transactionType"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast(MONEY).alias("netAmount"))


def _pad(c, n):
    return F.lpad(c.cast("string"), n, "0")


def acc(c):
    return F.concat(F.lit("ACC-"), _pad(c, 6))


def sec(c):
    return F.concat(F.lit("SEC-"), _pad(c, 6))


def accounts(spark, d) -> DataFrame:
    """Customers with an embedded client: client number c_custkey % 97, domicile from the nation's region."""
    k, cno = F.col("c_custkey"), F.col("cno")
    x = load(spark, d, "customer").withColumn("cno", F.col("c_custkey") % 97)
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = x.join(n, cno % 25 == F.col("n_nationkey"))
    domicile = F.upper(F.substring("r_name", 1, 2))
    base = F.concat(F.lit("5A93"), _pad(cno, 14))
    check = 98 - (F.concat(F.replace(base, F.lit("A"), F.lit("10")), F.lit("00")).cast("decimal(38,0)") % 97).cast("int")
    lei = F.concat(base, F.when(cno % 7 == 0, "00").otherwise(_pad(check, 2)))
    homes = F.when(k % 11 == 0, F.array(F.lit("US"))).when(k % 3 == 0, F.array(domicile, F.lit("US"))).otherwise(F.array(domicile))
    client = F.struct(
        F.concat(F.lit("CLI-"), _pad(cno, 4)).alias("clientId"), F.concat(F.lit("Client "), cno, F.when(k % 31 == 0, "*").otherwise("")).alias("clientName"), lei.alias("lei"), domicile.alias("countryOfDomicile"), domicile.alias("countryOfIncorporation"),
        homes.alias("taxResidencies"), F.lit("RETAIL").alias("classification"), F.lit("APPROVED").alias("kycStatus"), F.lit("LOW").alias("riskRating"), F.lit("FUND").alias("legalEntityType"),
        F.when(cno % 10 == 0, F.concat(F.lit("CLI-"), _pad(cno + 50, 4))).alias("parentClientId"),
    )
    status = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "SUSPENDED").when(F.col("c_mktsegment") == "BUILDING", "CLOSED").otherwise("ACTIVE")
    return x.select(acc(k).alias("accountId"), F.col("c_name").alias("accountName"), status.alias("status"), client.alias("client"), F.col("c_acctbal").cast(MONEY).alias("balance"))


def _sedol(n):
    six = F.concat(F.lit("B"), _pad(n % 3000, 5))
    digit = lambda i: F.substring(six, i, 1).cast("int")
    total = 11 + digit(2) * 3 + digit(3) * 1 + digit(4) * 7 + digit(5) * 3 + digit(6) * 9
    return F.concat(six, ((10 - total % 10) % 10).cast("string"))


def securities(spark, d) -> DataFrame:
    k = F.col("p_partkey")

    def listing(j):
        good = _sedol(k * 2 + j)
        sedol = F.when(k % 10 == 3, F.concat(F.substring(good, 1, 6), ((F.right(good, F.lit(1)).cast("int") + 1) % 10).cast("string"))).otherwise(good)
        mic = F.lit("XNYS") if j == 1 else F.when(k % 6 == 2, "XNYS").otherwise("XLON")
        ccy = F.lit("USD") if j == 1 else F.when(k % 8 == 2, "gbp").otherwise("GBP")
        return F.struct(
            sedol.alias("sedol"), mic.alias("micCode"), mic.alias("operatingMic"), F.lit(None).cast("string").alias("exchangeName"), ccy.alias("tradedCurrency"), F.lit("US" if j == 1 else "GB").alias("countryOfListing"),
            F.when(k % 13 == 0, "").otherwise("DTC").alias("settlementLocation"), F.lit(None).cast("string").alias("localCode"), (F.lit(j == 1) & (k % 17 != 2)).alias("primaryListing"), F.lit("ACTIVE").alias("status"),
        )

    cusip = F.when(k % 4 == 0, None).when(k % 5 == 1, _pad(k + 1, 9)).otherwise(_pad(k, 9))
    isin = F.when(k % 9 != 0, F.concat(F.when(k % 27 == 5, "us").otherwise("US"), _pad(k, 9), (k % 10).cast("string")))
    kind = F.element_at(F.array(*map(F.lit, ("EQUITY", "EQUITY", "GOVT_BOND", "CORP_BOND", "FUND"))), (k % 5 + 1).cast("int"))
    both = F.when(k % 3 == 0, F.array().cast(f"array<{'struct<sedol:string,micCode:string,operatingMic:string,exchangeName:string,tradedCurrency:string,countryOfListing:string,settlementLocation:string,localCode:string,primaryListing:boolean,status:string>'}>")).when(k % 3 == 1, F.array(listing(1))).otherwise(F.array(listing(1), listing(2)))
    return load(spark, d, "part").select(sec(k).alias("securityId"), F.lit(None).cast("string").alias("vendorUpdatedAt"), isin.alias("isin"), cusip.alias("cusip"), F.concat(F.lit("T"), k).alias("ticker"), F.col("p_name").alias("description"), kind.alias("assetClass"), F.col("p_brand").alias("issuer"), F.lit("ACTIVE").alias("status"), both.alias("listings"), F.col("p_retailprice").cast(MONEY).alias("price"), k.alias("k"))


def _sold(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def positions(spark, d) -> DataFrame:
    x = _sold(spark, d).groupBy("o_custkey", "l_partkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("asOfDate"))
    x = x.agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("decimal(18,4)").alias("quantity"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("marketValue"))
    return x.select(acc(F.col("o_custkey")).alias("accountId"), sec(F.col("l_partkey")).alias("securityId"), "asOfDate", "quantity", "marketValue")


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def numbered_lines(spark, d) -> DataFrame:
    return number_rows(load(spark, d, "lineitem"), [(c, True) for c in LINE])


def settlements(spark, d) -> DataFrame:
    x = numbered_lines(spark, d).join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return x.select(F.col("rn").alias("settlementId"), F.col("l_orderkey").alias("transactionId"), acc(F.col("o_custkey")).alias("accountId"), F.col("l_shipdate").alias("settlementDate"), F.when(failed, "FAILED").otherwise("SETTLED").alias("status"), F.col("l_extendedprice").cast(MONEY).alias("settlementAmount"))


def movements(spark, d) -> DataFrame:
    """Raw cash movements, as landed: all strings."""
    i = F.col("event_id")
    amount = F.col("value").cast(MONEY)
    amount = F.when(F.col("event_type").isin("error", "purchase"), -amount).otherwise(amount)
    return load(spark, d, "events").select(
        F.concat(F.lit("M-"), i).alias("MOVEMENT_ID"), F.date_format("ts", "yyyyMMdd").alias("MOV_FILE_DATE"), F.lit("1030").alias("MOV_FILE_TIME"), F.when(i % 211 == 3, "X1").otherwise(F.col("user_id").cast("string")).alias("MOV_ACCT_NBR"),
        F.when(i % 307 == 5, "").when(i % 2 == 0, "USD").otherwise("EUR").alias("MOV_CCY_CD"), F.when(i % 50 == 7, "").when(i % 50 == 8, "abc").otherwise(amount.cast("string")).alias("MOV_AMT"), F.col("event_type").alias("MOV_TYPE_CD"), F.lit("").alias("MOV_VALUE_TS"), F.lit("").alias("MOV_NARRATIVE"), F.lit("CORE").alias("MOV_SRC_SYS_ID"),
    )


BALANCE = "balanceId string, accountId string, currency string, asOfDate timestamp, openingBalance decimal(18,2), credits decimal(18,2), debits decimal(18,2), closingBalance decimal(18,2), pendingCredits decimal(18,2), pendingDebits decimal(18,2), projectedBalance decimal(18,2), snapshotType string, createdAt timestamp, updatedAt timestamp"


def openings(spark, d) -> DataFrame:
    """EOD balances of every customer on two days, in two currencies."""
    at = F.explode(F.array(*[F.struct(F.lit(day).alias("day"), F.lit(ccy).alias("ccy"), F.lit(m).alias("m"), F.lit(a).alias("a")) for day, a in (("2023-12-31", 0), ("2024-01-15", 1000)) for ccy, m in (("USD", 1), ("EUR", 2))]))
    x = load(spark, d, "customer").select("c_custkey", "c_acctbal", at.alias("s")).select("c_custkey", "c_acctbal", "s.*")
    closing = (F.col("c_acctbal").cast(MONEY) * F.col("m") + F.col("a")).cast(MONEY)
    zero, a = F.lit(0).cast(MONEY), acc(F.col("c_custkey"))
    now = F.lit("2024-01-31").cast("timestamp")
    return x.select(F.concat_ws("-", F.lit("BAL"), F.replace(a, F.lit("-"), F.lit("")), "ccy", F.replace("day", F.lit("-"), F.lit(""))).alias("balanceId"), a.alias("accountId"), F.col("ccy").alias("currency"), F.col("day").cast("timestamp").alias("asOfDate"), zero.alias("openingBalance"), zero.alias("credits"), zero.alias("debits"), closing.alias("closingBalance"), zero.alias("pendingCredits"), zero.alias("pendingDebits"), closing.alias("projectedBalance"), F.lit("EOD").alias("snapshotType"), now.alias("createdAt"), now.alias("updatedAt"))


def change_records(spark, d, table: str) -> DataFrame:
    """Change envelopes as JSON: every seventh event is a client's, the others are accounts'."""
    i, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    if table == "clients":
        pk = s(u % 20)
        image = F.struct(pk.alias("client_id"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("Client "), i)).alias("client_name"), F.element_at(F.array(*map(F.lit, ("us", "gb", ""))), (i % 3 + 1).cast("int")).alias("country_domicile"), F.element_at(F.array(*map(F.lit, ("US, GB", "", "FR,,DE"))), (i % 3 + 1).cast("int")).alias("tax_residencies"), F.element_at(F.array(*map(F.lit, ("retail", "Professional", "odd"))), (i % 3 + 1).cast("int")).alias("classification"))
        mine = i % 7 == 0
    else:
        pk = s(u)
        image = F.struct(pk.alias("account_nbr"), F.when(i % 90 != 1, s(u % 20)).alias("client_id"), F.concat(F.lit("Acct "), i).alias("account_name"), F.element_at(F.array(*map(F.lit, ("active", "Suspended", "closed", "odd"))), (i % 4 + 1).cast("int")).alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("open_date"))
        mine = i % 7 != 0
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    gone = F.col("event_type") == "error"
    e = F.struct(op.alias("op"), F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"), F.struct(i.alias("lsn"), ms.alias("ts_ms")).alias("source"), ms.alias("ts_ms"))
    return load(spark, d, "events").filter(mine).select(F.to_json(e).alias("value"))


def vendor_rows(spark, d, channel: int) -> DataFrame:
    """Vendor rows of one of two channels: other dates, lost zeros, sentinels, four timestamp formats."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    cusip = F.when(k % 5 == 2, "N/A").when(k % 3 == 0, k.cast("string")).otherwise(_pad(k, 9))
    isin = F.when(k % 5 == 2, " #n/a ").when(k % 4 == 1, F.concat(F.lit("US"), _pad(k, 9), (k % 10).cast("string"))).otherwise("-")
    day = F.date_add(F.lit("2026-01-01").cast("date"), ((k * 7 + channel * 13) % 28).cast("int"))
    ts = F.when((k % 8 == 7) & F.lit(channel == 0), "N/A").when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(day, "yyyyMMdd")).when(k % 4 == 2, F.date_format(day, "MM/dd/yyyy")).otherwise(F.upper(F.date_format(day, "dd-MMM-yy")))
    words = F.array(*map(F.lit, ("A", "ACT", "mat'd", "Delisted", "???")))
    part = load(spark, d, "part").select("p_partkey", "p_name")
    return part.repartition(shares(part), "p_partkey").filter(k % 20 != 19).select(  # a table of one split is parsed by many tasks
        F.concat(F.lit("V"), _pad(k, 7)).alias("Vendor_Ref"), cusip.alias("Cusip"), isin.alias("ISIN_CODE"), none.alias("sedol"), none.alias("TICKER"), F.col("p_name").alias("SecurityDesc"),
        F.when(k % 6 == channel, "").otherwise(F.concat(F.lit(f"Issuer{channel} "), k)).alias("Issuer_Name"), none.alias("ASSET_CLS"), none.alias("CPN_RATE"), none.alias("MATURITY_DT"), F.lit("USD").alias("CCY"), none.alias("CNTRY_DOM"), none.alias("CALLABLE_FLG"),
        F.element_at(words, ((k + channel) % 5 + 1).cast("int")).alias("ISSUE_STATUS"), none.alias("EXCH_CD"), ts.alias("LAST_UPD_TS"),
    )


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two populations of parts: the previous and the incoming one."""
    x = load(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").cast(MONEY).alias("price"))
    k = F.col("p_partkey")
    return x.filter(k % 50 != 0), x.filter(k % 37 != 0).withColumn("price", F.when(k % 11 == 0, F.col("price") + 1).otherwise(F.col("price")).cast(MONEY))


def wire_files(spark, d, packed: bool = False) -> str:
    """A landing folder of four custody files made from lineitem, written by Spark: two good, one with a short line, one with a wrong total; and a file still being written.

    Each is a folder of part files of some ``TASK_ROWS`` lines in order; what is shuffled are the numbers that a line is made of.  ``packed``: the part files are compressed, each read by one task.
    """
    from ..functions.columns import to_zoned

    sold = load(spark, d, "lineitem")
    numbered = number_rows(sold, [(c, True) for c in LINE], keep=["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])
    x = numbered.repartition(shares(sold), "l_orderkey").join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = stored(x.select("rn", "l_partkey", F.col("l_quantity").cast("decimal(18,4)").alias("qty"), F.col("l_extendedprice").cast(MONEY).alias("value"), "o_custkey"))  # read for the totals and for the lines
    discard(numbered)
    f, qty, value = F.pmod("rn", F.lit(4)), F.col("qty"), F.col("value")  # the number of the file
    day, price = F.concat(F.lit("2024011"), f), value % 1000
    put = lambda c, n: F.rpad(c, n, " ")
    k = F.col("l_partkey")
    cusip = F.when(F.col("rn") % 40 == 1, "").when(k % 4 == 0, "").otherwise(_pad(k, 9))
    isin = F.when(F.col("rn") % 40 == 1, "").otherwise(F.concat(F.lit("US"), _pad(k, 9), (k % 10).cast("string")))
    acct = F.when(F.col("rn") % 50 == 2, F.lit("900001")).otherwise(F.col("o_custkey").cast("string"))
    interest = F.concat(F.lit("0000012345"), F.lit("}"))
    line = F.concat(
        F.lit("03"), day, F.lit("001"), F.lit("0001"), F.lpad(acct, 12, "0"), F.lit("CU"), put(cusip, 9), put(isin, 12), put(F.lit("SECURITY"), 40), F.lit("EQU"), F.lit("R"), F.lit("DTC "),
        to_zoned(qty, 16, 4), to_zoned(F.lit(0), 16, 4), to_zoned(price, 15, 12), to_zoned(value, 15, 2), interest, F.lit("2024010"), F.lit("20240109"), F.lit("N"), F.lit("USD"), put(F.lit("MF01"), 8),
    )
    short = (f == 2) & (F.col("rn") % 1000 == 2)
    line = F.coalesce("mark", F.when(short, F.lit("03 short line")).otherwise(line))
    ok = ~short
    sums = x.groupBy(f.alias("f")).agg(F.count("*").alias("n"), F.sum(F.when(ok, qty)).alias("q"), F.sum(F.when(ok, value)).alias("v"))
    sums = stored(sums)  # a row per file
    head = sums.select((F.col("f") - 4).alias("rn"), F.rpad(F.concat(F.lit("012024011"), "f", F.lit("MF01    20240110000000")), 200, " ").alias("mark"))
    tail = sums.select((F.col("f") + (1 << 60)).alias("rn"), F.rpad(F.concat(F.lit("992024011"), "f", _pad(F.col("n"), 9), to_zoned(F.col("q"), 18, 4), to_zoned(F.col("v") + F.when(F.col("f") == 3, 1).otherwise(0), 18, 2)), 200, " ").alias("mark"))
    every = x.unionByName(head.unionByName(tail), allowMissingColumns=True)
    parts = max(4, -(-sums.agg(F.sum("n")).first()[0] // TASK_ROWS)) if not sums.isEmpty() else 1
    out = f"{shared_folder(spark)}/custody"
    every = every.repartitionByRange(parts, f, "rn").withColumn("file", F.concat(F.lit("CUSTPOS_"), day, F.lit(".dat")))  # named behind the shuffle
    with shuffles_removed(spark):
        every.sortWithinPartitions("file", "rn").select("file", line.alias("line")).write.option("compression", "gzip" if packed else "none").partitionBy("file").text(out)
    discard(x, sums)
    return out


def drop_files(spark, d) -> str:
    """Cash drops, one per day, from the movements."""
    from ..registry import CASH_FIELDS

    m = movements(spark, d)
    body = m.select(F.concat(F.lit("CASHMOV_"), "MOV_FILE_DATE", F.lit("_"), "MOV_FILE_TIME", F.lit(".csv")).alias("file"), F.substring_index("MOVEMENT_ID", "-", -1).cast("bigint").alias("o"), F.concat_ws(",", *[F.concat(F.lit(" "), c) if c == "MOV_CCY_CD" else F.col(c) for c in CASH_FIELDS]).alias("line"))
    head = body.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("o"), F.lit(",".join(CASH_FIELDS)).alias("line"))
    out = f"{shared_folder(spark)}/cash"
    head.unionByName(body).repartition("file").sortWithinPartitions("file", "o").select("file", "line").write.partitionBy("file").text(out)
    return out


def snapshot_file(spark, d, extra: int = 0) -> str:
    """The vendor snapshot with its trailer; ``extra`` falsifies the declared count."""
    from ..registry import VENDOR_FIELDS

    x = vendor_rows(spark, d, 0)
    body = x.select(F.lit("SECMASTER_20260131.csv").alias("file"), F.lit(1).alias("p"), F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in VENDOR_FIELDS]).alias("line"), F.col("Vendor_Ref").alias("o"))
    head = spark.range(1).select(F.lit("SECMASTER_20260131.csv").alias("file"), F.lit(0).alias("p"), F.lit(",".join(VENDOR_FIELDS)).alias("line"), F.lit("").alias("o"))
    tail = x.agg(F.count("*").alias("n")).select(F.lit("SECMASTER_20260131.csv").alias("file"), F.lit(2).alias("p"), F.concat(F.lit("TRAILER,"), (F.col("n") + extra).cast("string")).alias("line"), F.lit("").alias("o"))
    out = f"{shared_folder(spark)}/snapshot"
    head.unionByName(body).unionByName(tail).repartition("file").sortWithinPartitions("file", "p", "o").select("file", "line").write.partitionBy("file").text(out)
    return out


def _p(c: str, n: int) -> str:
    return f"lpad(CAST({c} AS VARCHAR), {n}, '0')"


_SEDOL6 = f"'B' || {_p('(k * 2 + j) % 3000', 5)}"
_SUM = "11 + " + " + ".join(f"CAST(substr(s6, {i}, 1) AS INT) * {w}" for i, w in ((2, 3), (3, 1), (4, 7), (5, 3), (6, 9)))

CTE = {
    "tx": "SELECT o_orderkey AS transactionId, o_custkey AS accountId, o_orderdate AS tradeDate, o_orderpriority AS transactionType, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS netAmount FROM orders",
    "acct": f"""SELECT 'ACC-' || {_p('c_custkey', 6)} AS accountId, c_name AS accountName, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SUSPENDED' WHEN 'BUILDING' THEN 'CLOSED' ELSE 'ACTIVE' END AS status,
      'CLI-' || {_p('cno', 4)} AS clientId, 'Client ' || cno || CASE WHEN c_custkey % 31 = 0 THEN '*' ELSE '' END AS clientName, base || CASE WHEN cno % 7 = 0 THEN '00' ELSE {_p("98 - CAST(replace(base, 'A', '10') || '00' AS HUGEINT) % 97", 2)} END AS lei,
      upper(substr(r_name, 1, 2)) AS domicile, CASE WHEN c_custkey % 11 = 0 THEN ['US'] WHEN c_custkey % 3 = 0 THEN [upper(substr(r_name, 1, 2)), 'US'] ELSE [upper(substr(r_name, 1, 2))] END AS homes,
      CASE WHEN cno % 10 = 0 THEN 'CLI-' || {_p('cno + 50', 4)} END AS parentClientId, CAST(c_acctbal AS DECIMAL(18,2)) AS balance
      FROM (SELECT *, c_custkey % 97 AS cno, '5A93' || {_p('c_custkey % 97', 14)} AS base FROM customer) JOIN nation ON cno % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sec": f"""SELECT 'SEC-' || {_p('p_partkey', 6)} AS securityId, CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 27 = 5 THEN 'us' ELSE 'US' END || {_p('p_partkey', 9)} || p_partkey % 10 END AS isin,
      CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN {_p('p_partkey + 1', 9)} ELSE {_p('p_partkey', 9)} END AS cusip, 'T' || p_partkey AS ticker, p_name AS description,
      ['EQUITY', 'EQUITY', 'GOVT_BOND', 'CORP_BOND', 'FUND'][p_partkey % 5 + 1] AS assetClass, p_brand AS issuer, 'ACTIVE' AS status, CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_partkey AS k FROM part""",
    "lst": f"""SELECT securityId, assetClass, k, j, CASE WHEN k % 10 = 3 THEN s6 || (CAST((10 - tot % 10) % 10 AS INT) + 1) % 10 ELSE s6 || (10 - tot % 10) % 10 END AS sedol,
      CASE WHEN j = 1 OR k % 6 = 2 THEN 'XNYS' ELSE 'XLON' END AS micCode, CASE WHEN j = 1 THEN 'USD' WHEN k % 8 = 2 THEN 'gbp' ELSE 'GBP' END AS tradedCurrency, CASE j WHEN 1 THEN 'US' ELSE 'GB' END AS countryOfListing,
      CASE WHEN k % 13 = 0 THEN '' ELSE 'DTC' END AS settlementLocation, j = 1 AND k % 17 <> 2 AS primaryListing
      FROM (SELECT *, {_SUM} AS tot FROM (SELECT securityId, assetClass, k, j, {_SEDOL6} AS s6 FROM sec, (SELECT unnest([1, 2]) AS j) WHERE j <= k % 3))""",
    "sold": "SELECT l.*, o_custkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey",
    "pos": f"""SELECT 'ACC-' || {_p('o_custkey', 6)} AS accountId, 'SEC-' || {_p('l_partkey', 6)} AS securityId, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS asOfDate, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS quantity,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS marketValue FROM sold GROUP BY o_custkey, l_partkey, date_trunc('month', l_shipdate)""",
    "lines": f"SELECT *, row_number() OVER (ORDER BY {', '.join(LINE)}) AS rn FROM lineitem",
    "stl": f"""SELECT rn AS settlementId, l_orderkey AS transactionId, 'ACC-' || {_p('o_custkey', 6)} AS accountId, l_shipdate AS settlementDate, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'FAILED' ELSE 'SETTLED' END AS status,
      CAST(l_extendedprice AS DECIMAL(18,2)) AS settlementAmount FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "mov": """SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 211 <> 3 THEN user_id END AS acct, CASE WHEN event_id % 307 = 5 THEN '' WHEN event_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS ccy, event_type,
      CASE WHEN event_id % 50 IN (7, 8) THEN NULL WHEN event_type IN ('error', 'purchase') THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS amount FROM events""",
    "opn": f"""SELECT 'ACC-' || {_p('c_custkey', 6)} AS accountId, ccy AS currency, day AS asOfDate, CAST(CAST(c_acctbal AS DECIMAL(18,2)) * m + a AS DECIMAL(18,2)) AS closingBalance FROM customer,
      (VALUES (DATE '2023-12-31', 0), (DATE '2024-01-15', 1000)) d(day, a), (VALUES ('USD', 1), ('EUR', 2)) c(ccy, m)""",
    "bal": """SELECT x.*, coalesce((SELECT arg_max(o.closingBalance, o.asOfDate) FROM opn o WHERE o.accountId = x.accountId AND o.currency = x.currency AND o.asOfDate < x.asOfDate), 0) AS openingBalance FROM (
      SELECT 'ACC-' || lpad(CAST(acct AS VARCHAR), 6, '0') AS accountId, ccy AS currency, day AS asOfDate, CAST(coalesce(sum(amount) FILTER (WHERE amount >= 0), 0) AS DECIMAL(18,2)) AS credits,
      CAST(coalesce(-sum(amount) FILTER (WHERE amount < 0), 0) AS DECIMAL(18,2)) AS debits FROM mov WHERE acct IS NOT NULL AND ccy <> '' GROUP BY acct, ccy, day) x""",
    "cli": """SELECT CAST(user_id % 20 AS VARCHAR) AS pk, event_id AS lsn, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Client ' || event_id END AS client_name,
      ['us', 'gb', ''][event_id % 3 + 1] AS dom, ['US, GB', '', 'FR,,DE'][event_id % 3 + 1] AS res, ['RETAIL', 'PROFESSIONAL', 'RETAIL'][event_id % 3 + 1] AS classification, epoch_us(ts) // 1000 AS ms FROM events WHERE event_id % 7 = 0""",
    "ace": """SELECT CAST(user_id AS VARCHAR) AS pk, event_id AS lsn, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, CASE WHEN event_id % 90 <> 1 THEN CAST(user_id % 20 AS VARCHAR) END AS client_id,
      'Acct ' || event_id AS account_name, ['ACTIVE', 'SUSPENDED', 'CLOSED', 'ACTIVE'][event_id % 4 + 1] AS status, CAST(ts AS DATE) AS open_date, epoch_us(ts) // 1000 AS ms FROM events WHERE event_id % 7 <> 0""",
    "vend": f"""SELECT p_partkey AS k, c AS channel, 'V' || {_p('p_partkey', 7)} AS Vendor_Ref, p_name, CASE WHEN p_partkey % 5 = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE {_p('p_partkey', 9)} END AS cusip,
      CASE WHEN p_partkey % 5 = 2 THEN NULL WHEN p_partkey % 4 = 1 THEN 'US' || {_p('p_partkey', 9)} || p_partkey % 10 END AS isin,
      CASE WHEN p_partkey % 8 <> 7 OR c = 1 THEN strftime(DATE '2026-01-01' + CAST((p_partkey * 7 + c * 13) % 28 AS INT), '%Y-%m-%dT00:00:00+00:00') END AS stamp,
      CASE WHEN p_partkey % 6 <> c THEN 'Issuer' || c || ' ' || p_partkey END AS issuer, [ 'ACTIVE', 'ACTIVE', 'MATURED', 'DELISTED', NULL][(p_partkey + c) % 5 + 1] AS status FROM part, (SELECT unnest([0, 1]) AS c) WHERE p_partkey % 20 <> 19""",
    "ids": """SELECT id_type, id_value, arg_min(securityId, (prio, securityId)) AS securityId FROM (
      SELECT 'cusip' AS id_type, cusip AS id_value, securityId, 0 AS prio FROM sec UNION ALL SELECT 'cusip', substr(isin, 3, 9), securityId, 1 FROM sec WHERE substr(isin, 1, 2) IN ('US', 'CA') UNION ALL SELECT 'isin', isin, securityId, 0 FROM sec UNION ALL SELECT 'sedol', sedol, securityId, 0 FROM lst)
      WHERE id_value IS NOT NULL GROUP BY id_type, id_value""",
    "vres": """SELECT v.*, coalesce(i.securityId, c.securityId, p.securityId) AS securityId FROM vend v LEFT JOIN ids i ON i.id_type = 'isin' AND i.id_value = v.isin LEFT JOIN ids c ON c.id_type = 'cusip' AND c.id_value = v.cusip
      LEFT JOIN ids p ON p.id_type = 'cusip' AND p.id_value = lpad(v.cusip, CAST(greatest(9, len(v.cusip)) AS INTEGER), '0')""",
    "wire": f"""SELECT rn, rn % 4 AS f, row_number() OVER (PARTITION BY rn % 4 ORDER BY rn) AS seq, NOT (rn % 4 = 2 AND rn % 1000 = 2) AS ok, CASE WHEN rn % 50 <> 2 THEN o_custkey ELSE 900001 END AS acct, l_partkey AS k, rn % 40 = 1 AS blank,
      CAST(l_quantity AS DECIMAL(18,4)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS val, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) % 1000 AS DECIMAL(18,2)) AS price FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "wres": f"""SELECT w.*, a.accountId, coalesce(c.securityId, i.securityId) AS securityId FROM wire w LEFT JOIN acct a ON a.accountId = 'ACC-' || {_p('acct', 6)}
      LEFT JOIN ids c ON c.id_type = 'cusip' AND NOT blank AND k % 4 <> 0 AND c.id_value = {_p('k', 9)} LEFT JOIN ids i ON i.id_type = 'isin' AND NOT blank AND i.id_value = 'US' || {_p('k', 9)} || k % 10""",
}
_NEED = {"lst": ["sec"], "pos": ["sold"], "stl": ["lines"], "bal": ["mov", "opn"], "ids": ["sec", "lst"], "vres": ["vend", "ids"], "wire": ["lines"], "wres": ["wire", "acct", "ids"]}


def sql(select: str, *names: str) -> str:
    """``select`` over the named stand-ins."""
    order: list[str] = []

    def add(n):
        for m in _NEED.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + select
