"""Fixed-width batches: scan, control totals, manifests, quarantine and batch identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import zoned
from ..registry import CUSTODY_FIELDS
from ..tables import lookup, small, stored

WIDTH = 200
#: The record layouts (field, width).
HEADER = (("REC_TYPE", 2), ("BUS_DATE", 8), ("SRC_SYS_ID", 8), ("CREATED_TS", 14))
DETAIL = tuple(zip(CUSTODY_FIELDS, (2, 8, 3, 4, 12, 2, 9, 12, 40, 3, 1, 4, 16, 16, 15, 15, 11, 7, 8, 1, 3, 8)))
TRAILER = (("REC_TYPE", 2), ("BUS_DATE", 8), ("REC_COUNT", 9), ("TOT_SHR_QTY", 18), ("TOT_MKT_VALUE", 18))
QUARANTINE = 100


def fields(line: Column, layout: tuple[tuple[str, int], ...]) -> list[Column]:
    out, at = [], 1
    for name, width in layout:
        out.append(F.rtrim(F.substring(line, at, width)).alias(name))
        at += width
    return out


def raw_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, file, size, block, at, raw: every line as it was delivered, blank ones and carriage returns included.

    ``path`` names a delivery, ``file`` is the batch name in it; a name that is no batch name
    is an error, not a batch of its own.  A delivery is a file, or a folder of that name with
    ``part-`` files in order, as Spark writes one; ``size`` is that of the part.  ``block`` (part and
    start in it) and ``at`` order the lines of a delivery, however many splits it has, and ``at``
    counts on within a split.
    """
    x = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([A-Z]+_[0-9]{8}(?:_[0-9]{4})?)\.(?:dat|csv)", 1)
    known = F.when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("BAD_FILE_NAME: "), F.col("_metadata.file_path"))))
    at = F.col("_metadata.file_path")
    last, folder = F.substring_index(at, "/", -1), F.substring_index(F.substring_index(at, "/", -2), "/", 1)
    part = F.when(F.startswith(last, F.lit("part-")) & (F.endswith(folder, F.lit(".dat")) | F.endswith(folder, F.lit(".csv"))), last).otherwise("")
    whole = F.when(part == "", at).otherwise(F.substr(at, F.lit(1), F.length(at) - F.length(part) - 1))
    block = F.struct(part.alias("part"), F.col("_metadata.file_block_start").alias("start"))
    return x.select(whole.alias("path"), known.alias("file"), F.col("_metadata.file_size").alias("size"), block.alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))


def _without_return() -> Column:
    return F.when(F.endswith("raw", F.lit("\r")), F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw"))


def lines_of(raw: DataFrame) -> DataFrame:
    """path, file, block, at, line: the lines that are not blank, without carriage returns."""
    x = raw.withColumn("line", _without_return())
    return x.select("path", "file", "block", "at", "line").filter(F.trim("line") != "")


def read_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return lines_of(raw_lines(spark, path, pattern))


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One pass over a landing folder: its lines with ``kind``, stored by column in the shared folder.

    Control totals then read kinds, decoded amounts and the few header and trailer lines,
    content hashes the raw lines, details the lines (``scanned_lines``); the wire files are not
    read again.
    """
    return stored(_judged(raw_lines(spark, path, pattern)))


def _judged(raw: DataFrame) -> DataFrame:
    """``raw`` with ``kind`` (blank, too), the line itself where it is a header or trailer (``mark``), and the decoded amounts of a detail."""
    x = classify(raw.withColumn("line", _without_return()))
    x = x.withColumn("kind", F.when(F.trim("line") == "", "blank").otherwise(F.col("kind")))
    line = F.col("line")
    amount = lambda name, scale: F.when(F.col("kind") == "detail", zoned(next(f for f, (n, _) in zip(fields(line, DETAIL), DETAIL) if n == name), scale))
    return x.select("path", "file", "size", "block", "at", "raw", "kind", F.when(F.col("kind").isin("header", "trailer"), line).alias("mark"), amount("POS_SHR_QTY", 4).alias("qty"), amount("POS_MKT_VALUE", 2).alias("value"))


def summaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All that ``controls`` and ``batch_ids`` need of a landing folder, by one pass over it that keeps no line.

    A row per split and kind of line in it, and per header or trailer line: how many lines, their
    amounts, how many have none, and their digests.  Lines are summed where they are read.
    """
    missing = F.sum(F.when((F.col("kind") == "detail") & (F.col("qty").isNull() | F.col("value").isNull()), 1).otherwise(0))
    x = _judged(raw_lines(spark, path, pattern)).groupBy(*SPLIT, "kind", "mark")
    return stored(x.agg(F.sum("qty").alias("qty"), F.sum("value").alias("value"), missing.alias("undecodable"), *_digests()))


def scanned_lines(scanned: DataFrame) -> DataFrame:
    """What ``classify(read_lines(...))`` gives, from a stored scan, with its decoded amounts."""
    return scanned.filter("kind <> 'blank'").withColumn("line", _without_return()).drop("raw", "size")


def classify(lines: DataFrame) -> DataFrame:
    """``kind``: header, detail, trailer or reject."""
    t = F.substring("line", 1, 2)
    kind = F.when(F.length("line") != WIDTH, "reject").when(t == "01", "header").when(t == "03", "detail").when(t == "99", "trailer").otherwise("reject")
    return lines.withColumn("kind", kind)


#: Bits of ``at`` within a run of lines, and within a word of its bitmap.
_RUN, _WORD = 12, 6


def _runs(details: DataFrame) -> DataFrame:
    """path, block, run, before, lo, words, bits, upto: a row per 4,096 lines of a split.

    ``before`` counts the details of the file ahead of the run and ``lo`` is its first one.  Where the
    run's details do not follow each other, ``words`` names the stretches of 64 lines that hold any,
    ``bits`` the lines of a stretch that are details, and ``upto`` the run's details ahead of it.
    """
    from pyspark.sql import Window

    run, word, split = F.shiftright("at", _RUN).alias("run"), F.shiftright("at", _WORD).alias("word"), ("path", "block")
    bit = F.expr(f"shiftleft(1L, int(at & {(1 << _WORD) - 1}))")
    x = details.groupBy(*split, run, word).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy(*split, "run").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("upto", F.coalesce(upto, F.lit(0)))  # at most 64 rows a run
    x = x.groupBy(*split, "run").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("word", "bits", "upto"))).alias("s"))
    gaps = F.when(F.col("n") < F.col("hi") - F.col("lo") + 1, F.col("s"))
    ahead = F.sum("n").over(Window.partitionBy("path").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1))
    return x.select(*split, "run", F.coalesce(ahead, F.lit(0)).alias("before"), "lo", gaps.word.alias("words"), gaps.bits.alias("bits"), gaps.upto.alias("upto"))


def with_sequence(lines: DataFrame, name: str = "seq") -> DataFrame:
    """1-based place of each detail in its file.  No line is sorted or shuffled for it: ``at`` counts on within a split, so a place follows from the counts of 4,096 lines each and the gaps in them (``_runs``).

    Lines that no scan has stored are stored first, as ``at`` must not change between the counts and the lines.
    """
    d = lines.filter("kind = 'detail'")
    d = d if "mark" in lines.columns else stored(d)
    runs = lookup(stored(_runs(d)))
    word = F.array_position("words", F.shiftright("at", _WORD)).cast("int") - 1
    here = F.expr(f"shiftrightunsigned(-1L, {(1 << _WORD) - 1} - int(at & {(1 << _WORD) - 1}))")  # this line of its stretch and those ahead
    within = F.when(F.col("words").isNull(), F.col("at") - F.col("lo") + 1).otherwise(F.get("upto", word) + F.bit_count(F.get("bits", word).bitwiseAND(here)))
    x = d.withColumn("run", F.shiftright("at", _RUN)).join(runs, ["path", "block", "run"])
    return x.withColumn(name, F.col("before") + within).drop("run", "before", "lo", "words", "bits", "upto")


def detail(name: str) -> Column:
    """A declared field of a detail line."""
    return next(f for f, (n, _) in zip(fields(F.col("line"), DETAIL), DETAIL) if n == name)


def details(lines: DataFrame) -> DataFrame:
    """path, file, REC_ID and the declared fields of every detail."""
    return detail_fields(with_sequence(lines))


def detail_fields(numbered: DataFrame, *more: str) -> DataFrame:
    """The same of numbered lines, with the columns ``more`` that they have beside."""
    x = numbered.select("path", "file", "seq", *fields(F.col("line"), DETAIL), *more)
    return x.withColumn("REC_ID", F.concat_ws("-", "POS_BUS_DATE", F.lpad(F.col("seq").cast("string"), 6, "0")))


def controls(lines: DataFrame) -> DataFrame:
    """Per file: counts, declared and computed totals, and the first failing rule (null: complete).  Numbers are summed by one hash aggregate; texts, which Spark aggregates only by sorting, come from the header and trailer lines alone.  Amounts that a scan has decoded are not decoded again; rows of ``summaries`` stand for many lines each."""
    known, summed = {"mark", "qty", "value"} <= set(lines.columns), "undecodable" in lines.columns
    lines = lines.filter("kind <> 'blank'") if summed else lines
    line = F.col("mark" if known else "line")
    at = lambda layout, name: next(f for f, (n, _) in zip(fields(line, layout), layout) if n == name)
    is_ = lambda k: F.col("kind") == k
    first = lambda kind, layout, name: F.min(F.when(is_(kind), at(layout, name)))
    qty, value = (F.col("qty"), F.col("value")) if known else (zoned(at(DETAIL, "POS_SHR_QTY"), 4), zoned(at(DETAIL, "POS_MKT_VALUE"), 2))
    n = lambda c, lines=F.col("lines") if summed else F.lit(1): F.sum(F.when(c, lines).otherwise(0)).cast("bigint")
    lines = lines.withColumns({"_q": qty, "_v": value})  # decoded once a line
    qty, value = F.col("_q"), F.col("_v")
    undecodable = n(is_("detail"), F.col("undecodable")) if summed else n(is_("detail") & (qty.isNull() | value.isNull()))
    x = lines.groupBy("path", "file").agg(
        n(is_("header")).alias("headers"), n(is_("trailer")).alias("trailers"), n(is_("detail")).alias("recordCount"), n(is_("reject")).alias("rejectedCount"),
        undecodable.alias("undecodable"),
        F.coalesce(F.sum(F.when(is_("detail"), qty)), F.lit(0)).cast("decimal(28,4)").alias("totalQty"), F.coalesce(F.sum(F.when(is_("detail"), value)), F.lit(0)).cast("decimal(28,2)").alias("totalValue"),
    )
    marks = lines.filter(F.col("kind").isin("header", "trailer")).groupBy("path").agg(
        first("header", HEADER, "BUS_DATE").alias("cycleDate"), first("trailer", TRAILER, "BUS_DATE").alias("trailerCycle"), first("trailer", TRAILER, "REC_COUNT").alias("declared"),
        first("trailer", TRAILER, "TOT_SHR_QTY").alias("declaredQty"), first("trailer", TRAILER, "TOT_MKT_VALUE").alias("declaredValue"),
    )
    x = x.join(marks, "path", "left")
    count = F.when(F.rlike("declared", F.lit("^[0-9]+$")), F.col("declared").try_cast("bigint"))
    reason = (
        F.when(F.col("headers") == 0, "NO_HEADER").when(F.col("trailers") == 0, "NO_TRAILER").when(F.col("trailerCycle") != F.col("cycleDate"), "CYCLE_MISMATCH")
        .when(count.isNull(), "BAD_COUNT").when(count != F.col("recordCount") + F.col("rejectedCount"), "COUNT_MISMATCH").when(F.col("rejectedCount") > 0, "REJECTED_LINES")
        .when((F.col("undecodable") > 0) | zoned(F.col("declaredQty"), 4, 28).isNull() | zoned(F.col("declaredValue"), 2, 28).isNull(), "UNDECODABLE_TOTALS")
        .when(zoned(F.col("declaredQty"), 4, 28) != F.col("totalQty"), "QUANTITY_MISMATCH").when(zoned(F.col("declaredValue"), 2, 28) != F.col("totalValue"), "VALUE_MISMATCH")
    )
    return x.withColumn("trailerRecordCount", count).withColumn("failReason", reason).withColumn("status", F.when(reason.isNull(), "COMPLETE").otherwise("FAILED"))


def manifests(verdicts: DataFrame, ids: DataFrame, extracted_at: Column) -> DataFrame:
    """One row per batch, complete or failed."""
    return verdicts.join(ids.drop("file"), "path").select("batchId", "cycleDate", F.col("file").alias("fileName"), "recordCount", "trailerRecordCount", F.col("totalQty").alias("controlTotalQty"), F.col("totalValue").alias("controlTotalValue"), "status", "failReason", "rejectedCount", extracted_at.alias("extractedAt"))


def accepted(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of complete batches: a failed one emits none.  A verdict is a row per file."""
    return rows.join(small(verdicts.filter("status = 'COMPLETE'").select("path")), "path", "left_semi")


def quarantined(lines: DataFrame, verdicts: DataFrame, limit: int = QUARANTINE) -> DataFrame:
    """The first reject lines of every failed batch."""
    from pyspark.sql import Window

    failed = small(verdicts.filter("status = 'FAILED'").select("path"))
    w = Window.partitionBy("path").orderBy("block", "at")
    return lines.filter("kind = 'reject'").join(failed, "path", "left_semi").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= limit)


#: Fixed values of the content hash: the modulus 2^31 - 1, its bases, and the bits of a place that one table of powers covers.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 16_777_619, 611_953)
_DIGIT, _DIGITS = 6, 6
#: ``at`` without the number of its task.
_WITHIN = (1 << 33) - 1


def _power(base: int, n: Column) -> Column:
    """base^n mod PRIME for n below 2^36, from tables of powers."""
    out = None
    for k in range(_DIGITS):
        table = F.array(*[F.lit(pow(base, d << (_DIGIT * k), PRIME)).cast("bigint") for d in range(1 << _DIGIT)])
        x = F.get(table, F.shiftright(n, _DIGIT * k).bitwiseAND((1 << _DIGIT) - 1).cast("int"))
        out = x if out is None else out * x % PRIME
    return out


#: What a split is known by; the size is that of its part.
SPLIT = ("path", "file", "size", "block")


def _digests() -> list[Column]:
    """lines, _from, d0, d1 ...: how many raw lines, the place of the first in its task, and their digests from the task's begin on."""
    at, hashed = F.col("at").bitwiseAND(_WITHIN), F.md5("raw")
    part = lambda k: F.conv(F.substring(hashed, 1 + 7 * k, 7), 16, 10).cast("bigint") + 1
    sums = [(F.sum(part(k) * _power(base, at) % PRIME) % PRIME).alias(f"d{k}") for k, base in enumerate(BASES)]
    return [F.count("*").alias("lines"), F.min(at).alias("_from"), *sums]


def split_digests(raw: DataFrame) -> DataFrame:
    """path, file, size, block, lines, d0, d1 ...: a digest of every split's lines, as if the split began the file; of raw lines or of their ``summaries``."""
    summed = [F.sum("lines").alias("lines"), F.min("_from").alias("_from"), *[(F.sum(f"d{k}") % PRIME).alias(f"d{k}") for k in range(len(BASES))]]
    x = raw.groupBy(*SPLIT).agg(*(summed if "undecodable" in raw.columns else _digests()))
    for k, base in enumerate(BASES):  # back by the places before the split in its task
        x = x.withColumn(f"d{k}", F.col(f"d{k}") * _power(pow(base, PRIME - 2, PRIME), F.col("_from")) % PRIME)
    return x.drop("_from")


def batch_ids(raw: DataFrame) -> DataFrame:
    """path, file, batchId = <name>:<first 12 hex digits of a hash of the file's bytes>.

    A line stands for three numbers of its MD5, and the hash is that of three polynomials
    in them, with the line's place as exponent, and of the file's size.  Polynomials of
    splits add up once each is moved to its place, so a file is hashed where it is read and
    only a row per split is shuffled; how it is split, and what else is in the folder,
    does not matter.  Carriage returns, blank lines and a missing end of line count.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    x = split_digests(raw).withColumn("_before", F.coalesce(F.sum("lines").over(w), F.lit(0)))  # a row per split
    whole = [(F.sum(F.col(f"d{k}") * _power(base, F.col("_before")) % PRIME) % PRIME).alias(f"d{k}") for k, base in enumerate(BASES)]
    parts = x.groupBy("path", "file", "block.part").agg(F.max("size").alias("size")).groupBy("path").agg(F.sum("size").alias("size"))
    x = x.groupBy("path", "file").agg(F.sum("lines").alias("lines"), *whole).join(parts, "path")
    digest = F.sha2(F.concat_ws(":", "size", "lines", *[f"d{k}" for k in range(len(BASES))]), 256)
    return x.select("path", "file", F.concat(F.col("file"), F.lit(":"), F.substring(digest, 1, 12)).alias("batchId"))


def unseen(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches that the ledger does not hold: same name and bytes is skipped, same name with other bytes is new."""
    return ids.join(ledger.select("batchId"), "batchId", "left_anti")
