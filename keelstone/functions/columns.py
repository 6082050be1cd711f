"""Decoding, cleaning and identifier expressions.  Each is one Catalyst expression; none is a Python UDF."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "nothing" in vendor fields.
NULL_SENTINELS = ("", "N/A", "#N/A", "NA", "NULL", "NONE", "-")
#: Sign overpunch, positive 0-9 and negative 0-9.
OVERPUNCH_POSITIVE, OVERPUNCH_NEGATIVE, DIGITS = "{ABCDEFGHI", "}JKLMNOPQR", "0123456789"
#: Date sentinels.
DATE_SENTINELS = ("00000000", "99999999")


def zoned(c: Column, scale: int, precision: int = 18, signed: bool = False) -> Column:
    """Zoned decimal with an implied point, exactly; null where it is not one."""
    if not signed:
        return F.when(F.rlike(c, F.lit("^[0-9]+$")), _pointed(c, scale, precision))
    last, head = F.right(c, F.lit(1)), F.substr(c, F.lit(1), F.length(c) - 1)
    digit = F.translate(last, OVERPUNCH_POSITIVE + OVERPUNCH_NEGATIVE, DIGITS + DIGITS)
    minus = F.instr(F.lit(OVERPUNCH_NEGATIVE), last) > 0
    whole = F.concat(head, digit)
    value = F.when(F.rlike(whole, F.lit("^[0-9]+$")), _pointed(whole, scale, precision))
    return F.when(minus, -value).otherwise(value).cast(f"decimal({precision},{scale})")


def _pointed(c: Column, scale: int, precision: int) -> Column:
    """Digits as a decimal of ``scale`` places: a number of at most ``precision`` digits, and exactly a power of ten of it."""
    whole = c.try_cast(f"decimal({precision},0)")
    return (whole * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})") if scale else whole


def to_zoned(c: Column, width: int, scale: int) -> Column:
    """A non-negative decimal as ``width`` digits with an implied point."""
    return F.lpad((c.cast(f"decimal(30,{scale})") * 10**scale).cast("decimal(30,0)").cast("string"), width, "0")


def plain_decimal(c: Column, kind: str = "decimal(18,2)") -> Column:
    return F.trim(c).try_cast(kind)


def ccyymmdd(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit("^[0-9]{8}$")), F.try_to_timestamp(c, F.lit("yyyyMMdd")))


def julian(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit("^[0-9]{7}$")), F.try_to_timestamp(c, F.lit("yyyyDDD")))


def optional_date(c: Column) -> Column:
    return F.when(~c.isin(*DATE_SENTINELS), ccyymmdd(c))


def vendor_timestamp(c: Column) -> Column:
    """The seven vendor formats, each behind a shape test; anything else is null.  Two-digit years from 69 are 19xx."""
    t = F.upper(F.trim(c))
    as_ = lambda shape, fmt, x=t: F.when(F.rlike(t, F.lit(shape)), F.try_to_timestamp(x, F.lit(fmt)))
    short = F.when(F.rlike(t, F.lit("^[0-9]{1,2}-[A-Z]{3}-[0-9]{2}$")), F.try_to_timestamp(F.initcap(F.replace(t, F.lit("-"), F.lit(" "))), F.lit("d MMM yy")))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200).cast("timestamp")).otherwise(short)
    return F.coalesce(
        as_(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "y-M-d H:m:s"),
        as_(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "y-M-d H:m:s", F.replace(t, F.lit("T"), F.lit(" "))),
        as_(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"),
        short,
        as_(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/y"),
        as_(r"^[0-9]{8}$", "yyyyMMdd"),
        F.when(F.rlike(t, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$")), t.try_cast("timestamp")),
    )


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def crm_date(c: Column) -> Column:
    return F.trim(c).try_cast("timestamp")


def epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("bigint"))


def clean(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.upper(t).isin(*NULL_SENTINELS), t)


def account_id(c: Column) -> Column:
    """Custody number -> ACC-%06d; null unless all digits."""
    t = F.regexp_replace(F.trim(c), "^0+(?=[0-9])", "")
    return F.when(F.rlike(t, F.lit("^[0-9]+$")), F.concat(F.lit("ACC-"), F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)))


def cusip_in_isin(c: Column) -> Column:
    return F.when((F.length(c) == 12) & F.substring(c, 1, 2).isin("US", "CA"), F.substring(c, 3, 9))


def zfill9(c: Column) -> Column:
    return F.when(F.length(c) < 9, F.lpad(c, 9, "0")).otherwise(c)


def position_id(acct: Column, sec: Column, cycle: Column) -> Column:
    return F.concat_ws("-", F.lit("POS"), F.replace(acct, F.lit("-"), F.lit("")), F.replace(sec, F.lit("-"), F.lit("")), cycle)


def balance_id(acct: Column, ccy: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lit("BAL"), F.replace(acct, F.lit("-"), F.lit("")), ccy, day)


def code(c: Column, values: dict[str, str], default: str) -> Column:
    """A source code list (lower case) -> enum, with an explicit default."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.get(F.array(table[F.lower(F.coalesce(c, F.lit("")))]), 0), F.lit(default))


def content_hash(columns: list[str], exclude: tuple[str, ...] = ()) -> Column:
    """16 hex digits over the columns' names and values (as text, nulls kept), whatever their order: SHA-256 of their JSON object."""
    cols = [F.col(c).cast("string").alias(c) for c in sorted(columns) if c not in exclude]
    return F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, 16)


SEDOL_WEIGHTS = (1, 3, 1, 7, 3, 9)


def sedol_ok(c: Column) -> Column:
    """7 characters without vowels whose check digit is the weighted sum mod 10."""
    value = lambda ch: F.when(F.rlike(ch, F.lit("[0-9]")), ch.try_cast("int")).otherwise(F.ascii(ch) - 55)
    total = sum((value(F.substring(c, i + 1, 1)) * w for i, w in enumerate(SEDOL_WEIGHTS)), F.lit(0))
    return F.coalesce(F.rlike(c, F.lit("^[0-9BCDFGHJ-NP-TV-Z]{6}[0-9]$")) & (F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == F.right(c, F.lit(1)).try_cast("int")), F.lit(False))


def lei_ok(c: Column) -> Column:
    """20 characters with ISO 7064 mod 97-10 equal to 1, folded a character at a time."""
    fold = F.aggregate(
        F.split(c, ""), F.lit(0).cast("bigint"),
        lambda a, ch: F.when(F.rlike(ch, F.lit("[0-9]")), (a * 10 + ch.try_cast("bigint")) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97),
    )
    return F.coalesce(F.rlike(c, F.lit("^[A-Z0-9]{18}[0-9]{2}$")) & (fold == 1), F.lit(False))


def isin_ok(c: Column) -> Column:
    return c.isNull() | F.rlike(c, F.lit("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"))
