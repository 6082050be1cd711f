import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelstone.functions import columns as C


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("text,scale,signed,want", [
    ("0000000008505000", 4, False, Decimal("850.5000")), ("0000012345}", 2, True, Decimal("-1234.50")), ("0000012345{", 2, True, Decimal("1234.50")), ("000001234J", 2, True, Decimal("-123.41")),
    ("00000123A", 2, False, None), ("", 2, False, None), ("123456789012345", 12, False, Decimal("123.456789012345")), (None, 2, False, None),
])
def test_zoned(spark, text, scale, signed, want):
    assert one(spark, text, lambda c: C.zoned(c, scale, 18, signed)) == want


@pytest.mark.parametrize("text,want", [("2024060", dt.datetime(2024, 2, 29)), ("2026366", None), ("2026001", dt.datetime(2026, 1, 1)), ("26001", None)])
def test_julian(spark, text, want):
    assert one(spark, text, C.julian) == want


@pytest.mark.parametrize("text,want", [("20260130", dt.datetime(2026, 1, 30)), ("20260230", None), ("x", None)])
def test_ccyymmdd(spark, text, want):
    assert one(spark, text, C.ccyymmdd) == want


@pytest.mark.parametrize("text,want", [
    ("2026-01-30 04:12:44", "2026-01-30T04:12:44+00:00"), ("2026-01-30T04:12:44", "2026-01-30T04:12:44+00:00"), ("2026-01-30", "2026-01-30T00:00:00+00:00"), ("14-FEB-25", "2025-02-14T00:00:00+00:00"), ("02/14/2025", "2025-02-14T00:00:00+00:00"),
    ("20260130", "2026-01-30T00:00:00+00:00"), ("N/A", None), ("99991231999", None), ("2026-1-3", "2026-01-03T00:00:00+00:00"), ("2/4/2025", "2025-02-04T00:00:00+00:00"), ("01-JAN-70", "1970-01-01T00:00:00+00:00"), ("2026-02-30", None),
])
def test_vendor_timestamp(spark, text, want):
    assert one(spark, text, lambda c: C.iso(C.vendor_timestamp(c))) == want


@pytest.mark.parametrize("text,want", [("N/A", None), (" #n/a ", None), ("-", None), ("", None), (" x ", "x"), (None, None)])
def test_clean(spark, text, want):
    assert one(spark, text, C.clean) == want


@pytest.mark.parametrize("text,want", [("000000000042", "ACC-000042"), ("42", "ACC-000042"), ("1234567", "ACC-1234567"), ("A1", None), ("", None), ("0", "ACC-000000")])
def test_account_id(spark, text, want):
    assert one(spark, text, C.account_id) == want


@pytest.mark.parametrize("text,want", [("0263494", True), ("0263495", False), ("B0YBKJ7", True), ("A0YBKJ7", False), ("12", False), (None, False)])
def test_sedol(spark, text, want):
    assert one(spark, text, C.sedol_ok) is want


@pytest.mark.parametrize("text,want", [("5493001KJTIIGC8Y1R12", True), ("5493001KJTIIGC8Y1R13", False), ("short", False)])
def test_lei(spark, text, want):
    assert one(spark, text, C.lei_ok) is want


@pytest.mark.parametrize("text,want", [("US0378331005", True), (None, True), ("us0378331005", False), ("US03783310", False)])
def test_isin(spark, text, want):
    assert one(spark, text, C.isin_ok) is want
