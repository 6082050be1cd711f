"""Identifier maps and prioritised resolution.

The map is in long form (id_type, id_value, securityId), one row per identifier, so
each candidate identifier is one equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import account_id, clean, cusip_in_isin, zfill9
from ..tables import lookup, shares, stored


def identifier_map(securities: DataFrame) -> DataFrame:
    """Explicit CUSIP beats one embedded in an ISIN; among equals the smallest securityId wins."""
    row = lambda kind, value, prio: securities.select(F.lit(kind).alias("id_type"), value.alias("id_value"), "securityId", F.lit(prio).alias("prio"))
    parts = [row("cusip", F.col("cusip"), 0), row("cusip", cusip_in_isin(F.col("isin")), 1), row("isin", F.col("isin"), 0)]
    if "listings" in securities.columns:
        parts.append(securities.select(F.lit("sedol").alias("id_type"), F.explode("listings.sedol").alias("id_value"), "securityId", F.lit(0).alias("prio")))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = x.filter("id_value IS NOT NULL AND id_value <> ''")
    x = x.repartition(shares(x), "id_type", "id_value")  # each value's rows are sorted where it ends, not where its security was read
    return x.groupBy("id_type", "id_value").agg(F.min_by("securityId", F.struct("prio", "securityId")).alias("securityId"))


#: Places over which rows without a value are spread in a lookup.
_SPREAD = 1024


def spread(key: list[str]) -> Column:
    """One of ``_SPREAD`` made-up values, each with a NUL, by a hash of ``key``: for rows that have no value and match nothing, so that they do not meet in one task."""
    return F.concat(F.lit("\0"), F.pmod(F.xxhash64(*key), F.lit(_SPREAD)).cast("string"))


def _found(df: DataFrame, column: Column, side: DataFrame, value: str, result: str, key: list[str]) -> DataFrame:
    """``df`` with ``result`` of the row of ``side`` that has ``column`` as its ``value``; null where there is none.

    Rows without a value (blank or null) match nothing and are looked up under made-up values (``spread``).
    """
    x = df.withColumn("_key", F.when(F.coalesce(column, F.lit("")) == "", spread(key)).otherwise(column))
    x = x.join(lookup(side.select(F.col(value).alias("_value"), F.col(result))), F.col("_key") == F.col("_value"), "left")
    return x.drop("_key", "_value")


def resolve_accounts(df: DataFrame, accounts: DataFrame, number: str | Column, key: list[str], out: str = "accountId") -> DataFrame:
    """``out``: the account that a custody number names, null unless it is numeric and exists; ``key`` tells rows of ``df`` apart."""
    known = accounts.select(F.col("accountId").alias("_id"), F.col("accountId").alias(out))
    known = known.repartition(shares(known), "_id").distinct()  # not where a large split of them was read
    return _found(df, account_id(F.col(number) if isinstance(number, str) else number), known, "_id", out, key)


def resolve_securities(df: DataFrame, ids: DataFrame, candidates: list[tuple[str, str]], key: list[str], out: str = "securityId") -> DataFrame:
    """``out`` by the first of ``candidates`` (id_type, column) that the map holds; ``key`` tells rows of ``df`` apart."""
    return resolve_small(df, ids, candidates, key, out)


def custody_candidates() -> list[tuple[str, str]]:
    return [("cusip", "POS_CUSIP_NBR"), ("isin", "POS_ISIN_NBR")]


def with_vendor_candidates(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Sentinels cleaned; ISIN, CUSIP, zero-padded CUSIP, SEDOL in this order."""
    x = df.withColumn("_isin", clean(F.col("ISIN_CODE"))).withColumn("_cusip", clean(F.col("Cusip"))).withColumn("_cusip9", zfill9(F.col("_cusip"))).withColumn("_sedol", clean(F.col("sedol")))
    return x, [("isin", "_isin"), ("cusip", "_cusip"), ("cusip", "_cusip9"), ("sedol", "_sedol")]


def resolve_small(df: DataFrame, ids: DataFrame, candidates: list[tuple[str, str | Column]], key: list[str], out: str = "securityId") -> DataFrame:
    """``out`` by the first of ``candidates`` that the map holds: one lookup per candidate, without a shuffle of ``df`` where the map is small and without a sort of it in any case."""
    found, ids = [], stored(ids)  # built once, read once or twice per candidate
    for i, (kind, column) in enumerate(candidates):
        side = ids.filter(F.col("id_type") == kind).select("id_value", F.col("securityId").alias(f"_s{i}"))
        df = _found(df, F.col(column) if isinstance(column, str) else column, side, "id_value", f"_s{i}", key)
        found.append(f"_s{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)
