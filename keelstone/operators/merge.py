"""Keyed merges and latest-per-key, each one aggregate: one shuffle on the key, combined before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shares


def latest(df: DataFrame, key: list[str], order: Column, keep: list[str] | None = None) -> DataFrame:
    """The row of each key with the largest ``order`` (never null)."""
    cols = keep or [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_v")).select(*key, "_v.*")


def last_k(df: DataFrame, key: list[str], order: Column, k: int) -> DataFrame:
    """The ``k`` rows of each key with the largest ``order``, with their rank ``k`` from the newest."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    return df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)  # Spark prunes by rank before the shuffle (window group limit)


def lsn_order(lsn: str = "LSN", event: str = "EVENT_ID") -> Column:
    """Snapshot events first, then by numeric position, then by event id."""
    return F.struct(F.when(F.startswith(F.col(lsn), F.lit("snapshot-")), 0).otherwise(1), F.coalesce(F.col(lsn).try_cast("bigint"), F.lit(-1)), F.col(event))


def newest_rank(ordering: str | None, arrival: str = "_arrival") -> list[Column]:
    """What ranks the rows of a key, whatever the order in which they come: with ``ordering`` stamped before unstamped, the newest stamp, the first arrival; else the last arrival."""
    at = [F.col(f"{arrival}.offset"), F.col(f"{arrival}.partition")]
    if ordering is None:
        return at
    return [F.col(ordering).isNotNull().alias("stamped"), F.coalesce(F.col(ordering).cast("string"), F.lit("")).alias("stamp"), *[(-c).alias(f"at{i}") for i, c in enumerate(at)]]


def newest(rows: DataFrame, key: list[str], ordering: str | None = None, arrival: str = "_arrival") -> DataFrame:
    """The row of each key that ranks highest, with its ``arrival``: one aggregate.

    Applied to a table and a batch together it upserts; as the rank lies in the rows,
    batches may be repeated and come in any order.  ``createdAt`` is kept from the row
    already in the table (``_src`` 0) or else from the first arrival.
    """
    values = [c for c in rows.columns if c not in key]
    agg = [F.max_by(F.struct(*values), F.struct(*newest_rank(ordering, arrival))).alias("_v")]
    if "createdAt" in values:
        first = [c for c in ("_src", arrival) if c in values]
        agg.append(F.min_by("createdAt", F.struct(*first)).alias("_created"))
    x = rows.groupBy(*key).agg(*agg)
    return x.select(*[F.col("_created").alias(c) if c == "createdAt" else F.col(c) if c in key else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def merge(current: DataFrame, incoming: DataFrame, key: list[str], ordering: str | None = None, arrival: str = "_arrival", rows: int | None = None) -> DataFrame:
    """Current rows and an incoming batch as the new current rows.

    Without ``ordering`` the last arrival replaces the row.  With it a row is replaced only
    by a strictly newer one: current wins ties, stamped beats unstamped, and of equal
    incoming rows the first arrival wins.  ``arrival`` is unique within the batch, a number
    or a struct of numbers (offset and partition of a stream); it and ``createdAt`` (kept
    from the current row where there is one) never leave the merge.

    ``rows``: how many there are at most, where keys rarely repeat: they are then dealt to as
    many tasks as they need and sorted there, not also where they were read.
    """
    cols = current.columns
    parts = incoming.select(f"{arrival}.*").columns if incoming.schema[arrival].dataType.typeName() == "struct" else []
    names = [f"_at{i}" for i in range(max(1, len(parts)))]
    at = [F.col(f"{arrival}.{p}").cast("bigint") for p in parts] or [F.col(arrival).cast("bigint")]
    a = current.withColumn("_src", F.lit(0)).withColumns({n: F.lit(0).cast("bigint") for n in names})
    both = a.unionByName(incoming.select(*cols, F.lit(1).alias("_src"), *[c.alias(n) for n, c in zip(names, at)]))
    if ordering is None:
        rank = F.struct("_src", *names)
    else:
        rank = F.struct(F.col(ordering).isNotNull(), F.coalesce(F.col(ordering).cast("string"), F.lit("")), F.col("_src") == 0, *[(-F.col(n)).alias(n) for n in names])
    values = [c for c in cols if c not in key]
    agg = [F.max_by(F.struct(*values), rank).alias("_v")]
    if "createdAt" in values:
        agg.append(F.min_by("createdAt", F.struct("_src", *names)).alias("_created"))
    if rows is not None:
        both = both.repartition(shares(both, rows), *key)
    x = both.groupBy(*key).agg(*agg)
    out = [F.col("_created").alias(c) if c == "createdAt" else F.col(c) if c in key else F.col(f"_v.{c}") for c in cols]
    return x.select(*out)
