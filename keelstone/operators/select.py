"""Lookups, filtered lists, top-k and keyset pages.

Day filters stay sargable (``>= d`` and ``< d + 1``), so they reach the Parquet scan as
pushed filters and prune date partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import EntitySpec, entity
from ..tables import shares, stored

LIST_LIMIT, OPS_LIMIT = 200, 50


def _day(text: str) -> dt.datetime:
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d")
    except ValueError as e:
        raise ValueError(f"INVALID_DATE: {text}") from e


def _lit(value) -> Column:
    """A literal.  Instants go as text, which takes the column's own type (with or without zone), so the column stays bare and the filter can be pushed."""
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value)


def day_range(column: str, day: str) -> Column:
    """The whole UTC day ``day``."""
    d = _day(day)
    return (F.col(column) >= _lit(d)) & (F.col(column) < _lit(d + dt.timedelta(days=1)))


def date_window(column: str, first: str, last: str) -> Column:
    """From ``first`` to ``last``, both days included."""
    return (F.col(column) >= _lit(_day(first))) & (F.col(column) < _lit(_day(last) + dt.timedelta(days=1)))


def clamp_limit(limit: int, maximum: int = LIST_LIMIT) -> int:
    return max(1, min(int(limit), maximum))


def where(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of the filters that are given; empty values are ignored.  ``a__b`` reaches into a struct."""
    for name, value in equal.items():
        if value is not None and value != "":
            df = df.filter(F.col(name.replace("__", ".")) == F.lit(value))
    return df


def ordered(df: DataFrame, order: Iterable[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order])


def get_one(df: DataFrame, key: Iterable[str], **equal) -> DataFrame:
    """At most one row; several matches are settled by the full key."""
    return where(df, **equal).orderBy(*key).limit(1)


def any_listing(sedol: str) -> Column:
    return F.exists("listings", lambda x: x.sedol == sedol)


def find_raw(df: DataFrame, name: str, field: str, value: str, limit: int = OPS_LIMIT) -> DataFrame:
    """Exact match on a declared field of a raw table."""
    spec = entity(name, tier="raw")
    if field not in spec.columns:
        raise ValueError(f"UNKNOWN_FIELD: {field}")
    return ordered(df.filter(F.col(field) == value), spec.total_order).limit(clamp_limit(limit, OPS_LIMIT))


def most_recent(df: DataFrame, stamp: str, key: Iterable[str], limit: int) -> DataFrame:
    return ordered(df, [(stamp, False), *[(k, True) for k in key]]).limit(clamp_limit(limit, OPS_LIMIT))


def seek(order: list[tuple[str, bool]], last: list) -> Column:
    """Rows strictly after ``last``: an OR over the prefixes of the order, behind a bound on the first column that the scan can use.

    Nulls have their place in the order, as in ``ordered``: first going up, last going down.
    """

    def beyond(name: str, up: bool, v) -> Column:
        c = F.col(name)
        if v is None:
            return c.isNotNull() if up else F.lit(False)
        return c > _lit(v) if up else (c < _lit(v)) | c.isNull()

    out = F.lit(False)
    for i, (name, up) in enumerate(order):
        tie = F.lit(True)
        for (n, _), v in zip(order[:i], last):
            tie = tie & (F.col(n).isNull() if v is None else F.col(n) == _lit(v))
        out = out | (tie & beyond(name, up, last[i]))
    (first, up), v = order[0], last[0]
    if v is None:
        return out if up else F.col(first).isNull() & out
    return (F.col(first) >= _lit(v) if up else (F.col(first) <= _lit(v)) | F.col(first).isNull()) & out


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int = LIST_LIMIT, after: list | None = None) -> tuple[list, bool]:
    """(rows, whether more follow) of the keyset page after ``after``; one more row than asked for is fetched."""
    n = clamp_limit(limit)
    rows = ordered(df if after is None else df.filter(seek(order, after)), order).limit(n + 1).collect()
    return rows[:n], len(rows) > n


def walk(df: DataFrame, order: list[tuple[str, bool]], limit: int = LIST_LIMIT) -> Iterator[tuple[DataFrame, bool]]:
    """(page, whether more follow), page by page as a client asks for them: each starts after the last row of the one before, of which alone the driver learns."""
    after = None
    while True:
        rows = df if after is None else df.filter(seek(order, after))
        n = clamp_limit(limit)
        # the last row of the page, and whether one stands beyond it
        ends = ordered(rows, order).limit(n + 1).select([c for c, _ in order]).collect()
        yield page_frame(df, order, limit, after), len(ends) > n
        if len(ends) <= n:
            return
        after = list(ends[n - 1])


def page_frame(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: list | None = None) -> DataFrame:
    """The same page as a DataFrame (a top-k in the plan)."""
    return ordered(df if after is None else df.filter(seek(order, after)), order).limit(clamp_limit(limit))


def number_rows(df: DataFrame, order: list[tuple[str, bool]], name: str = "rn", keep: list[str] | None = None) -> DataFrame:
    """``name``: 1-based place in the total order, by range partitions and their counts; no task sees all rows.  ``keep``: the columns that are stored beside it, all by default.

    A table of more than ``TASK_ROWS`` rows a partition is cut into more of them, so what a task sorts does not grow with it.
    Where every column kept is a key, those behind the last one order only rows that are kept alike: they are neither shuffled nor sorted.
    """
    names = [c for c, _ in order]
    if keep and set(keep) <= set(names):
        order = order[: 1 + max(names.index(c) for c in keep)]
    n, keys = shares(df), [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return places(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*(keep or df.columns)), name)
    return places(ordered(df, order).select(*(keep or df.columns)), name)


def places(df: DataFrame, name: str = "rn") -> DataFrame:
    """``name``: 1-based place in the order that ``df`` has."""
    table = stored(df.withColumn("_id", F.monotonically_increasing_id()))  # the order lies in the numbers from here on
    x = table.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = sorted((r._part, r["count"]) for r in x.groupBy("_part").count().collect())  # a row per partition
    upto, start = 0, []
    for part, n in counts:
        start.append((part, upto))
        upto += n
    offsets = df.sparkSession.createDataFrame(start or [(0, 0)], "_part bigint, _start bigint")
    out = x.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_id", "_part", "_at", "_start")
    out.stored_path = table.stored_path
    return out


def pages(df: DataFrame, order: list[tuple[str, bool]], limit: int) -> DataFrame:
    """Every row with its page number."""
    return number_rows(df, order).withColumn("page", F.ceil(F.col("rn") / clamp_limit(limit)).cast("bigint"))


def walked(df: DataFrame, order: list[tuple[str, bool]], limit: int = LIST_LIMIT) -> DataFrame:
    """What ``walk`` meets from cursor to cursor, as one DataFrame: every row with ``page`` and ``has_more``.

    One numbering of the rows instead of a query a page, so the work grows with the rows and
    the plan does not grow at all.
    """
    x = pages(df, order, limit)
    last = x.agg(F.max("page").alias("_last"))  # one row
    return x.crossJoin(F.broadcast(last)).withColumn("has_more", F.col("page") < F.col("_last")).drop("rn", "_last")


def list_entity(df: DataFrame, spec: EntitySpec, limit: int = LIST_LIMIT) -> DataFrame:
    return ordered(df, spec.total_order).limit(clamp_limit(limit))
