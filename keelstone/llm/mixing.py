"""Operator 7 [native]: mix sources to target weights by Sainte-Laguë apportionment.

Sources in code-point order (null last) weigh 5, 2, 1, repeating.  Their targets
share the total size, capped at ``EPOCHS`` times the source's size with the excess
reshared by weight: the fixed point is min(cap, weight x level), found in closed
form from the sources ordered by cap / weight.

A source's words are laid out as blocks of ``BLOCK`` words.  The blocks of the mix
go to the sources by highest quotients target / (2k - 1), so the quotas are
integers.  Each source is cut
into shards of about ``SHARD`` words by a seeded hash (a hot source has many
shards, so no window holds a source), and the source's quota goes to its shards by
the same rule, with the quotients ranked by range partitions.  Within a shard documents lie in seeded order and the quota picks
whole rounds plus one seeded arc of blocks; a document's ``taken`` words are what
of it lies in the picked blocks.  No block is picked more than ``EPOCHS`` times.  The last block of a
shard may be short, so a source's words differ from its target by less than
``EPOCHS`` + 1 blocks per shard.

Defined results: null text has size 0 and takes 0; a null source is a source;
repeated rows are separate rows with interchangeable shares; null ``doc_id`` counts
as an empty id in the seeded order; ties in that order go by doc_id and size; texts of any
length count whole, and one longer than a shard makes its shard longer; columns besides
doc_id, source and size are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, prepare, scratch, small, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 16
SHARD = 1 << 20
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(salt: str, *cols: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{SEED}{salt}"), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def _number(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target (double), blocks (its integer quota).  One row per source, not per document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", EPOCHS * F.col("source_size"))
    every = Window.partitionBy()
    ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = ratio.rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("total", F.sum("source_size").over(every)).withColumn("rest_words", F.col("total") - F.sum("cap").over(upto)).withColumn("rest_weight", F.sum("weight").over(every) - F.sum("weight").over(upto))
    # capped, if even with this source and all of smaller ratio capped the level reaches its ratio: total - capped before >= ratio * weight left
    before_words = F.col("rest_words") + F.col("cap")
    before_weight = F.col("rest_weight") + F.col("weight")
    w = w.withColumn("capped", before_words.cast("decimal(38,0)") * F.col("weight") > F.col("cap").cast("decimal(38,0)") * before_weight)
    free = ~F.col("capped")
    w = w.withColumn("left_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)))
    w = w.withColumn("left_weight", F.coalesce(F.sum(F.when(free, F.col("weight"))).over(every), F.lit(1)))
    w = w.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("left_words")).cast("double") / F.col("left_weight")))
    w = w.withColumn("n_all", F.round(F.col("total") / BLOCK).cast("long"))
    return apportion(w, "target", "n_all", "source").select("source", "source_size", "target", F.col("quota").alias("blocks"))


def _over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def _rounded(x: DataFrame, share: str, seats: str) -> DataFrame:
    """``_q0``: the share at the divisor ``_total`` / seats, rounded."""
    return x.withColumn("_q0", F.coalesce(F.round(_over(F.col(share), _over(F.col("_total"), F.col(seats)))).cast("long"), F.lit(0)))


def _steps(x: DataFrame, share: str) -> DataFrame:
    """The seats that a row may win or lose (``_j``), the first to move with the smallest ``_first``; null where there is no such seat."""
    reach = F.coalesce(F.ceil(_over(1.5 * F.col("_rows") * F.col(share), F.col("_total"))), F.lit(0)).cast("int") + 2
    x = x.withColumn("_j", F.explode(F.sequence(F.lit(1), F.when(F.col("_gap") == 0, 1).otherwise(reach))))
    seat = F.when(F.col("_gap") > 0, F.col("_q0") + F.col("_j")).otherwise(F.col("_q0") - F.col("_j") + 1)
    quotient = F.when(seat > 0, F.col(share) / (2 * seat - 1))
    return x.withColumn("_first", F.when(F.col("_gap") > 0, -quotient).otherwise(quotient))


def apportion(df: DataFrame, share: str, seats: str, name: str) -> DataFrame:
    """``quota``: integer seats for each row by Sainte-Laguë; for a row per source, as one window holds the rows.

    Rounding share / divisor is the Sainte-Laguë allocation for that divisor.  With
    the divisor sum(share) / seats the rounded seats miss ``seats`` by at most half a
    seat per row; the rest goes to the highest next quotients (or leaves by the
    lowest last ones).  A row can move at most 1.5 x rows x its share + 2 seats, so
    the quotients to compare are only a few per row.
    """
    every = Window.partitionBy()
    x = _rounded(df.withColumn("_total", F.sum(share).over(every)).withColumn("_rows", F.count("*").over(every)), share, seats)
    x = x.withColumn("_gap", F.col(seats) - F.sum("_q0").over(every))
    rank = F.row_number().over(Window.orderBy(F.col("_first").asc_nulls_last(), F.col(name).asc_nulls_last(), "_j"))
    x = _steps(x, share).withColumn("_rank", rank)
    moved = F.sum(F.when(F.col("_first").isNotNull() & (F.col("_rank") <= F.abs("_gap")), F.sign("_gap")).otherwise(0).cast("long"))
    return x.groupBy(*df.columns, "_q0").agg(moved.alias("_moved")).withColumn("quota", F.col("_q0") + F.col("_moved")).drop("_q0", "_moved")


def apportion_within(df: DataFrame, share: str, seats: str, key: str, name: str) -> DataFrame:
    """As ``apportion``, within each value of ``key``; (key, name) is unique, and a key may have any number of rows.

    Sums are combined before their shuffle.  The seats to move are ranked by range partitions
    of (key, quotient), the counts before a partition and the places in it, so no task
    sees a key; only a row per partition and key is added up in one.
    """
    of_key = F.col(key).eqNullSafe(F.col("_key"))
    per = df.groupBy(F.col(key).alias("_key")).agg(F.sum(share).alias("_total"), F.count("*").alias("_rows"))
    x = keep(_rounded(df.join(small(keep(per)), of_key).drop("_key"), share, seats))
    gaps = x.groupBy(F.col(key).alias("_key")).agg((F.max(seats) - F.sum("_q0")).alias("_gap")).filter("_gap <> 0")
    steps = _steps(x.join(small(keep(gaps)), of_key), share).filter("_first IS NOT NULL").select("_key", F.col(name).alias("_name"), "_gap", "_first", "_j")
    order = ["_first", "_name", "_j"]
    steps = keep(steps.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.groupBy("_key", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = small(keep(starts.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_start")))
    ranked = steps.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)))
    ranked = ranked.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).filter("_start + _rank <= abs(_gap)")
    moved = ranked.groupBy("_key", "_name").agg(F.sum(F.sign("_gap").cast("long")).alias("_moved"))
    x = x.join(moved, of_key & F.col(name).eqNullSafe(F.col("_name")), "left")
    return x.withColumn("quota", F.col("_q0") + F.coalesce("_moved", F.lit(0))).select(*df.columns, "quota")


def mix(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size of ``sizes`` with source_size, target, taken."""
    spark = sizes.sparkSession
    prepare(spark)
    with scratch() as stay:
        sizes = stay(keep(sizes.select("doc_id", "source", "size")))
        goal = small(stay(keep(targets(sizes).withColumnRenamed("source", "_source"))))
        x = sizes.join(goal, sizes.source.eqNullSafe(F.col("_source")), "left").drop("_source")
        x = x.withColumn("_draw", _draw("", F.col("doc_id"))).withColumn("_shard", _number(F.col("_draw")) % F.expr(f"source_size div {SHARD} + 1"))
        quotas = x.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.max("source_size").alias("_all"), F.max("blocks").alias("_blocks"))
        quotas = quotas.withColumn("_n", F.expr(f"(_words + {BLOCK - 1}) div {BLOCK}")).withColumn("_share", _over(F.col("_words"), F.col("_all")) * F.col("_blocks"))
        quotas = apportion_within(keep(quotas), "_share", "_blocks", "source", "_shard")
        quotas = quotas.withColumn("quota", F.least("quota", EPOCHS * F.col("_n")))
        quotas = small(stay(keep(quotas.select(F.col("source").alias("_s"), F.col("_shard").alias("_k"), "_words", "_n", "quota"))))
    x = x.join(quotas, x.source.eqNullSafe(F.col("_s")) & (x._shard == F.col("_k")), "left").drop("_s", "_k")
    # a shard holds about SHARD words, whatever the source's size
    order = Window.partitionBy("source", "_shard").orderBy("_draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_end", F.sum("size").over(order)).withColumn("_start", F.col("_end") - F.col("size"))
    x = x.withColumn("_rounds", F.expr("CASE WHEN _n > 0 THEN quota div _n ELSE 0 END")).withColumn("_more", F.expr("CASE WHEN _n > 0 THEN quota % _n ELSE 0 END"))
    x = x.withColumn("_from", F.when(F.col("_n") > 0, _number(_draw("arc", F.col("source"), F.col("_shard"))) % F.col("_n")).otherwise(0))
    # the arc of blocks [from, from + more) on a ring of n blocks: one or two ranges of words
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(F.col("_start"), a))
    to = F.col("_from") + F.col("_more")
    arc = over(F.col("_from") * BLOCK, to * BLOCK) + over(F.lit(0).cast("long"), (to - F.col("_n")) * BLOCK)
    return x.withColumn("taken", (F.col("_rounds") * F.col("size") + arc).cast("long")).drop("_draw", "_shard", "_words", "_n", "quota", "_end", "_start", "_rounds", "_more", "_from", "blocks")


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _sql_apportion(src: str, cols: str, share: str, seats: str, keys: str, name: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""(SELECT {cols}, q0 + CAST(sum(CASE WHEN seat > 0 AND rk <= abs(gap) THEN sign(gap) ELSE 0 END) AS BIGINT) AS quota FROM (
  SELECT *, row_number() OVER ({part} ORDER BY CASE WHEN gap > 0 THEN -{share} / (2 * seat - 1) WHEN seat > 0 THEN {share} / (2 * seat - 1) END ASC NULLS LAST, {name} ASC NULLS LAST, j) AS rk FROM (
  SELECT *, CASE WHEN gap > 0 THEN q0 + j ELSE q0 - j + 1 END AS seat FROM (
  SELECT *, unnest(range(1, CASE WHEN gap = 0 THEN 2 ELSE reach + 1 END)) AS j FROM (
  SELECT *, {seats} - sum(q0) OVER ({part}) AS gap, coalesce(CAST(ceil(1.5 * count(*) OVER ({part}) * {share} / sum({share}) OVER ({part})) AS BIGINT), 0) + 2 AS reach FROM (
  SELECT *, coalesce(CAST(round({share} / (sum({share}) OVER ({part}) / {seats})) AS BIGINT), 0) AS q0 FROM {src}))))) GROUP BY {cols}, q0)"""


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, {EPOCHS} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
fill AS (
  SELECT 0 AS step, source, weight, cap, total, FALSE AS capped FROM w
  UNION ALL
  SELECT step + 1, source, weight, cap, total, capped OR weight * (total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) > cap * coalesce(sum(weight) FILTER (WHERE NOT capped) OVER (), 1) FROM fill WHERE step < 60),
lastfill AS (SELECT *, total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS lw, coalesce(sum(weight) FILTER (WHERE NOT capped) OVER (), 1) AS lt FROM fill WHERE step = 60),
t AS (SELECT w.source, w.source_size, CASE WHEN capped THEN CAST(f.cap AS DOUBLE) ELSE CAST(CAST(f.weight * lw AS BIGINT) AS DOUBLE) / CAST(lt AS BIGINT) END AS target, CAST(round(w.total / {BLOCK}) AS BIGINT) AS n_all
  FROM w JOIN lastfill f ON w.source IS NOT DISTINCT FROM f.source),
g AS (SELECT source, source_size, target, quota AS blocks FROM {_sql_apportion("t", "source, source_size, target, n_all", "target", "n_all", "", "source")}),
x AS (SELECT d.doc_id, d.size, g.*, md5('{SEED}' || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS draw FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % (source_size // {SHARD} + 1) AS shard FROM x),
z AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, max(source_size) AS all_words, max(blocks) AS blocks FROM y GROUP BY source, shard),
k AS (SELECT *, (words + {BLOCK - 1}) // {BLOCK} AS n, words / all_words * blocks AS share FROM z),
quotas AS (SELECT source, shard, n, least(quota, {EPOCHS} * n) AS quota, CASE WHEN n > 0 THEN CAST('0x' || substr(md5('{SEED}arc:' || coalesce(source, '') || ':' || CAST(shard AS VARCHAR)), 1, 8) AS BIGINT) % n ELSE 0 END AS start
  FROM {_sql_apportion("k", "source, shard, words, all_words, blocks, n, share", "share", "blocks", "source", "shard")}),
p AS (SELECT y.doc_id, y.size, y.source_size, y.target, n, quota, start, sum(y.size) OVER (PARTITION BY y.source, y.shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS e
  FROM y JOIN quotas q ON y.source IS NOT DISTINCT FROM q.source AND y.shard = q.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN n > 0 THEN quota // n * size
  + greatest(0, least(e, (start + quota % n) * {BLOCK}) - greatest(e - size, start * {BLOCK}))
  + greatest(0, least(e, (start + quota % n - n) * {BLOCK}) - greatest(e - size, 0)) ELSE 0 END AS BIGINT) AS taken FROM p
"""
