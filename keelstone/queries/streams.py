"""Streams over JSON files with Kafka-like columns, made from ``events`` by Spark."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from pyspark.sql import functions as F

from ..plans import ops
from ..registry import EntitySpec
from ..streaming import heartbeats, landing
from ..tables import load, shared_folder

#: Two raw tables of the stand-in: one keeps the latest arrival, the other the newest source timestamp.
EVENT = EntitySpec("raw_events", "EVENT_KEY string, USER string, KIND string, AMOUNT string", ("EVENT_KEY",), (("EVENT_KEY", True),), "raw", required=("USER",), topic="raw.events")
STATE = EntitySpec("raw_users", "USER string, UPDATED string, KIND string", ("USER",), (("USER", True),), "raw", ordering="UPDATED", required=("USER",), topic="raw.users")
ROUTES = {e.topic: e for e in (EVENT, STATE)}
FILES = 6


def record_files(spark, d) -> str:
    """Every event as a record: even ids to raw.users, odd to raw.events; one in 101 without its key, one in 103 a tombstone; undeclared fields throughout."""
    i = F.col("event_id")
    user = F.when(i % 101 != 0, F.col("user_id").cast("string"))
    users = F.to_json(F.struct(user.alias("USER"), F.date_format(F.col("ts").cast("timestamp") - F.make_interval(days=(i % 5).cast("int")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UPDATED"), F.col("event_type").alias("KIND"), F.lit("x").alias("NEW_COLUMN")))
    events = F.to_json(F.struct(F.when(i % 101 != 0, F.concat(F.lit("E"), (i % 4000).cast("string"))).alias("EVENT_KEY"), F.col("user_id").cast("string").alias("USER"), F.col("event_type").alias("KIND"), F.col("value").cast("decimal(18,2)").cast("string").alias("AMOUNT"), F.lit("x").alias("NEW_COLUMN")))
    out = f"{shared_folder(spark)}/records"
    x = load(spark, d, "events").select(F.when(i % 2 == 0, STATE.topic).otherwise(EVENT.topic).alias("topic"), F.lit(0).alias("partition"), i.alias("offset"), F.lit(None).cast("string").alias("key"), F.when(i % 103 == 0, None).when(i % 2 == 0, users).otherwise(events).alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    x.repartitionByRange(FILES, "offset").write.json(out)
    return out


def landed(spark, d, times: int = 1, files: int = 2) -> landing.Landing:
    """The stream drained into tables; more than one time means replays under new checkpoints."""
    path, root = record_files(spark, d), f"{shared_folder(spark)}/tables"
    target = landing.Landing(spark, root, ROUTES)
    for k in range(times):
        offset = 1000 * k
        landing.drain(landing.records(spark, path, files), lambda b, n, o=offset: target(b, n + o), f"{shared_folder(spark)}/checkpoint")
    return target


def t1(spark, d):
    """Of one key the last record by offset stays, over three micro-batches in whatever order their files come."""
    return landed(spark, d).current("raw_events").select("EVENT_KEY", "USER", "KIND", "AMOUNT")


def t3(spark, d):
    """A continuous query, stopped when it has caught up."""
    target = landing.Landing(spark, f"{shared_folder(spark)}/tables", ROUTES)
    q = landing.run(landing.records(spark, record_files(spark, d), 2), target, f"{shared_folder(spark)}/checkpoint", "1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return target.current("raw_users").select("USER", "UPDATED", "KIND")


def l4(spark, d):
    x = landed(spark, d).appended("dead_letters", landing.LETTERS)
    return x.select("topic", "stage", "error", "offset")


def booked_amount(record: dict) -> tuple:
    """The amount as a number of two places, halves going up; an error where it is none."""
    text = record["AMOUNT"]
    if text is None:
        return (None,)
    if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", text.strip()):
        raise ValueError(f"[CAST_INVALID_INPUT] The value '{text}' is no amount.")
    try:
        amount = Decimal(text.strip()).quantize(Decimal("0.01"), ROUND_HALF_UP)
    except InvalidOperation:
        amount = None
    if amount is None or abs(amount) >= 10**16:
        raise ValueError(f"[NUMERIC_VALUE_OUT_OF_RANGE] The amount '{text}' has more than 18 digits.")
    return (amount,)


def t1_poison(spark, d):
    """A handler that turns amounts into numbers meets records whose amount is none: each of them becomes a dead letter, all others of its batch land, and the stream goes on."""
    root = shared_folder(spark)
    target = landing.Landing(spark, f"{root}/tables", ROUTES)
    spoiled = F.when(F.col("offset") % 10_000 == 1, F.regexp_replace("value", '"AMOUNT":"[^"]*"', '"AMOUNT":"n/a"')).otherwise(F.col("value"))

    def valid(rows):
        return landing.validated(rows.filter(F.col("topic") == EVENT.topic), EVENT).filter(F.size("errors") == 0).select("topic", "partition", "offset", "value", "ts", "AMOUNT")

    guarded = landing.Guarded(valid, booked_amount, "amount decimal(18,2)", lambda rows, n: target.put("booked", rows.select("offset", "amount"), n), lambda rows, n: target.put("dead_letters/stage=handler", rows, n))
    landing.drain(landing.records(spark, record_files(spark, d), 2).withColumn("value", spoiled), guarded, f"{root}/checkpoint")
    booked = target.appended("booked", "offset bigint, amount decimal(18,2)").select("offset", "amount", F.lit(None).cast("string").alias("error"))
    letters = target.appended("dead_letters", landing.LETTERS).select("offset", F.lit(None).cast("decimal(18,2)").alias("amount"), F.substring("error", 1, 36).alias("error"))
    return booked.unionByName(letters)


def t6_state(spark, d):
    """The guard in the state store: each batch hands on only the keys that it changed; half-way the query is stopped and goes on from its checkpoint."""
    root, path = shared_folder(spark), record_files(spark, d)
    target = landing.Landing(spark, f"{root}/tables", ROUTES)
    files = spark.read.format("binaryFile").load(path).select(F.col("path")).orderBy("path")
    first = [r.path for r in files.limit(FILES // 2).collect()]  # FILES names at most
    spark.read.text(first).write.text(f"{root}/records")
    landing.run_guarded(landing.records(spark, f"{root}/records", 1), target, STATE, f"{root}/checkpoint")
    rest = [r.path for r in files.collect() if r.path not in first]
    spark.read.text(rest).write.mode("append").text(f"{root}/records")
    landing.run_guarded(landing.records(spark, f"{root}/records", 1), target, STATE, f"{root}/checkpoint")
    return target.current("raw_users").select("USER", "UPDATED", "KIND")


def l6_observed(spark, d):
    """Heartbeats of three micro-batches, each of them one write that observes its records."""
    root, beats = shared_folder(spark), heartbeats.Heartbeats(ROUTES)
    spark.streams.addListener(beats)
    try:
        beats.wait(heartbeats.archive(landing.records(spark, record_files(spark, d), 2), ROUTES, f"{root}/archive", f"{root}/checkpoint"))
    finally:
        spark.streams.removeListener(beats)
    return ops.progress(beats.take(spark)).withColumn("lastLandedAt", F.date_trunc("second", "lastLandedAt").cast("timestamp_ntz"))


def l7(spark, d):
    t = landed(spark, d)
    count = lambda n: t.current(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
    beats = t.appended("sink_progress", landing.BEATS).groupBy(F.col("collection").alias("table")).agg(F.sum("n").alias("landed"))
    return count("raw_events").unionByName(count("raw_users")).join(beats, "table")


def t4(spark, d):
    """A fresh checkpoint replays everything; the table stays as it is."""
    return landed(spark, d, times=2).current("raw_users").select("USER", "UPDATED", "KIND")


QUERIES = {
    "t1_batch_loop": t1,
    "t1_poison_record": t1_poison,
    "t2_drain_backlog": lambda s, d: t1(s, d).groupBy("KIND").agg(F.count("*").alias("n")),
    "t3_continuous_run": t3,
    "t4_replay": t4,
    "t6_stateful_guard": t6_state,
    "t6_late_data": lambda s, d: landed(s, d).current("raw_users").select("USER", "UPDATED"),
    "t7_tombstones": lambda s, d: landing.split(landing.validated(s.read.schema(landing.RECORD).json(record_files(s, d)), STATE), STATE)[0].agg(F.count("*").alias("n")),
    "l1_contract": lambda s, d: landing.validated(s.read.schema(landing.RECORD).json(record_files(s, d)).filter(F.col("topic") == EVENT.topic), EVENT).select("offset", "EVENT_KEY", "USER", F.array_join("errors", ",").alias("errors")),
    "l4_dead_letters": l4,
    "l6_observed_heartbeats": l6_observed,
    "l7_routing": l7,
}

_EV = "SELECT event_id, 'E' || event_id % 4000 AS EVENT_KEY, CAST(user_id AS VARCHAR) AS \"USER\", event_type AS KIND, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS AMOUNT FROM events WHERE event_id % 2 = 1 AND event_id % 103 <> 0 AND event_id % 101 <> 0"
_T1 = f"SELECT EVENT_KEY, arg_max(\"USER\", event_id) AS \"USER\", arg_max(KIND, event_id) AS KIND, arg_max(AMOUNT, event_id) AS AMOUNT FROM ({_EV}) GROUP BY EVENT_KEY"
_US = "SELECT event_id, CAST(user_id AS VARCHAR) AS \"USER\", strftime(ts - to_days(CAST(event_id % 5 AS INT)), '%Y-%m-%d %H:%M:%S.%f') AS UPDATED, event_type AS KIND FROM events WHERE event_id % 2 = 0 AND event_id % 103 <> 0 AND event_id % 101 <> 0"
_T4 = f"SELECT \"USER\", max(UPDATED) AS UPDATED, arg_max(KIND, (UPDATED, -event_id)) AS KIND FROM ({_US}) GROUP BY \"USER\""
SQL = {
    "t1_batch_loop": _T1,
    "t1_poison_record": f"SELECT event_id AS \"offset\", CASE WHEN event_id % 10000 <> 1 THEN CAST(AMOUNT AS DECIMAL(18,2)) END AS amount, CASE WHEN event_id % 10000 = 1 THEN 'handler failed: [CAST_INVALID_INPUT]' END AS error FROM ({_EV})",
    "t2_drain_backlog": f"SELECT KIND, count(*) AS n FROM ({_T1}) GROUP BY KIND",
    "t3_continuous_run": _T4,
    "t4_replay": _T4,
    "t6_stateful_guard": _T4,
    "t6_late_data": f"SELECT \"USER\", UPDATED FROM ({_T4})",
    "t7_tombstones": "SELECT count(*) AS n FROM events WHERE event_id % 103 <> 0 AND (event_id % 2 = 1 OR event_id % 101 <> 0)",
    "l1_contract": "SELECT event_id AS \"offset\", CASE WHEN event_id % 101 <> 0 THEN 'E' || event_id % 4000 END AS EVENT_KEY, CAST(user_id AS VARCHAR) AS \"USER\", CASE WHEN event_id % 101 = 0 THEN 'EVENT_KEY' ELSE '' END AS errors FROM events WHERE event_id % 2 = 1 AND event_id % 103 <> 0",
    "l4_dead_letters": "SELECT CASE WHEN event_id % 2 = 0 THEN 'raw.users' ELSE 'raw.events' END AS topic, 'landing' AS stage, CASE WHEN event_id % 2 = 0 THEN 'missing: USER' ELSE 'missing: EVENT_KEY' END AS error, event_id AS \"offset\" FROM events WHERE event_id % 101 = 0 AND event_id % 103 <> 0",
    "l6_observed_heartbeats": f"SELECT topic, collection, count(*) AS recordsLanded, date_trunc('second', max(ts)) AS lastLandedAt FROM (SELECT 'raw.events' AS topic, 'raw_events' AS collection, event_id FROM ({_EV}) UNION ALL SELECT 'raw.users', 'raw_users', event_id FROM ({_US})) x JOIN events USING (event_id) GROUP BY topic, collection",
    "l7_routing": f"SELECT 'raw_events' AS \"table\", (SELECT count(*) FROM ({_T1})) AS rows, (SELECT count(*) FROM ({_EV})) AS landed UNION ALL SELECT 'raw_users', (SELECT count(*) FROM ({_T4})), (SELECT count(*) FROM ({_US}))",
}
