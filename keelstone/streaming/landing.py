"""Landing of a multiplexed stream, as micro-batches that can be retried.

A stream's records have the columns of Spark's Kafka source (topic, partition, offset,
key, value); ``records`` reads them from files, and a deployment with the Kafka
package swaps the format there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import newest, newest_rank
from ..operators.select import number_rows
from ..registry import EntitySpec

RECORD = "topic string, partition int, offset bigint, key string, value string, ts timestamp"
BATCH_FILES = 8
ERROR_CHARS = 1000
#: Buckets of a raw table, and the records of a batch that may fail before the handler itself is at fault.
BUCKETS = 64
MOST_FAILING = 100
LETTERS = "topic string, stage string, error string, partition int, offset bigint, at timestamp, payload string"
BEATS = "topic string, collection string, n bigint, at timestamp"


def records(spark: SparkSession, path: str, files_per_batch: int = BATCH_FILES, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def broken(spec: EntitySpec, r: Column | None = None) -> Column:
    """The fields of a record that break the contract: required ones without a value, or the payload itself.  ``r``: the parsed payload."""
    r = F.from_json("value", spec.schema) if r is None else r
    need = [c for c in spec.columns if c in (*spec.required, *spec.key)]
    missing = F.array_compact(F.array(*[F.when(F.coalesce(r[c].cast("string"), F.lit("")) == "", F.lit(c)) for c in need]))
    return F.when(r.isNull(), F.array(F.lit("payload"))).otherwise(missing)


def validated(batch: DataFrame, spec: EntitySpec) -> DataFrame:
    """The declared columns of JSON payloads (others are dropped) and ``errors``: the fields that break the contract."""
    x = batch.filter("value IS NOT NULL").withColumn("r", F.from_json("value", spec.schema))
    return x.withColumn("errors", broken(spec, F.col("r"))).select("topic", "partition", "offset", "value", "ts", *[F.col(f"r.{c}").alias(c) for c in spec.columns], "errors")


def split(judged: DataFrame, spec: EntitySpec) -> tuple[DataFrame, DataFrame]:
    """(valid rows with ``_arrival``: offset and partition, dead letters)."""
    ok = judged.filter(F.size("errors") == 0).select(*spec.columns, F.struct("offset", "partition").alias("_arrival"))
    bad = judged.filter(F.size("errors") > 0).select("topic", F.lit("landing").alias("stage"), F.substring(F.concat(F.lit("missing: "), F.array_join("errors", ",")), 1, ERROR_CHARS).alias("error"), "partition", "offset", F.col("ts").alias("at"), F.col("value").alias("payload"))
    return ok, bad


class Landing:
    """``foreachBatch`` target: routes a batch by topic into raw tables, rejects to dead letters, heartbeats beside them.

    A raw table is Parquet partitioned by ``bucket``, a hash of the key.  A batch reads and
    rewrites the buckets that its keys fall into, by dynamic partition overwrite, and no
    others; readers take the table as it is, and nothing has to be compacted.  A row keeps
    its ``_arrival`` (offset and partition), and which of two rows of a key stays follows from
    the rows alone (``merge.newest``), so a retried, replayed or late batch ends in the same table.

    The number of buckets is fixed for a table's life.  A bucket is replaced when the
    write commits; a driver that is lost just then leaves it to a replay of the source.
    """

    def __init__(self, spark: SparkSession, root: str, routes: dict[str, EntitySpec], buckets: int = BUCKETS):
        self.spark, self.root, self.routes, self.buckets = spark, root, routes, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            parts, judged, letters = [], {}, None
            for topic, spec in self.routes.items():
                x = validated(batch.filter(F.col("topic") == topic), spec)
                ok, bad = split(x, spec)
                judged[spec.name] = (spec, ok)
                letters = bad if letters is None else letters.unionByName(bad)
                good = F.size("errors") == 0
                parts.append(x.select("topic", good.alias("good"), F.when(good, F.col("ts")).alias("ts"), F.when(good, self._bucket(spec)).alias("bucket")))
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            # one job for all topics; a row per topic, with at most ``buckets`` numbers
            found = every.groupBy("topic").agg(F.sum(F.col("good").cast("bigint")).alias("n"), F.count("*").alias("seen"), F.max("ts").alias("at"), F.collect_set("bucket").alias("buckets")).collect()
            for r in found:
                if r.n:
                    spec, ok = judged[self.routes[r.topic].name]
                    self.upsert(spec, ok, r.buckets)
            if any(r.seen > r.n for r in found):
                self.put("dead_letters/stage=landing", letters.drop("stage"), batch_id)
            if beats := [(r.topic, self.routes[r.topic].name, r.n, r.at) for r in found if r.n]:
                self.put("sink_progress", self.spark.createDataFrame(beats, BEATS).coalesce(1), batch_id)
        finally:
            batch.unpersist()

    def _bucket(self, spec: EntitySpec) -> Column:
        return F.pmod(F.xxhash64(*spec.key), F.lit(self.buckets)).cast("int")

    def upsert(self, spec: EntitySpec, rows: DataFrame, touched: list[int] | None = None) -> None:
        """Merge rows with ``_arrival`` into a table; only the buckets of their keys are read and written."""
        rows = rows.withColumn("bucket", self._bucket(spec))
        if touched is None:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        rows = newest(rows, [*spec.key, "bucket"], spec.ordering)  # combined before the buckets are dealt out
        held = self._table(spec).filter(F.col("bucket").isin(touched))
        both = held.withColumn("_src", F.lit(0)).unionByName(rows.withColumn("_src", F.lit(1))).repartition("bucket")
        done = newest(both, [*spec.key, "bucket"], spec.ordering).drop("_src")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{spec.name}")

    def _table(self, spec: EntitySpec) -> DataFrame:
        schema = T.StructType([*spec.schema.fields, *T.StructType.fromDDL("_arrival struct<offset: bigint, partition: int>, bucket int").fields])
        return self.appended(spec.name, schema)

    def current(self, name: str) -> DataFrame:
        """The table as it stands."""
        spec = next(s for s in self.routes.values() if s.name == name)
        return self._table(spec).select(*spec.columns)

    def put(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Append rows as one partition ``batch=<id>``, which a retried batch overwrites."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def appended(self, name: str, schema: str | T.StructType) -> DataFrame:
        """What has been written under ``name``; nothing before the first write."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


def reason(e: Exception) -> str:
    """What a failed job says, without stack traces: the first line, of an error in Python code the last."""
    lines = [x for x in str(e).strip().splitlines() if x.strip() and not x.lstrip().startswith(("at ", "File "))]
    return (lines or [type(e).__name__])[-1 if isinstance(e, PythonException) else 0].strip()[:ERROR_CHARS]


class Isolated:
    """``foreachBatch`` target that lets a record that makes ``target`` fail cost that record, not the batch.

    A failed batch is fixed, numbered by topic, partition and offset, and halved: a half
    that fails is halved again, so one bad record among n takes about log2(n) further
    attempts.  ``target(rows, batch_id)`` must overwrite what it wrote for the same batch
    (as ``Landing`` does); at the end it gets all the rows that it can handle in one call,
    and the others go to ``letters(rows, batch_id)`` with their place, payload and error.
    More than ``most`` bad records in a batch are taken for a fault of the target itself:
    its error is raised, and the stream stops before its checkpoint moves.
    """

    def __init__(self, target, letters, most: int = MOST_FAILING):
        self.target, self.letters, self.most, self.attempts = target, letters, most, 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            return self.target(batch, batch_id)
        except Exception as e:
            first = e
        rows = number_rows(batch, [("topic", True), ("partition", True), ("offset", True)])
        bad = self._failing(rows, rows.count(), batch_id, first)
        names = batch.columns
        self.target(rows.filter(~F.col("rn").isin([n for n, _ in bad])).select(*names), batch_id)
        if bad:
            said = batch.sparkSession.createDataFrame(bad, "rn bigint, error string")
            letters = rows.join(F.broadcast(said), "rn").select(  # at most ``most`` rows
                "topic", F.concat(F.lit("handler failed: "), "error").alias("error"), "partition", "offset", F.coalesce("ts", F.current_timestamp()).alias("at"), F.substring("value", 1, ERROR_CHARS).alias("payload")
            )
            self.letters(letters, batch_id)

    def _failing(self, rows: DataFrame, n: int, batch_id: int, first: Exception) -> list[tuple[int, str]]:
        """(place, error) of the records that fail on their own."""
        bad: list[tuple[int, str]] = []
        todo = [(1, n, True)]  # (from, to, known to fail)
        while todo:
            a, b, fails = todo.pop()
            error = None
            if not fails or a == b:
                try:
                    self.attempts += 1
                    self.target(rows.filter(F.col("rn").between(a, b)).drop("rn"), batch_id)
                    continue
                except Exception as e:
                    error = e
            if a == b:
                bad.append((a, reason(error)))
                if len(bad) > self.most:
                    raise first
                continue
            middle = (a + b) // 2
            todo += [(middle + 1, b, False), (a, middle, False)]
        return bad


HANDLED_ERROR = "_failure"
#: The share of a batch's records that may fail before the handler of records itself is at fault.
MOST_SHARE = 0.5


def handled(rows: DataFrame, handler, schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema`` that ``handler(row)`` returns as a tuple, and ``_failure``: what it raised, else null.

    The handler runs record by record inside the tasks, so a record that fails costs itself
    alone, however many do, and no attempt is repeated.
    """
    import pandas as pd

    made = T.StructType.fromDDL(schema)
    result = T.StructType([*made.fields, T.StructField(HANDLED_ERROR, T.StringType())])
    none = (None,) * len(made)

    def run(*columns):
        out = []
        for row in zip(*columns):
            try:
                out.append((*handler(dict(zip(names, row))), None))
            except Exception as e:
                out.append((*none, (str(e).strip() or type(e).__name__)[:ERROR_CHARS]))
        return pd.DataFrame(out, columns=result.names, dtype=object)

    names, taken = list(rows.columns), {n.lower() for n in result.names}  # a result takes the place of a column of its name
    each = F.pandas_udf(run, result)
    return rows.withColumn("_h", each(*[F.col(n) for n in names])).select(*[n for n in names if n.lower() not in taken], "_h.*")


class Guarded:
    """``foreachBatch`` target for a handler of single records: those on which it fails become dead letters, the others land, by one pass over the batch.

    ``prepare(batch)`` gives the handler's rows, which keep topic, partition, offset, ts and
    payload (``value``); ``put(rows, batch_id)`` and ``letters(rows, batch_id)`` overwrite what
    they wrote for the same batch.  Where more than ``most`` of the records fail, the handler is
    at fault: the error of one is raised, and the stream stops before its checkpoint moves.
    ``Isolated`` is for targets that only take whole batches.
    """

    def __init__(self, prepare, handler, schema: str, put, letters, most: float = MOST_SHARE):
        self.prepare, self.handler, self.schema, self.put, self.letters, self.most = prepare, handler, schema, put, letters, most

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = handled(self.prepare(batch), self.handler, self.schema).persist()
        try:
            failure = F.col(HANDLED_ERROR)
            got = rows.agg(F.count("*").alias("n"), F.count(failure).alias("bad"), F.min(failure).alias("said")).first()
            if got.bad > self.most * got.n:
                raise RuntimeError(f"{got.bad} of {got.n} records failed: {got.said}")
            self.put(rows.filter(failure.isNull()).drop(HANDLED_ERROR), batch_id)
            if got.bad:
                self.letters(rows.filter(failure.isNotNull()).select("topic", F.substring(F.concat(F.lit("handler failed: "), failure), 1, ERROR_CHARS).alias("error"), "partition", "offset", F.coalesce("ts", F.current_timestamp()).alias("at"), F.substring("value", 1, ERROR_CHARS).alias("payload")), batch_id)
        finally:
            rows.unpersist()


def changes(rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """A stream's rows (the entity's columns, offset and partition) -> each key's newest row, emitted by the batch in which it changes (update mode).

    The state store holds a row and its rank per key, so a late or repeated row is
    dropped there and never reaches the table.  The winning row carries the time of the
    batch that brought it, which the checkpoint fixes for retries; a key whose winner is
    older did not change.  With stamped entities the newest stamp wins and then the first
    arrival, otherwise the last arrival.
    """
    x = rows.select(*spec.columns, F.struct("offset", "partition").alias("_arrival"), F.current_timestamp().alias("_seen"))
    values = [c for c in x.columns if c not in spec.key]
    rank = F.struct(*newest_rank(spec.ordering), (-F.unix_micros("_seen")).alias("first"))
    out = x.groupBy(*spec.key).agg(F.max_by(F.struct(*values), rank).alias("_v"))
    return out.filter(F.col("_v._seen") == F.current_timestamp()).select(*[F.col(c) if c in spec.key else F.col(f"_v.{c}").alias(c) for c in spec.columns], F.col("_v._arrival").alias("_arrival"))


def run_guarded(stream: DataFrame, target: Landing, spec: EntitySpec, checkpoint: str, topic: str | None = None):
    """Drain a topic through the state store into its table; returns the finished query."""
    topic = topic or spec.topic
    ok = validated(stream.filter(F.col("topic") == topic), spec).filter(F.size("errors") == 0)

    def land(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            target.upsert(spec, rows)
        finally:
            rows.unpersist()

    q = changes(ok, spec).writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain(stream: DataFrame, target, checkpoint: str) -> None:
    """Process the backlog and stop.  A query's position is its checkpoint: a new folder replays everything."""
    stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run(stream: DataFrame, target, checkpoint: str, every: str = "10 seconds"):
    """Run until stopped."""
    return stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
