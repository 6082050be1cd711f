"""Source and curation cases: truncated input is refused, replays and arrival orders do not matter."""

import json

import pytest
from pyspark.sql import functions as F

from keelstone.plans import crm
from keelstone.queries import standins as S
from keelstone.queries.joins import account_events, client_events, now
from keelstone.registry import VENDOR_FIELDS
from keelstone.sources import feeds, fixed_width as fw

SF = "/root/testdata/sf0.001"


def write(spark, tmp_path, name, lines):
    d = tmp_path / "in"
    d.mkdir(exist_ok=True)
    (d / name).write_text("\n".join(lines) + "\n")
    return str(d)


def test_snapshot_gate(spark, tmp_path):
    head, row = ",".join(VENDOR_FIELDS), ",".join(["V1", *[""] * 15])
    good = write(spark, tmp_path, "SECMASTER_20260101.csv", [head, row, "TRAILER,1"])
    assert feeds.read_snapshot(spark, good).count() == 1
    for lines, why in (([head, row], "NO_TRAILER"), ([head, row, "TRAILER,2"], "COUNT_MISMATCH"), (["A,B", row, "TRAILER,1"], "MISSING_COLUMN")):
        with pytest.raises(ValueError, match=why):
            feeds.read_snapshot(spark, write(spark, tmp_path, "SECMASTER_20260101.csv", lines))


def test_drop_names_and_headers(spark, tmp_path):
    from keelstone.registry import CASH_FIELDS

    path = write(spark, tmp_path, "CASHMOV_20260101_1030.csv", [",".join(CASH_FIELDS), "1, USD ,5.00,,,,X"])
    r = feeds.read_drops(spark, path).first()
    assert (r.MOVEMENT_ID, r.MOV_CCY_CD, r.MOV_TYPE_CD, r.MOV_FILE_TIME) == ("CASHMOV_20260101_1030-00001", "USD", "", "1030")
    with pytest.raises(Exception, match="BAD_FILE_NAME|MISSING_COLUMN"):
        feeds.read_drops(spark, write(spark, tmp_path, "CASHMOV_20260102_1030.csv", ["A,B", "1,2"])).collect()


def line(text):
    return text.ljust(200)


def detail(acct="42", qty="0000000000010000", value="000000000000100"):
    return "03" + "20240110" + "001" + "0001" + acct.zfill(12) + "CU" + "000000001" + "US0000000011" + "X".ljust(40) + "EQU" + "R" + "DTC " + qty + "0" * 16 + "000000000000000" + value + "0000012345}" + "2024010" + "20240109" + "N" + "USD" + "MF01".ljust(8)


@pytest.mark.parametrize("body,reason", [
    ([line("01" + "20240110"), detail(), line("99" + "20240110" + "000000001" + "10000".zfill(18) + "100".zfill(18))], None),
    ([detail(), line("99" + "20240110" + "000000001")], "NO_HEADER"),
    ([line("01" + "20240110"), detail()], "NO_TRAILER"),
    ([line("01" + "20240110"), line("99" + "20240111" + "000000000")], "CYCLE_MISMATCH"),
    ([line("01" + "20240110"), line("99" + "20240110" + "00000000X")], "BAD_COUNT"),
    ([line("01" + "20240110"), detail(), line("99" + "20240110" + "000000002")], "COUNT_MISMATCH"),
    ([line("01" + "20240110"), "03 short", line("99" + "20240110" + "000000001")], "REJECTED_LINES"),
    ([line("01" + "20240110"), detail(qty="000000000001000X"), line("99" + "20240110" + "000000001" + "10000".zfill(18) + "100".zfill(18))], "UNDECODABLE_TOTALS"),
    ([line("01" + "20240110"), detail(), line("99" + "20240110" + "000000001" + "10001".zfill(18) + "100".zfill(18))], "QUANTITY_MISMATCH"),
    ([line("01" + "20240110"), detail(), line("99" + "20240110" + "000000001" + "10000".zfill(18) + "200".zfill(18))], "VALUE_MISMATCH"),
])
def test_control_reasons(spark, tmp_path, body, reason):
    assert len(detail()) == 200
    lines = fw.classify(fw.read_lines(spark, write(spark, tmp_path, "CUSTPOS_20240110.dat", body)))
    v = fw.controls(lines).first()
    assert (v.failReason, v.status) == (reason, "FAILED" if reason else "COMPLETE")
    assert fw.accepted(lines.filter("kind = 'detail'"), fw.controls(lines)).count() == (0 if reason else 1)


def plain_id(name, body):
    """The content hash by plain loops over the bytes."""
    import hashlib

    lines = body.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    h = [hashlib.md5(x).hexdigest() for x in lines]
    d = [sum((int(x[7 * k : 7 * k + 7], 16) + 1) * pow(base, i, fw.PRIME) for i, x in enumerate(h)) % fw.PRIME for k, base in enumerate(fw.BASES)]
    return f"{name}:{hashlib.sha256(':'.join(map(str, [len(body), len(lines), *d])).encode()).hexdigest()[:12]}"


def test_batch_id_follows_the_bytes(spark, tmp_path):
    """The id is the hash of the file's bytes, whatever else is in the folder and however the file is split."""
    name = "CUSTPOS_20240110"
    body = ("\n".join(detail(str(i)) for i in range(400)) + "\n").encode()

    def put(folder, content, file=name):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{file}.dat").write_bytes(content)

    def ids():
        return {r.path.split("/")[-2] + "/" + r.file: r.batchId for r in fw.batch_ids(fw.raw_lines(spark, str(tmp_path))).collect()}

    put("a", body)
    assert ids() == {f"a/{name}": plain_id(name, body)}
    variants = {"crlf": body.replace(b"\n", b"\r\n"), "blank": body + b"\n", "blanks": b"\n" + body, "open": body[:-1], "moved": body[201:] + body[:201], "bytes": body.replace(b"EQU", b"E\xff\xfe", 1), "same": body}
    for folder, content in variants.items():
        put(folder, content)
    for day in range(11, 16):
        put("a", body[: day * 400], f"CUSTPOS_202401{day}")
    want = {f"{k}/{name}": plain_id(name, v) for k, v in {"a": body, **variants}.items()} | {f"a/CUSTPOS_202401{d}": plain_id(f"CUSTPOS_202401{d}", body[: d * 400]) for d in range(11, 16)}
    assert ids() == want and want[f"a/{name}"] == want[f"same/{name}"]
    assert len({v for k, v in want.items() if k.endswith(name)}) == len(variants)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("9000", "777", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert ids() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match="BAD_FILE_NAME"):
        ids_of_other = write(spark, tmp_path, "other.txt", ["x"])
        fw.batch_ids(fw.raw_lines(spark, ids_of_other)).collect()


def test_equal_names_in_two_folders_are_two_batches(spark, tmp_path):
    head, foot = line("01" + "20240110"), lambda n, q: line("99" + "20240110" + f"{n:09}" + str(q).zfill(18) + str(q // 100).zfill(18))
    for folder, n in (("x", 1), ("y", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "CUSTPOS_20240110.dat").write_text("\r\n".join([head, *[detail(str(k)) for k in range(n)], foot(n, 10000 * n), ""]))
    raw = fw.raw_lines(spark, str(tmp_path))
    lines = fw.classify(fw.lines_of(raw))
    v = fw.controls(lines)
    assert sorted((r.recordCount, r.status) for r in v.collect()) == [(1, "COMPLETE"), (3, "COMPLETE")]
    assert sorted(r.REC_ID[-1] for r in fw.accepted(fw.details(lines), v).collect()) == ["1", "1", "2", "3"]
    m = fw.manifests(v, fw.batch_ids(raw), F.lit("now")).collect()
    assert len(m) == 2 and len({r.batchId for r in m}) == 2


def test_true_up_twice_emits_nothing(spark):
    from keelstone.plans import vendor
    from keelstone.operators.delta import Retained
    from keelstone.tables import shared_folder

    index, sent = Retained(spark, shared_folder(spark), "Vendor_Ref", "SRC_UPDATED_AT", 4), []
    put = lambda x: sent.append(sorted((r.Vendor_Ref, r.change) for r in x.collect()))
    rows = feeds.stamp(S.vendor_rows(spark, SF, 0))
    keys = sorted(r.Vendor_Ref for r in rows.select("Vendor_Ref").collect())
    at = F.lit("2026-02-01T00:00:00+00:00")
    assert vendor.apply_true_up(index, rows, at, put, dry_run=True).count() == len(keys) and not sent and index.cycle() == 0
    vendor.apply_true_up(index, rows, at, put)
    vendor.apply_true_up(index, rows, at, put)
    assert sent == [[(k, "ADDED") for k in keys], []]
    vendor.apply_true_up(index, rows.filter(F.col("Vendor_Ref") != keys[0]), at, put)
    assert sent[2] == [(keys[0], "REMOVED")]
    spark.sql(f"DROP TABLE {index._name(index.cycle())}")  # as in a new session
    assert Retained(spark, index.path, "Vendor_Ref", "SRC_UPDATED_AT", 4).read(rows.schema).count() == len(keys) - 1
    with pytest.raises(ValueError, match="incoming snapshot has duplicate keys"):
        vendor.apply_true_up(index, rows.union(rows), at, put)


def record(key, user, partition, offset, **more):
    from keelstone.queries.streams import EVENT

    return (EVENT.topic, partition, offset, None, json.dumps({"EVENT_KEY": key, "USER": user, **more}), None)


def test_landing_keeps_the_last_arrival(spark, tmp_path):
    from keelstone.queries.streams import ROUTES
    from keelstone.streaming import landing

    parts = [[record("k", "a", 1, 5), record("k", "b", 0, 5), record("m", "x", 0, 1)], [record("k", "c", 0, 4)], [record("m", "y", 1, 2)]]
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0, 0, 2]):
        t = landing.Landing(spark, str(tmp_path / "".join(map(str, order))), ROUTES, 4)
        for n in order:
            for _ in range(2):  # a retried batch changes nothing
                t(spark.createDataFrame(parts[n], landing.RECORD), n)
        assert sorted((r.EVENT_KEY, r.USER) for r in t.current("raw_events").collect()) == [("k", "a"), ("m", "y")]
        assert t.current("raw_users").count() == 0 and t.appended("dead_letters", landing.LETTERS).count() == 0
        assert t.appended("sink_progress", landing.BEATS).agg(F.sum("n")).first()[0] == 5


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    from keelstone.queries.streams import EVENT, ROUTES
    from keelstone.streaming import landing

    t = landing.Landing(spark, str(tmp_path), ROUTES, 16)
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / EVENT.name).glob("bucket=*/*.parquet")}
    t(spark.createDataFrame([record(f"k{i}", "u", 0, i) for i in range(300)], landing.RECORD), 0)
    before = files()
    assert len(before) == 16  # one file a bucket
    keys = ["k7", "k150", "new"]
    touched = {r.b for r in spark.createDataFrame([(k,) for k in keys], "EVENT_KEY string").select(t._bucket(EVENT).alias("b")).collect()}
    t(spark.createDataFrame([record(k, "v", 0, 1000 + i) for i, k in enumerate(keys)], landing.RECORD), 1)
    after = files()
    assert {p.split("/")[1] for p in set(before) ^ set(after)} == {f"bucket={b}" for b in touched}
    assert len(after) == 16 and all(before[p] == after[p] for p in set(before) & set(after))
    got = {r.EVENT_KEY: r.USER for r in t.current("raw_events").collect()}
    assert got == {**{f"k{i}": "u" for i in range(300)}, **dict.fromkeys(keys, "v")}
    plan = t._table(EVENT).filter("bucket IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


def test_a_poisonous_record_costs_one_record(spark, tmp_path):
    from keelstone.queries.streams import EVENT, ROUTES
    from keelstone.streaming import landing

    t = landing.Landing(spark, str(tmp_path), ROUTES)

    def handler(rows, n):
        ok, _ = landing.split(landing.validated(rows, EVENT), EVENT)
        t.put("typed", ok.select("EVENT_KEY", F.col("AMOUNT").cast("decimal(18,2)").alias("amount")), n)

    target = landing.Isolated(handler, lambda x, n: t.put("dead_letters/stage=handler", x, n))
    rows = lambda bad: spark.createDataFrame([record(f"k{i}", "u", i % 3, i, AMOUNT="x" if i in bad else "1.50") for i in range(500)], landing.RECORD).repartition(7)
    landed = lambda n: {r.EVENT_KEY for r in t.appended("typed", "EVENT_KEY string, amount decimal(18,2), batch int").filter(F.col("batch") == n).collect()}
    letters = lambda n: sorted((r.partition, r.offset) for r in t.appended("dead_letters", landing.LETTERS + ", batch int").filter(F.col("batch") == n).collect())
    for n, bad in enumerate([{77}, set(), {0, 250, 499}]):
        target.attempts = 0
        for _ in range(2):
            target(rows(bad), n)
        assert landed(n) == {f"k{i}" for i in range(500) if i not in bad} and letters(n) == sorted((i % 3, i) for i in bad)
        assert target.attempts <= 2 * 20 * len(bad)
    said = t.appended("dead_letters", landing.LETTERS).first()
    assert said.stage == "handler" and said.topic == EVENT.topic and "CAST_INVALID_INPUT" in said.error and '"AMOUNT": "x"' in said.payload


def test_a_broken_target_stops_the_stream(spark):
    from keelstone.streaming import landing

    def down(rows, n):
        raise OSError("no such host")

    sent = []
    with pytest.raises(OSError, match="no such host"):
        landing.Isolated(down, lambda x, n: sent.append(n), most=3)(spark.createDataFrame([record(f"k{i}", "u", 0, i) for i in range(40)], landing.RECORD), 0)
    assert not sent


def test_stateful_guard_emits_changes_only(spark, tmp_path):
    """A late or repeated row changes nothing, also after a restart from the checkpoint."""
    from keelstone.queries.streams import ROUTES, STATE
    from keelstone.streaming import landing

    put, offset, emitted = (tmp_path / "in"), [0], []
    put.mkdir()
    t = landing.Landing(spark, str(tmp_path / "tables"), ROUTES, 4)
    merged, upsert = landing.Landing(spark, str(tmp_path / "merged"), ROUTES, 4), t.upsert
    t.upsert = lambda spec, rows: (emitted.append(sorted((r.USER, r.KIND) for r in rows.collect())), upsert(spec, rows))
    steps = [
        ([("a", "2024-01-02", "x"), ("b", "2024-01-01", "y"), ("c", None, "z")], [("a", "x"), ("b", "y"), ("c", "z")]),
        ([("a", "2024-01-01", "late"), ("b", "2024-01-03", "new"), ("b", "2024-01-02", "between")], [("b", "new")]),
        ([("a", "2024-01-02", "same stamp"), ("c", None, "again unstamped")], []),
        ([("c", "2020-01-01", "stamped"), ("d", None, "d")], [("c", "stamped"), ("d", "d")]),
    ]
    for n, (rows, want) in enumerate(steps):
        lines = []
        for user, at, kind in rows:
            lines.append(json.dumps({"topic": STATE.topic, "partition": 0, "offset": offset[0], "value": json.dumps({"USER": user, "UPDATED": at, "KIND": kind})}))
            offset[0] += 1
        (put / f"{n}.json").write_text("\n".join(lines))
        landing.run_guarded(landing.records(spark, str(put)), t, STATE, str(tmp_path / "checkpoint"))
        merged(spark.read.schema(landing.RECORD).json(str(put / f"{n}.json")), n)
        assert (emitted.pop() if emitted else []) == want
    key = lambda x: sorted((r.USER, r.UPDATED or "", r.KIND) for r in x.current("raw_users").collect())
    assert key(t) == key(merged) == [("a", "2024-01-02", "x"), ("b", "2024-01-03", "new"), ("c", "2020-01-01", "stamped"), ("d", "", "d")]


def test_heartbeats_come_from_the_write(spark, tmp_path):
    """One job a batch; bad records do not count; a restart goes on, and old progress told again changes nothing."""
    from keelstone.queries.streams import EVENT, ROUTES, STATE
    from keelstone.streaming import heartbeats, landing

    put = tmp_path / "in"
    put.mkdir()
    beats = heartbeats.Heartbeats(ROUTES)
    spark.streams.addListener(beats)
    jobs = []

    def cycle(n, lines):
        (put / f"{n}.json").write_text("\n".join(json.dumps(x) for x in lines))
        q = heartbeats.archive(landing.records(spark, str(put)), ROUTES, str(tmp_path / "archive"), str(tmp_path / "checkpoint"))
        beats.wait(q)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(q.runId))))
        return {r.topic: (r.collection, r.n, r.at and r.at.day) for r in beats.take(spark).collect()}

    line = lambda topic, day, value: {"topic": topic, "partition": 0, "offset": 1, "value": value, "ts": f"2024-01-0{day}T00:00:00Z"}
    user = json.dumps({"USER": "u", "EVENT_KEY": "k"})
    try:
        first = [line(STATE.topic, 2, user), line(STATE.topic, 1, user), line(STATE.topic, 9, "{}"), line(STATE.topic, 9, None), line(EVENT.topic, 9, "no json"), line("other", 9, user)]
        assert cycle(0, first) == {STATE.topic: (STATE.name, 2, 2)}
        assert cycle(1, [line(EVENT.topic, 3, user)]) == {EVENT.topic: (EVENT.name, 1, 3)}
        query = next(iter(beats._last))
        beats.count(query, 0, {"n_0": 5, "at_0": None, "n_1": 5, "at_1": None})
        assert cycle(2, [line("other", 1, user)]) == {}
    finally:
        spark.streams.removeListener(beats)
    assert jobs == [1, 1, 1]
    kept = spark.read.parquet(str(tmp_path / "archive"))
    assert kept.count() == 8 and kept.filter("value IS NULL").count() == 1


def test_outcomes_are_counted_by_their_write(spark, tmp_path):
    from keelstone.plans import ops

    rows = [(i, "CURATED" if i % 3 else "BAD") for i in range(100)]
    judged = spark.createDataFrame(rows, "id bigint, outcome string")
    known = ("BAD", "NEVER", "CURATED")
    for x in (judged, judged.repartition(7, "id")):
        assert sorted(map(tuple, ops.write_outcomes(x, str(tmp_path / "o"), known).collect())) == [("BAD", 34), ("CURATED", 66)]
    assert spark.read.parquet(str(tmp_path / "o")).filter("outcome = 'BAD'").count() == 34
    assert ops.write_outcomes(judged.filter("id < 0"), str(tmp_path / "none"), known).count() == 0
    for bad in ("other", None):
        with pytest.raises(ValueError, match="101 rows seen"):
            ops.write_outcomes(judged.unionByName(spark.createDataFrame([(1, bad)], judged.schema)), str(tmp_path / "bad"), known)


def test_crm_is_order_free(spark):
    a, c = account_events(spark, SF), client_events(spark, SF)
    key = lambda x: sorted((r.accountId, r.status, r.client.clientName) for r in x.collect())
    want = key(crm.accounts(a, c, now()))
    assert key(crm.accounts(a.orderBy(F.desc("LSN")), c.orderBy(F.rand(3)), now())) == want
    assert key(crm.accounts(a.union(a), c.union(c), now())) == want


def test_account_without_client_gets_a_placeholder(spark):
    a = account_events(spark, SF)
    r = crm.accounts(a, client_events(spark, SF).filter("false"), now()).first()
    assert r.client.clientName == r.client.clientId and r.client.kycStatus == "PENDING_REVIEW"


def test_wire_files_hold_what_they_declare(spark):
    v = {r.file: r.failReason for r in fw.controls(fw.classify(fw.read_lines(spark, S.wire_files(spark, SF)))).collect()}
    assert v == {"CUSTPOS_20240110": None, "CUSTPOS_20240111": None, "CUSTPOS_20240112": "REJECTED_LINES", "CUSTPOS_20240113": "VALUE_MISMATCH"}


def test_wire_files_are_read_once(spark):
    """Details, totals and ids come from the stored scan; they equal what reading the text each time gives."""
    path = S.wire_files(spark, SF)
    scanned = fw.scan(spark, path)
    lines, plain = fw.scanned_lines(scanned), fw.classify(fw.read_lines(spark, path))
    for a, b in ((fw.controls(lines), fw.controls(plain)), (fw.details(lines), fw.details(plain)), (fw.batch_ids(scanned), fw.batch_ids(fw.raw_lines(spark, path)))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
        assert "FileScan text" not in a._jdf.queryExecution().executedPlan().toString()
    totals = fw.controls(lines)._jdf.queryExecution().executedPlan().toString()
    assert "raw" not in totals.split("ReadSchema")[1].split("\n")[0]  # amounts and marks alone


def test_only_touched_days_are_read(spark, tmp_path):
    from keelstone.plans import cash

    m = S.movements(spark, SF)
    cash.land(m, str(tmp_path))
    raw = cash.landed(spark, str(tmp_path), m)
    days = sorted(r[0] for r in m.select("MOV_FILE_DATE").distinct().collect())
    batch = m.filter(F.col("MOV_FILE_DATE").isin(days[3], days[7]))
    x = cash.touched(raw, batch)
    assert x.count() == cash.outcomes(batch).filter("outcome = 'CURATED'").count() > 0
    rows = x.collect()
    plan = x._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString() and {r.MOV_FILE_DATE for r in rows} == {days[3], days[7]}
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.nodeName().startswith("Scan parquet") and "MOV_FILE_DATE" in node.toString() and node.metrics().contains("numPartitions"):
                scans.append(node.metrics().apply("numPartitions").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 2 in scans and len(days) > 2


def test_many_poisonous_records_cost_one_pass(spark, tmp_path):
    """A third of the records fails: halving gave the batch up beyond 100 of them and took some 20 attempts for each."""
    from keelstone.queries.streams import EVENT, booked_amount
    from keelstone.streaming import landing

    t = landing.Landing(spark, str(tmp_path), {EVENT.topic: EVENT})
    valid = lambda rows: landing.validated(rows, EVENT).filter(F.size("errors") == 0)
    guard = lambda most: landing.Guarded(valid, booked_amount, "amount decimal(18,2)", lambda x, n: t.put("booked", x.select("offset", "amount"), n), lambda x, n: t.put("dead_letters/stage=handler", x, n), most)
    amounts = {0: "n/a", 1: "1.505", 2: "-2"}
    batch = spark.createDataFrame([record(f"k{i}", "u", 0, i, AMOUNT=amounts[i % 3]) for i in range(600)], landing.RECORD).repartition(5)
    for _ in range(2):  # a retried batch changes nothing
        guard(0.5)(batch, 0)
    got = {r.offset: str(r.amount) for r in t.appended("booked", "offset bigint, amount decimal(18,2)").collect()}
    assert got == {i: "1.51" if i % 3 == 1 else "-2.00" for i in range(600) if i % 3}
    said = t.appended("dead_letters", landing.LETTERS).collect()
    assert sorted(r.offset for r in said) == list(range(0, 600, 3)) and all(r.stage == "handler" and r.error.startswith("handler failed: [CAST_INVALID_INPUT]") and '"AMOUNT": "n/a"' in r.payload for r in said)
    with pytest.raises(RuntimeError, match="200 of 600 records failed"):
        guard(0.3)(batch, 1)


def test_amounts_are_booked_as_spark_casts_them(spark):
    from keelstone.queries.streams import booked_amount

    texts = ["1", " 2.5 ", "-.5", "7.", "1e3", "0.005", "-0.005", "2.675", "9999999999999999.99", "99999999999999999", "NaN", "Infinity", "1_0", "x", "", ".", "1,0", None]
    want = [r.a for r in spark.createDataFrame([(x,) for x in texts], "t string").select(F.col("t").try_cast("decimal(18,2)").alias("a")).collect()]

    def got(x):
        try:
            return booked_amount({"AMOUNT": x})[0]
        except ValueError:
            return None

    assert [got(x) for x in texts] == want


def test_a_delivery_in_parts_is_one_batch(spark, tmp_path):
    """A folder of part files has the id, totals and sequence of the one file with the same bytes, and no task writes a file whole."""
    body = [line("01" + "20240110"), *[detail(str(k)) for k in range(30)], line("99" + "20240110" + f"{30:09}" + "300000".zfill(18) + "3000".zfill(18))]
    one = write(spark, tmp_path, "CUSTPOS_20240110.dat", body)
    folder = tmp_path / "parts" / "CUSTPOS_20240110.dat"
    folder.mkdir(parents=True)
    for k, (a, b) in enumerate(((0, 9), (9, 10), (10, 32))):
        (folder / f"part-0000{k}-x.txt").write_text("\n".join(body[a:b]) + "\n")
    got = []
    for path in (one, str(tmp_path / "parts")):
        raw = fw.raw_lines(spark, path)
        lines = fw.classify(fw.lines_of(raw))
        got.append((fw.batch_ids(raw).select("file", "batchId").collect(), fw.controls(lines).drop("path").collect(), sorted((r.REC_ID, r.POS_ACCT_NBR) for r in fw.details(lines).collect()), [r.length for r in feeds.discover(spark, path, "*.*").collect()]))
    assert got[0] == got[1] and got[0][1][0].status == "COMPLETE" and len(got[0][2]) == 30


def test_wire_totals_are_summed_without_a_sort(spark):
    plan = fw.controls(fw.classify(fw.read_lines(spark, S.wire_files(spark, SF))))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[path" in plan.replace("key=", "keys=") and plan.count("SortAggregate") <= 2  # of header and trailer lines


def test_wire_files_are_written_by_many_tasks(spark, monkeypatch):
    import os

    monkeypatch.setattr(S, "TASK_ROWS", 500)
    path = S.wire_files(spark, SF).removeprefix("file:")
    sizes = [os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    assert len(sizes) >= 12 and max(sizes) < 201 * 1500
    v = {r.file: (r.failReason, r.recordCount + r.rejectedCount) for r in fw.controls(fw.classify(fw.read_lines(spark, path))).collect()}
    assert sum(n for _, n in v.values()) == spark.read.parquet(f"{SF}/lineitem.parquet").count() and [v[k][0] for k in sorted(v)] == [None, None, "REJECTED_LINES", "VALUE_MISMATCH"]


def test_places_of_details_need_no_sort(spark, tmp_path, monkeypatch):
    """Splits, rejected and blank lines, long stretches without details: places follow the lines, and no line is sorted or shuffled."""
    import random

    r = random.Random(5)
    good = lambda i: ("03" + f"{i:08d}").ljust(fw.WIDTH)
    lines = [good(i) if (i // 150) % 3 and r.random() < 0.9 or i > 9000 else r.choice(["", "03 short", "xx".ljust(fw.WIDTH)]) for i in range(14000)]
    d = write(spark, tmp_path, "CUSTPOS_20260101.dat", lines)
    write(spark, tmp_path, "CUSTPOS_20260102.dat", [good(7), *["bad"] * 9000, good(8)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        x = fw.with_sequence(fw.classify(fw.read_lines(spark, d)))
        got = sorted((row.file, row.seq, row.line) for row in x.select("file", "seq", "line").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("CUSTPOS_20260101", n, l) for n, l in enumerate([l for l in lines if l.startswith("03") and len(l) == fw.WIDTH], 1)] + [("CUSTPOS_20260102", 1, good(7)), ("CUSTPOS_20260102", 2, good(8))]
    assert got == want
    plan = x._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Window" not in plan and "Sort" not in plan


def test_packed_wire_files_hold_the_same_lines(spark):
    """Compressed parts take less than a third of the bytes; numbers, totals and fields are the same."""
    import os

    got, sizes = [], []
    for packed in (False, True):
        path = S.wire_files(spark, SF, packed=packed)
        sizes.append(sum(os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.startswith("part-")))
        lines = fw.scanned_lines(fw.scan(spark, path))
        got.append([sorted(map(str, x.drop("path").collect())) for x in (fw.controls(lines), fw.details(lines))])
    assert got[0] == got[1] and 0 < 3 * sizes[1] < sizes[0]


def test_lookups_shuffle_lines_not_their_fields(spark, monkeypatch):
    from keelstone.operators import resolve
    from keelstone.plans import custody

    lines = fw.with_sequence(fw.scanned_lines(fw.scan(spark, S.wire_files(spark, SF, packed=True))))
    monkeypatch.setattr(resolve, "lookup", lambda df: df.hint("shuffle_hash"))
    x, y = custody.outcomes_of_lines(lines, S.accounts(spark, SF), S.securities(spark, SF)), custody.outcomes(fw.detail_fields(lines), S.accounts(spark, SF), S.securities(spark, SF))
    assert set(x.columns) == set(y.columns) and x.count() > 0
    assert sorted(map(str, x.collect())) == sorted(map(str, y.select(x.columns).collect()))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") >= 3 and "POS_SHR_QTY" not in plan.split("Join", 1)[1]


def test_judged_rows_are_written_without_a_sort(spark, tmp_path):
    """A task keeps a file of each outcome open: it writes its rows in the order they came, whatever their outcome."""
    from keelstone.plans import ops

    judged = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 3 == 0, "BAD").otherwise("CURATED").alias("outcome"))
    ops.write_outcomes(judged, str(tmp_path / "o"), ("BAD", "CURATED"))
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size()) if runs.apply(i).physicalPlanDescription().find("InsertIntoHadoopFs") >= 0]
    assert plans and "Sort" not in plans[-1]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_reconciliation_meets_positions_in_as_many_tasks_as_they_need(spark, monkeypatch):
    """Rows and positions are dealt to tasks by their number; rows without account and security do not meet in one; accounts are told apart where they are dealt to."""
    from keelstone import tables
    from keelstone.operators import resolve
    from keelstone.plans import reconcile

    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    k = F.col("id")
    accounts = spark.range(1, 41, 1, 1).select(F.concat(F.lit("ACC-"), F.lpad(k.cast("string"), 6, "0")).alias("accountId"))
    securities = spark.range(1, 51, 1, 1).select(F.concat(F.lit("SEC-"), k).alias("securityId"), F.lpad(k.cast("string"), 9, "0").alias("cusip"), F.lit(None).cast("string").alias("isin"))
    number = F.when(k < 1000, F.lit("900001")).when(k < 1020, F.lit("000000000001")).otherwise(F.lpad((k % 40 + 1).cast("string"), 12, "0"))
    cusip = F.when((k < 1000) | (k % 100 == 7), "").otherwise(F.lpad((F.floor(k / 40) % 50 + 1).cast("string"), 9, "0"))
    raw = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("R-"), k).alias("REC_ID"), F.lit("20240113").alias("POS_BUS_DATE"), number.alias("POS_ACCT_NBR"), cusip.alias("POS_CUSIP_NBR"), F.lit("").alias("POS_ISIN_NBR"))
    positions = accounts.crossJoin(securities.select("securityId")).filter("securityId <> 'SEC-30'")
    positions = positions.unionByName(positions)  # two days
    x = reconcile.custody(raw, accounts, securities, positions)
    n = {r.reason: r["count"] for r in x.groupBy("reason").count().collect()}
    assert n == {"UNKNOWN_ACCOUNT": 1000, "UNKNOWN_SECURITY": 10, "NO_CURATED_POSITION": 40, "MATCHED": 950}
    assert x.select("REC_ID").distinct().count() == 2000
    tasks = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 60 and max(tasks) < 100  # 3,920 positions in 79 tasks
    assert reconcile.custody(raw, accounts, securities, positions, rows=1900).rdd.getNumPartitions() == 40
    sides = []
    monkeypatch.setattr(resolve, "lookup", lambda df: sides.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    resolve.resolve_accounts(raw, accounts, "POS_ACCT_NBR", ["REC_ID"])
    assert "RepartitionByExpression" in sides[0]


def test_manifests_need_one_pass_and_keep_no_line(spark, tmp_path):
    """Odd deliveries in small splits: summed once, they have the totals, reasons and ids of their lines, and a row per split, kind and mark is stored."""
    head, foot = line("01" + "20240110"), line("99" + "20240110" + f"{300:09}" + "3000000".zfill(18) + "30000".zfill(18))
    good = [head, *[detail(str(k)) for k in range(300)], foot]
    odd = {"CUSTPOS_20240110": "\n".join(good), "CUSTPOS_20240111": "\r\n".join(good) + "\r\n", "CUSTPOS_20240112": "\n\n".join([head, line("01" + "20240109"), *good[1:200], "03 short", detail(qty="000000000001000X"), foot, foot]) + "\n\n", "CUSTPOS_20240113": "\n \n\n", "CUSTPOS_20240114": ""}
    for name, body in odd.items():
        (tmp_path / f"{name}.dat").write_bytes(body.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        summed, raw = fw.summaries(spark, str(tmp_path)), fw.raw_lines(spark, str(tmp_path))
        for a, b in ((fw.controls(summed), fw.controls(fw.classify(fw.lines_of(raw)))), (fw.batch_ids(summed), fw.batch_ids(raw))):
            got = sorted(str(r.asDict()) for r in a.collect())
            assert got == sorted(str(r.asDict()) for r in b.collect()) and len(got) >= 3
            assert "FileScan text" not in a._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert 10 < summed.count() < 100 and not {"raw", "line"} & set(summed.columns)
    assert plain_id("CUSTPOS_20240110", odd["CUSTPOS_20240110"].encode()) in {r.batchId for r in fw.batch_ids(summed).collect()}


def test_manifests_leave_only_the_wire_files(spark, tmp_path):
    """Beside the files no table of a row per line is left."""
    from pathlib import Path

    from keelstone.queries import files

    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert files.s4(spark, SF).count() == 4
        lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
        left = [spark.read.parquet(str(p)).count() for p in {p.parent for p in Path(tmp_path).rglob("*.parquet")}]
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)
    assert left and sum(left) < lines / 10


def test_numbering_moves_no_key_that_cannot_matter(spark, monkeypatch):
    """Keys behind the last kept column are not even evaluated; a kept column that is no key keeps them all."""
    from keelstone import tables
    from keelstone.operators.select import number_rows

    x = spark.range(0, 600, 1, 3).select((F.col("id") * 7 % 50).alias("a"), (F.col("id") % 4).alias("b"), F.col("id").alias("c"))
    late = x.withColumn("late", F.when(F.col("c") >= 0, F.raise_error(F.lit("LATE"))).cast("bigint"))
    order = [("a", True), ("b", False), ("late", True)]
    want = sorted(((r.a, r.b) for r in x.collect()), key=lambda r: (r[0], -r[1]))
    for rows in (tables.TASK_ROWS, 40):
        monkeypatch.setattr(tables, "TASK_ROWS", rows)
        got = number_rows(late, order, keep=["b", "a"]).collect()
        assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rn)] == want
        with pytest.raises(Exception, match="LATE"):
            number_rows(late, order, keep=["a", "c"]).collect()


def test_sequence_takes_less_disk_than_the_lines(spark, tmp_path):
    """Compressed files, and of the stored lines no more than their numbering needs: together less than half of the lines' bytes."""
    from pathlib import Path

    from keelstone.queries import files

    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        n = files.s2(spark, SF).count()
        left = [p for p in Path(tmp_path).rglob("*") if p.name.startswith("part-")]
        columns = {c for p in left if p.suffix == ".parquet" for c in spark.read.parquet(str(p)).columns}
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)
    assert n > 5000 and "line" in columns and not {"qty", "value", "raw"} & columns
    assert 0 < 2 * sum(p.stat().st_size for p in left) < 201 * n


def test_stored_tables_leave_no_shuffle_files(spark):
    """Shuffle files go when the write ends; the session's setting and a later run of the same rows are as before."""
    import time
    from pathlib import Path

    from keelstone.tables import stored

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, root = spark.conf.get(name), Path(spark.conf.get("spark.local.dir"))
    files = lambda: {p for p in root.rglob("shuffle_*.data")}
    old, x = files(), spark.range(5000).repartition(3, "id")
    assert stored(x).count() == 5000 and spark.conf.get(name) == before
    for _ in range(50):
        left = {p for p in files() - old if p.stat().st_size > 5000}  # the count's own are smaller
        if not left:
            break
        time.sleep(0.1)
    assert not left and stored(x).count() == x.count() == 5000
