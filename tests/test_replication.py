"""Literal cases of the log, policy, state, schema, file and stream operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from braidlake.functions import values
from braidlake.functions.stems import stem
from braidlake.operators import chunks, files, kv, log, merge, policies, schema, search, state
from braidlake.sources import store
from braidlake.streaming import live

LOG = "origin long, sequence long, payload string"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_apply_survives_redelivery_and_finds_conflicts(spark):
    rows = [(1, s, f"p{s}") for s in (1, 1, 2, 3, 5, 6)] + [(2, 4, "x"), (2, 5, "y"), (3, 2, "z")]
    applied = spark.createDataFrame([(2, 3)], "origin long, applied long")
    want = [(1, 1, "p1"), (1, 2, "p2"), (1, 3, "p3"), (2, 4, "x"), (2, 5, "y")]
    for size in (2, 3, 1 << 16):
        assert got(log.contiguous(spark.createDataFrame(rows, LOG), applied, "payload", size)) == want
    with pytest.raises(Exception, match="two payloads"):
        log.contiguous(spark.createDataFrame([*rows, (1, 2, "other")], LOG), applied, "payload").collect()
    assert log.contiguous(spark.createDataFrame([], LOG), applied).count() == 0


def test_ranges_agree_with_a_walk(spark):
    r = random.Random(4)
    rows = sorted({(o, r.randint(1, 90)) for o in range(6) for _ in range(r.choice([3, 70, 400]))})
    done = {o: r.choice([0, 3, 40]) for o in range(5)}
    df, applied = spark.createDataFrame(rows, "origin long, sequence long"), spark.createDataFrame(list(done.items()), "origin long, applied long")
    want, gaps = [], []
    for o in range(6):
        have, at = {s for p, s in rows if p == o}, done.get(o, 0)
        while at + 1 in have:
            at += 1
            want.append((o, at))
        last = 0
        for s in sorted(have):
            if s > last + 1:
                gaps.append((o, last + 1, s - 1))
            last = s
    for size in (4, 16, 1 << 16):
        assert got(log.contiguous(df, applied, size=size)) == sorted(want, key=repr)
        assert got(log.holes(df, size)) == sorted(gaps, key=repr)
        run = log.running(df.withColumn("one", F.lit(1)), {"n": F.col("one")}, size).groupBy("origin").agg(F.max("n"))
        assert got(run) == got(df.groupBy("origin").count())


def test_policy_cases(spark):
    ops = lambda rows: spark.createDataFrame(rows, "key long, generation long, actor long, delta long")
    base = spark.createDataFrame([], "key long, generation long, baseline long")
    none = spark.createDataFrame([], "key long, floor long")
    # concurrent inserts add up; +10 +7 -2 of three incarnations; a deleted +5 is fenced
    assert got(policies.rebased(ops([(1, 0, 1, 7), (1, 1, 2, 11)]), none, base)) == [(1, 1, 18)]
    assert got(policies.rebased(ops([(1, 0, 1, 10), (1, 1, 2, 7)]), none, base)) == [(1, 1, 17)]
    assert got(policies.rebased(ops([(1, 0, 1, 10), (1, 1, 2, 7), (1, 2, 3, -2)]), none, base)) == [(1, 2, 15)]
    assert got(policies.rebased(ops([(1, 0, 1, 5), (1, 1, 2, 7), (1, 2, 3, 11)]), spark.createDataFrame([(1, 0)], "key long, floor long"), base)) == [(1, 2, 18)]
    cells = spark.createDataFrame([(1, 0, 10.0), (1, 0, 20.0), (1, 1, 3.0), (1, 1, 90.0), (1, 0, 25.0)], "key long, generation long, value double")
    assert got(policies.extrema(cells, spark.createDataFrame([(1, 0)], "key long, floor long"))) == [(1, 3.0, 90.0)]
    states = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 1, "c")], "key long, basis long, baseline string")
    with pytest.raises(Exception, match="two baselines"):
        policies.joined_states(states).collect()
    assert got(policies.joined_states(states.filter("baseline <> 'b'"))) == [(1, 2, "a")]
    big = spark.createDataFrame([(2**63 - 1, 1)], "a long, b long")
    with pytest.raises(Exception, match="64 bits"):
        big.select(policies.checked_add(F.col("a"), F.col("b"))).collect()
    columns = spark.createDataFrame([("t", "id", True)], "table string, column string, key boolean")
    for column, text in (("id", "key column"), ("x", "no such column")):
        with pytest.raises(Exception, match=text):
            policies.configured(columns, spark.createDataFrame([("t", column, "max")], "table string, column string, policy string")).collect()
    # an add that a removal has not seen stays
    adds = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 2, 9)], "key long, value string, tag long, at long")
    gone = policies.set_remove(adds, spark.createDataFrame([(1, "a", 5)], "key long, value string, seen long"))
    assert got(gone) == [(1, 1)] and got(policies.observed_set(adds, gone)) == [(1, "a")]


def test_release_shows_the_low_side_again(spark):
    cell = "key long, column string, value long"
    owner = "key long, column string, owned boolean, epoch long"
    high, low = spark.createDataFrame([(1, "v", 99)], cell), spark.createDataFrame([(1, "v", 20), (2, "v", 5)], cell)
    owners, gone = spark.createDataFrame([(1, "v", True, 1)], owner), spark.createDataFrame([(1,), (2,)], "key long")
    assert got(policies.overlaid(high, low, owners, gone.limit(0))) == [(1, "v", 20 + 79, "high"), (2, "v", 5, "low")]
    released = policies.release(owners, spark.createDataFrame([(1, None)], "key long, column string"), F.lit(2).cast("long"))
    assert got(released) == [(1, "v", False, 2)]
    assert got(policies.overlaid(high, low, released, gone.limit(0))) == [(1, "v", 20, "low"), (2, "v", 5, "low")]
    assert got(policies.overlaid(high, low, owners, gone)) == [(1, "v", 99, "high")]


def test_strict_merge_raises(spark):
    cells = "key long, column string, value double, generation long, millis long, logical long, node long"
    bad = spark.createDataFrame([(1, "a", 1.0, 0, 5, 0, 0), (1, "a", 2.0, 0, 5, 0, 0)], cells)
    none = spark.createDataFrame([], "key long, generation long, millis long, logical long, node long")
    with pytest.raises(Exception, match="corrupt"):
        merge.merge(bad, none, strict=True).collect()


def test_state_guards(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    with pytest.raises(Exception, match="there already"):
        state.insert(t, t.limit(1), ["k"]).collect()
    with pytest.raises(ValueError, match="not to be updated: k"):
        state.update(t, F.lit(True), {"k": F.lit(1)}, ["k"])
    with pytest.raises(Exception, match="fails the check"):
        state.transaction(t, [lambda x: x.withColumn("v", F.lit(None).cast("string"))], F.col("v").isNotNull()).collect()
    with pytest.raises(Exception, match="no version"):
        state.export_state(t, spark.createDataFrame([(1, 5)], "k long, version long"), "k").collect()
    # a change and back in one batch is none; delete and insert again is an update
    row = lambda v: (v,) if v else None
    changes = [(1, 1, row("a"), row("t")), (1, 2, row("t"), row("a")), (2, 3, row("b"), None), (2, 4, None, row("c"))]
    df = spark.createDataFrame(changes, "k long, at long, old struct<v:string>, new struct<v:string>")
    assert [(x.k, x.op) for x in state.coalesced(df, ["k"], ["at"]).collect()] == [(2, "update")]


def test_schema_rules(spark):
    assert schema.barred("CREATE TABLE t (a TEXT CHECK (a > '')) -- VIRTUAL") == ["CHECK"] and schema.barred("CREATE TABLE \"CHECK\" (a TEXT /* REFERENCES */)") == []
    assert schema.parse_index('CREATE UNIQUE INDEX i ON "my t" (a, b DESC)') == ("i", "my t", ["a", "b"], True)
    with pytest.raises(ValueError, match="plain columns"):
        schema.parse_index("CREATE INDEX i ON t (lower(a))")
    assert schema.quoted('a"b') == '"a""b"' and schema.plain_name("a_1") and not schema.plain_name("1a")
    with pytest.raises(Exception, match="mapping to nothing"):
        new, old = spark.createDataFrame([("a", "x")], "table string, column string"), spark.createDataFrame([], "table string, column string, table_id string, column_id string")
        schema.identities(new, old, spark.createDataFrame([("a", None, "gone", None)], "table string, column string, old_table string, old_column string")).collect()
    with pytest.raises(Exception, match="may not be null"):
        schema.null_filled(spark.range(1), [("id", "bigint", True), ("x", "string", True)]).collect()


def test_pieces_are_checked(spark):
    records = spark.createDataFrame([(1, bytearray(b"abc" * 50)), (2, bytearray(b"")), (3, None)], "key long, payload binary")
    parts = chunks.pieces(records, 40).cache()
    assert got(chunks.assembled(parts)) == [(1, bytearray(b"abc" * 50)), (2, bytearray(b""))]
    for bad, text in ((parts.filter("key <> 1 OR place <> 2"), "missing or twice"), (parts.unionByName(parts.filter("place = 1")), "missing or twice"), (parts.withColumn("body", F.when(F.col("place") == 1, F.repeat(F.lit("x"), 40).cast("binary")).otherwise(F.col("body"))), "wrong digest")):
        with pytest.raises(Exception, match=text):
            chunks.assembled(bad).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(100)))
    (tmp_path / "b.bin").write_bytes(b"")
    there = files.objects(spark, str(tmp_path))
    assert [(x.name, x.bytes) for x in there.select("name", "bytes").orderBy("name").collect()] == [("a.bin", 100)]
    assert files.read_from(there, "a.bin", 90, 5).first().body == bytes(range(90, 95)) and files.read_from(there, "a.bin", 95).first().body == bytes(range(95, 100))
    now = F.lit("2024-01-02").cast("timestamp")
    staged = spark.createDataFrame([("x", datetime.datetime(2024, 1, 1)), ("y", datetime.datetime(2024, 1, 2))], "name string, modified timestamp")
    assert [x.name for x in files.staged_leftovers(staged, now).collect()] == ["x"]


def test_store_is_fenced(spark, tmp_path):
    one, two = store.Store(spark, str(tmp_path / "a")), store.Store(spark, str(tmp_path / "a"))
    assert one.publish({"t": spark.range(3)}, base=0) == 1
    with pytest.raises(store.Conflict):
        two.publish({"t": spark.range(9)}, base=0)
    assert one.read("t").count() == 3 and len(one.unreferenced()) == 1 and one.faults() == []
    assert two.transact(lambda have: {"t": have["t"].unionByName(spark.range(10, 12))}) == 2 and one.read("t").count() == 5 and one.read("t", 1).count() == 3
    other = store.Store(spark, str(tmp_path / "b"))
    assert one.backup(other) == 1 and other.identity() != one.identity() and other.manifest(1)["note"]["of"] == one.identity()
    spark.range(5).write.mode("overwrite").parquet(f"{other.path}/data/{other.manifest(1)['attempt']}/t")
    assert other.faults() == ["t"] and one.report().count() == 2
    with pytest.raises(ValueError, match="itself"):
        one.backup(two)


def test_sql_only_reads(spark):
    spark.range(2).createOrReplaceTempView("reads")
    for text in ("WITH a AS (SELECT 1 AS x) INSERT INTO tt SELECT x FROM a", "FROM reads INSERT INTO a SELECT id INSERT INTO b SELECT id", "DROP TABLE x", "SET a = 1", "CACHE TABLE reads", "CREATE TABLE n AS SELECT 1", "MERGE INTO a USING reads ON a.id = reads.id WHEN MATCHED THEN DELETE"):
        with pytest.raises(ValueError, match="reads"):
            store.sql(spark, text)
    assert store.sql(spark, "WITH a AS (SELECT id FROM reads) SELECT * FROM a WHERE id > ? UNION ALL SELECT 7", [0]).count() == 2


def test_sealed_columns_need_their_key(spark):
    df = store.sealed(spark.createDataFrame([("a", 1)], "t string, n int"), ["t"], b"0123456789abcdef", "k", "x")
    assert store.opened(df, ["t"], {"k": b"0123456789abcdef"}, "x").first().t == "a" and store.key_inventory(df).first().rows == 1
    for keys, context in (({"k": b"xxxxxxxxxxxxxxxx"}, "x"), ({"k": b"0123456789abcdef"}, "y"), ({}, "x")):
        with pytest.raises(Exception):  # noqa: B017  Spark wraps the cipher's own error
            store.opened(df, ["t"], keys, context).collect()


def test_kv(spark):
    rows = spark.createDataFrame([("a", "1", 1, False), ("b", "2", 2, False), ("a", None, 3, True)], "key string, value string, sequence long, deleted boolean")
    assert got(kv.load(rows)) == [("b", "2", 2)] and kv.compacted(rows, False).count() == 1
    assert [x.pos for x in kv.multi_get_bounded(rows.filter("NOT deleted"), ["a", "b", "c"], "key", "value", 1).orderBy("pos").collect()] == [0]


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "sky": "sky", "über": "über"}
    assert {w: stem(w) for w in words} == words


def test_index_is_ready_or_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Cats and dogs"), (2, "a dog"), (3, None)], "id long, t string")
    index, told = search.Index(spark, str(tmp_path), "id", "t", "porter"), []
    index.listeners.append(lambda name, generation: told.append((name, generation)))
    with pytest.raises(RuntimeError, match="empty"):
        index.bm25(["dogs"])
    index.rebuild(docs)
    assert got(index.bm25(["dogs"]).select("key")) == [(1,), (2,)]
    index.maintain(docs.filter("id <> 2").withColumn("t", F.when(F.col("id") == 3, "dogs dogs").otherwise(F.col("t"))), docs.filter("id > 1"))
    assert [x.key for x in index.bm25(["dog"], 1).collect()] == [3] and got(index.lengths()) == [(1, 3), (3, 2)] and told == [("t", 1), ("t", 2)]
    with pytest.raises(Exception):  # noqa: B017  a text column that is not there
        index.rebuild(spark.range(1))
    with pytest.raises(RuntimeError, match="failed"):
        index.postings()


def test_vectors(spark):
    import struct

    blobs = spark.createDataFrame([(1, bytearray(struct.pack("<2f", 1.0, 2.0))), (2, None)], "id long, b binary")
    assert [(x.key, x.vector) for x in search.decoded(blobs, "id", "b", 2).collect()] == [(1, [1.0, 2.0])]
    with pytest.raises(Exception, match="12 bytes"):
        search.decoded(blobs, "id", "b", 3).collect()
    r = random.Random(2)
    v = spark.createDataFrame([(k, [r.random() for _ in range(4)]) for k in range(90)] + [(90, None), (91, [0.5] * 4), (92, [0.5] * 4)], "id long, e array<double>")
    q = v.filter("id % 30 = 1")
    for metric in ("l2", "l1", "cosine"):
        want = []
        for x in q.collect():
            want += [(x.id, y.id, round(y.distance, 9)) for y in search.knn(v, "id", "e", x.e, 3, metric).collect()]
        few = search.knn_batch(v, q, "id", "e", 3, metric, tile=20, asked=2)
        assert sorted((x.query, x.id, round(x.distance, 9)) for x in few.collect()) == sorted(want)


def test_values(spark):
    row = spark.range(1).select(values.glob(F.lit("abc\n"), "abc"), values.glob(F.lit("abc"), "a[!x]c"), values.unhexed(F.lit("0g")), values.cidr_allows(F.lit("10.1.2.300"), ["0.0.0.0/0"]), values.substr(F.lit("hello"), F.lit(-3), F.lit(2)), values.printf("%d%%|%s", F.lit(None), F.lit(None)), values.datetime_shift(F.lit("2024-03-31").cast("timestamp"), "-1 month"))
    assert tuple(row.first()) == (False, False, None, False, "ll", "0%|", datetime.datetime(2024, 2, 29))
    for bad in (lambda: values.strftime("%q", F.lit(1)), lambda: values.datetime_shift(F.lit(1), "tomorrow")):
        with pytest.raises(ValueError, match="no "):
            bad()


def test_ordered_stream(spark, tmp_path):
    shape = "origin long, sequence long, payload string"

    def feed(name, rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    feed("a", [(1, 2, "b"), (1, 4, "d"), (2, 1, "x")])
    stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.ordered(stream).writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert got(spark.table("ordered")) == [(2, 1, "x")]
    feed("b", [(1, 1, "a"), (2, 1, "x"), (1, 3, "c"), (2, 3, "z")])
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("ordered")) == [(1, k + 1, c) for k, c in enumerate("abcd")] + [(2, 1, "x")]


def test_live_feed(spark, tmp_path):
    feed = live.Feed(2)
    for k in range(4):
        feed.put(("Update", k, None))
    assert feed.closed and feed.get() == ("Reset", None, None) and feed.get() is None
    queue = live.Queue(10)
    queue.take(7)
    with pytest.raises(live.Busy):
        queue.take(4)
    with pytest.raises(live.Limit):
        queue.take(11)
    assert [live.next_batch(100, s) for s in (0.02, 0.005, 0.001)] == [50, 100, 200]
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    now, seen = {"df": spark.createDataFrame([(1, 2)], "id long, v long")}, []
    query = live.LiveQuery(lambda: now["df"], "id", ["v", "w"], lambda kind, at, df: seen.append((kind, at[1])), "e", 1, ("t",), "me")
    changes = lambda table, origin: spark.createDataFrame([(table, origin)], "table string, origin string")
    query.on_batch(changes("t", "you"), 0)
    now["df"] = spark.createDataFrame([(1, 3)], "id long, v long")
    query.on_batch(changes("other", "you"), 1)
    query.on_batch(changes("t", "me"), 2)
    query.on_batch(changes("t", "you"), 3)
    now["df"] = spark.createDataFrame([(k, 9) for k in range(4)], "id long, v long")
    query.on_batch(None, 4)
    now["df"] = now["df"].withColumn("w", F.lit(1))
    query.on_batch(None, 5)
    assert seen == [("Initial", 0), ("Update", 3), ("Reset", 4), ("Reset", 5)] and query.resume(("e", 3)) == 4
    for cursor in (("x", 3), ("e", 9), ("e", -1)):
        with pytest.raises(ValueError, match="cursor"):
            query.resume(cursor)


class Shelf:
    """A backend for the test: parts a and b."""

    def __init__(self, where):
        self.where = where

    def parts(self):
        return ["a", "b"]

    def records(self, part):
        yield part, self.where.encode(), 1, False
        yield part, None, 2, part == "b"


def test_backend_and_objects(spark):
    from dataclasses import dataclass

    from braidlake.sources import backend

    @dataclass
    class Record:
        key: str
        sequence: int

    df = backend.records(spark, "tests.test_replication.Shelf", "here")
    assert [x.value for x in df.filter("sequence = 1").orderBy("key").collect()] == [b"here", b"here"]
    assert list(backend.as_objects(kv.load(df).select("key", "sequence"), Record)) == [Record("a", 2)]


def test_reports_and_replicas(spark, tmp_path):
    from braidlake.sources import reports

    own = store.Store(spark, str(tmp_path / "s"))
    own.publish({"t": spark.range(4)})
    assert reports.status(own) == {"id": own.identity(), "versions": 1, "last": 1, "unreferenced": 0} and reports.verify(own) == {"versions": {"1": []}}
    told = reports.inspect(own)
    assert told["tables"]["t"]["columns"] == ["id bigint"] and '"rows": 4' in reports.as_json(told) and "rows: 4" in reports.as_text(told)
    assert reports.progress(spark.createDataFrame([(1, 3, 9), (2, 4, 4)], "origin long, applied long, observed long")) == {"origins": 2, "behind": 6}
    locked = store.sealed(spark.createDataFrame([("a",)], "t string"), ["t"], b"0123456789abcdef", "k", "x")
    assert reports.keys({"one": locked, "two": locked}) == {"tables": {"one": {"k": 1}, "two": {"k": 1}}, "shared": ["k"]}
    state.export_replica(str(tmp_path / "r"), spark.range(3), spark.range(1))
    assert [df.count() for df in state.import_replica(spark, str(tmp_path / "r"))] == [3, 1]


def test_file_lifecycle(spark):
    shape = "name string, digest string, bytes long, generation long, millis long, node long, deleted boolean"
    empty = spark.createDataFrame([], shape)
    up = lambda text: spark.createDataFrame([("f", bytearray(text)), ("g", bytearray(b""))], "name string, content binary")
    at = lambda n: (F.lit(n).cast("long"), F.lit(1).cast("long"))
    one = files.put(files.put(empty, up(b"x"), *at(1)), up(b"yy"), *at(2))
    assert [(x.name, x.bytes, x.generation) for x in files.listed(one).collect()] == [("f", 2, 1), ("g", 0, 1)]
    gone = files.removed(one, spark.createDataFrame([("f",), ("none",)], "name string"), *at(3))
    assert [x.name for x in files.listed(gone).collect()] == ["g"] and gone.count() == one.count() + 1


def test_indexes_are_replaced_at_once(spark, tmp_path):
    docs, all_ = spark.createDataFrame([(1, "cats", "x")], "id long, t string, u string"), search.Indexes(spark, str(tmp_path))
    all_.replace({"t": ("id", "t", "unicode61")}, docs)
    with pytest.raises(Exception):  # noqa: B017  a column that is not there
        all_.replace({"u": ("id", "u", "porter"), "v": ("id", "gone", "ascii")}, docs)
    assert list(all_.held) == ["t"]
    kept = all_["t"]
    all_.replace({"t": ("id", "t", "unicode61"), "u": ("id", "u", "porter")}, docs)
    assert all_["t"] is kept and all_["u"].postings(["x"]).count() == 1


def test_snapshots(spark):
    body = spark.createDataFrame([("s", 0, bytearray(b"a")), ("s", 1, bytearray(b"b")), ("r", 0, bytearray(b"c"))], "name string, chunk long, body binary")
    assert got(chunks.received(chunks.manifest(body), body.filter("chunk = 0"))) == [("r", True), ("s", False)]
    pins = spark.createDataFrame([("x", 1, 5, datetime.datetime(2024, 1, 2)), ("y", 1, 3, datetime.datetime(2024, 1, 1))], "snapshot string, origin long, floor long, expires timestamp")
    assert [x.snapshot for x in chunks.live_pins(pins, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()] == ["x"]
