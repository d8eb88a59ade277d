"""Engine operators: literal cases, order-free merging, and registered queries against their SQL."""

import datetime
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from braidlake.functions import values
from braidlake.operators import log, merge, policies, search
from braidlake.plans import catalog
from braidlake.plans.fixtures import TABLES
from braidlake.sources.store import Store, sql
from braidlake.streaming import live

CELL = "key long, column string, value double, generation long, millis long, logical long, node long"
TOMB = "key long, generation long, millis long, logical long, node long"
SF = "/root/testdata/sf0.001"


def merged(spark, cells, tombs):
    return sorted(map(tuple, merge.merge(spark.createDataFrame(cells, CELL), spark.createDataFrame(tombs, TOMB)).collect()))


def test_merge_is_free_of_order_and_repeats(spark):
    r = random.Random(1)
    cells = [(r.randint(0, 5), r.choice("ab"), float(r.randint(0, 9)), r.randint(0, 3), m, 0, 0) for m in range(60)]
    tombs = [(k, 1, 5, 0, 0) for k in (1, 2)]
    want = merged(spark, cells, tombs)
    again = cells + cells[:20]
    r.shuffle(again)
    assert merged(spark, again, tombs + tombs) == want
    assert all(g > 1 for k, *_, g in want if k in (1, 2))


def test_counters_and_sets(spark):
    state = [(1, 1, 5, 0), (1, 2, 7, 0), (1, 2, 3, 0)]
    assert policies.counter(spark.createDataFrame(state, "key long, actor long, pos long, neg long")).collect() == [(1, 12)]
    ops = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 11)], "key long, generation long, delta long")
    assert policies.rebase_counters(ops, spark.createDataFrame([(1, 1)], "key long, floor long")).collect() == [(1, 18)]
    adds = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "key long, value string, tag long")
    assert policies.observed_set(adds, adds.filter("tag IN (1, 3)")).collect() == [(1, "a")]


def test_overlay_release(spark):
    low = spark.createDataFrame([(1, 20)], "id long, v long")
    own = lambda owned: spark.createDataFrame([(1, 99, owned)], "id long, v long, owned boolean")
    assert policies.overlay(low, own(True), "id", "v").collect() == [(1, 99)]
    assert policies.overlay(low, own(False), "id", "v").collect() == [(1, 20)]


def test_trigrams_of_odd_texts(spark):
    texts = ["", "ab", "aBc", "aaaa", "a\nb\r\n\u2028c", "x\U0001f600\U0001f601y", "ÄÖÜ ß ΑΣ", "a\x00b ", None]
    docs = spark.createDataFrame([*enumerate(texts), (2, "abcd")], "id long, t string")
    want = sorted((k, g) for k, t in [*enumerate(texts), (2, "abcd")] for g in {(t or "").lower()[i : i + 3] for i in range(len(t or "") - 2)})
    assert sorted(map(tuple, search.trigrams(docs, "id", "t").collect())) == want
    assert docs.select(F.size(search.tokens(F.col("t"), "trigram")).alias("n")).filter("n IS NULL OR n < 0").count() == 0


def test_trigrams_of_a_long_text_cost_as_those_of_short_ones(spark):
    words = " ".join(random.Random(2).choices(["cent", "pour", "license", "that"], k=20_000))[:80_000]
    long, short = [(0, words)], [(k, words[k * 1000 : (k + 1) * 1000]) for k in range(80)]

    def took(rows):
        docs, times = spark.createDataFrame(rows, "id long, t string").coalesce(1), []
        for _ in range(2):
            began = time.time()
            assert search.trigrams(docs, "id", "t").filter("gram = 'cen'").count() == len(rows)
            times.append(time.time() - began)
        return min(times)

    assert took(long) < 8 * took(short)


@pytest.mark.parametrize(("metric", "want"), [("l2", 2**0.5), ("l1", 2.0), ("cosine", 1.0)])
def test_knn(spark, metric, want):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, e array<float>")
    got = search.knn(df, "id", "e", [1.0, 0.0], 5, metric).collect()
    assert [x.id for x in got] == [1, 2] and got[1].distance == pytest.approx(want, abs=1e-5)


def test_conflict_and_log(spark):
    bad = [(1, "a", 1.0, 0, 5, 0, 0), (1, "a", 2.0, 0, 5, 0, 0)]
    assert merge.conflicts(spark.createDataFrame(bad, CELL)).count() == 1
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (2, 2)], "origin long, sequence long")
    done = spark.createDataFrame([(2, 1)], "origin long, applied long")
    assert sorted(map(tuple, log.contiguous(rows, done).collect())) == [(1, 1), (1, 2), (2, 2)]
    assert log.holes(rows).collect() == [(1, 3, 3)]


def test_clock_and_values(spark):
    assert values.next_clock((5, 3, b"n"), 9) == (9, 0, b"n") and values.next_clock((5, 3, b"n"), 4) == (5, 4, b"n")
    row = spark.range(1).select(values.int_div(F.lit(-7), F.lit(2)), values.int_div(F.lit(1), F.lit(0)), values.scalar_least(F.lit(1), F.lit(None).cast("int")), values.quote_literal(F.lit("a'b"), "string"), values.glob(F.lit("Abc.d"), "A?c.*")).first()
    assert tuple(row) == (-3, None, None, "'a''b'", True)
    mixed = spark.createDataFrame([(1, 2**53 + 1, None), (2, None, 2.0**53), (3, None, float("inf")), (4, -1, None), (5, None, -1.5)], "id int, i long, r double")
    assert [x.id for x in mixed.orderBy(values.number_key(F.col("i"), F.col("r"))).collect()] == [5, 4, 2, 1, 3]


def test_store(spark, tmp_path):
    first = Store(spark, str(tmp_path / "a"))
    assert first.versions() == []
    first.publish({"t": spark.range(3)})
    first.publish({"t": spark.range(5)})
    assert first.read("t").count() == 5 and first.read("t", 1).count() == 3
    other = Store(spark, str(tmp_path / "b"))
    first.backup(other)
    assert other.read("t").count() == 5
    with pytest.raises(ValueError, match="version"):
        first.read("t", 9)
    with pytest.raises(ValueError, match="reads"):
        sql(spark, "DROP TABLE x")


def test_live_query(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    now, got = {"df": spark.createDataFrame([(1, 2)], "id long, v long")}, []
    query = live.LiveQuery(lambda: now["df"], "id", ["v"], lambda kind, at, df: got.append((kind, at, sorted(map(tuple, df.collect())))), "e")
    query.on_batch(None, 0)
    query.on_batch(None, 1)
    now["df"] = spark.createDataFrame([(1, 3), (2, 1)], "id long, v long")
    query.on_batch(None, 2)
    assert got == [("Initial", ("e", 0), [(1, 2)]), ("Update", ("e", 2), [(1, "updated", 3), (2, "added", 1)])]
    with pytest.raises(ValueError, match="cursor"):
        query.resume(("x", 1), 0, 5)


def test_windows_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h), "a", 1.0) for h in (0, 0, 1)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = live.windowed(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x.n for x in spark.table("windows").collect()) == [1, 2]


def plain(v):
    if v is None or v != v:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(list(v) if isinstance(v, (list, tuple)) else v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert got.count() > 0
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(catalog.SQL[name])
        order = sorted(want.columns)
        expected = sorted(tuple(plain(v) for v in row) for row in want.project(", ".join(f'"{c}"' for c in order)).fetchall())
    assert sorted(got.columns) == order
    assert sorted(tuple(plain(v) for v in row) for row in got.select(*order).collect()) == expected
