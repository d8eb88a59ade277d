"""Queries of the engine and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidlake.functions import values
from braidlake.operators import chunks, kv, log, merge, policies, search
from braidlake.plans.fixtures import EDITS, LOG, TABLES, edits, events, table, tombstones
from braidlake.plans.fixtures import log as log_rows
from braidlake.plans.registry import QUERIES, SQL, query
from braidlake.sources import store
from braidlake.streaming import live

# ---- merge


@query(f"""WITH {EDITS}, w AS (SELECT key, max(generation) AS g FROM live GROUP BY 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY key, col ORDER BY generation DESC, millis DESC, logical DESC, node DESC) AS n FROM live)
    SELECT b.key, b.col AS "column", CASE WHEN b.generation = w.g THEN b.value END AS value, w.g AS generation FROM b JOIN w USING (key) WHERE n = 1""")
def merge_lww(spark, d):
    return merge.merge(edits(spark, d), tombstones(spark, d)).select("key", "column", "value", "generation")


@query(f'WITH {EDITS} SELECT key, col AS "column", min(value) AS low, max(value) AS high FROM live GROUP BY 1, 2')
def merge_minmax(spark, d):
    return merge.merge(edits(spark, d), tombstones(spark, d)).select("key", "column", "low", "high")


@query(f"WITH {EDITS} SELECT key, floor FROM floors")
def merge_floor(spark, d):
    return merge.floors(tombstones(spark, d))


SQL["merge_idempotent"] = SQL["merge_batch"] = SQL["merge_lww"]


@query(SQL["merge_lww"])
def merge_idempotent(spark, d):
    e = edits(spark, d)
    return merge.merge(e.unionByName(e), tombstones(spark, d).unionByName(tombstones(spark, d))).select("key", "column", "value", "generation")


@query(SQL["merge_lww"])
def merge_batch(spark, d):
    e = edits(spark, d)
    out = e.filter("node = 2")
    for k in (0, 1):
        out = out.unionByName(e.filter(F.col("node") == k))
    return merge.merge(out, tombstones(spark, d), strict=True).select("key", "column", "value", "generation")


@query(f"WITH {EDITS} SELECT millis, logical, node FROM live ORDER BY millis DESC, logical DESC, node DESC LIMIT 1")
def merge_clock(spark, d):
    return merge.watermark(merge.live_cells(edits(spark, d), tombstones(spark, d)))


@query(f'WITH {EDITS} SELECT key, col AS "column", generation, count(DISTINCT value) AS "values" FROM (SELECT key, col, generation, millis // 86400000 AS day, value FROM edits) GROUP BY key, col, generation, day HAVING count(DISTINCT value) > 1')
def corrupt_check(spark, d):
    days = edits(spark, d).withColumns({"millis": F.floor(F.col("millis") / 86400000), "logical": F.lit(0), "node": F.lit(0)})
    return merge.conflicts(days).select("key", "column", "generation", "values")


@query(f"WITH {EDITS} SELECT key, count(*) AS cells FROM edits WHERE key IN (SELECT key FROM floors) GROUP BY 1")
def affected_semi(spark, d):
    return edits(spark, d).join(tombstones(spark, d).select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {EDITS} SELECT e.key, count(*) AS cells, count(f.floor) AS fenced FROM edits e LEFT JOIN floors f USING (key) GROUP BY 1")
def export_enrich(spark, d):
    return edits(spark, d).join(merge.floors(tombstones(spark, d)), "key", "left").groupBy("key").agg(F.count(F.lit(1)).alias("cells"), F.count("floor").alias("fenced"))


def _before_after(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = o.filter(F.col("o_orderkey") % 10 != 1)
    after = o.filter(F.col("o_orderkey") % 10 != 2).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return before, after


_PATCH = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'added' WHEN o_orderkey % 10 = 2 THEN 'removed' ELSE 'updated' END AS change,
    CASE WHEN o_orderkey % 10 <> 2 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 10 = 2 THEN NULL WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)"""


@query(_PATCH)
def merge_patch(spark, d):
    return merge.patch(*_before_after(spark, d), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 1 THEN 'added' WHEN c_custkey % 9 = 2 THEN 'removed' ELSE 'updated' END AS change, CASE WHEN c_custkey % 9 = 4 THEN 'moved' WHEN c_custkey % 9 = 1 THEN c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_acctbal > 0 AND c_custkey % 9 IN (1, 2, 4)""")
def live_diff(spark, d):
    """What a subscriber to the customers in credit hears of a batch."""
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    now = c.filter("c_custkey % 9 <> 2").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 == 4, F.lit("moved")).otherwise(F.col("c_mktsegment")))
    return merge.patch(c.filter("c_custkey % 9 <> 1"), now, "c_custkey", ["c_mktsegment"])


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 2 THEN NULL WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS value, "
       "CASE WHEN o_orderkey % 10 IN (1, 2, 3) THEN 99 ELSE o_orderkey % 7 END::BIGINT AS version, o_orderkey % 10 = 2 AS deleted FROM orders")  # fmt: skip
def migrate_carry(spark, d):
    before, after = _before_after(spark, d)
    cells = lambda x: x.select(F.col("o_orderkey").alias("key"), F.lit("p").alias("column"), F.col("o_totalprice").alias("value"))
    old = cells(before).withColumn("version", (F.col("key") % 7).cast("long"))
    return merge.carry_versions(old, cells(after), F.lit(99).cast("long")).select("key", "value", "version", "deleted")


@query("WITH e AS (SELECT user_id, event_type, first(value ORDER BY ts, event_id) AS old, last(value ORDER BY ts, event_id) AS new FROM events GROUP BY 1, 2) SELECT * FROM e WHERE old <> new")
def cdc_coalesce(spark, d):
    order = F.struct("ts", "event_id")
    return events(spark, d).groupBy("user_id", "event_type").agg(F.min_by("value", order).alias("old"), F.max_by("value", order).alias("new")).filter("old <> new")


# ---- policies and overlays


@query("SELECT key, sum(pos - neg)::BIGINT AS value FROM (SELECT user_id AS key, event_id % 3 AS actor, max(event_id % 97) AS pos, max(event_id % 9) AS neg FROM events GROUP BY 1, 2) GROUP BY 1")
def pn_counter(spark, d):
    e = table(spark, d, "events")
    return policies.counter(e.select(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("actor"), (F.col("event_id") % 97).alias("pos"), (F.col("event_id") % 9).alias("neg")))


@query(f"WITH {EDITS} SELECT key, sum(logical % 9)::BIGINT AS value FROM live GROUP BY 1")
def pn_rebase(spark, d):
    return policies.rebase_counters(edits(spark, d).withColumn("delta", F.col("logical") % 9), merge.floors(tombstones(spark, d)))


@query("SELECT DISTINCT a.user_id AS key, a.event_type AS value FROM events a WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = a.user_id AND r.event_id % 10 = a.event_id % 10)")
def or_set(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("event_id") % 10).alias("tag"))
    return policies.observed_set(e, e.filter("value = 'error'"))


@query("SELECT user_id AS key, list_sort(list(DISTINCT event_type)) AS tags FROM events GROUP BY 1")
def or_set_values(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_set("event_type")).alias("tags"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 11 <> 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def overlay_project(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    owned = c.filter("c_custkey % 7 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"), (F.col("c_custkey") % 11 != 0).alias("owned"))
    return policies.overlay(c, owned, "c_custkey", "c_acctbal")


@query("SELECT user_id AS key, event_type AS \"column\", last(event_id ORDER BY event_id % 100, event_id) AS owner, last(event_id % 2 = 0 ORDER BY event_id % 100, event_id) AS owned FROM events GROUP BY 1, 2")
def owner_latest(spark, d):
    e = table(spark, d, "events")
    return policies.latest_owner(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("column"), F.col("event_id").alias("owner"), (F.col("event_id") % 2 == 0).alias("owned"), (F.col("event_id") % 100).alias("epoch"), F.col("event_id").alias("version")))


# ---- logs


@query(f"WITH {LOG} SELECT origin, max(sequence) AS upto, count(*) AS n FROM log WHERE sequence < 97 GROUP BY 1")
def apply_contiguous(spark, d):
    rows = log_rows(spark, d)
    applied = spark.createDataFrame([], "origin long, applied long")
    return log.contiguous(rows, applied).groupBy("origin").agg(F.max("sequence").alias("upto"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT origin, sequence - 1 AS first, sequence - 1 AS last FROM log WHERE sequence % 97 = 1 AND sequence > 1")
def log_holes(spark, d):
    return log.holes(log_rows(spark, d))


@query(f"WITH {LOG} SELECT origin, sequence, row_number() OVER (PARTITION BY origin ORDER BY sequence)::INTEGER AS turn, (origin + 2) % 5 AS seat FROM log")
def round_robin(spark, d):
    return log.round_robin(log_rows(spark, d), 2, 5).select("origin", "sequence", "turn", "seat")


@query(f"WITH {LOG} SELECT origin, sequence, running FROM (SELECT *, sum(size) OVER (PARTITION BY origin ORDER BY sequence)::BIGINT AS running FROM log) WHERE running <= 4000 OR sequence = 1")
def admit_bytes(spark, d):
    return log.admit(log_rows(spark, d), 4000, "size").select("origin", "sequence", "running")


@query(f"WITH {LOG} SELECT l.origin, l.sequence FROM log l WHERE l.sequence < 50")
def retention_prefix(spark, d):
    return log.retention_prefix(log_rows(spark, d).withColumn("ok", F.col("sequence") % 50 != 0), "ok").select("origin", "sequence")


@query(f"WITH {LOG} SELECT origin, min(coalesce(acked, 0))::BIGINT AS floor FROM (SELECT origin, sequence % 3 AS peer, max(CASE WHEN sequence % 2 = 0 THEN sequence END) AS acked FROM log GROUP BY 1, 2) GROUP BY 1")
def retention_floor(spark, d):
    acks = log_rows(spark, d).groupBy("origin", (F.col("sequence") % 3).alias("peer")).agg(F.max(F.when(F.col("sequence") % 2 == 0, F.col("sequence"))).alias("acked"))
    return log.retention_floor(acks)


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def compact_latest(spark, d):
    return kv.compact(table(spark, d, "events"), "user_id", "event_id", "value")


@query("SELECT 'f' || (o_orderkey % 20) AS name, o_orderkey // 20 AS chunk FROM orders WHERE FALSE UNION ALL SELECT 'f' || n, c FROM range(20) a(n), range(80) b(c) WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id % 20 = n AND event_id // 20 % 60 = c AND event_id % 7 = 0)")
def chunk_missing(spark, d):
    have = table(spark, d, "events").filter("event_id % 7 = 0").select(F.concat(F.lit("f"), F.col("event_id") % 20).alias("name"), (F.floor(F.col("event_id") / 20) % 60).alias("chunk")).distinct()
    total = spark.range(20).select(F.concat(F.lit("f"), F.col("id")).alias("name"), F.lit(80).cast("long").alias("total"))
    return chunks.missing_chunks(have, total)


@query("SELECT event_id % 64 AS segment, avg(CASE WHEN live THEN 1.0 ELSE 0.0 END) AS ratio FROM (SELECT event_id, event_id = max(event_id) OVER (PARTITION BY user_id, event_type) AS live FROM events) GROUP BY 1")
def segment_ratio(spark, d):
    e = table(spark, d, "events")
    best = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("best")).select("best")
    marked = e.select("event_id").join(best, F.col("event_id") == F.col("best"), "left")
    return marked.groupBy((F.col("event_id") % 64).alias("segment")).agg(F.avg(F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)).alias("ratio"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, d):
    return table(spark, d, "orders").filter("o_orderkey > 100").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(50)


@query("SELECT pos, asked, c_acctbal AS value FROM (VALUES (0::BIGINT, 5::BIGINT), (1, 99999999), (2, 1), (3, 5)) v(pos, asked) LEFT JOIN customer ON c_custkey = asked")
def multi_get(spark, d):
    return kv.multi_get(table(spark, d, "customer"), [5, 99999999, 1, 5], "c_custkey", "c_acctbal")


@query("SELECT node, max(s)[1] AS incarnation, max(s)[2] AS state FROM (SELECT user_id AS node, [event_id % 11, event_id % 4] AS s FROM events) GROUP BY 1")
def member_merge(spark, d):
    best = F.max(F.struct((F.col("event_id") % 11).alias("i"), (F.col("event_id") % 4).alias("s"))).alias("b")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(best).select("node", F.col("b.i").alias("incarnation"), F.col("b.s").alias("state"))


# ---- search


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _first(spark, d):
    return _vectors(spark, d).orderBy("vec_id").first()["embedding"]


_D = {
    "l2": "sqrt(list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))))",
    "l1": "list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda p: abs(p[1]::DOUBLE - p[2])))",
    "cosine": "1 - list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x)))",
}


def _knn(metric):
    def run(spark, d):
        return search.knn(_vectors(spark, d), "vec_id", "embedding", _first(spark, d), 10, metric).select("vec_id", F.round("distance", 6).alias("distance"))

    run.__name__ = f"knn_{metric}"
    query(f"SELECT a.vec_id, round({_D[metric]}, 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_D[metric]}, a.vec_id LIMIT 10")(run)


for _metric in _D:
    _knn(_metric)


@query(f"SELECT q.vec_id AS query, a.vec_id, round({_D['l2']}, 6) AS distance FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D['l2']}, a.vec_id) <= 3")
def knn_batch(spark, d):
    v = _vectors(spark, d)
    return search.knn_batch(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", 3).select("query", "vec_id", F.round("distance", 6).alias("distance"))


def _index(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", "text")


_P = r"p AS (SELECT doc_id AS key, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents))"


@query(f"WITH {_P} SELECT key FROM p WHERE term IN ('that', 'from') GROUP BY 1 HAVING count(DISTINCT term) = 2")
def fts_match(spark, d):
    return search.match(_index(spark, d), ["that", "from"])


@query(f"WITH {_P} SELECT DISTINCT key FROM p WHERE term IN ('license', 'pour')")
def fts_or(spark, d):
    return search.match(_index(spark, d), ["license", "pour"], every=False)


@query(f"WITH {_P} SELECT DISTINCT a.key FROM p a JOIN p b ON a.key = b.key AND b.pos = a.pos + 1 WHERE a.term = 'mit' AND b.term = 'license'")
def fts_phrase(spark, d):
    return search.phrase(_index(spark, d), ["mit", "license"])


@query(f"""WITH {_P}, l AS (SELECT key, count(*) AS len FROM p GROUP BY 1), c AS (SELECT count(*) AS docs, avg(len) AS mean FROM l),
    tf AS (SELECT key, term, count(*) AS tf FROM p WHERE term IN ('license', 'released') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
    FROM tf JOIN l USING (key) JOIN df USING (term), c GROUP BY 1""")
def fts_bm25(spark, d):
    return search.bm25_scan(table(spark, d, "documents"), "doc_id", "text", ["license", "released"]).select("key", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS key FROM documents WHERE lower(text) LIKE '%cen%'")
def fts_trigram(spark, d):
    return search.trigrams(table(spark, d, "documents"), "doc_id", "text").filter("gram = 'cen'").select("key")


# ---- streams, in their batch form


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    w = live.windowed(table(spark, d, "events"), "1 hour")
    return w.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS s, event_type FROM events) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return live.windowed(table(spark, d, "events"), "2 hours", "1 hour").select(F.col("w.start").alias("start"), "event_type", "n")


@query("WITH f AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 hour, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
       "g AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")  # fmt: skip
def stream_session(spark, d):
    return live.sessions(table(spark, d, "events"), "6 hours").select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events)")
def stream_dedup(spark, d):
    return table(spark, d, "events").dropDuplicates(["user_id", "event_type", "value"]).agg(F.count(F.lit(1)).alias("n"))


# ---- SQL functions that differ between engines


@query("SELECT p_partkey, p_size // 3 AS a, CASE WHEN p_size > 20 THEN NULL ELSE least(p_size, 10) END AS b, typeof_ AS c, p_name LIKE '%a%' AND p_name LIKE 'g%' AS g FROM (SELECT *, CASE WHEN p_retailprice IS NULL THEN 'null' ELSE 'real' END AS typeof_ FROM part)")
def fn_compat(spark, d):
    p = table(spark, d, "part")
    some = F.when(F.col("p_size") <= 20, F.col("p_size"))
    return p.select("p_partkey", values.int_div(F.col("p_size"), F.lit(3)).cast("int").alias("a"), values.scalar_least(some, F.lit(10)).alias("b"), values.storage_class(F.col("p_retailprice"), "double").alias("c"), (values.glob(F.col("p_name"), "g*") & values.glob(F.col("p_name"), "*a*")).alias("g"))


#: One text that both engines run.
SHARED = {
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_range": "SELECT p.p_partkey, n.n_nationkey FROM part p JOIN nation n ON p.p_size BETWEEN n.n_nationkey AND n.n_nationkey + 2",
    "join_nullsafe": "SELECT n_name, r_name, a.k FROM (SELECT n_name, nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT r_name, nullif(r_regionkey, 0) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "subquery_exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 1)",
    "agg_group": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60",
    "agg_distinct": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
    "agg_filter": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id",
    "agg_total": "SELECT coalesce(sum(CAST(o_orderkey AS DOUBLE)), 0.0) AS t FROM orders WHERE o_orderkey < 0",
    "agg_rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "agg_cube": "SELECT event_type, user_id % 3 AS k, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)",
    "win_rank": "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer",
    "win_lag": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events",
    "win_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events",
    "win_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM events",
    "win_exclude": "SELECT event_id, round((sum(value) OVER (PARTITION BY user_id)) - value, 4) AS s FROM events",
    "win_groups": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS g FROM orders) x",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    "fn_string": "SELECT c_custkey, upper(c_name) AS a, trim(lower(c_name)) AS b, replace(c_name, '0', 'o') AS c, substr(c_name, 3, 5) AS e, CAST(length(c_name) AS BIGINT) AS f FROM customer",
    "fn_math": "SELECT o_orderkey, abs(o_totalprice) AS a, round(sqrt(o_totalprice), 4) AS b, floor(o_totalprice) AS c, coalesce(nullif(o_orderkey % 4, 0), -1) AS e FROM orders WHERE o_totalprice >= 0",
    "fn_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'big' WHEN o_totalprice IS NULL THEN 'none' ELSE 'small' END AS k FROM orders",
    "fn_like": "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%e%' AND p_size IN (1, 5, 9) AND p_retailprice BETWEEN 0 AND 100000",
    "live_filter": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0",
}


def _shared(text):
    def run(spark, d):
        for name in TABLES:
            if name in text:
                table(spark, d, name).createOrReplaceTempView(name)
        return store.sql(spark, text)

    return run


for _name, _text in SHARED.items():
    QUERIES[_name] = _shared(_text)
    SQL[_name] = _text
SQL["fn_math"] = SQL["fn_math"].replace("floor(o_totalprice)", "floor(o_totalprice)::BIGINT")
SQL["win_rank"] = SQL["win_rank"].replace("rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", "(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::INTEGER")


@query("SELECT event_id, date_trunc('day', ts) AS day, year(ts)::INTEGER AS y, (props->>'$.k')::BIGINT AS k FROM events")
def fn_date_json(spark, d):
    return table(spark, d, "events").select("event_id", F.date_trunc("day", "ts").alias("day"), F.year("ts").alias("y"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_listagg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT o_orderkey, (SELECT max(ts) FROM events e WHERE e.user_id = o_custkey AND e.ts <= o_orderdate + INTERVAL 10000 day) AS seen FROM orders")
def asof_latest(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 10000 DAY")).alias("at"), "o_orderkey", F.lit(None).cast("timestamp_ntz").alias("ts"))
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(None).cast("long").alias("o_orderkey"), "ts")
    order = Window.partitionBy("k").orderBy("at", F.col("ts").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return o.unionByName(e).withColumn("seen", F.last("ts", ignorenulls=True).over(order)).filter("o_orderkey IS NOT NULL").select("o_orderkey", "seen")


@query("SELECT name, digest, deleted FROM (SELECT 'f' || (event_id % 40) AS name, event_id AS digest, event_type = 'error' AS deleted, row_number() OVER (PARTITION BY event_id % 40 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def file_lww(spark, d):
    best = F.max_by(F.struct(F.col("event_id").alias("digest"), (F.col("event_type") == "error").alias("deleted")), F.struct("ts", "event_id")).alias("b")
    return events(spark, d).groupBy(F.concat(F.lit("f"), F.col("event_id") % 40).alias("name")).agg(best).select("name", "b.digest", "b.deleted")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'local' WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey) THEN 'remote' ELSE 'unavailable' END AS state FROM supplier")
def file_availability(spark, d):
    peers = table(spark, d, "customer").select("c_custkey").distinct()
    rows = table(spark, d, "supplier").join(peers, F.col("s_suppkey") == F.col("c_custkey"), "left")
    return rows.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "local").when(F.col("c_custkey").isNotNull(), "remote").otherwise("unavailable").alias("state"))


# the other queries register themselves
from braidlake.plans import function_queries, replication_queries, state_queries  # noqa: E402, F401
