"""Queries over logs, progress, peers, mergeable columns, ownership, files and bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidlake.operators import files, log, merge, policies
from braidlake.plans.fixtures import EDITS, LOG, edits, events, table, tombstones
from braidlake.plans.fixtures import log as log_rows
from braidlake.plans.registry import query

# ---- logs


def _delivered(spark, d):
    """The log with a third of its places delivered twice."""
    rows = log_rows(spark, d)
    return rows.unionByName(rows.filter("sequence % 3 = 0"))


@query(f"WITH {LOG} SELECT origin, sequence FROM log WHERE sequence < 97 AND sequence > CASE origin WHEN 1 THEN 40 WHEN 2 THEN 96 ELSE 0 END")
def apply_redelivered(spark, d):
    applied = spark.createDataFrame([(1, 40), (2, 96)], "origin long, applied long")
    return log.contiguous(_delivered(spark, d), applied, "size", 32).select("origin", "sequence")


@query(f"WITH {LOG} SELECT DISTINCT origin, CASE WHEN origin = 2 THEN 97 + CASE WHEN (SELECT max(sequence) FROM log l WHERE l.origin = 2) > 193 THEN 96 ELSE (SELECT max(sequence) FROM log l WHERE l.origin = 2) - 97 END ELSE 96 END::BIGINT AS upto FROM log")
def apply_upto(spark, d):
    applied = spark.createDataFrame([(2, 97)], "origin long, applied long")
    return log.first_gaps(_delivered(spark, d), applied, 25)


@query(f"""WITH {LOG} SELECT origin, sequence, CASE WHEN sequence <= 20 THEN 'duplicate' WHEN sequence % 10 = 1 THEN CASE WHEN sequence % 20 = 1 THEN 'duplicate' ELSE 'conflict' END ELSE 'new' END AS verdict
    FROM log WHERE sequence <= 60""")
def stage_incoming(spark, d):
    rows = _delivered(spark, d).filter("sequence <= 60").select("origin", "sequence", F.concat(F.lit("d"), "sequence").alias("digest"))
    floors = rows.select("origin").distinct().withColumn("floor", F.lit(20).cast("long"))
    pending = rows.filter("sequence % 10 = 1").distinct().withColumn("digest", F.when(F.col("sequence") % 20 == 1, F.col("digest")).otherwise(F.lit("other")))
    return log.staged(rows, floors, pending).select("origin", "sequence", "verdict")


@query(f"WITH {LOG} SELECT origin, count(*) AS n, sum(size)::BIGINT AS bytes FROM log GROUP BY 1")
def staged_totals(spark, d):
    return log.staged_totals(log_rows(spark, d), "size")


@query(f"WITH {LOG} SELECT origin, sequence FROM (SELECT *, sum(size) OVER w AS s, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY origin ORDER BY sequence)) WHERE (s <= 900 OR n = 1) AND n <= 70")
def admit_batch(spark, d):
    return log.admit(log_rows(spark, d), 900, "size", 70, 16).select("origin", "sequence")


@query(f"WITH {LOG} SELECT origin, sequence FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY sequence DESC) AS n FROM log) WHERE n > 50")
def retention_minimum(spark, d):
    return log.kept_minimum(log_rows(spark, d), 50, 32).select("origin", "sequence")


@query(f"WITH {LOG} SELECT origin, sequence FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY sequence DESC) AS n FROM log) WHERE n > 20 AND sequence <= CASE WHEN origin < 3 THEN 30 ELSE 89 END AND sequence < 90 AND sequence <= 40")
def retention_pass(spark, d):
    floors = spark.createDataFrame([(k, 30) for k in range(3)], "origin long, floor long")
    return log.retention_pass(log_rows(spark, d).withColumn("ok", F.col("sequence") % 90 != 0), floors, "ok", 20, 40).select("origin", "sequence")


@query(f"""WITH {LOG} SELECT origin, min(f)::BIGINT AS floor FROM (SELECT origin, coalesce(max(CASE WHEN sequence % 2 = 0 THEN sequence END), 0) AS f FROM log WHERE origin < 3 GROUP BY origin, sequence % 3
    UNION ALL SELECT 1, 17 UNION ALL SELECT 7, 5 UNION ALL SELECT 2, 8) GROUP BY 1""")
def retention_floor_pins(spark, d):
    acks = log_rows(spark, d).filter("origin < 3").groupBy("origin", (F.col("sequence") % 3).alias("peer")).agg(F.max(F.when(F.col("sequence") % 2 == 0, F.col("sequence"))).alias("acked"))
    shape = "origin long, floor long"
    return log.retention_floor(acks, spark.createDataFrame([(1, 17), (7, 5)], shape), spark.createDataFrame([(2, 8)], shape))


@query(f"WITH {LOG} SELECT origin, sequence FROM log WHERE NOT (sequence <= 40 AND origin IN (0, 1) AND sequence <= CASE origin WHEN 0 THEN 25 ELSE 10 END)")
def log_prune(spark, d):
    rows, shape = log_rows(spark, d), "origin long, {} long"
    covered, pins = spark.createDataFrame([(0, 25), (1, 99)], shape.format("upto")), spark.createDataFrame([(1, 10)], shape.format("floor"))
    return log.pruned(rows, rows.filter("sequence <= 40"), covered, pins).select("origin", "sequence")


@query(f"WITH {LOG} SELECT origin, sequence FROM log WHERE sequence > CASE origin WHEN 1 THEN 10 ELSE 0 END AND sequence <= CASE origin WHEN 1 THEN 10 ELSE 0 END + 32")
def in_flight(spark, d):
    return log.in_flight(log_rows(spark, d), spark.createDataFrame([(1, 10)], "origin long, acked long"), 4, 8).select("origin", "sequence")


@query(f"""WITH {LOG}, l AS (SELECT origin, max(sequence) AS last FROM log GROUP BY 1), n AS (SELECT s_suppkey % 5 AS origin, s_name AS payload, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS n FROM supplier)
    SELECT origin, (last + n)::BIGINT AS sequence, payload, sha256(concat_ws(':', origin, last + n, payload)) AS digest FROM n JOIN l USING (origin)""")
def log_append(spark, d):
    new = table(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("origin"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("payload"))
    return log.appended(log_rows(spark, d), new, "payload")


@query(f"""WITH {LOG} SELECT origin, sequence, ((origin + 2) % 5) AS seat, row_number() OVER (PARTITION BY origin ORDER BY sequence)::INTEGER AS turn FROM log WHERE sequence < 40""")
def round_robin_ranges(spark, d):
    return log.round_robin(log_rows(spark, d).filter("sequence < 40"), 2, 5, 8).select("origin", "sequence", "seat", "turn")


# ---- progress, peers, members


@query("SELECT user_id AS origin, max(event_id % 50) AS applied, max(event_id % 70) AS observed FROM events GROUP BY 1")
def progress_max(spark, d):
    return log.progress_max(table(spark, d, "events").select(F.col("user_id").alias("origin"), (F.col("event_id") % 50).alias("applied"), (F.col("event_id") % 70).alias("observed")))


@query("""SELECT o AS origin, a AS applied, greatest(a, b) AS observed, f AS retained_from, t AS retained_through FROM (SELECT k AS o, CASE WHEN k < 30 THEN k * 2 ELSE 0 END AS a, CASE WHEN k % 2 = 0 THEN k * 3 - 20 ELSE 0 END AS b,
    CASE WHEN k >= 10 THEN k ELSE 0 END AS f, CASE WHEN k >= 10 THEN k + 5 ELSE 0 END AS t FROM range(40) r(k))""")
def progress_assemble(spark, d):
    k = spark.range(40).withColumnRenamed("id", "origin")
    retained = k.filter("origin >= 10").select("origin", F.col("origin").alias("retained_from"), (F.col("origin") + 5).alias("retained_through"))
    return log.progress_assembled(retained, k.filter("origin < 30").select("origin", (F.col("origin") * 2).alias("applied")), k.filter("origin % 2 = 0").select("origin", (F.col("origin") * 3 - 20).alias("observed")))


@query("""SELECT k AS origin, CASE WHEN 2 * k <= m THEN 'none' WHEN k % 7 > m + 1 THEN 'snapshot' ELSE 'range' END AS action, CASE WHEN 2 * k > m AND k % 7 <= m + 1 THEN m + 1 END AS first,
    CASE WHEN 2 * k > m AND k % 7 <= m + 1 THEN 2 * k END AS last FROM (SELECT k, CASE WHEN k % 3 = 0 THEN k * 3 WHEN k % 3 = 1 THEN k ELSE 0 END AS m FROM range(60) r(k))""")
def missing_history(spark, d):
    k = spark.range(60).withColumnRenamed("id", "origin")
    peer = k.select("origin", (F.col("origin") * 2).alias("applied"), (F.col("origin") % 7).alias("retained_from"))
    return log.missing_history(peer, k.filter("origin % 3 < 2").select("origin", F.when(F.col("origin") % 3 == 0, F.col("origin") * 3).otherwise(F.col("origin")).alias("applied")))


@query("SELECT user_id AS origin, count(*) > 30 AND max(event_id % 60) >= 30 AS snapshot FROM events GROUP BY 1")
def lag_rule(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("origin")).agg(F.count(F.lit(1)).alias("behind"), F.max(F.col("event_id") % 60).alias("since"))
    return log.lagging(e, 30)


@query("""SELECT user_id AS peer, max(ts)::TIMESTAMP AS last_seen, CASE WHEN bool_or(event_id % 401 = 0) THEN 'retired' WHEN max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY THEN 'live' ELSE 'away' END AS status FROM events WHERE event_id % 13 <> user_id % 13 GROUP BY 1""")
def peer_status(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    seen = e.filter("event_id % 13 <> user_id % 13").select(F.col("user_id").alias("peer"), F.col("ts").alias("at"), (F.col("event_id") % 401 == 0).alias("retired"))
    return log.peers(seen, F.lit(now), 2)


_STATES = "['alive', 'suspect', 'dead', 'left']"


@query(f"""WITH m AS (SELECT 'n' || user_id AS node, max([event_id % 11, event_id % 4]) AS s FROM events GROUP BY 1)
    SELECT node, (s[1] + CASE WHEN node = 'n3' AND s[2] IN (1, 2) THEN 1 ELSE 0 END)::BIGINT AS incarnation, CASE WHEN node = 'n3' AND s[2] IN (1, 2) THEN 'alive' ELSE ({_STATES})[s[2] + 1] END AS state FROM m""")
def member_refute(spark, d):
    states = F.array(*[F.lit(x) for x in log.MEMBER])
    e = table(spark, d, "events").select(F.concat(F.lit("n"), "user_id").alias("node"), (F.col("event_id") % 11).alias("incarnation"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("state"))
    return log.members(e, "n3")


@query("""WITH r AS (SELECT event_id % 64 AS segment, avg(CASE WHEN live THEN 1.0 ELSE 0.0 END) AS ratio FROM (SELECT event_id, event_id = max(event_id) OVER (PARTITION BY user_id, event_type) AS live FROM events) GROUP BY 1)
    SELECT min(segment) AS segment FROM r WHERE ratio <= 0.1""")
def segment_choice(spark, d):
    e = table(spark, d, "events")
    best = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("best")).select("best")
    marked = e.join(best, F.col("event_id") == F.col("best"), "left").select((F.col("event_id") % 64).alias("segment"), F.col("best").isNotNull().alias("live"))
    return log.compactable(log.segment_ratios(marked, "live"), 0.1)


# ---- mergeable columns


@query(f"WITH {EDITS} SELECT key, min(value) AS low, max(value) AS high FROM live GROUP BY 1")
def extrema_fenced(spark, d):
    return policies.extrema(edits(spark, d), merge.floors(tombstones(spark, d)))


def _ops(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("actor"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 9).otherwise(-(F.col("event_id") % 9)).alias("delta"))


@query("""SELECT user_id AS key, event_id % 3 AS actor, (sum(CASE WHEN event_id % 2 = 0 THEN event_id % 9 ELSE 0 END) + CASE WHEN event_id % 3 = 1 THEN 100 ELSE 0 END)::BIGINT AS pos,
    (sum(CASE WHEN event_id % 2 = 1 THEN event_id % 9 ELSE 0 END) + CASE WHEN event_id % 3 = 1 THEN 7 ELSE 0 END)::BIGINT AS neg FROM events GROUP BY user_id, event_id % 3""")
def counter_add(spark, d):
    ops = _ops(spark, d)
    have = ops.filter("actor = 1").select("key", "actor").distinct().select("key", "actor", F.lit(100).cast("long").alias("pos"), F.lit(7).cast("long").alias("neg"))
    return policies.counter_add(have, ops)


@query("""SELECT c_custkey AS key, (coalesce(x, 0) + CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END)::BIGINT AS value FROM customer LEFT JOIN
    (SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN event_id % 9 ELSE -(event_id % 9) END) AS x FROM events GROUP BY 1) ON user_id = c_custkey WHERE c_custkey % 2 = 0 OR x IS NOT NULL""")
def counter_projection(spark, d):
    none = spark.createDataFrame([], "key long, actor long, pos long, neg long")
    base = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("baseline"))
    return policies.projected_counter(policies.counter_add(none, _ops(spark, d)), base)


@query("""SELECT n_regionkey AS key, list_sort(list_filter(list_distinct(list_concat(list(n_name), ['x', 'NATION_0'])), lambda v: v NOT IN ('NATION_1', 'NATION_2'))) AS names FROM nation GROUP BY 1""")
def set_projection(spark, d):
    sets = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.collect_list("n_name").alias("v"))
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    return sets.select("key", policies.set_projection(F.col("v"), lit("x", "NATION_0"), lit("NATION_1", "NATION_2")).alias("names"))


@query("""SELECT DISTINCT a.user_id AS key, a.event_type AS value FROM events a WHERE a.event_type <> 'error' AND NOT EXISTS
    (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.event_id % 4 = 0 AND r.user_id = a.user_id AND a.event_type = 'click' AND a.event_id <= r.event_id)""")
def set_remove(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("tag"), F.col("event_id").alias("at"))
    adds = e.filter("value <> 'error'")
    last = e.filter("value = 'error' AND tag % 4 = 0").groupBy("key").agg(F.max("at").alias("seen")).withColumn("value", F.lit("click"))
    return policies.observed_set(adds, policies.set_remove(adds, last))


@query("""WITH i AS (SELECT event_id % 200 AS t, count(*) AS n, sum((event_id % 83 = 0)::INT) AS nulls, sum((event_id % 83 <> 0 AND user_id % 150 >= 140)::INT) AS gone FROM events GROUP BY 1)
    SELECT t AS "transaction", CASE WHEN n > 60 THEN 'limit: too many intents' WHEN nulls > 0 THEN 'a null key' ELSE 'no such row' END AS fault FROM i WHERE n > 60 OR nulls > 0 OR gone > 0""")
def intent_guards(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 200).alias("transaction"), F.when(F.col("event_id") % 83 != 0, F.col("user_id") % 150).alias("key"))
    return policies.refused_intents(e, spark.range(140).withColumnRenamed("id", "key"), 60)


@query("""SELECT event_type AS "column", user_id AS key, event_id % 3 AS actor, sum(CASE WHEN event_id % 2 = 0 THEN event_id % 9 ELSE 0 END)::BIGINT AS pos, sum(CASE WHEN event_id % 2 = 1 THEN event_id % 9 ELSE 0 END)::BIGINT AS neg FROM events GROUP BY 1, 2, 3""")
def intent_states(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("column"), F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("actor"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 9).otherwise(-(F.col("event_id") % 9)).alias("delta"))
    return policies.materialised(e, ("column", "key"))


@query("SELECT n_regionkey AS key, v AS value, 0 AS node, (row_number() OVER (PARTITION BY n_regionkey ORDER BY v) - 1)::INTEGER AS place FROM (SELECT DISTINCT n_regionkey, n_name AS v FROM nation)")
def seed_tags(spark, d):
    return policies.seed_tags(table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.collect_list("n_name").alias("values")))


def _states(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 5).alias("basis"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 5).alias("baseline"))


@query("SELECT o_custkey AS key, max(o_orderkey % 5) AS basis, max(o_custkey * 10 + o_orderkey % 5) AS baseline FROM orders GROUP BY 1")
def causal_baseline(spark, d):
    return policies.joined_states(_states(spark, d))


@query("""WITH t AS (SELECT o_custkey AS key, o_orderkey % 5 AS basis, (o_orderkey % 2)::INTEGER AS node, o_orderkey AS tag FROM orders)
    SELECT key, tag FROM t WHERE node <> 0 OR basis = (SELECT max(basis) FROM t x WHERE x.key = t.key)""")
def causal_tags(spark, d):
    tags = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 5).alias("basis"), (F.col("o_orderkey") % 2).cast("int").alias("node"), F.col("o_orderkey").alias("tag"))
    return policies.kept_tags(tags, policies.joined_states(_states(spark, d))).select("key", "tag")


@query(f"""WITH {EDITS}, w AS (SELECT key, max(generation) AS g FROM live GROUP BY 1)
    SELECT l.key, w.g AS generation, (sum(l.logical % 9) + 1000 + w.g)::BIGINT AS value FROM live l JOIN w USING (key) GROUP BY l.key, w.g""")
def policy_rebase(spark, d):
    e = edits(spark, d)
    ops = e.select("key", "generation", F.col("node").alias("actor"), (F.col("logical") % 9).alias("delta"))
    base = e.select("key", "generation").distinct().withColumn("baseline", F.col("generation") + 1000)
    return policies.rebased(ops, merge.floors(tombstones(spark, d)), base)


@query("""SELECT "table", "column", policy FROM (VALUES ('t', 'n', 'counter'), ('t', 's', 'set')) v("table", "column", policy)""")
def policy_configure(spark, d):
    columns = spark.createDataFrame([("t", "id", True), ("t", "n", False), ("t", "s", False)], "table string, column string, key boolean")
    return policies.configured(columns, spark.createDataFrame([("t", "n", "counter"), ("t", "s", "set")], "table string, column string, policy string"))


@query("SELECT c_custkey AS key, (c_acctbal * 100)::DECIMAL(38,0)::BIGINT AS cents, ((c_acctbal * 100)::DECIMAL(38,0) + c_custkey)::BIGINT AS total FROM customer")
def counter_checked(spark, d):
    c = table(spark, d, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    return c.select(F.col("c_custkey").alias("key"), "cents", policies.checked_add(F.col("cents"), F.col("c_custkey")).alias("total"))


# ---- ownership


def _sides(spark, d):
    c = table(spark, d, "customer").filter("c_custkey < 700")
    cell = lambda column, value: F.struct(F.lit(column).alias("column"), value.cast("double").alias("value"))
    low = c.select(F.col("c_custkey").alias("key"), F.explode(F.array(cell("a", F.col("c_acctbal")), cell("b", F.col("c_nationkey")))).alias("x")).select("key", "x.*")
    high = low.select("key", "column", (-F.col("value")).alias("value"))
    k = F.col("key") % 7
    own = low.select("key").distinct()
    owners = own.filter(k == 0).select("key", F.lit(policies.ROW).alias("column")).unionByName(own.filter(k == 1).select("key", F.lit("a").alias("column")))
    owners = owners.withColumns({"owned": F.lit(True), "epoch": F.lit(1).cast("long")})
    return high, low, owners, own.filter("key % 5 = 0")


_CELLS = "c AS (SELECT c_custkey AS key, unnest(['a', 'b']) AS col, unnest([c_acctbal, c_nationkey::DOUBLE]) AS v FROM customer WHERE c_custkey < 700)"


@query(f"""WITH {_CELLS} SELECT key, col AS "column", CASE WHEN high THEN -v ELSE v END AS value, CASE WHEN high THEN 'high' ELSE 'low' END AS side
    FROM (SELECT *, key % 7 = 0 OR (key % 7 = 1 AND col = 'a') AS high, key % 7 NOT IN (0, 1) AND key % 5 = 0 AS gone FROM c) WHERE NOT (NOT high AND gone)""")
def overlay_rows(spark, d):
    return policies.overlaid(*_sides(spark, d))


@query(f"""WITH {_CELLS} SELECT key, col AS "column", CASE WHEN high THEN -v ELSE v END AS value
    FROM (SELECT *, (key % 7 = 0 AND key % 2 = 0) OR (key % 7 = 1 AND col = 'a' AND key % 3 <> 0) AS high, NOT (key % 7 = 0 AND key % 2 = 0) AND NOT (key % 7 = 1 AND key % 3 <> 0) AND key % 5 = 0 AS gone FROM c) WHERE high OR NOT gone""")
def overlay_release(spark, d):
    high, low, owners, deleted = _sides(spark, d)
    keys = owners.select("key").distinct()
    given_up = keys.filter("key % 7 = 0 AND key % 2 = 1").select("key", F.lit(None).cast("string").alias("column")).unionByName(keys.filter("key % 7 = 1 AND key % 3 = 0").select("key", F.lit("a").alias("column")))
    return policies.overlaid(high, low, policies.release(owners, given_up, F.lit(2).cast("long")), deleted).select("key", "column", "value")


@query(f"""WITH {EDITS}, s AS (SELECT node AS domain, key, col, value, logical AS version, generation, max(generation) OVER (PARTITION BY node, key) AS g FROM edits)
    SELECT domain, key, col AS "column", arg_max(value, version) AS value, max(version) AS version, max(generation) AS generation FROM s WHERE generation = g GROUP BY 1, 2, 3""")
def shadow_join(spark, d):
    e = edits(spark, d).select(F.col("node").alias("domain"), "key", "column", "value", F.col("logical").alias("version"), "generation")
    return policies.shadows(e)


@query("""SELECT user_id AS key, event_type AS "column", TRUE AS owned, 9::BIGINT AS epoch FROM events WHERE event_id % 50 = 7 AND event_type <> 'error' UNION SELECT user_id, '__row__', TRUE, 9 FROM events WHERE event_id % 50 = 7 AND event_type = 'error'""")
def owner_promote(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("column"), (F.col("event_id") % 50).alias("version"))
    return policies.promoted(e.filter("column <> 'error'"), e.filter("column = 'error'"), F.lit(7), F.lit(9).cast("long"))


@query("""WITH c AS (SELECT user_id AS key, event_type AS col, event_id, 'd' || (event_id % 3) AS domain FROM events)
    SELECT key, col AS "column", CASE WHEN col = 'view' AND key % 2 = 0 THEN 'here' ELSE arg_max(domain, event_id) END AS domain FROM c GROUP BY key, col""")
def owner_branch(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("column"), F.col("event_id").alias("version"), F.concat(F.lit("d"), F.col("event_id") % 3).alias("domain"), F.lit(0).alias("generation"))
    owners = e.filter("column = 'view'").select("key", "column", (F.col("key") % 2 == 0).alias("owned")).distinct()
    return policies.branches(owners, e, "here")


@query("SELECT user_id AS stream, event_id AS sequence FROM events WHERE event_id % 3 <> 0")
def bundle_import(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("sequence"), F.col("props").alias("digest"))
    return policies.imported(e, e.filter("sequence % 3 = 0")).select("stream", "sequence")


# ---- files and bridges


def _files(spark, d):
    return events(spark, d).select(F.concat(F.lit("f"), F.col("event_id") % 40).alias("name"), F.concat(F.lit("c"), F.col("event_id") % 90).alias("digest"), F.col("event_id").alias("millis"), F.lit(0).alias("node"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("bytes"), F.lit(0).alias("generation"))


_F = "f AS (SELECT 'f' || (event_id % 40) AS name, arg_max('c' || (event_id % 90), event_id) AS digest, max(event_id) AS bytes, arg_max(event_type = 'error', event_id) AS deleted FROM events GROUP BY 1)"


@query(f"WITH {_F} SELECT name, digest, bytes FROM f WHERE NOT deleted ORDER BY name")
def file_list(spark, d):
    return files.listed(_files(spark, d)).select("name", "digest", "bytes")


@query(f"WITH {_F} SELECT name FROM f WHERE name LIKE '%3%' AND NOT deleted")
def file_search(spark, d):
    return files.search(files.listed(_files(spark, d)), "3").select("name")


@query(f"WITH {_F} SELECT name, CASE WHEN substr(digest, 2)::BIGINT % 3 = 0 THEN 'missing' WHEN substr(digest, 2)::BIGINT % 3 = 1 THEN 'bad' ELSE 'good' END AS state FROM f WHERE NOT deleted")
def file_verify(spark, d):
    have = files.metadata(_files(spark, d)).withColumn("k", F.substring("digest", 2, 9).cast("int") % 3)
    stored = have.filter("k <> 0").select("name", F.when(F.col("k") == 1, F.lit("spoilt")).otherwise(F.col("digest")).alias("digest"))
    return files.checked(stored, _files(spark, d))


@query("""WITH p AS (SELECT user_id AS peer, max(ts) AS seen FROM events WHERE event_id % 13 <> user_id % 13 GROUP BY 1), n AS (SELECT DISTINCT s_suppkey, 'f' || s_suppkey AS name FROM supplier),
    o AS (SELECT s_suppkey, list_sort(list(DISTINCT peer)) AS ps FROM n JOIN p ON peer % 9 = s_suppkey % 11 WHERE seen >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1)
    SELECT name, CASE WHEN s_suppkey % 3 = 0 THEN 'local' WHEN ps IS NOT NULL THEN 'remote' ELSE 'unavailable' END AS state, CASE WHEN s_suppkey % 3 <> 0 THEN len(ps) END::INTEGER AS peers FROM n LEFT JOIN o USING (s_suppkey)""")
def file_offers(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    peers = e.filter("event_id % 13 <> user_id % 13").groupBy(F.col("user_id").alias("peer")).agg(F.max("ts").alias("last_seen"))
    names = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("f"), "s_suppkey").alias("name"))
    offers = names.join(peers.select("peer"), F.col("peer") % 9 == F.col("s_suppkey") % 11).select("name", "peer")
    got = files.availability(names, names.filter("s_suppkey % 3 = 0"), offers, peers, F.lit(now))
    return got.select("name", "state", F.when(F.col("peers").isNotNull(), F.size("peers")).alias("peers"))


@query(f"WITH {_F} SELECT DISTINCT 'c' || (event_id % 120) AS digest FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 1 DAY AND 'c' || (event_id % 120) NOT IN (SELECT digest FROM f WHERE NOT deleted)")
def file_gc(spark, d):
    stored = table(spark, d, "events").select(F.concat(F.lit("c"), F.col("event_id") % 120).alias("digest"), F.col("ts").alias("modified"))
    return files.collectable(stored, files.metadata(_files(spark, d)), F.lit("2024-01-20").cast("timestamp_ntz"))


_SHA = "sha256(concat_ws(':', origin, sequence, 'p' || sequence))"


@query(f"WITH {LOG} SELECT 'out' AS stream, origin, sequence, 'p' || sequence AS payload, {_SHA} AS digest FROM log WHERE sequence > CASE origin WHEN 0 THEN 50 ELSE 0 END AND sequence < 120")
def bridge_export(spark, d):
    rows = log_rows(spark, d).filter("sequence < 120").withColumn("payload", F.concat(F.lit("p"), "sequence"))
    return files.bundled(rows, spark.createDataFrame([(0, 50)], "origin long, exported long"), "out")


@query(f"""WITH {LOG} SELECT origin, sequence, CASE WHEN sequence % 83 = 0 THEN 'quarantined' WHEN sequence % 59 = 0 AND origin = 1 THEN 'held' WHEN sequence < CASE WHEN origin = 1 THEN 59 ELSE 83 END THEN 'ready' ELSE 'waiting' END AS state FROM log WHERE sequence < 120""")
def bridge_inbox(spark, d):
    rows = log_rows(spark, d).filter("sequence < 120").withColumn("payload", F.concat(F.lit("p"), "sequence"))
    sent = files.bundled(rows, spark.createDataFrame([], "origin long, exported long"), "in")
    sent = sent.withColumn("digest", F.when(F.col("sequence") % 83 == 0, F.lit("x")).otherwise(F.col("digest"))).withColumn("error", F.when((F.col("sequence") % 59 == 0) & (F.col("origin") == 1), F.lit("failed")))
    return files.inbox(sent, spark.createDataFrame([], "origin long, applied long")).select("origin", "sequence", "state")
