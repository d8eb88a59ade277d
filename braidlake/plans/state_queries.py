"""Queries over captured changes, keyed rows, schemas, key-value logs and stored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidlake.operators import chunks, kv, merge, schema, state
from braidlake.plans.fixtures import EDITS, edits, table, tombstones
from braidlake.plans.registry import query
from braidlake.sources import store

_o = "o_orderkey"


def _orders(spark, d):
    return table(spark, d, "orders").select(_o, "o_orderstatus", "o_totalprice")


def _halves(spark, d):
    """Orders before and after a change: a tenth comes in, a tenth goes, a tenth changes."""
    o, k = _orders(spark, d), F.col(_o) % 10
    return o.filter(k != 1), o.filter(k != 2).withColumn("o_totalprice", F.when(k == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


# ---- reads


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
def table_scan(spark, d):
    return state.table_scan(table(spark, d, "customer"), ["c_custkey"], ["c_custkey", "c_name"])


@query("""SELECT 'nation' AS "table", n_nationkey::VARCHAR AS key, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS row FROM nation
    UNION ALL SELECT 'region', r_regionkey::VARCHAR, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' FROM region""")
def all_tables(spark, d):
    rows = {"region": (table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"]), "nation": (table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])}
    return state.all_tables(rows).withColumn("key", F.element_at("key", 1))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def point_read(spark, d):
    return kv.point_read(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 7)


@query("SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name")
def prefix_scan(spark, d):
    return kv.prefix_scan(table(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "Customer#00000001")


@query("SELECT c_name FROM customer WHERE c_name > 'Customer#000000015' AND starts_with(c_name, 'Customer#00000') ORDER BY c_name LIMIT 20")
def prefix_page(spark, d):
    return kv.keyset_page(table(spark, d, "customer").select("c_name"), "c_name", "Customer#000000015", 20, "Customer#00000")


@query("SELECT pos, asked, c_name AS value FROM (VALUES (0::BIGINT, 3::BIGINT), (1, 5), (2, 99999999), (3, 8)) v(pos, asked) LEFT JOIN customer ON c_custkey = asked WHERE pos <= 2")
def multi_get_bounded(spark, d):
    return kv.multi_get_bounded(table(spark, d, "customer"), [3, 5, 99999999, 8], "c_custkey", "c_name", 40)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def sql_bound(spark, d):
    return store.sql(spark, "SELECT o_orderkey, o_totalprice FROM bound_orders WHERE o_totalprice > ? AND o_orderstatus = ?", [100000, "F"], {"bound_orders": _orders(spark, d)})


# ---- changes


@query("""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN o_orderkey % 10 <> 1 THEN o_totalprice END AS old, CASE o_orderkey % 10 WHEN 1 THEN o_totalprice WHEN 3 THEN o_totalprice + 1 END AS new
    FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)""")
def changeset(spark, d):
    got = state.capture(*_halves(spark, d), [_o], ["o_orderstatus", "o_totalprice"])
    return got.select(_o, "op", F.col("old.o_totalprice").alias("old"), F.col("new.o_totalprice").alias("new"))


@query("""SELECT DISTINCT 't' || (event_id % 4) AS "table" FROM events WHERE event_type = 'purchase'""")
def affected_tables(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    return state.affected_tables(e.select(F.concat(F.lit("t"), F.col("event_id") % 4).alias("table"), "event_id"))


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN event_type <> 'signup' THEN event_type END AS old, CASE WHEN event_id % 5 <> 0 THEN event_type END AS new FROM events),
    n AS (SELECT user_id, (list(old ORDER BY event_id))[1] AS old, (list(new ORDER BY event_id))[-1] AS new FROM c GROUP BY 1)
    SELECT user_id, CASE WHEN old IS NULL THEN 'insert' WHEN new IS NULL THEN 'delete' ELSE 'update' END AS op FROM n WHERE old IS DISTINCT FROM new""")
def session_coalesce(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "signup", F.struct("event_type")).alias("old"), F.when(F.col("event_id") % 5 != 0, F.struct("event_type")).alias("new"))
    return state.coalesced(e, ["user_id"], ["event_id"]).select("user_id", "op")


def _changed_cells(spark, d):
    before, after = _halves(spark, d)
    cells = before.select(F.col(_o).alias("key"), F.explode(F.array(F.struct(F.lit("p").alias("column"), F.col("o_totalprice").alias("value")))).alias("c"), F.lit(3).cast("long").alias("generation"), (F.col(_o) % 7).cast("long").alias("version")).select("key", "c.*", "generation", "version")
    named = lambda x: x.select(F.col(_o).alias("key"), F.col("o_totalprice").alias("p"))
    return state.apply_changes(cells, state.capture(named(before), named(after), ["key"], ["p"]), F.lit(99).cast("long"), ["p"])


@query("""SELECT o_orderkey AS key, CASE o_orderkey % 10 WHEN 3 THEN o_totalprice + 1 ELSE o_totalprice END AS value, CASE o_orderkey % 10 WHEN 1 THEN 0 ELSE 3 END::BIGINT AS generation,
    CASE WHEN o_orderkey % 10 IN (1, 3) THEN 99 ELSE o_orderkey % 7 END::BIGINT AS version FROM orders WHERE o_orderkey % 10 <> 2""")
def cdc_apply(spark, d):
    return _changed_cells(spark, d)[0].select("key", "value", "generation", "version")


@query("SELECT o_orderkey AS key, 3::BIGINT AS generation, 99::BIGINT AS version FROM orders WHERE o_orderkey % 10 = 2")
def cdc_tombstones(spark, d):
    return _changed_cells(spark, d)[1]


@query(f"""WITH {EDITS}, w AS (SELECT key, max(generation) AS g FROM live GROUP BY 1), b AS (SELECT l.key, g, col, value, row_number() OVER (PARTITION BY l.key, col ORDER BY millis DESC, logical DESC) AS n
    FROM live l JOIN w ON w.key = l.key AND w.g = l.generation)
    SELECT key, max(g) AS generation, max(CASE WHEN col = 'click' AND n = 1 THEN value END) AS click, max(CASE WHEN col = 'view' AND n = 1 THEN value END) AS view FROM b GROUP BY 1""")
def rebuild_rows(spark, d):
    live = merge.live_cells(edits(spark, d), tombstones(spark, d)).withColumn("version", F.struct("millis", "logical"))
    return state.rebuilt(live, ["click", "view"])


@query(f"WITH {EDITS} SELECT key, generation, max(millis) AS millis FROM edits WHERE col = 'error' AND logical % 50 = 0 GROUP BY 1, 2")
def tombstone_dedup(spark, d):
    return merge.deduplicated_tombstones(tombstones(spark, d)).select("key", "generation", "millis")


@query("SELECT c_custkey, c_acctbal, (c_custkey * 3)::BIGINT AS version FROM customer")
def export_versions(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return state.export_state(c, c.select("c_custkey", (F.col("c_custkey") * 3).cast("long").alias("version")), "c_custkey")


@query("""SELECT n_nationkey AS row, CASE n_nationkey % 5 WHEN 1 THEN 'a column twice' WHEN 2 THEN 'a column missing' WHEN 3 THEN 'an unknown column' ELSE 'key and cells differ' END AS fault
    FROM nation WHERE n_nationkey % 5 <> 0""")
def row_shape(spark, d):
    k = F.col("n_nationkey") % 5
    cell = lambda name, value: F.struct(F.lit(name).alias("column"), value.cast("string").alias("value"))
    key, name = cell("k", F.col("n_nationkey")), cell("n", F.col("n_name"))
    cells = F.when(k == 1, F.array(key, name, name)).when(k == 2, F.array(key)).when(k == 3, F.array(key, name, cell("z", F.col("n_name")))).when(k == 4, F.array(cell("k", F.lit("x")), name)).otherwise(F.array(key, name))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("row"), F.array(F.col("n_nationkey").cast("string")).alias("key"), cells.alias("cells"))
    return state.row_faults(rows, ["k"], ["k", "n"])


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 10 = 3) AS touches, FALSE AS other")
def changes_overlap(spark, d):
    before, after = _halves(spark, d)
    changes = state.capture(before, after, [_o], ["o_totalprice"])
    rows = [(state.overlaps(changes, after.filter(f"{_o} % 10 = 3"), [_o]), state.overlaps(changes, after.filter(f"{_o} % 10 = 4"), [_o]))]
    return spark.createDataFrame(rows, "touches boolean, other boolean")


@query("""WITH k AS (SELECT o_orderkey AS key, length(o_orderpriority)::BIGINT * CASE WHEN o_orderkey % 10 IN (1, 2) THEN 1 ELSE 2 END AS b FROM orders),
    r AS (SELECT key, key % 8 AS slot, row_number() OVER w - 1 AS n, coalesce(sum(b) OVER (PARTITION BY key % 8 ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM k WINDOW w AS (PARTITION BY key % 8 ORDER BY key))
    SELECT key, slot, (s // 4000 + n // 100)::BIGINT AS chunk FROM r""")
def migrate_chunk(spark, d):
    o = table(spark, d, "orders").select(F.col(_o).alias("k"), F.length("o_orderpriority").alias("size"))
    return state.aligned_chunks(o.filter("k % 10 <> 1"), o.filter("k % 10 <> 2"), "k", "size", 100, 4000, 8)


# ---- rows by key


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def dml_insert(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return state.insert(n, table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")), ["n_nationkey"])


@query("""SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN c_custkey IS NULL THEN s_acctbal WHEN s_suppkey IS NULL THEN c_acctbal ELSE c_acctbal + s_acctbal END AS v
    FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) FULL JOIN supplier ON c_custkey = s_suppkey""")
def dml_upsert(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return state.upsert(c, s, ["k"], {"v": F.col("v") + F.col("excluded_v")})


@query("SELECT coalesce(s_suppkey, c_custkey) AS k, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS v FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def dml_replace(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return state.replace(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@query("SELECT n_nationkey, nullif(n_regionkey, 0) AS k FROM nation WHERE n_regionkey NOT IN (0, 3)")
def dml_delete(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.expr("nullif(n_regionkey, 0)").alias("k"))
    return state.delete(n, spark.createDataFrame([(None,), (3,)], "k int"), ["k"])


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return state.update(s, F.col("s_acctbal") < 1000, {"s_acctbal": F.lit(0.0)}, ["s_suppkey"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'first' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 2")
def dml_transaction(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    steps = [lambda t: state.update(t, F.col("n_nationkey") == 1, {"n_name": F.lit("first")}, ["n_nationkey"]), lambda t: t.filter("n_nationkey <> 2")]
    return state.transaction(n, steps, F.col("n_name").isNotNull())


# ---- schemas


def _catalogue(spark, rows):
    return spark.createDataFrame(rows, schema.CATALOGUE)


_LOCAL = [("a", "id", "INTEGER", 1, True, None), ("a", "n", "INTEGER", 0, False, "counter"), ("a", "t", "TEXT", 0, False, None), ("b", "id", "TEXT", 1, True, None), ("old", "id", "TEXT", 1, True, None)]
_REMOTE = [("a", "id", "INTEGER", 1, True, None), ("a", "n", "INTEGER", 0, False, "set"), ("a", "t", "text", 0, False, None), ("a", "more", "REAL", 0, False, None), ("a", "must", "REAL", 0, True, None), ("b", "id", "TEXT", 1, True, None), ("c", "id", "TEXT", 1, True, None)]


@query("""SELECT * FROM (VALUES ('a', 'id', 'same'), ('a', 'n', 'conflict'), ('a', 't', 'same'), ('a', 'more', 'add_column'), ('a', 'must', 'conflict'), ('b', 'id', 'same'),
    ('c', 'id', 'add_table'), ('old', 'id', 'local_only')) v("table", "column", action)""")
def schema_adopt(spark, d):
    return schema.adopted(_catalogue(spark, _LOCAL), _catalogue(spark, _REMOTE))


@query("""SELECT * FROM (VALUES ('a', 'id', 'INTEGER', NULL::VARCHAR), ('a', 't', 'text', NULL), ('b', 'id', 'TEXT', NULL)) v("table", "column", type, policy)""")
def map_columns(spark, d):
    return schema.mapped(_catalogue(spark, _LOCAL), _catalogue(spark, _REMOTE))


_ID = "substr(sha256({}), 1, 32)"
_PART = "octet_length(encode({0}))::VARCHAR || ':' || {0}"


@query(f"""WITH n(t, c) AS (VALUES ('person', 'id'), ('person', 'full_name'), ('person', 'age'), ('fresh', 'id')),
    ids AS (SELECT t, c, CASE t WHEN 'person' THEN 'T1' ELSE {_ID.format(_PART.format("'table'") + " || " + _PART.format("t"))} END AS table_id FROM n)
    SELECT t AS "table", c AS "column", table_id, CASE WHEN t = 'person' AND c = 'id' THEN 'C1' WHEN c = 'full_name' THEN 'C2' ELSE {_ID.format(_PART.format("table_id") + " || " + _PART.format("c"))} END AS column_id FROM ids""")
def schema_identity(spark, d):
    new = spark.createDataFrame([("person", "id"), ("person", "full_name"), ("person", "age"), ("fresh", "id")], "table string, column string")
    previous = spark.createDataFrame([("people", "id", "T1", "C1"), ("people", "name", "T1", "C2")], "table string, column string, table_id string, column_id string")
    mappings = spark.createDataFrame([("person", None, "people", None), ("person", "full_name", "people", "name")], "table string, column string, old_table string, old_column string")
    return schema.identities(new, previous, mappings)


@query("""SELECT * FROM (VALUES ('bare', 'no key'), ('gap', 'a gap in the key'), ('loose', 'a key column may be null'), ('odd name', 'a name that is not plain'), ('ruled', 'a policy on a key column')) v("table", fault)""")
def schema_faults(spark, d):
    rows = [("bare", "x", "TEXT", 0, False, None), ("gap", "x", "TEXT", 1, True, None), ("gap", "y", "TEXT", 3, True, None), ("loose", "x", "TEXT", 1, False, None), ("lone", "x", "INTEGER", 1, False, None)]
    return schema.faults(_catalogue(spark, [*rows, ("odd name", "x", "TEXT", 1, True, None), ("ruled", "x", "TEXT", 1, True, "max")]))


@query("SELECT 'd' || n_nationkey AS \"database\", CASE WHEN n_nationkey >= 20 THEN 'record' WHEN n_nationkey % 3 = 0 THEN 'current' WHEN n_regionkey > 2 THEN 'adopt' ELSE 'stale' END AS verdict FROM nation")
def schema_accept(spark, d):
    n = table(spark, d, "nation").withColumn("database", F.concat(F.lit("d"), "n_nationkey"))
    sent = n.select("database", F.col("n_regionkey").cast("long").alias("epoch"), (F.col("n_nationkey") % 3).cast("string").alias("history"))
    return schema.accepted(sent, n.filter("n_nationkey < 20").select("database", F.lit(2).cast("long").alias("epoch"), F.lit("0").alias("history")))


def _tabled(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("t"), F.col("event_id") % 6).alias("table"), (F.col("user_id") % 3).alias("sender"), "event_id")


@query("""SELECT 't' || (event_id % 6) AS "table", user_id % 3 AS sender, event_id FROM events WHERE event_id % 6 NOT IN (1, 4)""")
def table_filter(spark, d):
    settings = spark.createDataFrame([("t1", False), ("t4", False), ("t5", True)], "table string, enabled boolean")
    return schema.replicated(_tabled(spark, d), settings)


@query("""SELECT 't' || (event_id % 6) AS "table", user_id % 3 AS sender, event_id FROM events WHERE NOT (event_id % 6 IN (2, 3) AND user_id % 3 = 1)""")
def retired_tables(spark, d):
    declared = spark.createDataFrame([(1, "t2"), (1, "t3"), (1, "t0"), (2, "t0")], "sender long, table string")
    local = spark.createDataFrame([(f"t{k}",) for k in (0, 1, 4, 5)], "table string")
    return schema.without_retired(_tabled(spark, d), schema.retired(declared, local))


@query("SELECT s_suppkey AS id, NULL::VARCHAR AS note, s_acctbal::DOUBLE AS balance FROM supplier")
def nullfill(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return schema.null_filled(s, [("id", "bigint", True), ("note", "string", False), ("balance", "double", False)])


# ---- key-value logs


def _records(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("sequence"), (F.col("event_type") == "error").alias("deleted"), (F.col("event_id") % 32).alias("segment"))


_R = "r AS (SELECT user_id AS key, value, event_id AS sequence, event_type = 'error' AS deleted, event_id % 32 AS segment, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)"


@query(f"WITH {_R} SELECT key, value, sequence FROM r WHERE n = 1 AND NOT deleted")
def kv_load(spark, d):
    return kv.load(_records(spark, d))


@query("""WITH b AS (SELECT user_id AS key, value, event_id AS sequence, event_type = 'error' AS deleted FROM events UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, c_custkey + 1000000000, c_custkey % 2 = 1 FROM customer WHERE c_custkey < 50)
    SELECT key, arg_max(value, sequence) AS value, max(sequence) AS sequence FROM b GROUP BY 1 HAVING NOT arg_max(deleted, sequence)""")
def kv_write(spark, d):
    batch = table(spark, d, "customer").filter("c_custkey < 50").select(F.col("c_custkey").alias("place"), F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("value"), (F.col("c_custkey") % 2 == 1).alias("deleted"))
    return kv.load(kv.written(_records(spark, d), batch, 1000000000))


@query(f"WITH {_R} SELECT key, value, sequence, deleted FROM r WHERE n = 1")
def kv_compact(spark, d):
    return kv.compacted(_records(spark, d))


@query(f"WITH {_R} SELECT segment, key, sequence FROM r WHERE NOT deleted OR sequence > (SELECT min(sequence) FROM r x WHERE x.key = r.key)")
def tombstone_drop(spark, d):
    return kv.dropped_tombstones(_records(spark, d).select("segment", "key", "sequence", "deleted")).select("segment", "key", "sequence")


@query(f"WITH {_R} SELECT segment FROM r GROUP BY 1 HAVING max(CASE WHEN n = 1 THEN 1 ELSE 0 END) = 0 UNION ALL SELECT 32::BIGINT")
def dead_files(spark, d):
    r = _records(spark, d)
    return kv.dead_files(r.select("segment").unionByName(spark.createDataFrame([(32,)], "segment long")), r)


@query("""WITH e AS (SELECT event_id AS sequence, CASE WHEN event_type = 'signup' THEN 'schema' WHEN event_id % 1000 = 7 THEN 'snapshot' ELSE 'delta' END AS kind FROM events)
    SELECT sequence, kind FROM e WHERE sequence = (SELECT max(sequence) FROM e WHERE kind = 'schema') OR (kind <> 'schema' AND sequence >= (SELECT coalesce(max(sequence), 0) FROM e WHERE kind = 'snapshot'))""")
def snapshot_head(spark, d):
    kind = F.when(F.col("event_type") == "signup", "schema").when(F.col("event_id") % 1000 == 7, "snapshot").otherwise("delta")
    return kv.snapshot_head(table(spark, d, "events").select(F.col("event_id").alias("sequence"), kind.alias("kind")))


# ---- pieces, pages, digests


@query("""SELECT doc_id AS key, p AS place, ((octet_length(encode(text)) + 499) // 500)::INTEGER AS pieces, octet_length(encode(text))::INTEGER AS length, sha256(text) AS digest
    FROM (SELECT doc_id, text, unnest(range(greatest(1, (octet_length(encode(text)) + 499) // 500)))::INTEGER AS p FROM documents WHERE text <> '')""")
def chunk_write(spark, d):
    r = table(spark, d, "documents").filter("text <> ''").select(F.col("doc_id").alias("key"), F.encode("text", "UTF-8").alias("payload"))
    return chunks.pieces(r, 500).select("key", "place", "pieces", "length", "digest")


@query("SELECT doc_id AS key, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def chunk_digest(spark, d):
    r = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.encode("text", "UTF-8").alias("payload"))
    return chunks.assembled(chunks.pieces(r, 700)).select("key", F.sha2("payload", 256).alias("digest"))


@query("SELECT 'f' || k AS name, c AS chunk, CASE WHEN c % 3 = 0 THEN 'missing' WHEN c % 5 = 1 THEN 'bad' ELSE 'good' END AS state FROM range(4) a(k), range(10) b(c)")
def chunk_verify(spark, d):
    all_ = spark.range(40).select(F.concat(F.lit("f"), F.floor(F.col("id") / 10)).alias("name"), (F.col("id") % 10).alias("chunk"))
    sent = all_.withColumn("body", F.encode(F.concat("name", F.lit("/"), "chunk"), "UTF-8"))
    got = sent.filter("chunk % 3 <> 0").withColumn("body", F.when(F.col("chunk") % 5 == 1, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("body")))
    return chunks.verified(got, chunks.manifest(sent))


def _having(spark, d):
    e = table(spark, d, "events").filter("event_id % 7 = 0")
    return e.select(F.concat(F.lit("f"), F.col("event_id") % 20).alias("name"), (F.floor(F.col("event_id") / 20) % 60).alias("chunk"), F.concat(F.lit("p"), F.col("user_id") % 4).alias("holder"))


_MISSING = "m AS (SELECT 'f' || k AS name, c AS chunk, row_number() OVER (PARTITION BY k ORDER BY c) - 1 AS i FROM range(20) a(k), range(60) b(c) WHERE c % 4 = 1)"


@query(f"""WITH {_MISSING}, h AS (SELECT 'f' || (event_id % 20) AS name, event_id // 20 % 60 AS chunk, list_sort(list(DISTINCT 'p' || (user_id % 4))) AS hs FROM events WHERE event_id % 7 = 0 GROUP BY 1, 2)
    SELECT m.name, m.chunk, hs[i % len(hs) + 1] AS holder FROM m LEFT JOIN h USING (name, chunk)""")
def chunk_holders(spark, d):
    missing = spark.range(1200).select(F.concat(F.lit("f"), F.col("id") % 20).alias("name"), F.floor(F.col("id") / 20).alias("chunk")).filter("chunk % 4 = 1")
    return chunks.holders(missing, _having(spark, d))


@query("SELECT name, chunk FROM (SELECT 'f' || k AS name, c AS chunk, row_number() OVER (PARTITION BY k ORDER BY c) AS n FROM range(5) a(k), range(40) b(c) WHERE c % 2 = 1) WHERE n <= 8")
def chunk_repair(spark, d):
    have = spark.range(200).select(F.concat(F.lit("f"), F.col("id") % 5).alias("name"), F.floor(F.col("id") / 5).alias("chunk")).filter("chunk % 2 = 0")
    return chunks.missing_chunks(have, spark.range(5).select(F.concat(F.lit("f"), "id").alias("name"), F.lit(40).cast("long").alias("total")), 8)


@query("""SELECT key, page FROM (SELECT o_orderkey AS key, ((coalesce(sum(s) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500) + (row_number() OVER (ORDER BY o_orderkey) - 1) // 64)::BIGINT AS page
    FROM (SELECT o_orderkey, length(o_orderpriority) AS s FROM orders WHERE o_orderkey < 1000))""")
def snapshot_pages(spark, d):
    o = table(spark, d, "orders").filter(f"{_o} < 1000").select(F.col(_o).alias("key"), F.length("o_orderpriority").alias("size"))
    return chunks.pages(o, "key", "size", 1, 64, 500).select("key", "page")


@query("""WITH p AS (SELECT 'f' || (event_id % 10) AS name, (event_id // 10) * 100 AS o, CASE WHEN event_id % 97 = 0 THEN 50 ELSE 100 END AS l FROM events WHERE event_id < 2000),
    g AS (SELECT *, CASE WHEN o > coalesce(max(o + l) OVER (PARTITION BY name ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS gap FROM p),
    s AS (SELECT *, sum(gap) OVER (PARTITION BY name ORDER BY o) AS gaps FROM g)
    SELECT name, coalesce(max(CASE WHEN gaps = 0 THEN o + l END), 0)::BIGINT AS upto, CASE WHEN name = 'f3' THEN 'conflict' ELSE 'good' END AS state FROM s GROUP BY 1""")
def file_parts(spark, d):
    e = table(spark, d, "events").filter("event_id < 2000")
    p = e.select(F.concat(F.lit("f"), F.col("event_id") % 10).alias("name"), (F.floor(F.col("event_id") / 10) * 100).alias("offset"), F.when(F.col("event_id") % 97 == 0, 50).otherwise(100).alias("length"), F.col("event_id").cast("string").alias("digest"))
    again = p.filter("name = 'f3' AND offset = 200").withColumn("digest", F.lit("other"))
    return chunks.file_parts(p.unionByName(p).unionByName(again))


_RD = "sha256(concat_ws(',', length(o_orderkey::VARCHAR) || ':' || o_orderkey, length(o_orderstatus) || ':' || o_orderstatus))"


@query(f"""WITH x AS (SELECT o_orderkey AS k, {_RD} AS d FROM orders), r AS (SELECT k // 4096 AS r, count(*) AS n, sha256(string_agg(d, '' ORDER BY k, d)) AS d FROM x GROUP BY 1)
    SELECT sum(n)::BIGINT AS rows, sha256(string_agg(d, '' ORDER BY r)) AS digest FROM r""")
def digest_table(spark, d):
    return chunks.digest(_orders(spark, d), [_o, "o_orderstatus"], _o)


@query("""SELECT 'nation' AS "table", count(*) AS rows, sum(octet_length(encode(n_name)) + 8 + 8 + 3 * 16)::BIGINT AS bytes FROM nation UNION ALL SELECT 'supplier', count(*), sum(8 + octet_length(encode(s_name)) + 8 + 8 + 4 * 16)::BIGINT FROM supplier""")
def table_stats(spark, d):
    return state.table_stats({n: table(spark, d, n) for n in ("supplier", "nation")})


@query("SELECT c_custkey, c_name, 'k2' AS key_id FROM customer WHERE c_custkey < 200")
def sealed_columns(spark, d):
    keys = {"k1": b"0123456789abcdef", "k2": b"fedcba9876543210"}
    c = table(spark, d, "customer").filter("c_custkey < 200").select("c_custkey", "c_name")
    both = store.sealed(c.filter("c_custkey % 2 = 0"), ["c_name"], keys["k1"], "k1", "customer").unionByName(store.sealed(c.filter("c_custkey % 2 = 1"), ["c_name"], keys["k2"], "k2", "customer"))
    turned = store.rotated(both, ["c_name"], keys, "k2", "customer")
    return store.opened(turned.withColumn("of", F.col("key_id")), ["c_name"], {"k2": keys["k2"]}, "customer").withColumnRenamed("of", "key_id")
