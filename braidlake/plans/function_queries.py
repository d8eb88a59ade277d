"""Queries over column functions, joins and windows that differ between engines, search and its upkeep, streams in their batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidlake.functions import values
from braidlake.operators import search
from braidlake.plans.fixtures import LOG, events, table
from braidlake.plans.fixtures import log as log_rows
from braidlake.plans.registry import query
from braidlake.streaming import live

# ---- functions


@query("""SELECT c_custkey, substr(c_name, 3, 4) AS a, substr(c_name, greatest(len(c_name) - 4, 1)) AS b, substr(c_name, 1, 2) AS c, substr(c_name, 2, 3) AS e, '' AS f FROM customer""")
def fn_substr(spark, d):
    n = F.col("c_name")
    cut = lambda a, b=None: values.substr(n, F.lit(a), None if b is None else F.lit(b))
    return table(spark, d, "customer").select("c_custkey", cut(3, 4).alias("a"), cut(-5).alias("b"), cut(0, 3).alias("c"), cut(5, -3).alias("e"), cut(-99, 3).alias("f"))


@query("""SELECT c_custkey, hex(encode(c_name)) AS h, octet_length(encode(c_name))::INTEGER AS n, c_name AS back, repeat('00', (c_custkey % 5)::INTEGER) AS z, 'X''' || hex(encode(c_mktsegment)) || '''' AS q FROM customer""")
def fn_blob(spark, d):
    raw = F.encode("c_name", "UTF-8")
    back = F.decode(values.unhexed(F.hex(raw)), "UTF-8")
    return table(spark, d, "customer").select(
        "c_custkey", F.hex(raw).alias("h"), values.blob_length(raw).alias("n"), back.alias("back"), F.hex(values.zeroblob(F.col("c_custkey") % 5)).alias("z"), values.quote_literal(F.encode("c_mktsegment", "UTF-8"), "binary").alias("q")
    )


@query("SELECT o_orderkey, printf('%05d|%s|%x', o_orderkey, o_orderstatus, o_orderkey) AS t FROM orders")
def fn_printf(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.printf("%05d|%s|%x", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderkey")).alias("t"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%j') AS j, floor(epoch(ts))::BIGINT::VARCHAR AS s, round(julian(ts), 3) AS jd, date_trunc('month', ts) + INTERVAL 3 DAY AS m FROM events""")
def fn_datetime(spark, d):
    e = events(spark, d)
    out = e.select("event_id", values.strftime("%Y-%m-%d %H:%M:%S", F.col("ts")).alias("t"), values.strftime("%j", F.col("ts")).alias("j"), values.strftime("%s", F.col("ts")).alias("s"), F.round(values.julianday(F.col("ts")) + 0.5, 3).alias("jd"), values.datetime_shift(F.col("ts"), "start of month", "+3 days").cast("timestamp_ntz").alias("m"))
    return out


@query("""SELECT vec_id, len(embedding)::INTEGER AS n, round((embedding[1]::DOUBLE + embedding[1]::DOUBLE), 6) AS a, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS one, 0.0::DOUBLE AS zero FROM embeddings""")
def fn_vector(spark, d):
    v = F.col("embedding").cast("array<double>")
    norm = F.aggregate(values.vec_normalize(v), F.lit(0.0), lambda a, x: a + x * x)
    return table(spark, d, "embeddings").select("vec_id", values.vec_length(v).alias("n"), F.round(F.element_at(values.vec_add(v, v), 1), 6).alias("a"), F.round(norm, 6).alias("one"), F.aggregate(values.vec_sub(v, v), F.lit(0.0), lambda a, x: a + x).alias("zero"))


@query("""SELECT user_id, event_id, '10.' || (user_id % 4) || '.' || (event_id % 256) || '.7' AS ip, user_id % 4 = 1 OR (user_id % 4 = 2 AND event_id % 256 >= 128) AS allowed FROM events""")
def fn_cidr(spark, d):
    ip = F.concat(F.lit("10."), F.col("user_id") % 4, F.lit("."), F.col("event_id") % 256, F.lit(".7"))
    return table(spark, d, "events").select("user_id", "event_id", ip.alias("ip"), values.cidr_allows(ip, ["10.1.0.0/16", "10.2.128.0/17"]).alias("allowed"))


@query("SELECT c_custkey, upper(md5(c_name)) AS h, c_name ILIKE 'CUSTOMER#%1' AS l FROM customer")
def fn_hex_like(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.hex(values.parse_hex(F.md5("c_name"), 16)).alias("h"), values.like_ascii(F.col("c_name"), "CUSTOMER#%1").alias("l"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS r, CASE event_id % 5 WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN value END AS n, CASE event_id % 5 WHEN 3 THEN event_type WHEN 4 THEN props END AS t FROM events)
    SELECT event_id, row_number() OVER (ORDER BY r, n, t, event_id)::INTEGER AS place FROM v WHERE event_id < 500""")
def value_order(spark, d):
    k, none = F.col("event_id") % 5, F.lit(None)
    kind = F.when(k == 0, "null").when(k == 1, "integer").when(k == 2, "real").when(k == 3, "text").otherwise("blob")
    key = values.value_key(kind, F.when(k == 1, F.col("event_id")), F.when(k == 2, F.col("value")), F.when(k == 3, F.col("event_type")), F.when(k == 4, F.encode("props", "UTF-8")).otherwise(none.cast("binary")))
    return table(spark, d, "events").filter("event_id < 500").select("event_id", F.row_number().over(Window.orderBy(key, "event_id")).alias("place"))


@query("SELECT event_id, (event_id * 1000003)::BIGINT AS big, least(event_id, user_id) AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE greatest(event_id, user_id) END AS b FROM events")
def fn_numbers(spark, d):
    e, some = table(spark, d, "events"), F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    return e.select("event_id", values.fits_long(F.col("event_id").cast("decimal(38,0)") * 1000003).alias("big"), values.scalar_least(F.col("event_id"), F.col("user_id")).alias("a"), values.scalar_greatest(some, F.col("user_id")).alias("b"))


# ---- joins and windows


@query("SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 300000) t")
def join_lateral(spark, d):
    for name in ("customer", "orders"):
        table(spark, d, name).createOrReplaceTempView(f"lateral_{name}")
    return spark.sql("SELECT c.c_custkey, t.o_orderkey FROM lateral_customer c, LATERAL (SELECT o_orderkey FROM lateral_orders WHERE o_custkey = c.c_custkey AND o_totalprice > 300000) t")


@query("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) USING (k)")
def join_using(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    return n.join(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")), "k")


@query("SELECT * FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region)")
def join_natural(spark, d):
    table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("a")).createOrReplaceTempView("natural_n")
    table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")).createOrReplaceTempView("natural_r")
    return spark.sql("SELECT * FROM natural_n NATURAL JOIN natural_r")


_G = "(PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {})"


@query(f"SELECT event_id, count(*) OVER {_G.format('GROUP')} AS g, count(*) OVER {_G.format('TIES')} AS t FROM events")
def win_exclude_ties(spark, d):
    """EXCLUDE GROUP and TIES of a whole partition: its count less that of the row's peers, with the row itself for TIES."""
    all_, peers = F.count(F.lit(1)).over(Window.partitionBy("user_id")), F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type"))
    return table(spark, d, "events").select("event_id", (all_ - peers).alias("g"), (all_ - peers + 1).alias("t"))


# ---- search


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


def _terms(text: str, pattern: str = r"[\p{L}\p{N}]+") -> str:
    return f"(SELECT doc_id AS key, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower({text}), '{pattern}') AS t FROM documents))"


@query(f"SELECT DISTINCT key FROM {_terms('text')} WHERE starts_with(term, 'licen')")
def fts_prefix(spark, d):
    return search.prefix(search.postings(_docs(spark, d), "doc_id", "text"), "licen")


@query(f"SELECT DISTINCT key FROM {_terms('source')} WHERE starts_with(term, 'src1')")
def fts_column(spark, d):
    both = search.postings(_docs(spark, d), "doc_id", "text", column="text").unionByName(search.postings(_docs(spark, d), "doc_id", "source", column="source"))
    return search.prefix(both, "src1", "source")


@query(f"WITH p AS {_terms('text')} SELECT DISTINCT a.key FROM p a JOIN p b ON a.key = b.key AND abs(a.pos - b.pos) BETWEEN 1 AND 6 WHERE a.term = 'the' AND b.term = 'license'")
def fts_near(spark, d):
    return search.near(search.postings(_docs(spark, d), "doc_id", "text"), "the", "license", 5)


@query(f"SELECT key, count(*) AS n FROM {_terms('text', '[a-z0-9]+')} GROUP BY 1")
def fts_ascii(spark, d):
    return search.postings(_docs(spark, d), "doc_id", "text", "ascii").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def fts_porter(spark, d):
    """Keys whose text holds a word of the stem of licenses; SQL has no such stems."""
    return search.match(search.postings(_docs(spark, d), "doc_id", "text", "porter"), [search.stem("licenses")])


@query(f"""WITH p AS {_terms('text')}, l AS (SELECT key, count(*) AS len FROM p GROUP BY 1), c AS (SELECT count(*) AS docs, avg(len) AS mean FROM l),
    tf AS (SELECT key, term, count(*) AS tf FROM p WHERE term IN ('license', 'released') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN l USING (key) JOIN df USING (term), c GROUP BY 1
    ORDER BY sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) DESC, key LIMIT 5""")
def fts_rank(spark, d):
    docs = _docs(spark, d)
    return search.bm25(search.postings(docs, "doc_id", "text"), ["license", "released"], search.lengths(docs, "doc_id", "text"), 5).select("key", F.round("score", 6).alias("score"))


@query(f"""WITH p AS {_terms('text')} SELECT CASE WHEN key % 10 = 3 THEN 'quite' ELSE term END AS term, count(*) AS n FROM p WHERE key % 10 <> 4 AND term = 'license' AND key % 10 <> 3 GROUP BY 1
    UNION ALL SELECT 'quite', count(*) FROM documents WHERE doc_id % 10 = 3""")
def fts_maintain(spark, d):
    """A tenth of the texts is rewritten, another deleted; only their postings change."""
    docs = _docs(spark, d)
    index = search.postings(docs, "doc_id", "text")
    now = docs.filter("doc_id % 10 <> 4").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.lit("quite")).otherwise(F.col("text")))
    new = search.maintained(index, now, docs.filter("doc_id % 10 IN (3, 4)"), "doc_id", "text")
    return new.filter("term IN ('quite', 'license')").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS key, CASE WHEN vec_id % 7 = 1 THEN 'width' ELSE 'not finite' END AS fault FROM embeddings WHERE vec_id % 7 IN (1, 2)")
def vector_check(spark, d):
    k, v = F.col("vec_id") % 7, F.col("embedding")
    bad = F.when(k == 1, F.slice(v, 1, 3)).when(k == 2, F.transform(v, lambda x: F.lit(float("inf")).cast("float"))).when(k != 3, v)
    return search.vector_faults(table(spark, d, "embeddings").select("vec_id", bad.alias("v")), "vec_id", "v", 64)


# ---- streams, in their batch form


@query(f"WITH {LOG} SELECT origin, sequence FROM log WHERE sequence > 30")
def stream_catch_up(spark, d):
    rows = log_rows(spark, d).select("origin", "sequence")
    boundary = rows.select("origin").distinct().withColumn("upto", F.lit(30).cast("long"))
    return live.caught_up(rows.limit(0), rows, boundary)


@query("SELECT event_id FROM events WHERE event_id % 4 IN (1, 3) AND user_id % 5 <> 2")
def live_tables(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("t"), F.col("event_id") % 4).alias("table"), F.concat(F.lit("o"), F.col("user_id") % 5).alias("origin"))
    return live.others(live.of_tables(e, ["t1", "t3"]), "o2").select("event_id")
