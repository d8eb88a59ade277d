"""Full-text and vector search over derived indexes, and their upkeep.

An index of texts is two tables: postings (key, column, term, pos) and lengths (key, column, len). ``Index`` keeps them in a folder, the postings
partitioned by a hash of the term so that a query reads the parts of its terms alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.functions.stems import stem

K1, B = 1.2, 0.75
#: Parts of stored postings by term; vectors of a tile, and queries that meet a tile at once.
PARTS, TILE, ASKED = 64, 4096, 256
#: Widths that a vector may have.
MOST_WIDE = 8192
#: Three code points ahead, line ends included, and a step of one.
TRIGRAM = r"(?s)(?=(...))."
WORDS = {"unicode61": r"([\p{L}\p{N}]+)", "ascii": r"([A-Za-z0-9]+)", "porter": r"([\p{L}\p{N}]+)"}


def tokens(text: Column, tokenizer: str = "unicode61") -> Column:
    """Column: a text's terms in order: unicode61 (letters and digits of all scripts), ascii, porter (stems of the former) or trigram."""
    low = F.lower(text)
    if tokenizer == "trigram":
        # one pass over the text; a substring for each place would read it anew from its start
        return F.coalesce(F.regexp_extract_all(low, F.lit(TRIGRAM), F.lit(1)), F.array().cast("array<string>"))
    if tokenizer not in WORDS:
        raise ValueError(f"no tokenizer {tokenizer}")
    return F.regexp_extract_all(low, F.lit(WORDS[tokenizer]), F.lit(1))


def _stemmed(terms: DataFrame) -> DataFrame:
    """(__term, __stem) of distinct terms: each is stemmed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"__term": batch["term"], "__stem": batch["term"].map(stem)})

    return terms.select("term").distinct().mapInPandas(run, "__term string, __stem string")


def postings(docs: DataFrame, key: str, text: str, tokenizer: str = "unicode61", column: str | None = None) -> DataFrame:
    """(key, term, pos), with ``column`` also the name of the column they come from."""
    name = [F.lit(column).alias("column")] if column else []
    rows = docs.select(F.col(key).alias("key"), *name, F.posexplode(tokens(F.col(text), tokenizer)).alias("pos", "term"))
    if tokenizer == "porter":
        rows = rows.join(_stemmed(rows), F.col("term") == F.col("__term")).withColumn("term", F.col("__stem")).drop("__term", "__stem")
    return rows


def lengths(docs: DataFrame, key: str, text: str, tokenizer: str = "unicode61") -> DataFrame:
    """(key, len): how many terms a text has, without writing them out."""
    return docs.select(F.col(key).alias("key"), F.size(tokens(F.col(text), tokenizer)).cast("long").alias("len")).filter("len > 0")


def match(index: DataFrame, terms: list[str], every: bool = True) -> DataFrame:
    """Keys that hold every (or any) term."""
    hit = index.filter(F.col("term").isin(terms)).groupBy("key").agg(F.count_distinct("term").alias("n"))
    return hit.filter(F.col("n") >= (len(set(terms)) if every else 1)).select("key")


def prefix(index: DataFrame, start: str, column: str | None = None) -> DataFrame:
    """Keys that hold a term that begins with ``start``, in one column if it is named."""
    rows = index.filter(F.col("term").startswith(start))
    return (rows.filter(F.col("column") == column) if column else rows).select("key").distinct()


def phrase(index: DataFrame, terms: list[str]) -> DataFrame:
    """Keys that hold the terms next to each other."""
    out = index.filter(F.col("term") == terms[0]).select("key", "pos")
    for k, term in enumerate(terms[1:], 1):
        out = out.join(index.filter(F.col("term") == term).select("key", (F.col("pos") - k).alias("pos")), ["key", "pos"])
    return out.select("key").distinct()


def near(index: DataFrame, first: str, second: str, within: int = 10) -> DataFrame:
    """Keys that hold two terms with at most ``within`` others between them.

    The positions of both terms lie in one window by key; each looks back to the last of the other, so no pairs are made.
    """
    rows = index.filter(F.col("term").isin(first, second)).select("key", "term", "pos")
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda term: F.max(F.when(F.col("term") == term, F.col("pos"))).over(before)
    other = F.when(F.col("term") == first, last(second)).otherwise(last(first))
    return rows.withColumn("__gap", F.col("pos") - other - 1).filter(F.col("__gap") <= within).select("key").distinct()


def bm25(index: DataFrame, terms: list[str], sizes: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(key, score) of keys that hold any term; with ``k`` the best so many. ``sizes`` (key, len) spares counting the postings."""
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("len")) if sizes is None else sizes
    corpus = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    tf = index.filter(F.col("term").isin(terms)).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(F.lit(1.0) + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    # corpus is one row and df one for each asked term: both are bounded by the query
    out = tf.join(sizes, "key").join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus)).groupBy("key").agg(F.sum(part).alias("score"))
    return out if k is None else out.orderBy(F.col("score").desc(), "key").limit(k)


def _equal(term: str):
    return lambda x: x == term


def bm25_scan(docs: DataFrame, key: str, text: str, terms: list[str], k: int | None = None, tokenizer: str = "unicode61") -> DataFrame:
    """(key, score) as ``bm25``, from the texts themselves: a pass counts, a pass scores, and no posting is written or shuffled."""
    terms = list(dict.fromkeys(terms))
    found = tokens(F.col(text), tokenizer)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), found.alias("__t"))
    many = [F.size(F.filter("__t", _equal(t))).alias(f"__f{n}") for n, t in enumerate(terms)]
    rows = rows.select("key", F.size("__t").alias("__len"), *many).filter("__len > 0")
    some = F.greatest(*[F.col(f"__f{n}") for n in range(len(terms))], F.lit(0)) > 0
    held = [F.sum((F.col(f"__f{n}") > 0).cast("long")).alias(f"__d{n}") for n in range(len(terms))]
    corpus = rows.agg(F.count(F.lit(1)).alias("__docs"), F.avg("__len").alias("__mean"), *held)
    score = F.lit(0.0)
    for n in range(len(terms)):
        df, tf = F.col(f"__d{n}"), F.col(f"__f{n}")
        idf = F.ln(F.lit(1.0) + (F.col("__docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__mean")))).otherwise(0.0)
    # corpus is one row
    out = rows.filter(some).crossJoin(F.broadcast(corpus)).select("key", score.alias("score"))
    return out if k is None else out.orderBy(F.col("score").desc(), "key").limit(k)


def trigrams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram) of each text's distinct trigrams."""
    return docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(tokens(F.col(text), "trigram"))).alias("gram"))


def maintained(index: DataFrame, docs: DataFrame, touched: DataFrame, key: str, text: str, tokenizer: str = "unicode61") -> DataFrame:
    """An index after ``touched`` keys changed: their old postings go, those of the texts that ``docs`` now has come in; a deleted key only goes."""
    keys = touched.select(F.col(key).alias("__touched")).distinct()
    kept = index.join(keys, F.col("key") == F.col("__touched"), "left_anti")
    return kept.unionByName(postings(docs.join(keys, F.col(key) == F.col("__touched"), "left_semi"), key, text, tokenizer))


class Index:
    """An index of a text column in a folder, with a generation for each rebuild and a state that readers must find ready."""

    def __init__(self, spark, path: str, key: str, text: str, tokenizer: str = "unicode61"):
        self.spark, self.path, self.key, self.text, self.tokenizer = spark, path.rstrip("/"), key, text, tokenizer
        self.state, self.generation, self.listeners = "empty", 0, []

    def rebuild(self, docs: DataFrame) -> None:
        """Write all postings and lengths anew; the new generation counts when both are there, and listeners hear of it."""
        self.state, new = "rebuilding", self.generation + 1
        try:
            rows = postings(docs, self.key, self.text, self.tokenizer)
            self._write(rows, lengths(docs, self.key, self.text, self.tokenizer), new)
        except Exception:
            self.state = "failed"
            raise
        self._publish(new)

    def maintain(self, docs: DataFrame, touched: DataFrame) -> None:
        """A new generation in which ``touched`` keys have the terms of ``docs``."""
        old, sizes, new = self.postings(), self.lengths(), self.generation + 1
        keys = touched.select(F.col(self.key).alias("__touched")).distinct()
        some = docs.join(keys, F.col(self.key) == F.col("__touched"), "left_semi")
        kept = sizes.join(keys, F.col("key") == F.col("__touched"), "left_anti")
        rows = maintained(old.drop("part"), docs, touched, self.key, self.text, self.tokenizer)
        self._write(rows, kept.unionByName(lengths(some, self.key, self.text, self.tokenizer)), new)
        self._publish(new)

    def _write(self, rows: DataFrame, sizes: DataFrame, generation: int) -> None:
        parted = rows.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
        parted.repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/g={generation}/postings")
        sizes.write.mode("overwrite").parquet(f"{self.path}/g={generation}/lengths")

    def _publish(self, generation: int) -> None:
        self.generation, self.state = generation, "ready"
        for told in self.listeners:
            told(self.text, generation)

    def _ready(self) -> None:
        if self.state != "ready":
            raise RuntimeError(f"the index is {self.state}")

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Postings; those of ``terms`` are read from their parts alone."""
        self._ready()
        rows = self.spark.read.parquet(f"{self.path}/g={self.generation}/postings")
        if terms is None:
            return rows
        asked = self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(PARTS)).cast("int").alias("p"))
        return rows.filter(F.col("part").isin([r.p for r in asked.collect()]) & F.col("term").isin(list(terms)))  # one row for each asked term

    def lengths(self) -> DataFrame:
        self._ready()
        return self.spark.read.parquet(f"{self.path}/g={self.generation}/lengths")

    def bm25(self, terms: list[str], k: int | None = None) -> DataFrame:
        terms = [stem(t) for t in terms] if self.tokenizer == "porter" else terms
        return bm25(self.postings(terms), terms, self.lengths(), k)


# ---- vectors


def distance(a, b, metric: str):
    """l2, l1 or cosine distance of two arrays."""
    add = lambda x, y: x + y
    total = lambda f: F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f), F.lit(0.0), add)
    if metric == "l2":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if metric == "l1":
        return total(lambda x, y: F.abs(x - y))
    if metric != "cosine":
        raise ValueError(f"no metric {metric}")
    return 1 - total(lambda x, y: x * y) / F.sqrt(total(lambda x, y: x * x) * total(lambda x, y: y * y))


def vector_faults(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, fault) of vectors that cannot be indexed: a wrong width, a null or a number that is not finite; a null vector is no fault, it is left out."""
    if not 1 <= width <= MOST_WIDE:
        raise ValueError(f"a width from 1 to {MOST_WIDE}")
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(F.size(vector) != width, "width").when(odd, "not finite")
    return vectors.filter(F.col(vector).isNotNull()).withColumn("fault", fault).filter("fault IS NOT NULL").select(F.col(key).alias("key"), "fault")


def decoded(blobs: DataFrame, key: str, blob: str, width: int) -> DataFrame:
    """(key, vector) of blobs of little-endian 32-bit floats; a wrong length raises, null stays out."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def floats(column: pd.Series) -> pd.Series:
        bad = next((len(b) for b in column if len(b) != 4 * width), None)
        if bad is not None:
            raise ValueError(f"a vector of {width} floats has {4 * width} bytes, not {bad}")
        return column.map(lambda b: np.frombuffer(b, "<f4"))

    return blobs.filter(F.col(blob).isNotNull()).select(F.col(key).alias("key"), floats(F.col(blob)).alias("vector"))


def knn(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows to one vector; null vectors are left out."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.col(vector).isNotNull()).select(key, distance(F.col(vector), asked, metric).alias("distance"))
    return scored.orderBy("distance", key).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, metric: str = "l2", tile: int = TILE, asked: int = ASKED) -> DataFrame:
    """(query, key, distance, rank): the k nearest rows to each of a stated set of queries, by exact distances.

    Vectors lie in tiles, queries in batches; every batch meets every tile in a task of its own, which gives each query's k nearest in the tile. A
    task holds one tile and one batch; what is shuffled then is k rows for each query and tile. Of equal distances the smaller key comes first.
    """
    import numpy as np

    kind = dict(vectors.dtypes)[key]
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    wanted = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    tiles, batches = max(1, -(-rows.count() // tile)), max(1, -(-wanted.count() // asked))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.withColumn("t", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("b", upto(batches))
    asks = wanted.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).withColumn("t", upto(tiles))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            # keys in order, so that a stable sort puts the smaller one first
            left = left.sort_values("id", kind="stable")
            ids, data = left["id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(np.float64)
            for query, v in zip(right["id"], right["v"], strict=True):
                v = np.asarray(v, dtype=np.float64)
                if metric == "l2":
                    d = np.sqrt(((data - v) ** 2).sum(axis=1))
                elif metric == "l1":
                    d = np.abs(data - v).sum(axis=1)
                else:
                    d = 1 - data @ v / np.sqrt((data * data).sum(axis=1) * (v * v).sum())
                best = np.argsort(d, kind="stable")[:k]
                out += [(query, ids[j], d[j]) for j in best.tolist()]
        return pd.DataFrame(out, columns=["query", key, "distance"])

    if metric not in ("l2", "l1", "cosine"):
        raise ValueError(f"no metric {metric}")
    found = held.groupBy("t", "b").cogroup(asks.groupBy("t", "b")).applyInPandas(nearest, f"query {kind}, `{key}` {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Indexes:
    """Definitions of several indexes, replaced all at once: all that are new or changed are built first, then the whole set counts."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.held, self.epoch = spark, path.rstrip("/"), {}, 0

    def replace(self, definitions: dict[str, tuple[str, str, str]], docs: DataFrame) -> None:
        """``definitions``: name to (key, text, tokenizer). If one cannot be built, the old set stays."""
        made, epoch = {}, self.epoch + 1
        for name, (key, text, tokenizer) in definitions.items():
            old = self.held.get(name)
            if old is not None and (old.key, old.text, old.tokenizer) == (key, text, tokenizer):
                made[name] = old
                continue
            made[name] = Index(self.spark, f"{self.path}/{epoch}/{name}", key, text, tokenizer)
            made[name].rebuild(docs)
        self.held, self.epoch = made, epoch

    def __getitem__(self, name: str) -> Index:
        return self.held[name]
