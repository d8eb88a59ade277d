"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

The leaves of the tree are shards, their parents racks, the parents of those regions; a node weighs what its shards weigh. A key descends from
the root: at each level every child of the node reached draws ``-ln(u) / weight`` with ``u`` a hash of (key, child) in (0, 1), and
the least draw is followed, which falls on a child with a chance in proportion to its weight. A draw depends on the key, the child and
its weight alone. So a shard whose weight grows draws keys into its rack from that rack's region and from other regions,
moves nothing between other subtrees, and where no node above it changes weight (weight shifted within a rack) moves keys within that rack alone.
``grow`` adds a shard as a region of its own: that takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.common import hex_fraction

#: Numbering blocks of a shard: slots are numbered block by block, so that no task numbers a whole shard.
BLOCKS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """A tree of equal shards: ``per_rack`` shards in a rack, ``racks`` racks in a region, as many regions as needed."""
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and a region of its own."""
    return [*leaves, Leaf(*(1 + max(getattr(x, level) for x in leaves) for level in ("region", "rack", "shard")), weight)]


def nested(leaves: list[Leaf]) -> dict[int, dict[int, dict[int, float]]]:
    """Weights by region, rack and shard, without those of no weight."""
    if len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("a shard stands in a tree once")
    out: dict[int, dict[int, dict[int, float]]] = {}
    for x in sorted(leaves, key=lambda x: (x.region, x.rack, x.shard)):
        if x.weight > 0:
            out.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = float(x.weight)
    if not out:
        raise ValueError("a tree needs a shard of positive weight")
    return out


def _followed(level: str, weights: dict[int, float], key):
    """Column: the child with the least draw; of equal draws the first."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draw = lambda name, w: -F.ln(hex_fraction(F.md5(F.concat_ws(":", F.lit(level), F.lit(str(name)), key)))) / F.lit(w)
    return F.least(*[F.struct(draw(name, w).alias("draw"), F.lit(name).alias("name")) for name, w in weights.items()])["name"]


def _chosen(at, ways: dict[int, object]):
    """Column: the way of the child that was followed; only that one is computed."""
    (first, way), *rest = ways.items()
    if not rest:
        return way
    out = F.when(at == first, way)
    for name, way in rest[:-1]:
        out = out.when(at == name, way)
    return out.otherwise(rest[-1][1])


def descend(docs: DataFrame, key, leaves: list[Leaf], out: str) -> DataFrame:
    """Add the column ``out``: the shard to which ``key`` descends, level by level."""
    regions = nested(leaves)
    weigh = lambda node: sum(map(weigh, node.values())) if isinstance(node, dict) else node
    docs = docs.withColumn("__region", _followed("region", {r: weigh(x) for r, x in regions.items()}, key))
    docs = docs.withColumn("__rack", _chosen(F.col("__region"), {r: _followed("rack", {k: weigh(y) for k, y in x.items()}, key) for r, x in regions.items()}))
    # racks are named within their region
    ways = {r: _chosen(F.col("__rack"), {k: _followed("shard", y, key) for k, y in x.items()}) for r, x in regions.items()}
    return docs.withColumn(out, _chosen(F.col("__region"), ways).cast("int")).drop("__region", "__rack")


def assign(docs: DataFrame, key, leaves: list[Leaf], out: str) -> DataFrame:
    """Add the column ``out`` with the shard of ``key``; a null key counts as a key of its own."""
    return descend(docs.withColumn("__key", F.coalesce(key.cast("string"), F.lit("null"))), F.col("__key"), leaves, out).drop("__key")


def number_slots(placed: DataFrame, shard: str, key, order: list, out: str = "slot", blocks: int = BLOCKS) -> DataFrame:
    """Number the rows of each shard without gaps from 0.

    Rows fall into ``blocks`` blocks by a hash of ``key``; a row's slot is the rows of its shard in
    earlier blocks plus its place within its block by ``order``.
    """
    df = placed.withColumn("__block", F.floor(hex_fraction(F.md5(F.concat_ws(":", F.lit("block"), key))) * F.lit(blocks)).cast("long"))
    counts = df.groupBy(shard, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(shard).alias("__shard"), F.col("__block").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy(shard, "__block").orderBy(*order)
    df = df.withColumn("__rank", F.row_number().over(within) - 1)
    df = df.join(offsets, (F.col(shard) == F.col("__shard")) & (F.col("__block") == F.col("__of")))
    return df.withColumn(out, (F.col("__before") + F.col("__rank")).cast("long")).drop("__block", "__shard", "__of", "__before", "__rank")


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place documents into shards under the law ``key``: id and shards decide, and a new shard takes rows only into itself.

    Returns id, ``size`` (UTF-8 bytes of the text, 0 for null, plus 1), ``text_crc32`` (of the empty text for null),
    ``law``, ``shard``, ``slot``, ``grown_shard`` (null without ``grown``). A null id is a key like any other; rows that repeat an id share its
    shard and take slots of their own, in blocks by their texts; an empty table gives an empty result; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(rows, F.col("doc_id"), leaves, "shard")
    placed = assign(placed, F.col("doc_id"), grown, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    block = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32")
    numbered = number_slots(placed, "shard", block, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
