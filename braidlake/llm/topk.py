"""Exact top-k by inner product over a bit-sliced index.

Rows are indexed in tiles of bounded size. For each dimension a tile holds bitmaps (Python integers, one bit a row):
slice b has the bits b of the row's value less the tile's least value. A query adds, for every dimension, the slices shifted by the
set bits of its own component with carry-save adders, in bitmap arithmetic, which gives the slices of all rows' scores.
The best rows are then selected from the most significant slice downward. The lowest ``drop`` bits of the values stay out of the index: what
they can add is bounded, the selection keeps every row that this bound lets reach the k-th score, and these boundary
rows get their exact inner products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.common import ship

#: Rows and queries in a tile at most, low bits that the index leaves out, and tiles wanted where rows allow.
TILE_ROWS, TILE_QUERIES, DROP, TILES, LEAST_ROWS = 8192, 2048, 2, 32, 128


def pack(bits: np.ndarray) -> int:
    """A bitmap of a boolean vector: bit i is row i."""
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class BitSliced:
    """The index of one tile: ``values`` is rows x dimensions of integers (int64 or object)."""

    def __init__(self, values: np.ndarray, drop: int = DROP):
        self.values, self.rows = values, len(values)
        self.drop, self.full = drop, (1 << len(values)) - 1
        self.low = values.min(axis=0) if self.rows else np.zeros(values.shape[1], dtype=np.int64)
        self.slices: list[list[int]] = []
        for j in range(values.shape[1]):
            lifted = (values[:, j] - self.low[j]) >> drop
            width = int(lifted.max()).bit_length() if self.rows else 0
            self.slices.append([pack(((lifted >> b) & 1).astype(bool)) for b in range(width)])
        self.inverse = [[s ^ self.full for s in column] for column in self.slices]

    def sums(self, query: list[int]) -> tuple[list[int], int]:
        """Slices of a score of all rows, the same but for a constant as the inner product of the indexed bits; and the most that the bits left out add."""
        columns: list[list[int]] = []
        slack = 0
        for q, own, flipped in zip(query, self.slices, self.inverse, strict=True):
            # a negative factor takes the complement of the slices: -q * x is |q| * (all ones - x) less a constant
            bits = own if q > 0 else flipped
            size = abs(q)
            slack += size * ((1 << self.drop) - 1)
            shift = 0
            while size:
                if size & 1:
                    while len(columns) < shift + len(bits):
                        columns.append([])
                    for b, s in enumerate(bits, shift):
                        columns[b].append(s)
                size >>= 1
                shift += 1
        out, b = [], 0
        while b < len(columns):
            have = columns[b]
            if len(have) > 1 and b + 1 == len(columns):
                columns.append([])
            while len(have) > 2:
                x, y, z = have.pop(), have.pop(), have.pop()
                u = x ^ y
                have.insert(0, u ^ z) if len(have) < 8 else have.append(u ^ z)
                columns[b + 1].append((x & y) | (u & z))
            if len(have) == 2:
                x, y = have
                columns[b + 1].append(x & y)
                have = [x ^ y]
            out.append(have[0] if have else 0)
            b += 1
        return out, slack

    def at_least(self, slices: list[int], k: int, allowed: int, slack: int) -> int:
        """A bitmap of the rows whose score plus ``slack`` reaches the k-th greatest score among ``allowed``."""
        if allowed.bit_count() <= k:
            return allowed
        above, equal, threshold = 0, allowed, 0
        for b in range(len(slices) - 1, -1, -1):
            with_bit = equal & slices[b]
            threshold <<= 1
            if above.bit_count() + with_bit.bit_count() >= k:
                equal, threshold = with_bit, threshold | 1
            else:
                above |= with_bit
                equal &= ~slices[b]
        kept = above | equal
        if slack:
            least = max(0, threshold - slack)
            more, tie = 0, allowed
            for b in range(len(slices) - 1, -1, -1):
                if (least >> b) & 1:
                    tie &= slices[b]
                else:
                    more |= tie & slices[b]
                    tie &= ~slices[b]
            kept = more | tie
        return kept

    def search(self, query: list[int], k: int, allowed: int, ids: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, place) of the allowed rows, ties to the smaller id; rows are in the order of their ids."""
        slices, slack = self.sums(query)
        # the slices leave out the drop lowest bits, so their unit is 2^drop; either bound is rounded outward
        kept = self.at_least(slices, k, allowed, (slack >> self.drop) + (1 if slack else 0))
        raw = np.frombuffer(kept.to_bytes((self.rows + 7) // 8, "little"), dtype=np.uint8)
        at = np.flatnonzero(np.unpackbits(raw, bitorder="little", count=self.rows))
        if self.values.dtype == object:
            exact = [sum(int(v) * q for v, q in zip(self.values[i], query, strict=True)) for i in at]
            order = sorted(range(len(at)), key=lambda n: (-exact[n], ids[at[n]], at[n]))[:k]
        else:
            exact = self.values[at] @ np.array(query, dtype=np.int64)
            order = np.lexsort((at, ids[at], -exact))[:k]
        return [(int(exact[n]), int(at[n])) for n in order]


def quantise(vectors: list) -> np.ndarray:
    """floor(256 x) for each component, as int64 where all products fit and as Python integers otherwise."""
    scaled = np.floor(np.array(vectors, dtype=np.float64) * 256.0)
    if scaled.size and np.abs(scaled).max() >= 2**24:
        return np.array([[int(x) for x in row] for row in scaled.tolist()], dtype=object).reshape(scaled.shape)
    return scaled.astype(np.int64)


LONG = (1 << 63) - 1


def _tile(k: int, drop: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked, held = rows[rows["is_query"]], rows[~rows["is_query"]].sort_values("id", kind="stable")
        out: list[tuple[int, int, int]] = []
        if len(asked) and len(held):
            values = quantise(list(held["v"]))
            queries = quantise(list(asked["v"]))
            if values.dtype != queries.dtype:
                values, queries = values.astype(object), queries.astype(object)
            ids = held["id"].to_numpy()
            index = BitSliced(values, drop)
            for q, vector in zip(asked["id"].tolist(), queries.tolist(), strict=True):
                allowed = index.full
                first, last = np.searchsorted(ids, [q, q + 1])
                for i in range(first, last):
                    allowed &= ~(1 << i)
                out += [(q, int(ids[i]), max(-LONG - 1, min(LONG, s))) for s, i in index.search([int(x) for x in vector], k, allowed, ids)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", drop: int = DROP, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES, tiles: int = TILES) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the greatest inner products for each of ``queries``: query_id, rank, vec_id, score.

    Components count as floor(256 x). Ties go to the smaller id. Rows with a query's own id are not its candidates. A null id or
    vector, and a null or non-finite component, takes a row out; a query meets candidates of its own length; a repeated
    query id is asked once, with the first of its vectors in order; repeated candidates each count; no rows give no rows. Products beyond 64 bits are
    clamped. Queries and rows meet in a grid of tiles, each of bounded size.
    """
    ship(vectors.sparkSession)
    clean = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col("id").isNotNull()
    held = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(clean)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(clean)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_asked = held.count(), asked.count()
    wanted = max(1, min(tiles, n_rows // LEAST_ROWS))
    h = max(1, -(-n_rows // tile_rows), wanted)
    g = max(1, -(-n_asked // tile_queries))
    held = held.withColumn("row_tile", F.pmod(F.xxhash64("id"), F.lit(h))).withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.lit(g - 1)).cast("array<bigint>")))
    asked = asked.withColumn("query_tile", F.pmod(F.xxhash64("id"), F.lit(g))).withColumn("row_tile", F.explode(F.sequence(F.lit(0), F.lit(h - 1)).cast("array<bigint>")))
    both = held.withColumn("is_query", F.lit(False)).unionByName(asked.withColumn("is_query", F.lit(True)))
    both = both.withColumn("length", F.size("v"))
    found = both.groupBy("row_tile", "query_tile", "length").applyInPandas(_tile(k, drop), "query_id long, vec_id long, score long")
    # Spark keeps only the k best of a task's rows before the shuffle, as the rank is limited
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
