"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its words takes every document floor(r) times, and once more those that a balanced sample
with inclusion probability r - floor(r) draws. The cube method's flight phase moves the probabilities through the null
space of the constraints (words and documents taken stay what they were) until they are 0 or 1 for all but as many
documents as there are constraints; it runs in blocks, then on what the blocks left, until one block per source remains. Those few
land last. Documents fly from large to small, so only small ones are left to land.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.common import cut, n_words, ship

#: Source weights by rank, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so often.
MAX_REPEATS = 3
#: Documents that fly together in one task.
BLOCK = 4096


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size); sources rank by code point, null last.

    Targets share the sum of sizes by weight, no target above ``cap`` times its source's size, the excess going to the others
    by weight: target = min(cap * size, level * weight). The level is found by going through the sources by cap / weight.
    The table has one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("__rank", rank).withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # if all sources before this one are at their caps and the others are not, this is the level
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(onward)
    per = per.withColumn("__level", level)
    fits = F.col("__level") * F.col("__weight") <= F.col("__cap")
    # the first source by ratio whose level fits under its cap has the level of all that stay below their caps
    first = F.first(F.when(fits, F.col("__level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("__final", first)
    target = F.least(F.col("__cap"), F.coalesce(F.col("__final") * F.col("__weight"), F.col("__cap")))
    return per.withColumn("target", target.cast("double")).select("source", "source_size", "source_docs", "target")


def fly(prob: np.ndarray, size: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """The flight phase over units in the given order with the constraints words and documents; with ``land`` also the landing."""
    out = prob.astype(float)
    rng = np.random.default_rng(seed)
    coins = rng.random(len(out) + 8).tolist()
    coin = 0
    at: list[int] = []
    eps = 1e-9
    values, sizes = out.tolist(), size.astype(float).tolist()
    for k, p in enumerate(values):
        if p < eps or p > 1 - eps:
            values[k] = float(round(p))
            continue
        at.append(k)
        while len(at) == 3:
            a, b, c = at
            x, y, z = sizes[a], sizes[b], sizes[c]
            u = (y - z, z - x, x - y)  # orthogonal to (1, 1, 1) and (x, y, z)
            if x == y == z:
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for v, i in zip(u, at, strict=True):
                if v > 0:
                    up, down = min(up, (1 - values[i]) / v), min(down, values[i] / v)
                elif v < 0:
                    up, down = min(up, values[i] / -v), min(down, (1 - values[i]) / -v)
            step = up if coins[coin % len(coins)] * (up + down) < down else -down
            coin += 1
            for v, i in zip(u, at, strict=True):
                values[i] += step * v
                if values[i] < eps or values[i] > 1 - eps:
                    values[i] = float(round(values[i]))
            at = [i for i in at if 0 < values[i] < 1]
    if land and at:
        # at most two are left: of the ways to round them, the one whose words come nearest, then whose count comes nearest
        want = sum(values[i] * sizes[i] for i in at)
        count = sum(values[i] for i in at)
        ways = [[(m >> b) & 1 for b in range(len(at))] for m in range(1 << len(at))]
        best = min(ways, key=lambda w: (abs(sum(t * sizes[i] for t, i in zip(w, at, strict=True)) - want), abs(sum(w) - count), w))
        for t, i in zip(best, at, strict=True):
            values[i] = float(t)
        # words that rounding a large document leaves over go to a few others, the largest that fit first
        short = want - sum(t * sizes[i] for t, i in zip(best, at, strict=True))
        for _ in range(8):
            taken = 0.0 if short > 0 else 1.0
            fit = max((i for i, p in enumerate(prob) if eps < p < 1 - eps and values[i] == taken and sizes[i] <= abs(short)), key=lambda i: (sizes[i], -i), default=None)
            if fit is None or not sizes[fit]:
                break
            values[fit] = 1.0 - taken
            short -= sizes[fit] * (1 - 2 * taken)
    return np.array(values)


def _flown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block's flight; a source's last block also lands."""
    rows = rows.sort_values(["size", "unit"], ascending=[False, True], kind="stable")
    seed = int.from_bytes(hashlib.blake2b(repr(tuple(map(int, key))).encode(), digest_size=8).digest(), "little")
    rows["prob"] = fly(rows["prob"].to_numpy(), rows["size"].to_numpy(), seed, land=int(key[1]) == 1)
    return rows[["src", "unit", "size", "prob", "blocks"]]


def balanced_sample(units: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """Rows (src, unit, size, prob, n) to (src, unit, size, prob) with prob moved to 0 or 1.

    ``n`` is (at least) the units of the row's source, ``most`` the largest n. A source flies in ceil(n / block) blocks, each of
    which leaves two units at most, so the levels shrink by ``block / 2`` until a source has one block and lands.
    """
    ship(units.sparkSession)
    done: list[DataFrame] = []
    for level in range(64):
        placed = units.withColumn("blocks", F.ceil(F.col("n") / F.lit(block))).withColumn(
            "at", F.pmod(F.xxhash64(F.lit(level), "src", "unit"), F.col("blocks"))
        )
        flown = placed.groupBy("src", "blocks", "at").applyInPandas(_flown, "src long, unit long, size long, prob double, blocks long")
        if most <= block:
            done.append(flown)
            break
        flown = cut(flown, f"flight{level}")
        still = (F.col("prob") > 0) & (F.col("prob") < 1)
        done.append(flown.filter(~still))
        units = flown.filter(still).withColumn("n", 2 * F.col("blocks"))
        most = 2 * -(-most // block)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("blocks")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = MAX_REPEATS) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: doc_id, size (words), source, source_size, target, copies, taken (= size * copies). Documents
    without words are not taken. Rows that repeat an id and text are units that are taken alike; a null id and a null
    source count as values; an empty table gives an empty result. Reruns agree: order and draws come from hashes of the rows.
    """
    unit = F.xxhash64(F.col(id_col), F.col(text_col))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), unit.alias("unit")), "sizes")
    targets = cut(source_targets(sized, weights, cap), "targets")
    sized = sized.withColumn("src", F.xxhash64(F.coalesce(F.col("source"), F.lit("\x00null"))))
    keyed = targets.select(
        F.xxhash64(F.coalesce(F.col("source"), F.lit("\x00null"))).alias("__src"), "source_size", "source_docs", "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0)).alias("__ratio"),
    )
    rows = sized.join(keyed, F.col("src") == F.col("__src")).drop("__src")
    # ratios that are whole but for rounding leave nothing to draw
    whole = F.floor(F.col("__ratio") + 1e-9)
    rows = rows.withColumn("__whole", whole.cast("long")).withColumn("prob", F.greatest(F.col("__ratio") - F.col("__whole"), F.lit(0.0)))
    units = rows.filter((F.col("size") > 0) & (F.col("prob") > 1e-9)).select("src", "unit", "size", "prob", F.col("source_docs").alias("n"))
    most = keyed.agg(F.max("source_docs")).first()[0] or 1
    drawn = balanced_sample(units, most).groupBy("src", "unit").agg(F.sum(F.round("prob").cast("long")).alias("__drawn"), F.count(F.lit(1)).alias("__same"))
    drawn = drawn.select(F.col("src").alias("__s"), F.col("unit").alias("__u"), "__drawn", "__same")
    out = rows.join(drawn, (F.col("src") == F.col("__s")) & (F.col("unit") == F.col("__u")), "left")
    # rows that repeat a row share its draws: as many of them are taken as were drawn
    some = out.filter(F.col("__same") > 1).withColumn("__nth", F.row_number().over(Window.partitionBy("src", "unit").orderBy("size")))
    single = out.filter(F.coalesce(F.col("__same"), F.lit(1)) <= 1).withColumn("__nth", F.lit(1))
    out = single.unionByName(some)
    extra = F.when(F.col("__nth") <= F.coalesce(F.col("__drawn"), F.lit(0)), F.lit(1)).otherwise(F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("__whole") + extra).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", "taken", "unit")
