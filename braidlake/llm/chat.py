"""Chat formatting with minimum-cost role repair.

Legal turns form an automaton: a conversation begins with system or user, system is followed by user, user by assistant, assistant by
user. A turn can be kept, relabelled, merged into the turn before it, or be given an empty turn before it. Dynamic programming over
the automaton's states finds the cheapest repair, and the repaired turns are rendered.

Turns are sorted over all conversations by range, so a conversation of very many turns lies in many tasks. One that lies within a task and has at most
SEGMENT turns is repaired there and then. Others are cut into segments of SEGMENT turns: each segment's costs from state to
state form a matrix, the matrices of a conversation combine by minimum and sum, and with the states at its borders known each segment
is repaired on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.common import cut, ship, tidy

STATES = ("start", "system", "user", "assistant")
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, INSERT = 1, 2, 3
SEGMENT = 512
NEVER = 1e15


def moves(role: str | None) -> list[tuple[int, int, int, str, int]]:
    """(from, to, cost, action, role of an inserted empty turn or 0) for a turn, in order of preference."""
    out = []
    for p in range(4):
        for t in (1, 2, 3):
            change = 0 if STATES[t] == role else RELABEL
            name = "relabel" if change else "keep"
            if t in FOLLOWS[p]:
                out.append((p, t, change, name, 0))
            elif t == p:
                out.append((p, t, change + MERGE, "merge", 0))
            for x in FOLLOWS[p]:
                if t in FOLLOWS[x]:
                    out.append((p, t, change + INSERT, f"insert+{name}", x))
    return out


_MOVES = {r: moves(r) for r in (*STATES[1:], None)}


def of(role):
    return _MOVES.get(role, _MOVES[None])


def matrix(roles: list) -> np.ndarray:
    """Least costs from each state to each over a run of turns."""
    total = np.where(np.eye(4) > 0, 0.0, NEVER)
    for role in roles:
        step = np.full((4, 4), NEVER)
        for p, t, c, _, _ in of(role):
            step[p, t] = min(step[p, t], c)
        total = (total[:, :, None] + step[None]).min(axis=1)
    return total


def repair(roles: list, entry: int, leave: int | None = None) -> tuple[int, list[tuple[int, str, int]]]:
    """The least cost from ``entry`` to ``leave`` (any state if None), and (state, action, inserted state or 0) of each turn on the way."""
    cost, back = [0 if s == entry else NEVER for s in range(4)], []
    for role in roles:
        best: list = [(NEVER * 2, None)] * 4
        for m in of(role):
            if cost[m[0]] + m[2] < best[m[1]][0]:
                best[m[1]] = (cost[m[0]] + m[2], m)
        cost, back = [b[0] for b in best], [*back, [b[1] for b in best]]
    at = min(range(4), key=lambda s: (cost[s], s)) if leave is None else leave
    least, out = cost[at], []
    for step in reversed(back):
        p, t, _, action, x = step[at]
        out.append((t, action, x))
        at = p
    return int(least), out[::-1]


def escaped(text: str | None) -> str:
    """A body in which no mark can stand: each backslash is doubled and each ``<|`` becomes ``<\\|``."""
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(body: str) -> str:
    out, k = [], 0
    while k < len(body):
        step = 2 if body[k] == "\\" else 1
        out.append(body[k + step - 1 : k + step])
        k += step
    return "".join(out)


def render(way: list[tuple[int, str, int]], texts: list[str | None]) -> str:
    """The repaired turns: a line with the role's mark, then the body's lines; a merged body goes on under the mark before it."""
    out = []
    for (state, action, inserted), text in zip(way, texts, strict=True):
        if inserted:
            out.append(f"<|{STATES[inserted]}|>\n\n")
        out.append((f"<|{STATES[state]}|>\n" if action != "merge" else "") + escaped(text) + "\n")
    return "".join(out)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, body) of the turns of a rendered conversation."""
    marked = rendered.split("<|")[1:]
    return [(x[: x.index("|>\n")], unescaped(x[x.index("|>\n") + 3 : -1])) for x in marked]


_PACKED = "conv_id long, alone boolean, part int, piece int, turns array<long>, roles array<string>, texts array<string>"
_RESULT = "conv_id long, segment long, n_turns long, cost long, turns array<long>, roles array<string>, actions array<string>, inserted array<string>, rendered string"


def _pack(segment: int):
    """Sorted rows (part, conv_id, turn, role, text) of a task to pieces of at most ``segment`` turns; ``alone`` is one that is a whole conversation for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = [x.split()[0] for x in _PACKED.split(", ")]
        held, conv, piece, runs, out = [], None, 0, 0, []

        def close(last: bool):
            # the first and the last conversation of a task may go on in its neighbours
            nonlocal held, piece
            out.append((conv, piece == 0 and runs > 1 and not last, part, piece, *map(list, zip(*held, strict=True))))
            held, piece = [], piece + 1

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)
            out.clear()
            return made

        for rows in batches:
            for part, c, turn, role, text in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                if not runs or c != conv:
                    if held:
                        close(False)
                    conv, piece, runs = c, 0, runs + 1
                elif len(held) == segment:
                    out.append((conv, False, part, piece, *map(list, zip(*held, strict=True))))
                    held, piece = [], piece + 1
                held.append((turn, role, text))
            if len(out) >= 256:
                yield batch()
        if held:
            close(True)
        if out:
            yield batch()

    return tidy(run)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, segment, turns, roles, texts, entry, leave) to the result's."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    for batch in batches:
        out = []
        for conv, segment, turns, roles, texts, entry, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cost, way = repair(roles, entry, leave)
            out.append((conv, segment, len(turns), cost, turns, [STATES[w[0]] for w in way], [w[1] for w in way], [STATES[w[2]] if w[2] else None for w in way], render(way, texts)))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in _RESULT.split(", ")])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [matrix(r).ravel().tolist() for r in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.float64()))], ["conv_id", "segment", "costs"])


def _borders(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("segment")
    cost, back = np.array([0.0, NEVER, NEVER, NEVER]), []
    for costs in rows["costs"]:
        through = cost[:, None] + np.array(costs).reshape(4, 4)
        back.append(through.argmin(axis=0))
        cost = through.min(axis=0)
    at, ways = int(cost.argmin()), []
    for b in reversed(back):
        ways.append((int(b[at]), at))
        at = int(b[at])
    ways.reverse()
    return pd.DataFrame({"conv_id": rows["conv_id"], "segment": rows["segment"], "entry": [w[0] for w in ways], "leave": [w[1] for w in ways]})


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation, or for each ``segment`` turns of a longer one, of turns (conv_id, turn, role, text).

    Returns conv_id, segment (from 0), n_turns, cost, turns, roles (repaired), actions, inserted (the role of an empty turn put before, or null)
    and rendered; a conversation's texts in the order of segment make its whole. Turns are taken in the order of turn, role, text, nulls first, so
    ties and repeated rows have one order. Unknown and null roles are relabelled, null texts are empty, null conv_ids are one conversation; marks in
    bodies are escaped; an empty table gives an empty result; other columns are left out.
    """
    ship(turns.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *order)
    packed = cut(rows.mapInArrow(_pack(segment), _PACKED), "pieces")
    open_ = packed.filter(~F.col("alone"))
    # what may span tasks is numbered anew by place: one row for each piece is sorted, not the turns
    sizes = open_.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("piece").alias("i"), F.size("turns").cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("p", "i").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("c", "p", "i", F.coalesce(before, F.lit(0)).alias("before"))
    both = open_.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("piece") == F.col("i")))
    each = both.select("conv_id", "before", F.posexplode(F.arrays_zip("turns", "roles", "texts")).alias("k", "x"))
    each = each.select("conv_id", (F.col("before") + F.col("k")).alias("place"), "x.*").withColumn("segment", F.floor(F.col("place") / segment))
    lists = F.array_sort(F.collect_list(F.struct("place", "turns", "roles", "texts"))).alias("l")
    long_ = cut(each.groupBy("conv_id", "segment").agg(lists).select("conv_id", "segment", *[F.col(f"l.{x}").alias(x) for x in ("turns", "roles", "texts")]), "segments")
    costs = long_.select("conv_id", "segment", "roles").mapInArrow(tidy(_matrices), "conv_id long, segment long, costs array<double>")
    borders = costs.groupBy("conv_id").applyInPandas(_borders, "conv_id long, segment long, entry int, leave int")
    borders = borders.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "entry", "leave")
    cells = ["conv_id", "segment", "turns", "roles", "texts", "entry", "leave"]
    long_ = long_.join(borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).select(cells)
    alone = packed.filter("alone").select("conv_id", F.lit(0).cast("long").alias("segment"), "turns", "roles", "texts", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("leave"))
    return alone.unionByName(long_).mapInArrow(tidy(_repaired), _RESULT)
