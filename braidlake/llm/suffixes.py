"""Removal of repeated byte strings by a hash-compared suffix sort.

Every string of LENGTH bytes is filed under its anchor: the k-gram in it with the least hash, the last of equals. Equal
strings have equal anchors at equal places, so only strings under an anchor that occurs twice need sorting; all strings of
one anchor occurrence lie together and form its context. Contexts that occur twice whole, told by a 128-bit BLAKE2 digest of their bytes, are repeated throughout. The others
are brought together by anchor with their bytes, and the suffixes that start in them are sorted, cut at LENGTH bytes:
a mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial
hashes, in a number of steps that grows with the logarithm of LENGTH. Neighbours in the order that extend over LENGTH are repeated; their bytes are compared
to rule out collisions.

The contexts of an anchor are a family. A family too large for one sort is halved by where the anchor stands in a string: the strings of either
half share more bytes around the anchor, so each half parts by these into families of its own, and so on; parts that are equal whole are repeated.
A halving writes contexts, never strings, and after log2(LENGTH) of them a family holds equal strings alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import cut, discard, ship, tidy
from braidlake.llm.textbytes import PrefixHash, binary, mix

#: A string of LENGTH bytes that starts twice is repeated; anchors are k-grams of ANCHOR bytes.
LENGTH, ANCHOR = 200, 64
#: Contexts sorted together, and contexts of the largest family that is sorted without being halved.
BUCKET, MANY = 1024, 256
#: Bytes that are worked on at once.
SLICE = 1 << 20
_PLACE = (1 << 23) - 1


def pieces(bounds: np.ndarray, length: int, most: int = SLICE) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, from, to) with ``most`` bytes together or so; long rows come in parts that share length - 1 bytes."""
    held, size = [], 0
    for row in range(len(bounds) - 1):
        a, end = int(bounds[row]), int(bounds[row + 1])
        while end - a >= length:
            b = min(end, a + most + length - 1)
            if held and size + b - a > most:
                yield held
                held, size = [], 0
            held.append((row, a, b))
            size += b - a
            if b == end:
                break
            a = b - length + 1
    if held:
        yield held


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def digests(data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """Two 64-bit halves of a digest of each span of some bytes."""
    view = memoryview(data)
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in spans]), dtype="<i8").reshape(-1, 2)


def contexts(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """For each anchor occurrence: row, first start of its strings in the row, number of starts, the anchor's place after that start, its hash, the context's digest."""
    for held in pieces(bounds, length):
        part = np.concatenate([data[a:b] for _, a, b in held])
        edge = np.cumsum([0] + [b - a for _, a, b in held])
        sums = PrefixHash(part, 0)
        at = np.arange(len(part) - anchor + 1)
        grams = mix(sums.of(at, at + anchor))
        # the last of equal hashes is the least: the place within the part is turned round in the low bits
        tagged = (grams & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - at.astype(np.uint64))
        least = np.uint64(_PLACE) - (window_least(tagged, length - anchor + 1) & np.uint64(_PLACE))
        whole = np.ones(len(least), dtype=bool)  # strings that lie within one row
        for e in edge[1:-1]:
            whole[max(0, e - length + 1) : e] = False
        new = whole & np.concatenate(([True], (least[1:] != least[:-1]) | ~whole[:-1]))
        start = np.flatnonzero(new)
        last = np.flatnonzero(whole & np.concatenate((new[1:] | ~whole[1:], [True])))
        of = np.searchsorted(edge, start, side="right") - 1
        rows, offsets = np.array([r for r, _, _ in held])[of], np.array([a - int(bounds[r]) for r, a, _ in held])[of]
        place = least[start].astype(np.int64)
        told = digests(part.tobytes(), list(zip(start.tolist(), (last + length).tolist(), strict=True)))
        yield rows, offsets + start - edge[of], last - start + 1, place - start, grams[place], told


class HashedText:
    """Common extensions of suffixes of a buffer, each ended where its context ends."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.hashes = [PrefixHash(data, 0), PrefixHash(data, 1)]

    def equal(self, i: np.ndarray, j: np.ndarray, n) -> np.ndarray:
        return np.logical_and.reduce([h.of(i, i + n) == h.of(j, j + n) for h in self.hashes])

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes have in common, up to ``length``, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), dtype=np.int64), np.full(len(i), self.length, dtype=np.int64)
        whole = self.equal(i, j, high)
        low[whole] = self.length
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_], j[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes after suffix j."""
        n = self.extension(i, j)
        at = np.minimum(n, self.length - 1)
        return (n < self.length) & (self.data[i + at] > self.data[j + at])

    def sort(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes by group and then by their bytes: a mergesort that merges the runs of all groups in step."""
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1], [True])))
        starts, ends = edges[:-1], edges[1:]
        width, most = 1, int((ends - starts).max()) if len(starts) else 0
        while width < most:
            left, right, stop = [], [], []
            for off in range(0, most, 2 * width):
                live = starts + off + width < ends
                left.append(starts[live] + off)
                right.append(starts[live] + off + width)
                stop.append(np.minimum(starts[live] + off + 2 * width, ends[live]))
            i, r, e = np.concatenate(left), np.concatenate(right), np.concatenate(stop)
            out, o, j, middle = order.copy(), i.copy(), r.copy(), r
            while len(i):
                both = (i < middle) & (j < e)
                take_right = i >= middle
                if both.any():
                    take_right[both] = self.after(suffixes[order[i[both]]], suffixes[order[j[both]]])
                out[o] = order[np.where(take_right, np.minimum(j, e - 1), np.minimum(i, middle - 1))]
                j, i, o = j + take_right, i + ~take_right, o + 1
                more = o < e
                i, j, o, e, middle = i[more], j[more], o[more], e[more], middle[more]
            order = out
            width *= 2
        return order


def repeated_starts(texts: list[bytes], groups: np.ndarray, lead: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its strings also start in another context of its group.

    ``lead``: the anchor's place in the context. Equal strings have their anchor at an equal place, so the suffixes of a group that start equally far
    before the anchor are sorted together.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    base = np.concatenate(([0], np.cumsum(size)))[:-1]
    count = size - length + 1
    owner = np.repeat(np.arange(len(texts)), count)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    _, dense = np.unique(groups, return_inverse=True)
    family = dense[owner] * 4 * length + (lead[owner] - within + length)
    values, inverse, many = np.unique(family, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(many[inverse] > 1)
    flags = np.zeros(len(owner), dtype=bool)
    if shared.size:
        text = HashedText(data, length)
        suffixes = base[owner[shared]] + within[shared]
        order = text.sort(suffixes, inverse[shared])
        left, right = order[:-1], order[1:]
        near = np.flatnonzero((inverse[shared][left] == inverse[shared][right]))
        near = near[text.extension(suffixes[left[near]], suffixes[right[near]]) == length]
        for k in near.tolist():
            a, b = int(suffixes[left[k]]), int(suffixes[right[k]])
            if data[a : a + length].tobytes() == data[b : b + length].tobytes():
                flags[shared[left[k]]] = flags[shared[right[k]]] = True
    ends = np.cumsum(count)
    return [flags[e - c : e] for e, c in zip(ends, count, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of true values."""
    padded = np.concatenate(([False], flags, [False])).astype(np.int8)
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _occurrences(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, bounds = binary(batch.column(1))
            for rows, start, count, lead, h, told in contexts(data, bounds, length, anchor):
                columns = [h.view(np.int64), told[:, 0], told[:, 1], keys[rows], start.astype(np.int64), count.astype(np.int32), lead.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "f", "g", "key", "start", "count", "lead"])

    return run


#: Contexts with their bytes: of family ``fam``, whose strings have their anchor at ``low`` to ``high``; ``done`` if known to be repeated whole.
PARTS = "fam long, low int, high int, f long, g long, key long, start long, lead int, done boolean, bytes binary"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], [x.split()[0] for x in PARTS.split(", ")])


def _cut_out(length: int, anchor: int):
    """Rows (key, text, wanted) to PARTS, a piece of a row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            data, bounds = binary(batch.column(1))
            for k, (key, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                raw = data[bounds[k] : bounds[k + 1]]
                for w in wanted.as_py():
                    found = raw[w["start"] : w["start"] + w["count"] - 1 + length].tobytes()
                    out.append((w["h"], 0, length - anchor, w["f"], w["g"], key, w["start"], w["lead"], w["copies"] > 1, found))
                    if len(out) == 4096:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    return run


def halves(low: int, high: int, lead: int, text: bytes, length: int):
    """Of a context whose strings have their anchor at ``low`` to ``high``: (low, high, shared bytes, first start, last start) of its halves that have strings."""
    middle = (low + high + 1) // 2
    first, last = lead, lead - (len(text) - length)  # the anchor's places in the first and in the last string
    for a, b in ((low, middle - 1), (middle, high)):
        if first >= a and last <= b:
            yield a, b, text[lead - a : lead - b + length], max(0, lead - b), min(len(text) - length, lead - a)


def _halved(length: int):
    """PARTS to the PARTS of their halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
        for batch in batches:
            out = []
            for fam, low, high, _, _, key, start, lead, done, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, shared, s, e in halves(low, high, lead, text, length):
                    part = text[s : e + length]
                    f, g = digests(part, [(0, len(part))])[0].tolist()
                    out.append((short(b"%d %d %d " % (fam, a, b) + shared), a, b, f, g, key, start + s, lead - s, done, part))
            yield _batch(out)

    return run


def _sorted(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "start"], kind="stable")
        flags = repeated_starts(rows["bytes"].tolist(), rows["fam"].to_numpy(), rows["lead"].to_numpy(), length)
        out = []
        for key, start, done, found in zip(rows["key"].tolist(), rows["start"].tolist(), rows["done"].tolist(), flags, strict=True):
            if not done:
                out += [(key, start + a, start + b + length) for a, b in zip(*map(np.ndarray.tolist, runs(found)), strict=True)]
        return pd.DataFrame(out, columns=["key", "a", "b"]).astype("int64")

    return run


def _open(parts: DataFrame) -> DataFrame:
    """``parts`` of families that hold several, one of them not known to be repeated; with the family's size ``many``."""
    sizes = parts.groupBy(F.col("fam").alias("of")).agg(F.count(F.lit(1)).alias("many"), F.min("done").alias("all_done"))
    sizes = cut(sizes.filter((F.col("many") > 1) & ~F.col("all_done")).select("of", "many"), "families")
    out = cut(parts.join(sizes, F.col("fam") == F.col("of")).drop("of"), "open")
    discard(sizes)
    return out


def repeated_spans(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(key, a, b): byte spans of the rows of (key long, text) that repeated strings cover; spans may overlap."""
    every = cut(rows.select("key", "text").mapInArrow(tidy(_occurrences(length, anchor)), "h long, f long, g long, key long, start long, count int, lead int"), "anchors")
    # written, so that the join below deals both sides anew and Spark can split an anchor with very many occurrences
    twice = cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(F.col("h").alias("of")), "twice")
    found = cut(every.join(twice, F.col("h") == F.col("of"), "left_semi"), "repeated_anchors")
    discard(every, twice)
    # contexts of an anchor, with how often each occurs whole and one of its occurrences
    kinds = cut(found.groupBy("h", "f", "g").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start", "count", "lead")).alias("at")), "contexts")
    whole = kinds.filter(F.col("copies") > 1).select(F.col("h").alias("wh"), F.col("f").alias("wf"), F.col("g").alias("wg"))
    spans = found.join(whole, (F.col("h") == F.col("wh")) & (F.col("f") == F.col("wf")) & (F.col("g") == F.col("wg")), "left_semi")
    spans = spans.select("key", F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + length).alias("b"))
    # anchors with several contexts of which one occurs once: these need their bytes
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min("copies").alias("least")).filter((F.col("many") > 1) & (F.col("least") == 1))
    wanted = kinds.join(cut(several.select(F.col("h").alias("sh")), "several"), F.col("h") == F.col("sh"), "left_semi")
    asked = F.struct("h", "f", "g", "at.start", "at.count", "at.lead", "copies")
    wanted = wanted.groupBy(F.col("at.key").alias("k")).agg(F.collect_list(asked).alias("wanted"))
    texts = rows.join(wanted, F.col("key") == F.col("k")).select("key", "text", "wanted")
    parts = _open(cut(texts.mapInArrow(tidy(_cut_out(length, anchor)), PARTS), "parts"))
    small = []
    while True:
        small.append(parts.filter(F.col("many") <= MANY).select("fam", "key", "start", "lead", "done", "bytes"))
        large = parts.filter(F.col("many") > MANY).drop("many")
        if large.isEmpty():
            break
        large = cut(large.mapInArrow(tidy(_halved(length)), PARTS), "halves")
        # parts of a family that are equal whole are repeated, and one of them goes on for all
        equal = cut(large.groupBy("fam", "f", "g").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start")).alias("at")), "equal")
        same = (F.col("fam") == F.col("ofam")) & (F.col("f") == F.col("of")) & (F.col("g") == F.col("og"))
        more = equal.filter(F.col("copies") > 1).select(F.col("fam").alias("ofam"), F.col("f").alias("of"), F.col("g").alias("og"))
        spans = spans.unionByName(
            large.filter(~F.col("done")).join(more, same, "left_semi").select("key", F.col("start").alias("a"), (F.col("start") + F.length("bytes")).alias("b"))
        )
        one = equal.select(F.col("fam").alias("ofam"), F.col("f").alias("of"), F.col("g").alias("og"), "copies", "at")
        first = same & (F.col("key") == F.col("at.key")) & (F.col("start") == F.col("at.start"))
        parts = large.join(one, first).withColumn("done", F.col("done") | (F.col("copies") > 1)).select(*[x.split()[0] for x in PARTS.split(", ")])
        parts = _open(parts)
    few = small[0]
    for more in small[1:]:
        few = few.unionByName(more)
    buckets = max(1, few.count() // BUCKET)
    partial = few.withColumn("bucket", F.pmod(F.xxhash64("fam"), F.lit(buckets))).groupBy("bucket").applyInPandas(_sorted(length), "key long, a long, b long")
    return spans.unionByName(partial)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, keep: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers, in any document or the same one.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep`` kept_text (without the rest of characters
    that a removed run cuts) and spans (array of from, to); ``carry`` names columns to pass on. Null texts are empty. Texts under ``length`` bytes keep everything. Rows that repeat a text repeat its strings, whatever their
    ids. Rows are told apart by a 64-bit hash of id and text; null ids pass through; an empty table gives an empty
    result; other columns are left out.
    """
    ship(docs.sparkSession)
    passed = [F.col(c).alias(f"carried_{c}") for c in carry]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *passed)
    rows = rows.withColumn("key", F.xxhash64("text", "doc_id"))
    spans = repeated_spans(rows.filter(F.octet_length("text") >= length).select("key", "text"), length, anchor)
    spans = spans.distinct().groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = binary(batch.column(1))
            n, removed, count, digests, left, at = [], [], [], [], [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                raw = data[bounds[k] : bounds[k + 1]].tobytes()
                out = merged([(s["a"], s["b"]) for s in spans or []])
                rest, last = [], 0
                for a, b in out:
                    rest.append(raw[last:a])
                    last = b
                rest = b"".join([*rest, raw[last:]])
                n.append(len(raw))
                removed.append(len(raw) - len(rest))
                count.append(len(out))
                digests.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode("utf-8", "ignore") if keep else None)
                at.append([{"a": a, "b": b} for a, b in out] if keep else None)
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())]
            columns.append(pa.array(at, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3:]], [*names, *carry])

    kind = rows.schema["doc_id"].dataType.simpleString()
    also = "".join(f", `{c}` {rows.schema[f'carried_{c}'].dataType.simpleString()}" for c in carry)
    out = rows.join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "text", "spans", *(f"carried_{c}" for c in carry))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<a:long,b:long>>{also}"
    out = out.mapInArrow(tidy(kept), schema)
    return out if keep else out.drop("kept_text", "spans")
