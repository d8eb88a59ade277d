"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the hashes of its distinct word shingles. Tokens fall into classes by how many documents hold them: rare
ones, which are indexed singly, frequent ones, indexed by pairs, and very frequent ones, indexed by triples. Frequent classes are cut
into groups by hash, and a combination lies within one group. All documents order tokens alike, rare ones first. A prefix
that goes on until it holds n - t + 1 tokens beyond those that a combination costs (k - 1 for each group of a class indexed by k) shares a
combination with the prefix of every set that has t tokens in common. So a key stands over few documents unless these are alike.

The class of a token decides the cost alone, never the result. It is read from two bitmaps of fixed size, so tokens that share a
bit with a frequent one count as frequent.

The keys under which one document is the first are taken together as its group; documents of a group meet as sketches: bit h mod m of a set's parity says whether an odd number of its tokens hash there, so two sets
differ in at least as many tokens as their parities differ in bits. Of the pairs that this leaves, those that join two components of a group are
verified on whole sets, by an independent second hash of the texts. The groups of which a pair fails meet again, now with their documents' tokens in 24 bits each
beside the sketches, so that almost no pair is left that is not similar; should one fail again, another 24 bits are taken, until none does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.common import cut, discard, ship, tidy
from braidlake.llm.components import connected_components
from braidlake.llm.textbytes import binary, mix, shingle_sets

#: Similar: PERCENT * union <= 100 * intersection.
SHINGLE_WORDS, PERCENT = 4, 85
#: A token is counted where a task meets it LOCAL times among FLUSH tokens; it is frequent from PAIRS such counts, very frequent from TRIPLES.
LOCAL, FLUSH, PAIRS, TRIPLES = 8, 1 << 21, 128, 4096
#: Bits of each bitmap of frequent tokens.
MARKS = 1 << 22
#: Documents of a group that are compared in one piece.
BLOCK = 2048
#: Bytes of texts that are verified at once, and documents compared with a first one in one piece.
SLICE, LED = 1 << 20, 4096


def needed(n: int, percent: int) -> int:
    """The least intersection of a set of n with one that is similar to it."""
    return -(-percent * n // 100)


def class_groups(level: int) -> dict[int, int]:
    """For sets of 2^level to 2^(level + 1) - 1 tokens: groups of the tokens indexed by pairs and, from 32 tokens on, by triples."""
    size = 1 << level
    return {2: max(1, size // 16)} | ({3: size // 12} if level >= 5 else {})


@lru_cache(maxsize=4096)
def _ways(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k).T


def _marked(tokens: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bit = tokens & np.uint64(len(marks) * 64 - 1)
    return (marks[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def prefix_keys(tokens: np.ndarray, marks: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The keys under which a set of distinct tokens is indexed; ``marks``: bitmaps of frequent and of very frequent tokens."""
    n = len(tokens)
    if not n:
        return tokens
    need = n - needed(n, percent) + 1
    order = mix(tokens)
    often = _marked(tokens, marks[0])
    rare = order[~often]
    if len(rare) >= need:
        return np.partition(rare, need - 1)[:need]
    out = [rare]
    very = _marked(tokens, marks[1])[often]
    rest = order[often]
    by = np.lexsort((rest, very))
    rest, very = rest[by], very[by]
    level = n.bit_length() - 1
    # sets of the next level can be similar to this one: then it has keys of that level too
    for scheme in [level, level + 1] if 100 * n >= percent * (1 << (level + 1)) else [level]:
        groups = class_groups(scheme)
        k = np.where(very & (3 in groups), 3, 2)
        spread = rest >> np.uint64(20)
        of = np.where(k == 3, spread % np.uint64(groups.get(3, 1)) + np.uint64(groups[2]), spread % np.uint64(groups[2])).astype(np.int64)
        # a token's place in its group: the first k - 1 of a group make no combination
        by = np.argsort(of, kind="stable")
        first = np.concatenate(([True], of[by][1:] != of[by][:-1]))
        nth = np.empty(len(of), dtype=np.int64)
        nth[by] = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        gain = np.cumsum(nth >= k - 1)
        end = int(np.searchsorted(gain, need - len(rare))) + 1
        taken, of, k = rest[:end], of[:end], k[:end]
        by = np.argsort(of, kind="stable")
        taken, of, k = taken[by], of[by], k[by]
        edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            size = int(k[a])
            if b - a >= size:
                key = np.full(1, scheme * 4 + size, dtype=np.uint64)
                for row in _ways(b - a, size):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + taken[a + row])
                out.append(key)
    return np.concatenate(out)


def parity(tokens: np.ndarray) -> bytes:
    """The parity of a set in 2 to 4 bits a token, at least 64; one of twice the bits folds into it by exclusive or of its halves."""
    bits = max(64, 4 << (max(len(tokens), 1).bit_length() - 1))
    places = (mix(tokens ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sizes and parities of some sets; which of them may be similar to one of them."""

    def __init__(self, n: np.ndarray, parities: list[bytes], percent: int):
        self.n, self.percent = n.astype(np.int64), percent
        self.words = np.array([len(p) // 8 for p in parities])
        self.at = np.zeros(len(n), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.halves: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            rows = self.rows[w] = np.flatnonzero(self.words == w)
            self.at[rows] = np.arange(len(rows))
            self.own[w] = np.frombuffer(b"".join([parities[r] for r in rows.tolist()]), dtype="<u8").reshape(-1, w)
            if w > 1:
                self.halves[w] = self.own[w][:, : w // 2] ^ self.own[w][:, w // 2 :]

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which parities differ, -1 where these or the sizes prove sets not similar."""
        out = np.full(len(others), -1, dtype=np.int64)
        w = int(self.words[i])
        n, p = int(self.n[i]), self.percent
        for kind in (w // 2, w, 2 * w):
            if kind not in self.rows:
                continue
            here = np.flatnonzero(self.words[others] == kind)
            if not here.size:
                continue
            m = self.n[others[here]]
            here = here[100 * np.minimum(m, n) >= p * np.maximum(m, n)]
            at = self.at[others[here]]
            if kind == w:
                bits = self.own[w][at] ^ self.own[w][self.at[i]]
            elif kind < w:
                bits = self.own[kind][at] ^ self.halves[w][self.at[i]]
            else:
                bits = self.halves[kind][at] ^ self.own[w][self.at[i]]
            apart = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            both = self.n[others[here]] + n
            out[here] = np.where(apart <= both + 2 * (-p * both // (100 + p)), apart, -1)
        return out


class Exact:
    """Tokens of some sets in 24 bits each; of which of them an intersection may be large enough. Tokens that fall together only add to it."""

    def __init__(self, n: np.ndarray, packed: list[bytes], percent: int):
        self.n, self.percent = n.astype(np.int64), percent
        self.ends = np.cumsum([len(p) // 3 for p in packed])
        raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
        self.tokens = raw[:, 0] | (raw[:, 1] << np.uint32(8)) | (raw[:, 2] << np.uint32(16))

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i - 1] if i else 0 : self.ends[i]]

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        own = np.sort(self.of(i))
        parts = [self.of(j) for j in others.tolist()]
        every = np.concatenate(parts)
        held = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        edges = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
        both = np.add.reduceat(held.astype(np.int64), edges)
        return 100 * both >= self.percent * (self.n[others] + self.n[i] - both)


def short_tokens(tokens: np.ndarray, salt: int) -> bytes:
    """24 bits of each token's hash under a salt."""
    raw = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D * (salt + 1) & ((1 << 64) - 1))).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :3]).tobytes()


def joining_pairs(ids: list, comps: list, n: np.ndarray, parities: list[bytes], asks: np.ndarray, percent: int, packed: list[bytes] | None = None) -> list[tuple]:
    """Pairs of places that join components of the documents under a key, the first document's first; one of each pair ``asks``.

    A pair that sketches and, if given, ``packed`` tokens do not rule out counts as a link, and only pairs that join more are given.
    """
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sketches, exact = Sketches(n, parities, percent), None if packed is None else Exact(n, packed, percent)
    dense = {c: k for k, c in enumerate(dict.fromkeys(comps[k] for k in order))}
    comp = np.array([dense[c] for c in comps], dtype=np.int64)
    place = np.array(order, dtype=np.int64)
    out: list[tuple] = []
    for turn, i in enumerate(order):
        if not asks[i]:
            continue
        others = np.concatenate((place[:turn][~asks[place[:turn]]], place[turn + 1 :]))
        others = others[comp[others] != comp[i]]
        if not others.size:
            if (comp == comp[0]).all():
                break
            continue
        others = others[sketches.distances(i, others) >= 0]
        if exact is not None and others.size:
            others = others[exact.similar(i, others)]
        for j in others.tolist():
            if comp[i] != comp[j]:
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return out


def _sets(column, n: int, which: int = 0):
    data, bounds = binary(column)
    return shingle_sets(data, bounds, n, which)


def frequent_marks(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the tokens that many documents hold, and of those that very many hold, counted over all documents.

    A token's bit is its last bits, so a bitmap has MARKS bits at any size of the input.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], ["token", "n"])

        total = 0
        for batch in batches:
            for tokens in _sets(batch.column(0), n):
                held.append(tokens)
                total += len(tokens)
                if total >= FLUSH:
                    total = 0
                    yield flush()
        if held:
            yield flush()

    often = docs.select("text").mapInArrow(tidy(counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= PAIRS)
    bit = F.col("token").bitwiseAND(F.lit(MARKS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    word = often.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(one).alias("pairs"), F.bit_or(F.when(F.col("n") >= TRIPLES, one).otherwise(F.lit(0).cast("long"))).alias("triples"))
    marks = np.zeros((2, MARKS // 64), dtype=np.int64)
    for at, pairs, triples in word.collect():  # MARKS / 64 rows at most
        marks[:, at] = pairs, triples
    return marks[0].view(np.uint64), marks[1].view(np.uint64)


def indexed(docs: DataFrame, n: int, percent: int, marks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, f1, f2, parity, keys, packed) of every row: its set's size, fingerprint of two independent hashes, parity and keys, and its text compressed."""

    told = docs.sparkSession.sparkContext.broadcast(marks)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            sizes, one, two, odd, keys, packed = [], [], [], [], [], []
            data, bounds = binary(batch.column(1))
            for k, (tokens, again) in enumerate(zip(shingle_sets(data, bounds, n), shingle_sets(data, bounds, n, 1), strict=True)):
                sizes.append(len(tokens))
                one.append(int(np.bitwise_xor.reduce(mix(tokens ^ np.uint64(0xA0761D6478BD642F))) if len(tokens) else 0))
                two.append(int(np.add.reduce(mix(again + np.uint64(0xE7037ED1A0B428DB))) if len(again) else 0))
                odd.append(parity(tokens))
                keys.append(prefix_keys(tokens, told.value, percent).view(np.int64))
                packed.append(squeeze(data[bounds[k] : bounds[k + 1]].tobytes()))
            starts = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            whole = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), whole(one), whole(two), pa.array(odd, pa.binary()), lists, pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "f1", "f2", "parity", "keys", "packed"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(tidy(sketched), f"id {kind}, n long, f1 long, f2 long, parity binary, keys array<long>, packed binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _led(percent: int):
    """Rows (group, u, v, n_u, p_u, n_v, p_v) to those pairs (group, u, v) that their sketches leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_u, p_u, n_v, p_v = (batch.column(k).to_pylist() for k in range(3, 7))
            keep = [int(Sketches(np.array([a, b]), [p, q], percent).distances(0, np.array([1]))[0]) >= 0 for a, p, b, q in zip(n_u, p_u, n_v, p_v, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)], ["group", "u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def likely_places(comps: list, n: np.ndarray, parities: list[bytes], asks: np.ndarray, percent: int) -> list[int]:
    """Places of the documents that their sketches let be similar to one of another component; one of the two asks."""
    sketches, comp = Sketches(n, parities, percent), np.array(comps, dtype=np.int64)
    out = np.zeros(len(comp), dtype=bool)
    for i in np.flatnonzero(asks).tolist():
        others = np.flatnonzero(comp != comp[i])
        others = others[sketches.distances(i, others) >= 0]
        out[others] = True
        out[i] |= bool(others.size)
    return np.flatnonzero(out).tolist()


def _pieces(each, names: list[str]):
    """An Arrow function over rows (group, row, col, ...), those of a (group, row, col) one after another: ``each`` gives whole numbers of a table of whole pieces."""

    def found(table: pa.Table) -> pa.RecordBatch:
        rows = list(each(table))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            marks = [table.column(k).to_numpy() for k in range(3)]
            other = np.flatnonzero(np.logical_or.reduce([m != m[-1] for m in marks])) if len(table) else np.zeros(0, np.int64)
            end = int(other[-1]) + 1 if other.size else 0
            held = table.slice(end)
            yield found(table.slice(0, end))
        if held is not None and len(held):
            yield found(held)

    return tidy(run)


def _edges(table: pa.Table) -> Iterator[tuple[int, int]]:
    g, row, col = (table.column(k).to_numpy() for k in range(3))
    at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1]), [True])))
    return ((a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a > 1)


def _likely(percent: int):
    """Rows (group, row, col, node, comp, n, parity, asks, exact) to the (group, node) that may be similar to one of another component."""

    def each(table: pa.Table) -> Iterator[tuple]:
        g, ids, comps, odd = (table.column(k).to_pylist() for k in (0, 3, 4, 6))
        n, asks = table.column(5).to_numpy(), table.column(7).to_numpy()
        for a, b in _edges(table):
            for k in likely_places(comps[a:b], n[a:b], odd[a:b], asks[a:b], percent):
                yield g[a], ids[a + k]

    return _pieces(each, ["group", "node"])


def _candidates(percent: int):
    """Rows (group, row, col, node, comp, n, parity, asks, exact) to pairs (group, u, v)."""

    def whole(table: pa.Table) -> Iterator[tuple]:
        g = table.column(0).to_numpy()
        ids, comps, odd, packed = (table.column(k).to_pylist() for k in (3, 4, 6, 8))
        n, asks = table.column(5).to_numpy(), table.column(7).to_numpy()
        for a, b in _edges(table):
            # a document that both asks and is asked may stand here twice: once, as one that asks
            last = {}
            for k in range(a, b):
                if ids[k] not in last or asks[k]:
                    last[ids[k]] = k
            rows = list(last.values())
            tokens = None if packed[a] is None else [packed[k] for k in rows]
            for i, j in joining_pairs([ids[k] for k in rows], [comps[k] for k in rows], n[rows], [odd[k] for k in rows], asks[rows], percent, tokens):
                yield int(g[a]), *sorted((ids[rows[i]], ids[rows[j]]))

    return _pieces(whole, ["group", "u", "v"])


def _shortened(n: int, salt: int):
    """Rows (row, packed) to (row, exact): a text's tokens in 24 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = [short_tokens(next(_sets(pa.array([expand(z.as_py())], pa.large_binary()), n)), salt) for z in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["row", "exact"])

    return run


def _verify(n: int, percent: int):
    """Rows (u, part, v, packed), the row of a null v first for each (u, part), to the pairs (u, v) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        last, leads = None, []
        for batch in batches:
            us, parts, vs, packed = (batch.column(k) for k in range(4))
            us, parts, vs = us.to_pylist(), parts.to_pylist(), vs.to_pylist()
            keep, at = [False] * len(us), 0
            while at < len(us):
                texts, size, end = [], 0, at
                while end < len(us) and (size < SLICE or end == at):
                    texts.append(expand(packed[end].as_py()))
                    size += len(texts[-1])
                    end += 1
                for k, tokens in zip(range(at, end), _sets(pa.array(texts, pa.large_binary()), n, 1), strict=True):
                    if (us[k], parts[k]) != last:
                        last, leads = (us[k], parts[k]), []
                    if vs[k] is None:
                        leads.append(tokens)
                    else:
                        keep[k] = any(similar(lead, tokens, percent) for lead in leads)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v), distinct, that are similar. A text travels to each of its partners; partners of one document go in parts of about LED."""
    many = cut(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(LED)).alias("parts")), "parts")
    parted = pairs.join(many.withColumnRenamed("u", "of"), F.col("u") == F.col("of")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"))
    sides = many.select(F.col("u").alias("side")).unionByName(pairs.select(F.col("v").alias("side"))).distinct()
    texts = cut(base.select("row", "packed").join(sides, F.col("row") == F.col("side"), "left_semi"), "texts")
    asked = parted.join(texts, F.col("v") == F.col("row")).select("u", "part", "v", "packed")
    leads = many.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(texts, F.col("u") == F.col("row"))
    rows = asked.unionByName(leads.select("u", "part", F.lit(None).cast("long").alias("v"), "packed"))
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    out = cut(rows.mapInArrow(tidy(_verify(words, percent)), "u long, v long"), "links")
    discard(many, texts)
    return out


def _units(members: DataFrame, mains: DataFrame | None) -> DataFrame:
    """Members (group, m, node, comp, n, parity, exact) with (row, col, asks): the pieces in which the documents of a group are compared.

    ``mains`` has (g, all, some, main): how many documents a group has, how many of them are outside the component of its first one, and that one; None if every
    document is its own. Documents outside it ask and all of a group are asked; a group of over BLOCK documents is a grid of pieces.
    """
    zero = F.lit(0).cast("long")
    columns = ["group", "row", "col", "node", "comp", "n", "parity", "asks", "exact"]
    if mains is None:
        placed = members.withColumns({"all": F.col("m"), "some": F.col("m"), "main": F.lit(-1).cast("long")})
    else:
        placed = members.join(mains, F.col("group") == F.col("g"))
    minor = F.col("comp") != F.col("main")
    single = placed.filter(F.col("all") <= BLOCK).withColumns({"row": zero, "col": zero, "asks": minor})
    across, down = F.ceil(F.col("all") / F.lit(BLOCK)), F.ceil(F.col("some") / F.lit(BLOCK))
    upto = lambda c: F.explode(F.sequence(zero, c - 1))
    grid = placed.filter(F.col("all") > BLOCK)
    held = grid.withColumn("col", F.pmod(F.xxhash64("node"), across)).withColumn("row", upto(down)).withColumn("asks", F.lit(False))
    ask = grid.filter(minor).withColumn("row", F.pmod(F.xxhash64(F.lit(1), "node"), down)).withColumn("col", upto(across)).withColumn("asks", F.lit(True))
    units = single.select(columns).unionByName(held.select(columns)).unionByName(ask.select(columns))
    return units.repartition("group", "row", "col").sortWithinPartitions("group", "row", "col")


def main_components(members: DataFrame) -> DataFrame:
    """(g, all, some, main) of the groups of members: see ``_units``."""
    first = F.max(F.when(F.col("node") == F.col("group"), F.col("comp")))
    comps = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("n"), first.alias("own"))
    # where the first document is not among the members any more, any component will do
    main = F.coalesce(F.max("own").over(Window.partitionBy("group")), F.min("comp").over(Window.partitionBy("group")))
    comps = comps.withColumn("main", main).groupBy(F.col("group").alias("g")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("n")).otherwise(0)).alias("some"), F.max("main").alias("main"))
    return comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links reach, its own included), set_id.

    ``set_id`` is the smallest id with the very same set. Null and empty texts have empty sets and link with nothing. Rows, not ids, are linked:
    rows that repeat an id have the component of their own text, and a row of null id links like any other; nulls are no
    smallest id, so its component is null only if no row that it reaches has an id. An empty table gives an empty result; other columns are left out.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = cut(indexed(rows, words, percent, frequent_marks(rows, words)).withColumn("row", F.monotonically_increasing_id()), "keys")
    # rows with the same set are one from here on
    classes = cut(base.filter(F.col("n") > 0).groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.min("row").alias("node")), "classes")
    own = cut(base.select("row", "n", "parity", "keys").join(classes.select("node"), F.col("row") == F.col("node"), "left_semi"), "own")
    keyed = own.select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    # the keys of one first document are taken together: near copies share many keys, and so meet there once
    firsts = keyed.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("group")).filter(F.col("m") > 1).select("of", "group")
    met = keyed.join(firsts, F.col("key") == F.col("of")).select("group", "node").distinct()
    # a document goes on in a group if another there is of about its size: similar sets are of one class of sizes or of neighbouring ones
    size = F.floor(F.ln("n") / F.lit(1.000001 * math.log(100 / percent))) if percent < 100 else F.col("n")
    met = cut(met.join(own.select("row", "n"), F.col("node") == F.col("row")).select("group", "node", size.alias("size")), "met")
    about = met.groupBy("group", "size").agg(F.count(F.lit(1)).alias("c")).select(F.col("group").alias("g"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("s"), "c")
    about = about.groupBy("g", "s").agg(F.sum("c").alias("c")).filter(F.col("c") > 1).select("g", "s")
    light = cut(met.join(about, (F.col("group") == F.col("g")) & (F.col("size") == F.col("s")), "left_semi").select("group", "node"), "light")
    sizes = light.groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("m"))
    members = light.join(sizes, F.col("group") == F.col("g")).join(own.select("row", "n", "parity"), F.col("node") == F.col("row"))
    members = cut(members.select("group", "m", "node", "n", "parity", F.col("node").alias("comp")), "members")
    discard(met, light, own)
    links = cut(docs.sparkSession.createDataFrame([], "u long, v long"), "links")
    tested, found = links, None

    def told(pairs: DataFrame) -> None:
        """Verify the ``pairs`` (group, u, v, ...) that are new, and join components by those that are similar."""
        nonlocal links, tested, found
        new = cut(pairs.select("u", "v").distinct().join(tested, ["u", "v"], "left_anti"), "new")
        tested, links = tested.unionByName(new), links.unionByName(verified(new, base, words, percent))
        discard(found)
        found = connected_components(links, "u", "v")

    def apart(rows: DataFrame) -> DataFrame:
        """Those ``rows`` of members whose group holds several components, with these as they now are."""
        now = rows.drop("comp").join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        now = now.select("group", "m", "node", "n", "parity", F.coalesce("component", "node").alias("comp"))
        several = now.groupBy(F.col("group").alias("g")).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter(F.col("c1") != F.col("c2"))
        out = cut(now.join(several.select("g"), F.col("group") == F.col("g"), "left_semi"), "apart")
        discard(rows)
        return out

    large = members.filter(F.col("m") > BLOCK)
    mains = None
    if not large.isEmpty():
        # of a group of many documents, first all with the first one: most are like it as a rule
        leaders = large.filter(F.col("node") == F.col("group")).select(F.col("group").alias("led"), F.col("n").alias("n_u"), F.col("parity").alias("p_u"))
        near = large.filter(F.col("node") != F.col("group")).join(leaders, F.col("group") == F.col("led"))
        near = near.select("group", F.col("group").alias("u"), F.col("node").alias("v"), "n_u", "p_u", F.col("n").alias("n_v"), F.col("parity").alias("p_v"))
        pairs = cut(near.mapInArrow(tidy(_led(percent)), "group long, u long, v long"), "pairs")
        told(pairs)
        discard(pairs)
        members = apart(members)
        mains = cut(main_components(members), "mains")
    salt, exact = 0, None
    while True:
        if exact is None:
            units = _units(members.withColumn("exact", F.lit(None).cast("binary")), mains)
        else:
            units = _units(members.join(exact, F.col("node") == F.col("row")).drop("row"), mains)
        pairs = cut(units.mapInArrow(_candidates(percent), "group long, u long, v long"), "pairs")
        told(pairs)
        # a group of which no pair failed is done: its documents' components are as its pairs made them
        again = pairs.join(links, ["u", "v"], "left_anti").select(F.col("group").alias("left")).distinct()
        again = cut(again, "again")
        discard(pairs, mains, exact)
        if again.isEmpty():
            break
        old, members = members, apart(cut(members.join(again, F.col("group") == F.col("left"), "left_semi"), "open"))
        discard(old)
        mains = cut(main_components(members), "mains")
        # tokens travel only for documents that may be similar to one of another component
        few = _units(members.withColumn("exact", F.lit(None).cast("binary")), mains).mapInArrow(_likely(percent), "group long, node long")
        few = cut(few.distinct().select(F.col("group").alias("fg"), F.col("node").alias("fn")), "likely")
        old, members = members, cut(members.join(few, (F.col("group") == F.col("fg")) & (F.col("node") == F.col("fn")), "left_semi"), "few")
        discard(old, few)
        some = members.select(F.col("node").alias("asked")).distinct()
        exact = base.select("row", "packed").join(some, F.col("row") == F.col("asked"), "left_semi")
        exact = cut(exact.mapInArrow(tidy(_shortened(words, salt)), "row long, exact binary"), "exact")
        salt += 1
    rooted = classes.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    rooted = cut(rooted.select("n", "f1", "f2", "rep", F.coalesce("component", "node").alias("root")), "rooted")
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id"))
    sets = rooted.join(least, F.col("root") == F.col("r")).select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rep", "component_id")
    out = base.select("id", "n", "f1", "f2").join(sets, (F.col("n") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left")
    mine = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), mine("component_id").alias("component_id"), mine("rep").alias("set_id"))
