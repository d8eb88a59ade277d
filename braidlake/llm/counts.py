"""Token counts that follow edits.

A document's pre-tokens are the leaves' contents of a segment tree; inner nodes hold the sums of token counts below. Trees are stored, a row for each
document (``count_trees``), and edits are applied to stored trees (``edit_trees``): an edit re-splits
from the pre-token before it until the new split meets an old border behind it; only pre-tokens between are encoded again, and the sums on the
way to the root are renewed. Leaves that grow beyond twice their size are split, and only their own sums are made anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import cut, ship, tidy

#: Pre-tokens in a leaf at first, and pre-token counts that a task keeps.
LEAF, KEPT = 64, 500_000


class CountTree:
    """Token and character sums over leaves of pre-tokens; ``pieces`` yields pre-tokens of a text, ``count`` their tokens.

    A leaf is a list of its pre-tokens, or, as long as no edit came near, its text and their lengths.
    """

    def __init__(self, text: str, pieces: Callable[[str], Iterator[str]], count: Callable[[str], int]):
        self.split, self.count, self.encoded = pieces, count, 0
        every = list(pieces(text))
        leaves = [every[k : k + LEAF] for k in range(0, len(every), LEAF)] or [[]]
        self._grow(leaves, [sum(map(count, x)) for x in leaves], [sum(map(len, x)) for x in leaves])

    @classmethod
    def stored(cls, texts: list[str], lengths: list[list[int]], tokens: list[int], pieces, count) -> CountTree:
        """A tree from its leaves' texts, pre-token lengths and token counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.split, tree.count, tree.encoded = pieces, count, 0
        tree._grow([(t, n) for t, n in zip(texts, lengths, strict=True)], tokens, [len(t) for t in texts])
        return tree

    def store(self) -> tuple[list[str], list[list[int]], list[int]]:
        """The leaves' texts, pre-token lengths and token counts."""
        texts = [x[0] if type(x) is tuple else "".join(x) for x in self.leaves]
        return texts, [x[1] if type(x) is tuple else list(map(len, x)) for x in self.leaves], self.tokens[self.width : self.width + len(self.leaves)]

    def _grow(self, leaves: list, tokens: list[int], chars: list[int]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        rest = [0] * (self.width - len(leaves))
        self.tokens, self.chars = [0] * self.width + tokens + rest, [0] * self.width + chars + rest
        for k in range(self.width - 1, 0, -1):
            self._pull(k)

    def leaf(self, k: int) -> list[str]:
        """The pre-tokens of a leaf."""
        own = self.leaves[k]
        if type(own) is tuple:
            text, at, out = own[0], 0, []
            for n in own[1]:
                out.append(text[at : at + n])
                at += n
            own = self.leaves[k] = out
        return own

    def _pull(self, k: int) -> None:
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(x[0] if type(x) is tuple else "".join(x) for x in self.leaves)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and first character of the pre-token that holds a character (the last one at the end)."""
        if at >= self.chars[1]:
            leaf = max((k for k in range(len(self.leaves)) if self.chars[self.width + k]), default=0)
            pieces = self.leaf(leaf)
            return leaf, max(0, len(pieces) - 1), self.chars[1] - (len(pieces[-1]) if pieces else 0)
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        leaf = k - self.width
        for n, p in enumerate(self.leaf(leaf)):
            if at < start + len(p):
                return leaf, n, start
            start += len(p)
        raise AssertionError("sums are right")

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from start to end."""
        leaf, n, at = self._find(max(0, start - 1))
        if at:
            leaf, n, at = self._find(at - 1)  # one more, whose border in front cannot depend on the edit
        first_leaf, first = leaf, n
        old, size = [], at
        k, j = leaf, n
        while k < len(self.leaves):  # the old pre-tokens up to the end of the edit and a few of those behind
            if j < len(self.leaf(k)):
                old.append((k, j, size))
                size += len(self.leaf(k)[j])
                j += 1
            else:
                k, j = k + 1, 0
            if size >= end + 64 and len(old) > 1 and old[-1][2] > end:
                joined = "".join(self.leaf(a)[b] for a, b, _ in old)
                met = self._meet(joined, at, start, end, new, [s for _, _, s in old], False)
                if met:
                    return self._put(first_leaf, first, old[: met[1]], met[0])
                end_of = size
                while size < end_of + len(joined) and k < len(self.leaves):  # twice as far
                    if j < len(self.leaf(k)):
                        old.append((k, j, size))
                        size += len(self.leaf(k)[j])
                        j += 1
                    else:
                        k, j = k + 1, 0
        joined = "".join(self.leaf(a)[b] for a, b, _ in old)
        pieces, _ = self._meet(joined, at, start, end, new, [], True)
        return self._put(first_leaf, first, old, pieces)

    def _meet(self, joined, at, start, end, new, borders, whole):
        """The new pre-tokens up to an old border behind the edit, and how many old ones they replace."""
        text = joined[: start - at] + new + joined[end - at :]
        shift, out, place = len(new) - (end - start), [], at
        places = {s: n for n, s in enumerate(borders)}
        for p in self.split(text):
            out.append(p)
            place += len(p)
            if not whole and place >= start + len(new) and place - shift in places and place - shift >= end and place < at + len(text) - 32:
                return out, places[place - shift]
        return (out, None) if whole else None

    def _put(self, leaf: int, n: int, old: list, pieces: list[str]) -> None:
        gone: dict[int, int] = {}
        for k, _, _ in old:
            gone[k] = gone.get(k, 0) + 1
        for k, many in gone.items():
            have = self.leaf(k)
            a = n if k == leaf else 0
            self.leaves[k] = have[:a] + (pieces if k == leaf else []) + have[a + many :]
        if leaf not in gone:
            self.leaves[leaf] = self.leaf(leaf)[:n] + pieces + self.leaf(leaf)[n:]
        self.encoded += len(pieces)
        for k in {*gone, leaf}:
            self.tokens[self.width + k], self.chars[self.width + k] = sum(map(self.count, self.leaf(k))), sum(map(len, self.leaf(k)))
        if len(self.leaves[leaf]) > 2 * LEAF:
            own = self.leaves[leaf]
            parts = [own[k : k + LEAF] for k in range(0, len(own), LEAF)]
            at = slice(self.width, self.width + len(self.leaves))
            tokens, chars = self.tokens[at], self.chars[at]
            tokens[leaf : leaf + 1], chars[leaf : leaf + 1] = [sum(map(self.count, p)) for p in parts], [sum(map(len, p)) for p in parts]
            self._grow(self.leaves[:leaf] + parts + self.leaves[leaf + 1 :], tokens, chars)
            return
        for k in {*gone, leaf}:
            k = (self.width + k) // 2
            while k:
                self._pull(k)
                k //= 2


@lru_cache(maxsize=2)
def counter(path: str, pattern: str):
    import regex
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    find, known = regex.compile(pattern), {}

    def count(piece: str) -> int:
        if piece not in known:
            if len(known) >= KEPT:
                known.clear()
            known[piece] = len(own.encode(piece, add_special_tokens=False).ids)
        return known[piece]

    return (lambda text: (m.group() for m in find.finditer(text))), count


#: A stored tree: texts, pre-token lengths and token counts of the leaves in order, and the root's sum.
TREE = "n_tokens long, leaves array<string>, lengths array<array<int>>, tokens array<int>"
_TREE = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())]


def count_trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored tree (doc_id, n_tokens, leaves, lengths, tokens) of every text; this encodes whole texts.

    Null texts are empty; null ids and repeated rows have trees like any others; an empty table gives an empty result; other columns are left out.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, count = counter(path, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                tree = CountTree(text or "", pieces, count)
                for column, value in zip(out, (tree.total, *tree.store()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, _TREE, strict=True))], ["doc_id", *(x.split()[0] for x in TREE.split(", "))])

    return rows.mapInArrow(tidy(built), f"doc_id {kind}, {TREE}")


def settled(length: int, given: list[dict], found: list[tuple[int, int]], new: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, text) that do not overlap, by place, of given ones and of places ``found`` to be replaced by ``new``.

    A null start is 0 and a null end the start; places beyond the text are cut to it, negative ones are 0, an end before its start is the start. Of given
    edits that overlap, the later one begins where the earlier one ends; a found place that touches a given edit is left out.
    """
    out: list[tuple[int, int, str]] = []
    bounded = lambda x: min(max(x, 0), length)
    for e in sorted(given, key=lambda e: (e["start"] or 0, e["start"] or 0 if e["end"] is None else e["end"], e["new"] or "")):
        start = bounded(e["start"] or 0)
        end = max(start, bounded(start if e["end"] is None else e["end"]))
        last = out[-1][1] if out else 0
        out.append((max(start, last), max(end, last), e["new"] or ""))
    have, k = list(out), 0
    for start, end in found:
        while k < len(have) and have[k][1] < start:
            k += 1
        if k == len(have) or have[k][0] > end:
            out.append((start, end, new))
    return sorted(out)


def edit_trees(trees: DataFrame, edits: DataFrame | None, path: str, pattern: str, redact: str | None = None) -> DataFrame:
    """Stored trees after edits: (doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded, leaves, lengths, tokens), the last three of the new tree.

    ``edits`` has rows (doc_id, start, end, new) in characters of the stored text; ``redact`` is a pattern every match of which is
    an edit to "0". See ``settled`` for edits that overlap and for odd places. A null id takes no edits from the table, repeated rows are edited alike, edits of unknown
    ids are left out. A document's edits are in one task's memory, as its text is. n_reencoded counts the pre-tokens that were encoded again.
    """
    ship(trees.sparkSession)
    rows = trees.select("doc_id", *(x.split()[0] for x in TREE.split(", ")))
    if edits is not None:
        lists = edits.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "new")).alias("edits"))
        rows = rows.join(lists, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    else:
        rows = rows.withColumn("edits", F.lit(None).cast("array<struct<start:long,end:long,new:string>>"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        pieces, count = counter(path, pattern)
        find = re.compile(redact) if redact else None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            sums: list[list[int]] = [[], [], [], []]
            new: list[list] = [[], [], []]
            for before, texts, lengths, tokens, given in zip(*columns, strict=True):
                text = "".join(texts)
                todo = settled(len(text), given or [], [m.span() for m in find.finditer(text)] if find else [], "0")
                made, after, encoded = (texts, lengths, tokens), before, 0
                if todo:
                    tree = CountTree.stored(texts, lengths, tokens, pieces, count)
                    for start, end, put in reversed(todo):  # from the end, so that places stay right
                        tree.edit(start, end, put)
                    made, after, encoded = tree.store(), tree.total, tree.encoded
                for column, value in zip(sums, (before, len(todo), after, encoded), strict=True):
                    column.append(value)
                for column, value in zip(new, made, strict=True):
                    column.append(value)
            arrays = [*(pa.array(c, pa.int64()) for c in sums), *(pa.array(c, k) for c, k in zip(new, _TREE[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded", "leaves", "lengths", "tokens"])

    shape = f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long, leaves array<string>, lengths array<array<int>>, tokens array<int>"
    return rows.mapInArrow(tidy(edited), shape)


def edited_counts(docs: DataFrame, edits: DataFrame | None, path: str, pattern: str, redact: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded): token counts before and after edits, by way of stored trees.

    The trees are written first; a user who edits again keeps the table that ``edit_trees`` returns and edits that. Nulls, repeats and an empty table are
    as in ``count_trees`` and ``edit_trees``.
    """
    trees = cut(count_trees(docs, path, pattern, id_col, text_col), "trees")
    return edit_trees(trees, edits, path, pattern, redact).drop("leaves", "lengths", "tokens")
