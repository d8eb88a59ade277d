"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes has its low bits at zero, so texts that share a passage share its chunks
wherever it stands. Documents are dealt to tasks by the least hash among their chunks, which brings copies and near copies
together; within a task each distinct chunk is encoded once and its result kept in a table of bounded size. A cut may fall inside a word,
so every join between two chunks is repaired: the end of the left and the start of the right chunk are encoded together as a window
whose outer words, at white space on both sides, must get the ids that the chunks themselves have there. A chunk without such
words lets the window grow over it; without agreement the window grows over the chunks on both sides, until there is agreement or it is the whole text.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import ship, tidy
from braidlake.llm.textbytes import PrefixHash, binary, mix, slices

#: A chunk ends where the low bits of the hash of the last WINDOW bytes are zero: after 2^CUT_BITS bytes on average.
WINDOW, CUT_BITS = 16, 10
#: Bytes of chunk results, and number of words, that a task keeps.
KEPT_BYTES, KEPT_WORDS = 32 << 20, 300_000
#: Bytes that are cut, and bytes that are encoded, at once: whole rows, one at least.
CUT_SLICE, ENCODE_SLICE = 1 << 19, 1 << 20

_LETTERS = "".join(chr(c) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == "L")
_DIGITS = "".join(chr(c) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == "N")
#: Texts of these characters alone are split into words here; others go through the library as they are.
_PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E\xA1-\u012F\u0131-\u017F]*")


class Coder:
    """The tokenizer of a file, with tables of words and chunks that have been encoded before."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.words: dict[str, bytes] = {}
        self.chunks: OrderedDict[bytes, tuple] = OrderedDict()
        self.room, self.kept_bytes, self.encoded, self.reused = kept_bytes, kept_bytes, 0, 0
        self.widened = 0
        self.split = self._splitter()
        top = self.library.get_vocab_size(with_added_tokens=True)
        self.names = [(self.library.id_to_token(i) or "").encode() for i in range(top)]
        mark = (getattr(self.library.model, "end_of_word_suffix", None) or "").encode()
        self.last = np.array([bool(mark) and name.endswith(mark) for name in self.names])
        # decoding joins tokens by a space where the file names no decoder
        self.joined = self.library.decoder is None

    def _splitter(self):
        """Splits lower-case plain text as the file's own pre-tokenizer; None if the file is not of the kind this knows."""
        import json

        own = json.loads(self.library.to_str())
        steps = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
        norm = [x["type"] for x in (own["normalizer"] or {}).get("normalizers", [])]
        pattern = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
        if norm != ["NFC", "Replace", "Lowercase"] or r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" not in pattern:
            return None
        letters, digits = re.escape(_LETTERS), re.escape(_DIGITS)
        head = pattern.split(r"[\p{L}]")[0]
        return re.compile(rf"{head}[{letters}]+|[{digits}]|[^\s{letters}{digits}\x1c-\x1f]+").findall

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian 32-bit integers; right for any text."""
        found: list = []
        for text in texts:
            if self.split is None or not _PLAIN.fullmatch(text) or (self.special and self.special.search(text)):
                found.append(np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
            else:
                found.append(self.split(text.lower()))
        new = set().union(*(f for f in found if type(f) is list)) - self.words.keys()
        if new:
            if len(self.words) + len(new) > KEPT_WORDS:
                self.words.clear()
                new = set().union(*(f for f in found if type(f) is list))
            self._learn(sorted(new))
        known = self.words.__getitem__
        return [b"".join(map(known, f)) if type(f) is list else f for f in found]

    def _learn(self, words: list[str]) -> None:
        """Encode new words as one text between spaces; a word's last token bears the end mark, which tells words apart."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words):
            raw, at = ids.tobytes(), 0
            for w, end in zip(words, (4 * ends).tolist(), strict=True):
                self.words[w] = raw[at:end]
                at = end
        else:
            for w in words:
                self.words[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8, special tokens included."""
        got = np.frombuffer(ids, dtype="<u4")
        if self.joined:
            names = self.names
            return b" ".join(map(names.__getitem__, got.tolist()))
        return self.library.decode(got.tolist(), skip_special_tokens=False).encode()

    def learn_chunks(self, raws: list[bytes]) -> list[tuple | None]:
        """Each chunk's parts: head, its last word's ids, ids of the words between, first word's ids of the tail, tail.

        Head and tail are a cut word and a whole one each, in which joins look for agreement. None if a chunk has too little
        white space for that. A chunk seen before is not encoded again.
        """
        out: list = [None] * len(raws)
        fresh: dict[bytes, list[int]] = {}
        for k, raw in enumerate(raws):
            key = hashlib.blake2b(raw, digest_size=16).digest()
            have = self.chunks.get(key)
            if have is not None:
                self.chunks.move_to_end(key)
                out[k] = have[0]
                self.reused += 1
            else:
                self.reused += key in fresh
                fresh.setdefault(key, []).append(k)
        parts: list = []
        for places in fresh.values():
            text = raws[places[0]].decode("utf-8", "surrogateescape")
            a, d = text.find(" "), text.rfind(" ")
            b, c = text.find(" ", a + 1), text.rfind(" ", 0, max(d, 0))
            parts.append((text[:b], text[a:b], text[b:c], text[c:d], text[c:]) if -1 < a < b <= c < d else None)
        ids = iter(self.ids([x for p in parts if p for x in p[1:4]]))
        for (key, places), p in zip(fresh.items(), parts, strict=True):
            made = (p[0].encode("utf-8", "surrogateescape"), next(ids), next(ids), next(ids), p[4].encode("utf-8", "surrogateescape")) if p else None
            for k in places:
                out[k] = made
            size = 400 + len(raws[places[0]]) + len(made[2] if made else b"")
            self.chunks[key] = (made, size)
            self.room -= size
        self.encoded += len(fresh)
        while self.room < 0:
            self.room += self.chunks.popitem(last=False)[1][1]
        return out

    def encode(self, raws: list[bytes], cuts: list[list[int]]) -> list[bytes]:
        """The ids of whole texts, each cut at its ``cuts`` (places in it, rising, its end included).

        Where a join finds no agreement, the cuts in its window go, so the window grows over the chunks on both sides, until all joins agree or one chunk is left.
        """
        out: list[bytes] = [b""] * len(raws)
        cuts, todo = [list(c) for c in cuts], list(range(len(raws)))
        while todo:
            chunks = iter(self.learn_chunks([raws[k][a:b] for k in todo for a, b in zip([0, *cuts[k]], cuts[k], strict=False)]))
            cores, windows = [], []  # a text is its windows with the chunks' cores between them
            for k in todo:
                own, joins, window, before, inside = [], [], b"", b"", []
                for a, b in zip([0, *cuts[k]], cuts[k], strict=False):
                    part = next(chunks)
                    if part is None:
                        window += raws[k][a:b]  # nothing to hold on to: the window goes on over this chunk
                    else:
                        joins.append((window + part[0], before, part[1], inside or [b]))
                        own.append(part[2])
                        before, window, inside = part[3], part[4], []
                    inside.append(b)
                joins.append((window, before, b"", inside[:-1] or cuts[k][-2:-1]))
                cores.append(own)
                windows.append(joins)
            joined = iter(self.ids([j[0].decode("utf-8") for joins in windows for j in joins]))
            again = []
            for k, own, joins in zip(todo, cores, windows, strict=True):
                got = [next(joined) for _ in joins]
                lost = {c for g, (_, before, after, inside) in zip(got, joins, strict=True) if not (g.startswith(before) and g.endswith(after)) for c in inside}
                if not lost and all(g.startswith(j[1]) and g.endswith(j[2]) for g, j in zip(got, joins, strict=True)):
                    out[k] = b"".join([x for pair in zip(got, [*own, b""], strict=True) for x in pair])
                    continue
                self.widened += 1
                left = [c for c in cuts[k][:-1] if c not in lost]
                if left and len(left) < len(cuts[k]) - 1:
                    cuts[k] = [*left, cuts[k][-1]]
                    again.append(k)
                else:
                    out[k] = self.ids([raws[k].decode("utf-8")])[0]  # the window is the whole text
            todo = again
        return out


def cut_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end in a buffer by the rolling hash, and the hash at each place."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = PrefixHash(data, 1)
    places = np.arange(WINDOW, len(data) + 1)
    h = mix(sums.of(places - WINDOW, places))
    hit = (h & np.uint64((1 << CUT_BITS) - 1)) == 0
    return places[hit], h[hit]


def cut_rows(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """For each row where its chunks end, its own end last, and the least hash among its cuts (of its whole bytes if none)."""
    for a, b in slices(bounds, CUT_SLICE):
        part = data[bounds[a] : bounds[b]]
        places, h = cut_places(part)
        for k in range(a, b):
            s, e = int(bounds[k] - bounds[a]), int(bounds[k + 1] - bounds[a])
            i, j = np.searchsorted(places, [s + WINDOW, e])  # a window lies within its row
            least = int(h[i:j].min()) if j > i else int.from_bytes(hashlib.blake2b(part[s:e].tobytes(), digest_size=8).digest(), "little")
            yield [*(places[i:j] - s).tolist(), e - s], least


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode whole texts.

    Returns doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; only with ``keep_ids``), ids_sha256 and
    decoded_sha256. Null texts count as empty and give no tokens; null ids and repeated rows pass through; an empty
    table gives an empty result; other columns are left out.
    """

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = binary(batch.column(1))
            least = [x[1] & ((1 << 63) - 1) for x in cut_rows(data, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], ["doc_id", "text", "bin"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path)
        for batch in batches:
            data, bounds = binary(batch.column(1))
            n, kept, digests, decoded = [], [], [], []
            cuts = [c for c, _ in cut_rows(data, bounds)]
            every = (x for a, b in slices(bounds, ENCODE_SLICE) for x in own.encode([data[bounds[k] : bounds[k + 1]].tobytes() for k in range(a, b)], cuts[a:b]))
            for ids in every:
                n.append(len(ids) // 4)
                kept.append(ids if keep_ids else None)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    binned = rows.mapInArrow(tidy(bins), f"doc_id {id_type}, text string, bin long").hint("rebalance", "bin")
    out = binned.select("doc_id", "text").mapInArrow(tidy(encoded), f"doc_id {id_type}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    return out if keep_ids else out.drop("ids")
