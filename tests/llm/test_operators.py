"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlake.llm import bpe, jaccard, mixing, quality, sharding, suffixes, topk
from braidlake.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string, key string, id long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)


def words(seed, n, size=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)) if n else ""


@pytest.fixture(scope="module")
def rows():
    base = [words(k, 60 + k) for k in range(12)]
    out = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    out += [(20, base[0], "s0"), (21, base[0] + " tail", "s1"), (22, base[1].replace(" ", "  "), None), (23, base[2].upper(), "s0")]
    out += [(24, base[3][:300] + " " + base[4][-250:], "s1"), (25, "é" * 150 + "ü" * 150, "s2"), (26, None, "s0"), (27, "", "s0"), (28, "one two", None)]
    out += [(29, "ONE two", None), (30, " \n\t", "s1"), (31, "a" * 5000, "s2"), (32, "ab" * 4000 + base[5], "s2"), (None, "x y z w", "s0"), (20, base[0], "s0")]
    return out


def test_suffix_dedup(spark, rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for (doc, _, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.append((doc, len(t), int(gone.sum()), len(suffixes.runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(frame(spark, rows), keep=False).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_halves_large_families(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", 2)
    shared = words(99, 60)
    rows = [(k, words(k, 40) + " " + shared + " " + words(100 + k, 40), "s") for k in range(9)]
    # contexts that are equal on one side of an anchor only, for different lengths, and copies among them
    rows += [(20 + k, words(k, 40) + " " + shared + " " + words(100 + k % 3, 5 * k), "s") for k in range(9)] + [(40, rows[3][1], "s"), (41, shared, "s")]
    test_suffix_dedup(spark, rows)


def test_suffix_order():
    data = b"banana banana bandana" * 30
    text = suffixes.HashedText(np.frombuffer(data + bytes(40), np.uint8), 40)
    at = np.arange(len(data))
    order = text.sort(at, np.zeros(len(at), int))
    assert [(data + bytes(40))[i : i + 40] for i in order] == sorted((data + bytes(40))[i : i + 40] for i in at)


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(s), least.get(find(k))) for k, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(spark, rows):
    got = jaccard.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, components(rows)))
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("pairs", "triples"), [(3, 5), (3, 1000)])
def test_near_duplicates_of_a_frequent_text(spark, monkeypatch, pairs, triples):
    for name, value in (("LOCAL", 2), ("PAIRS", pairs), ("TRIPLES", triples), ("BLOCK", 7), ("LED", 4)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(5)
    base = words(7, 150).split()
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(len(own))] = f"new{r.random()}"
        rows.append((k, " ".join(own), "s"))
    rows += [(70, rows[4][1], "s"), (None, rows[5][1] + " end", "s"), (71, words(8, 150), "s")]
    got = jaccard.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, components(rows)))


def test_prefixes_share_a_key():
    r = random.Random(3)
    for trial in range(300):
        n = r.randint(2, 300)
        a = np.unique(np.array([r.getrandbits(63) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate((a[r.sample(range(len(a)), max(1, int(len(a) * r.uniform(0.9, 1))))], np.array([r.getrandbits(63) for _ in range(r.randint(0, n // 12 + 1))], np.uint64))))
        marks = np.zeros((2, 1 << 16), np.uint64)
        for token in a[: int(len(a) * r.choice([0, 0.5, 0.9, 1]))].tolist():
            bit = token & ((1 << 22) - 1)
            marks[: r.choice([1, 1, 2]), bit >> 6] |= np.uint64(1 << (bit & 63))
        for percent in (85, 80):
            if jaccard.similar(a, b, percent) and not np.array_equal(a, b):
                assert np.intersect1d(jaccard.prefix_keys(a, marks, percent), jaccard.prefix_keys(b, marks, percent)).size, trial


def test_long_words_do_not_collide():
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2^64."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    texts = [word.encode(), word.translate(str.maketrans("ab", "ba")).encode(), word.upper().encode()]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.array([0, 2048, 4096, 6144])
    for which in (0, 1):
        one, two, three = (x.tolist() for x in jaccard.shingle_sets(data, bounds, 4, which))
        assert one != two and one == three


def test_parities_never_part_similar_sets():
    r = np.random.default_rng(5)
    close = far = 0
    for trial in range(1500):
        n = int(r.integers(1, 600))
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[int(r.integers(0, max(1, n // 6))) :], r.integers(0, 1 << 63, int(r.integers(0, n // 6 + 2))).astype(np.uint64)))
        c = r.integers(0, 1 << 63, len(a)).astype(np.uint64)
        sketches = jaccard.Sketches(np.array([len(x) for x in (a, b, c)]), [jaccard.parity(x) for x in (a, b, c)], 85)
        likely = lambda i, j: sketches.distances(i, np.array([j]))[0] >= 0
        if jaccard.similar(a, b, 85):
            close += 1
            assert likely(0, 1) and likely(1, 0), trial
        far += n >= 50 and not likely(0, 2)
    assert close > 300 and far > 1200


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 50), (100, 101), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()))
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 50, 101: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_top_k(spark):
    r = np.random.default_rng(1)
    v = [(k, r.normal(size=8).astype("float32").tolist()) for k in range(400)]
    v += [(400 + k, v[3][1]) for k in range(30)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (950, [float("inf")] * 8), (960, [1.0, 2.0]), (970, [1e9] * 8), (None, v[0][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit("a"))
    good = [(i, [int(np.floor(float(x) * 256)) for x in e]) for i, e in v if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for q, e in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in good if i != q and len(f) == len(e))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    for drop in (0, 3):
        got = {tuple(x) for x in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, drop=drop, tile_rows=100, tile_queries=3).collect()}
        assert got == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bpe(spark, rows):
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    odd = ["Don't <|endoftext|> stop", "ÀÉ ﬁ ΑΣ Σ 日本語 текст İstanbul é x  y", "a\x1cb \x85 c", "x" * 9000, words(1, 3000), "١٢ ½ ²", "Ⱥ ſ ß", "a 12,5% 's 'S"]
    every = rows + [(100 + k, t, "s") for k, t in enumerate(odd)]
    got = {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.encode_documents(frame(spark, every), path).collect()}
    want = set()
    for doc, t, _ in every:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.encode_documents(frame(spark, []), path).count() == 0


def test_bpe_reuses_chunks_and_repairs_joins():
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    coder = bpe.Coder(path)
    shared = words(5, 3000).encode()
    data = np.frombuffer(b"first words " + shared + b"other " + shared, np.uint8)
    bounds = np.array([0, 12 + len(shared), len(data)])
    cuts = [c for c, _ in bpe.cut_rows(data, bounds)]
    texts = [bytes(data[bounds[k] : bounds[k + 1]]) for k in range(2)]
    got = coder.encode(texts, cuts)
    assert got == [np.array(coder.library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.reused >= coder.encoded - 6 > 0


def test_bpe_widens_a_join_without_agreement():
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    text = words(6, 2500).encode()
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    cuts = [c for c, _ in bpe.cut_rows(data, bounds)]
    edges = [0, *cuts[0]]
    for k in (0, 3, len(edges) - 2):
        wrong = text[edges[k] : edges[k + 1]]

        class Odd(bpe.Coder):
            def learn_chunks(self, raws, wrong=wrong):
                return [(p[0], p[1] + b"\0\0\0\0", *p[2:3], p[3] + b"\0\0\0\0", p[4]) if r == wrong else p for r, p in zip(raws, super().learn_chunks(raws), strict=True)]

        odd = Odd(path)
        want = np.array(odd.library.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        assert odd.encode([text], cuts) == [want] and 0 < odd.widened < 4


def test_quality(spark, rows):
    got = {x.doc_id: x for x in quality.quality_rules(frame(spark, rows)).collect()}
    assert len(quality.quality_rules(frame(spark, rows)).collect()) == len(rows)
    assert got[26].n_words == got[27].n_words == 0 and got[26].base_failed and not got[26].kept
    assert got[28].n_words == 2 and got[0].kept and got[0].n_words == 60
    menu = [(k, words(k, 20) + "\n" + "home about contact " * 30, "h") for k in range(20)]
    judged = {x.doc_id: x for x in quality.quality_rules(frame(spark, menu + [(99, words(99, 80), "h")])).collect()}
    assert judged[99].kept and not any(judged[k].kept for k in range(1, 20))
    assert quality.quality_rules(frame(spark, [])).count() == 0
    text = "a b c d a b c x # # #\nline\nline\n"
    one = quality.quality_rules(frame(spark, [(1, text, None)])).first()
    assert (one.n_words, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == (13, 3, 1, 6)


def test_quality_removes_lines_above_the_limit(spark):
    line = "Home  About\tContact"
    rows = [(k, f"{words(k, 40)}\n{line.upper() if k % 2 else line}\n\n{words(50 + k, 30)}\n{line}\n", "h") for k in range(20)] + [(30, f"{words(30, 60)}\n{line}", "other"), (31, None, "h")]
    got = {x.doc_id: x for x in quality.quality_rules(frame(spark, rows)).collect()}
    assert all(got[k].kept_text == f"{words(k, 40)}\n\n{words(50 + k, 30)}\n" and got[k].removed_words == 6 and got[k].kept for k in range(1, 20))
    assert got[0].kept_text == rows[0][1] and got[30].kept_text == rows[20][1] and got[31].kept_text == ""


def test_quality_limit_does_not_grow_with_the_host(spark):
    rows = [(k, words(k, 60) + ("\nread more here" if k < 8 else "\nsix only" if k < 14 else ""), "h") for k in range(200)]
    got = {x.doc_id: x.removed_words for x in quality.quality_rules(frame(spark, rows)).collect()}
    assert {k for k, n in got.items() if n} == set(range(1, 8)) and got[1] == 3


def test_quality_counts_lines_of_repeated_rows_once(spark):
    line = " ".join(f"menu{k}" for k in range(30))
    rows = [(k, f"{words(k, 70)}\n{line}", "h") for k in range(12)]
    rows += [rows[5]] * 3 + [(*rows[6][:2], "i")] + [(20 + k, f"{words(20 + k, 70)}\n{line}", "i") for k in range(12)]
    got = quality.quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(x.kept and x.removed_words == (0 if x.doc_id == 0 else 30) for x in got if x.doc_id not in (6, 20))
    assert sorted(x.removed_words for x in got if x.doc_id == 6) == [0, 30]


def test_mixing(spark):
    r = random.Random(2)
    rows = [(k, words(k, r.randint(0, 60)), r.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(600)] + [(600, None, "a"), (None, "x y", "b"), (5, "p q", "e"), (5, "p q", "e")]
    first = mixing.mix_sources(frame(spark, rows)).collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.mix_sources(frame(spark, rows)).collect())) and len(first) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for x in first:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken <= 3 * x.size and x.taken % max(x.size, 1) == 0 and x.source_size >= x.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, want, open_ = sum(size.values()), {}, set(order)
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        open_ -= set(over)
    for s in order:
        assert target[s] == pytest.approx(want.get(s, level * weight[s]))
        assert abs(taken[s] - target[s]) <= 60
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_flight_keeps_totals():
    r = np.random.default_rng(4)
    size, prob = np.sort(r.integers(1, 500, 800))[::-1], np.full(800, 0.37)
    out = mixing.fly(prob, size, 1, land=True)
    assert set(out) <= {0.0, 1.0}
    assert abs((out * size).sum() - 0.37 * size.sum()) < 20 and abs(out.sum() - 0.37 * 800) <= 6


def test_sharding(spark, rows):
    many = rows + [(1000 + k, words(k, 5), "s") for k in range(3000)]
    many += [(None, words(k, 4), "s") for k in range(40)] + [(5000, "a " * 100_000, "s")]
    got = sharding.shard_documents(frame(spark, many), sharding.tree(8), sharding.grow(sharding.tree(8))).collect()
    assert len(got) == len(many)
    slots = {}
    for x in got:
        assert x.grown_shard in (x.shard, 8)
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert all(250 < len(s) < 520 for s in slots.values())
    one = next(x for x in got if x.doc_id == 0)
    assert one.text_crc32 == zlib.crc32(rows[0][1].encode()) and one.size == len(rows[0][1].encode()) + 1
    assert sharding.shard_documents(frame(spark, []), sharding.tree(8)).count() == 0


def test_sharding_descends_a_tree(spark):
    """The same by brute force; weights move keys only into and out of the subtree that they change; labels matter."""
    import math

    def walk(key, leaves):
        for level in ("region", "rack", "shard"):
            weight = Counter()
            for x in leaves:
                weight[getattr(x, level)] += x.weight
            draw = lambda name: -math.log((int(hashlib.md5(f"{level}:{name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / weight[name]  # noqa: E731, B023
            took = min(sorted(weight), key=draw)
            leaves = [x for x in leaves if getattr(x, level) == took]
        return leaves[0].shard

    def change(leaves, **weights):
        return [sharding.Leaf(x.region, x.rack, x.shard, weights.get(f"s{x.shard}", x.weight)) for x in leaves]

    base = sharding.tree(8)
    flat = [sharding.Leaf(0, 0, s) for s in range(8)]
    trees = {"base": base, "flat": flat, "heavy": change(base, s2=4.0), "shifted": change(base, s2=1.5, s3=0.5), "gone": change(base, s7=0.0), "grown": sharding.grow(base)}
    df = spark.range(3000)
    for name, leaves in trees.items():
        df = sharding.assign(df, F.col("id"), leaves, name)
    rows = df.collect()
    for x in rows[:400]:
        assert all(x[name] == walk(x.id, [y for y in leaves if y.weight]) for name, leaves in trees.items())
    moved = lambda name: {(x.base, x[name]) for x in rows if x.base != x[name]}
    assert moved("shifted") == {(3, 2)}  # weight shifted within a rack stays there
    assert moved("grown") == {(s, 8) for s in range(8)} and {a for a, _ in moved("gone")} > {7}
    assert {b // 4 for _, b in moved("heavy")} == {0} and all(a // 4 == 1 or b // 2 == 1 for a, b in moved("heavy"))  # into its region or its rack
    assert len(moved("flat")) > 40  # region and rack decide
    assert 900 < sum(x.heavy == 2 for x in rows) < 1300
    with pytest.raises(ValueError):
        sharding.assign(df, F.col("id"), [sharding.Leaf(0, 0, 0, 0.0)], "none")


def least_repair(roles):
    """The least cost of all scripts: each turn relabelled or not, merged, set plainly, or with an empty turn before it; the outcome must be legal."""
    import re
    from itertools import product

    best = None
    options = [(r, how) for r in "sua" for how in ("plain", "merge", "s", "u", "a")]
    for script in product(options, repeat=len(roles)):
        cost, out = 0, ""
        for role, (new, how) in zip(roles, script, strict=True):
            cost += 2 * (new != (role or "?")[0] or role not in ("system", "user", "assistant"))
            if how == "merge":
                cost += 1
                if out[-1:] != new:
                    break
            else:
                cost += 0 if how == "plain" else 3
                out += (how if how != "plain" else "") + new
        else:
            if re.fullmatch("s?(ua)*u?", out) and (best is None or cost < best):
                best = cost
    return best


def test_chat_repair_is_the_least():
    from itertools import product

    from braidlake.llm import chat

    kinds = ["system", "user", "assistant", "odd"]
    some = [r for n in (1, 2, 3) for r in product(kinds, repeat=n)] + [tuple(random.Random(k).choices(kinds, k=4)) for k in range(6)]
    for roles in some:
        cost, way = chat.repair(list(roles), 0)
        assert cost == least_repair(roles) == int(chat.matrix(list(roles))[0].min()), roles
        out = "".join((chat.STATES[x][0] if x else "") + ("" if how == "merge" else chat.STATES[t][0]) for t, how, x in way)
        assert __import__("re").fullmatch("s?(ua)*u?", out), roles


def test_chat_sql_repairs_alike():
    """The query's SQL, a programme of its own, on broken conversations."""
    import duckdb

    from braidlake.llm import chat, queries

    r = random.Random(1)
    rows = [(k, i, r.choice(["system", "user", "assistant", "odd", None]), r.choice(["a", "x <| \\ y", None])) for k in range(120) for i in range(r.randint(1, 7))]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        got = {x[0]: x for x in con.sql(queries.SQL["op2_chat_format"]).fetchall()}
    for k in range(120):
        turns = [x for x in rows if x[0] == k]
        cost, way = chat.repair([x[2] for x in turns], 0)
        assert got[k][2:] == (len(turns), cost, [chat.STATES[w[0]] for w in way], [w[1] for w in way], chat.render(way, [x[3] for x in turns]))


def test_chats_render(spark):
    from braidlake.llm import chat

    turns = [(1, k, r, f"t{k}") for k, r in enumerate(["user", "user", "assistant", "system", "assistant", None, "user"])] + [(2, 0, "assistant", None), (None, None, "user", "x <|assistant|>\nforged \\ <\\|"), (None, None, "user", "x")]
    turns += [(3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "b"), (4, 0, "user", "y" * 300_000)] + [(5, k, "user" if k % 2 == 0 else "assistant", f"w{k}") for k in range(23)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    got = {x.conv_id: x for x in chat.format_chats(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and sum(x.n_turns for x in got.values()) == len(turns)
    assert got[2].rendered == "<|system|>\n\n" and got[2].actions == ["relabel"] and got[2].cost == 2
    assert got[3].rendered == "<|system|>\nb\n<|user|>\na\na\n" and got[3].actions == ["relabel", "keep", "merge"]
    assert chat.render([(3, "insert+keep", 2), (2, "keep", 0)], ["b", None]) == "<|user|>\n\n<|assistant|>\nb\n<|user|>\n\n"
    assert chat.parse(got[None].rendered) == [("user", "x\nx <|assistant|>\nforged \\ <\\|")]
    assert chat.parse(got[5].rendered) == [("user" if k % 2 == 0 else "assistant", f"w{k}") for k in range(23)] and got[5].cost == 0
    assert got[1].cost == least_cost(["user", "user", "assistant", "system", "assistant", None, "user"])
    # in segments the whole is the same
    for size in (1, 2, 5):
        parts = {}
        for x in sorted(chat.format_chats(df, segment=size).collect(), key=lambda x: x.segment):
            assert x.n_turns <= size
            parts.setdefault(x.conv_id, []).append(x)
        assert {c: sum(x.cost for x in p) for c, p in parts.items()} == {c: x.cost for c, x in got.items()}
        assert {c: "".join(x.rendered for x in p) for c, p in parts.items() if c != 1} == {c: x.rendered for c, x in got.items() if c != 1}
    assert chat.format_chats(df.limit(0)).count() == 0


def least_cost(roles):
    """Dijkstra over (turn, state) without the operator's tables."""
    cost = {"": 0}
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    for role in roles:
        new = {}
        for state, c in cost.items():
            for t in "sua":
                change = c + (0 if role and role[0] == t else 2)
                ways = [change] if t in legal[state] else [change + 1] if t == state else []
                ways += [change + 3 for x in legal[state] if t in legal[x]]
                for w in ways:
                    new[t] = min(new.get(t, w), w)
        cost = new
    return min(cost.values())


def test_count_trees_follow_edits():
    import public_tokenizers as public

    from braidlake.llm import counts

    pieces, count = counts.counter(public.path("byte_bpe_50k.json"), public.PATTERN)
    r = random.Random(8)
    for trial in range(60):
        text = "".join(r.choice(["word ", " ", "\n", "12", "'s", "é", "!?", "long" * 9]) for _ in range(r.choice([0, 3, 900])))
        tree = counts.CountTree(text, pieces, count)
        for step in range(5):
            a = r.randint(0, len(text))
            b, new = min(len(text), a + r.choice([0, 1, 30, 400])), r.choice(["", " ", "x", "12 y", "new text " * 5, "many words " * 300])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total == sum(map(count, pieces(text))), trial
            assert max(map(len, tree.leaves)) <= 2 * counts.LEAF and tree.chars[1] == len(text)
            if step % 2:
                tree = counts.CountTree.stored(*tree.store(), pieces, count)
    tree = counts.CountTree("one two three " * 400, pieces, count)
    tree.edit(100, 101, "x")
    assert tree.encoded < 40


def test_edited_counts(spark):
    import public_tokenizers as public

    from braidlake.llm import counts

    path, pattern = public.path("byte_bpe_50k.json"), public.PATTERN
    pieces, count = counts.counter(path, pattern)
    total = lambda text: sum(map(count, pieces(text)))
    long_ = "word " * 40_000
    df = frame(spark, [(1, "call 123456 now", "s"), (2, None, "s"), (None, "", "s"), (3, "abc def ghi jkl", "s"), (3, "abc def ghi jkl", "s"), (4, long_, "s")])
    got = counts.edited_counts(df, None, path, pattern, redact=r"\d{4,}").collect()
    assert len(got) == 6 and {(x.doc_id, x.n_edits, x.n_tokens, x.n_tokens_edited) for x in got} == {
        (1, 1, total("call 123456 now"), total("call 0 now")), (2, 0, 0, 0), (None, 0, 0, 0), (3, 0, total("abc def ghi jkl"), total("abc def ghi jkl")), (4, 0, total(long_), total(long_))
    }
    assert counts.edited_counts(df.limit(0), None, path, pattern).count() == 0
    # overlapping, reversed, negative, null and unknown edits; a redaction inside a given edit
    rows = [(3, 4, 9, "X"), (3, 8, 11, "Y"), (3, 14, 2, "!"), (1, -5, None, ">"), (1, 6, 8, "99999"), (4, 199_990, 10**9, "end"), (2, None, None, "new"), (9, 0, 1, "z"), (None, 0, 1, "z")]
    edits = spark.createDataFrame(rows, "doc_id long, start long, end long, new string").withColumn("text", F.lit(1))
    trees = counts.edit_trees(counts.count_trees(df, path, pattern), edits, path, pattern, redact=r"\d{4,}").collect()
    want = {1: "> call 199999456 now".replace("> ", ">"), 2: "new", 3: "abc XY jk!l", None: "", 4: long_[:199_990] + "end"}
    for x in trees:
        assert "".join(x.leaves) == want[x.doc_id] and x.n_tokens_edited == total(want[x.doc_id]) == sum(x.tokens)
    # stored trees are edited again without encoding them anew
    again = spark.createDataFrame([(x.doc_id, x.n_tokens_edited, x.leaves, x.lengths, x.tokens) for x in trees], f"doc_id long, {counts.TREE}")
    one = next(x for x in counts.edit_trees(again, spark.createDataFrame([(4, 0, 4, "first")], "doc_id long, start long, end long, new string"), path, pattern).collect() if x.doc_id == 4)
    assert one.n_reencoded < 10 and one.n_tokens_edited == total("first" + want[4][4:])


def test_licenses(spark):
    from braidlake.llm import licenses

    rows = [(1, "Copyright 2020 A\nRELEASED under the MIT Licence!", "s"), (2, "other", "s"), (3, None, "s"), (4, "© x", "s")]
    assert {x.doc_id: x.license_id for x in licenses.scan(frame(spark, rows)).collect()} == {1: "MIT-notice", 2: None, 3: None, 4: None}


def test_whole_licenses(spark):
    import textwrap
    from pathlib import Path

    from braidlake.llm import licenses

    folder = Path(licenses.__file__).parent / "license_texts"
    text = {f.stem: f.read_text() for f in folder.glob("*.txt")}
    wrapped = {n: "\n\n".join(textwrap.fill(" ".join(p.split()), 61) for p in text[n].split("\n\n")) for n in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause")}
    isc = "ISC License\n\nCopyright Jo Doe\n\n" + text["ISC"].replace("provided that the\nabove copyright", "provided that the above\ncopyright")
    assert "\ncopyright notice and this permission notice appear in all copies" in isc
    apache = text["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Jo Doe")
    rows = [(n, t) for n, t in text.items()] + list(wrapped.items()) + [("ISC", isc), ("Apache-2.0", apache), ("Apache-2.0", apache[: apache.index(licenses.END) + len(licenses.END)])]
    rows += [(n, f"Copyright (c) 2020, Jo Doe\nAll rights reserved.\n\n{t}") for n, t in wrapped.items()] + [("MIT", "The MIT License (MIT)\n\n© 2020 Jo\n\n" + text["MIT"].upper())]
    rows += [(None, "这是一篇文章。\nReleased under the MIT License."), (None, "Это текст. " + text["MIT"]), (None, text["MIT"][:-300]), (None, text["ISC"].split("\n\n")[0]), ("MIT-notice", "Released under the MIT License.")]
    got = {x.doc_id: x.license_id for x in licenses.scan(frame(spark, [(k, t, "s") for k, (_, t) in enumerate(rows)])).collect()}
    assert [got[k] for k in range(len(rows))] == [n and n.removesuffix("-Regents") for n, _ in rows]


def test_licenses_on_odd_rows(spark):
    from braidlake.llm import licenses

    text = (__import__("pathlib").Path(licenses.__file__).parent / "license_texts" / "MIT.txt").read_text()
    rows = [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, text + " more " * 200_000, "s"), (3, "", "s"), (4, " \n", "s"), (5, None, "s")]
    got = sorted(map(str, ((x.doc_id, x.license_id) for x in licenses.scan(frame(spark, rows)).collect())))
    assert got == sorted(map(str, [(1, "MIT"), (1, "MIT"), (None, "MIT"), (2, None), (3, None), (4, None), (5, None)]))
    assert licenses.scan(frame(spark, [])).count() == 0 and licenses.scan(frame(spark, rows)).columns == ["doc_id", "digest", "license_id"]


def test_long_texts_in_rules_and_mixes(spark):
    long_ = words(70, 60_000)
    rows = [(1, long_, "a"), (2, long_, "a"), (3, words(71, 80), "a"), (4, words(72, 80), None)]
    got = {x.doc_id: x for x in quality.quality_rules(frame(spark, rows)).collect()}
    assert got[1].n_words == got[2].n_words == 60_000 and got[1].word_chars == len(long_.replace(" ", "")) and got[1].kept
    mixed = {x.doc_id: x for x in mixing.mix_sources(frame(spark, rows)).collect()}
    assert mixed[1].size == 60_000 and all(x.taken <= 3 * x.size for x in mixed.values()) and mixed[4].source_size == 80


def test_components_leave_out_nulls(spark):
    links = [(1, 2), (None, 3), (4, None), (None, None), (2, 2), (2, 1)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert list(map(tuple, got)) == [(2, 1)]
