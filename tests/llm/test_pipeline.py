"""Every stage of the pipeline against brute force, each on the rows that its predecessor kept."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from braidlake.llm.common import cut
from tests.llm.test_operators import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs():
    base = [words(k, 90 + k) for k in range(14)]
    shared = words(500, 70)
    texts = dict(enumerate(base))
    texts |= {20: base[0], 21: base[1] + " and a tail", 22: base[2].upper(), 23: "short", 24: None, 25: "", 26: "same old words " * 40}
    texts |= {30: words(30, 60) + " " + shared + " " + words(31, 60), 31: words(32, 70) + " " + shared + " " + words(33, 50)}
    return [(k, t, "en", ("a", "a", "b", None)[k % 4], len(t or "")) for k, t in texts.items()]


def low_quality(text):
    w = (text or "").split()
    repeated = Counter(zip(w, w[1:], w[2:], strict=False))
    places = {p for i in range(len(w) - 2) if repeated[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(places) > 50 * len(w)


def first_of_groups(texts):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, label = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: t for k, t in texts.items() if label[k] == k}


def without_repeats(texts):
    count = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[k] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return {k: t for k, t in out.items() if t.split()}


def test_stages(spark):
    rows = docs()
    frame, have = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = cut(stage(spark, frame, ""), name)
        have[name] = frame.collect()
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert have[name][0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {k: t for k, t, *_ in rows if not low_quality(t)}
    assert set(want) == set(range(14)) | {20, 21, 22, 30, 31}
    for name, rule in (("quality_rules", dict), ("ngram_jaccard_join", first_of_groups), ("suffix_array_dedup", without_repeats)):
        want = rule(want)
        assert sorted((x.doc_id, x.text) for x in have[name]) == sorted(want.items()), name
    assert set(want) == set(range(14)) | {30, 31} and len(want[30].split()) < 130
    size = {k: len(t.split()) for k, t in want.items()}
    copies = Counter(x.doc_id for x in have["mixing_sources"])
    assert all((x.doc_id, x.text) in want.items() for x in have["mixing_sources"]) and max(copies.values()) <= 3
    of = {k: s for k, _, _, s, _ in rows}
    weights, totals = {"a": 5, "b": 2, None: 1}, Counter()
    for k, n in size.items():
        totals[of[k]] += n
    for source, weight in weights.items():
        level = sum(size.values()) * weight / 8
        assert level < 3 * totals[source]  # no target is at its stop here
        assert abs(sum(size[k] * n for k, n in copies.items() if of[k] == source) - level) <= max(size.values())
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: own.encode(t, add_special_tokens=False).ids for k, t in want.items()}
    coded = Counter((x.doc_id, x.n_tokens, x.ids_sha256) for x in have["bpe_encoding"])
    assert coded == Counter({(k, len(ids[k]), hashlib.sha256(np.array(ids[k], "<u4").tobytes()).hexdigest()): n for k, n in copies.items()})


def test_stages_on_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        frame = cut(stage(spark, frame, ""), name)
    assert frame.count() == 0


def test_quality_stage_passes_texts_without_boilerplate_lines(spark):
    texts = {k: f"{words(k, 60)}\nHome About Contact\n{words(40 + k, 9)}" for k in range(12)}
    frame = spark.createDataFrame([(k, t, "en", None, len(t)) for k, t in texts.items()], SCHEMA)
    got = {x.doc_id: x for x in corpus_pipeline.quality_stage(spark, frame, "").collect()}
    want = {k: t if k == 0 else t.replace("Home About Contact\n", "") for k, t in texts.items()}
    assert {k: (x.text, x.n_chars) for k, x in got.items()} == {k: (t, len(t)) for k, t in want.items()}


def test_stages_keep_one_row_of_repeated_rows_and_null_ids(spark):
    """A rejected text shares its id with a kept one; whole rows repeat; copies have null ids."""
    own, nulls, other, hot = words(60, 90), words(61, 90), words(62, 90), words(63, 90)
    rows = [(1, own, "en", "a", 1), (1, own, "en", "a", 1), (1, "too short", "en", "a", 1), (None, nulls, "en", "a", 1), (None, nulls, "en", None, 1), (None, nulls, None, "a", 1)]
    rows += [(None, "short too", "en", "a", 1), (2, other, "en", "a", 1), (None, other, "en", "a", 1), (1, words(64, 90), "en", "a", 1)] + [(7, hot, "en", "b", 1)] * 20
    frame = spark.createDataFrame(rows, SCHEMA)
    good = cut(corpus_pipeline.quality_stage(spark, frame, ""), "good")
    assert good.count() == len(rows) - 2 and good.filter("text like '%short%'").count() == 0
    kept = cut(corpus_pipeline.near_duplicate_stage(spark, good, ""), "kept")
    want = sorted([("1", own), ("None", nulls), ("2", other), ("1", rows[9][1]), ("7", hot)])
    assert sorted((str(x.doc_id), x.text) for x in kept.collect()) == want
    assert sorted((str(x.doc_id), x.text) for x in corpus_pipeline.repeated_string_stage(spark, kept, "").collect()) == want


def test_later_stages_on_nulls(spark):
    """Stages after the first on rows that the first would not let through."""
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", None, "a", 0), (2, " ", "en", None, 1), (3, words(80, 90), None, None, None), (3, words(80, 90), None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = cut(corpus_pipeline.near_duplicate_stage(spark, frame, ""), "kept")
    assert sorted((str(x.doc_id), x.text or "") for x in kept.collect()) == sorted([("None", ""), ("1", ""), ("1", ""), ("2", " "), ("3", words(80, 90))])
    left = cut(corpus_pipeline.repeated_string_stage(spark, kept, ""), "left")
    assert sorted((str(x.doc_id), x.text) for x in left.collect()) == sorted([("None", ""), ("1", ""), ("1", ""), ("2", " "), ("3", words(80, 90))])
    mixed = cut(corpus_pipeline.mixing_stage(spark, left, ""), "mixed")
    assert {x.doc_id for x in mixed.collect()} == {3}
    assert {x.doc_id: x.n_tokens for x in corpus_pipeline.encoding_stage(spark, frame, "").collect() if x.doc_id != 3} == {None: 0, 1: 0, 2: 0}
