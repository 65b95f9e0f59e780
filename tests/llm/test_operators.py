"""The ten operators against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapewright.llm import byte_bpe, common, embedding_dedup, language_id, license_scan, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity
from shapewright.llm.common import Scratch, hub_join, labelled_sample
from shapewright.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " \t\n", "a", "Licensed under the MIT License.", "under the mit license cc by nc cc by nc", "é" * 3000, "the quick brown fox jumps over the lazy dog " * 40, "x y z\nx y z\n\nq", "IT!! WAS!! %%% ### | $$", "漢字 かな 🙂 It's we'll 12345"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = [(i, t, "en", None, 0, "clash") for i, t in enumerate(TEXTS)]
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    for k, text in enumerate(base):
        rows.append((100 + k, text, "en", "s", 1, None))
        rows.append((200 + k, text + " more", None, "s", 1, None))
        rows.append((300 + k, " ".join(text.split()[:100] + [word() for _ in range(20)]), "fr", "s", 1, None))
    rows += [(100, base[0], "en", "s", 1, None), (400, base[0], None, None, None, None), (None, base[1], "en", "s", 1, None), (None, None, None, None, None, None), (500, base[2], "de", "s", 1, None), (500, "another text with this id", "de", "s", 1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return df.select("doc_id", "text").collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(spark, docs):
    def base(text):
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        counts, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if counts[x] > 1:
                covered.update((i, i + 1, i + 2))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    got = quality_rules.base_rules(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert all(tuple(r)[1:] == base(r["text"]) for r in got) and len(got) == docs.count()
    trusted = spark.createDataFrame([(100 + k,) for k in range(12)], "doc_id long")
    ratios = quality_rules.ngram_ratios(docs, trusted, 64)
    slots = {r["t"]: r["g"] for r in quality_rules.hashed_ngrams(docs.selectExpr("text", "text as t"), 64).selectExpr("t", "_grams as g").collect()}
    raw, good, n = Counter(), Counter(), 0
    for r in rows_of(docs):
        raw.update(slots[r["text"]])
        if r["doc_id"] in range(100, 112):
            good.update(slots[r["text"]])
    for b, c in raw.items():
        p = c / sum(raw.values())
        assert math.isclose(ratios[b], math.log((good[b] + 64 * p) / (sum(good.values()) + 64) / p), abs_tol=1e-4)
    judged = quality_rules.quality_rules(docs, trusted, 64, threshold=-0.1)
    for r in judged.collect():
        g = slots[r["text"]]
        llr = sum(ratios[b] for b in g) / len(g) if g else 0.0
        assert math.isclose(r["llr"], llr, abs_tol=1e-9) and r["kept"] == (not r["base_failed"] and r["llr"] >= -0.1)
    assert quality_rules.keep(judged).count() == judged.where("kept").count()
    assert quality_rules.quality_rules(docs.limit(0), trusted, 64).count() == 0


def test_all_trusted_documents_are_counted(spark):
    n = 4600
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'even', 'odd') as text")
    labels = spark.range(n).selectExpr("id as doc_id", "if(id % 20 = 1, 0, 1) as quality").unionByName(spark.createDataFrame([(None, 1), (3, 0), (5, None), (2, 1)], "doc_id long, quality int"))
    trusted = quality_rules.trusted_ids(labels)
    want = {i for i in range(n) if i % 20 != 1 and i != 3}
    assert len(want) > 4000 and {r["doc_id"] for r in trusted.collect()} == want and trusted.count() == len(want)
    slots = {r["text"]: r["_grams"][0] for r in quality_rules.hashed_ngrams(docs.limit(2), 64).collect()}
    ratios = quality_rules.ngram_ratios(docs, trusted, 64)
    for rest, text in enumerate(("even", "odd")):
        good = sum(i % 2 == rest for i in want)
        assert math.isclose(ratios[slots[text]], math.log((good + 64 * 0.5) / (len(want) + 64) / 0.5), abs_tol=1e-4)


def test_sharding(docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    by_text, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for r in rows:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) == least_capacity([r["text"] for r in rows_of(docs)])
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def least_capacity(texts, shards=8):
    """Brute force: groups of at least an even share apart, then the least capacity over the others in order of their MD5."""
    groups = Counter()
    for t in texts:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    rest, apart = sum(groups.values()), []
    for k, n in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if shards - len(apart) > 1 and n * (shards - len(apart)) >= rest:
            apart.append(n)
            rest -= groups.pop(k)
        else:
            break
    ordered = [groups[k] for k in sorted(groups)]

    def needed(capacity):
        n, held = 1, 0
        for g in ordered:
            n, held = (n, held + g) if held + g <= capacity else (n + 1, g)
        return n

    return max([*apart, *([next(c for c in range(max(ordered), sum(ordered) + 1) if needed(c) <= shards - len(apart))] if ordered else [])])


@pytest.mark.parametrize("digits", [(3, 2), (1, 1)])
def test_sharding_is_even(spark, monkeypatch, digits):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits[0])
    monkeypatch.setattr(sharding, "MORE_DIGITS", digits[1])
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    rng = random.Random(41)
    small = ["".join(rng.choice("abc") for _ in range(rng.randrange(20, 400))) for _ in range(200)]
    for texts, many in ((small + ["hot" * 5333 + "x"] * 20, 8), (small + ["a"] * 300, 8), (small, 8), (small[:3], 3), (["same"] * 40, 1), (small + ["h" * 30_000, "i" * 9_000, "j" * 9_100], 8), (["long" * 400_000, *small], 8)):
        docs = spark.createDataFrame([(i if i % 7 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, shard int, row int")
        rows = sharding.shard_documents(docs).collect()
        sizes, slots = Counter(), defaultdict(list)
        for r in rows:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(rows) == len(texts) and len(sizes) == many and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(sizes.values()) == least_capacity(texts)
        groups = sorted(Counter({t: len(t) + 1 for t in texts} | {t: n * (len(t) + 1) for t, n in Counter(texts).items()}).values())
        # groups of their own aside, no shard is short of an even share by more than the others' largest group
        while groups and groups[-1] * many >= sum(groups) and many > 1:
            groups.pop()
            many -= 1
        if groups:
            assert min(sizes.values()) >= sum(groups) / many - max(groups), sizes


def test_byte_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = byte_bpe.coder(path, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("abcdeéüthion  \n\t's漢字🙂́0123<|>") for _ in range(rng.choice([1, 5, 60])))
        assert ours.encode(text) == theirs.encode_ordinary(text) and ours.decode(ours.encode(text)) == text.encode()
    for text in ("a" * 30000, " " * 3000, "ab" * 5000):
        assert ours.encode(text) == theirs.encode_ordinary(text)
    got = byte_bpe.round_trip_digests(docs, path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for r in rows_of(docs):
        ids = theirs.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    assert byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).count() == docs.count()


def test_language(spark):
    rng = random.Random(1)
    parts = {"en": ["th", "er", "on", "wh"], "fr": ["é", "que", "eau", "è"], "de": ["sch", "ü", "ung", "tz"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(parts) * 40)] + [(900, None, "en"), (901, "12 .", "fr"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = language_id.language_prototypes(docs.where("doc_id < 60"), 10, 256, 7)
    assert set(prototypes) == set(parts)
    got = {r["doc_id"]: r for r in language_id.identify_language(docs.select("doc_id", "text"), prototypes, 256, 7).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows[60:120])
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902))
    assert language_id.language_prototypes(docs.limit(0), 10, 256, 7) == {}
    # a bundle is the sum of its trigrams' bound vectors
    pairs, letters = language_id.bound_pairs(64, 3)
    grams, counts = language_id.text_trigrams(b"abcab")
    one = sum(n * pairs[g // 64].astype(int) * letters[g % 64] for g, n in zip(grams, counts, strict=True))
    assert np.array_equal(language_id.bundle(grams, counts, 64, 3), one)


def test_language_against_a_slow_version(spark, tmp_path):
    """The whole query with nulls, repeats, a long text, ties and clashing columns, each trigram bound by itself."""
    rng = random.Random(5)
    parts = {"de": ["sch", "ü", "ung"], "fr": ["é", "que", "eau"], "xx": ["漢", "字", "z"]}
    make = lambda lang, n=12: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) + rng.choice(["", "!", " 1"]) for _ in range(n))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(parts) * 12)]
    rows += [(50, None, "fr"), (51, "12 .", "de"), (52, "", None), (53, make("fr"), None), (54, make("de", 20_000), "de"), (None, make("xx"), "xx"), rows[4], rows[4]]
    rows = [(*r, "clash", -1.0) for r in rows]
    schema = "doc_id long, text string, lang string, lang_pred string, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    letters = language_id.bound_pairs(256, 7)[1].astype(np.int64)

    def vector(text):
        code, table = [0], language_id.letter_slots()
        for ch in text:
            if (slot := int(table[ord(ch)])) or code[-1]:
                code.append(slot)
        if len(code) == 1:
            return None
        code.append(0)
        grams = Counter(zip(code, code[1:], code[2:], strict=False))
        v = sum(n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for (a, b, c), n in grams.items())
        return v / np.linalg.norm(v)

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    sums = {}
    for i, text, lang, *_ in rows:
        if not held(i) and text is not None and lang is not None and (v := vector(text)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    prototypes = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    got = language_id.op3_language_id(spark, str(tmp_path), dimensions=256, seed=7)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = []
    for i, text, *_ in rows:
        v = vector(text or "")
        cosines = [] if v is None else [float(p @ v) for p in prototypes.values()]
        best = max(cosines, default=0)
        want.append((i, held(i), list(prototypes)[cosines.index(best)] if cosines else "und", 1 / sum(np.exp(40 * (c - best)) for c in cosines) if cosines else 0.0))
    order = lambda r: (r[0] is None, r[0] or 0)
    found = sorted(map(tuple, got.collect()), key=order)
    want.sort(key=order)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in found], [r[3] for r in want], atol=1e-3)
    # equal prototypes: the first in the alphabet
    same = language_id.identify_language(spark.createDataFrame(rows[:1], schema), {"a": prototypes["de"], "b": prototypes["de"]}, 256, 7).collect()
    assert [(r["lang_pred"], round(r["score"], 6)) for r in same] == [("a", 0.5)]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert language_id.op3_language_id(spark, f"{tmp_path}/empty").count() == 0


def test_toxicity():
    rng = random.Random(3)
    clean = [" ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(3)) for _ in range(40)) for _ in range(300)]
    toxic = [" ".join([*(w := c.split())[: (k := rng.randrange(40))], rng.choice(["stupid", "moron"]), *w[k:]]) for c in clean[:100]]
    counts = np.zeros(language_id.SLOTS**3, np.int64)
    for t in clean + toxic:
        code = np.concatenate(([0, 0], language_id.letter_slots()[[ord(c) for c in t]].astype(int), [0]))
        np.add.at(counts, (code[:-2] * 64 + code[1:-1]) * 64 + code[2:], 1)
    model = toxicity.CharacterModel(counts)
    assert model.restore(["then stuuupid\ner", "an s t u p i d an", "m0r0n.", "there"]) == ["then stupid\ner", "an stupid an", "moron.", "there"]
    lexicon = toxicity.train_lexicon(clean[100:] + toxic, [0] * 200 + [1] * 100)
    scores = lexicon.scores(model.restore(["theron m0r0n an", "s.t.u.p.i.d", "theron eran", "", clean[0]]), 0.01)
    assert (scores[:2] > 0.5).all() and (scores[2:] < 0.5).all()
    assert toxicity.train_lexicon(["a"], [1]).scores(["a", ""], 0.01).tolist() == [0.01, 0.01]
    assert toxicity.distinct_texts([clean[0], clean[0] + " on", clean[1], ""]) == [0, 2, 3]


def test_toxicity_reads_ends_and_doubles():
    texts = ["then kill on", "then stupid on", "then moron on", "hate there", "an ass then", "letter on"] * 50
    counts = np.zeros(language_id.SLOTS**3, np.int64)
    for t in texts:
        code = np.concatenate(([0, 0], language_id.letter_slots()[[ord(c) for c in t]].astype(int), [0]))
        np.add.at(counts, (code[:-2] * 64 + code[1:-1]) * 64 + code[2:], 1)
    model = toxicity.CharacterModel(counts)
    assert model.restore(["then ki11, on", "hat3.", "an a$$!", "stuupid moroon"]) == ["then kill, on", "hate.", "an ass!", "stupid moron"]
    assert model.restore(["letter then!", "s t u p i d", "12 on", ""]) == ["letter then!", "stupid", "12 on", ""]
    # a stretch of single letters stays whole beside a doubled one
    assert toxicity.suspect_stretches("letter-s-t-u-p-i-d on") == [(7, 18)]


def letter_counts(texts):
    counts = np.zeros(language_id.SLOTS**3, np.int64)
    for t in texts:
        code = np.concatenate(([0, 0], language_id.letter_slots()[[ord(c) for c in t]].astype(int), [0]))
        np.add.at(counts, (code[:-2] * 64 + code[1:-1]) * 64 + code[2:], 1)
    return counts


def test_viterbi_finds_the_best_of_all_readings():
    rng = random.Random(21)
    model = toxicity.CharacterModel(letter_counts(["then kill on", "stupid moron", "hate there", "an ass then", "letter all"] * 20))
    slots = language_id.letter_slots()

    def cost(readings):
        x, y, total = 0, 0, 0.0
        for reading, c in [*readings, ("\n", 0.0)]:
            total -= c
            for ch in reading:
                z = int(slots[ord(ch)])
                total += float(model.log[x, y, z])
                x, y = y, z
        return total

    for _ in range(150):
        seen = "".join(rng.choice("aelst1!|0$@7 .-4oo") for _ in range(rng.randrange(2, 8)))
        lattice = model.lattice(seen)
        every = [cost(r) for r in itertools.product(*lattice)]
        found = model._decode(seen)
        assert any("".join(x for x, _ in r) == found and math.isclose(c, max(every), abs_tol=1e-6) for r, c in zip(itertools.product(*lattice), every, strict=True)), seen


def test_lexicon_against_counts():
    """The features of a lexicon are those that a plain count says, and their chances too."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(2))
    texts = [" ".join([*(word() for _ in range(rng.randrange(5, 20))), *(["zonk"] if i % 3 == 0 else [])]) for i in range(90)]
    labels = [int(i % 3 == 0) for i in range(90)]
    lexicon = toxicity.train_lexicon(texts, labels)
    signs = set()
    for n in range(3, 5):
        signs.add("zonk"[:n])
    features, _, of, _ = toxicity.word_features(["zonk"])
    assert set(features.tolist()) == set(lexicon.features.tolist()) and len(features) == 3 and not of.any()  # zon-, zonk-, zonk
    bad, good = 0.1 * 1.0, 0.9 * 0.25 / 60
    assert np.allclose(lexicon.chances, bad / (bad + good), atol=1e-2)
    assert np.allclose(lexicon.scores([f"an zonk {w}" for w in ("th", "on")], 0.0), lexicon.chances.max())


def test_toxicity_of_whole_texts(spark):
    counts = letter_counts(["then stupid on", "then moron on", "an there"] * 30)
    lexicon = toxicity.Lexicon(*(lambda f: (f, np.full(len(f), 0.9)))(toxicity.word_features(["stupid"])[0]))
    long = "then on an " * 40_000
    rows = [(1, None), (2, ""), (3, "an stup1d on"), (3, "an stup1d on"), (None, "then s t u p i d"), (5, long + "stup1d " + long), (6, long), (7, "İİİ stupid"), (8, "\U0001d400 x"), (9, "ΣΑΣ STUPID")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, predicted int").coalesce(1)
    want = {1: 0.005, 2: 0.005, 3: 0.9, None: 0.9, 5: 0.9, 6: 0.005, 7: 0.9, 8: 0.005, 9: 0.9}
    got = toxicity.score_toxicity(docs, counts, lexicon, 0.005)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows)
    assert all(math.isclose(r["score"], want[r["doc_id"]], abs_tol=1e-9) and r["predicted"] == (r["score"] >= 0.5) for r in got.collect())
    assert toxicity.score_toxicity(docs.limit(0), counts, lexicon, 0.005).count() == 0
    # cutting and neighbours make no difference
    model, rng = toxicity.CharacterModel(counts), random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice("ab$1 .-\n") for _ in range(300))
        parts = toxicity.whole_parts(text, rng.randrange(1, 80))
        assert "".join(parts) == text and "".join(model.restore(parts)) == model.restore([text])[0]
    assert toxicity.whole_parts("", 5) == [""]


def test_license_scan(docs):
    def base(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            n = len(phrase.split())
            for i in range(len(w) - n + 1):
                if w[i : i + n] == phrase.split():
                    places.append(i)
                    labels.add(label)
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    got = license_scan.scan_licenses(docs).drop("labels", "score").collect()
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], *base(r["text"])) for r in rows_of(docs))
    scan = lambda t: license_scan.Scanner().scan(t.encode())[5]
    assert scan("Released under the GNU General Public License, version 3.") == "gpl-3"
    assert scan("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert scan("licensed under the Creative Commons Attribution-ShareAlike 4.0 license") == "cc-by-sa"
    assert scan("a clean text about permits and commits") == ""
    assert 200 <= len(license_scan.signature_rules()) <= 600


def test_neighbouring_licenses_keep_their_labels():
    scan = lambda t: license_scan.Scanner().scan(t.encode())[5]
    assert scan("MIT license, ISC license") == "isc,mit"
    assert scan("MIT license, ISC license, zlib license") == "isc,mit,zlib"
    # several readings of one place are still one
    assert scan("under the terms of the GNU Lesser General Public License version 3 license") == "lgpl-3"
    assert scan("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 license") == "cc-by-nc-sa"


def test_license_wordings_and_short_names():
    scan = lambda t: license_scan.Scanner().scan(t.encode())[5]
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions in binary form must reproduce the above copyright notice. "
    for text, label in (
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        (bsd, "bsd-2-clause"),
        (bsd + "Neither the name of the holder nor others", "bsd-3-clause"),
        (bsd + "All advertising materials mentioning features or use. Neither the name", "bsd-4-clause"),
        (bsd + "x " * 50 + bsd + "Neither the name of", "bsd-2-clause,bsd-3-clause"),
        ("licensed under the GPL v3", "gpl-3"),
        ("GPLv3", "gpl-3"),
        ("GNU General Public License", "gpl"),
        ("under the GNU Lesser General Public License", "lgpl"),
        ("GNU LGPL 2.1", "lgpl-2.1"),
        ("the BSD license", "bsd"),
        ("the BSD 3-Clause license", "bsd-3-clause"),
        ("the Apache License", "apache"),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
    ):
        assert scan(text) == label, text


def test_license_suppression_against_all_pairs():
    """Of the ungated rules' matches, sorted by importance, those stand that no standing one suppresses."""
    rng, scanner = random.Random(51), license_scan.Scanner()
    parts = "mit|isc license|under the terms of|the|gnu general public license|version 2|licensed under|apache license version 2 0|and|bsd 3 clause|license|creative commons attribution|non commercial|4 0|mozilla public license 2 0|zlib|spdx license identifier|" + "gpl 2 0 or later|all rights reserved|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software"
    for _ in range(150):
        text = " ".join(rng.choice(parts.split("|")) for _ in range(rng.randrange(1, 40)))
        found = [(m.span(), m.span("name"), r) for r in scanner.rules for m in r.expression.finditer(text)]
        found.sort(key=lambda d: (-d[2].priority, d[0][0] - d[0][1], d[0][0], d[2].label))
        standing = []
        for x in found:
            (a, b), (c, d), r = x
            inside = any(y[0][0] <= a and b <= y[0][1] for y in standing)
            same = any(a < y[0][1] and y[0][0] < b and y[2].label == r.label for y in standing)
            names = any(c < y[1][1] and y[1][0] < d for y in standing)
            if not (inside or same or names):
                standing.append(x)
        want = sorted((*x[0], x[2].label) for x in standing)
        assert [(a, b, r.label) for a, b, r in scanner.detections(text)] == want
        labels = {x[2].label for x in standing} | {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in f" {text} "}
        row = scanner.scan(text.encode())
        assert row[5] == ",".join(sorted(labels)) and row[6] == (1.0 if row[4] else max((x[2].confidence for x in standing), default=0.0))


def test_license_scan_of_long_texts(spark):
    text = "under the MIT license, some words. Permission is granted under GNU GPL version 3; " * 40_000  # 3 MB
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, labels string")
    start = time.time()
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert time.time() - start < 60
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (40_000, 0, got[1]["n_words"] - 14) and got[1]["labels"] == "gpl-3,mit"
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def written(parsed, rng):
    """A random text that an expression without look-around matches."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "BRANCH":
                out += written(rng.choice(arg[1]), rng)
            case "SUBPATTERN":
                out += written(arg[3], rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(written(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
            case "IN":
                kind, value = rng.choice(arg)
                out += "a" if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else value[0])
    return out


def test_license_keywords_are_necessary():
    rng = random.Random(9)
    scanner = license_scan.Scanner()
    for r in scanner.rules:
        for _ in range(60):
            text = written(re._parser.parse(r.expression.pattern), rng)
            if r.expression.search(text):
                assert any(k in text for k in r.keywords), (r.label, text)
                assert scanner.detections(text)
    labels = lambda t: scanner.scan(t.encode())[5]
    assert [labels(t) for t in ("GNU GPL version 3", "GNU LGPL 2.1", "AGPL v3", "gnu gpl 2")] == ["gpl-3", "lgpl-2.1", "agpl-3", "gpl-2"]


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(64, 100, 10), packing.Limits(50, 1, 50)])
def test_pack(limits):
    rng = random.Random(limits.segments)
    for _ in range(60):
        lengths = [rng.choice([0, 1, 5, limits.tokens, rng.randrange(3 * limits.tokens)]) for _ in range(rng.randrange(30))]
        loss = [rng.randrange(n + 1) for n in lengths]
        of, at = defaultdict(list), defaultdict(list)
        for p in packing.pack(lengths, loss, limits, 7):
            of[p.sequence].append(p)
            at[p.example].append((p.start, p.length))
        for e, n in enumerate(lengths):
            end = 0
            for start, length in sorted(at[e]):
                assert start == end and length > 0
                end += length
            assert end == n
        for ps in of.values():
            end = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == end
                end += p.length
            assert end <= limits.tokens and len(ps) <= limits.segments
            assert sum(max(0, p.start + p.length - max(p.start, loss[p.example])) for p in ps) <= limits.loss_tokens
            assert end == limits.tokens or end & (end - 1) == 0


def test_pack_weighs_all_three_dimensions():
    """Of two examples that fit, the one whose demand has the larger dot product with what is left goes first."""
    limits = packing.Limits(100, 10, 20)
    pieces = packing.pack([60, 60, 40, 40], [60, 40, 40, 20], limits)
    first = [p.example for p in pieces if p.sequence == 0]
    demand = np.array([200 / 100, 4 / 10, 40 / 20])
    value = [demand / demand.sum() @ [n / 100, 1 / 10, (n - f) / 20] for n, f in ((60, 60), (60, 40), (40, 40), (40, 20))]
    assert first[0] == int(np.argmax(value)) == 1 and first[1] == 2  # 3 has too many loss-bearing tokens beside 1


def test_pack_documents(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(8)
    own = packing.WordEncoder(path)
    for _ in range(500):
        text = "".join(rng.choice("abcDEéüñ İIKthion  \n\t's,.!漢🙂̱\x01\u00850123") for _ in range(rng.choice([3, 30])))
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    ids = lambda t: theirs.encode(t or "", add_special_tokens=False).ids

    def check(df, want, partitions):
        """Each document's ids once, in pieces whose sums and places are right; few sequences are short."""
        of, sequences = defaultdict(list), defaultdict(list)
        for r in df.collect():
            of[r["doc_id"], r["doc_tokens"]].append(r)
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        whole = defaultdict(list)
        for doc, found in want:
            whole[doc, len(found)].append(found)
        assert set(of) == set(whole)
        for k, rows in of.items():
            expected = Counter((r["start"], r["length"], r["ids_crc32"]) for r in rows)
            alone = all(x == whole[k][0] for x in whole[k])
            spans = Counter()
            for start, length, crc in expected.elements():
                spans.update(range(start, start + length))
                if alone:
                    assert crc == zlib.crc32(np.array(whole[k][0][start : start + length], "<u4").tobytes())
            assert spans == Counter({i: len(whole[k]) for i in range(k[1])})
        short = 0
        for places in sequences.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 4096 and end & (end - 1) == 0
            short += end < 4096
        assert short <= 13 * partitions  # the binary digits of one sequence each

    rows = rows_of(docs)
    check(packing.pack_documents(docs, path, round_rows=7), [(r["doc_id"], [*ids(r["text"]), 2]) for r in rows], docs.rdd.getNumPartitions())
    many = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).repartition(2).withColumn("length", F.lit("clash")).withColumn("ids", F.lit(1))
    check(packing.pack_documents(many, path, round_rows=5, round_tokens=3000), [(r["doc_id"], [*ids(r["text"]), 2]) for r in many.collect()], 2)
    asked = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.lit("Tell me, why?")).alias("question"))
    check(packing.pack_documents(asked, path, packing.Limits(loss_tokens=500), prompt="question", round_rows=9), [(r["doc_id"], [*ids(r["question"]), *ids(r["text"]), 2]) for r in asked.collect()], 10**6)
    long = spark.createDataFrame([(1, "Ünïcode wörds, and more. " * 60_000), (2, "漢字" * 50_000)], "doc_id long, text string")
    check(packing.pack_documents(long, path), [(r["doc_id"], [*ids(r["text"]), 2]) for r in long.collect()], 4)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def brute_links(rows):
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w := words(t)) >= 5 else ({tuple(w)} if w else set()) for _, t in rows]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            for j in js:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    return sets, links, root


def test_ngram_join(docs):
    rows = [tuple(r) for r in rows_of(docs)]
    sets, links, root = brute_links(rows)
    least = defaultdict(list)
    for (doc, _), r in zip(rows, root, strict=True):
        if doc is not None:
            least[r].append(doc)
    want = Counter((rows[i][0], min(least[root[i]], default=None) if sets[i] else rows[i][0], len(links[i])) for i in range(len(rows)))
    for block in (256, 4):
        got = ngram_join.similarity_join(docs, block=block).select("doc_id", "class_id", "n_links").collect()
        assert Counter(map(tuple, got)) == want
    assert ngram_join.similarity_join(docs.limit(0)).count() == 0
    fewest = ngram_join.least_matches(0.8, 1e-6)
    assert fewest == sorted(fewest) and 0 < fewest[0] < 0.8 * ngram_join.STEP


def test_ngram_join_compares_texts_without_ids(spark):
    rng = random.Random(12)
    w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    changed = lambda *ends: " ".join("x" + x if any(i in e for e in ends) else x for i, x in enumerate(w))
    left, right = range(14), range(186, 200)
    # 1 and 2 are linked through a text without an id only
    rows = [(1, changed(left)), (2, changed(right)), (None, changed()), (None, changed()), (None, "y " + changed(left, right)), (None, " ".join(reversed(w))), (3, " ".join(reversed(w[1:])))]
    sets, links, root = brute_links(rows)
    assert 1 not in links[0] and {2, 3} <= set(links[0]) & set(links[1])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = Counter((rows[i][0], least[root[i]], len(links[i])) for i in range(len(rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 1):
        got = ngram_join.similarity_join(docs, block=block).select("doc_id", "class_id", "n_links").collect()
        assert Counter(map(tuple, got)) == want


def test_ngram_join_of_long_texts_in_small_blocks(spark):
    rng = random.Random(15)
    long = " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 9) for _ in range(60_000))
    rows = [(i, long + " end" * i) for i in range(4)] + [(9, "short one " * 30), (10, "short one " * 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, links, root = brute_links(rows)
    want = Counter((i, rows[root[k]][0], len(links[k])) for k, (i, _) in enumerate(rows))
    got = ngram_join.similarity_join(docs, block_shingles=50_000).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == want and sum(map(len, links)) >= 12


def test_one_of_each_class_stays(spark):
    rng = random.Random(13)
    u, v, w, x = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4))
    rows = [(2, u, "a"), (3, u + " more", "a"), (3, v, "b"), (4, w, "a"), (4, w, "a"), (4, w + " more", "c"), (None, x, None), (None, x, None), (None, x + " more", None), (None, u + " less", None)]
    rows += [(7, None, "a"), (7, None, "a"), (8, "", "a"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, c, 1, 2, c) for i, t, c in rows], "doc_id long, text string, class_id string, _key int, n_links int, copies string")
    out = ngram_join.one_of_each_class(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got.pop((None, x), 0) + got.pop((None, x + " more"), 0) == 1  # neither has an id: any one of them
    assert got.pop((4, w), 0) + got.pop((4, w + " more"), 0) == 1  # an id's several texts: any one
    assert got == Counter([(2, u), (3, v), (7, None), (7, None), (8, ""), (None, None)])
    assert ngram_join.one_of_each_class(docs.limit(0)).count() == 0
    # rows that repeat one document
    same = docs.where("doc_id = 4 and class_id = 'a'").unionByName(docs.where("doc_id = 2"))
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each_class(same).collect()) == [2, 4]


def test_hub_join(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HUB", 0)
    left = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (3, 1), (None, 2)) for i in range(n)], "k int, i int")
    right = spark.createDataFrame([(1, "x", 500), (2, "y", 3), (4, "z", 0)], "k int, v string, n int")
    for how in ("inner", "left"):
        want = Counter(map(tuple, left.join(right.drop("n"), "k", how).collect()))
        assert Counter(map(tuple, hub_join(left, right, "k", "n", 506, how, share=100).collect())) == want


@pytest.mark.parametrize("least", [0, 100_000])
def test_components_of_hubs_and_chains(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_HUB", least)
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(rng.randrange(6000, 6100), rng.randrange(6000, 6100)) for _ in range(80)] + [(7, 7), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {(x, find(x)) for x in list(root)}
    df = spark.createDataFrame(edges, "u long, v long")
    got = connected_components(df, Scratch(spark, "test"), "c").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(300):
        v = centres[k % 6] + rng.normal(size=8) * rng.choice([0.02, 0.1, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    rows += [(1, rows[1][1], 1), (400, rows[5][1], 1), (401, rows[5][1], None), (402, None, 1), (403, [0.0] * 8, 1), (404, [float("nan")] * 8, 1), (405, [], 0), (406, [None] * 8, 0), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    rows += [(None, rows[5][1], 1), (None, rows[9][1], 1), (None, [3.0, -1.0, 0.5], 1), (None, [3.0, -1.0, 0.5], 1), (None, None, 1), (409, [0.1] * 300, 0), (410, [0.1] * 300, 0)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int, weight int")
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in good}
    root = {i: math.inf if rows[i][0] is None else rows[i][0] for i in range(len(rows))}
    for _ in range(len(rows)):
        for i in good:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    root = {i: None if r == math.inf else r for i, r in root.items()}
    want = Counter((rows[i][0], len(links.get(i, [])), root[i], rows[i][0] == root[i]) for i in range(len(rows)))
    for options in ({}, {"cell_rows": 20, "block": 8, "sample_rows": 60}):
        assert Counter(map(tuple, embedding_dedup.near_duplicate_vectors(vectors, **options).collect())) == want
    assert embedding_dedup.near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_quality_classifier(spark):
    rng = random.Random(6)
    make = lambda: " ".join("".join(rng.choice(["th", "er", "on", "an"]) for _ in range(3)) for _ in range(40))
    good, junk = [make() for _ in range(120)], [make().upper().replace(" ", "!! ") for _ in range(60)] + [" ".join([make().split()[0]] * 60) for _ in range(60)]
    texts, labels = good[:80] + junk[:40] + junk[60:100], [1] * 80 + [0] * 80
    w = quality_classifier.train([t.encode() for t in texts], labels, bits=14)
    rows = [(i, t, "x") for i, t in enumerate(good[80:] + junk[40:60] + junk[100:])] + [(900, None, "x"), (901, "", "x"), (None, " ", "x")]
    got = {r["doc_id"]: r for r in quality_classifier.score_quality(spark.createDataFrame(rows, "doc_id long, text string, score string"), w, 14).collect()}
    assert all(got[i]["predicted"] == (i < 40) for i in range(80))
    assert got[900]["score"] == got[901]["score"] == got[None]["score"] == 0.0
    # a text's score doesn't depend on those beside it
    data = pa.array([r[1] for r in rows[:80]])
    offsets, buffer = quality_classifier.utf8_buffers(data)
    alone = [quality_classifier.text_scores(offsets[i : i + 2], buffer, w, 14, 0.0)[0] for i in range(80)]
    assert np.allclose(alone, [got[i]["score"] for i in range(80)], atol=1e-9)
    assert not quality_classifier.train([b"a"], [1], bits=8).any()
    assert quality_classifier.score_quality(spark.createDataFrame([], "text string, predicted string"), w, 14).collect() == []


def slow_ngrams(text, bits):
    """Word and character n-grams one by one, by the hashes of single words and n-grams."""
    words = [x for x in re.split(rb"[\x20\x09-\x0D]+", text) if x]
    alone = lambda data: next(quality_classifier.text_ngrams(np.frombuffer(data, np.uint8), bits))[0].tolist()
    ones = [alone(x)[0] for x in words]
    pairs = [alone(a + b" " + b)[2] for a, b in itertools.pairwise(words)]
    chars = []
    for n in (2, 3, 4):
        for i in range(len(text) + 2 - n):
            gram = (text + b"\n")[i : i + n]
            if not re.search(rb"[\x20\x09-\x0D]", gram[:-1]):
                points = np.frombuffer(gram, np.uint8)
                chars.append(int(quality_classifier._char_buckets(quality_classifier._RANDOM[points], quality_classifier._BLANK[points], bits)[0][n - 2][0]))
    return Counter(ones + pairs), Counter(chars)


def test_quality_ngrams_whatever_the_pieces():
    rng = random.Random(31)
    for size in (0, 1, 2, 7, 60, 200):
        for letters in ("ab \n", "abcdé", "a  "):
            text = "".join(rng.choice(letters) for _ in range(size)).encode()
            want = slow_ngrams(text, 16) if size < 100 else None
            for at_once in (1, 2, 3, 16, 1 << 19):
                found = list(quality_classifier.text_ngrams(np.frombuffer(text, np.uint8), 16, at_once))
                got = tuple(Counter(np.concatenate([f[k] for f in found]).tolist()) for k in (0, 1))
                want = want or got
                assert got == want, (text, at_once)


def test_quality_scores_against_a_slow_scorer(spark):
    rng, random_weights = random.Random(32), np.random.default_rng(1).normal(0, 3, 1 << 16).astype(np.float32)
    texts = ["", " \n", "a", "".join(rng.choice("ab cd\n") for _ in range(400)), "abc" * 200, "漢字かな" * 100]

    def slow(text):
        parts = [sum(random_weights[g].astype(float) * n for g, n in c.items()) / max(1, sum(c.values())) for c in slow_ngrams(text.encode(), 16)]
        return 1 / (1 + math.exp(-sum(parts) / 2)) if text.split() else 0.0

    offsets, data = quality_classifier.utf8_buffers(pa.array(texts))
    for at_once in (5, 64, 1 << 19):
        got = quality_classifier.text_scores(offsets, data, random_weights, 16, 0.0, at_once)
        assert np.allclose(got, list(map(slow, texts)), atol=1e-9)


def test_labelled_sample(spark):
    texts = {i: "x" * (10 * i) for i in range(40)}
    docs = spark.createDataFrame([*((i, t) for i, t in texts.items()), (5, None), (50, None), (None, "x"), (7, "aa")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(40)), (50, 1), (None, 1), (3, 0), (4, None), (8, 0)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), (100, 100), 1 << 20)
    assert {r["doc_id"]: (r["text"], r["label"]) for r in got} == {i: ("aa" if i == 7 else t, i % 2) for i, t in texts.items() if i != 3}
    few = labelled_sample(docs, labels, "toxic", F.lit(True), (5, 3), 1 << 20)
    assert Counter(r["label"] for r in few) == {0: 5, 1: 3} and set(few) <= set(got)
    small = labelled_sample(docs, labels, "toxic", F.lit(True), (100, 100), 500)
    assert 450 < sum(len(r["text"]) for r in small) <= 500
