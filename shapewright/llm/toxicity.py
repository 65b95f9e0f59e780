"""Operator 5: toxicity by noisy-channel deobfuscation.

Stretches of a text that may be disguised (look-alike symbols among letters or at a word's end, letters
said twice or more, single letters set apart) become character lattices: each observed symbol may
stand for several letters, a run for one or two of its letter, a separator for nothing. Viterbi decoding under a
character trigram model of the whole corpus picks the reading, and the restored text is scored by
learned words and word beginnings. A stretch without any of these has one reading, itself, so it is
not decoded.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, slices, table, utf8_buffers, with_fields
from .language_id import SLOTS, letter_slots

#: What a symbol may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*"
COST_LOOKALIKE, COST_KEPT, COST_RUN, COST_RUN_KEPT, COST_JOIN, COST_APART, COST_DOUBLE = 1.0, 14.0, 0.5, 3.0, 0.3, 2.5, 4.0
REMEMBERED, AT_ONCE = 200_000, 1 << 18

_L = r"[^\W\d_]"
_S = "[" + re.escape("".join(LOOKALIKES)) + "]"
_ANY = rf"(?:{_L}|{_S})"
SPACED = re.compile(rf"(?<!\w){_ANY}(?:[{re.escape(SEPARATORS)}]{_ANY}){{2,}}(?!\w)", re.IGNORECASE)  # s t u p i d
SUSPECT = re.compile(rf"({_L})\1\1|{_L}{_S}+{_L}|^[^\w\s]*{_S}{_L}", re.IGNORECASE)  # stuuupid, st00pid, $tupid
#: Look-alikes at a word's end, before sentence punctuation: ki11, a$$.
AT_END = re.compile(rf"{_L}{_S}*[{re.escape(''.join(c for c in LOOKALIKES if c not in '!|'))}][\"')\]}}>.,;:?!|]*$", re.IGNORECASE)
_EDGE = re.compile(r"^[\"'(\[{<]+|[\"')\]}>.,;:?!|]+$")


_KIND: list[np.ndarray] = []


def suspect_stretches(text: str) -> list[tuple[int, int]]:
    """Ascending stretches that may be disguised: blank-separated tokens with SUSPECT in them, matches of SPACED,
    and, where they overlap none of these, tokens with AT_END or a doubled letter in them."""
    if not _KIND:
        kind = (letter_slots() > 0).astype(np.uint8)
        for c in LOOKALIKES:
            kind[ord(c)] |= 2 if c in "!|" else 2 | 16
        for c in SEPARATORS:
            kind[ord(c)] |= 4
        for c in " \t\n\v\f\r":
            kind[ord(c)] |= 8
        _KIND.append(kind)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(points) < 3:
        return []
    kind = _KIND[0][points]
    same = points[1:] == points[:-1]
    run = same[1:] & same[:-1] & (kind[2:] & 1 > 0)
    sign = (kind[:-1] & 2 > 0) & (kind[1:] & 1 > 0)
    places = np.union1d(np.flatnonzero(run), np.flatnonzero(sign))
    found = []
    blanks = np.concatenate(([-1], np.flatnonzero(kind & 8), [len(points)]))
    after = np.unique(np.searchsorted(blanks, places, side="left"))
    for a, b in zip((blanks[after - 1] + 1).tolist(), blanks[after].tolist(), strict=True):
        if SUSPECT.search(text[a:b]):
            found.append((a, b))
    double = same & (kind[1:] & 1 > 0)
    last = (kind[:-1] & 3 > 0) & (kind[1:] & 16 > 0)
    weak = []
    doubled = set(np.unique(np.searchsorted(blanks, np.flatnonzero(double), side="left")).tolist())
    for k in sorted(doubled.union(np.searchsorted(blanks, np.flatnonzero(last), side="left").tolist())):
        a, b = int(blanks[k - 1]) + 1, int(blanks[k])
        if k in doubled or AT_END.search(text[a:b]):
            weak.append((a, b))
    one, gap = kind & 3 > 0, kind & 4 > 0
    if len(points) >= 5:
        done = -1
        for i in np.flatnonzero(one[:-4] & gap[1:-3] & one[2:-2] & gap[3:-1] & one[4:]).tolist():
            if i > done and (m := SPACED.match(text, i)):
                done = m.end()
                found.append(m.span())
        found.sort()
    apart, last = [], -1
    for a, b in found:  # an overlapping stretch goes, the earlier stays
        if a >= last:
            apart.append((a, b))
            last = b
    starts, whole = [a for a, _ in apart], list(apart)
    for a, b in weak:
        i = bisect.bisect_left(starts, b)
        if not i or apart[i - 1][1] <= a:
            whole.append((a, b))
    whole.sort()
    return whole


_APART = re.compile(r"[^\W\d_]{2}[ \t\n\v\f\r]")


def whole_parts(text: str, least: int) -> list[str]:
    """A text in parts of at least so many characters that end where no stretch and no word goes on.

    A blank after two letters is such a place: it ends a token, and no single letters set apart span it.
    """
    parts, at = [], 0
    while len(text) - at > least and (m := _APART.search(text, at + least - 1)):
        parts.append(text[at : m.end()])
        at = m.end()
    return [*parts, text[at:]] if at < len(text) or not parts else parts


class CharacterModel:
    """Trigram log-probabilities of letter slots, interpolated with shorter ones; slot 0 is any other character."""

    def __init__(self, trigrams: np.ndarray):
        three = trigrams.reshape(SLOTS, SLOTS, SLOTS).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SLOTS)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)
        self.memo: dict[str, str] = {}

    def restore(self, texts: list[str]) -> list[str]:
        """The texts with their suspect stretches read; a stretch lies within a text."""
        whole = "\n".join(texts)
        parts, at = [], 0
        for a, b in suspect_stretches(whole):
            new = self.reading(whole[a:b])
            parts += [whole[at:a], new]
            at = b
        if not parts:
            return texts
        lines = [t.count("\n") + 1 for t in texts]
        flat = "".join([*parts, whole[at:]]).split("\n")
        out, at = [], 0
        for n in lines:
            out.append("\n".join(flat[at : at + n]))
            at += n
        return out

    def reading(self, seen: str) -> str:
        """The likeliest reading of a stretch; punctuation at its end stays."""
        found = self.memo.get(seen)
        if found is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            head = _EDGE.match(seen) if seen[:1] in "\"'([{<" else None
            start = head.end() if head else 0
            tail = _EDGE.search(seen, start)
            end = tail.start() if tail and tail.end() == len(seen) else len(seen)
            found = self.memo[seen] = seen[:start] + self._decode(seen[start:end]) + seen[end:]
        return found

    @staticmethod
    def lattice(seen: str) -> list[list[tuple[str, float]]]:
        """For each symbol or run: (reading, cost) of everything it may stand for."""
        apart = re.fullmatch(rf"{_ANY}(?:[{re.escape(SEPARATORS)}]{_ANY})+", seen) is not None
        steps: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(seen):
            c = seen[i]
            n = 1
            while i + n < len(seen) and seen[i + n].lower() == c.lower():
                n += 1
            if c.isalpha():
                if n >= 3:
                    steps.append([(c, COST_RUN), (seen[i : i + 2], COST_RUN + 0.2), (seen[i : i + n], COST_RUN_KEPT)])
                elif n == 2:  # most are said as they are written
                    steps.append([(c, COST_DOUBLE), (seen[i : i + 2], 0.0)])
                else:
                    steps.append([(c, 0.0)])
            else:
                for x in seen[i : i + n]:
                    if apart and x in SEPARATORS:
                        steps.append([("", COST_JOIN), (x, COST_APART)])
                    else:
                        steps.append([(y, COST_LOOKALIKE) for y in LOOKALIKES.get(x, "")] + [(x, COST_KEPT if x in LOOKALIKES else 0.0)])
            i += n
        return steps

    def _decode(self, seen: str) -> str:
        slots = letter_slots()
        log = self.log
        # (slot before last, last slot) -> (score, place of the way here); ways are linked backwards
        ways: list[tuple[int, str]] = [(-1, "")]
        best = {(0, 0): (0.0, 0)}
        for options in [*self.lattice(seen), [("\n", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, int, str]] = {}
            for (a, b), (score, way) in best.items():
                for reading, cost in options:
                    x, y, total = a, b, score - cost
                    for ch in reading:
                        z = int(slots[ord(ch)])
                        total += float(log[x, y, z])
                        x, y = y, z
                    old = after.get((x, y))
                    if old is None or total > old[0]:
                        after[x, y] = (total, way, reading)
            best = {}
            for state, (total, way, reading) in after.items():
                ways.append((way, reading))
                best[state] = (total, len(ways) - 1)
        way = max(best.values())[1]
        parts = []
        while way > 0:
            way, reading = ways[way]
            parts.append(reading)
        return "".join(reversed(parts[1:]))  # without the end


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts of docs. Each task adds up its own, so SLOTS ** 3 rows a task are shuffled at most."""

    def counted(batches):
        total = np.zeros(SLOTS**3, np.int64)
        for batch in batches:
            offsets, data = utf8_buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets), AT_ONCE):
                text = b"\n\n".join([data[a:b].tobytes() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)])
                code = letter_slots()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
                code = np.concatenate(([0, 0], code, [0]))
                total += np.bincount((code[:-2] * SLOTS + code[1:-1]) * SLOTS + code[2:], minlength=SLOTS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    counts = np.zeros(SLOTS**3, np.int64)
    for r in docs.select("text").mapInArrow(counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # SLOTS ** 3 rows at most
        counts[r["gram"]] = r["n"]
    return counts


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SHORTEST, LONGEST = 3, 10


_LOWER: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """Code point -> code point of its lower case (the first, where there are several), whatever stands beside it."""
    if not _LOWER:
        _LOWER.append(np.array([cp if 0xD800 <= cp < 0xE000 else ord(chr(cp).lower()[0]) for cp in range(0x110000)], np.uint32))
    return _LOWER[0]


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, word before, word number, text number) of each beginning and short whole word of all words of these texts."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    points = lower_letters()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)]
    letter = letter_slots()[points] > 0
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False]))) + 1 - starts
    text = np.searchsorted(ends, starts, side="right")
    state = np.zeros(len(starts), np.uint64)
    found, of = [], []
    alive = np.arange(len(starts))
    with np.errstate(over="ignore"):
        for k in range(1, LONGEST + 1):
            alive = alive[sizes[alive] >= k]
            h = (state[alive] ^ (points[starts[alive] + k - 1].astype(np.uint64) + np.uint64(1)) * _A) * _B
            h ^= h >> np.uint64(32)
            state[alive] = h
            if k >= SHORTEST:
                found.append(h * _A)
                of.append(alive)
                short = sizes[alive] == k
                found.append((h[short] ^ np.uint64(0x5555)) * _B)
                of.append(alive[short])
    word = np.concatenate(of) if of else np.zeros(0, np.int64)
    before = np.concatenate((np.zeros(1, np.uint64), state[:-1]))
    before[np.concatenate(([True], text[1:] != text[:-1]))] = 0
    return np.concatenate(found), before[word], word, text[word]


class Lexicon:
    """Features and how likely each of them is a sign of toxic texts."""

    def __init__(self, features: np.ndarray, chances: np.ndarray):
        order = np.argsort(features)
        self.features, self.chances = features[order], chances[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(features >> np.uint64(48)).astype(np.int64)] = True

    def clear(self, texts: list[str]) -> np.ndarray:
        """The chance that none of a text's words is a sign; a word counts by its likeliest feature."""
        none = np.ones(len(texts))
        if not len(self.features):
            return none
        features, _, word, text = word_features(texts)
        near = self.maybe[(features >> np.uint64(48)).astype(np.int64)]
        features, word, text = features[near], word[near], text[near]
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        hit = self.features[at] == features
        word, text, chance = word[hit], text[hit], self.chances[at[hit]]
        order = np.lexsort((-chance, word))
        first = order[np.concatenate(([True], np.diff(word[order]) > 0))] if len(order) else order
        np.multiply.at(none, text[first], 1 - chance[first])
        return none

    def scores(self, texts: list[str], otherwise: float) -> np.ndarray:
        return np.maximum(otherwise, 1 - self.clear(texts))


def train_lexicon(texts: list[str], labels: list[int], least: int = 3, signs: float = 1e-5, slips: float = 0.03, base_rate: float = 0.1) -> Lexicon:
    """The features that labelled, restored texts show to be signs, all those likelier to be one than not.

    A feature's occurrences behind different words are counted, so that copies of one text count
    once. A sign's come from toxic texts but for the share `slips`; any other feature's come from
    both kinds in proportion to their words. `signs` is the share of signs among all features,
    base_rate that of toxic texts.
    """

    def counted(chosen: list[str], only: np.ndarray | None, signs: np.ndarray, copies: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(features, in how many contexts or, with copies, texts; number of words) over words without any of signs."""
        keys, features, words, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0, 0
        for i, j in slices(map(len, chosen), AT_ONCE):
            found, before, word, text = word_features(chosen[i:j])
            if len(word):
                words += len(np.unique(word))
                told = np.zeros(word.max() + 1, bool)
                told[word[np.isin(found, signs)]] = True
                keep = ~told[word]
                if only is not None:
                    keep &= np.isin(found, only)
                found, other = found[keep], (text[keep] + first).astype(np.uint64) if copies else before[keep]
                with np.errstate(over="ignore"):
                    key, at = np.unique((found ^ (other + np.uint64(1)) * _B) * _A, return_index=True)
                keys.append(key)
                features.append(found[at])
            first += j - i
        _, at = np.unique(np.concatenate(keys), return_index=True)
        return *np.unique(np.concatenate(features)[at], return_counts=True), words

    bad, good = ([t for t, y in zip(texts, labels, strict=True) if y == x] for x in (1, 0))
    if not bad or not good:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    sure, sure_chance = np.zeros(0, np.uint64), np.zeros(0)
    for _ in range(2):  # again without the words that sure signs explain
        features, n_bad, words_bad = counted(bad, None, sure, False)
        features, n_bad = features[n_bad >= least], n_bad[n_bad >= least]
        n_good, bad_texts, good_texts = (np.zeros(len(features)) for _ in range(3))
        for counts, chosen, copies in ((n_good, good, False), (bad_texts, bad, True), (good_texts, good, True)):
            other, n, words_good = counted(chosen, features, sure, copies)
            counts[np.searchsorted(features, other)] = n
        share = min(max(words_bad / max(1, words_bad + words_good), 0.01), 0.5)
        odds = np.log(signs) + n_bad * np.log((1 - slips) / share) + n_good * np.log(slips / (1 - share))
        # a sign tells as much as the texts with it that are toxic, of all such texts
        p_bad = base_rate * bad_texts / len(bad)
        p_good = (1 - base_rate) * (good_texts + 0.25) / len(good)
        chance = p_bad / (p_bad + p_good) / (1 + np.exp(-np.clip(odds, -50, 50)))
        if not len(sure):
            sure, sure_chance = features[chance >= 0.95], chance[chance >= 0.95]
    rest = (chance >= 0.5) & (chance < 0.95)
    return Lexicon(np.concatenate((sure, features[rest])), np.concatenate((sure_chance, chance[rest])))


def score_toxicity(docs: DataFrame, counts: np.ndarray, lexicon: Lexicon, otherwise: float) -> DataFrame:
    """docs (with text) plus score and predicted; its other columns pass through, but for these two names and text.

    Null and empty texts have the score `otherwise`, as all have without a sign, so those tie. Repeated
    rows score alike, whatever stands beside them. Very long texts are scored whole, in parts that no
    word or stretch spans. An empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    # 8 * SLOTS ** 3 bytes and the lexicon's bounded table, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((counts, lexicon))
    kept = [c for c in docs.columns if c != "text"]

    def scored(batches):
        counts, lexicon = shared.value
        model = CharacterModel(counts)
        for batch in batches:
            scores, texts = [], [t or "" for t in batch.column("text").to_pylist()]
            for i, j in slices(map(len, texts), AT_ONCE):
                if j == i + 1:  # perhaps very long
                    clear = np.prod([lexicon.clear(model.restore([part])) for part in whole_parts(texts[i], AT_ONCE)], axis=0)
                else:
                    clear = lexicon.clear(model.restore(texts[i:j]))
                scores.append(np.maximum(otherwise, 1 - clear))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(scored, with_fields(docs.drop("text"), "score double, predicted int"))


def distinct_texts(texts: list[str]) -> list[int]:
    """Numbers of the texts that are no near copy of an earlier one, by six pairs of MinHashes of 4-word shingles."""
    seen: set[tuple[int, int, int]] = set()
    kept = []
    factors = np.random.default_rng(5).integers(1, 1 << 62, 12, np.uint64) * np.uint64(2) + np.uint64(1)
    for k, text in enumerate(texts):
        words = np.fromiter(map(xxhash.xxh64_intdigest, text.split()), np.uint64)
        with np.errstate(over="ignore"):
            shingles = words
            for i in range(1, min(4, len(words))):
                shingles = shingles[:-1] * _A + words[i:]
            least = [int((shingles * f ^ (shingles >> np.uint64(31))).min()) if len(shingles) else 0 for f in factors]
        keys = {(i, least[i], least[i + 6]) for i in range(6)}
        if not keys & seen:
            kept.append(k)
        seen |= keys
    return kept


def train_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, rows_per_class: tuple[int, int] = (3000, 2000), most_bytes: int = 1 << 26) -> tuple[np.ndarray, Lexicon, float]:
    """(character counts of all docs, lexicon, score of texts without a sign).

    Labels come from a sample that rows_per_class and most_bytes bound (see labelled_sample).
    """
    counts = character_counts(docs)
    sample = labelled_sample(docs, labels, "toxic", keep, rows_per_class, most_bytes)
    sample = [sample[k] for k in distinct_texts([r["text"] for r in sample])]
    texts, labels = [r["text"] for r in sample], [r["label"] for r in sample]
    model, restored = CharacterModel(counts), []
    for i, j in slices(map(len, texts), AT_ONCE):
        restored += model.restore(texts[i:j])
    return counts, train_lexicon(restored, labels), 0.005


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = train_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score_toxicity(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), *learned)


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
