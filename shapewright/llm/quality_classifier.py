"""Operator 10: quality classifier by supervised subword embeddings.

Hashed word and character n-grams have learned vectors; a document's is half the mean of its word
n-grams and half that of its character n-grams, a softmax layer on it gives the score, and both are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled documents. As the mean and the layer are linear, scoring needs one number
per bucket: its vector's contribution to the difference of the two logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from .common import fold, labelled_sample, slices, table, utf8_buffers, with_fields

AT_ONCE = 1 << 19
LENGTHS = (2, 3, 4)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(kind * 0x51ED2701)) * _MIX
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _word_sums(points: np.ndarray, blank: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words among these bytes; of the word at their beginning `known` bytes came before.

    A word's hash adds up its bytes' numbers times odd powers of their place in it.
    """
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    ends = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
    first = np.repeat(starts, ends - starts)
    chars = np.flatnonzero(~blank)
    rank = (chars - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        if known and starts[0] == 0:
            rank[: ends[0]] += np.uint64(known)
        value = points[chars] * (_MIX * (rank * np.uint64(2) + np.uint64(1)) ^ (rank << np.uint64(17)) | np.uint64(1))
        value ^= value >> np.uint64(31)
    return starts, ends, np.add.reduceat(value, np.concatenate(([0], np.cumsum(ends - starts)[:-1])))


def _word_buckets(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and of pairs of neighbouring words (one bucket for all pairs of equal words)."""
    a, b = words[:-1], words[1:]
    with np.errstate(over="ignore"):
        pairs = np.where(a == b, np.int32(0), _bucket(a * np.uint64(3) + b * _MIX, 2, bits))
    return _bucket(words, 1, bits), pairs


def _char_buckets(points: np.ndarray, blank: np.ndarray, bits: int, seen: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(buckets, places of first bytes) of the n-grams of each length that end behind the first `seen` bytes."""
    found, places = [], []
    rolling = points.copy()
    for n in range(2, max(LENGTHS) + 1):
        if len(points) < n:
            break
        with np.errstate(over="ignore"):
            rolling = rolling[:-1] * _MIX + points[n - 1 :]
            rolling ^= rolling >> np.uint64(32)
        if n in LENGTHS:
            # an n-gram may end with one blank, but none stands before its end
            ok = ~blank[: len(points) - n + 1]
            for k in range(1, n - 1):
                ok &= ~blank[k : len(points) - n + 1 + k]
            ok[: max(0, seen - n + 1)] = False
            keep = np.flatnonzero(ok)
            found.append(_bucket(rolling[keep], 2 + n, bits))
            places.append(keep)
    return found, places


def text_ngrams(part: np.ndarray, bits: int, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of word n-grams, buckets of character n-grams) of one text, at_once bytes at a time.

    Words and n-grams that go on over the end of a piece are carried into the next: it makes no
    difference to what is found where the pieces end.
    """
    known, begun, before = 0, np.uint64(0), None  # an unfinished word's length and hash so far, the word before
    for at in range(0, len(part) + 1, at_once):
        piece = part[at : at + at_once]
        if at + at_once > len(part):
            piece = np.concatenate((piece, np.full(1, 10, np.uint8)))  # a blank ends the text
        blank, points = _BLANK[piece], _RANDOM[piece]
        starts, ends, words = _word_sums(points, blank, known)
        if known:
            with np.errstate(over="ignore"):
                if len(starts) and starts[0] == 0:
                    words[0] += begun
                else:
                    words = np.concatenate((np.full(1, begun, np.uint64), words))
        if not blank[-1]:  # the last word goes on
            known = int(ends[-1] - starts[-1]) + (known if starts[-1] == 0 else 0)
            begun, words = words[-1], words[:-1]
        else:
            known, begun = 0, np.uint64(0)
        # the word before the first is there for its pair only
        ones, pairs = _word_buckets(words if before is None else np.concatenate(([before], words)), bits)
        if before is not None:
            ones = ones[1:]
        if len(words):
            before = words[-1]
        lead = part[max(0, at - max(LENGTHS) + 1) : at]
        chars, _ = _char_buckets(np.concatenate((_RANDOM[lead], points)), np.concatenate((_BLANK[lead], blank)), bits, len(lead))
        yield np.concatenate((ones, pairs)), np.concatenate([np.zeros(0, np.int32), *chars])


def ngram_weights(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text: half the weight is spread over its word n-grams, half over its character n-grams."""
    kinds: tuple[list, list] = ([], [])
    for found in text_ngrams(np.frombuffer(text, np.uint8), bits):
        for kind, grams in zip(kinds, found, strict=True):
            kind.append(np.unique(grams, return_counts=True))
    seen, weights = [], []
    for kind in kinds:
        total = max(1, sum(int(n.sum()) for _, n in kind))
        seen += [grams for grams, _ in kind]
        weights += [n * (0.5 / total) for _, n in kind]
    every, place = np.unique(np.concatenate(seen), return_inverse=True)
    return every, np.bincount(place, np.concatenate(weights), minlength=len(every)).astype(np.float32)


def train(texts: list[bytes], labels: list[int], bits: int = 18, dimensions: int = 8, epochs: int = 6, rate: float = 2.0, seed: int = 11) -> np.ndarray:
    """Contribution of each bucket to the logit difference (label 1 less label 0), bias included.

    Without examples of both labels all contributions are 0.
    """
    contribution = np.zeros(1 << bits, np.float32)
    if len(set(labels)) < 2:
        return contribution
    rng = np.random.default_rng(seed)
    examples = []
    for text, label in zip(texts, labels, strict=True):
        seen, weights = ngram_weights(text, bits)
        if len(seen):
            examples.append((seen, weights, label))
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (2, dimensions)).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount([y for *_, y in examples], minlength=2) / max(1, len(examples))
    total, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            seen, weights, y = examples[i]
            speed = rate * (1 - step / total)
            step += 1
            hidden = weights @ vectors[seen]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1  # the gradient at the logits
            p *= 0.5 / max(share[y], 0.05)  # either class counts the same
            back = layer.T @ p
            layer -= speed * 0.1 * np.outer(p, hidden)
            bias -= speed * 0.01 * p
            # frequent n-grams don't drown rare ones: the step goes with the weight's root
            vectors[seen] -= speed * np.sqrt(weights)[:, None] * back[None, :] * 0.5
    difference = layer[1] - layer[0]
    return (vectors @ difference + (bias[1] - bias[0])).astype(np.float32)


def text_scores(offsets: np.ndarray, data: np.ndarray, contribution: np.ndarray, bits: int, empty: float, at_once: int = AT_ONCE) -> np.ndarray:
    """Scores of the texts between these offsets. Texts are hashed many at a time, long ones in connected pieces."""
    n = len(offsets) - 1
    sums, counts = np.zeros((2, n)), np.zeros((2, n), np.int64)  # of word n-grams, of character n-grams
    worth = contribution.astype(np.float64)
    for i, j in slices(np.diff(offsets), at_once):
        if j == i + 1 and offsets[j] - offsets[i] > at_once:
            for kinds in text_ngrams(data[offsets[i] : offsets[j]], bits, at_once):
                for group, grams in enumerate(kinds):
                    sums[group, i] += worth[grams].sum()
                    counts[group, i] += len(grams)
            continue
        grams, owner, words = _many([data[a:b] for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)], bits)
        for group, chosen in enumerate((slice(0, words), slice(words, None))):
            sums[group, i:j] = np.bincount(owner[chosen], worth[grams[chosen]], minlength=j - i)
            counts[group, i:j] = np.bincount(owner[chosen], minlength=j - i)
    logits = (sums / np.maximum(counts, 1)).sum(0) / 2
    return np.where(counts.sum(0) > 0, 1 / (1 + np.exp(-np.clip(logits, -500, 500))), empty)


def _many(parts: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, number of its text) of all n-grams of these texts, and the number of word n-grams, which come first.

    A blank stands after each, so that no n-gram spans two of them; pairs of words that do are left out.
    """
    gap = np.full(1, 10, np.uint8)
    joined = np.concatenate([x for p in parts for x in (p, gap)])
    ends = np.cumsum([len(p) + 1 for p in parts])
    blank, points = _BLANK[joined], _RANDOM[joined]
    starts, _, words = _word_sums(points, blank)
    of_word = np.searchsorted(ends, starts, side="right")
    ones, pairs = _word_buckets(words, bits)
    one = of_word[:-1] == of_word[1:]
    chars, places = _char_buckets(points, blank, bits)
    grams = np.concatenate((ones, pairs[one], *chars))
    owner = np.concatenate((of_word, of_word[:-1][one], *[np.searchsorted(ends, p, side="right") for p in places]))
    return grams, owner, len(ones) + int(one.sum())


def score_quality(docs: DataFrame, contribution: np.ndarray, bits: int, empty: float = 0.0, threshold: float = 0.3) -> DataFrame:
    """docs (with text) plus score and predicted; its other columns pass through, but for these two names.

    Null and empty texts, and those of blanks only, have the score `empty`. Repeated rows score alike,
    very long texts are scored whole (in connected pieces, so that memory doesn't grow with them), and
    an empty table gives no rows. A tie with the threshold counts as label 1.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(contribution)  # 4 * 2 ** bits bytes, whatever the input

    def scored(batches):
        for batch in batches:
            offsets, data = utf8_buffers(batch.column("text"))
            scores = text_scores(offsets, data, shared.value, bits, empty)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(scored, with_fields(docs, "score double, predicted int"))


def train_quality(docs: DataFrame, labels: DataFrame, keep: Column, rows_per_class: tuple[int, int] = (1500, 1500), most_bytes: int = 1 << 26, bits: int = 18) -> np.ndarray:
    """Contributions learned from a sample of the labelled documents that keep holds for.

    rows_per_class and most_bytes bound the sample (see labelled_sample), and so the driver's memory.
    """
    sample = labelled_sample(docs, labels, "quality", keep, rows_per_class, most_bytes)
    return train([r["text"].encode() for r in sample], [r["label"] for r in sample], bits)


def op10_quality_classifier(spark: SparkSession, sf_dir: str, bits: int = 18) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    contribution = train_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0, bits=bits)
    scored = score_quality(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), contribution, bits)
    return scored.drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, bits: int = 18) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    Null, empty and blank texts have score 0, so they go. Repeated rows and rows with a null id are
    judged by their texts as all others; other columns may be null. An empty table stays empty.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    contribution = train_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0, bits=bits)
    return score_quality(docs, contribution, bits).where("predicted = 1").drop("score", "predicted")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
