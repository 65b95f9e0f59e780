"""Operator 3: language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, permuted (rolled) twice, once and not at all; a text's vector bundles (adds) those of its
trigrams, and a language's prototype those of its training texts. The prediction is the prototype
with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, utf8_buffers, with_fields

SLOTS = 64
_TABLES: dict = {}


def letter_slots() -> np.ndarray:
    """Code point -> slot. 0: no letter; a to z have slots of their own, other letters share the rest by a hash."""
    if "letters" not in _TABLES:
        slots = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            if not 0xD800 <= cp < 0xE000 and (ch := chr(cp)).isalpha():
                low = ord(ch.lower()[0])
                slots[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SLOTS - 27)
        _TABLES["letters"] = slots
    return _TABLES["letters"]


def bound_pairs(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all letter pairs, already permuted, and of the letters."""
    if ("pairs", dimensions, seed) not in _TABLES:
        letters = (np.random.default_rng(seed).integers(0, 2, (SLOTS, dimensions)) * 2 - 1).astype(np.int8)
        pairs = np.roll(letters, 2, axis=1)[:, None, :] * np.roll(letters, 1, axis=1)[None, :, :]
        _TABLES["pairs", dimensions, seed] = pairs.reshape(SLOTS * SLOTS, dimensions), letters
    return _TABLES["pairs", dimensions, seed]


def text_trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """(trigrams, their counts) of a text between two blanks; None without any letter."""
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    slots = letter_slots()[points]
    if not slots.any():
        return None
    # runs of what isn't a letter are one blank
    keep = (slots > 0) | np.concatenate(([True], slots[:-1] > 0))
    code = np.concatenate(([0], slots[keep], [0])).astype(np.int32)
    grams = (code[:-2] * SLOTS + code[1:-1]) * SLOTS + code[2:]
    if len(grams) > 1 << 17:  # a long text: counting sort needs no copy of it
        counts = np.bincount(grams, minlength=SLOTS**3)
        return (seen := np.flatnonzero(counts)), counts[seen]
    return np.unique(grams, return_counts=True)


def bundle(grams: np.ndarray, counts: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    pairs, letters = bound_pairs(dimensions, seed)
    total = np.zeros(dimensions, np.float32)
    for i in range(0, len(grams), 1024):
        g = grams[i : i + 1024]
        vectors = pairs[g // SLOTS] * letters[g % SLOTS]
        total += counts[i : i + 1024].astype(np.float32) @ vectors.astype(np.float32)
    return total


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    offsets, data = utf8_buffers(batch.column(name))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b].tobytes()


def language_prototypes(docs: DataFrame, rows_per_language: int, dimensions: int, seed: int) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from about rows_per_language texts of each (those whose ids hash low).

    Null texts and null languages teach nothing.
    """
    known = docs.where("text is not null and lang is not null")
    # one row per language; the number of languages is small
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def bundled(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(_texts(batch, "text"), batch.column("lang").to_pylist(), strict=True):
                if (found := text_trigrams(text)) is not None:
                    vector = bundle(*found, dimensions, seed)
                    # every text weighs the same
                    sums[lang] = sums.get(lang, 0) + (vector / max(np.linalg.norm(vector), 1e-9)).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.float64()))]))

    total: dict[str, np.ndarray] = {}
    for r in sample.repartition(8).mapInArrow(bundled, "lang string, sums array<double>").collect():  # 8 rows a language at most
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["sums"])
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(total.items()) if np.linalg.norm(v) > 0}


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int, seed: int, sharpness: float = 40.0) -> DataFrame:
    """docs (with text) plus lang_pred and score; its other columns pass through, but for these two names.

    Null texts, texts without a letter and all texts if there are no prototypes get 'und' and 0.0.
    Ties go to the language first in the alphabet. The score is the softmax of the cosines. Repeated rows are
    judged alike, very long texts whole, null ids as others; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    names, matrix = list(prototypes), np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dimensions), np.float32)
    kept = [n for n in docs.columns if n != "text"]

    def predicted(batches):
        for batch in batches:
            langs, scores = [], []
            for text in _texts(batch, "text"):
                found = text_trigrams(text) if names else None
                if found is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                vector = bundle(*found, dimensions, seed)
                cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-9)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(float(1 / np.exp(sharpness * (cosines.astype(np.float64) - cosines[best])).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(predicted, with_fields(docs.drop("text"), "lang_pred string, score double"))


def op3_language_id(spark: SparkSession, sf_dir: str, rows_per_language: int = 1500, dimensions: int = 1024, seed: int = 7) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    prototypes = language_prototypes(docs.where("not held_out"), rows_per_language, dimensions, seed)
    return identify_language(docs.select("doc_id", "held_out", "text"), prototypes, dimensions, seed)


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
