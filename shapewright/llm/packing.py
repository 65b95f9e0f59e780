"""Operator 8: vector bin packing of examples into sequences by the dot-product heuristic.

Every example asks for a vector of tokens, one segment and loss-bearing tokens; a sequence offers a
vector of limits. An open sequence takes the example, among those that fit, whose demand has the
largest dot product with what the sequence has left, each dimension weighed by its total demand.
What no example fills whole is filled by cutting one. Packing is local to a partition and goes on in
rounds of bounded size, so nothing is shuffled and memory doesn't grow with the input.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, utf8_buffers

END = 2
#: Entries of the memo, none of a chunk of more bytes than the second: some 300 MB at the utmost.
REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
MARKS = frozenset(b".,;:!?")
#: A character that is a token of its own beside blanks.
SEPARATOR = "\x01"
_ENCODERS: dict = {}


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, remembered by blank-separated chunk.

    ASCII blanks end a token in this vocabulary's pattern and its normalizer knows no context beyond
    them, so a text's ids are its chunks' ids in order. Small Latin-1 letters go to the model directly,
    if the vocabulary's pattern and normalizer leave them whole, all else through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[bytes, bytes] = {}

        # whether a run of small Latin-1 letters reaches the model whole, with its bytes written as these characters
        letters = "".join(c for c in map(chr, range(256)) if c.isalpha() and c == c.lower())
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        normal = self.tokenizer.normalizer.normalize_str(letters) if self.tokenizer.normalizer else letters
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else []
        self.plain = frozenset(letters) if [t for t, _ in found] == [self._shown(letters)] else frozenset()
        alone = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = alone[0] if len(alone) == 1 else None

    def _shown(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))

    def _each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these chunks. Many are encoded as one text, with a separator after each."""
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.separator is None or any(SEPARATOR in t for t in texts):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = []
        joined = [f" {SEPARATOR} ".join([*texts[i : i + 64], ""]) for i in range(0, len(texts), 64)]
        for found in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.separator).tolist()
            whole, at = ids.tobytes(), 0
            for end in ends:
                out.append(whole[4 * at : 4 * end])
                at = end + 1
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        split = [t.split() for t in texts]
        new = set().union(*split).difference(memo)
        # a mark after an ASCII letter or digit starts a token of its own, and ASCII capitals are lowered
        # anyway (where marks may combine with them, that is left to the normalizer): so a chunk's ids
        # follow from those of its stem, which is encoded once for all its forms
        unknown: set[bytes] = set()
        forms: list[tuple[bytes, bytes, bytes]] = []
        for chunk in new:
            low = chunk.lower() if chunk.isascii() else chunk
            if low[-1] in MARKS and low[-2:-1].isalnum():
                stem, mark = low[:-1], low[-1:]
                if mark not in memo:
                    unknown.add(mark)
                forms.append((chunk, stem, mark))
            elif low == chunk:
                unknown.add(chunk)
                continue
            else:
                stem = low
                forms.append((chunk, stem, b""))
            if stem not in memo:
                unknown.add(stem)
        other = []
        tokenize = self.tokenizer.model.tokenize
        for word in unknown:
            if self.plain.issuperset(text := word.decode("utf-8", "replace")):
                memo[word] = array("I", [t.id for t in tokenize(self._shown(text))]).tobytes()
            else:
                other.append(word)
        memo.update(zip(other, self._each(other), strict=True))
        memo[b""] = b""
        for chunk, stem, mark in forms:
            memo[chunk] = memo[stem] + memo[mark]
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        for chunk in itertools.chain(new, unknown):  # what is long doesn't come often
            if len(chunk) > LONGEST_REMEMBERED:
                memo.pop(chunk, None)
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@dataclass
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass
class Piece:
    """Tokens [start, start + length) of an example, at [offset, ...) of a sequence."""

    example: int
    start: int
    length: int
    sequence: int = -1
    offset: int = -1


def pack(lengths: list[int], loss_from: list[int], limits: Limits, first_sequence: int = 0) -> list[Piece]:
    """Packs examples of these many tokens, whose loss-bearing tokens are those from loss_from on.

    Returns pieces that cover each example exactly once, in the order of (sequence, offset). A
    sequence is full or of a power of two tokens: what is closed by another limit, or for want of
    examples, is cut where its binary digits say. Examples without tokens have no piece.
    """
    return pack_round(lengths, loss_from, limits, first_sequence, True)[0]


def pack_round(lengths: list[int], loss_from: list[int], limits: Limits, first_sequence: int, last: bool) -> tuple[list[Piece], dict[int, int]]:
    """(pieces, left), see pack. Unless this is the last round, the sequence that is open at its end isn't
    closed: left says which examples would be in it and from where on."""
    pieces: list[Piece] = []
    sequence = first_sequence
    loss = lambda e, a, b: max(0, b - max(a, loss_from[e]))

    # whole sequences come off long examples' fronts
    rest: list[tuple[int, int, int]] = []  # example, start, length
    for e, n in enumerate(lengths):
        start = 0
        while n - start >= limits.tokens and loss(e, start, start + limits.tokens) <= limits.loss_tokens:
            pieces.append(Piece(e, start, limits.tokens, sequence, 0))
            sequence, start = sequence + 1, start + limits.tokens
        if n > start:
            rest.append((e, start, n - start))
    if not rest:
        return pieces, {}
    # demands of what is left, as fractions of the limits; free: not yet placed
    example, begin, length = (np.array(x, np.int64) for x in zip(*rest, strict=True))
    bearing = np.array([loss(e, a, a + n) for e, a, n in rest], np.int64)
    free = np.ones(len(rest), bool)
    left = int(free.sum())
    while left:
        demand = np.array([length[free].sum() / limits.tokens, left / limits.segments, bearing[free].sum() / limits.loss_tokens])
        weight = demand / demand.sum()
        room, seats, bear, offset = limits.tokens, limits.segments, limits.loss_tokens, 0
        placed: list[Piece] = []
        while room and seats and left:
            fits = free & (length <= room) & (bearing <= bear)
            if fits.any():
                value = weight[0] * (room / limits.tokens) * (length / limits.tokens) + weight[1] * (seats / limits.segments) / limits.segments
                if bear:
                    value = value + weight[2] * (bear / limits.loss_tokens) * (bearing / limits.loss_tokens)
                k = int(np.where(fits, value, -1.0).argmax())
                n = int(length[k])
                free[k] = False
                left -= 1
            else:  # cut one: the longest, so that what is left of it stays long
                k = int(np.where(free, length, -1).argmax())
                n = min(room, int(length[k]))
                e, a = int(example[k]), int(begin[k])
                n = min(n, max(0, loss_from[e] - a) + bear)
                if n == 0:
                    break
            e, a = int(example[k]), int(begin[k])
            placed.append(Piece(e, a, n, sequence, offset))
            room, seats, bear, offset = room - n, seats - 1, bear - loss(e, a, a + n), offset + n
            if free[k]:
                begin[k], length[k] = a + n, length[k] - n
                bearing[k] = loss(e, a + n, a + n + int(length[k]))
        if room and not left and not last and seats and bear:
            open_at: dict[int, int] = {}
            for p in placed:
                open_at[p.example] = min(p.start, open_at.get(p.example, p.start))
            return pieces, open_at
        if room:
            placed, sequence = _by_digits(placed, offset, sequence)
        else:
            sequence += 1
        pieces += placed
    return pieces, {}


def _by_digits(placed: list[Piece], end: int, sequence: int) -> tuple[list[Piece], int]:
    """A sequence of `end` tokens as sequences of powers of two, and the number after theirs."""
    at, todo, spread = 0, placed[::-1], []
    while at < end:
        size = 1 << ((end - at).bit_length() - 1)
        inside = 0
        while inside < size:
            p = todo.pop()
            n = min(p.length, size - inside)
            spread.append(Piece(p.example, p.start, n, sequence, inside))
            if n < p.length:
                todo.append(Piece(p.example, p.start + n, p.length - n))
            inside += n
        at, sequence = at + size, sequence + 1
    return spread, sequence


@dataclass
class _Held:
    """What isn't packed yet of a document: its ids from `start` on, as bytes."""

    doc_id: int | None
    tokens: int
    loss_from: int
    start: int
    ids: memoryview


def pack_documents(docs: DataFrame, path: str, limits: Limits | None = None, prompt: str | None = None, round_tokens: int = 1 << 20, round_rows: int = 1024) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and END; null and empty texts are END alone. In instruction
    data the column `prompt` names a text whose ids come before those. Loss-bearing are the tokens after
    the prompt, and without a prompt all but the first, which nothing precedes that it could be
    predicted from. Repeated rows are packed each for itself, null doc_ids too. Very long texts fill
    sequences of their own, their rest is packed with others. Examples that tie go in the order in
    which they were read. sequence_id is unique over the table: partitions count in ranges of their
    own. round_tokens and round_rows bound what is packed together, not which documents are; the
    sequence open at a round's end goes on in the next. Columns of other names aren't read, and an
    empty table gives no rows.
    """
    limits = limits or Limits()

    def packed(batches) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        held: list[_Held] = []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held
            pieces, left = pack_round([len(h.ids) // 4 for h in held], [max(0, h.loss_from - h.start) for h in held], limits, sequence, last)
            sequence = max((p.sequence for p in pieces), default=sequence - 1) + 1
            columns = [
                pa.array([held[p.example].doc_id for p in pieces], pa.int64()),
                pa.array([held[p.example].start + p.start for p in pieces], pa.int64()),
                pa.array([p.length for p in pieces], pa.int64()),
                pa.array([zlib.crc32(held[p.example].ids[4 * p.start : 4 * (p.start + p.length)]) for p in pieces], pa.int64()),
                pa.array([held[p.example].tokens for p in pieces], pa.int64()),
                pa.array([p.sequence for p in pieces], pa.int64()),
                pa.array([p.offset for p in pieces], pa.int64()),
            ]
            held = [_Held(h.doc_id, h.tokens, h.loss_from, h.start + at, memoryview(bytes(h.ids[4 * at :]))) for h, at in ((held[e], at) for e, at in sorted(left.items()))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end, tokens = np.array([END], "<u4").tobytes(), 0
        for batch in batches:
            names = batch.column("doc_id").cast(pa.int64()).to_pylist()
            sides = [utf8_buffers(batch.column(c)) for c in (["prompt"] if prompt else []) + ["text"]]
            for i, j in slices(sum(np.diff(offsets) + (1 << 14) for offsets, _ in sides), 1 << 22):  # 256 texts at most
                ids = []
                for offsets, data in sides:
                    bounds = offsets[i : j + 1]
                    ids.append(encode([data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]))
                for name, *parts in zip(names[i:j], *ids, strict=True):
                    found = b"".join([*parts, end])
                    held.append(_Held(name, len(found) // 4, len(parts[0]) // 4 if prompt else 1, 0, memoryview(found)))
                    tokens += len(found) // 4
                    if tokens >= round_tokens or len(held) >= round_rows:
                        yield flush(False)
                        tokens = sum(len(h.ids) // 4 for h in held)
        if held:
            yield flush(True)

    docs = docs.select("doc_id", *([docs[prompt].alias("prompt")] if prompt else []), "text")
    return docs.mapInArrow(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, packed; see pack_documents for nulls, empty and long texts, ties and repeated rows."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
