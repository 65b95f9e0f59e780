"""Operator 4: byte-level BPE encoding and decoding by automaton and backtracking.

Token bytes are mapped to Latin-1 strings for an Aho-Corasick trie. A piece is encoded by taking the
longest token at each place and stepping back wherever it can't stand beside the token before it;
whether two tokens can be neighbours is found once and remembered. Places from which no end was
reached are marked, so each (place, token) is tried once and the time is linear in the piece's length.
"""

from __future__ import annotations

import base64
import hashlib
import operator
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table, with_fields

#: Entries of the memo, none of a piece of more characters than the second: some 200 MB at the utmost.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 48
AT_ONCE = 1 << 18
_CODERS: dict = {}


class _Memo(dict):
    """Pieces and their ids; a piece that isn't known yet is encoded, and remembered unless it is long."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """A coder for a rank table (token bytes -> rank) and a pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.digits = {r: str(r) for r in ranks.values()}
        self.trie = ahocorasick.Automaton()
        # a token that merging never makes from its own bytes can't occur, but as a whole piece
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            made, halves = self._merged(token)
            if made:
                self.halves[rank] = halves
        # every beginning of a token leads to the longest token that it begins with itself
        words = {self.bytes_of[rank].decode("latin-1"): (rank, len(self.bytes_of[rank])) for rank in self.halves}
        for word in words:
            for n in range(1, len(word) + 1):
                if word[:n] not in self.trie:
                    self.trie.add_word(word[:n], words.get(word[:n]) or (self.trie.get(word[: n - 1]) if n > 1 else None))
        #: the longest other token that a token begins with: the next to be tried at a place
        self.shorter = {rank: self.trie.get(word[:-1]) if len(word) > 1 else None for word, (rank, _) in words.items()}
        self.most = max(map(len, ranks), default=0)
        self.memo = _Memo(self.encode_piece)
        self.beside: dict[tuple[int, int], bool] = {}
        self.joined = {v: k for k, v in self.halves.items() if v}

    def _merged(self, token: bytes) -> tuple[bool, tuple[int, int] | None]:
        """Whether lowest-rank merging turns these bytes into this one token, and the last two parts."""
        parts = [token[i : i + 1] for i in range(len(token))]
        get, top = self.ranks.get, self.ranks[token]
        halves = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and r <= top and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return False, None
            if len(parts) == 2:
                halves = (get(parts[0]), get(parts[1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True, halves

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens.

        It goes back through the merges on either side of the seam, latest first: no merge across
        the seam may have come before the merges that closed it.
        """
        key = (left, right)
        found = self.beside.get(key)
        if found is not None:
            return found
        if len(self.beside) > 4 * REMEMBERED:
            self.beside.clear()
        # a merge across the seam wins over what comes later: rank below `bound`, ties going left
        bound = 1 << 62
        found = True
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                found = False
                break
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                break
            if b is None or a is not None and left > right:
                # the left token was made last; a merge across must have rank below it
                bound, left = left, a[1]
            else:
                # the right one: across the seam an equal rank stands further left and wins
                bound, right = right + 1, b[0]
        self.beside[key] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, size = piece.decode("latin-1"), len(piece)
        beside, neighbours, shorter, longest = self.beside, self.neighbours, self.shorter, self._longest
        open_at = bytearray(b"\x01") * (size + 1)
        ids: list[int] = []
        at = 0
        token = longest(text, at)
        while True:
            if token is None:  # no token is left for this place: give up the one before it
                open_at[at] = 0
                last = ids.pop()
                at -= len(self.bytes_of[last])
                token = shorter[last]
                continue
            rank, width = token
            if open_at[at + width]:
                fits = True
                if ids:
                    fits = beside.get((ids[-1], rank))
                    if fits is None:
                        fits = neighbours(ids[-1], rank)
                if fits:
                    ids.append(rank)
                    at += width
                    if at == size:
                        return ids
                    token = longest(text, at)
                    continue
            token = shorter[rank]

    def _longest(self, text: str, start: int) -> tuple[int, int] | None:
        """The longest token that begins at start."""
        part = text[start : start + self.most]
        n = self.trie.longest_prefix(part)
        return self.trie.get(part[:n]) if n else None

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some ten thousand pieces of the pattern at a time where it is long."""
        if len(text) <= AT_ONCE:
            yield self._encode_pieces(self.pattern.findall(text))
            return
        found = map(operator.itemgetter(0), self.pattern.finditer(text))
        while pieces := list(islice(found, AT_ONCE // 8)):
            yield self._encode_pieces(pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def coder(path: str, pattern: str) -> ByteBPE:
    """One per Python process; path names a vocabulary that every machine has."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (array<int>): each piece of the pattern encoded separately.

    Null and empty texts have no ids. Repeated rows are encoded alike, very long texts whole. Columns
    but doc_id and text aren't read, and an empty table gives no rows. An array holds a text's ids, so
    texts of more than 2 ** 31 tokens don't fit one.
    """

    def encoded(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(encoded, with_fields(docs.select("doc_id"), "ids array<int>"))


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null, empty, repeated and long texts are as in encode_documents; of a long text only a part's ids
    are held at a time.
    """

    def digested(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode_parts(text.as_py() or ""):
                    of_ids.update((("," if count and ids else "") + ",".join(map(bpe.digits.__getitem__, ids))).encode())
                    of_text.update(bpe.decode(ids))
                    count += len(ids)
                counts.append(count)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(digested, with_fields(docs.select("doc_id"), "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLES: dict[str, str] = {}
