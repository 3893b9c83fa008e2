"""Byte-level BPE encoding and decoding (operator 2).

A text is cut by the vocabulary's pattern; each match (pre-token) is merged on its own. Merging uses a rank
queue: one bucket of linked-list positions for each merge rank, and a three-level bitmap over the ranks whose
lowest set bit names the next bucket. Entries whose pair has changed meanwhile are stale and are skipped. The
queue holds the positions of all new pre-tokens of a batch at once, so a step of it is one set of array
operations; since a position never leaves its pre-token, the order within each is the same as alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces_of, texts_of, utf8_view
from .pretokens import MemoEncoder

#: Bytes of text that are encoded together.
CHUNK_BYTES = 8 << 20


class RankQueue:
    """Buckets of positions by rank; the lowest rank that has a bucket comes first."""

    def __init__(self, ranks: int):
        size = -(-max(ranks, 1) // 64)
        self.low = [0] * size
        self.mid = [0] * -(-size // 64)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and all positions in its bucket."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        word = (group << 6) | ((self.mid[group] & -self.mid[group]).bit_length() - 1)
        rank = (word << 6) | ((self.low[word] & -self.low[word]).bit_length() - 1)
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.mid[group] &= ~(1 << (word & 63))
            if not self.mid[group]:
                self.top &= ~(1 << group)
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


class Vocabulary:
    """Ranks of byte strings, and the rank of each pair of tokens whose bytes join to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.by_id = [b""] * self.size
        for token, rank in ranks.items():
            self.by_id[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        keys, merged = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], merged[order]
        #: Ranks whose token can form a pair of a lower rank; their merges are made one by one.
        self.sinks = np.zeros(self.size, dtype=bool)
        for half in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.sinks[half[self.merged < half]] = True

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as file:
            return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it makes no token."""
        if not len(self.keys):
            return np.full(len(left), -1, dtype=np.int64)
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.merged[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                rest.append(i)
        if rest:
            ids, counts = self._merge([pieces[i] for i in rest])
            raw, end = ids.astype("<u4").tobytes(), 0
            for i, n in zip(rest, counts.tolist(), strict=True):
                out[i] = raw[end : end + 4 * n]
                end += 4 * n
        return out

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        owner = np.repeat(np.arange(len(pieces)), lengths)
        token = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        if token.min() < 0:
            raise ValueError("the vocabulary lacks a single byte")
        n = len(token)
        ends = np.cumsum(lengths) - 1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[ends[:-1] + 1] = -1
        before[0] = -1
        rank_at = np.full(n, -1, dtype=np.int64)
        alive = np.ones(n, dtype=bool)
        queue = RankQueue(self.size)

        def place(positions: np.ndarray) -> None:
            """Puts the pairs that begin at these positions into their buckets."""
            right = after[positions]
            positions, right = positions[right >= 0], right[right >= 0]
            ranks = self.pair_ranks(token[positions], token[right])
            rank_at[positions] = ranks
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if len(ranks) <= 1:
                if len(ranks):
                    queue.push(int(ranks[0]), positions)
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                if end > start:
                    queue.push(rank, positions[start:end])

        place(np.arange(n))
        while (entry := queue.pop()) is not None:
            rank, found = entry
            found = found[rank_at[found] == rank]  # the others are stale
            if len(found) > 1:
                found = np.unique(found)
                if self.sinks[rank]:
                    first = np.r_[True, owner[found[1:]] != owner[found[:-1]]]
                    if not first.all():
                        queue.push(rank, found[~first])
                        found = found[first]
                else:
                    touches = np.r_[False, after[found[:-1]] == found[1:]]
                    if touches.any():  # in a run of overlapping pairs each second one is consumed
                        index = np.arange(len(found))
                        start = np.maximum.accumulate(np.where(touches, 0, index))
                        found = found[(index - start) % 2 == 0]
            if not len(found):
                continue
            right = after[found]
            beyond = after[right]
            token[found] = rank
            after[found] = beyond
            before[beyond[beyond >= 0]] = found[beyond >= 0]
            alive[right] = False
            rank_at[right] = -1
            rank_at[found] = -1
            left = before[found]
            left = left[left >= 0]
            place(np.unique(np.concatenate([found, left])) if len(left) else found)
        return token[alive], np.bincount(owner[alive], minlength=len(pieces))


class Encoder:
    """Encodes texts by a vocabulary and the pattern that cuts them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.memo = MemoEncoder(regex.compile(pattern).findall, self._pieces, vocabulary.size)
        self.encode, self.view = self.memo.encode, self.memo.encode_view

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return self.vocabulary.encode_pieces([piece.encode() for piece in pieces])

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str, pattern: str) -> Encoder:
        return Encoder(Vocabulary.load(path), pattern)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.by_id.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces_of(batch, 1, CHUNK_BYTES)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_tokens and ids (binary, little-endian unsigned 32-bit).

    path is the rank file, which every executor must see. A null or empty text has no ids. Rows are neither
    joined nor dropped, so repeated keys stay, and columns other than these two do not matter. Long texts are
    held whole, one chunk of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pattern)
        for batch in _chunks(batches):
            ids = encoder.encode(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, n_tokens long, ids binary")
    return rows.withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: the key and text_bytes, the bytes that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        encoder = Encoder(vocabulary, "")
        for batch in batches:
            data = [encoder.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["key", "text_bytes"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(ids)).mapInArrow(run, f"key {kind}, text_bytes binary").withColumnRenamed("key", key)


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and ids (array of int) added; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    at = names.index(text)
    schema = docs.select(*names).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pattern)
        for batch in batches:
            for part in pieces_of(batch, at, CHUNK_BYTES // 2):
                ids, ends = encoder.view(*utf8_view(part.column(at)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(ends), pa.int64()), lists], [*names, "n_tokens", "ids"])

    return docs.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass, so that ids need not leave the worker. Per row: the key, n_tokens,
    ids_sha256 and decoded_sha256 (lowercase hex)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pattern)
        for batch in _chunks(batches):
            ids, ends = encoder.view(*utf8_view(batch.column(1)))
            raw = [x.astype("<u4").tobytes() for x in np.split(ids, ends[1:-1])]
            columns = [
                batch.column(0),
                pa.array(np.diff(ends)),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in raw], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.withColumnRenamed("key", key)
