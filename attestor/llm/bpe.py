"""Byte-level BPE encoding and decoding with a segment tree of pair ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import common

#: Pre-tokens of more bytes get a tree of their own; the others share one array of trees.
WIDE = 64
#: Fewer new pre-tokens than this are merged one by one.
FEW = 16
#: No pair to merge.
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairRanks:
    """(left id, right id) -> rank of their concatenation, as an open-addressed table that looks up whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for one slot the last stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        at = np.arange(len(keys))
        while len(at):
            have = self.keys[slot]
            hit = have == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (have >= 0)
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    """Encodes and decodes by the ranks in a file; each match of the pattern separately, without special tokens."""

    def __init__(self, path: str, pattern: str, cache: int = 200_000):
        self.ranks = read_ranks(path)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.table = PairRanks(self.ranks)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.most = cache

    # the merges

    def merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words of `width` bytes at most, a power of two.

        One segment tree for each word, all in one array: leaf i holds the rank of the pair that begins at byte i, and the
        position, so that the root is the leftmost of the least. A merge changes three leaves and the paths above them.
        """
        many, shift = len(words), width.bit_length() - 1
        length = np.fromiter(map(len, words), np.int64, many)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(many), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        ids = np.full((many, width), -1, np.int32)
        ids[row, col] = self.byte_ids[flat]
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (many, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (many, 1))
        stop = length.astype(np.int32)  # a position that ends the word
        tree = np.full((many, 2 * width), NONE, np.int32)
        pairs = col < length[row] - 1
        r, c = row[pairs], col[pairs]
        rank = self.table.look_up(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(rank == NONE, NONE, (rank << shift) | c)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[r, node] = value
            while width > 1 and len(node):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                if node[0] == 1:  # all leaves are equally deep
                    break

        def pair(r: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            rank = self.table.look_up(ids[r, left], ids[r, right])
            return np.where(rank == NONE, NONE, (rank << shift) | left.astype(np.int32))

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            left = root & (width - 1)
            right = after[live, left]
            ids[live, left] = root >> shift
            ids[live, right] = -1
            beyond = after[live, right]
            after[live, left] = beyond
            tree[live, width + right] = NONE
            more = beyond < stop[live]
            before[live[more], beyond[more]] = left[more]
            value = np.full(len(live), NONE, np.int32)
            value[more] = pair(live[more], left[more], beyond[more])
            put(live, right, np.full(len(live), NONE, np.int32))
            put(live, left, value)
            front = before[live, left]
            has = front >= 0
            put(live[has], front[has], pair(live[has], front[has], left[has]))
            live = live[tree[live, 1] != NONE]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, word: bytes) -> bytes:
        """The same for one long word, with its own tree in a list."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, none = self.table.pairs, 1 << 62
        tree = [none] * (2 * width)

        def value(left: int, right: int) -> int:
            rank = pairs.get(ids[left] << 32 | ids[right])
            return none if rank is None else rank * width + left

        for i in range(n - 1):
            tree[width + i] = value(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, x: int) -> None:
            node = leaf + width
            tree[node] = x
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            rank, left = divmod(tree[1], width)
            right = after[left]
            ids[left], ids[right] = rank, -1
            beyond = after[left] = after[right]
            put(right, none)
            if beyond < n:
                before[beyond] = left
                put(left, value(left, beyond))
            else:
                put(left, none)
            if before[left] >= 0:
                put(before[left], value(before[left], left))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # texts

    def learn(self, words: set[str]) -> None:
        """Puts the ids of these pre-tokens into the cache."""
        if len(self.cache) + len(words) > self.most:
            self.cache.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[word] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE or len(words) < FEW:
                self.cache[word] = self.merge_one(raw)
            else:
                by_width.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for width, group in by_width.items():
            for word, ids in zip(group, self.merge_many([raw for _, raw in group], width), strict=True):
                self.cache[word[0]] = ids

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[list[str], list[bytes]]]]:
        """For slices of texts of bounded size: the pre-tokens of each text and their ids."""
        part: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            part.append(self.split(text))
            size += len(text)
            if size > 1 << 20 or i == len(texts) - 1:
                new = set().union(*part) - self.cache.keys()
                if new:
                    if len(self.cache) + len(new) > self.most:
                        self.cache.clear()
                        new = set().union(*part)
                    self.learn(new)
                get = self.cache.__getitem__
                yield [(words, list(map(get, words))) for words in part]
                part, size = [], 0

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [b"".join(ids) for part in self.pieces(texts) for _, ids in part]


class Decoder:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for b in common.sliced(batches):
        ids = encoder(path, pattern).encode_many(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], at: int, path: str) -> Iterator[pa.RecordBatch]:
    for b in common.sliced(batches):
        back = decoder(path).decode
        out = pa.array([back(x or b"") for x in b.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])


def _tokens(docs: DataFrame) -> tuple[DataFrame, StructType]:
    schema = StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), schema


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    Whole texts are encoded; null counts as empty and has no ids. Rows are independent, so repeated rows and null or equal
    doc_ids are kept as they are; other columns are ignored.
    """
    texts, schema = _tokens(docs)
    return texts.mapInArrow(lambda it: _encoded(it, path, pattern), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` (replaced if there): the bytes that the ids stand for (null ids: empty)."""
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")
    return encoded.mapInArrow(lambda it: _decoded(it, at, path), StructType([*encoded.schema, StructField("decoded", BinaryType())]))


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one Python worker for each task instead of two, so that an executor holds half as many."""
    texts, schema = _tokens(docs)
    return texts.mapInArrow(lambda it: _decoded(_encoded(it, path, pattern), 2, path), StructType([*schema, StructField("decoded", BinaryType())]))
