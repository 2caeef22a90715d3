"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A piece (one match of the split pattern) is merged as follows. Leaf i of the tree holds the rank of the pair that the
live part starting at byte i forms with its live right neighbour, with i itself as the tie-break; inner nodes hold the
least of their children. The root is thus the leftmost pair of least rank. A merge joins that pair and makes three
point updates (the pair itself, its left neighbour, the part that is gone), each over log2(n) nodes, so a piece of n
bytes takes O(n log n) whatever it looks like. Short pieces that are new go together, a tree a row of one numpy array:
each step merges one pair in every piece that still has one. Longer ones go alone, in the same way.

Defined results: null text is empty text and gives no ids; every row gives one row, repeated rows too; of pairs of one
rank the leftmost merges first; a very long text is split into pieces like any other, and a very long piece has a tree of
its own; ids beyond the vocabulary are an error in decode(); an empty table gives no rows; columns other than doc_id and text are not read, so no name can clash.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import list_array, pieces_of, text_or_empty
from imgtrace.llm.splitting import splitter

#: Distinct pieces whose ids a worker keeps (about 150 MB); beyond it the memory starts anew.
KEPT_PIECES = 500_000
#: Bytes of a short piece, and pieces whose trees are held at once.
SHORT, AT_ONCE = 64, 8192
NONE = 1 << 62


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, _, rank = line.strip().partition(b" ")
            if token:
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    rank_of = ranks.get
    after = [*range(1, n + 1), n]
    before = [*range(-1, n)]
    leaves = [NONE if (rank := rank_of(piece[i : i + 2])) is None else rank * size + i for i in range(n - 1)]
    tree = leaves + [NONE] * (size - n + 1)
    level = tree
    while len(level) > 1:
        level = [*map(min, level[::2], level[1::2])]
        tree = level + tree
    # The root is tree[0], the children of node k are 2k + 1 and 2k + 2, and leaf i is node size - 1 + i.
    first = size - 1
    while tree[0] < NONE:
        i = tree[0] % size
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        rank = rank_of(piece[i : after[end]]) if end < n else None
        changes = [(gone, NONE), (i, NONE if rank is None else rank * size + i)]
        left = before[i]
        if left >= 0:
            rank = rank_of(piece[left:end])
            changes.append((left, NONE if rank is None else rank * size + left))
        for leaf, value in changes:
            node = first + leaf
            tree[node] = value
            while node:
                other = tree[node + 1 if node & 1 else node - 1]
                if other < value:
                    value = other
                node = (node - 1) >> 1
                if tree[node] == value:
                    break
                tree[node] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pieces(dict):
    """From a piece of text to its ids as little-endian 32-bit integers; learn() takes many new ones together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.has_all_bytes = bool((self.byte_ids >= 0).all())
        self.ids = 1 + max(ranks.values(), default=0)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.ids + right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def __missing__(self, piece: str) -> bytes:
        self.learn({piece})
        return self[piece]

    def learn(self, pieces: set[str]) -> None:
        """Adds what is new; a vocabulary without some byte takes the pieces one by one."""
        if len(self) > KEPT_PIECES:
            self.clear()
        alike: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces - self.keys():
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self[piece] = struct.pack("<i", rank)
            elif len(data) <= SHORT and self.has_all_bytes:
                alike.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
            else:
                ids = merge_piece(data, self.ranks)
                self[piece] = struct.pack(f"<{len(ids)}i", *ids)
        for height, found in alike.items():
            for start in range(0, len(found), AT_ONCE):
                some = found[start : start + AT_ONCE]
                ids, counts = self._merged([data for _, data in some], 1 << height)
                packed, ends = ids.astype("<i4").tobytes(), (4 * counts.cumsum()).tolist()
                self.update((piece, packed[a:b]) for (piece, _), a, b in zip(some, [0, *ends], ends, strict=False))

    def forget_long(self, pieces: set[str]) -> None:
        for piece in pieces:
            if len(piece) > SHORT:
                self.pop(piece, None)

    def _pair_values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """What a leaf holds: the pair's rank with its place as the tie-break, or NONE."""
        key = left * self.ids + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at] * size + place, NONE)

    def _merged(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has; a piece has more than size / 2 bytes, and size at most.

        Node 1 of a row's tree is its root, nodes 2k and 2k + 1 are the children of k, and leaf i is node size + i.
        """
        count, places = len(pieces), np.arange(size)
        length = np.fromiter(map(len, pieces), np.int64, count)
        data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        ids = np.where(places < length[:, None], self.byte_ids[data], -1)
        tree = np.full((count, 2 * size), NONE, np.int64)
        if len(self.pairs):
            tree[:, size:-1] = np.where(places[1:] < length[:, None], self._pair_values(ids[:, :-1], ids[:, 1:], places[:-1], size), NONE)
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        after, before = np.tile(np.arange(1, size + 2), (count, 1)), np.tile(np.arange(-1, size), (count, 1))
        flat, row = tree.ravel(), np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root, ends = tree[row, 1], length[row]
            i = root % size
            merged = root // size
            gone = after[row, i]
            end = after[row, gone]
            left = before[row, i]
            after[row, i], before[row, end] = end, i
            ids[row, i], ids[row, gone] = merged, -1
            right_value = np.where(end < ends, self._pair_values(merged, ids[row, np.minimum(end, size - 1)], i, size), NONE)
            left_value = np.where(left >= 0, self._pair_values(ids[row, left], merged, left, size), NONE)
            base = row * (2 * size)
            nodes = size + np.stack([gone, i, np.where(left >= 0, left, gone)])
            flat[base + nodes[0]] = NONE
            flat[base + nodes[1]] = right_value
            flat[base + nodes[2]] = left_value
            for _ in range(size.bit_length() - 1):
                nodes >>= 1
                first = base + 2 * nodes
                flat[base + nodes] = np.minimum(flat[first], flat[first + 1])
            row = row[flat[base + 1] < NONE]
        return ids[ids >= 0], (ids >= 0).sum(1)


@functools.cache
def _encoder(path: str) -> Pieces:
    return Pieces(load_ranks(path))


def _encoded(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """doc_id and ids of batches of doc_id and text, in parts of a megabyte or so."""
    encoder, split = _encoder(ranks_path), splitter(pattern)
    for batch in batches:
        for part in pieces_of(batch, most=1 << 20):
            texts = [split(text) for text in part.column(1).to_pylist()]
            distinct = set().union(*texts)
            encoder.learn(distinct)
            packed = [b"".join(map(encoder.__getitem__, text)) for text in texts]
            encoder.forget_long(distinct)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield part.column(0), list_array(values, [len(x) // 4 for x in packed])


@functools.cache
def _tokens(ranks_path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = load_ranks(ranks_path)
    token = [b""] * (max(ranks.values(), default=-1) + 1)
    for text, rank in ranks.items():
        token[rank] = text
    return token


def _decoded(ids: pa.ListArray, token: list[bytes]) -> Iterator[tuple[pa.ListArray, pa.Array]]:
    """ids and their bytes, some rows at a time."""
    for start in range(0, len(ids), 512):
        part = ids.slice(start, 512)
        yield part, pa.array([b"".join(map(token.__getitem__, x)) for x in part.to_pylist()], pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in _encoded(batches, ranks_path, pattern):
            yield pa.RecordBatch.from_arrays([doc_ids, ids], ["doc_id", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded` (binary), the bytes that the ids stand for, to rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for ids, decoded in _decoded(batch.column(1), _tokens(ranks_path)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), ids, decoded], ["doc_id", "ids", "decoded"])
                start += len(ids)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """decode(encode(docs)) by one Python worker a task: the ids do not go back to the JVM in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, encoded in _encoded(batches, ranks_path, pattern):
            start = 0
            for ids, decoded in _decoded(encoded, _tokens(ranks_path)):
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, len(ids)), ids, decoded], ["doc_id", "ids", "decoded"])
                start += len(ids)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
