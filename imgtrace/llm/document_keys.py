"""How many documents hold each 64-bit key of a document, found without shuffling keys as rows.

Documents are dealt into groups of a few megabytes of text. A group turns its keys into sorted, distinct ones and sends
each range of them (a bucket) as one packed row of 32-bit fingerprints, with the count of its documents that hold them. A
bucket merges what it gets from all groups and sends each group back the total counts, in the group's order; the group,
which has the texts again from the same shuffle, makes the keys anew and has a count for each. Keys are spread by their
hash, so a key that every document holds weighs one entry a group.

The number of buckets grows with the data, so a bucket's load and the chance that two of its keys share a fingerprint stay
constant; that chance (about one in ten thousand) can only make a count too large.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import text_or_empty

GROUP_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
MOST = 0xFFFF  # counts beyond are as good as this

#: From the texts of a group, in order, to something to work on with and arrays of keys (uint64); a key counts once an array.
Keys = Callable[[list[str]], tuple[Any, list[np.ndarray]]]


class Group(NamedTuple):
    """What a group works with once it has the counts: rows in order, what `keys_of` gave, counts of keys, and which rows are copies."""

    g: int
    doc_ids: list[int | None]
    texts: list[str]
    made: Any
    keys: list[np.ndarray]
    counts_of: Callable[[np.ndarray], np.ndarray]
    copies: list[bool]


def grouped_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows of g, doc_id, text and text_key (a hash), and the number of buckets; g deals the rows into groups of about GROUP_BYTES."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    buckets = 1 << max(4, (size // BUCKET_BYTES).bit_length())
    key = F.xxhash64("text")
    return source.select(F.pmod(F.xxhash64("doc_id", key), F.lit(groups)).alias("g"), "doc_id", "text", key.alias("text_key")), buckets


def ordered(table: pa.Table) -> tuple[list[int | None], list[str], list[int]]:
    """doc_ids, texts and text keys of a group, in an order that does not hang on how the rows arrived."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("doc_id", "text", "text_key")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def copies_of_texts(texts: DataFrame) -> DataFrame:
    """g and mark (binary, for copied_rows) of the rows whose text a smaller doc_id has too, by 128 bits of hash and the length."""
    small = texts.where("doc_id is not null").select("g", "doc_id", "text_key", F.xxhash64(F.lit("copy"), "text").alias("other_key"), F.octet_length("text").alias("size"))
    same = ["text_key", "other_key", "size"]
    firsts = small.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    mark = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("doc_id", "text_key")))
    return small.join(firsts, same).where("doc_id > first").select("g", mark.alias("mark"))


def copied_rows(doc_ids: list[int | None], text_keys: list[int], marks: list[bytes]) -> list[bool]:
    known = set(marks)
    pack = lambda d, k: d.to_bytes(8, "big", signed=True) + k.to_bytes(8, "big", signed=True)
    return [d is not None and pack(d, k) in known for d, k in zip(doc_ids, text_keys, strict=True)]


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))


def with_counts(texts: DataFrame, buckets: int, keys_of: Keys, use: Callable[[Group], pa.Table], schema: str, copies: DataFrame | None = None) -> DataFrame:
    """What `use` makes of each group, once the count of every key's arrays over all groups is known; copies as copies_of_texts gives them."""
    shift = np.uint64(32 - (buckets.bit_length() - 1))

    def send(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        keys, counts = np.unique(np.concatenate(keys_of(ordered(table)[1])[1]), return_counts=True)
        prints = ((keys >> shift) & np.uint64(0xFFFFFFFF)).astype("<u4")
        counts = np.minimum(counts, MOST).astype("<u2")
        ends = _bounds(keys, buckets)
        used = [b for b in range(buckets) if ends[b + 1] > ends[b]]
        part = lambda x: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in used], pa.binary())
        packed = pa.array([zlib.compress(counts[ends[b] : ends[b + 1]].tobytes(), 1) for b in used], pa.binary())
        return pa.table({"g": pa.array([g] * len(used), pa.int64()), "b": pa.array(used, pa.int32()), "prints": part(prints), "counts": packed})

    def merge(table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, "<u4") for x in table["prints"].to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), "<u2") for x in table["counts"].to_pylist()])
        _, places = np.unique(np.concatenate(prints), return_inverse=True)
        totals = np.minimum(np.bincount(places, counts)[places], MOST).astype("<u2")
        parts = np.split(totals, np.cumsum([len(x) for x in prints])[:-1])
        return pa.table({"g": table["g"], "b": table["b"], "totals": pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())})

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        doc_ids, rows, text_keys = ordered(table)
        made, keys = keys_of(rows)
        known = np.unique(np.concatenate(keys))
        bs, packed = found["b"].to_numpy(), found["totals"].to_pylist()
        order = [i for i in np.argsort(bs, kind="stable") if bs[i] >= 0]
        totals = np.concatenate([np.frombuffer(zlib.decompress(packed[i]), "<u2") for i in order] or [np.zeros(0, "<u2")])
        copied = copied_rows(doc_ids, text_keys, [packed[i] for i in np.flatnonzero(bs < 0)])
        return use(Group(table["g"][0].as_py(), doc_ids, rows, made, keys, lambda x: totals[np.searchsorted(known, x)], copied))

    sent = texts.groupBy("g").applyInArrow(send, "g long, b int, prints binary, counts binary")
    back = sent.groupBy("b").applyInArrow(merge, "g long, b int, totals binary")
    if copies is not None:
        back = back.unionAll(copies.select("g", F.lit(-1).alias("b"), F.col("mark").alias("totals")))
    return texts.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(finish, schema)
