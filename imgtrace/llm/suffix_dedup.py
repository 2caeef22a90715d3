"""Suffix-array dedup: every byte covered by a LENGTH-byte string that a document with a smaller doc_id holds too goes.

The strings that start at each byte (windows) are dealt out by their content: a window's key is the least hash of the
GRAM-byte strings in it, so equal windows meet wherever they stand, and as neighbours mostly share their key, a run of them
travels as one segment. Keys of one document only (document_keys counts them) have no match and are not sent, exact copies
of a document's text are settled by a hash. Of equal segments in a group of documents only those of its least document
travel; the others are gone whole, which the group notes as masks of its own. So a passage that a third of all documents
hold weighs an entry a group. Keys of very many documents are split up: their windows go by a hash of the whole window.

Each bucket sets its segments one after the other, by document, and sorts its windows as suffixes, by their first LENGTH
bytes and then by place, with the common prefix of neighbours. The previous and the next smaller place of each place in
suffix order give its longest previous factor (LPF): the longest string that starts there and at a smaller place too, as
far as LENGTH bytes. Where the LPF reaches LENGTH, an earlier place has the whole window; following these places down
leads to the least document that has it, and windows of later documents are marked, as a mask a segment. Groups get
their masks back and cut the texts.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; a null doc_id is neither smaller nor greater
than others, so such rows lose nothing and give no matches; rows with the same doc_id do not remove each other's text, so
repeated rows stay (ties: the same window at several places of the least document stays at all of them); a very long text
is hashed in chunks of CHUNK bytes and travels as segments like any other; an empty table gives no rows; columns other
than doc_id and text are not read, so no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.document_keys import Group, copied_rows, copies_of_texts, grouped_texts, ordered, with_counts

LENGTH, GRAM = 50, 32
#: Rounds of climbing before ranks go down by powers of two.
CLIMBS = 64
SPREAD = LENGTH - GRAM + 1  # hashes of grams in a window
RUN = 32  # windows in a segment at most, for a mask of 32 bits
#: Keys of more runs than this go by whole windows.
HOT = 3000
#: Buckets of segments for each bucket of keys.
FINER = 4
_U = np.uint64
_FACTORS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
CHUNK = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _FACTORS[3]
    x = (x ^ (x >> _U(29))) * _FACTORS[1]
    return x ^ (x >> _U(32))


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place; lengths 2, 4, 8, 16 and 32 in turn."""
    h = x.astype(np.uint64) + _U(1)
    n = 1
    for factor in _FACTORS:
        h = h[:-n] * factor + (h[n:] ^ (h[n:] >> _U(31)))
        n *= 2
    return _mixed(h)


def _least_in(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def window_keys(x: np.ndarray) -> np.ndarray:
    """The key of the window at each place (bytes as uint8); in chunks that stay in the cache."""
    n = len(x) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.concatenate([_least_in(_gram_hashes(x[i : min(i + CHUNK, n) + LENGTH - 1]), SPREAD) for i in range(0, n, CHUNK)])


class Runs:
    """The runs of windows with equal keys in the texts of a group, laid end to end."""

    def __init__(self, texts: list[str]) -> None:
        encoded = [t.encode() for t in texts]
        self.bytes = np.frombuffer(b"".join(encoded), np.uint8)
        self.ends = np.cumsum([len(t) for t in encoded], dtype=np.int64)
        keys = window_keys(self.bytes)
        place = np.arange(len(keys))
        doc = np.searchsorted(self.ends, place, side="right")
        inside = place + LENGTH <= self.ends[doc] if len(keys) else np.zeros(0, bool)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new & inside)
        # Places past the last window of a document end its last run.
        stop = np.flatnonzero(new | ~inside)
        ends = np.append(stop, len(keys))[np.searchsorted(stop, starts, side="right")] if len(starts) else starts
        self.keys, self.starts, self.counts = keys[starts], starts, ends - starts
        self.docs = doc[starts]


def _cut(starts: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut into parts of at most `most` windows: index of the run, start and count."""
    parts = -(-counts // most)
    of = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return of, starts[of] + nth * most, np.minimum(most, counts[of] - nth * most)


def _gather(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of x, end to end."""
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return x[at]


def _packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _whole_window_keys(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(0, LENGTH):
        h = h * _FACTORS[0] + x[starts + k] + _U(1)
    return _mixed(h)


#: Segments of a group for a bucket; where content is null, masks of windows that the group itself found gone.
SEGMENTS = "g long, bucket int, docs binary, starts binary, counts binary, content binary"


def _later_copies(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which segments (slices of x, of documents `ids`) a smaller document among these has too."""
    number = _content_numbers(x, starts, lengths)
    least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    return ids > least[number]


def _content_numbers(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same number for slices of equal content."""
    data, seen = x.tobytes(), {}
    found = (seen.setdefault(data[b : b + n], len(seen)) for b, n in zip(starts.tolist(), lengths.tolist(), strict=True))
    return np.fromiter(found, np.int64, len(starts))


def _segments(buckets: int):
    """For with_counts: the segments that may have a match, packed by bucket."""

    def use(group: Group) -> pa.Table:
        runs: Runs = group.made
        real = np.array([d is not None and not c for d, c in zip(group.doc_ids, group.copies, strict=True)], bool)
        counts = group.counts_of(runs.keys)
        shared = (counts > 1) & real[runs.docs] if len(runs.keys) else np.zeros(0, bool)
        hot = shared & (counts > HOT)
        plain = np.flatnonzero(shared & ~hot)
        of, starts, sizes = _cut(runs.starts[plain], runs.counts[plain], RUN)
        docs, keys = runs.docs[plain][of], runs.keys[plain][of]
        single = np.flatnonzero(hot)
        of, more, ones = _cut(runs.starts[single], runs.counts[single], 1)
        starts, sizes = np.concatenate([starts, more]), np.concatenate([sizes, ones])
        docs = np.concatenate([docs, runs.docs[single][of]])
        keys = np.concatenate([keys, _whole_window_keys(runs.bytes, more)])
        ids = np.array([d if d is not None else 0 for d in group.doc_ids], np.int64)
        begins = np.concatenate([[0], runs.ends[:-1]]) if len(runs.ends) else np.zeros(1, np.int64)
        bucket = (_mixed(keys) % _U(buckets)).astype(np.int32)
        rows: dict[str, list] = {k: [] for k in ("g", "bucket", "docs", "starts", "counts", "content")}

        def send(b: int, mine: np.ndarray, whole: bool) -> None:
            rows["g"].append(group.g)
            rows["bucket"].append(b)
            rows["docs"].append(_packed(np.stack([docs[mine], ids[docs[mine]]]).astype("<i8")))
            rows["starts"].append(_packed((starts[mine] - begins[docs[mine]]).astype("<i8")))
            rows["counts"].append(_packed(sizes[mine].astype(np.uint8)))
            rows["content"].append(_packed(_gather(runs.bytes, starts[mine], sizes[mine] + LENGTH - 1)) if whole else None)

        later = _later_copies(runs.bytes, starts, sizes + LENGTH - 1, ids[docs])
        if later.any():
            send(group.g % buckets, np.flatnonzero(later), False)
        first = np.flatnonzero(~later)
        order = first[np.lexsort((starts[first], bucket[first]))]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            if bounds[b + 1] > bounds[b]:
                send(b, order[bounds[b] : bounds[b + 1]], True)
        kinds = {"g": pa.int64(), "bucket": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})

    return use


def sort_windows(x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows at the places (ascending) in suffix order, by LENGTH bytes and then place, and each one's common prefix with the one before."""
    words = [(k, min(8, LENGTH - k)) for k in range(0, LENGTH, 8)]

    def word(at: np.ndarray, k: int, n: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out = (out << _U(8)) | x[at + (k + j)]
        return out

    def agree(value: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
        """Leading bytes in which two different words of n bytes agree."""
        off = value ^ before
        return sum((off >> _U(8 * (n - j)) == 0).astype(np.int64) for j in range(1, n))

    first = word(places, 0, 8)
    order = np.argsort(first, kind="stable")
    first = first[order]
    common = np.zeros(len(order), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    cut = np.flatnonzero(new)[1:]
    common[cut] = agree(first[cut], first[cut - 1], 8)
    for k, n in words[1:]:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        run = np.cumsum(new)[open_]
        value = word(places[order[open_]], k, n)
        within = np.lexsort((value, run))
        order[open_] = order[open_][within]
        value = value[within]
        cut = np.flatnonzero((value[1:] != value[:-1]) & ~new[open_[1:]]) + 1  # runs keep their extent, so run starts stay
        common[open_[cut]] = k + agree(value[cut], value[cut - 1], n)
        new[open_[cut]] = True
    common[~new] = LENGTH
    return order, common


def previous_smaller(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the nearest rank before it that has a smaller place, or -1, and the common prefix with it.

    All ranks climb at once: one whose candidate has a greater place takes that one's own candidate, which lies beyond
    nothing smaller. The common prefix is the least over the ranks passed. Long runs of places that rise, then fall, would
    take a round for each, so what still climbs after CLIMBS rounds goes down by powers of two.
    """
    to, prefix = np.arange(len(order)) - 1, common.copy()
    climbing = np.arange(1, len(order))
    climbing = climbing[order[climbing - 1] > order[climbing]]
    for _ in range(CLIMBS):
        if not len(climbing):
            break
        at = to[climbing]
        near, nearer = to[at], np.minimum(prefix[climbing], prefix[at])
        to[climbing], prefix[climbing] = near, nearer
        going = near >= 0
        climbing, near = climbing[going], near[going]
        climbing = climbing[order[near] > order[climbing]]
    if len(climbing):
        to[climbing], prefix[climbing] = _descended(order, common, climbing, to[climbing], prefix[climbing])
    prefix[to < 0] = 0
    return to, prefix


def _descended(order: np.ndarray, common: np.ndarray, ranks: np.ndarray, to: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for some ranks from their candidates on: past blocks of 2 ** k ranks without a smaller place, largest first."""
    least, nearest = [order.astype(np.int32)], [common.astype(np.int32)]
    while 2 << (len(least) - 1) <= len(order):
        half = 1 << (len(least) - 1)
        for levels in (least, nearest):
            up = levels[-1].copy()  # of the 2 * half ranks that end here; those too near the start are never asked for
            up[half:] = np.minimum(levels[-1][half:], levels[-1][:-half])
            levels.append(up)
    for k in range(len(least) - 1, -1, -1):
        whole = to >= (1 << k) - 1
        past = np.zeros(len(ranks), bool)
        past[whole] = least[k][to[whole]] > order[ranks[whole]]
        prefix = np.where(past, np.minimum(prefix, nearest[k][to]), prefix)
        to = np.where(past, to - (1 << k), to)
    return to, prefix


def longest_previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place (as a number in `order`): the length of its longest previous factor, and an earlier place that has it, or -1.

    Of the previous and the next smaller place in suffix order, the one with the longer common prefix; the previous on a tie.
    """
    n = len(order)
    back, back_prefix = previous_smaller(order, common)
    turned = np.concatenate([np.zeros(min(1, n), np.int64), common[:0:-1]])
    ahead, ahead_prefix = (a[::-1] for a in previous_smaller(order[::-1], turned))
    ahead = n - 1 - ahead  # n where there is none
    use_back = back_prefix >= ahead_prefix
    rank = np.where(use_back, back, ahead)
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    length[order] = np.maximum(back_prefix, ahead_prefix)
    source[order] = np.where((rank >= 0) & (rank < n), order[np.clip(rank, 0, max(0, n - 1))] if n else rank, -1)
    source[length == 0] = -1
    return length, source


def earliest_places(length: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For each place the least place that has its whole window: sources of full length, followed to their end."""
    to = np.where(length >= LENGTH, source, np.arange(len(length)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


MASKS = "g long, docs binary, starts binary, masks binary"


def match_bucket(table: pa.Table) -> pa.Table:
    """Masks of the windows that an earlier document has, for the segments of each group."""
    rows: list[tuple] = []
    packed = list(zip(*(table[k].to_pylist() for k in ("g", "docs", "starts", "counts", "content")), strict=True))
    for g, docs_, starts_, counts_, content in packed:
        if content is None:
            whole = (np.int64(1) << _unpacked(counts_, "u1").astype(np.int64)) - 1
            rows.append((g, _packed(_unpacked(docs_, "<i8").reshape(2, -1)[0].astype("<i4")), starts_, _packed(whole.astype("<u4"))))
    parts = [(g, _unpacked(d, "<i8").reshape(2, -1), _unpacked(s, "<i8"), _unpacked(c, "u1").astype(np.int64), _unpacked(x, "u1")) for g, d, s, c, x in packed if x is not None]
    if parts:
        masks = _masks(np.concatenate([p[1][1] for p in parts]), np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]))
        ends = np.cumsum([len(p[2]) for p in parts])
        for (g, docs, starts, _, _), end in zip(parts, ends.tolist(), strict=True):
            own = masks[end - len(starts) : end]
            hit = np.flatnonzero(own)
            if len(hit):
                rows.append((g, _packed(docs[0][hit].astype("<i4")), _packed(starts[hit]), _packed(own[hit].astype("<u4"))))
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["g", "docs", "starts", "masks"])


def _masks(docs: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each segment (its document, its count of windows, its bytes in x, end to end) a bit for each window that a smaller document has."""
    lengths = counts + LENGTH - 1
    begins = np.cumsum(lengths) - lengths
    first_copy, copy_of = _distinct_segments(x, begins, lengths, docs)
    # Distinct segments by their least document, laid end to end.
    own_lengths, own_counts = lengths[first_copy], counts[first_copy]
    text = _gather(x, begins[first_copy], own_lengths)
    at = np.cumsum(own_lengths) - own_lengths
    first_window = np.cumsum(own_counts) - own_counts
    segment = np.repeat(np.arange(len(first_copy)), own_counts)
    places = at[segment] + np.arange(len(segment)) - first_window[segment]
    earliest = earliest_places(*longest_previous_factors(*sort_windows(text, places)))
    least_doc = docs[first_copy][segment][earliest]
    # Every segment's windows again, against the least document that has each.
    of = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    gone = least_doc[first_window[copy_of][of] + nth] < docs[of]
    return np.add.reduceat(gone.astype(np.int64) << nth, np.cumsum(counts) - counts)


def _distinct_segments(x: np.ndarray, begins: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one segment of each content, that of the least document, by document; and for each segment its place among these."""
    number = _content_numbers(x, begins, lengths)
    order = np.lexsort((np.arange(len(docs)), docs, number))
    new = np.ones(len(order), bool)
    new[1:] = number[order][1:] != number[order][:-1]
    firsts = order[new]  # by number
    by_doc = np.lexsort((firsts, docs[firsts]))
    rank = np.empty(len(firsts), np.int64)
    rank[by_doc] = np.arange(len(firsts))
    return firsts[by_doc], rank[number]


RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"


def _cut_texts(table: pa.Table, found: pa.Table) -> pa.Table:
    doc_ids, texts, text_keys = ordered(table)
    marks, masks = [], []
    for mark, *packed in zip(*(found[k].to_pylist() for k in ("mark", "docs", "starts", "masks")), strict=True):
        if mark is None:
            masks.append(packed)
        else:
            marks.append(mark)
    copied = copied_rows(doc_ids, text_keys, marks)
    docs = np.concatenate([_unpacked(d, "<i4") for d, _, _ in masks] or [np.zeros(0, "<i4")])
    starts = np.concatenate([_unpacked(s, "<i8") for _, s, _ in masks] or [np.zeros(0, "<i8")])
    bits = np.concatenate([_unpacked(m, "<u4") for _, _, m in masks] or [np.zeros(0, "<u4")]).astype(np.int64)
    order = np.argsort(docs, kind="stable")
    bounds = np.searchsorted(docs[order], np.arange(len(texts) + 1))
    rows = []
    for i, text in enumerate(texts):
        raw = text.encode()
        mine = order[bounds[i] : bounds[i + 1]]
        if copied[i] and len(raw) >= LENGTH:
            rows.append((doc_ids[i], len(raw), b"", [{"start": 0, "end": len(raw)}]))
        elif not len(mine):
            rows.append((doc_ids[i], len(raw), raw, []))
        else:
            windows = np.concatenate([starts[mine][bits[mine] >> k & 1 == 1] + k for k in range(RUN)])
            change = np.bincount(windows, minlength=len(raw) + 1) - np.bincount(windows + LENGTH, minlength=len(raw) + 1)
            gone = np.cumsum(change)[: len(raw)] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            rows.append((doc_ids[i], len(raw), np.frombuffer(raw, np.uint8)[~gone].tobytes(), [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "kept", "spans"])


def _keys_of(texts: list[str]) -> tuple[Runs, list[np.ndarray]]:
    """A key counts once a run here, so a key with several runs in one document passes too, which only costs work."""
    runs = Runs(texts)
    return runs, [runs.keys]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (removed, start and end) of every document."""
    texts, buckets = grouped_texts(docs)
    copies = copies_of_texts(texts)
    finer = buckets * FINER
    segments = with_counts(texts, buckets, _keys_of, _segments(finer), SEGMENTS, copies)
    masks = segments.groupBy("bucket").applyInArrow(match_bucket, MASKS)
    back = masks.select("g", F.lit(None).cast("binary").alias("mark"), "docs", "starts", "masks").unionAll(
        copies.select("g", "mark", *(F.lit(None).cast("binary").alias(c) for c in ("docs", "starts", "masks")))
    )
    return texts.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(_cut_texts, RESULT)

