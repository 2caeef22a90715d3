"""N-gram Jaccard self-join of documents, by rare-first prefix filtering.

A document's set is its distinct five-word shingles as 64-bit hashes; documents with equal sets are one class. Shingles are
ordered by the count of documents that hold them, rare ones first, the same for all. For two sets to link, at least 3/4 of
each must be in the other, so
- a set with less than 3/4 of its shingles in other documents links with nothing and is left out;
- two linked sets share a shingle in their prefixes, the first n - ceil(3n/4) + 1 in order: prefixes meet by a join;
- sizes must agree to 3/4 (length filter), and what can still follow the shared place must suffice (positional filter);
- before the first shared place nothing agrees, and behind it the two suffixes, parted by hash ranges, differ at least by
  what their counts differ in each part; all of that must leave enough to share (suffix filter).
What passes is verified once a pair by the exact intersection.

Groups of near copies would meet in all pairs. Instead each prefix shingle's documents first meet one of them (a star, so
as many pairs as entries), in turn by different choices; links merge components; then only pairs that no links connect yet
are joined in full. Every pair that passes the filters is verified or already connected: no link between components is lost.

Defined results: null text and texts without words have an empty set, link with nothing and are their own component;
fewer than five words make one shingle of the whole sequence; repeated rows are equal sets and link with themselves;
ties of shingles in the order go by their hash; a very long text is one set like any other; null doc_ids take part in
nothing and have no component; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import materialize
from imgtrace.llm.components import components, downward, least_known, one_step
from imgtrace.llm.document_keys import Group, grouped_texts, with_counts

WORDS = 5
#: The least similarity is NEED / OF.
NEED, OF = 3, 4
BINS = 16
STARS = 2
KEPT_WORDS = 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_HASHES = _WordHashes()


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text, as hashes in increasing order."""
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    words = _WORD.findall(text.encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += hashed[k : k + len(total)] * _FACTORS[k]
    return np.unique(_mixed(total))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1 and h2 (hashes of the set), and for sets that may link, tokens (shared shingles, rare first), bins (counts of
    shingles by hash range) and prefix (the hash ranges of its first shingles, a byte each)."""
    texts, buckets = grouped_texts(docs)
    schema = "doc_id long, n int, h1 long, h2 long, tokens array<long>, bins array<int>, prefix binary"
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())

    def use(group: Group) -> pa.Table:
        out = []
        for doc_id, keys in zip(group.doc_ids, group.keys, strict=True):
            n = len(keys)
            df = group.counts_of(keys)
            shared = df > 1
            own = np.array([np.add.reduce(keys, dtype=np.uint64), np.bitwise_xor.reduce(_mixed(keys))], np.uint64).view(np.int64) if n else (0, 0)
            tokens = bins = prefix = None
            if n and OF * np.count_nonzero(shared) >= NEED * n:
                order = np.lexsort((keys, df))
                tokens = keys[order[n - np.count_nonzero(shared) :]].view(np.int64)
                ranges = (keys >> np.uint64(60)).astype(np.uint8)
                bins = np.bincount(ranges, minlength=BINS).astype(np.int32)
                prefix = ranges[order[: n - -(-NEED * n // OF) + 1]].tobytes()
            out.append((doc_id, n, int(own[0]), int(own[1]), tokens, bins, prefix))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])

    return with_counts(texts, buckets, lambda rows: (None, [shingles(x) for x in rows]), use, schema)


def _least_overlap(n: Column, m: Column) -> Column:
    """Twice scaled, to stay in whole numbers: overlap * (NEED + OF) must reach this."""
    return NEED * (n + m)


def _prefixes(sets: DataFrame) -> DataFrame:
    """token, rep, n and pos of the shared shingles in each set's prefix; the shingles that no other document holds come before."""
    alone = F.col("n") - F.size("tokens")
    length = F.col("n") - F.ceil(NEED * F.col("n") / OF).cast("int") + 1
    inside = sets.where(length > alone).select("rep", "n", alone.alias("alone"), F.slice("tokens", F.lit(1), (length - alone).cast("int")).alias("prefix"))
    return inside.select("rep", "n", F.posexplode("prefix").alias("k", "token"), "alone").select("token", "rep", "n", (F.col("alone") + F.col("k")).alias("pos"))


def _may_link(n: Column, pos: Column, m: Column, other_pos: Column) -> Column:
    sizes = (OF * F.least(n, m) >= NEED * F.greatest(n, m))
    return sizes & ((NEED + OF) * (1 + F.least(n - pos - 1, m - other_pos - 1)) >= _least_overlap(n, m))


def suffix_distance(bins: np.ndarray, prefix: bytes, pos: int, other_bins: np.ndarray, other_prefix: bytes, other_pos: int) -> int:
    """At least how many shingles behind the shared places are in one set only: what the counts by hash range differ in."""
    behind = bins - np.bincount(np.frombuffer(prefix, np.uint8, pos + 1), minlength=BINS)
    other = other_bins - np.bincount(np.frombuffer(other_prefix, np.uint8, other_pos + 1), minlength=BINS)
    return int(np.abs(behind - other).sum())


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose shared places leave enough to share behind them."""
    for batch in batches:
        rows = batch.to_pydict()
        sides = zip(*(rows[f"{s}_{c}"] for s in "ab" for c in ("n", "pos", "bins", "prefix")), strict=True)
        keep = [(NEED + OF) * (n + m - p - q - suffix_distance(np.array(x), u, p, np.array(y), v, q)) >= 2 * NEED * (n + m) for n, p, x, u, m, q, y, v in sides]
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("a", "b", "a_n", "b_n")], ["a", "b", "a_n", "b_n"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with `linked`: whether the sets are similar enough.

    The place of a pair must be its first shared one; where stars meet at a later one, the filter may drop a pair that links,
    which then is not among the checked ones and comes again when all pairs meet.
    """
    side = lambda s, columns: sets.select(F.col("rep").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    small = pairs.join(side("a", ("n", "bins", "prefix")), "a").join(side("b", ("n", "bins", "prefix")), "b")
    near = small.mapInArrow(_suffix_filter, "a long, b long, a_n int, b_n int")
    n, m = F.col("a_n"), F.col("b_n")
    tokens = near.join(side("b", ("tokens",)), "b").join(side("a", ("tokens",)), "a")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return tokens.select("a", "b", ((NEED + OF) * common >= _least_overlap(n, m)).alias("linked"))


def _pairs(met: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column]) -> DataFrame:
    """a, b, a_pos and b_pos of each pair once, the lower document first, at the first place at which they met."""
    (rep, pos), (other, other_pos) = x, y
    turned = rep < other
    at = F.struct(F.when(turned, pos).otherwise(other_pos).alias("p"), F.when(turned, other_pos).otherwise(pos).alias("q"))
    found = met.groupBy(F.least(rep, other).alias("a"), F.greatest(rep, other).alias("b")).agg(F.min(at).alias("at"))
    return found.select("a", "b", F.col("at.p").cast("int").alias("a_pos"), F.col("at.q").cast("int").alias("b_pos"))


def _labelled(prefixes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The prefixes' rows with their label, for tokens that more than one label holds."""
    if labels is None:
        with_label = prefixes.withColumn("label", F.col("rep"))
    else:
        known = labels.select(F.col("node").alias("rep"), F.col("component").alias("known"))
        with_label = prefixes.join(known, "rep", "left").withColumn("label", F.coalesce("known", "rep")).drop("known")
    mixed = with_label.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("token")
    return with_label.join(mixed, "token")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """For each token one document, and the others it may link with and is not connected to; turns choose differently."""
    key = F.struct("rep", "n", "pos", "label") if not turn else F.struct(F.xxhash64("rep", "token", F.lit(turn)), "rep", "n", "pos", "label")
    hubs = rows.groupBy("token").agg(F.min(key).alias("hub"))
    hub = F.col("hub")
    met = rows.join(hubs, "token").where((F.col("label") != hub.label) & _may_link(F.col("n"), F.col("pos"), hub.n, hub.pos))
    return _pairs(met, (F.col("rep"), F.col("pos")), (hub.rep, hub.pos))


def _open_pairs(rows: DataFrame) -> DataFrame:
    """All pairs that meet in a token, may link and are not connected."""
    other = rows.select("token", *(F.col(c).alias(f"other_{c}") for c in ("rep", "n", "pos", "label")))
    met = rows.join(other, "token").where((F.col("rep") < F.col("other_rep")) & (F.col("label") != F.col("other_label")) & _may_link(F.col("n"), F.col("pos"), F.col("other_n"), F.col("other_pos")))
    return _pairs(met, (F.col("rep"), F.col("pos")), (F.col("other_rep"), F.col("other_pos")))


def links(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (a, b) that connect all of the sets (rep, n, tokens, bins, prefix) that links connect, and their components.

    Between the turns one step towards the components is enough: what has one label is connected, what is connected but has
    two is only looked at again.
    """
    prefixes = materialize(_prefixes(sets))
    checked: list[DataFrame] = []
    known = labels = None
    for turn in range(STARS + 1):
        rows = materialize(_labelled(prefixes, labels))
        if rows.isEmpty():
            break
        pairs = _star_pairs(rows, turn) if turn < STARS else _open_pairs(rows)
        for old in checked:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        checked.append(materialize(_verified(pairs, sets)))
        new = checked[-1].where("linked").select("a", "b")
        known = downward(known.union(new) if known is not None else new)
        if turn < STARS:
            known = one_step(known)
            labels = least_known(known)
    found = reduce(DataFrame.union, checked).where("linked").select("a", "b") if checked else sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    return found, components(known) if known is not None else None


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document."""
    every = materialize(shingle_sets(docs))
    linked = every.where("tokens is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "tokens", "bins", "prefix"), "doc_id").alias("s"))
    sets = materialize(linked.select("rep", "s.*"))
    _, labels = links(sets)
    classes = every.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    if labels is not None:
        classes = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("long"))
    classes = classes.select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), F.coalesce("component", "rep").alias("component"))
    joined = every.select("doc_id", "n", "h1", "h2").join(classes, (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that links connect to a smaller doc_id; null doc_ids stay."""
    found = similar(docs)
    losers = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
                        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
    from words
), shingles as (
    select doc_id, len(s) as n, unnest(s) as shingle from sets
), pairs as (
    select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as common
    from shingles a join shingles b on b.shingle = a.shingle and b.doc_id > a.doc_id group by all
), links as (
    select a, b from pairs where 100 * common >= 75 * (n + m - common)
), both_ways as (
    select a, b from links union all select b, a from links
), reached as (
    select a as node, a as other from (select distinct a from both_ways)
    union
    select r.node, l.b from reached r join both_ways l on l.a = r.other
), components as (
    select node, min(other) as component_id from reached group by node
)
select s.doc_id, len(s.s) as n_shingles, coalesce(c.component_id, s.doc_id) as component_id
from sets s left join components c on c.node = s.doc_id
"""
