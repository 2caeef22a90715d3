"""Importance resampling towards a target, by hashed n-grams that suffix arrays of word ids enumerate.

Words become ids within a chunk of texts. The suffixes of the ids (within their documents) are sorted as deep as features
reach, three words; neighbours' common prefixes of k words and more make runs, one for each distinct k-gram of the chunk.
A run is hashed once, and its bucket scattered back to all its occurrences by the suffix array. Chunks only add up bucket
counts in the first pass; Spark sums these over chunks. In the second pass they add the buckets' gains up by document. The
CRC of an n-gram comes from its words' CRCs, as a CRC of joined bytes is a linear function of the parts' CRCs.

Only the 10,000 gains go to all tasks. Texts larger than a chunk are cut between words, and the last two words of a part
lead the next one, whose features end in its own words: so whole texts count, and memory is bounded by a chunk.

Defined results: null and empty texts have no words, no features and weight 0; they get a score and no rank. Repeated rows
count as often as they occur. Ties in the score go to the smaller doc_id, null last, then to the lesser hash of the text.
An empty table gives no rows; without target texts T is 0. Columns other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.llm.common import materialize, pieces_of, text_or_empty

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
CHUNK_BYTES = 8 << 20
#: Bytes of words in lower case; all others of ASCII separate words and become 0.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
SPACE_CRC = np.uint32(zlib.crc32(b" "))


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = (x[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits != 0, matrix, np.uint32(0)), axis=1)


@functools.lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """What 2 ** k bytes of zero make of each bit of a CRC."""
    if k:
        return _apply(_power(k - 1), _power(k - 1))
    out = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


@functools.lru_cache(maxsize=4096)
def _shift_table(length: int) -> np.ndarray:
    """For each byte of a CRC and each value of it, what `length` bytes of zero make of it."""
    x = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for k in range(length.bit_length()):
        if length >> k & 1:
            x = _apply(_power(k), x)
    return x


def _joined(left: np.ndarray, right: np.ndarray, tables: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of left and right bytes together, from their CRCs and the places of the right ones' lengths among the tables."""
    base = lengths.astype(np.int64) * 1024
    out = right.copy()
    for k in range(4):
        out ^= tables[base + 256 * k + ((left >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def _spaced(left: np.ndarray) -> np.ndarray:
    return _joined(left, np.full(len(left), SPACE_CRC), _shift_table(1), np.zeros(len(left), np.int64))


class Words:
    """Word ids (from 1) of texts, the dictionary's CRCs and lengths, and where each text's words begin."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        data = FOLDED[raw]
        solid = data != 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = edges[edges < len(data)]
        begins[inner] = solid[inner]
        places = np.flatnonzero(begins)
        self.bounds = np.searchsorted(places, edges)
        starts = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(starts), pa.py_buffer(data[solid])]).dictionary_encode()
        self.ids = words.indices.to_numpy().astype(np.int64) + 1
        known = words.dictionary.to_pylist()
        self.crcs = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
        sizes, self.lengths = np.unique(np.fromiter(map(len, known), np.int64, len(known)), return_inverse=True)
        self.tables = np.concatenate([_shift_table(int(n)) for n in sizes] or [np.zeros(0, np.uint32)])


def suffix_order(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The suffix array of texts' word ids down to LONGEST words, the ids at each depth in its order (0 past the end), and
    the words that each suffix has in common with the one before."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(ids))
    deep = [np.where(at + k < ends, np.append(ids[k:], np.zeros(min(k, len(ids)), ids.dtype)), 0) for k in range(LONGEST)]
    if len(ids) and ids.max() < 1 << 21:
        order = np.argsort(functools.reduce(lambda key, x: key << 21 | x, deep))
    else:
        order = np.lexsort(deep[::-1])
    deep = [x[order] for x in deep]
    common, same = np.zeros(len(ids), np.int64), np.ones(max(len(ids) - 1, 0), bool)
    for x in deep:
        same &= x[1:] == x[:-1]
        common[1:] += same
    return order, deep, common


def occurrence_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each length of n-gram and each word of the texts, the bucket of the n-gram that begins there (-1: none); and where texts begin."""
    words = Words(texts)
    order, deep, common = suffix_order(words.ids, words.bounds)
    out = np.full((LONGEST, len(words.ids)), -1, np.int64)
    for k in range(1, LONGEST + 1):
        heads = np.flatnonzero((common < k) & (deep[k - 1] > 0))  # first of a run, and as long as k
        crcs = words.crcs[deep[0][heads] - 1]
        for x in deep[1:k]:
            word = x[heads] - 1
            crcs = _joined(_spaced(crcs), words.crcs[word], words.tables, words.lengths[word])
        run_of = np.cumsum((common < k) & (deep[k - 1] > 0)) - 1
        there = deep[k - 1] > 0
        out[k - 1, order[there]] = (crcs % np.uint32(BUCKETS)).astype(np.int64)[run_of[there]]
    return out, words.bounds


def _parts(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in parts that end between words, each after the last words of the one before, and how many these are."""
    text = text.translate(FOLDED.tobytes()).replace(b"\0", b" ")
    lead: list[bytes] = []
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > CHUNK_BYTES:
            end = text.rfind(b" ", start + 1, start + CHUNK_BYTES)
            end = end if end > 0 else text.find(b" ", start + CHUNK_BYTES)
            end = end if end > 0 else len(text)
        part = text[start:end]
        yield len(lead), b" ".join([*lead, part])
        lead = (lead + part.rsplit(None, LONGEST - 1)[-(LONGEST - 1) :])[-(LONGEST - 1) :]
        start = end


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batch, their occurrences' buckets, and where each row's begin, by chunk; a long text's row comes more than once."""
    first = 0
    for piece in pieces_of(batch, most=CHUNK_BYTES):
        rows = np.arange(first, first + len(piece))
        first += len(piece)
        texts = piece.column(piece.schema.get_field_index("text"))
        if len(piece) > 1 or texts.nbytes <= 2 * CHUNK_BYTES:
            buckets, bounds = occurrence_buckets(texts)
            yield rows, buckets, bounds
            continue
        for lead, part in _parts(texts.cast(pa.binary())[0].as_py()):
            buckets, bounds = occurrence_buckets(pa.array([part], pa.large_binary()))
            for k in range(LONGEST):
                buckets[k, : max(lead - k, 0)] = -1  # counted with the part before
            yield rows, buckets, bounds


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets, _ in _chunks(batch):
                total += np.bincount(buckets.ravel() + 1, minlength=BUCKETS + 1)[1:]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, and text_key, a hash of the text, of every document."""
    known = np.append(gain, 0)  # the last one is for -1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = np.zeros((LONGEST, len(batch)), np.int64)
            weight = np.zeros(len(batch), np.int64)
            for rows, buckets, bounds in _chunks(batch):
                summed = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])  # noqa: B023, E731
                weight[rows] += summed(known[buckets].sum(0))
                for k in range(LONGEST):
                    totals[k, rows] += summed(buckets[k] >= 0)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(totals[0]), pa.array(totals.sum(0)), pa.array(weight)], names=["doc_id", "text_key", "n_words", "n_features", "weight"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.withColumn("text_key", F.xxhash64("text")).mapInArrow(add_up, "doc_id long, text_key long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight with Gumbel noise from a hash of the doc_id, so the highest scores are a draw without replacement."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Adds rank to the highest scores among the documents of MIN_WORDS words, `percent` of these in number.

    Rows are dealt into ranges of the order and counted by range, so a rank is a range's offset and a place within it.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_key")]
    eligible = scored.where(F.col("n_words") >= MIN_WORDS)
    drawn = eligible.count() * percent // 100
    # equal rows can take each other's places; the random number only deals many of them to several ranges
    spread = eligible.withColumn("spread", F.rand(SEED)).repartitionByRange(*order, "spread")
    ranges = materialize(spread.drop("spread").withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("range", F.coalesce(before, F.lit(0)).alias("offset"))  # a row for each of the shuffle's partitions
    place = F.col("offset") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    placed = ranges.join(F.broadcast(offsets), "range").withColumn("rank", F.when(place <= drawn, place))
    others = scored.where(F.col("n_words") < MIN_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*scored.columns, "rank").unionByName(others)


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; a rank marks the documents drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = materialize(with_scores(weigh(docs, gain)))
    return ranked(scored).drop("text_key")


#: The same in SQL: CRCs of the distinct n-grams, byte by byte.
SQL = r"""
WITH steps AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT 0 AS target, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
split AS MATERIALIZED (
  SELECT target, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
grams AS MATERIALIZED (
  SELECT target, r, unnest(words) AS gram FROM split
  UNION ALL SELECT target, r, unnest(list_transform(range(len(words) - 1), lambda i: words[i + 1] || ' ' || words[i + 2])) FROM split
  UNION ALL SELECT target, r, unnest(list_transform(range(len(words) - 2), lambda i: words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) FROM split),
counted AS MATERIALIZED (SELECT target, r, gram, count(*) AS n FROM grams GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT gram, xor(list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode(gram))::bigint), lambda k: ('0x' || substr(hex(encode(gram)), (2 * k + 1)::int, 2))::bigint),
    lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT gram FROM counted), steps),
filled AS MATERIALIZED (SELECT target, r, bucket, sum(n)::bigint AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL),
gained AS (
  SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (sum(coalesce(s, 0)) OVER () + 10000)::double / ((coalesce(s, 0) + 1)::double * (sum(coalesce(t, 0)) OVER () + 10000)::double)))::bigint AS gain
  FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN (SELECT bucket, sum(n) FILTER (WHERE target = 0) AS s, sum(n) FILTER (WHERE target = 1) AS t FROM filled GROUP BY bucket) ON bucket = i),
weighed AS (SELECT r, sum(n * gain)::bigint AS weight, sum(n)::bigint AS n_features FROM filled JOIN gained USING (bucket) WHERE target = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score
  FROM split LEFT JOIN weighed USING (r) WHERE target = 0),
placed AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * eligible // 100 THEN place END AS rank FROM placed
"""
