"""Masked pseudo-likelihood: a window network predicts each word from the words on both sides.

Words are counted over the whole corpus; the most frequent ones have one of the SIZE ids of their own, the others share
SHARED ids by a hash. An id is three digits of base DIGIT. The network adds up the embeddings of RADIUS words on each side,
scaled by their place, and a tanh layer gives the hidden state; a softmax predicts the first digit from it, another the
second digit from it and the first, a third the last digit from it and the first two. So the probabilities of all ids sum
to 1, at the cost of three small softmaxes, whatever the vocabulary. A document's score is the sum of the log-probabilities
of its words, each given its neighbours (pseudo-likelihood).

Texts are split into words once: a chunk of documents keeps its own list of words with counts, which the vocabulary is
counted from, and the documents as numbers in that list, which become ids by one look-up a chunk. All words of all
documents are windows to learn from. Documents are dealt into shards of about SHARD_WORDS words by a hash of their ids, so
shards grow in number with the corpus. In each of ROUNDS rounds every shard takes the current network one pass further over
its own part of that round (its documents are dealt to rounds by another digit of the hash), and the shards' networks,
weighted by their windows, are averaged by blocks of weights in Spark; Adagrad's sums are averaged and kept with them.
Shards, their order and the order of the averages hang on the documents alone, not on partitions; copies of a text spread
over the shards by their doc_ids.

Defined results: null text and texts without words have no tokens and score 0; every row gives one row, repeated rows too,
and equal texts score alike; an empty corpus leaves the first weights; ties in the counts go by the word; a very long text
is one document of one shard, and is scored in slices; columns other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import forget, list_array, materialize, pieces_of, rows_a_batch, text_or_empty

DIGIT = 32
SIZE = DIGIT**3
SHARED = 2048
RADIUS, WIDTH = 2, 16
ROUNDS, BATCH, STEP = 2, 4096, 0.1
SHARD_WORDS = 8_000_000
#: Bytes of text in a chunk, chunks that a task takes up as one batch, and bytes of them that the table's readers do.
CHUNK, CHUNKS, ROW_GROUP = 2 << 20, 8, 16 << 20
#: Weights in a block that is averaged as one, and rows of it that a task averages.
BLOCK, FAN_IN = 1 << 14, 64
PAD = SIZE
_SHAPES = {
    "embed": (SIZE + 1, WIDTH),
    "place": (2 * RADIUS, WIDTH),
    "bias": (WIDTH,),
    "first": (WIDTH, DIGIT),
    "first_bias": (DIGIT,),
    "after_first": (DIGIT, WIDTH),
    "second": (WIDTH, DIGIT),
    "second_bias": (DIGIT, DIGIT),
    "after_second": (DIGIT * DIGIT, WIDTH),
    "third": (WIDTH, DIGIT),
    "third_bias": (DIGIT * DIGIT, DIGIT),
}
_N_WEIGHTS = sum(int(np.prod(s)) for s in _SHAPES.values())

Weights = dict[str, np.ndarray]


def unflatten(flat: np.ndarray) -> Weights:
    """The network's arrays, as copies."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def flatten(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in _SHAPES])


def first_weights(seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    start = {n: rng.normal(0, 0.1, s) if n in ("embed", "first", "second", "third", "after_first", "after_second") else np.zeros(s) for n, s in _SHAPES.items()}
    start["place"] = rng.normal(1, 0.3, _SHAPES["place"])
    return np.concatenate([start[n].ravel() for n in _SHAPES]).astype(np.float32)


# ---- words and ids


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of a few documents: words (distinct) and counts, and doc_ids, lengths and codes (binary, 32-bit numbers of words)."""
    schema = "words array<string>, counts array<long>, doc_ids array<long>, lengths array<int>, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", CHUNK):
                number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
                split = (text.lower().encode().split() for text in part.column(1).to_pylist())  # bytes part where WORD does
                found = [np.fromiter(map(number.__getitem__, x), "<i4", len(x)) for x in split]
                codes = np.concatenate(found)
                one = lambda values: list_array(values, [len(values)])
                columns = [
                    one(pa.array(list(number), pa.binary()).cast(pa.string())),
                    one(pa.array(np.bincount(codes, minlength=len(number)).astype(np.int64), pa.int64())),
                    one(pa.array(part.column(0).to_pylist(), pa.int64())),
                    one(pa.array([len(x) for x in found], pa.int32())),
                    pa.array([codes.tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["words", "counts", "doc_ids", "lengths", "codes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def vocabulary(chunked: DataFrame) -> list[str]:
    """The most frequent words of all documents, at most SIZE - SHARED of them.

    A count that about twice as many words reach cuts off the rest first, so tasks send no more than these to be ranked.
    """
    most = SIZE - SHARED
    words = chunked.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    counted = materialize(words.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n")))
    total = counted.count()
    if total > 2 * most:
        counted = counted.where(F.col("n") >= counted.agg(F.percentile_approx("n", 1 - 2 * most / total, 10 * total // most)).first()[0])
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def ids_of_words(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Ids: frequent words have their place among the known ones, which spreads them over the first digits; others share the rest by a hash."""
    found = pc.index_in(words, value_set=known).to_numpy(zero_copy_only=False)
    rare = np.flatnonzero(np.isnan(found)) if found.dtype.kind == "f" else np.zeros(0, np.int64)
    ids = np.nan_to_num(found).astype(np.int64)
    _, offsets, data = words.take(pa.array(rare)).buffers()  # their bytes as they lie, as lists of words are slow to make
    if len(rare):
        ends, data = np.frombuffer(offsets, "<i4", len(rare) + 1).tolist(), memoryview(data)
        ids[rare] = [SIZE - SHARED + zlib.crc32(data[i:j]) % SHARED for i, j in itertools.pairwise(ends)]
    return ids


def numbered(chunked: DataFrame, words: list[str]) -> DataFrame:
    """doc_id and ids (binary, 16-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            for own, doc_ids, lengths, codes in zip(*batch.columns, strict=True):
                ids = ids_of_words(own.values, known).astype("<u2")[np.frombuffer(codes.as_py(), "<i4")]
                sizes = lengths.values.to_numpy()
                packed = [ids[e - n : e].tobytes() for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return chunked.select("words", "doc_ids", "lengths", "codes").mapInArrow(run, "doc_id long, ids binary")


def windows_of(ids: np.ndarray) -> np.ndarray:
    """A row for each id: its RADIUS neighbours on the left, on the right, and itself."""
    n = len(ids)
    padded = np.full(n + 2 * RADIUS, PAD, np.uint16)
    padded[RADIUS : RADIUS + n] = ids
    sides = [k for k in range(2 * RADIUS + 1) if k != RADIUS]
    return np.stack([padded[k : k + n] for k in [*sides, RADIUS]], axis=1)


# ---- the network


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of logits, in their place, less a number for each row; these numbers; and the sums.

    The number is 0 where all logits are so small that nothing overflows and no row vanishes, else each row's greatest.
    """
    top = np.zeros((len(x), 1), x.dtype)
    if x.max(initial=0) > 60 or x.min(initial=0) < -60:
        top = x.max(-1, keepdims=True)
        x -= top
    np.exp(x, out=x)
    return x, top[:, 0], x @ np.ones(x.shape[1], x.dtype)


def _log_prob(x: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """By a softmax of the logits."""
    own = x.reshape(-1).take(np.arange(len(x)) * x.shape[1] + digit)
    _, top, total = _exponentials(x)
    return own - top - np.log(total)


def _digits(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The three digits of ids, the last first, so that frequent ids differ early; and the first two as one number."""
    target = target.astype(np.intp)
    a, b = target % DIGIT, target // DIGIT % DIGIT
    return a, b, target // (DIGIT * DIGIT), a * DIGIT + b


def _logits(state: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = state @ weights
    out += bias
    return out


def _hidden(w: Weights, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden state, and the embeddings of each window's neighbours."""
    near = w["embed"].take(context, 0)
    return np.tanh(np.einsum("nkd,kd->nd", near, w["place"]) + w["bias"]), near


def log_probs(w: Weights, windows: np.ndarray) -> np.ndarray:
    """The log-probability of each window's middle id."""
    hidden, _ = _hidden(w, windows[:, :-1])
    a, b, c, ab = _digits(windows[:, -1])
    out = _log_prob(_logits(hidden, w["first"], w["first_bias"]), a)
    out += _log_prob(_logits(hidden + w["after_first"].take(a, 0), w["second"], w["second_bias"].take(a, 0)), b)
    return out + _log_prob(_logits(hidden + w["after_second"].take(ab, 0), w["third"], w["third_bias"].take(ab, 0)), c)


def _summed_neighbours(at: np.ndarray, g_hidden: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The embeddings' gradient: each window's row, scaled by each place, added up by the neighbours' numbers (a row a place) below n."""
    rows, scale = g_hidden.T.astype(np.float64, order="C"), place.T.astype(np.float64, order="C")
    out = np.empty((len(rows), n))
    for k, row in enumerate(rows):
        out[k] = np.bincount(at.ravel(), np.multiply.outer(scale[k], row).ravel(), n)
    return out.T.astype(np.float32, order="C")


def gradient(w: Weights, windows: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Of the summed log-probabilities of the windows; and the embeddings' rows that it has, all others being 0."""
    windows = windows.take(np.argsort(windows[:, -1] % DIGIT, kind="stable"), 0)  # windows of one first digit in a row
    context, n = windows[:, :-1].astype(np.intp), len(windows)
    a, b, c, ab = _digits(windows[:, -1])
    flat = np.arange(n) * DIGIT
    hidden, near = _hidden(w, context)
    ones = np.ones(n, np.float32)
    g: Weights = {}

    def part(state: np.ndarray, name: str, bias: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off, _, total = _exponentials(_logits(state, w[name], bias))
        off *= (-1 / total)[:, None]
        off.reshape(-1)[flat + digit] += 1
        g[name] = state.T @ off
        return off, off @ w[name].T

    off, g_hidden = part(hidden, "first", w["first_bias"], a)
    g["first_bias"] = ones @ off
    off, g_state = part(hidden + w["after_first"].take(a, 0), "second", w["second_bias"].take(a, 0), b)
    is_digit = np.eye(DIGIT, dtype=np.float32)
    is_first, is_second = is_digit.take(a, 0), is_digit.take(b, 0)
    g["second_bias"], g["after_first"] = is_first.T @ off, is_first.T @ g_state
    g_hidden += g_state
    off, g_state = part(hidden + w["after_second"].take(ab, 0), "third", w["third_bias"].take(ab, 0), c)
    both = np.concatenate([off, g_state], 1)
    ends = np.searchsorted(a, np.arange(DIGIT + 1)).tolist()
    summed = np.concatenate([is_second[i:j].T @ both[i:j] for i, j in itertools.pairwise(ends)])
    g["third_bias"], g["after_second"] = summed[:, :DIGIT], summed[:, DIGIT:]
    g_hidden += g_state
    g_hidden *= 1 - hidden * hidden
    g["bias"] = ones @ g_hidden
    g["place"] = np.einsum("nkd,nd->kd", near, g_hidden)
    at = context.T.ravel()
    is_touched = np.zeros(SIZE + 1, bool)
    is_touched[at] = True
    touched = np.flatnonzero(is_touched)
    slot = np.empty(SIZE + 1, np.intp)
    slot[touched] = np.arange(len(touched))
    g["embed"] = _summed_neighbours(slot.take(at), g_hidden, w["place"], len(touched))
    return g, touched


def train_on(flat: np.ndarray, sums: np.ndarray, windows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights and Adagrad's sums after one pass over the windows, in an order that the seed gives."""
    w, seen = unflatten(flat), unflatten(sums)
    order = np.random.default_rng(seed).permutation(len(windows))
    for start in range(0, len(order), BATCH):
        batch = windows.take(order[start : start + BATCH], 0)
        found, touched = gradient(w, batch)
        for name, grad in found.items():
            grad = grad / np.float32(len(batch))
            square = grad * grad
            square += seen[name].take(touched, 0) if name == "embed" else seen[name]
            grad *= STEP
            grad /= np.sqrt(square)
            if name == "embed":
                seen[name][touched] = square
                grad += w[name].take(touched, 0)
                w[name][touched] = grad
            else:
                seen[name] = square
                w[name] += grad
    return flatten(w), flatten(seen)


# ---- training in shards


def _shard(ids: Column, shards: int) -> list[Column]:
    key = F.xxhash64("doc_id", ids)
    return [F.pmod(key, F.lit(shards)).alias("shard"), F.pmod(F.shiftright(key, 40), F.lit(ROUNDS)).cast("int").alias("round")]


def _averaged(blocks: DataFrame, shards: int) -> DataFrame:
    """block, and weights and sums averaged over the shards' rows by their windows, in a tree: a task takes FAN_IN rows at most."""
    schema = "shard long, block int, windows long, weights binary, sums binary"

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        n = rows["windows"].to_numpy().astype(np.float64)
        out = [sum(k * np.frombuffer(x, "<f4").astype(np.float64) for k, x in zip(n.tolist(), rows[c].to_pylist(), strict=True)) / n.sum() for c in ("weights", "sums")]
        return pa.table([rows["shard"][:1], rows["block"][:1], pa.array([int(n.sum())], pa.int64()), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in out)], names=["shard", "block", "windows", "weights", "sums"])

    while True:
        blocks = blocks.withColumn("part", F.col("shard")).withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("block", "shard").applyInArrow(mean, schema)
        shards = -(-shards // FAN_IN)
        if shards == 1:
            return blocks


def train(documents: DataFrame, n_words: int) -> np.ndarray:
    """The averaged network after ROUNDS rounds; documents as `numbered` gives them."""
    flat, sums = first_weights(), np.full(_N_WEIGHTS, 1e-3, np.float32)
    shards = max(1, -(-n_words // SHARD_WORDS))
    source = documents.where(F.length("ids") > 0).select("ids", *_shard(F.col("ids"), shards))
    schema = "shard long, block int, windows long, weights binary, sums binary"

    def one_round(weights: np.ndarray, adagrad: np.ndarray, number: int) -> DataFrame:
        def run(rows: pa.Table) -> pa.Table:
            shard = rows["shard"][0].as_py()
            windows = np.concatenate([windows_of(np.frombuffer(x, "<u2")) for x in sorted(rows["ids"].to_pylist())])
            new = [x.astype("<f4") for x in train_on(weights, adagrad, windows, shard * ROUNDS + number)]
            starts = range(0, _N_WEIGHTS, BLOCK)
            columns = [pa.array([shard] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([len(windows)] * len(starts), pa.int64())]
            return pa.table([*columns, *(pa.array([x[i : i + BLOCK].tobytes() for i in starts], pa.binary()) for x in new)], names=["shard", "block", "windows", "weights", "sums"])

        return _averaged(source.where(F.col("round") == number).groupBy("shard").applyInArrow(run, schema), shards)

    for k in range(ROUNDS):
        rows = sorted(one_round(flat, sums, k).collect(), key=lambda r: r.block)
        if rows:
            flat, sums = (np.concatenate([np.frombuffer(r[c], "<f4") for r in rows]) for c in ("weights", "sums"))
    return flat


def score(documents: DataFrame, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens and log_likelihood (the sum over its words) of every document; documents as `numbered` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = unflatten(flat)
        for batch in batches:
            for part in pieces_of(batch, "ids", 1 << 20):
                every = [np.frombuffer(x, "<u2") for x in part.column(1).to_pylist()]
                rows = np.concatenate([windows_of(x) for x in every])
                found = np.concatenate([log_probs(weights, rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)] or [np.zeros(0)])
                ends = np.cumsum([len(x) for x in every])
                sums = [float(found[e - len(x) : e].sum(dtype=np.float64)) for x, e in zip(every, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in every], pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])

    return documents.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")


def fit_and_score(docs: DataFrame) -> DataFrame:
    chunked = materialize(chunks(docs), ROW_GROUP)
    words = vocabulary(chunked)
    with rows_a_batch(docs.sparkSession, CHUNKS):
        documents = materialize(numbered(chunked, words))
    forget(chunked)
    n_words = documents.agg(F.sum(F.length("ids"))).first()[0] or 0
    return score(documents, train(documents, n_words // 2))
