"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only documents have labels.

A sentence's score is a logistic function of the weights of its words; a document's is their noisy-or, one less the product
of what each sentence leaves. A word's weight is the sum of its own and its beginnings' (so inflected forms of a stem share
theirs). Training maximises the likelihood of the documents' labels, so the weights settle on the sentences that explain
them. A leak, a constant chance of the label without any sentence's doing, takes up labels that no word explains; it is
part of the fit, not of the score. The level BASE of a sentence without weighted words is fixed, and what it alone would
leave is taken off each sentence, so such sentences add nothing, however many there are. From that level small steps would
not find any weights, so features whose count in toxic documents stands out start with one, and lose it if others explain
the labels.

Bounds of the fit: at most SAMPLE_DOCS labelled documents of at most SAMPLE_CHARS characters, chosen by a hash of doc_id,
each with all its sentences; at most CANDIDATES features, those that stand out most. The counting runs in Spark, and only
the candidates of sentences reach the driver, equal ones of a document as one row with their count. Scoring reads every
whole text.

Defined results: null and empty texts have no sentence and score 0; without labels of both kinds all weights are 0 and
all scores near 0; labels with nulls are not learnt from, of several labels of a document the largest counts, and rows of
one doc_id are one bag; labelled documents without sentences count as documents without features; a null doc_id counts as empty text in the fold; every row gives one row, repeated rows the same score; features that stand out
equally are taken by name; a very long text is scored whole, as so many sentences, and left out of the sample if it is
beyond its bound; an empty table gives no rows, and a model of zero weights if it is what the fit sees; lang, source and
further columns are not read, so no name can clash.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import materialize, pieces_of, text_or_empty

FOLDS = 5
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 50_000
BASE, ROUNDS, RATE = -9.0, 150, 0.3
#: A feature is a candidate if its count in toxic documents lies so many deviations (of the count and two more) above chance.
STANDS_OUT, LEAST_DOCS, CANDIDATES = 3.5, 3, 4000
#: What each unit of weight costs, in documents: a constant, and a share of the sample.
COST = (0.1, 0.0001)
BEGINNINGS = (4, 5, 6, 7, 8)
KEPT_WORDS = 150_000
#: A word with the end of its line, if it is the last there; a sentence ends with a line or a full stop, ! or ?.
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]*\n)?")
_EDGES = "\"'`,;:()[]{}<>.!?*#$%&|\n\t\r\x0b\x0c "


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def features_of(token: str) -> tuple[list[str], bool]:
    """A token's features, and whether a sentence ends with it."""
    bare = token.rstrip(" \t\n\x0b\x0c\r")
    word = bare.strip(_EDGES).lower()
    ends = bare != token or bare.rstrip("\"')]").endswith((".", "!", "?"))
    return [word, *(word[:k] + "~" for k in BEGINNINGS if len(word) > k)] if word else [], ends


def sample_sentences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic and features of the sample's sentences, and of each document without any, a row with no features."""
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("of_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = toxic.where(fold(F.col("of_doc")) != 0).orderBy(F.xxhash64("of_doc"), "of_doc").limit(SAMPLE_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    sample = texts.join(chosen, F.col("doc_id") == F.col("of_doc")).select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, most=1 << 20):
                rows = []
                for doc_id, text, label in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    before = len(rows)
                    features: set[str] = set()
                    for token in _TOKEN.findall(text):
                        new, ends = features_of(token)
                        features.update(new)
                        if ends and features:
                            rows.append((doc_id, label, sorted(features)))
                            features = set()
                    if features or len(rows) == before:
                        rows.append((doc_id, label, sorted(features)))
                types = (pa.int64(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "toxic", "features"])

    return materialize(sample.mapInArrow(run, "doc_id long, toxic int, features array<string>"))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _hazard(z: np.ndarray, base: float) -> np.ndarray:
    """What sentences add to the noisy-or, in logs: nothing at the level of one without weighted words."""
    return np.where(z > base, _softplus(z) - _softplus(base), 0.0)


class Model:
    """Weights by feature, and the level of a sentence without weighted words."""

    def __init__(self, weights: dict[str, float], base: float) -> None:
        self.weights, self.base = weights, base
        self.known: dict[str, float] = _Tokens(self)

    def sentence_scores(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens, the ends of sentences among them, and each sentence's logit."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return tokens, np.zeros(0, np.int64), np.zeros(0)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        # A token's weight is the real part, the end of a sentence the imaginary one.
        x = np.fromiter(map(self.known.__getitem__, tokens), np.complex128, len(tokens))
        ends = np.flatnonzero(x.imag) + 1
        if not len(ends) or ends[-1] != len(tokens):
            ends = np.append(ends, len(tokens))
        return tokens, ends, self.base + np.add.reduceat(x.real, np.concatenate([[0], ends[:-1]]))

    def score(self, text: str) -> float:
        _, _, logits = self.sentence_scores(text)
        return float(-np.expm1(-_hazard(logits, self.base).sum()))

    def dump(self) -> str:
        return json.dumps({"weights": sorted(self.weights.items()), "base": self.base})


class _Tokens(dict):
    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> complex:
        features, end = features_of(token)
        value = complex(sum(self.model.weights.get(f, 0.0) for f in features), float(end))
        if len(token) <= 64:
            self[token] = value
        return value


@functools.lru_cache(maxsize=1)
def load(dumped: str) -> Model:
    x = json.loads(dumped)
    return Model(dict(map(tuple, x["weights"])), x["base"])


def train(hits: list[tuple[int, int, list[str], int]], n_toxic: int, n_docs: int) -> Model:
    """Fits weights to the sentences with a candidate, as (doc_id, toxic, features, how often), and the counts of documents."""
    if not hits or not 0 < n_toxic < n_docs:
        return Model({}, BASE)
    names = sorted({f for _, _, features, _ in hits for f in features})
    number = {f: i for i, f in enumerate(names)}
    docs = sorted({(d, t) for d, t, _, _ in hits})
    place = {d: i for i, d in enumerate(docs)}
    label = np.array([t for _, t in docs], float)
    doc_of = np.array([place[d, t] for d, t, _, _ in hits])
    times = np.array([n for *_, n in hits], float)
    feature = np.array([number[f] for _, _, features, _ in hits for f in features])
    sentence = np.repeat(np.arange(len(hits)), [len(x) for _, _, x, _ in hits])
    others_toxic, others = n_toxic - label.sum(), n_docs - len(docs) - (n_toxic - label.sum())
    # A word and its beginnings share what lifts a sentence from the level.
    w = np.full(len(names), (1 - BASE) / 3)
    leak = np.log(n_toxic / n_docs)
    cost = COST[0] / n_docs + COST[1]
    seen, seen_leak = np.zeros_like(w), 0.0
    for _ in range(ROUNDS):
        z = BASE + np.bincount(sentence, w[feature], len(hits))
        hazard = np.bincount(doc_of, times * _hazard(z, BASE), len(docs)) + np.exp(leak)
        pull = np.where(label > 0, 1 / np.expm1(np.clip(hazard, 1e-9, 50)), -1.0)
        slope = times * pull[doc_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.bincount(feature, slope[sentence], len(w)) / n_docs
        seen += g * g
        w = w + RATE * g / np.sqrt(seen + 1e-12)
        w = np.maximum(0, w - RATE * cost / np.sqrt(seen + 1e-12))
        rest = others_toxic / np.expm1(np.exp(leak)) - others
        g_leak = float((pull.sum() + rest) * np.exp(leak) / n_docs)
        seen_leak += g_leak * g_leak
        leak += 0.1 * g_leak / np.sqrt(seen_leak + 1e-12)
    return Model({f: round(float(x), 4) for f, x in zip(names, w, strict=True) if x > 1e-3}, BASE)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sentences = sample_sentences(docs, labels)
    counts = sentences.select("doc_id", "toxic").distinct().agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = counts.n, counts.toxic or 0
    share = toxic / max(1, n)
    by_doc = sentences.select("doc_id", "toxic", F.explode("features").alias("feature")).distinct()
    by_feature = by_doc.groupBy("feature").agg(F.count("*").alias("df"), F.sum("toxic").alias("toxic_df"))
    above = (F.col("toxic_df") - share * F.col("df")) / F.sqrt(share * (1 - share) * F.col("df") + 2)
    candidates = by_feature.withColumn("above", above).where((F.col("above") > STANDS_OUT) & (F.col("df") >= LEAST_DOCS)).orderBy(F.desc("above"), "feature").limit(CANDIDATES)
    wanted = {r.feature for r in candidates.select("feature").collect()}
    known = F.array(*(F.lit(f) for f in sorted(wanted))).cast("array<string>")
    hits = sentences.select("doc_id", "toxic", F.array_intersect("features", known).alias("features")).where(F.size("features") > 0)
    counted = hits.groupBy("doc_id", "toxic", "features").agg(F.count("*").alias("times"))
    rows = [(r.doc_id, r.toxic, r.features, r.times) for r in counted.orderBy("doc_id", "features").collect()]
    return train(rows, toxic, n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    dumped = model.dump()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(dumped)
        for batch in batches:
            for part in pieces_of(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.score(x) for x in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """A row for each offending sentence: doc_id, sentence (its number), score, text (its words, one space apart)."""
    dumped = model.dump()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(dumped)
        for batch in batches:
            for part in pieces_of(batch):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens, ends, logits = own.sentence_scores(text)
                    scores = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
                    for k in np.flatnonzero(scores >= least).tolist():
                        start = int(ends[k - 1]) if k else 0
                        rows.append((doc_id, k, float(scores[k]), " ".join(t.rstrip() for t in tokens[start : ends[k]])))
                types = (pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "sentence", "score", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, sentence long, score double, text string")


def keep_harmless(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score below `least`, with all their columns."""
    dumped = model.dump()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(dumped)
        for batch in batches:
            for part in pieces_of(batch):
                yield part.filter(pa.array([own.score(x or "") < least for x in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
