"""Secret scans: three fixed rules, and a linear-chain conditional random field for what they miss.

The field tags words (between white space) as begin, inside or outside of a secret. A word's score for a tag adds the
weights of its own features (shape, length, digits, variety, known words), of its neighbours' and of the whole text's;
a weight for each pair of tags ties the chain. It is trained here, on windows around the rules' matches in a bounded
sample of the documents, with made-up secrets put into other windows of the sample, and decoded by Viterbi. A word whose
score for outside leads by more than the tag pairs can ever make up is outside on any best path, so the chain is cut
there and Viterbi runs on what lies between.

Defined results: null text is empty text and has no spans; the rules' spans stay as they are, and of each found run the
parts outside of these are added, but for mere quotes, brackets and stops; every row gives one row, repeated rows too; with
no documents (an empty table, which gives no rows) the field is trained on made-up windows alone; of equally likely tags
the first one is taken; documents of one id, or none, are told apart in the sample by their texts, and equal rows count
once there; a very long text is tagged whole, cut only where any best path is outside; offsets count code points, ends are exclusive; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import WORD, pieces_of, text_or_empty

# The rules' patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "field")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 is the whole run, as runs are taken at their full length
_KEYWORDS = ("passw", "secret", "token", "api")

BEGIN, INSIDE, OUTSIDE = range(3)
_WORD = re.compile(WORD)
_EDGES = "\"'`,;:()[]{}<>.!?"
_BREAKS = " \t\n\x0b\x0c\r"
_HINTS = frozenset("password passwd pwd pass secret token apikey api_key key keys auth bearer credential credentials login access private authorization signature".split())
KEPT_WORDS = 150_000
#: The sample: so many documents at most, and a window of so many words from each.
SAMPLE_DOCS, WINDOW = 1500, 40
ROUNDS = 60

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed rules, by start and then kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(x in lower for x in _KEYWORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def word_features(word: str) -> tuple[str, ...]:
    """What the field sees of a word; few distinct results, however many words there are."""
    core = word.strip(_EDGES)
    lower = core.lower()
    out = []
    if lower in _HINTS:
        out.append(f"hint={lower}")
    elif any(h in lower for h in ("passw", "secret", "token", "apikey", "api_key")):
        out.append("hint inside")
    if word[-1:] in ":=":
        out.append("ends in sign")
    if core.isalpha():
        out.append("letters capital" if core[:1].isupper() and not core[1:].isupper() else "letters")
        out.append(f"length={min(len(core) // 6, 5)}")
        return tuple(out)
    digits = sum(c.isdigit() for c in core)
    upper = sum(c.isupper() for c in core)
    letters = sum(c.isalpha() for c in core)
    turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(core, core[1:]))
    out.append(f"length={min(len(core) // 4, 11)}")
    out.append(f"digits={'none' if not digits else 'all' if digits == len(core) else min(3, 4 * digits // len(core))}")
    out.append(f"case={'mixed' if 0 < upper < letters else 'upper' if upper else 'lower'}")
    out.append(f"turns={min(turns // 3, 6)}")
    out.append(f"variety={min(len(set(core)) // 5, 6)}")
    signs = {c for c in core if not c.isalnum()}
    out.append("signs=none" if not signs else "signs=key" if signs <= set("+/_.=-") else "signs=pair" if signs & set("=:") else "signs=other")
    return tuple(out)


def text_features(text: str, n_base: int) -> tuple[str, ...]:
    signs = text.count("=") + text.count("{") + text.count(";")
    share = 1000 * signs // max(1, len(text))
    return (f"text signs={min(share // 5, 3)}", f"text rules={min(n_base, 2)}")


def _made_up(rng: random.Random) -> list[str]:
    """Words that hold a made-up secret of a form that the rules may miss."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    value = rng.choice((run(rng.randint(20, 44)), f"{run(rng.randint(2, 4), letters[26:52])}_{run(rng.randint(18, 36))}", f"{run(8)}-{run(12)}-{run(12)}", run(rng.randint(24, 31), "0123456789abcdef"), f"{run(16)}/{run(12)}+{run(10)}="))
    hint = rng.choice(("pwd", "pass", "key", "auth", "bearer", "credential", "login", "Authorization", "private", "signature"))
    form = rng.randrange(4)
    return [value] if form == 0 else [f"{hint}:", value] if form == 1 else [hint, "=", value] if form == 2 else [hint, value]


class Field:
    """The trained field: weights of features for a word itself, for its left and its right neighbour, of texts, and of tag pairs."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, pairs: np.ndarray, ends: np.ndarray) -> None:
        self.features, self.weights, self.pairs, self.ends = features, weights, pairs, ends
        others = [max(pairs[p, x] + pairs[x, n] - pairs[p, OUTSIDE] - pairs[OUTSIDE, n] for p in range(3) for n in range(3)) for x in (BEGIN, INSIDE)]
        first = [max(ends[x] - ends[OUTSIDE] + pairs[x, n] - pairs[OUTSIDE, n] for n in range(3)) for x in (BEGIN, INSIDE)]
        last = [max(pairs[p, x] - pairs[p, OUTSIDE] for p in range(3)) for x in (BEGIN, INSIDE)]
        alone = [ends[x] - ends[OUTSIDE] for x in (BEGIN, INSIDE)]
        self.lead = max(*others, *first, *last, *alone) + 1e-9
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, 9))
        self.known: dict[str, int] = _Words(self)

    def score(self, features: tuple[str, ...]) -> np.ndarray:
        ids = [self.features[f] for f in features if f in self.features]
        return self.weights[ids].sum(0) if ids else np.zeros(9)

    def row(self, word: str) -> int:
        features = word_features(word)
        at = self.rows.get(features)
        if at is None:
            at = self.rows[features] = len(self.rows)
            if at >= len(self.table):
                self.table = np.vstack([self.table, np.zeros((max(256, at), 9))])
            self.table[at] = self.score(features)
        return at

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of the tags for each word, without the text's features."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        found = self.table[ids]
        out = found[:, :3].copy()
        out[1:] += found[:-1, 3:6]
        out[:-1] += found[1:, 6:]
        return out

    def decode(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words (first, one past the last) that are a secret on the best path."""
        n = len(scores)
        open_words = np.flatnonzero(scores[:, OUTSIDE] - scores[:, :2].max(1) <= self.lead)
        if not len(open_words):
            return []
        spans: list[tuple[int, int]] = []
        for run in np.split(open_words, np.flatnonzero(np.diff(open_words) > 1) + 1):
            start, end = int(run[0]), int(run[-1]) + 1
            tags = self._viterbi(scores[start:end].tolist(), start == 0, end == n)
            at = None
            for i, tag in enumerate([*tags, OUTSIDE]):
                if at is not None and tag != INSIDE:
                    spans.append((start + at, start + i))
                    at = None
                if at is None and tag != OUTSIDE:
                    at = i
        return spans

    def _viterbi(self, scores: list[list[float]], from_start: bool, to_end: bool) -> list[int]:
        pairs = self.pairs.tolist()
        into = self.ends.tolist() if from_start else pairs[OUTSIDE]
        best = [into[y] + scores[0][y] for y in range(3)]
        back = []
        for row in scores[1:]:
            came = [max(range(3), key=lambda x: best[x] + pairs[x][y]) for y in range(3)]
            best = [best[came[y]] + pairs[came[y]][y] + row[y] for y in range(3)]
            back.append(came)
        if not to_end:
            best = [best[y] + pairs[y][OUTSIDE] for y in range(3)]
        tags = [max(range(3), key=best.__getitem__)]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return tags[::-1]

    def dump(self) -> str:
        return json.dumps({"features": list(self.features), "weights": self.weights.tolist(), "pairs": self.pairs.tolist(), "ends": self.ends.tolist()})


class _Words(dict):
    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> int:
        at = self.field.row(word)
        if len(word) <= 64:
            self[word] = at
        return at


@functools.lru_cache(maxsize=1)
def load(dumped: str) -> Field:
    x = json.loads(dumped)
    return Field({f: i for i, f in enumerate(x["features"])}, np.array(x["weights"]).reshape(-1, 9), np.array(x["pairs"]), np.array(x["ends"]))


Example = tuple[list[str], list[int], tuple[str, ...]]


def tag_words(text: str, spans: list[Span]) -> tuple[list[str], list[int]]:
    """Words of a text, and their tags by the spans."""
    words, tags, k, open_span = [], [], 0, -1
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        words.append(m[0])
        if k < len(spans) and spans[k][0] < m.end():
            tags.append(INSIDE if open_span == k else BEGIN)
            open_span = k
        else:
            tags.append(OUTSIDE)
    return words, tags


def sample_windows(docs: DataFrame) -> list[Example]:
    """Windows of the sample's documents: around the first match of a rule, else where a hash of doc_id says."""
    schema = "key long, words array<string>, tags array<int>, features array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    spans = base_spans(text)
                    words, tags = tag_words(text, spans)
                    hit = next((i for i, t in enumerate(tags) if t == BEGIN), key % max(1, len(words)))
                    start = max(0, hit - WINDOW // 2)
                    rows.append((key, words[start : start + WINDOW], tags[start : start + WINDOW], text_features(text, len(spans))))
                types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", "words", "tags", "features"])

    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    source = docs.select(key.alias("key"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    # The least pairs of hashes of id and text, equal rows once: found on the hashes alone, so no text moves but those of the sample.
    bound = source.select("key", "tie").distinct().orderBy("key", "tie").limit(SAMPLE_DOCS).agg(F.max(F.struct("key", "tie")).alias("last")).first().last
    if bound is None:
        return []
    least = (F.col("key") < bound.key) | ((F.col("key") == bound.key) & (F.col("tie") <= bound.tie))
    chosen = source.where(least).dropDuplicates(["key", "tie"]).orderBy("key", "tie").drop("tie")
    return [(r.words, r.tags, tuple(r.features)) for r in chosen.mapInArrow(run, schema).collect()]


def train(windows: list[Example], seed: int = 0) -> Field:
    """Fits the field by full-batch gradient steps; half of the windows without a secret, and made-up ones, get a secret put in."""
    rng = random.Random(seed)
    plain = [["the", "of", "and", "Word", "for", "number", "12", "x1", "2024-01-01", "state,", "a.", "http://example.org/page"][rng.randrange(12)] for _ in range(4000)]
    examples = [w for w in windows if w[0]] + [(plain[i : i + WINDOW], [OUTSIDE] * WINDOW, text_features("", 0)) for i in range(0, 4000, WINDOW)]
    for words, tags, features in list(examples):
        if BEGIN not in tags and rng.random() < 0.5:
            new, at = _made_up(rng), rng.randint(0, len(words))
            examples.append(((words[:at] + new + words[at:])[: WINDOW + 4], (tags[:at] + [BEGIN] + [INSIDE] * (len(new) - 1) + tags[at:])[: WINDOW + 4], features))
    names: dict[str, int] = {}
    rows: dict[tuple, int] = {}
    longest = max(len(w) for w, _, _ in examples)
    ids = np.zeros((len(examples), longest), np.int64)
    gold = np.full((len(examples), longest), OUTSIDE)
    live = np.zeros((len(examples), longest), bool)
    text_rows = np.zeros(len(examples), np.int64)
    for k, (words, tags, features) in enumerate(examples):
        n = len(words)
        ids[k, :n] = [rows.setdefault(word_features(w), len(rows)) for w in words]
        gold[k, :n], live[k, :n] = tags, True
        text_rows[k] = rows.setdefault(features, len(rows))
    for features in rows:
        for f in features:
            names.setdefault(f, len(names))
    has = np.zeros((len(rows), len(names)))
    for features, r in rows.items():
        has[r, [names[f] for f in features]] = 1
    weights, pairs, ends = np.zeros((len(names), 9)), np.zeros((3, 3)), np.zeros(3)
    lengths = live.sum(1)
    onehot = np.eye(3)[gold] * live[:, :, None]
    step = lambda g, seen, w: (seen.__iadd__(g * g), w.__iadd__(0.3 * g / np.sqrt(seen + 1e-8)))
    seen = [np.zeros_like(x) for x in (weights, pairs, ends)]
    every = np.arange(len(examples))
    for _ in range(ROUNDS):
        table = has @ weights
        own, left, right = table[:, :3], table[:, 3:6], table[:, 6:]
        scores = own[ids] + own[text_rows][:, None]
        scores[:, 1:] += left[ids[:, :-1]] * live[:, 1:, None]
        scores[:, :-1] += right[ids[:, 1:]] * live[:, 1:, None]
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = ends + scores[:, 0]
        for t in range(1, longest):
            x = np.logaddexp.reduce(alpha[:, t - 1, :, None] + pairs, 1) + scores[:, t]
            alpha[:, t] = np.where(live[:, t, None], x, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = np.logaddexp.reduce(pairs + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], x, 0)
        total = np.logaddexp.reduce(alpha[every, lengths - 1], 1)
        found = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        off = (onehot - found) / len(examples)
        both = np.exp(alpha[:, :-1, :, None] + pairs + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        per_row = np.zeros((len(rows), 9))
        for y in range(3):
            per_row[:, y] += np.bincount(ids.ravel(), off[:, :, y].ravel(), len(rows)) + np.bincount(text_rows, off[:, :, y].sum(1), len(rows))
            per_row[:, 3 + y] += np.bincount(ids[:, :-1].ravel(), off[:, 1:, y].ravel(), len(rows))
            per_row[:, 6 + y] += np.bincount(ids[:, 1:].ravel(), (off[:, :-1, y] * live[:, 1:]).ravel(), len(rows))
        step(has.T @ per_row - 1e-5 * weights, seen[0], weights)
        step(np.einsum("stx,sty->xy", onehot[:, :-1], onehot[:, 1:]) / len(examples) - both.sum((0, 1)) / len(examples) - 1e-5 * pairs, seen[1], pairs)
        step(off[:, 0].sum(0) - 1e-5 * ends, seen[2], ends)
    return Field(names, weights, pairs, ends)


def scan_text(text: str, field: Field) -> list[Span]:
    """All spans of a text: the rules', and the parts of the field's runs outside of these, by start and then kind."""
    base = base_spans(text)
    words = _WORD.findall(text)
    if not words:
        return base
    runs = field.decode(field.scores(words) + field.score(text_features(text, len(base)))[:3])
    if not runs:
        return base
    return _add_runs(text, base, runs)


def _add_runs(text: str, base: list[Span], runs: list[tuple[int, int]]) -> list[Span]:
    added, at, position, k = [], 0, 0, 0
    wanted = sorted({i for run in runs for i in (run[0], run[1] - 1)})
    place = {}
    for m in _WORD.finditer(text):
        if at == wanted[k]:
            place[at] = m.span()
            k += 1
            if k == len(wanted):
                break
        at += 1
    for first, last in runs:
        start, end = place[first][0], place[last - 1][1]
        while position < len(base) and base[position][1] <= start:
            position += 1
        stop = position
        while stop < len(base) and base[stop][0] < end:
            stop += 1
        for before, after, _ in [*base[position:stop], (end, end, "")]:
            part = text[start : max(start, before)]
            if part.strip(_EDGES + _BREAKS):
                left = len(part) - len(part.lstrip(_BREAKS))
                added.append((start + left, start + len(part.rstrip(_BREAKS)), "field"))
            start = max(start, after)
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, end, kind) of every document."""
    dumped = train(sample_windows(docs)).dump()
    schema = "doc_id long, spans array<struct<start:int,end:int,kind:string>>"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = load(dumped)
        for batch in batches:
            for part in pieces_of(batch):
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan_text(x, field)] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, spans_type)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span of their texts replaced by a mark; null texts stay null, other columns as they are."""
    dumped = train(sample_windows(docs)).dump()

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = load(dumped)
        for batch in batches:
            for part in pieces_of(batch):
                texts = [x if x is None else replace_spans(x, scan_text(x, field), mark) for x in part.column(place).to_pylist()]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def replace_spans(text: str, spans: list[Span], mark: str) -> str:
    out, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])
