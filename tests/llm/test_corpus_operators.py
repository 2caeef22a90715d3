"""The operators that compare documents, or learn from them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from imgtrace.llm import common, components, entries, line_dedup, ngram_join, pseudo_likelihood, suffix_dedup, toxicity
from imgtrace.llm.common import materialize

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, 0), (2, "", "en", 1), (3, " \n\t ", None, 2), (3, " \n\t ", None, 2), (None, "no id here " * 20, "en", 3), (None, "no id here " * 20, "en", 3), (5, "x" * 3000, "en", 4), (6, "x" * 3000, "en", 5), (6, "x" * 3000, "en", 5), (7, "word " * 20000, "en", 6), (7, "other", "en", 7)]
SCHEMA = "doc_id long, text string, lang string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return {r.doc_id: r.text for r in rows}


def _documents(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def _passages(seed, n=60):
    """Documents of a small vocabulary that share passages, are copies, or are periodic."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "é", "kappa"]
    prose = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(k))
    shared = [prose(12) for _ in range(4)]
    texts = {}
    for i in range(n):
        kind = rng.randrange(6)
        parts = [prose(rng.randint(0, 20)), rng.choice(shared), prose(rng.randint(0, 20))]
        texts[i] = "" if kind == 0 else "ab" * rng.randint(10, 80) if kind == 1 else texts.get(i - 3, "x") if kind == 2 else " ".join(parts)
    return texts


def _plain_removed(texts):
    """By doc_id: (bytes, removed, spans, digest), from sets of windows."""
    seen, out = set(), {}
    for doc_id in sorted(texts):
        raw = (texts[doc_id] or "").encode()
        gone, own = bytearray(len(raw)), set()
        for p in range(len(raw) - 49):
            window = raw[p : p + 50]
            own.add(window)
            if window in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= own
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def _removed(df):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def test_suffix_dedup_of_the_table(spark, table):
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entries.op1_suffix_dedup(spark, SF).collect()}
    assert rows == _plain_removed(table)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup_of_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr("imgtrace.llm.document_keys.GROUP_BYTES", 2000)
    texts = _passages(hot)
    assert _removed(suffix_dedup.dedup(_documents(spark, texts))) == _plain_removed(texts)


def test_suffix_dedup_of_odd_rows(spark, odd, empty):
    assert suffix_dedup.dedup(empty).count() == 0
    rows = sorted((str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept)) for r in suffix_dedup.dedup(odd).collect())
    # Rows without an id and rows of one id don't remove each other; copies under a greater id go.
    want = sorted((str(d), len(t or ""), len(t) if d == 6 else 0) for d, t, *_ in ODD)
    assert rows == want


def test_window_keys_hang_on_the_window_alone():
    x = np.frombuffer(random.Random(0).randbytes(400), np.uint8)
    keys = suffix_dedup.window_keys(np.concatenate([x[:100], x, x[50:300]]))
    own = suffix_dedup.window_keys(x)
    assert keys[100 : 100 + len(own)].tolist() == own.tolist()
    assert keys[500:].tolist() == own[50 : 50 + len(keys[500:])].tolist()


def _common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(4))
def test_previous_factors_by_brute_force(seed):
    """Suffix order, common prefixes, previous and next smaller places, factor lengths and earliest places, all by their definitions."""
    rng = random.Random(seed)
    text = "".join(rng.choice("ab") for _ in range(60)) * 3 + "".join(rng.choice("abc"[: 2 + seed % 2]) for _ in range(150)) + "c" * 70 * (seed % 2)
    x = np.frombuffer(text.encode(), np.uint8)
    n = len(x) - 49
    order, common = suffix_dedup.sort_windows(x, np.arange(n))
    windows = [text[p : p + 50] for p in range(n)]
    assert order.tolist() == sorted(range(n), key=lambda p: (windows[p], p))
    assert common.tolist() == [0] + [_common(windows[a], windows[b]) for a, b in zip(order, order[1:])]
    back, prefix = suffix_dedup.previous_smaller(order, common)
    for r in range(n):
        want = next((k for k in range(r - 1, -1, -1) if order[k] < order[r]), -1)
        assert back[r] == want and prefix[r] == (_common(windows[order[r]], windows[order[want]]) if want >= 0 else 0)
    length, source = suffix_dedup.longest_previous_factors(order, common)
    for p in range(n):
        assert length[p] == max((_common(windows[p], windows[q]) for q in range(p)), default=0)
        assert source[p] == -1 if not length[p] else source[p] < p and _common(windows[p], windows[source[p]]) == length[p]
    first = {}
    for p in range(n):
        first.setdefault(windows[p], p)
    assert suffix_dedup.earliest_places(length, source).tolist() == [first[w] for w in windows]


def _smaller_by_stack(order, common):
    """Previous smaller places with a stack, and the least common prefix on the way."""
    stack, to, prefix = [], [], []
    for r, place in enumerate(order):
        near = int(common[r]) if r else 0
        while stack and order[stack[-1][0]] > place:
            near = min(near, stack.pop()[1])
        to.append(stack[-1][0] if stack else -1)
        prefix.append(near if stack else 0)
        stack.append((r, near))
    return to, prefix


@pytest.mark.parametrize("climbs", [0, 2, 64])
def test_smaller_places_of_long_climbs(monkeypatch, climbs):
    monkeypatch.setattr(suffix_dedup, "CLIMBS", climbs)
    rng = np.random.default_rng(5)
    n = 3000
    for order in (np.r_[0 : n // 2, n - 1 : n // 2 - 1 : -1], np.r_[0:n:2, n - 1 : 0 : -2], np.arange(n)[::-1], np.arange(n), rng.permutation(n), rng.permutation(5), np.zeros(1, np.int64)):
        common = rng.integers(0, 50, len(order))
        got = suffix_dedup.previous_smaller(order, common)
        assert [x.tolist() for x in got] == list(_smaller_by_stack(order, common))


def test_averages_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "FAN_IN", 4)
    rng = np.random.default_rng(6)
    weights, sums, windows = rng.random((70, 2, 5)).astype("<f4"), rng.random((70, 2, 5)).astype("<f4"), rng.integers(1, 99, 70)
    rows = [(k, b, int(windows[k]), bytearray(weights[k, b].tobytes()), bytearray(sums[k, b].tobytes())) for k in range(70) for b in range(2)]
    blocks = spark.createDataFrame(rows, "shard long, block int, windows long, weights binary, sums binary")
    for r in pseudo_likelihood._averaged(blocks, 70).collect():
        share = windows / windows.sum()
        assert np.frombuffer(r.weights, "<f4") == pytest.approx(share @ weights[:, r.block], rel=1e-5) and np.frombuffer(r.sums, "<f4") == pytest.approx(share @ sums[:, r.block], rel=1e-5)
        assert r.windows == windows.sum()


def test_factors_of_nothing():
    none = np.zeros(0, np.int64)
    length, source = suffix_dedup.longest_previous_factors(none, none)
    assert len(length) == len(source) == len(suffix_dedup.earliest_places(length, source)) == 0


def test_a_passage_of_all_documents_leaves_each_group_once():
    """Equal segments of a group travel once, for its least document; repeated rows of that document keep theirs."""
    passage = "a passage that every document of the group holds, of more than fifty bytes"
    made = suffix_dedup.Runs([f"{passage}"] * 40)
    group = suffix_dedup.Group(3, [5, 5, *range(6, 44)], [passage] * 40, made, [made.keys], lambda k: np.full(len(k), 2), [False] * 40)
    rows = suffix_dedup._segments(8)(group).to_pylist()
    sent = [suffix_dedup._unpacked(r["docs"], "<i8").reshape(2, -1)[1].tolist() for r in rows if r["content"] is not None]
    own = [suffix_dedup._unpacked(r["docs"], "<i8").reshape(2, -1)[1].tolist() for r in rows if r["content"] is None]
    assert {d for x in sent for d in x} == {5} and {d for x in own for d in x} == set(range(6, 44))


def _plain_lines(texts):
    seen, out = set(), {}
    for doc_id, text in sorted(texts.items()):
        lines = (text or "").split("\n")
        worded = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(worded) - 2):
            window = tuple(t for _, t in worded[k : k + 3])
            gone |= {k, k + 1, k + 2} if window in seen else set()
            seen.add(window)
        places = {worded[k][0] for k in gone}
        runs = sum(k - 1 not in gone for k in gone)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in places), len(worded), len(gone), runs)
    return out


def test_line_dedup_against_plain_code(spark, table):
    rng = random.Random(7)
    made = {i: "\n".join(rng.choice(["a", "b ", " b", "c", "", "d", " \t", "e"]) for _ in range(rng.randint(0, 25))) for i in range(80)}
    for texts in (table, made):
        rows = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_passages) for r in line_dedup.dedup(_documents(spark, texts)).collect()}
        assert rows == _plain_lines(texts)


def test_line_dedup_of_odd_rows(spark, odd, empty):
    assert line_dedup.dedup(empty).count() == 0
    assert line_dedup.dedup(odd).count() == len(ODD)
    clash = spark.createDataFrame([(1, "a\nb\nc", 1, "k"), (2, "a\nb\nc", 2, "k"), (2, "x\na\nb\nc\ny", 3, "k"), (None, None, 4, None)], "doc_id int, text string, places int, `text_key` string")
    out = line_dedup.remove_repeats(clash)
    assert out.schema == clash.schema
    assert sorted((r.places, r.text) for r in out.collect()) == [(1, "a\nb\nc"), (3, "x\ny"), (4, None)]


def _plain_components(texts):
    sets = {}
    for doc_id, text in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        n = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    label = {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return {d: (len(sets[d]), label[d]) for d in texts}


def _near_copies(seed, n=90):
    """Copies of a few texts with some words changed, cut or added, so that similarities lie on both sides of 3/4."""
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 80))] for _ in range(4)]
    texts = {}
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 9999)}"
        texts[i * 3 + 1] = " ".join(words[: len(words) - rng.randint(0, 6)] + [f"u{rng.randint(0, 99)}" for _ in range(rng.randint(0, 3))])
    return texts | {0: "Only three words", 2: "only THREE words", 500: "", 501: "", 503: " "}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_of_near_copies(spark, seed):
    texts = _near_copies(seed)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(_documents(spark, texts)).collect()}
    assert rows == _plain_components(texts)


def test_open_pairs_alone_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STARS", 0)
    texts = _near_copies(3, 50)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(_documents(spark, texts)).collect()}
    assert rows == _plain_components(texts)


def test_suffix_filter_never_exceeds_the_distance():
    """The bound is at most the true count of shingles behind the first shared place that are in one set only."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
        a, b = (np.sort(rng.choice(pool, rng.integers(20, 50), replace=False)) for _ in range(2))
        first = np.intersect1d(a, b)[0]
        p, q = int(np.searchsorted(a, first)), int(np.searchsorted(b, first))
        ranges = [(x >> np.uint64(60)).astype(np.uint8) for x in (a, b)]
        bins = [np.bincount(r, minlength=16) for r in ranges]
        bound = ngram_join.suffix_distance(bins[0], ranges[0].tobytes(), p, bins[1], ranges[1].tobytes(), q)
        assert bound <= len(np.setxor1d(a[p + 1 :], b[q + 1 :]))


def test_ngram_join_of_odd_rows(spark, odd, empty):
    assert ngram_join.similar(empty).count() == 0
    rows = ngram_join.similar(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 2), (3, 3), (None, None), (5, 5), (6, 5), (7, 7)}
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()} and kept.count() == len(ODD) - 2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(301, 300), (302, 301)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 140), 100) | dict.fromkeys((300, 301, 302), 300)
    assert found == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _toxic_corpus(n=900, seed=0):
    rng = random.Random(seed)
    plain = [f"plain{i}" for i in range(300)]
    bad = ["fool", "fooling", "rotten", "vile"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        sentences = [" ".join(rng.choice(plain) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(2, 10))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + " ".join(rng.choice(bad) for _ in range(2))
        docs.append((i, ". ".join(sentences) + ".", "en"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_is_learnt_from_documents_and_located(spark):
    docs, labels = _toxic_corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.fit(table, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    truth = dict(labels)
    rows = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = [d for d in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(rows[d] >= 0.5) == bool(truth[d]) for d in held]) > 0.97
    found = toxicity.locate(table, model).collect()
    bad = re.compile("fool|rotten|vile")
    assert len(found) > 150 and np.mean([bool(bad.search(r.text)) for r in found]) > 0.95
    kept = toxicity.keep_harmless(table, model)
    assert kept.columns == table.columns and kept.count() == sum(s < 0.5 for s in rows.values())


def test_toxicity_of_very_long_texts(spark):
    """Clean lines add nothing, however many; one toxic sentence among them counts in full."""
    model = toxicity.Model({"vile": 8.0, "rotten": 8.0}, toxicity.BASE)
    clean, toxic = "a clean line of text\n" * 20_000, "a vile and rotten line\n"
    assert model.score(clean) == 0.0
    assert model.score(clean + toxic + clean) == model.score(toxic) > 0.99
    table = spark.createDataFrame([(1, clean), (2, clean + toxic)], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.keep_harmless(table, model).collect()] == [1]


def test_toxicity_learns_a_sentence_that_many_documents_share(spark):
    """A sentence repeated word by word is evidence in each labelled document, also where a clean one with a smaller id holds it."""
    rng = random.Random(5)
    filler = lambda: " ".join(f"plain{rng.randrange(300)}" for _ in range(9)) + "."
    toxic = {i for i in range(1, 600) if rng.random() < 0.25}
    docs = [(i, f"{filler()} {'Xenial zorp quib. ' if i in toxic or not i else ''}{filler()}") for i in range(600)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i in toxic)) for i, _ in docs], "doc_id long, toxic int"))
    assert np.mean([model.score(t) >= 0.5 for i, t in docs if i in toxic]) > 0.99
    assert np.mean([model.score(t) >= 0.5 for i, t in docs[1:] if i not in toxic]) < 0.02


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in entries.op9_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    held = [d for d in labels if rows[d].held_out]
    caught = np.mean([rows[d].predicted for d in held if labels[d]])
    wrong = np.mean([rows[d].predicted for d in held if not labels[d]])
    assert caught > 0.8 and wrong < 0.02


def test_network_is_normalised_and_its_gradient_is_right():
    pl, rng = pseudo_likelihood, np.random.default_rng(0)
    flat = pl.first_weights(1) * 3
    w = {k: x.astype(np.float64) for k, x in pl.unflatten(flat).items()}
    context = rng.integers(0, pl.SIZE, 4)
    every = np.concatenate([np.tile(context, (pl.SIZE, 1)), np.arange(pl.SIZE)[:, None]], axis=1)
    assert np.exp(pl.log_probs(w, every)).sum() == pytest.approx(1, abs=1e-9)
    windows = rng.integers(0, 40, (60, 5))
    found, touched = pl.gradient(w, windows)
    assert touched.tolist() == sorted(set(windows[:, :-1].ravel().tolist()))
    whole = np.zeros_like(w["embed"])
    whole[touched] = found["embed"]
    for name, grad in (found | {"embed": whole}).items():
        for at in np.argwhere(np.abs(grad) > np.abs(grad).max() / 2)[:2].tolist():
            old = w[name][tuple(at)]
            both = []
            for step in (1e-5, -1e-5):
                w[name][tuple(at)] = old + step
                both.append(pl.log_probs(w, windows).sum())
            w[name][tuple(at)] = old
            assert grad[tuple(at)] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-4)
    before = pl.log_probs(pl.unflatten(flat), windows).mean()
    after = pl.log_probs(pl.unflatten(pl.train_on(flat, np.full_like(flat, 1e-3), windows, 0)[0]), windows).mean()
    assert after > before


def test_pseudo_likelihood_prefers_the_corpus(spark, odd, empty):
    rng = random.Random(1)
    words = [f"t{i}" for i in range(30)]
    start = {w: rng.sample(words, 2) for w in words}
    def chain(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(start[out[-1]]))
        return " ".join(out)
    docs = spark.createDataFrame([(i, chain(400)) for i in range(400)] + [(1000 + i, " ".join(rng.choice(words) for _ in range(400))) for i in range(10)], "doc_id long, text string")
    rows = pseudo_likelihood.fit_and_score(docs).collect()
    mean = lambda wanted: np.mean([r.log_likelihood / r.n_tokens for r in rows if (r.doc_id < 1000) == wanted])
    assert mean(True) > mean(False) + 0.3
    out = pseudo_likelihood.fit_and_score(odd).collect()
    assert len(out) == len(ODD) and {(r.n_tokens, r.log_likelihood) for r in out if r.doc_id in (1, 2, 3)} == {(0, 0.0)}
    assert pseudo_likelihood.fit_and_score(empty).count() == 0


def _plain_ids(text, known):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return [known[x] if x in known else pseudo_likelihood.SIZE - pseudo_likelihood.SHARED + zlib.crc32(x.encode()) % pseudo_likelihood.SHARED for x in words]


def _plain_log_prob(w, left, right, target):
    """One word's log-probability, number by number."""
    total = w["bias"].astype(float).copy()
    for k, near in enumerate([*left, *right]):
        total += w["embed"][near] * w["place"][k]
    hidden, digits, out = np.tanh(total), (target % 32, target // 32 % 32, target // 1024), 0.0
    states = (hidden, hidden + w["after_first"][digits[0]], hidden + w["after_second"][digits[0] * 32 + digits[1]])
    biases = (w["first_bias"], w["second_bias"][digits[0]], w["third_bias"][digits[0] * 32 + digits[1]])
    for state, name, bias, digit in zip(states, ("first", "second", "third"), biases, digits):
        logits = [float(sum(state * w[name][:, j]) + bias[j]) for j in range(32)]
        out += logits[digit] - np.log(sum(np.exp(x) for x in logits))
    return out


def test_pseudo_likelihood_scores_are_sums_over_words(spark, table):
    pl = pseudo_likelihood
    chunked = pl.chunks(_documents(spark, table))
    words = pl.vocabulary(chunked)
    counts = Counter(w for t in table.values() for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    assert words == sorted(counts, key=lambda w: (-counts[w], w))[: pl.SIZE - pl.SHARED]
    known, flat = {w: i for i, w in enumerate(words)}, pl.first_weights(2)
    w, pad = pl.unflatten(flat), [pl.PAD] * 2
    for r in pl.score(pl.numbered(chunked, words), flat).collect()[:8]:
        ids = _plain_ids(table[r.doc_id], known)
        padded = pad + ids + pad
        assert r.n_tokens == len(ids)
        want = sum(_plain_log_prob(w, padded[t : t + 2], padded[t + 3 : t + 5], padded[t + 2]) for t in range(min(len(ids), 300)))
        if len(ids) <= 300:
            assert r.log_likelihood == pytest.approx(want, rel=1e-4)


def test_every_window_trains_and_partitions_do_not_matter(spark, table, monkeypatch):
    pl = pseudo_likelihood
    monkeypatch.setattr(pl, "SHARD_WORDS", 20_000)
    docs = _documents(spark, table)
    scores = []
    for parts in (2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        scores.append({r.doc_id: r.log_likelihood for r in pl.fit_and_score(docs.repartition(parts, "doc_id")).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)
    assert len({r.n_tokens for r in pl.fit_and_score(docs).collect()}) > 1
    documents = pl.numbered(pl.chunks(docs), ["the"])
    n_words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in table.values())
    dealt = documents.where("length(ids) > 0").select("ids", *pl._shard(F.col("ids"), 7)).collect()
    assert sum(len(r.ids) // 2 for r in dealt) == n_words and {r.round for r in dealt} == set(range(pl.ROUNDS)) and len({r.shard for r in dealt}) == 7


def test_pipeline_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r for r in rows}
        if name == "line_dedup":
            plain = _plain_lines(before)
            assert {d: r.text for d, r in after.items()} == {d: t for d, (t, n, gone, _) in plain.items() if not n or gone < n}
        if name == "ngram_join":
            assert set(after) == {c for _, c in _plain_components(before).values()}
        if name == "secrets":
            assert set(after) == set(before) and not any(re.search("[0-9a-f]{32}", r.text) for r in rows)
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
        docs = spark.createDataFrame(rows, out.schema) if name != "packing" else docs
    assert corpus_pipeline.run(spark, SF).count() > 0


def _write(spark, folder, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids long, bucket string"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, a text of more than 8 MiB, and columns with names that stages use go through every stage."""
    lines = ["a line of some words here", "and a second line of words", "the third line has words too"]
    long = "\n".join(f"line {i} of a very long text" for i in range(400_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "\n".join(lines)), (5, "\n".join(lines)), (6, "one lone text"), (6, "one lone text"), (None, "a text without an id, of nine words or so"), (8, long)]
    rows = [(d, t, "en", None, 0 if t is None else len(t), 7, "x") for d, t in texts]
    assert len(long) > 8 << 20
    _write(spark, tmp_path, rows, [])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = materialize(out)
        kept[name] = sorted(str(r.doc_id) for r in (docs if name != "packing" else out).select("doc_id").distinct().collect())
    assert kept["toxicity"] == sorted(["1", "2", "3", "4", "5", "6", "8", "None"])
    assert kept["line_dedup"] == kept["ngram_join"] == kept["secrets"] == sorted(["1", "2", "3", "4", "6", "8", "None"])  # 5 lost all its lines
    assert docs.where("doc_id = 6").count() == 2 and kept["packing"] == kept["secrets"]
    assert docs.where("doc_id = 8").first().text == long
    pieces = out.where("doc_id = 1").collect()
    assert [(p.length, p.doc_tokens) for p in pieces] == [(1, 1)]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_that_the_pipeline_still_finds(spark):
    """Line dedup cuts shared passages from later copies, so fewer are linked after it than on whole texts; none of the clean ones goes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, copies = [], {}
    for k in range(40):
        lines = [[word() for _ in range(12)] for _ in range(12)]
        rows.append((len(rows), "\n".join(map(" ".join, lines))))
        for at in rng.sample(range(12), 3 if k % 2 else 1):
            lines[at][rng.randrange(12)] = word()
        copies[len(rows)] = len(rows) - 1
        rows.append((len(rows), "\n".join(map(" ".join, lines))))
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    whole = {r.doc_id for r in stages["ngram_join"](spark, docs, SF).collect()}
    cut = {r.doc_id for r in stages["ngram_join"](spark, materialize(stages["line_dedup"](spark, docs, SF)), SF).collect()}
    assert whole >= {d for d in range(len(rows)) if d not in copies} and cut >= {d for d in range(len(rows)) if d not in copies}
    found = [sum(d not in left for d in copies) / len(copies) for left in (whole, cut)]
    assert found[0] > 0.9
    print("near copies found on whole texts, and after line dedup:", found)


def test_toxicity_scores_are_a_plain_noisy_or():
    """One less the product over sentences of what each leaves, against the level of a sentence without weighted words."""
    words = ["bad", "worse", "fine", "so", "idiotic", "it"]
    rng = random.Random(11)
    model = toxicity.Model({f: round(rng.uniform(0, 9), 3) for w in words[:4] for f in toxicity.features_of(w)[0]}, toxicity.BASE)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(60):
        sentences = [[rng.choice(words) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 7))]
        text = " ".join(" ".join(s) + "." for s in sentences)
        left = 1.0
        for s in sentences:
            z = toxicity.BASE + sum(model.weights.get(f, 0.0) for k, w in enumerate(s) for f in toxicity.features_of(w + "." * (k == len(s) - 1))[0])
            left *= (1 - sigmoid(z)) / (1 - sigmoid(toxicity.BASE)) if z > toxicity.BASE else 1.0
        assert model.score(text) == pytest.approx(1 - left, abs=1e-9)
    assert model.score("") == model.score(" \n ") == 0


def test_toxicity_gradient_by_differences(monkeypatch):
    """One round of training moves each weight by the slope of the bags' log-likelihood, found by differences, less its cost."""
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    rng = random.Random(12)
    names = [f"f{i}" for i in range(6)]
    labels = {d: int(d % 3 == 0) for d in range(30)}
    hits = [(d, labels[d], sorted(rng.sample(names, rng.randint(1, 3))), rng.randint(1, 3)) for d in range(30) for _ in range(rng.randint(1, 3))]
    n_toxic, n_docs = 14, 50
    leak = n_toxic / n_docs

    def likelihood(w):
        total = 0.0
        for d, label in labels.items():
            hazard = leak
            for of, _, features, times in hits:
                if of == d:
                    z = toxicity.BASE + sum(w[f] for f in features)
                    hazard += times * max(0.0, np.log1p(np.exp(z)) - np.log1p(np.exp(toxicity.BASE)))
            total += np.log(-np.expm1(-hazard)) if label else -hazard
        return total / n_docs

    start = (1 - toxicity.BASE) / 3
    w0 = dict.fromkeys(names, start)
    cost = toxicity.COST[0] / n_docs + toxicity.COST[1]
    got = toxicity.train(hits, n_toxic, n_docs).weights
    for f in names:
        slope = (likelihood({**w0, f: start + 1e-5}) - likelihood({**w0, f: start - 1e-5})) / 2e-5
        size = np.sqrt(slope * slope + 1e-12)
        assert got[f] == pytest.approx(start + toxicity.RATE * (slope - cost) / size, abs=2e-4)



def test_windows_take_two_bytes_a_word():
    found = pseudo_likelihood.windows_of(np.array([1, pseudo_likelihood.SIZE - 1], "<u2"))
    assert found.dtype.itemsize == 2 and found.tolist() == [[pseudo_likelihood.PAD, pseudo_likelihood.PAD, pseudo_likelihood.SIZE - 1, pseudo_likelihood.PAD, 1], [pseudo_likelihood.PAD, 1, pseudo_likelihood.PAD, pseudo_likelihood.PAD, pseudo_likelihood.SIZE - 1]]


def test_softmax_of_any_span():
    far = np.array([[0.0, 1.0], [500.0, 501.0], [-900.0, -900.0]], np.float32)
    want = [-np.log1p(np.e), -np.log1p(1 / np.e), -np.log(2)]
    assert np.allclose(pseudo_likelihood._log_prob(far, np.array([0, 1, 1])), want, atol=1e-4)
    assert len(pseudo_likelihood._log_prob(np.zeros((0, 2), np.float32), np.zeros(0, int))) == 0


def test_words_part_at_spaces_and_controls_only(spark):
    docs = spark.createDataFrame([(1, "A\x1cb c 　d\te\x0bÉ\x85f"), (2, None)], "doc_id long, text string")
    (row,) = pseudo_likelihood.chunks(docs.coalesce(1)).collect()
    assert row.words == ["a\x1cb c", "　d", "e", "é\x85f"] and row.lengths == [4, 0] and row.counts == [1] * 4


def test_large_rows_come_in_batches_of_few(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    seen = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    with common.rows_a_batch(spark, 8):
        found = common.materialize(spark.range(0, 20, 1, 1).mapInArrow(seen, "n long"), 1 << 20)
    assert sorted(r.n for r in found.collect()) == [4, 8, 8] and spark.conf.get(name) == before


def test_small_logits_are_not_shifted():
    near, far = np.array([[0.0, 1.0], [-40.0, 50.0]], np.float32), np.array([[0.0, 1.0], [-80.0, -70.0]], np.float32)
    for x, want in ((near, [0, 0]), (far, [1, -70])):
        powers, top, total = pseudo_likelihood._exponentials(x.copy())
        assert top.tolist() == want and np.allclose(powers, np.exp(x - top[:, None])) and np.allclose(total, powers.sum(1))


def test_a_batch_adds_up_its_windows():
    pl, rng = pseudo_likelihood, np.random.default_rng(5)
    windows = pl.windows_of(np.minimum(rng.zipf(1.2, pl.BATCH), pl.SIZE - 1).astype("<u2"))
    w = pl.unflatten(pl.first_weights(3))
    alone = [pl.gradient(w, windows[i : i + 1]) for i in range(0, pl.BATCH, 64)]
    part, at = pl.gradient(w, windows[::64])
    for name in ("third_bias", "after_second", "second_bias", "after_first", "place"):
        assert np.allclose(part[name], sum(g[name] for g, _ in alone), atol=1e-4)
    want = np.zeros_like(w["embed"])
    for g, rows in alone:
        want[rows] += g["embed"]
    assert np.allclose(part["embed"], want[at], atol=1e-4) and not np.delete(want, at, 0).any()


def test_words_of_a_slice_get_their_ids():
    words = ["é日", "the", "zz", "of", "x" * 300, "q"]
    known = pa.array(["of", "the"])
    want = [_plain_ids(w, {"of": 0, "the": 1})[0] for w in words]
    for i in range(len(words) + 1):
        assert pseudo_likelihood.ids_of_words(pa.array(words)[i:], known).tolist() == want[i:]
    assert pseudo_likelihood.ids_of_words(pa.array(words)[1:2], known).tolist() == [1]
