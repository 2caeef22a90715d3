"""Shards in random order, importance resampling, and the audit of sources, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from imgtrace.llm import divergence, importance, sharding

#: Nulls, empty and odd texts, repeated rows, a long text, and columns with names that the operators use themselves.
ODD = [
    (1, None, None, None, 0, 7, "x"), (2, "", "en", "a", 1, 7, "x"), (3, " \n\t ", None, "a", 2, 7, "x"), (3, " \n\t ", None, "a", 2, 7, "x"), (None, "a text without an id", "en", None, 3, 7, "x"),
    (5, "x" * 3000, "en", "a", 4, 7, "x"), (6, "Naïve ÄB\0b 日本語 𝔸 \x1c　 don't 12²", "de", "b", 5, 7, "x"), (7, "Word " * 5000, "en", "a", 6, 7, "x"), (7, "other text, same id", "en", "a", 7, 7, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, slot long, bucket long, record string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(seed, n, lang="en"):
    rng = random.Random(seed)
    return " ".join(rng.choice(["The", "of", "Éa", "b2", "x-y", "tre", "longer", lang]) for _ in range(n))


def _lawful(rows, n_shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(n_shards))


def test_shards_hold_every_record_once_in_near_equal_numbers(spark, odd):
    docs = odd.union(spark.range(10, 400).selectExpr("id", "concat('text ', id)", "'en'", "'a'", "0", "0", "'x'"))
    for n_shards in (1, 7, 40):
        rows = sharding.shards(docs, n_shards, bucket_bytes=1000).collect()
        _lawful(rows, n_shards)
        assert Counter((r.doc_id, r.text, r.lang, r.source, r.bucket, r.record) for r in rows) == Counter((r[0], r[1], r[2], r[3], r[5], r[6]) for r in docs.collect())
    assert sharding.shards(docs, 40).columns == ["doc_id", "text", "lang", "source", "bucket", "record", "shard", "slot"]


def test_shards_depend_on_records_and_seed_alone(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('w', cast(id % 50 as int)) AS text")
    place = lambda d, **k: {r.doc_id: (r.shard, r.slot) for r in sharding.shards(d, 8, bucket_bytes=4000, **k).collect()}
    first = place(docs.coalesce(1))
    assert place(docs.repartition(7)) == first
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    assert place(docs) == first
    spark.conf.set("spark.sql.shuffle.partitions", before)
    other = place(docs, seed=1)
    assert sum(other[d] == first[d] for d in first) < 40
    order = np.array([d for d, _ in sorted(first.items(), key=lambda x: x[1])])
    assert abs(np.corrcoef(order, np.arange(2000))[0, 1]) < 0.1  # random within the whole order
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.1


def test_records_repeated_very_often_spread_over_the_shards(spark):
    same = spark.range(1500).selectExpr("cast(null as long) AS doc_id", "'the same text' AS text")
    docs = same.union(spark.range(500).selectExpr("id", "concat('other ', id)"))
    rows = sharding.shards(docs, 10, bucket_bytes=2000).collect()
    _lawful(rows, 10)
    assert Counter(r.doc_id for r in rows)[None] == 1500 and len(rows) == 2000
    assert min(Counter(r.shard for r in rows if r.doc_id is None).values()) > 100


def test_shards_of_an_empty_table_and_written_files(spark, empty, tmp_path):
    assert sharding.shards(empty, 40).count() == 0
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    sharded = sharding.shards(docs, 6, bucket_bytes=1500)
    sharding.write(sharded, str(tmp_path / "out"))
    want = {s: [r.doc_id for r in sharded.where(F.col("shard") == s).orderBy("slot").collect()] for s in range(6)}
    for s in range(6):
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == want[s]


def _plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _plain_resample(docs, targets):
    crc = lambda f: zlib.crc32(f.encode()) % 10000
    features = [(d, *_plain_features(t)) for d, t in docs]
    s, t = Counter(crc(f) for _, _, fs in features for f in fs), Counter(crc(f) for x in targets for f in _plain_features(x)[1])
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    rows = []
    for d, n, fs in features:
        weight = sum(gain(crc(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = drawn[: 5 * len(drawn) // 100]
    return Counter((*r[:4], next((i + 1 for i, x in enumerate(drawn) if x is r), None)) for r in rows)


def test_resampling_is_what_loops_give(spark, odd):
    more = [(100 + i, _words(i % 90, 5 + i % 60), "en", "a", 0, 0, "x") for i in range(200)]
    docs = odd.union(spark.createDataFrame(more, SCHEMA))
    target = spark.createDataFrame([(1, _words(3, 300)), (2, None), (3, "日本語 of the")], "item_id long, text string")
    want = _plain_resample([(r[0], r[1]) for r in ODD + more], [r.text for r in target.collect()])
    for n in (1, 6):
        got = importance.resample(docs.repartition(n), target).collect()
        assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == want
    assert sum(r.rank is not None for r in got) == 7


def test_ranks_of_many_equal_rows_and_empty_tables(spark, empty):
    scored = spark.range(2000).selectExpr("cast(null as long) AS doc_id", "1L AS text_key", "30L AS n_words", "1L AS n_features", "0L AS weight", "5L AS score")
    ranks = sorted(r["rank"] for r in importance.ranked(scored).where("rank is not null").collect())
    assert ranks == list(range(1, 101))
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_features, r["rank"]) for r in importance.resample(few, none).collect()] == [(6, None)]


def test_a_long_text_in_parts_has_the_same_buckets(monkeypatch):
    texts = [_words(1, 700) + " " + "z" * 900 + " -- " + _words(2, 300), "short one", "", "," * 5000, "q" * 2500]
    batch = pa.record_batch({"text": pa.array(texts)})
    tally = lambda: [Counter(b.ravel()[b.ravel() >= 0].tolist()) for b in _by_row(batch)]
    whole = tally()
    monkeypatch.setattr(importance, "CHUNK_BYTES", 400)
    assert tally() == whole
    assert whole == [Counter(zlib.crc32(f.encode()) % 10000 for f in _plain_features(t)[1]) for t in texts]


def _by_row(batch):
    out = [[np.zeros((3, 0), np.int64)] for _ in range(len(batch))]
    for rows, buckets, bounds in importance._chunks(batch):
        for i, row in enumerate(rows):
            out[row].append(buckets[:, bounds[i] : bounds[i + 1]])
    return [np.concatenate(x, axis=1) for x in out]


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    ids, bounds = rng.integers(1, 5, 400), np.array([0, 0, 150, 151, 400])
    order, deep, common = importance.suffix_order(ids, bounds)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    key = lambda i: (ids[i : min(i + 3, ends[i])].tolist() + [0, 0])[:3]
    assert [key(i) for i in order] == sorted(key(i) for i in range(400)) and sorted(order) == list(range(400))
    assert [list(x) for x in zip(*deep, strict=True)] == [key(i) for i in order]
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        assert c == next((k for k in range(3) if key(a)[k] != key(b)[k]), 3)
    assert np.array_equal(importance.suffix_order(ids + (1 << 22), bounds)[2] >= 1, common >= 1)


def test_crc_of_joined_bytes():
    parts = [b"", b"a", b" ", "é日".encode() * 9, b"0123456789" * 100]
    for a in parts:
        for b in parts:
            got = importance._joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), importance._shift_table(len(b)), np.zeros(1, np.int64))
            assert got[0] == zlib.crc32(a + b)


def _plain_audit(rows):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, lang, source in rows]
    seen = Counter((lang, w) for lang, _, ws in docs for w in set(ws))
    kept = defaultdict(list)
    for (lang, w), n in seen.items():
        if n >= 30:
            kept[lang].append(w)
    groups = defaultdict(Counter)
    for lang, source, ws in docs:
        groups[lang, source].update(w for w in ws if seen[lang, w] >= 30)
    langs = defaultdict(Counter)
    for (lang, _), c in groups.items():
        langs[lang].update(c)
    p = lambda c, w, v: 1 + 1000000000 * (c[w] + 5) // (c.total() + 5 * v)
    out = []
    for (lang, source), c in groups.items():
        v = len(kept[lang])
        pairs = [(sum(abs(p(c, w, v) - p(d, w, v)) for w in kept[lang]), other) for (of, other), d in groups.items() if of == lang and other != source]
        terms = [(p(c, w, v) - p(langs[lang], w, v), w) for w in c if p(c, w, v) > p(langs[lang], w, v)]
        for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, w, x, i + 1) for i, (x, w) in enumerate(found[:most])]
    return sorted(out)


def test_audit_is_what_loops_give(spark, odd):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcéßü日") for _ in range(4)) for _ in range(120)]
    more = [(i, " ".join(rng.choice(vocabulary[: 20 + 25 * (i % 5)]) for _ in range(60)) + " B1b", ["en", "de", None][i % 3], ["a", "b", "c", "d", None][i % 5], 0, 0, "x") for i in range(300)]
    docs = odd.union(spark.createDataFrame(more, SCHEMA))
    want = _plain_audit([r[1:4] for r in ODD + more])
    assert {x[2] for x in want} == {"pair", "term"} and max(x[5] for x in want) == 50
    for n in (1, 5):
        assert sorted(map(tuple, divergence.audit(docs.repartition(n)).collect())) == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_audit_over_many_shards_and_without_terms(spark, odd, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(20)), "en", f"s{i % 4}", 0, 0, "x") for i in range(160)]
    monkeypatch.setattr(divergence, "SHARD_BYTES", 1500)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == _plain_audit([r[1:4] for r in rows])
    got = divergence.audit(odd).collect()
    assert sorted(map(tuple, got)) == _plain_audit([r[1:4] for r in ODD]) and {(r.part, r.value) for r in got} == {("pair", 0)}


def test_terms_are_added_up_when_many_are_held(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.record_batch({"lang": ["en"] * 4, "source": ["a", "a", "b", "b"], "text": ["x y z x", "Y w", None, "x v u t s"]})
    found = sorted(tuple(r.values()) for b in divergence._count(iter([batch, batch])) for r in b.to_pylist())
    assert found == sorted([("en", "a", "x", 4, 2), ("en", "a", "y", 4, 4), ("en", "a", "z", 2, 2), ("en", "a", "w", 2, 2)] + [("en", "b", t, 2, 2) for t in "xvuts"])
