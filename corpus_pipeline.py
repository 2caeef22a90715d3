"""A training corpus from the table of documents, in five stages.

Each stage takes all that its predecessor kept, whole texts, and passes on all columns of its input; null texts count as
empty. Defined results: rows without words, with a null doc_id, or of a doc_id that comes more than once stay as long as
no stage's own rule drops them (line dedup: rows that lose all their lines; the n-gram join: rows linked to a smaller
doc_id), and packing gives each of them its pieces; an empty table gives no rows, and without labels no document is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from imgtrace.llm.common import forget, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep_harmless(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three lines and more that occur before are cut out; documents of nothing else go."""
    return line_dedup.remove_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id stays."""
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can't express a trained model or a tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, done = materialize(stage(spark, docs, sf_dir)), before
        if done is not None:
            forget(done)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
