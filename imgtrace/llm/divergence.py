"""How far the sources of a language differ in their words, by DuckDB over hashed shards.

Tasks count their documents' terms in DuckDB and send the counts to shards by a hash of language and term. A shard's task
takes these in a stream, adds them up in DuckDB, and keeps the terms that enough documents of the language have, a row
each with the counts of its sources. Spark sums the sizes of sources and languages over shards. In a second round every
shard gets these sums with its terms, and DuckDB gives partial sums of all pairs of sources and the shard's highest terms
of each source; Spark adds up the sums and ranks.

A source without a term has the same probability for each term that it lacks, so a shard only goes through the occurrences
of its terms and corrects what two sources differ by where neither has the term; Spark adds that for the whole language.
A term that all documents have weighs one row a source in its shard.

Defined results: null text, lang and source are ''; repeated rows count as often as they occur; a language without kept
terms has pairs of value 0 and no terms; a language with one source has no pairs; ties go by item; a very long text is one
list of terms in its task; an empty table gives no rows; other columns are not read, so none can clash. All arithmetic is
in whole numbers (128 bits for products).
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.llm.common import materialize, pieces_of

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Bytes of text a shard, and rows that a task's DuckDB holds before it adds them up.
SHARD_BYTES = 16 << 20
HELD = 1_000_000
#: Parts of a shard in the second round, so that its tasks are many and even.
PARTS = 8
#: Shards whose highest terms are merged first, before all of them are.
MERGED = 64
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
PARTIAL = "lang string, source string, term string, n long, docs long"
ROWS_OUT = 50_000


def _duck() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": "", "preserve_insertion_order": False})


def _run(con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    return con.execute(sql).fetchall()


def _summed(con: duckdb.DuckDBPyConnection) -> None:
    _run(con, "CREATE OR REPLACE TABLE partial AS SELECT lang, source, term, sum(n)::bigint AS n, sum(docs)::bigint AS docs FROM partial GROUP BY ALL")


def _add(con: duckdb.DuckDBPyConnection, rows: str, held: int) -> int:
    """Inserts rows, adds up what is held once it has doubled since the last time, and returns that limit."""
    count = lambda: _run(con, "SELECT count(*) FROM partial")[0][0]
    _run(con, f"INSERT INTO partial {rows}")
    if count() > held:
        _summed(con)
        held = max(HELD, 2 * count())
    return held


_NEW = "CREATE TABLE partial (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con, held = _duck(), HELD
    _run(con, _NEW)
    for batch in batches:
        for piece in pieces_of(batch):
            con.register("docs", pa.Table.from_batches([piece]))
            words = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term"
            each = f"SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, {words} FROM (SELECT row_number() OVER () AS r, * FROM docs)) GROUP BY ALL"
            held = _add(con, f"SELECT lang, source, term, sum(n), count(*) FROM ({each}) GROUP BY ALL", held)
            con.unregister("docs")
    _summed(con)
    yield from con.sql("SELECT * FROM partial").to_arrow_reader(ROWS_OUT)
    con.close()


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con, held = _duck(), HELD
    _run(con, _NEW)
    shard = None
    for batch in batches:
        if batch.num_rows:
            shard = batch.column(batch.schema.get_field_index("shard"))[0].as_py()
            con.register("rows_in", pa.Table.from_batches([batch]))
            held = _add(con, "SELECT lang, source, term, n, docs FROM rows_in", held)
            con.unregister("rows_in")
    if shard is not None:
        _summed(con)
        lists = "list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts"
        yield from con.sql(f"SELECT {shard}::integer AS shard, lang, term, {lists} FROM partial GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}").to_arrow_reader(ROWS_OUT)
    con.close()


def kept_terms(docs: DataFrame) -> tuple[DataFrame, int]:
    """shard, lang, term, and its sources with their counts (not 0), of the terms in MIN_DOCS documents of a language and more; and the number of shards."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(*_group(), text.alias("text"))
    shards = max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES))
    partial = source.mapInArrow(_count, PARTIAL).withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    return partial.repartitionById(shards, "shard").mapInArrow(_keep, "shard int, lang string, term string, sources array<string>, counts array<long>"), shards


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), lang_n (the language's) and v (its kept terms) of every group."""
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    per_source = each.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    every = docs.select(*_group()).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left").select("lang", "source", zero("n"), zero("lang_n"), zero("v"))


_PART = "shard int, lang string, source string, part string, item string, value long, lone long"


def _compare(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """A shard's part of the sums of pairs, over its terms that the source has (lone: and the item lacks), and its highest terms."""
    con = _duck()
    shard = (terms if terms.num_rows else groups)["shard"][0].as_py()
    con.register("terms", terms)
    con.register("groups", groups)
    p = lambda n, total: f"(1 + ({SCALE}::hugeint * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING} * v))::bigint"
    _run(con, f"CREATE TABLE g AS SELECT *, {p(0, 'n')} AS p0 FROM groups WHERE v > 0")
    _run(con, "CREATE TABLE c AS SELECT lang, term, list_sum(counts) AS term_n, unnest(sources) AS source, unnest(counts) AS k FROM terms")
    _run(con, f"CREATE TABLE o AS SELECT c.lang, c.term, c.source, p0, {p('k', 'n')} AS p, {p('term_n', 'lang_n')} AS q FROM c JOIN g USING (lang, source)")
    return con.sql(f"""
        WITH pairs AS (
          SELECT o.lang, o.source, g.source AS item, abs(o.p - coalesce(other.p, g.p0)) - abs(o.p0 - g.p0) AS x, other.p IS NULL AS lacks
          FROM o JOIN g ON g.lang = o.lang AND g.source <> o.source LEFT JOIN o AS other ON other.lang = o.lang AND other.term = o.term AND other.source = g.source)
        SELECT {shard}::integer AS shard, lang, source, 'pair' AS part, item, sum(x)::bigint AS value, coalesce(sum(x) FILTER (WHERE lacks), 0)::bigint AS lone FROM pairs GROUP BY ALL
        UNION ALL
        SELECT {shard}::integer, lang, source, 'term', term, p - q, 0 FROM o WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {TOP}
    """).to_arrow_table()


def _rank(rows: DataFrame, *within: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", *within).orderBy(F.desc("value"), "item")))


def _pairs(compared: DataFrame, groups: DataFrame) -> DataFrame:
    """Every source with each other one of its language: what all terms give if neither has any, and the shards' corrections."""
    p0 = F.when(F.col("v") > 0, 1 + F.call_function("div", F.lit(SCALE * SMOOTHING), F.greatest(F.col("n") + SMOOTHING * F.col("v"), F.lit(1).cast("long"))))
    own = groups.select("lang", "source", "v", p0.alias("p0"))
    others = own.select("lang", F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    apart = F.coalesce(F.col("v") * F.abs(F.col("p0") - F.col("other_p0")), F.lit(0)).cast("long")
    bare = own.join(others, "lang").where("source <> item").select("lang", "source", "item", apart.alias("value"))
    mine = compared.where("part = 'pair'").select("lang", "source", "item", "value")
    lone = compared.where("part = 'pair'").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("lone").alias("value"))
    return bare.union(mine).union(lone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: how far a source is from the others of its language ('pair'), and the terms
    that it has more often than the language has ('term', the first TOP)."""
    kept, shards = kept_terms(docs)
    kept = materialize(kept)
    groups = materialize(sizes(docs, kept))
    part = F.pmod(F.xxhash64(F.lit("part"), "lang", "term"), F.lit(PARTS)).cast("int")
    kept = kept.withColumn("shard", F.col("shard") * PARTS + part)
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards * PARTS - 1))))
    compared = materialize(kept.groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInArrow(_compare, _PART))
    terms = compared.where("part = 'term'").withColumn("merged", F.pmod("shard", F.lit(MERGED)))
    highest = _rank(terms, "merged").where(F.col("rank") <= TOP).drop("rank")
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = _rank(_pairs(compared, groups)).withColumn("part", F.lit("pair"))
    return pairs.select(*columns).union(_rank(highest).where(F.col("rank") <= TOP).select(*columns))


#: The same in SQL, for every pair of sources over all kept terms.
SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
counted AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM texts) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS lang_n FROM kept GROUP BY lang),
own AS (SELECT c.lang, c.source, term, sum(c.n) AS k FROM counted c JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(k), 0) AS n FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source GROUP BY ALL),
every AS MATERIALIZED (
  SELECT g.lang, g.source, t.term, coalesce(k, 0) AS k,
    1 + ({SCALE}::hugeint * (coalesce(k, 0)::hugeint + {SMOOTHING})) // (g.n::hugeint + {SMOOTHING} * v) AS p,
    1 + ({SCALE}::hugeint * (t.n::hugeint + {SMOOTHING})) // (lang_n::hugeint + {SMOOTHING} * v) AS q
  FROM groups g JOIN kept t USING (lang) JOIN langs USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = t.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::bigint FROM every WHERE k > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::integer AS rank FROM found) WHERE part = 'pair' OR rank <= {TOP}
"""
