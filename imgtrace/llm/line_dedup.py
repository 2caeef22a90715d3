"""Line dedup: passages of three lines and more that occur before are removed.

A document's lines with a word, trimmed of white space, give overlapping windows of three consecutive ones. Windows are
compared by 128 bits of hash over the whole table. The first occurrence of a repeated window, by doc_id and then place,
stays; later ones are removed, and as neighbouring windows overlap, their places merge into whole passages. Counting
pre-aggregates, so a window that a third of all documents holds is a few rows by the time it is shuffled; where its
occurrences meet the first one, the join has one row on that side, and adaptive execution may split the other.

Defined results: null text is empty; documents of fewer than three lines with a word have no window and stay as they are;
lines without a word are never removed; repeated rows (same doc_id and text) are occurrences of the same place, so they
do not remove each other; rows of one doc_id and different texts are ordered by a hash of the text (the tie-break between
them); a null doc_id comes first; an empty table gives no rows; a very long text is one row, cut like any other; columns
of the table whose names are used here do not clash, as rows travel in a struct. A run of equal lines overlaps itself, so
its first line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import text_or_empty

SPACES = " \t\n\x0b\x0c\r"
LINES = 3


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def windows(docs: DataFrame) -> DataFrame:
    """A row for each window: doc_id, text_key, the place of its first line among those with a word, and its hash as two longs."""
    with_word = F.filter(F.transform(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES))), lambda line: line != "")
    n = F.size("lines")
    at = lambda i, k: F.get("lines", i + k)

    def window(i: Column) -> Column:
        three = [at(i, k) for k in range(LINES)]
        return F.struct(i.alias("place"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("window"), *three).alias("h2"))

    lines = _keyed(docs).select("doc_id", "text_key", with_word.alias("lines")).where(n >= LINES)
    found = lines.select("doc_id", "text_key", F.explode(F.transform(F.sequence(F.lit(0), n - LINES), window)).alias("w"))
    return found.select("doc_id", "text_key", "w.*")


def later_places(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and places (array of the windows that occur before) of the documents that have any."""
    every = windows(docs)
    occurrence = F.struct("doc_id", "text_key", "place")
    firsts = every.groupBy("h1", "h2").agg(F.min(occurrence).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = every.join(firsts, ["h1", "h2"]).where(occurrence > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def _marked(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, text, n_lines, n_removed, n_passages and kept (the text that stays) of every document.

    Lines with a word are counted before the join; arrays of lines are made only of the few documents that lose any. The
    join builds its table from the places, so texts are streamed past it and never sorted.
    """
    found = later_places(docs).select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key"), "places").hint("shuffle_hash")
    text = text_or_empty()
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    keyed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), n_lines.cast("long").alias("n_lines"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_key")), "left")
    hit = F.col("places").isNotNull()
    split = joined.select("row", "doc_id", "text", "n_lines", "places", F.when(hit, F.split("text", "\n")).alias("lines")).withColumn(
        "worded", F.filter(F.transform("lines", lambda line, i: F.struct(F.btrim(line, F.lit(SPACES)).alias("t"), i.alias("i"))), lambda x: x.t != "")
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + LINES - 1)))))
    marked = split.withColumn("covered", covered)
    # Ordinals among lines with a word become places among all lines.
    gone = marked.withColumn("gone", F.transform("covered", lambda c: F.get("worded", c).i))
    n = F.size("covered")
    gaps = F.zip_with(F.slice("covered", F.lit(2), n - 1), F.slice("covered", F.lit(1), n - 1), lambda b, a: b - a)
    kept = F.array_join(F.transform(_kept_runs(), lambda r: F.array_join(F.slice("lines", r.start + 1, r.n), "\n")), "\n")
    return gone.select(
        "row",
        "doc_id",
        "text",
        "n_lines",
        F.when(hit, n).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, F.size(F.filter(gaps, lambda gap: gap > 1)) + 1).otherwise(0).cast("long").alias("n_passages"),
        F.when(hit, kept).otherwise(F.col("text")).alias("kept"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (what stays), n_lines (with a word), n_removed and n_passages (maximal removed runs) of every document."""
    return _marked(docs, F.lit(None)).select("doc_id", F.col("kept").alias("text"), "n_lines", "n_removed", "n_passages")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with repeated passages removed from `text`; those that lose all their lines go.

    Null texts stay null, and n_chars, where there is such a column, follows a changed text.
    """
    out = _marked(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept")} | ({"n_chars": F.char_length("kept")} if "n_chars" in docs.columns else {})
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    column = lambda c: F.col(f"row.`{c}`")
    return kept.select(*(F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(column(c)).alias(c) if c in new else column(c).alias(c) for c in docs.columns))


def _kept_runs() -> Column:
    """(start, n) of the runs of lines between those that are gone, without empty runs."""
    before = F.concat(F.array(F.lit(-1)), F.col("gone"))
    after = F.concat(F.col("gone"), F.array(F.size("lines")))
    return F.filter(F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n"))), lambda r: r.n > 0)


SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), worded as (
    select doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t,
           row_number() over (partition by doc_id order by pos) as k
    from lines where trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), grams as (
    select a.doc_id, a.k, a.t || chr(10) || b.t || chr(10) || c.t as gram
    from worded a join worded b on b.doc_id = a.doc_id and b.k = a.k + 1 join worded c on c.doc_id = a.doc_id and c.k = a.k + 2
), ranked as (
    select doc_id, k, row_number() over (partition by gram order by doc_id, k) as nth from grams
), gone as (
    select distinct r.doc_id, w.k, w.pos from ranked r join worded w on w.doc_id = r.doc_id and w.k between r.k and r.k + 2 where r.nth > 1
), runs as (
    select doc_id, k, case when lag(k) over (partition by doc_id order by k) = k - 1 then 0 else 1 end as new_run from gone
), counted as (
    select doc_id, count(*) as n_removed, sum(new_run) as n_passages from runs group by doc_id
), kept as (
    select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text
    from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos where g.pos is null group by l.doc_id
)
select d.doc_id, (select count(*) from worded w where w.doc_id = d.doc_id) as n_lines, coalesce(c.n_removed, 0) as n_removed,
       coalesce(c.n_passages, 0)::bigint as n_passages, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join counted c on c.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""
