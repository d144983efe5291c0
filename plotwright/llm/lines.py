"""Line dedup by overlapping windows of three lines, in DataFrame operations alone.

Every three consecutive lines of a text are hashed. A window that occurs more than once stays where it comes
first, by (doc_id, position); at every other place its three lines are covered. Covered positions of a
document are merged, and the lines at them go. Texts under three lines have no window and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small, table

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """``(id, key, at, h1, h2)``: a 128-bit hash of each window; ``at`` counts lines from 0."""
    lines = F.split(F.col("text"), "\n", -1)
    n = F.greatest(F.size(lines) - (WINDOW - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(lines, i + 1, n).alias(f"l{i}") for i in range(WINDOW)])
    three = lambda z: [z.getField(f"l{i}") for i in range(WINDOW)]
    # the second hash begins with another value, so the two are independent
    hashed = F.transform(zipped, lambda z, i: F.struct(i.alias("at"), F.xxhash64(*three(z)).alias("h1"), F.xxhash64(F.lit("second"), *three(z)).alias("h2")))
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.inline(hashed))


def covered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, key, positions array<int>)`` of the documents that lose lines, one row each.

    ``key`` is the text's hash, so that different texts under one doc_id are told apart. Equal rows count as
    one document.
    """
    windows = scratch.save(_windows(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")), "windows")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "at")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    # at most a text's own number of lines
    return later.groupBy("id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + (WINDOW - 1)))))).alias("positions"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered lines gone from ``text``, and the columns ``n_lines`` and ``n_removed``.

    All rows and columns stay; columns of these two names are replaced. Null text stays null, with no lines. A
    text of which all lines go is empty. Rows without doc_id come after all others. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(covered(docs, scratch), "covered")
    # texts are shuffled only where the covered positions are too many to be sent to them
    found = small(found, 96, 8 * F.size("positions")).select(F.col("id").alias("__pw_id"), F.col("key").alias("__pw_key"), F.col("positions").alias("__pw_positions"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    body = F.col("text").cast("string")
    # the lines become a column below the join, so that no lambda above splits the text again for each of them
    rows = docs.select(*[F.col(c) for c in names if c != "text"], F.xxhash64(body).alias("__pw_text_key"), F.split(body, "\n", -1).alias("__pw_lines"))
    rows = rows.join(found, rows.doc_id.eqNullSafe(found["__pw_id"]) & (rows["__pw_text_key"] == found["__pw_key"]), "left")
    positions, lines = F.col("__pw_positions"), F.col("__pw_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
    kept = F.when(positions.isNull(), lines).otherwise(F.transform(left, lambda i: F.get(lines, i)))
    text = F.array_join(kept, "\n")
    count = lambda x: F.when(x.isNull(), 0).otherwise(F.size(x)).cast("long")
    return rows.select(*[text.alias("text") if c == "text" else rows[c] for c in names], count(lines).alias("n_lines"), count(positions).alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows of lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null
), windows as (
  select doc_id, pos, line as a, lead(line, 1) over w as b, lead(line, 2) over w as c from lines
  window w as (partition by doc_id order by pos)
), marked as (
  select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as n from windows where c is not null
), gone as (
  select distinct doc_id, pos + i as pos from marked, (values (0), (1), (2)) t(i) where n > 1
)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines,
  coalesce(g.n, 0) as n_removed, case when d.text is null then null else coalesce(k.text, '') end as text
from documents d
left join (select doc_id, count(*) as n from gone group by doc_id) g on g.doc_id = d.doc_id
left join (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text from lines l
  left join gone x on x.doc_id = l.doc_id and x.pos = l.pos where x.pos is null group by l.doc_id) k on k.doc_id = d.doc_id
"""
