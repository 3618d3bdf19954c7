"""Line-run deduplication over a suffix array of line IDs built by prefix doubling.

Every non-blank line is a symbol (a hash of the trimmed line).  A round of
prefix doubling gives each suffix the rank of its first 2h lines from the ranks
of its first h lines and of the h lines after them; equal ranks form an interval
of suffixes with a common prefix of at least 2h lines.  Suffixes alone in their
interval are finished and leave the job, so each round works only on what still
repeats.  The first member of an interval in (doc_id, line) order is the
original.  Intervals on the same diagonal (document, original, shift) join into
maximal repeated runs, and lines of later copies are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, column, cut, table

#: (doc_id, hash of the text): rows that share both are one document
KEY = ["__d", "__t"]


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__t": F.xxhash64(text)})


def line_suffixes(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each non-blank line: key, seq (number among them), line_no, two-part rank, long."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.btrim(x, F.lit(" \t\r")).alias("line")))
    rows = docs.filter("text is not null").select(*KEY, F.posexplode(F.filter(lines, lambda x: x["line"] != "")).alias("seq", "x"))
    return rows.select(
        *KEY,
        "seq",
        F.col("x.no").alias("line_no"),
        F.xxhash64("x.line").alias("rank"),
        F.hash("x.line").alias("rank2"),
        (F.length("x.line") >= min_chars).alias("long"),
    )


def _intervals(suffixes: DataFrame) -> DataFrame:
    """The suffixes that share their rank with another one; `first` is the place of the
    interval's first member, `earlier` whether that is before this one."""
    place = F.struct(*KEY, "seq")
    shared = suffixes.groupBy("rank", "rank2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    # cut, so that the join deals its rows out itself and a line that is everywhere can be split
    shared = cut(shared)
    return suffixes.join(shared, ["rank", "rank2"]).withColumn("earlier", F.col("first") < place)


def _longer(level: DataFrame, by: int) -> DataFrame:
    """Suffixes ranked by their own rank and by that of the suffix `by` lines on, if it repeats as well."""
    ahead = Window.partitionBy(*KEY).orderBy("seq").rangeBetween(by, by)
    both = level.select(*KEY, "seq", "rank", "rank2", F.max("rank").over(ahead).alias("next"), F.max("rank2").over(ahead).alias("next2"))
    return both.filter("next is not null").select(*KEY, "seq", F.xxhash64("rank", "next").alias("rank"), F.hash("rank2", "next2").alias("rank2"))


def repeated_runs(docs: DataFrame, min_lines: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(lines to delete: key, seq, line_no; maximal repeated runs: key, seq, n_lines, and
    d, t, original_seq of the first occurrence).  `docs` comes from with_key().

    A suffix is aligned with the first occurrence of its longest prefix of 1, 2, 4, ...
    lines that occurs earlier; such stretches at the same shift from the same document
    join into one run, so a run is as long as that alignment goes on.
    """
    if min_lines < 1:
        raise ValueError("a run has one line at least")
    lines = cut(_intervals(line_suffixes(docs, min_chars)))
    hits, found = [lines.filter("earlier and long").select(*KEY, "seq")], []
    level, h = lines, 1
    while True:
        found.append(level.filter("earlier").select(*KEY, "seq", F.lit(h).alias("h"), "first"))
        if h <= min_lines < 2 * h:  # prefixes of exactly min_lines lines: two of h lines that overlap
            exact = level if h == min_lines else _intervals(_longer(level, min_lines - h))
            at = exact.filter("earlier").select(*KEY, F.explode(F.sequence("seq", F.col("seq") + (min_lines - 1))).alias("seq"))
            hits.append(at)
        level, h = cut(_intervals(_longer(level, h))), 2 * h
        if level.isEmpty():
            break
    marked, all_ = hits[0], found[0]
    for more in hits[1:]:
        marked = marked.union(more)
    for more in found[1:]:
        all_ = all_.union(more)
    delete = lines.join(marked.distinct(), [*KEY, "seq"], "left_semi").select(*KEY, "seq", "line_no").distinct()
    return delete, _runs(all_)


def _runs(found: DataFrame) -> DataFrame:
    best = found.groupBy(*KEY, "seq").agg(F.max(F.struct("h", "first")).alias("m")).select(
        *KEY, "seq", (F.col("seq") + F.col("m.h")).alias("end"), F.col("m.first.__d").alias("d"), F.col("m.first.__t").alias("t"),
        (F.col("seq") - F.col("m.first.seq")).alias("shift"),
    )
    diagonal = [*KEY, "d", "t", "shift"]
    before = Window.partitionBy(*diagonal).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parted = best.withColumn("new", F.coalesce(F.col("seq") > F.max("end").over(before), F.lit(True)).cast("int"))
    numbered = parted.withColumn("run", F.sum("new").over(Window.partitionBy(*diagonal).orderBy("seq")))
    runs = numbered.groupBy(*diagonal, "run").agg(F.min("seq").alias("seq"), F.max("end").alias("end"))
    return runs.select(*KEY, "seq", (F.col("end") - F.col("seq")).alias("n_lines"), "d", "t", (F.col("seq") - F.col("shift")).alias("original_seq"))


def deduplicate_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 60) -> DataFrame:
    """All columns and rows of docs with later copies of repeated line runs deleted
    from `text`, and __removed: array of the (seq, line_no) deleted, __n_lines: how many
    lines the text had, __longest: lines in its longest run that occurs earlier.

    A run counts if it has at least `min_lines` lines, or is one line of at least
    `min_chars` characters.  The copy with the smallest (doc_id, text hash, line)
    stays; copies inside one document count too.  Lines are compared without
    spaces, tabs and carriage returns at their ends; blank lines are no part of a
    run and stay.  A null text stays null and has no lines, a null doc_id counts as
    the smallest, rows equal in doc_id and text are one document and get the same
    result.  A document may end up with an empty text.
    """
    delete, runs = repeated_runs(with_key(docs), min_lines, min_chars)
    gone = delete.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("seq", "line_no"))).alias("__removed"))
    longest = runs.groupBy(*KEY).agg(F.max("n_lines").alias("__longest"))
    # split before the join: behind it the lines are a column and not split again for each line
    named = with_key(docs).withColumn("__lines", F.split(F.col("text").cast("string"), "\n")).drop("text")
    joined = named.join(longest.join(gone, KEY, "left"), KEY, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed.line_no"))
    text = F.when(F.col("__removed").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return joined.select(
        *(text.alias("text") if c == "text" else column(c) for c in docs.columns),
        "__removed",
        F.greatest(F.coalesce(F.size("__lines"), F.lit(0)), F.lit(0)).alias("__n_lines"),
        F.coalesce("__longest", F.lit(0)).alias("__longest"),
    )


def line_report(docs: DataFrame, min_lines: int = 2, min_chars: int = 60) -> DataFrame:
    """doc_id, n_lines (all lines; a null text has the one of an empty text), n_removed,
    n_runs (stretches of neighbouring deleted lines), longest_run (lines of the longest
    run that occurs earlier) and kept_sha256 of the text that stays, for each row of docs."""
    out = deduplicate_lines(docs.select("doc_id", "text"), min_lines, min_chars)
    gone = F.coalesce("__removed", F.array().cast("array<struct<seq:int,line_no:int>>"))
    starts = F.size(F.filter(gone, lambda x, i: (i == 0) | (F.element_at(gone, F.greatest(i, F.lit(1)))["seq"] != x["seq"] - 1)))
    return out.select(
        "doc_id",
        F.greatest("__n_lines", F.lit(1)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        starts.cast("long").alias("n_runs"),
        F.col("__longest").cast("long").alias("longest_run"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of line_report()."""
    return line_report(table(spark, sf_dir, "documents"))


#: ids are unique in these tables, so (doc_id, line) orders the copies
OP2_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM (
    SELECT doc_id, unnest(range(len(parts))) AS line_no, trim(unnest(parts), ' ' || chr(9) || chr(13)) AS line FROM split
  ) WHERE line <> ''
), pairs AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS following FROM lines
), judged AS (
  SELECT doc_id, line_no, seq, length(line) >= 60 AND (doc_id, seq) > min((doc_id, seq)) OVER (PARTITION BY line) AS single,
    following IS NOT NULL AND (doc_id, seq) > min((doc_id, seq)) OVER (PARTITION BY line, following) AS pair
  FROM pairs
), marked AS (
  SELECT doc_id, line_no, seq, single OR pair OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY seq), false) AS gone FROM judged
), gone AS (
  SELECT doc_id, line_no, seq, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM marked WHERE gone
), counts AS (
  SELECT doc_id, count(*) AS n_removed, count(DISTINCT island) AS n_runs FROM gone GROUP BY 1
), kept AS (
  SELECT s.doc_id, string_agg(s.part, chr(10) ORDER BY s.line_no) AS text FROM (
    SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS part FROM split
  ) s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.line_no = g.line_no GROUP BY 1
), levels(h, doc_id, seq, r) AS (
  SELECT 1, doc_id, seq, md5(line) FROM lines QUALIFY count(*) OVER (PARTITION BY line) > 1
  UNION ALL
  SELECT 2 * a.h, a.doc_id, a.seq, md5(a.r || b.r) FROM levels a JOIN levels b ON b.doc_id = a.doc_id AND b.seq = a.seq + a.h
  QUALIFY count(*) OVER (PARTITION BY md5(a.r || b.r)) > 1
), placed AS (
  SELECT *, first_value(doc_id) OVER w AS d, first_value(seq) OVER w AS s FROM levels WINDOW w AS (PARTITION BY h, r ORDER BY doc_id, seq)
), best AS (
  SELECT doc_id, seq, seq + max(h) AS upto, arg_max(d, h) AS d, seq - arg_max(s, h) AS shift FROM placed WHERE (doc_id, seq) > (d, s) GROUP BY doc_id, seq
), parted AS (
  SELECT *, coalesce(seq > max(upto) OVER (PARTITION BY doc_id, d, shift ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM best
), numbered AS (
  SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, d, shift ORDER BY seq) AS run FROM parted
), longest AS (
  SELECT doc_id, max(n) AS n FROM (SELECT doc_id, max(upto) - min(seq) AS n FROM numbered GROUP BY doc_id, d, shift, run) GROUP BY doc_id
)
SELECT s.doc_id, len(s.parts)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
  coalesce(c.n_runs, 0)::BIGINT AS n_runs, coalesce(l.n, 0)::BIGINT AS longest_run, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN counts c ON s.doc_id = c.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id LEFT JOIN longest l ON s.doc_id = l.doc_id
"""
