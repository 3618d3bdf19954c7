"""Quality rules and hashed n-gram importance, in DataFrame functions only.

The method compares two multinomials over hashed word uni- and bigrams, one of
a trusted target set and one of the raw corpus.  A document's score is the mean
log ratio of its n-grams; documents below a quantile of the trusted documents'
own scores are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"


def _word_columns(docs: DataFrame) -> DataFrame:
    """Adds __text, __words and __h, a hash of each word."""
    docs = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.withColumn("__words", F.array_remove(F.split("__text", SPACE_RUN), ""))
    return docs.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))


def _windows(width: int) -> Column:
    """A hash of every `width` neighbouring words."""
    n = F.size("__h")
    at = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get("__h", i + k) for k in range(width))))


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds __repeat: words inside a 3-word window that the text has twice or more."""
    docs = docs.withColumn("__tri", _windows(3))
    docs = docs.withColumn("__some", F.size("__tri") > F.size(F.array_distinct("__tri")))
    sorted_ = F.array_sort(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("__tri", F.when(F.col("__some"), sorted_))

    def twice(x, i):
        return (F.get("__tri", i - 1)["h"] == x["h"]) | (F.get("__tri", i + 1)["h"] == x["h"])

    def both(x, i):
        return F.coalesce(twice(x, i), F.get("__tri", i - 1)["h"] == x["h"], F.get("__tri", i + 1)["h"] == x["h"], F.lit(False))

    docs = docs.withColumn("__at", F.sort_array(F.transform(F.filter("__tri", both), lambda x: x["i"])))
    # each window adds the words up to the next one, three at most
    step = F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - p, F.lit(3))))
    return docs.withColumn("__repeat", F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def _lines_repeated() -> Column:
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as empty: no words, and base_failed.  Windows of one text are told
    apart by 64-bit hashes: of a million windows two collide once in 30 million texts.
    Repeated rows give repeated results; extra columns stay.
    """
    words = F.col("n_words")
    out = _repeat_words(_word_columns(docs))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": _lines_repeated(),
            "n_repeat_words": F.col("__repeat"),
        }
    )
    return out.withColumn("base_failed", (words < 50) | (100 * F.col("n_repeat_words") > 50 * words))


def _grams(buckets: int) -> Column:
    """The bucket of every word and of every pair of neighbouring words."""
    return F.transform(F.concat("__h", _windows(2)), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = 10_000, smoothing: float = 1.0) -> DataFrame:
    """One row: weights, the log ratio of target to raw probability of each bucket.

    Counts cover all documents.  `trusted` has the distinct doc_id of the target.
    """
    # the labels grow with the documents: never broadcast, whatever their size here
    marked = docs.join(trusted.withColumn("__target", F.lit(1)).hint("merge"), "doc_id", "left")
    grams = _word_columns(marked.select("doc_id", "text", "__target")).select("__target", F.explode(_grams(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__target").alias("target"))
    whole = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = whole.join(counts, "bucket", "left").na.fill(0)
    # as many rows as buckets from here on
    one = counts.agg(
        F.sum("raw").alias("r"),
        F.sum("target").alias("t"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"),
    )
    part = lambda n, total: F.log((n + smoothing) / (total + smoothing * buckets))
    ratio = F.transform("c", lambda x: part(x["target"], F.col("t")) - part(x["raw"], F.col("r")))
    # without any trusted text every ratio is 0 and nothing is rejected
    return one.select(F.when(F.col("t") > 0, ratio).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("weights"))


def scored(docs: DataFrame, weights: DataFrame, buckets: int = 10_000) -> DataFrame:
    """docs with the base columns and `score`: the mean log ratio of a text's n-grams, 0 for no words."""
    out = base_rules(docs).withColumns({"__w": weights.select("weights").scalar(), "__g": _grams(buckets)})
    total = F.aggregate("__g", F.lit(0.0), lambda a, b: a + F.get("__w", b))
    return out.withColumn("score", F.when(F.size("__g") > 0, total / F.size("__g")).otherwise(0.0))


def low_quantile(scores: DataFrame, share: float, steps: int = 10_000) -> DataFrame:
    """One row: threshold, the score (in 1/steps) below which at most `share` of the rows lie.

    Works on a histogram, whose size depends on the range of scores alone.
    """
    from pyspark.sql import Window

    bins = scores.groupBy(F.floor(F.col("score") * steps).alias("bin")).agg(F.count("*").alias("n"))
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = bins.select("bin", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("below"), F.sum("n").over(whole).alias("all"))
    return below.filter(F.col("below") <= share * F.col("all")).agg((F.max("bin") / steps).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, share: float = 0.01, buckets: int = 10_000) -> DataFrame:
    """doc_id, the base columns, score and kept for each row of docs.

    The target are documents with quality 1 in `labels`; the threshold is the
    score that `share` of the target documents stay below.  Null texts have no
    words and fail the base rules.  A null doc_id has no label.  Repeated rows
    count and are judged as often as they occur.  Without labels every document
    that passes the base rules is kept.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    weights = cut(log_ratios(source, trusted, buckets))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    rows = cut(scored(source, weights, buckets).select(*columns))
    known = rows.filter(~F.col("base_failed")).join(trusted, "doc_id", "left_semi")
    limit = F.coalesce(low_quantile(known, share).scalar(), F.lit(float("-inf")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= limit))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of judge()."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
