"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.store import cut  # noqa: F401

#: stands for a missing doc_id in keys: smaller than every real id
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name for select() and expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text only: null ids become NULL_ID, null texts the empty text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def id_back(column: str = "doc_id"):
    """Undo the null replacement of keyed()."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def tree_depth(partitions: int) -> int:
    """The depth for treeAggregate() at which each level has about a quarter of the partitions of
    the one before, so that the driver merges a handful of partial results for any input."""
    return max(2, math.ceil(math.log2(max(partitions, 2)) / 2))


def text_slices(texts: pa.Array, limit: int) -> Iterator[slice]:
    """Neighbouring rows of an Arrow column with up to `limit` bytes together, one row at least."""
    import pyarrow.compute

    lengths = pyarrow.compute.fill_null(pyarrow.compute.binary_length(texts), 0).to_pylist()
    at, size = 0, 0
    for i, n in enumerate(lengths):
        if i > at and size + n > limit:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield slice(at, len(lengths))


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list], dict[str, list]]],
    schema: str,
    keep: list[str] | None = None,
    text: str = "text",
    slice_chars: int = 4_000_000,
) -> DataFrame:
    """Run a function over whole texts in slices of each Arrow batch that are bounded by bytes.

    `make()` is called once a task and returns a function from a list of texts
    (null: empty) to a dict of columns.  The columns in `keep` pass through.
    """
    keep = keep if keep is not None else ["doc_id"]
    made_fields = StructType.fromDDL(schema).fields
    names = [f.name for f in made_fields]
    own = keep.index(text) if text in keep and docs.schema[text].dataType.simpleString() == "string" else len(keep)
    # kept columns pass under names of our own: mapInArrow() reads names as expressions
    inner = [f"__keep{i}" for i in range(len(keep))]
    typed = StructType([StructField(n, docs.schema[c].dataType) for n, c in zip(inner, keep)] + made_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in text_slices(batch.column(own), slice_chars):
                rows = batch.slice(part.start, part.stop - part.start)
                made = apply([x or "" for x in rows.column(own).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: len(keep)], *(pa.array(made[n]) for n in names)], names=[*inner, *names]
                )

    more = [column(text).cast("string").alias("__text")] if own == len(keep) else []
    out = docs.select(*(column(c).alias(n) for c, n in zip(keep, inner)), *more).mapInArrow(run, typed)
    return out.select(*(F.col(n).alias(c) for n, c in zip(inner, keep)), *names)
