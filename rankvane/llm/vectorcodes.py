"""Product quantisation of vectors in exact integers.

Vectors become columnar blocks: for each component one row of 32-bit integers.  Every
round is one RDD treeAggregate over those blocks.  A task adds up the distances of a
tile of vectors to a part's codebook component by component, takes the nearest entries
and adds its vectors to int64 tensors of sums and counts with np.add.at; the tensors
(their size depends on the codebooks alone) merge through the reduction tree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import column, cut, table, tree_depth

PARTS, ENTRIES, SCALE = 4, 256, 1024
#: vectors whose distances to a codebook are held at once, so that they stay in the processor's cache
TILE = 128
#: integers in a block
BLOCK = 1 << 20
#: labels whose sums are broadcast; more of them are joined by shuffle
FEW_LABELS = 10_000


def usable(vector: Column) -> Column:
    """Not null, and neither null nor non-finite in any component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(ok, F.lit(False))


def bound_of(dim: int) -> int:
    """The largest absolute value of a component for which sums of squares fit in 63 bits."""
    return min(2**31 - 1, math.isqrt(2**62 // max(dim, 1)) // 2)


def integers(x: np.ndarray, dim: int) -> np.ndarray:
    """floor(1024 * x), at most bound_of(dim) away from zero."""
    return np.clip(np.floor(SCALE * x.astype(np.float64)), -bound_of(dim), bound_of(dim)).astype(np.int32)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each vector of a part: x[component, vector] and
    book[component, entry]; of equal distances the lower entry."""
    width, n = x.shape
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.int32 if reach * reach * max(width, 1) < 2**31 else np.int64
    x, book = x.astype(kind, copy=False), book.astype(kind)
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    for at in range(0, n, TILE):
        tile = x[:, at : at + TILE]
        total = np.zeros((tile.shape[1], book.shape[1]), kind)
        step = np.empty_like(total)
        for mine, theirs in zip(tile, book):
            np.subtract(mine[:, None], theirs[None, :], out=step)
            np.multiply(step, step, out=step)
            total += step
        best = total.argmin(axis=1)
        code[at : at + TILE] = best
        error[at : at + TILE] = total[np.arange(len(best)), best]
    return code, error


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks [part, component, entry] after one round over all blocks."""
    parts, width, entries = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def add(state, row):
        books = shared.value
        sums, counts = state or (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
        x = np.frombuffer(row[0], np.int32).reshape(parts, width, -1)
        for p in range(parts):
            code, _ = nearest(x[p], books[p])
            np.add.at(counts[p], code, 1)
            for d in range(width):
                np.add.at(sums[p, d], code, x[p, d])
        return sums, counts

    def merge(a, b):
        return a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1])

    rows = blocks.select("block").rdd
    state = rows.treeAggregate(None, add, merge, tree_depth(rows.getNumPartitions()))
    shared.unpersist()
    if state is None:
        return books
    sums, counts = state
    counts = counts[:, None, :]
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def compress_vectors(vectors: DataFrame, vector: str = "embedding", rounds: int = 4) -> DataFrame:
    """One row for each kept row of `vectors`: vec_id, label, code (two hex digits for each
    part), error, label_error (errors summed over the rows of an equal label, null labels
    together), codebooks_sha256.

    Rows go whose vector is null or holds a null or non-finite component.  The codebooks
    start from the rows of the 256 smallest vec_ids (nulls count as the largest; rows of
    one vec_id are ordered by their vectors, repeated rows fill several entries), and of
    all rows if they are fewer.  Equal distances go to the lower entry.  Vectors need the
    length of the one with the smallest vec_id, a multiple of 4; rows of other lengths
    stay, with null in code and error.  A component that is too large for exact 64-bit
    sums counts as the largest that isn't: 131072 at 64 components.  Without kept rows
    the result is empty.  A missing label column counts as null.
    """
    label = column("label") if "label" in vectors.columns else F.lit(None).cast("string")
    kept = vectors.select(column("vec_id").cast("long").alias("vec_id"), label.alias("label"), column(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    dim = len(first[0].v) if first else 0
    fits = (F.size("v") == dim) & F.lit(dim % PARTS == 0)
    seeds = [r.v for r in first if len(r.v) == dim]
    width = dim // PARTS
    per_block = max(1, BLOCK // max(dim, 1))
    schema = StructType(
        [StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(kept.schema["label"].dataType))] + StructType.fromDDL("block binary").fields
    )

    def to_blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                rows = batch.slice(at, per_block)
                n = rows.num_rows
                x = integers(rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, dim), dim)
                one = pa.array([0, n], pa.int32())
                lists = [pa.ListArray.from_arrays(one, rows.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], names=["ids", "labels", "block"])

    blocks = cut(kept.filter(fits).mapInArrow(to_blocks, schema))
    start = integers(np.array(seeds, np.float64).reshape(len(seeds), dim if dim % PARTS == 0 else 0), dim) if dim % PARTS == 0 else np.empty((0, 0), np.int32)
    books = np.ascontiguousarray(start.reshape(len(start), PARTS, -1 if start.size else 0).transpose(1, 2, 0)).astype(np.int64)
    for _ in range(rounds if start.size else 0):
        books = _round(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def assign(batches):
        books = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(k)[i].values for k in (0, 1))
                n = len(ids)
                x = np.frombuffer(batch.column(2)[i].as_py(), np.int32).reshape(PARTS, width, n)
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p in range(PARTS if width else 0):
                    code, far = nearest(x[p], books[p])
                    codes[:, p], error = code, error + far
                text = codes.tobytes().hex()
                size = 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[k : k + size] for k in range(0, len(text), size)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    kinds = StructType([StructField("vec_id", LongType()), StructField("label", kept.schema["label"].dataType)] + StructType.fromDDL("code string, error long").fields)
    other = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut(blocks.mapInArrow(assign, kinds).union(other))
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    few = sums.count() <= FEW_LABELS
    sums = sums.withColumnRenamed("label", "__label")
    # many labels meet the rows in a shuffle on both sides, whose large partitions Spark can split
    sums = F.broadcast(sums) if few else sums.hint("merge")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each kept row of embeddings, in the columns of compress_vectors() without the label."""
    return compress_vectors(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    """The same in DuckDB: distances to all entries of a part at once, the first least one."""
    width = "len(v) // 4"
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cuts AS (SELECT vec_id, label, p, v[p * {width} + 1 : (p + 1) * {width}] AS v FROM kept, range(4) AS parts(p))",
        "book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v AS c FROM cuts QUALIFY k < 256)",
    ]
    pairs = "SELECT vec_id, label, a.p, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cuts a JOIN book{r} b ON a.p = b.p"
    for r in range(4):
        steps += [
            f"near{r} AS (SELECT vec_id, p, v, arg_min(k, (d, k)) AS k FROM ({pairs.format(r=r)}) GROUP BY vec_id, p, v)",
            f"sums{r} AS (SELECT p, k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS s FROM (SELECT p, k, v, unnest(range(1, len(v) + 1)) AS i FROM near{r}) GROUP BY p, k, i)",
            f"mean{r} AS (SELECT p, k, list(s ORDER BY i) AS c FROM sums{r} GROUP BY p, k)",
            f"book{r + 1} AS (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.k = m.k)",
        ]
    return "WITH " + ", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps) + f""",
last AS (SELECT vec_id, label, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM ({pairs.format(r=4)}) GROUP BY vec_id, label, p),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


OP11_SQL = _sql()
