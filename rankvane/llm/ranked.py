"""Ranked lexical search over sharded, compressed inverted lists.

A shard is a slice of a task's texts.  Its documents are sorted by doc_id, and for each
term it holds the positions in that order and the term's counts, as bytes of variable
length.  A query is answered document at a time: a heap merges the inverted lists of its
terms by position, a bounded heap keeps the best documents by score and then doc_id, and
the tasks' heaps are merged for each query at the end.

Terms whose largest scores together can't lift a document into the bounded heap don't
enter the merge; they are looked up in the documents that the others bring.  Such
documents can't be among the best, so the result is whole.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, id_back, keyed, table, text_slices

#: A-Z become a-z, other ASCII letters and digits and all bytes of other characters stay, the rest parts terms
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: characters of a text that are cut into terms at once
PIECE = 1_000_000


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    raw = text.encode().translate(_TERMS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of non-negative numbers, seven bits in each; how many bytes each number took)."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for shift in range(7, 64, 7):
        sizes += v >> np.uint64(shift) > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        more = np.where(sizes[some] > k + 1, np.uint8(128), np.uint8(0))
        out[ends[some] - sizes[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, sizes


def unpack(raw: np.ndarray) -> np.ndarray:
    """The numbers of pack()."""
    last = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else np.empty(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((raw & np.uint8(127)).astype(np.int64) << (7 * place), start) if len(start) else np.empty(0, np.int64)


class Shard:
    """An inverted index of some documents: `ids` and `sizes` (terms of each) by doc_id,
    `slot` of each term, and its postings."""

    columns = ("ids", "sizes", "terms", "ends", "postings")
    schema = ", ".join(f"{c} binary" for c in columns) + ", n_docs long, n_terms long"

    @staticmethod
    def build(ids: list[int], texts: list[str]) -> dict:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        order = sorted(range(len(ids)), key=ids.__getitem__)
        sizes, term, count = [], [], []
        for i in order:
            found: Counter = Counter()
            for words in terms_of(texts[i]):
                found.update(words)
            term.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            count.append(np.fromiter(found.values(), np.int64, len(found)))
            sizes.append(int(count[-1].sum()))
        place = np.repeat(np.arange(len(order)), [len(t) for t in term])
        term, count = np.concatenate(term), np.concatenate(count)
        by = np.argsort(term, kind="stable")
        term, count, place = term[by], count[by], place[by]
        first = np.ones(len(term), bool)
        first[1:] = term[1:] != term[:-1]
        gap = np.where(first, place, np.diff(place, prepend=0))
        raw, taken = pack(np.stack([gap, count], axis=1).ravel())
        ends = np.cumsum(taken)[1::2][np.append(first[1:], True)] if len(term) else np.empty(0, np.int64)
        return {
            "ids": np.array(ids, np.int64)[order].tobytes(),
            "sizes": np.array(sizes, np.int64).tobytes(),
            "terms": b" ".join(numbers),
            "ends": ends.tobytes(),
            "postings": raw.tobytes(),
            "n_docs": sum(s > 0 for s in sizes),
            "n_terms": sum(sizes),
        }

    def __init__(self, ids: bytes, sizes: bytes, terms: bytes, ends: bytes, postings: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.slot = {t: k for k, t in enumerate(terms.split())}
        self.ends, self.raw = np.frombuffer(ends, np.int64), np.frombuffer(postings, np.uint8)

    def postings(self, term: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """(positions, counts) of a term, None if no document holds it."""
        k = self.slot.get(term)
        if k is None:
            return None
        both = unpack(self.raw[self.ends[k - 1] if k else 0 : self.ends[k]])
        return np.cumsum(both[::2]), both[1::2]


def inverted_lists(docs: DataFrame, shard_bytes: int = 8_000_000) -> DataFrame:
    """One row for each shard: the columns of Shard, and the number of its documents that
    have a term and of their terms."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch.column(1), shard_bytes):
                rows = batch.slice(part.start, part.stop - part.start)
                made = Shard.build(rows.column(0).to_pylist(), rows.column(1).to_pylist())
                yield pa.RecordBatch.from_pylist([made], pa.schema([(c, pa.binary()) for c in Shard.columns] + [("n_docs", pa.int64()), ("n_terms", pa.int64())]))

    return keyed(docs).mapInArrow(run, Shard.schema)


class Best:
    """The `limit` best documents so far, the worst one on top: by score, then by smaller doc_id."""

    def __init__(self, limit: int):
        self.limit, self.heap = limit, []

    def full(self) -> bool:
        return len(self.heap) >= self.limit

    def floor(self) -> int:
        """Documents with a smaller score can't come in."""
        return self.heap[0][0] if self.full() else 1

    def offer(self, score: int, doc: int) -> None:
        if not self.full():
            heapq.heappush(self.heap, (score, -doc))
        elif (score, -doc) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc))


def search(lists: list[tuple[list[int], list[int], int]], ids: np.ndarray, best: Best) -> None:
    """Offer the documents of a shard to `best`, in order of their positions.

    `lists` has the positions, the scores there and the largest score of each term.
    """
    lists = sorted(lists, key=lambda x: x[2])
    reach, total = [], 0
    for _, _, most in lists:
        total += most
        reach.append(total)  # what this term and all before it can add
    merged = bisect_left(reach, best.floor())  # the terms before it can't fill a place alone
    if merged == len(lists):
        return
    width = len(lists)
    at = [0] * width
    heap = [lists[k][0][0] * width + k for k in range(merged, width)]
    heapq.heapify(heap)
    end = len(ids) * width
    while heap and heap[0] < end:
        doc = heap[0] // width
        score = 0
        while heap[0] // width == doc:
            k = heap[0] % width
            places, scores, _ = lists[k]
            i = at[k]
            score += scores[i]
            at[k] = i = i + 1
            if i < len(places):
                heapq.heapreplace(heap, places[i] * width + k)
            else:
                heapq.heappop(heap)
                if not heap:
                    break
        floor = best.floor()
        for k in range(merged - 1, -1, -1):
            if score + reach[k] < floor:
                score = 0
                break
            places, scores, _ = lists[k]
            at[k] = i = bisect_left(places, doc, at[k])
            if i < len(places) and places[i] == doc:
                score += scores[i]
        if score >= floor and score > 0:
            best.offer(score, int(ids[doc]))
            if best.floor() > floor and merged < width:
                more = bisect_left(reach, best.floor())
                if more > merged:  # those lists leave the merge; their cursors stay where they are
                    merged = more
                    heap = [x for x in heap if x % width >= merged]
                    heapq.heapify(heap)


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * norms)


def _answers(index: DataFrame, queries: list[tuple[int, Counter]], weights: dict[bytes, int], n: int, total: int, limit: int) -> DataFrame:
    """(query, doc_id, score): the best documents of each task for each of some queries."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = shared.value
        best = [Best(limit) for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(*(row[c] for c in Shard.columns))
                norms = np.array([75 + 25 * s * n // total for s in shard.sizes.tolist()], np.int64)
                known = {}
                for term, w in weights.items():
                    found = shard.postings(term) if w > 0 else None
                    if found is not None:
                        scores = w * impacts(found[1], norms[found[0]])
                        known[term] = found[0].tolist(), scores.tolist(), int(scores.max())
                for (_, query), heap in zip(queries, best):
                    lists = []
                    for term, times in query.items():
                        if term in known:
                            places, scores, most = known[term]
                            lists.append((places, scores if times == 1 else [times * s for s in scores], times * most))
                    if lists:
                        search(lists, shard.ids, heap)
        out = [(number, -doc, score) for (number, _), heap in zip(queries, best) for score, doc in heap.heap]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], names=["query", "doc_id", "score"])

    return index.select(*Shard.columns).mapInArrow(run, "query long, doc_id long, score long")


def _frequencies(index: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each term of a vocabulary of bounded size."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(*(row[c] for c in Shard.columns))
                for term in shared.value & shard.slot.keys():
                    counts[term] += len(shard.postings(term)[0])
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["term", "df"])

    found = index.select(*Shard.columns).mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in found.toLocalIterator()}


def _blocks(items: DataFrame, terms: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """The queries in order of arrival, in lists with up to `terms` distinct terms, one query at least."""
    block, size = [], 0
    for row in items.toLocalIterator():
        found: Counter = Counter()
        for words in terms_of(row.text):
            found.update(words)
        if block and size + len(found) > terms:
            yield block
            block, size = [], 0
        block.append((row.item_id, found))
        size += len(found)
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, limit: int = 20, shard_bytes: int = 8_000_000, block_terms: int = 200_000) -> DataFrame:
    """For each row of items its `limit` best documents with a score above 0 (all, if
    fewer): item_id, rank (from 1), doc_id, score.

    Scores are those of BM25 in integers; equal ones are ranked by doc_id.  A null text
    has no terms; a null doc_id comes before all others, and repeated rows are ranked
    apart, as are repeated items.  An item without terms, or none of whose terms occurs,
    has no rows.  Items are taken in blocks with up to `block_terms` different terms (a
    longer item is a block), each against the whole index.
    """
    spark = docs.sparkSession
    index = cut(inverted_lists(docs, shard_bytes))
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    number, out, names = 0, [], []
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for block in _blocks(plain, block_terms) if total else ():
        counts = _frequencies(index, {t for _, query in block for t in query})
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in counts.items()}
        queries = [(number + k, query) for k, (_, query) in enumerate(block)]
        names = [(number + k, item) for k, (item, _) in enumerate(block)]
        number += len(block)
        found = _answers(index, queries, weights, n, total, limit)
        named = F.broadcast(spark.createDataFrame(names, "query long, item_id long"))  # no larger than the block
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        out.append(cut(top.join(named, "query").select("item_id", "rank", id_back(), "score")))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _union(out)


def _union(frames: list[DataFrame]) -> DataFrame:
    """A balanced union, so that the plan of many blocks stays shallow."""
    while len(frames) > 1:
        frames = [a.union(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) // 2 * 2 :]
    return frames[0]


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of rank_documents() for all documents and benchmark items."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH found AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM found WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM sizes),
counts AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM found) GROUP BY r, term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * w.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole w GROUP BY term, w.n),
norms AS (SELECT r, doc_id, 75 + (25 * s.n * w.n) // w.l AS m FROM sizes s, whole w),
scores AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20"""
