"""Exact Jaccard join of documents by their sets of word shingles, with signature trees.

Equal sets are merged first.  Which sets can be similar at all is found by cutting the
shingles into so many segments that the sets of a linked pair agree in one of them (they
differ in too few shingles to touch all), so each set is sent to one key for each segment.
Sets that hang together by keys are compared in tasks of bounded size.

A task sorts its sets into a signature tree: a node holds the OR of its sets' token
bitmaps, the range of their sizes, and the most tokens of a set that share a bit with
another one.  Two nodes are followed down together as long as the bits they have in
common, and their sizes, leave room for the overlap that a link needs.  A task yields a
spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_back, keyed, map_texts, table, tree_depth
from .simhash import _hung, components, pair_tasks, with_roots

FANOUT = 16
#: counters of the sketch that tells frequent shingles
COUNTERS = 1 << 20
#: bits of all signatures of a task, and bytes that a step of the traversal may hold
TASK_BITS, STEP_BYTES = 1 << 28, 1 << 23
#: clusters that need more blocks than this are compared by their keys
MOST_PARTS = 33
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """XXH64 of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


def shingle_set(text: str, hashes: WordHashes, width: int = 3) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    words = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * _ODD + h[k : k + n])
    return np.unique(out)


def allowed(size: int, percent: int) -> int:
    """In how many elements linked sets may differ if the larger one has `size`."""
    return 2 * size * (100 - percent) // (100 + percent)


def steps_of(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(step, segments, spare segments) for the sizes of the larger set that a set of this
    size can meet.  A step covers sizes up to half as much again; it has one segment more
    than differences and spare ones."""
    top, step, out = 1, 0, []
    while allowed(top + 1, percent) == 0:
        top += 1
    while size * 100 // percent > top:
        below, top, step = top, max(top + 1, top * 3 // 2), step + 1
        if size <= top:
            d = allowed(top, percent)
            out.append((step, d + 2 + d // 10, 1 + d // 10))
    return out


def segment_keys(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two sets share one if their Jaccard similarity is `percent` or more
    and they aren't equal.

    Linked sets agree in more segments than there are spare ones.  Segments that are empty
    or hold frequent shingles only are left out by sets that have no more of them than
    spare ones; such a set agrees with a linked one in another segment too.
    """
    if not len(shingles):
        return np.empty(0, np.int64)
    usual = ~frequent[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    keys = []
    for step, segments, spare in steps_of(len(shingles), percent):
        of = (_mix(shingles ^ np.uint64(step)) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(segments))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(shingles[order] + _ODD))])
        sums = sums[np.append(starts[1:], len(of))] - sums[starts]
        good = np.bincount(of, weights=usual, minlength=segments) > 0
        value = _mix(_mix(sums) + np.arange(segments, dtype=np.uint64) * _ODD + np.uint64(step << 40))
        keys.append(value[good] if (~good).sum() <= spare else value)
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def frequent_counters(docs: DataFrame, width: int, least: int = 50) -> np.ndarray:
    """Which counters of a sketch over the shingle sets of all texts stand out: four times
    the mean and `least` at any rate.  The sketch has one size for any input."""

    def count(batches):
        hashes, total = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (shingle_set(text.as_py(), hashes, width) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def add(a, row):
        b = np.frombuffer(row[0], np.int64)
        return b if a is None else a + b

    parts = docs.select("text").mapInArrow(count, "total binary").rdd
    counts = parts.treeAggregate(None, add, lambda a, b: a if b is None else b if a is None else a + b, tree_depth(parts.getNumPartitions()))
    return np.zeros(COUNTERS, bool) if counts is None else counts > max(least, 4 * counts.mean())


class SignatureTree:
    """Sets of 64-bit numbers in a tree of OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        sizes = np.array([len(s) for s in sets])
        self.order = np.lexsort(([int(s[0]) for s in sets], sizes))
        sets = [sets[i] for i in self.order]
        sizes = sizes[self.order]
        values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.cumsum(sizes)
        self.own = np.split(numbers, cuts[:-1])
        bits = 1 << max(8, (min(len(values), TASK_BITS // len(sets)) - 1).bit_length())
        words = np.zeros((len(sets), bits // 64), np.uint64)
        place = numbers & (bits - 1)
        owner = np.repeat(np.arange(len(sets)), sizes)
        np.bitwise_or.at(words, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        shared = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)  # tokens whose bit another one has set
        #: from the sets up to the root: bitmaps, least and largest size, most shared bits
        self.levels = [(words, sizes, sizes, shared)]
        while len(words) > 1:
            at = np.arange(0, len(words), FANOUT)
            words, low, high, shared = self.levels[-1]
            words, low, high, shared = np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(shared, at)
            self.levels.append((words, low, high, shared))

    def _meet(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest overlap that pairs of nodes can have; -1 where their sizes forbid a link."""
        words, low, high, shared = self.levels[level]
        out = np.empty(len(a), np.int64)
        step = max(1, STEP_BYTES // (8 * words.shape[1]))
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            out[k : k + step] = np.bitwise_count(words[x] & words[y]).sum(axis=1, dtype=np.int64)
        out = np.minimum(out + np.minimum(shared[a], shared[b]), np.minimum(high[a], high[b]))
        p = self.percent
        fits = (100 * high[a] >= p * low[b]) & (100 * high[b] >= p * low[a]) & ((100 + p) * out >= p * (low[a] + low[b]))
        return np.where(fits, out, -1)

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, each once."""
        k = np.arange(FANOUT * FANOUT)
        x = (a[:, None] * FANOUT + k // FANOUT).ravel()
        y = (b[:, None] * FANOUT + k % FANOUT).ravel()
        n = len(self.levels[level][0])
        real = (x < n) & (y < n) & (x <= y)
        return x[real], y[real]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links (numbers of sets) that connect all sets which links connect."""
        n = len(self.own)
        root = np.arange(n)
        top = len(self.levels) - 1
        a = b = np.zeros(min(top, 1), np.int64)
        for level in range(top, 0, -1):
            if level < top:
                a, b = self._below(level, a, b)
            near = self._meet(level, a, b) >= 0
            a, b = a[near], b[near]
        by = np.argsort(b - a, kind="stable")  # near ones first: what they connect needn't be compared again
        a, b = a[by], b[by]
        at = np.arange(0, n, FANOUT)
        for k in range(0, len(a), 64):
            low, high = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
            x, y = a[k : k + 64], b[k : k + 64]
            open_ = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
            x, y = self._below(0, x[open_], y[open_])
            apart = (x < y) & (root[x] != root[y])
            x, y = x[apart], y[apart]
            most = self._meet(0, x, y)
            x, y, most = x[most >= 0], y[most >= 0], most[most >= 0]
            shared = self.levels[0][3]
            sure = (shared[x] == 0) | (shared[y] == 0)  # then the bitmaps count the overlap itself
            self._hook(root, x[sure], y[sure])
            for i, j in zip(x[~sure].tolist(), y[~sure].tolist()):
                if root[i] != root[j]:
                    both = len(np.intersect1d(self.own[i], self.own[j], assume_unique=True))
                    if (100 + self.percent) * both >= self.percent * (len(self.own[i]) + len(self.own[j])):
                        self._hook(root, np.array([i]), np.array([j]))
        moved = np.flatnonzero(root != np.arange(n))
        return self.order[moved], self.order[root[moved]]

    @staticmethod
    def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Let the linked sets have one root."""
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            open_ = low != high
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(root, high[open_], low[open_])
            while not ((flat := root[root]) == root).all():
                root[:] = flat


def tree_links(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b), a > b, that connect the nodes of each task whose sets are linked."""
    groups = (
        tasks.join(sets, "node")
        .groupBy("by_key", "group", "i", "j")
        .agg(F.collect_list(F.struct("node", "shingles")).alias("sets"))
        .filter(F.size("sets") > 1)
        .select("sets")
    )

    def run(batches):
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                nodes, lists = (group.values.field(k) for k in (0, 1))
                nodes = nodes.to_numpy(zero_copy_only=False)
                sets = [s.values.to_numpy(zero_copy_only=False) for s in lists]
                for x, y in zip(*SignatureTree(sets, percent).links()):
                    a.append(max(nodes[x], nodes[y]))
                    b.append(min(nodes[x], nodes[y]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, shard_limit: int = 2048) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id
    that links reach, its own included).

    Documents link if 100 * intersection >= percent * union of their sets of shingles.  A
    text with fewer words than a shingle is one shingle; a text without words, or null, is
    empty and linked with nothing.  A null doc_id counts as the smallest; repeated rows
    give repeated results.  Shingles are told apart by 64 bits, equal sets by 128.
    """
    source = keyed(docs).withColumn("mark", F.md5("text"))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent_counters(source, width)))

    def make():
        import xxhash

        hashes, frequent = WordHashes(), np.unpackbits(shared.value).astype(bool)

        def apply(texts):
            sets = [shingle_set(t, hashes, width) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets],
                "same": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "keys": pa.array([segment_keys(s, frequent, percent) for s in sets], pa.list_(pa.int64())),
            }

        return apply

    seen = cut(map_texts(source, make, "n_shingles long, same binary, keys array<bigint>", ["doc_id", "mark"]))
    full = seen.filter("same IS NOT NULL")
    nodes = full.groupBy("same").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = cut(nodes).withColumn("node", F.monotonically_increasing_id())  # of what is checkpointed: always the same

    # sets that share a key with the smallest node of it hang together; a hot key is split in the join
    keys = nodes.select("node", "n", F.explode("keys").alias("group"))
    least = cut(keys.groupBy("group").agg(F.min("node").alias("b"), F.count("*").alias("m")).filter("m > 1").drop("m"))
    loose = cut(with_roots(components(_hung(keys.join(least.hint("merge"), "group")))))

    whole = cut(pair_tasks(loose.join(nodes.select("node", "n"), "node").select(F.col("root").alias("group"), "node", "n"), shard_limit))
    large = whole.filter(F.col("parts") > MOST_PARTS).select("node").distinct()
    tasks = whole.filter(F.col("parts") <= MOST_PARTS).withColumn("by_key", F.lit(False))
    if not large.isEmpty():
        by_key = pair_tasks(keys.join(large, "node").select("group", "node", "n"), shard_limit)
        tasks = tasks.union(by_key.withColumn("by_key", F.lit(True)))

    def make_sets():
        hashes = WordHashes()
        return lambda texts: {"shingles": pa.array([shingle_set(t, hashes, width).view(np.int64) for t in texts], pa.list_(pa.int64()))}

    asked = loose.join(nodes, "node").select("node", "row.*")
    texts = source.join(asked, ["doc_id", "mark"]).dropDuplicates(["node"])
    sets = map_texts(texts, make_sets, "shingles array<bigint>", ["node"])
    found = cut(with_roots(components(tree_links(tasks, sets, percent))))
    smallest = cut(nodes.join(found, "node").groupBy("root").agg(F.min("row.doc_id").alias("component_id")))
    moved = found.join(smallest.hint("merge"), "root").select("node", "component_id")
    named = cut(nodes.join(moved, "node", "left").select("same", F.coalesce("component_id", "row.doc_id").alias("component_id")))
    linked = full.select("doc_id", "n_shingles", "same").join(named.hint("merge"), "same").select("doc_id", "n_shingles", "component_id")
    alone = seen.filter("same IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select(id_back(), "n_shingles", id_back("component_id"))


def op13_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of jaccard_components()."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS s FROM words),
same AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY 1),
shingles AS MATERIALIZED (SELECT node, len(s) AS n, hash(unnest(s)) AS h FROM same),
links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.node <> b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT node, node AS root FROM same UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(root, doc_id) AS component_id FROM sets LEFT JOIN same ON list_sort(sets.s) = same.s LEFT JOIN least USING (node)"""
