"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints are made in tasks over whole texts.  Equal fingerprints are merged
first, so copies cost one row.  Two fingerprints that differ in at most
`distance` bits agree in enough of the blocks that the 64 bits are cut into, so
each fingerprint is sent to one shard for every choice of agreeing blocks.  In
a shard the fingerprints are sorted by Gray rank, consecutive ones form the
leaves of a tree, every node holds the bits that all below it share and that no
node above it holds, and a search adds up the differences on the way down and
leaves a whole group as soon as they exceed the distance.  A shard yields a
spanning forest, not its pairs.  Shards with many fingerprints are cut again by
the bits they don't share yet, so that no group grows without bound.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, column, cut, id_back, keyed, map_texts, table

BITS = 64
#: fingerprints in a tree node, and children of an upper node
FANOUT = 16
#: shingles of the texts that one task compares
SHARD_SHINGLES = 1_000_000


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    runs = zip(*(words[i:] for i in range(width)))
    return np.fromiter((digest(b" ".join(run), seed) for run in runs), np.uint64, len(words) - width + 1)


_SALTS = np.random.default_rng(42).integers(1, 1 << 63, 64, dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits set in over half of the hashes; 0 for none.  Words behind the first
    are made of other mixtures of the same hashes."""
    counts = np.zeros(BITS * words, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        more = [(part ^ salt) * np.uint64(0x9E3779B97F4A7C15) for salt in _SALTS[: words - 1]]
        all_ = np.stack([part, *(x ^ (x >> np.uint64(32)) for x in more)], axis=1)
        counts += np.unpackbits(all_.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default doc_id) and fp, the fingerprint: a signed long, or an array
    of them for several words."""

    def make():
        def apply(texts):
            fps = [fingerprint(shingle_hashes(t, width), words).view(np.int64) for t in texts]
            return {"fp": np.concatenate(fps) if words == 1 else pa.array(fps, pa.list_(pa.int64()))}

        return apply

    return map_texts(docs, make, f"fp {'long' if words == 1 else 'array<bigint>'}", keep)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchical index of distinct fingerprints (rows of words) for searches within a Hamming distance."""

    def __init__(self, fps: np.ndarray):
        self.order = np.lexsort([gray_rank(fps[:, k]) for k in range(fps.shape[1])][::-1])
        self.fps = fps[self.order]
        alls, anys = self.fps, self.fps
        levels = []
        while len(alls) > 1 or not levels:
            cuts = np.arange(0, len(alls), FANOUT)
            alls, anys = np.bitwise_and.reduceat(alls, cuts, 0), np.bitwise_or.reduceat(anys, cuts, 0)
            levels.append((~(alls ^ anys), alls))
        #: from the root down: the bits that a node adds to those of the nodes above, and their values
        self.levels, above = [], None
        for mask, pattern in reversed(levels):
            own = mask if above is None else mask & ~np.repeat(above, FANOUT, 0)[: len(mask)]
            self.levels.append((own, pattern))
            above = mask
        self.leaf_mask = above

    def near(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, fingerprint number) of all within the distance."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        gone = np.zeros(len(queries), np.int64)
        for k, (own, pattern) in enumerate(self.levels):
            if k:
                q, node, gone = self._children(q, node, gone, len(own))
            gone = gone + bits_of((queries[q] ^ pattern[node]) & own[node])
            q, node, gone = (x[gone <= distance] for x in (q, node, gone))
        q, node, gone = self._children(q, node, gone, len(self.fps))
        gone = gone + bits_of((queries[q] ^ self.fps[node]) & ~self.leaf_mask[node // FANOUT])
        hit = gone <= distance
        return q[hit], self.order[node[hit]]

    @staticmethod
    def _children(q, node, gone, count):
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        q, gone = np.repeat(q, FANOUT), np.repeat(gone, FANOUT)
        real = child < count
        return q[real], child[real], gone[real]


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def forest(fps: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) for all nodes of a shard but the smallest ones."""
    order = np.argsort(nodes)  # positions by node, so that the smallest position is the smallest node
    fps, nodes = fps[order], nodes[order]
    # all that are near the first are linked by it; only the others have to ask
    linked = bits_of(fps ^ fps[:1]) <= distance
    root = np.where(linked, 0, np.arange(len(fps)))
    ask = np.flatnonzero(~linked)
    if len(ask):
        index = GrayIndex(fps)
        step = max(16, 2_000_000 // len(fps))
        for start in range(0, len(ask), step):
            some = ask[start : start + step]
            a, b = index.near(fps[some], distance)
            a = some[a]
            while len(a):  # hook the larger root to the smaller one, then flatten
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                open_ = low != high
                if not open_.any():
                    break
                a, b = a[open_], b[open_]
                np.minimum.at(root, high[open_], low[open_])
                while True:
                    flat = root[root]
                    if (flat == root).all():
                        break
                    root = flat
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]]


def blocks(bits: list[int], count: int) -> list[list[int]]:
    """Bit numbers dealt into `count` blocks of near equal size."""
    cuts = [round(i * len(bits) / count) for i in range(count + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _masked(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def shards(nodes: DataFrame, distance: int, shard_limit: int) -> DataFrame:
    """(part, value, fp, node): for any two fingerprints within the distance there
    is a shard that holds both."""
    whole = list(range(BITS))
    firsts = blocks(whole, distance + 2)
    parts = [sorted(sum(chosen, [])) for chosen in combinations(firsts, 2)]  # two blocks at least agree
    fp = F.col("fp")
    keys = nodes.select(
        "fp",
        "node",
        F.explode(F.array(*(F.struct(F.lit(i).alias("part"), _masked(fp, bits).alias("value")) for i, bits in enumerate(parts)))).alias("k"),
    ).select("k.part", "k.value", "fp", "node")
    # a shard above the limit is cut by the bits it doesn't share: distance + 1 blocks, one of which agrees
    large = keys.groupBy("part", "value").count().filter(F.col("count") > shard_limit).drop("count").withColumn("large", F.lit(True))
    finer = []
    for i, bits in enumerate(parts):
        rest = [b for b in whole if b not in bits]
        finer.append(
            F.array(
                *(
                    F.struct(F.lit(len(parts) + i * (distance + 1) + j).alias("part"), _masked(fp, bits + more).alias("value"))
                    for j, more in enumerate(blocks(rest, distance + 1))
                )
            )
        )
    as_is = F.array(F.struct(F.col("part"), F.col("value")))
    own = F.when(F.col("large").isNull(), as_is)
    for i, array in enumerate(finer):
        own = own.when(F.col("part") == i, array)
    return keys.join(large, ["part", "value"], "left").select(F.explode(own).alias("k"), "fp", "node").select("k.part", "k.value", "fp", "node")


def links(shards_: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b), a > b, that connect all fingerprints of a shard within the distance.

    `shards_` has fp, a long `node` that is distinct for each, and its shard's key.
    """
    many = dict(shards_.dtypes)["fp"].startswith("array")
    fps = F.collect_list("fp")
    groups = (
        shards_.groupBy(*(c for c in shards_.columns if c not in ("fp", "node")))
        .agg((F.flatten(fps) if many else fps).alias("fps"), F.collect_list("node").alias("nodes"))
        .filter(F.size("nodes") > 1)
        .select("fps", "nodes")
    )

    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps, ids in zip(batch.column(0), batch.column(1)):
                x, ids = fps.values.to_numpy(zero_copy_only=False).view(np.uint64), ids.values.to_numpy(zero_copy_only=False)
                hi, lo = forest(x.reshape(len(ids), -1), ids, distance)
                a.append(hi)
                b.append(lo)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node with an edge.

    Alternating large-star and small-star rounds; each is an aggregation and an
    equi-join on the edges that are left, and every round is checkpointed.  It ends
    when each node has one edge up or edges from below, not both.
    """
    edges = cut(edges)
    while not _stars(edges):
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        # written first: a join of shuffled rows with checkpointed ones is split where a hub's rows are many
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))).hint("merge")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least.hint("merge"), "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def simhash_components(docs: DataFrame, width: int = 3, distance: int = 2, shard_limit: int = 2048) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most `distance` bits;
    component_id is the smallest doc_id reachable.  Null texts count as empty,
    empty texts have fingerprint zero.  A null doc_id counts as the smallest id.
    Repeated rows give repeated results.
    """
    fps = cut(fingerprints(keyed(docs), width))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(links(shards(nodes, distance, shard_limit), distance))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(roots, "fp").select(
        id_back(),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        id_back("component_id"),
    )


def set_key(shingles: np.ndarray) -> int:
    """A number for a set of shingles, given as its sorted hashes."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 1)).view(np.int64))


def band_values(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each band a hash of its number and of `rows` min-hashes of the set; none for an empty set.

    Two sets of Jaccard similarity s agree in a band with probability s ** rows,
    whatever the number of sets.
    """
    if not len(shingles):
        return np.empty(0, np.int64)
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)
    least = np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(shingles), 1 << 9):
        np.minimum(least, (shingles[at : at + (1 << 9)] * odd + add).min(axis=1), out=least)
    value = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        value = (value ^ least[k::rows]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def similar(sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Links (positions) that connect all sets with a Jaccard similarity of `share` or
    more, and no others: a search that compares each set with those not reached yet."""
    sizes = np.array([len(s) for s in sets])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(numbers, np.cumsum(sizes)[:-1])
    there = np.zeros(len(numbers), np.int8)
    left, found = np.arange(len(sets)), []

    def without(gone):
        stay = ~gone
        return left[stay], flat[np.repeat(stay, sizes[left])]

    flat, queue = numbers, []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left, flat = without(left == left[0])
            continue
        x = queue.pop()
        there[own[x]] = 1
        sums = np.concatenate([[0], np.cumsum(there[flat], dtype=np.int64)])
        there[own[x]] = 0
        ends = np.cumsum(sizes[left])
        common = sums[ends] - sums[ends - sizes[left]]
        near = common * (1 + share) >= share * (sizes[x] + sizes[left]) - 1e-9
        if near.any():
            more = left[near].tolist()
            found += [(x, y) for y in more]
            queue += more
            left, flat = without(near)
    return found


def _blocks(shard_limit: int) -> Column:
    """Blocks of a group with m nodes and n shingles."""
    over = F.greatest(F.col("m") / shard_limit, F.col("n") / SHARD_SHINGLES)
    return F.when(over <= 1, 1).otherwise(F.ceil(2 * over)).cast("int")


def pair_tasks(groups: DataFrame, shard_limit: int) -> DataFrame:
    """(group, parts, i, j, node): tasks in which any two nodes of a group meet.

    A group with up to `shard_limit` sets and SHARD_SHINGLES shingles is one task; a
    larger one is dealt into `parts` blocks, and any two blocks make a task.
    """
    sized = groups.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("n")).filter("m > 1")
    dealt = groups.select("group", "node").join(sized.select("group", _blocks(shard_limit).alias("parts")), "group")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), "parts").cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
    return dealt.withColumn("other", F.explode(other)).select("group", "parts", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")


def verified(tasks: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Edges (a, b), a > b, that connect the nodes of each task whose sets are similar."""
    groups = (
        tasks.join(sets, "node")
        .groupBy("by_band", "group", "i", "j")
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
                for x, y in similar([s.values.to_numpy(zero_copy_only=False) for s in lists], share):
                    a.append(max(nodes[x], nodes[y]))
                    b.append(min(nodes[x], nodes[y]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def with_roots(found: DataFrame) -> DataFrame:
    """components() with a row for each root as well."""
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def _hung(joined: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect each node with the smallest nodes b of its bands.

    A node is tied to the smallest of them only, and that one to the others: nodes that
    share their bands give the same edges between the b, so a node costs one edge of its
    own.  A node has as many b as it has bands at most.
    """
    of = joined.groupBy("node").agg(F.collect_set("b").alias("bs")).withColumn("m", F.array_min("bs"))
    ends = F.explode(F.array_append("bs", F.col("node")))
    return of.select(ends.alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def fingerprint_edges(nodes: DataFrame, distance: int, shard_limit: int) -> DataFrame:
    """Edges (a, b), a > b, that connect the nodes whose fingerprints the Gray-order index links."""
    apart = nodes.groupBy("fp").agg(F.min("node").alias("b"))
    same = nodes.select("fp", F.col("node").alias("a")).join(apart, "fp").filter("a != b").select("a", "b")
    return links(shards(apart.withColumnRenamed("b", "node"), distance, shard_limit), distance).union(same)


def fingerprint_groups(nodes: DataFrame, distance: int, shard_limit: int) -> DataFrame:
    """(node, group): nodes whose fingerprints the Gray-order index links have the same group."""
    found = components(fingerprint_edges(nodes, distance, shard_limit))
    return nodes.join(found, "node", "left").select("node", F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "node")).alias("group"))


def keep_one_of_each(docs: DataFrame, width: int = 5, share: float = 0.8, bands: int = 32, rows: int = 6, shard_limit: int = 4096, distance: int = 2) -> DataFrame:
    """The rows of docs, all columns, but for one of each group of near copies only the
    row with the smallest doc_id stays.

    Near copies have sets of word shingles with a Jaccard similarity of `share` or
    more; groups are what such pairs connect.  Candidates are the sets whose
    fingerprints are linked at `distance` or fewer differing bits, found by the
    Gray-order index and joined to components, and, as few pairs at 0.8 are that
    close, sets that agree in one of `bands` bands of `rows` min-hashes.  The sets of
    candidates are then compared: of pairs at exactly 0.8 all but 6 in 100,000 become
    candidates, at any number of texts.  Rows with equal sets (all texts without words among them) are always one
    group; of rows that share the doc_id as well one stays.  Null texts count as
    empty, a null doc_id as the smallest.
    """
    named = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__t": F.md5(F.coalesce(F.col("text"), F.lit("")))})

    def make():
        def apply(texts):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            return {
                "node": [set_key(s) for s in sets],
                "n": [len(s) for s in sets],
                "fp": np.array([fingerprint(s)[0] for s in sets], np.uint64).view(np.int64),
                "bands": pa.array([band_values(s, bands, rows) for s in sets], pa.list_(pa.int64())),
            }

        return apply

    seen = map_texts(named, make, "node long, n long, fp long, bands array<bigint>", ["__d", "__t"])
    nodes = cut(seen.groupBy("node").agg(F.min(F.struct("__d", "__t")).alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))

    # candidates: all that share a band with the smallest node of it hang together, and so do those linked by fingerprints
    banded = nodes.select("node", "n", F.explode("bands").alias("group"))
    least = cut(banded.groupBy("group").agg(F.min("node").alias("b"), F.count("*").alias("m")).filter("m > 1").drop("m"))
    edges = _hung(banded.join(least.hint("merge"), "group")).union(fingerprint_edges(nodes, distance, shard_limit)).distinct()
    loose = cut(with_roots(components(edges)).join(nodes.select("node", "n"), "node").select(F.col("root").alias("group"), "node", "n"))

    # the texts of those are compared; a group that would be dealt into more blocks than there are bands goes by its bands
    tasks = pair_tasks(loose, shard_limit).withColumn("by_band", F.lit(False))
    over = loose.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("n")).agg(F.max(_blocks(shard_limit))).first()[0]
    if (over or 0) > bands + 2:
        large = cut(tasks.filter(F.col("parts") > bands + 2).select("node").distinct())
        own = nodes.join(large, "node")
        linked = fingerprint_groups(own, distance, shard_limit).join(own.select("node", "n"), "node")
        by_band = own.select("node", "n", F.explode("bands").alias("group")).unionByName(linked)
        by_band = pair_tasks(by_band.select("group", "node", "n"), shard_limit).withColumn("by_band", F.lit(True))
        tasks = tasks.filter(F.col("parts") <= bands + 2).union(by_band)

    def make_sets():
        return lambda texts: {"shingles": pa.array([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts], pa.list_(pa.int64()))}

    asked = loose.join(nodes, "node").select("node", "row.*")
    texts = named.select("__d", "__t", "text").join(asked, ["__d", "__t"]).dropDuplicates(["__d", "__t"])
    sets = map_texts(texts, make_sets, "shingles array<bigint>", ["node"])
    found = with_roots(components(verified(tasks, sets, share)))

    first = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("row").alias("row")).select("row.*")
    kept = named.join(first, ["__d", "__t"], "left_semi").dropDuplicates(["__d", "__t"])
    return kept.select(*map(column, docs.columns))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of simhash_components()."""
    return simhash_components(table(spark, sf_dir, "documents"))
