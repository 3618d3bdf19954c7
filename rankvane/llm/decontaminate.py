"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: the words under its ones are
hashed, those under its zeros may differ.  Seeds of the texts are joined with
the benchmark's seeds; each hit gives an alignment, and the words around the hit
are compared one by one, so that overlaps with substituted words are found and
measured.

Long items and texts are worked on in pieces of PIECE windows.  Only seeds and their
places go through the join by seed; the words of two pieces are fetched for each pair of
pieces that has hits.  What is equal up to the edge of a piece goes on in the next one
and is put together afterwards.

Nothing of the benchmark is gathered in one place.  Most text seeds are in no
item and don't reach the shuffle: a bitmap of the benchmark's seeds, of at most
MOST_BITS bits whatever its size, rules them out in the tasks that read the
texts.  A benchmark too large for it only lets more seeds through.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, column, cut, table, text_slices

WORDS = re.compile(r"\w+").findall
#: whichever two words of twelve are replaced, one of these masks still fits at some place
MASKS = ("11101011", "110110011", "100110111")
#: the same for items of 8 to 11 words, which are compared whole
SHORT_MASKS = ("11111", "110111", "11001011")
#: bits of the largest bitmap of seeds (16 MB) and of the smallest
MOST_BITS, LEAST_BITS = 27, 16
#: windows of an item or text that are compared at once
PIECE = 1024
#: bytes of text that are worked on at once
SLICE = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: (doc_id, hash of the text): rows that share both are one document
KEY = ["__d", "__t"]


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def covers(masks: tuple[str, ...], window: int, substitutions: int) -> bool:
    """Whether every choice of substituted words in a window leaves some seed whole."""
    places = [
        sum(1 << (at + i) for i, c in enumerate(mask) if c == "1") for mask in masks for at in range(window - len(mask) + 1)
    ]
    return all(any(not p & sum(1 << b for b in bad) for p in places) for bad in combinations(range(window), substitutions))


def checked(window: int = 12, share: float = 0.8, min_words: int = 8, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS) -> None:
    for n in range(min(min_words, window), window + 1):
        gone = int(n * (1 - share) + 1e-9)
        if not covers(masks if n == window else short_masks, n, gone):
            raise ValueError(f"the masks can miss windows of {n} words with {gone} substitutions")


class WordHashes(dict):
    """word -> XXH64 of it; emptied when full."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_hashes(ids: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A hash of the words under the mask at each place where it fits."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, factor = np.full(n, salt, np.uint64), 1
    for i, c in enumerate(mask):
        if c == "1":
            factor = factor * int(_PRIME) % 2**64
            out += ids[i : i + n] * np.uint64(factor)
    out ^= out >> np.uint64(31)
    return out * _PRIME


def _bit(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)) if probe == 0 else (h >> np.uint64(5)) & np.uint64((1 << bits) - 1)


def good_runs(own: np.ndarray, ids: np.ndarray, shift: int, window: int, share: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(first and last window of an item that have a place at ids[shift:], starts and ends
    of the runs of windows in which enough words are equal)."""
    a, b = max(0, -shift), min(len(own), len(ids) - shift)
    w = min(window, len(own))
    if b - a < w:
        return a, a, np.empty(0, np.int64), np.empty(0, np.int64)
    equal = np.concatenate([[0], (own[a:b] == ids[a + shift : b + shift]).cumsum()])
    good = np.concatenate([[False], equal[w:] - equal[:-w] >= share * w - 1e-9, [False]])
    edges = np.flatnonzero(good[1:] != good[:-1])
    return a, b - w + 1, a + edges[::2], a + edges[1::2]


def pieces(windows: int) -> list[tuple[int, int]]:
    """(first, last) windows of each piece."""
    return [(p, min(windows, p + PIECE)) for p in range(0, windows, PIECE)]


def _item_pieces(benchmark: DataFrame, min_words: int, masks, short_masks, window: int) -> DataFrame:
    """A row for each piece of an item: name, item (hash of name and text), piece (its first
    word), more_before and more_after, words (hashes), and seeds with their places in it."""
    items = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"))
    schema = "name string, item long, piece int, more_before boolean, more_after boolean, words array<bigint>, seeds array<struct<seed:bigint,at:array<int>>>"

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for name, item, text in zip(*batch.columns):
                ids = hashes.of(text.as_py())
                if len(ids) < min_words:
                    continue
                own = masks if len(ids) >= window else short_masks
                w = min(window, len(ids))
                n = len(ids) - w + 1
                for first, last in pieces(n):
                    words = ids[first : last + w - 1]
                    seeds, at = _grouped([seed_hashes(words, m, (*masks, *short_masks).index(m)) for m in own])
                    pairs = pa.StructArray.from_arrays([pa.array(seeds.view(np.int64)), at], names=["seed", "at"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()], pa.string()),
                            pa.array([item.as_py()], pa.int64()),
                            pa.array([first], pa.int32()),
                            pa.array([first > 0]),
                            pa.array([last < n]),
                            pa.array([words.view(np.int64)], pa.list_(pa.int64())),
                            pa.ListArray.from_arrays(pa.array([0, len(seeds)], pa.int32()), pairs),
                        ],
                        names=["name", "item", "piece", "more_before", "more_after", "words", "seeds"],
                    )

    return items.distinct().select("name", F.xxhash64("name", "text").alias("item"), "text").mapInArrow(run, schema)


def _grouped(found: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """(distinct seeds, the places of each)."""
    seeds, at = np.concatenate(found), np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
    order = np.argsort(seeds, kind="stable")
    seeds, at = seeds[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]])) if len(seeds) else np.empty(0, np.int64)
    return seeds[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(seeds)).astype(np.int32)), pa.array(at))


def _bitmap(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap of two bits for each seed); what comes back has 2 ** MOST_BITS bits at most."""
    n = seeds.agg(F.approx_count_distinct("seed")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))  # two of 64 bits a seed: one in a thousand others passes
    at = [F.shiftrightunsigned("seed", 64 - bits), F.shiftrightunsigned("seed", 5).bitwiseAND(F.lit((1 << bits) - 1))]
    both = seeds.select(F.explode(F.array(*at)).alias("at"))
    words = both.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return bits, out


def _text_seeds(docs: DataFrame, bits: int, bitmap: np.ndarray, masks: tuple[str, ...], window: int) -> DataFrame:
    """For each stretch of a text in which seeds pass the bitmap, with `window` - 1 words on
    both sides, its pieces: key, start (the first word's place), text_before and text_after
    (whether the stretch goes on there), words (hashes) and seeds: array of (seed, places)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = "__d long, __t long, start int, text_before boolean, text_after boolean, words array<bigint>, seeds array<struct<seed:bigint,places:array<int>>>"
    pad, longest = window - 1, max(map(len, masks))

    def run(batches):
        bitmap, hashes = shared.value, WordHashes()
        for batch in batches:
            for part in text_slices(batch.column(2), SLICE):
                parts = [hashes.of(text.as_py() or "") for text in batch.column(2)[part]]
                gap = np.zeros(longest, np.uint64)  # no window of a text reaches into the next one
                ids = np.concatenate([x for p in parts for x in (p, gap)])
                starts = np.cumsum([0] + [len(p) + longest for p in parts])
                place, seed = [], []
                for k, mask in enumerate(masks):
                    h = seed_hashes(ids, mask, k)
                    b = _bit(h, bits, 0)
                    some = np.flatnonzero(bitmap[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1))
                    b = _bit(h[some], bits, 1)
                    some = some[(bitmap[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    doc = np.searchsorted(starts, some, "right") - 1
                    some = some[some + len(mask) <= starts[doc + 1] - longest]
                    place.append(some)
                    seed.append(h[some])
                place, seed = np.concatenate(place), np.concatenate(seed)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                doc = np.searchsorted(starts, place, "right") - 1
                low = np.maximum(place - pad, starts[doc])
                high = np.minimum(place + longest + pad, starts[doc + 1] - longest)
                new = np.ones(len(place), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (low[1:] >= np.maximum.accumulate(high)[:-1])
                cuts = np.append(np.flatnonzero(new), len(place))
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    at, end, begin = low[a], high[a:b].max(), starts[doc[a]]
                    n = max(1, end - at - pad)
                    for first, last in pieces(n):
                        from_, to = at + first, min(end, at + last + pad)
                        x, y = a + np.searchsorted(place[a:b], [from_, to])
                        if x < y:
                            got, where = _grouped_at(seed[x:y], place[x:y] - from_)
                            rows.append((part.start + doc[a], int(from_ - begin), first > 0, last < n, ids[from_:to].view(np.int64), got, where))
                yield _segments(batch, rows)

    return docs.select(*KEY, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _grouped_at(seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(seeds, kind="stable")
    seeds, at = seeds[order], at[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
    return seeds[first], np.split(at, first[1:])


def _segments(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
    doc, start, before, after, words, seeds, places = zip(*rows)
    pairs = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(seeds).view(np.int64)), pa.array([p for own in places for p in own], pa.list_(pa.int32()))], names=["seed", "places"]
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in seeds])]).astype(np.int32))
    doc = pa.array(list(map(int, doc)))
    columns = [
        batch.column(0).take(doc),
        batch.column(1).take(doc),
        pa.array(start, pa.int32()),
        pa.array(list(map(bool, before))),
        pa.array(list(map(bool, after))),
        pa.array(list(words), pa.list_(pa.int64())),
        pa.ListArray.from_arrays(offsets, pairs),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*KEY, "start", "text_before", "text_after", "words", "seeds"])


def shifts_of(hits, most: int = 4_000_000) -> np.ndarray:
    """The distinct differences of places, taken in blocks of `most` pairs."""
    found = []
    for places, at in hits:
        step = max(1, most // max(1, len(at)))
        for k in range(0, len(places), step):
            found.append(np.unique(places[k : k + step, None] - at))
    return np.unique(np.concatenate(found))


def _compared(pairs: DataFrame, window: int, share: float) -> DataFrame:
    """For each two pieces with hits the words of the longest overlap inside them (n), and
    the overlaps that reach an edge where either goes on: shift (place in the text less
    that in the item), low and high (first and last window in the item) and width (words
    of a window)."""
    schema = "__d long, __t long, name string, item long, n int, shift long, low long, high long, width int"

    def run(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                key = [batch.column(k)[r].as_py() for k in range(4)]
                start, before, after, piece, more_before, more_after = (batch.column(k)[r].as_py() for k in range(4, 10))
                words, own = (batch.column(k)[r].values.to_numpy() for k in (10, 11))
                hits = batch.column(12)[r].values
                places, ats = (hits.field(k) for k in (0, 1))
                width, best = min(window, len(own)), 0
                for shift in shifts_of([(p.values.to_numpy(), a.values.to_numpy()) for p, a in zip(places, ats)]).tolist():
                    a, b, lows, highs = good_runs(own, words, shift, window, share)
                    for low, high in zip(lows.tolist(), highs.tolist()):
                        on_left = low == a and ((a == 0 and more_before) or (a == -shift and before))
                        on_right = high == b and ((b == len(own) - width + 1 and more_after) or (b == len(words) - shift - width + 1 and after))
                        if on_left or on_right:
                            out.append((*key, None, start + shift - piece, piece + low, piece + high, width))
                        else:
                            best = max(best, high - low + width - 1)
                if best:
                    out.append((*key, best, None, None, None, None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "name", "item", "n", "shift", "low", "high", "width"])

    given = pairs.select(*KEY, "name", "item", "start", "text_before", "text_after", "piece", "more_before", "more_after", "words", "own", "hits")
    found = cut(given.mapInArrow(run, schema))
    inside = found.filter("n IS NOT NULL").select(*KEY, "name", "n")
    # runs of one alignment that touch or overlap are one
    order = Window.partitionBy(*KEY, "item", "shift").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.filter("n IS NULL").withColumn("new", F.coalesce(F.col("low") > reached, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(*KEY, "name", "item", "shift", "run").agg((F.max("high") - F.min("low") + F.max("width") - 1).cast("int").alias("n"))
    return inside.union(joined.select(*KEY, "name", "n"))


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__t": F.xxhash64(text)})


def overlap_lengths(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 12,
    share: float = 0.8,
    min_words: int = 8,
    masks: tuple[str, ...] = MASKS,
    short_masks: tuple[str, ...] = SHORT_MASKS,
) -> DataFrame:
    """(__d, __t, name, n): for each document of with_key() and each item that overlaps
    with it the words of the longest overlap.

    An item overlaps a text if, aligned word by word at some place, some `window`
    neighbouring words (the whole item if it is shorter) have at least `share` of
    them equal; case and all but word characters are ignored, and words are
    compared by 64-bit hashes.  Items of fewer than `min_words` words are too short
    to tell a leak.  Null texts and items have no words.  Items that share an id
    count as one; a null id is the empty one.
    """
    checked(window, share, min_words, masks, short_masks)
    items = cut(_item_pieces(benchmark, min_words, masks, short_masks, window))
    seeds = items.select("item", "piece", F.explode("seeds").alias("s")).select("item", "piece", "s.seed", "s.at")
    segments = cut(_text_seeds(docs, *_bitmap(seeds), (*masks, *short_masks), window))
    one = segments.select(*KEY, "start", F.explode("seeds").alias("s")).select(*KEY, "start", "s.seed", "s.places")
    # shuffled on both sides, whatever their estimated sizes: a hot seed's rows can be split, nothing is broadcast
    hits = one.join(seeds.hint("merge"), "seed").groupBy(*KEY, "start", "item", "piece").agg(F.collect_list(F.struct("places", "at")).alias("hits"))
    pairs = hits.join(segments.drop("seeds").hint("merge"), [*KEY, "start"])
    pairs = pairs.join(items.drop("seeds").withColumnRenamed("words", "own").hint("merge"), ["item", "piece"])
    return _compared(pairs, window, share).groupBy(*KEY, "name").agg(F.max("n").alias("n"))


def overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All rows and columns of docs with __hits: map from item_id to the words of the longest
    overlap, empty for no overlap.  See overlap_lengths() for what counts and the options.

    Rows that repeat an id and a text get the same result; a null id counts as one of its own.
    """
    checked(**options)
    named = with_key(docs)
    found = overlap_lengths(named, benchmark, **options)
    maps = found.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("__hits"))
    none = F.create_map().cast("map<string,int>")
    return named.join(maps, KEY, "left").select(*map(column, docs.columns), F.coalesce("__hits", none).alias("__hits"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that no item overlaps with."""
    named = with_key(docs)
    found = overlap_lengths(named, benchmark, **options).select(*KEY).distinct()
    return named.join(found, KEY, "left_anti").select(*map(column, docs.columns))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, items (sorted, comma-joined) and longest (words), for each row of docs."""
    named = with_key(docs.select("doc_id", "text"))
    found = overlap_lengths(named, benchmark, **options)
    of = found.groupBy(*KEY).agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("items"), F.max("n").cast("long").alias("longest")
    )
    return named.select("doc_id", *KEY).join(of, KEY, "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of contaminated()."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
