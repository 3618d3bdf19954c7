"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes.

The suffixes of all texts are grouped by the first `match` bytes in steps, and
every step works only on suffixes that are still in a bucket with others.

1. Initial buckets.  In every `match`-byte window one position is chosen from
   the window's content alone (the place of its least t-gram, modulo the number
   of gram places), so equal windows choose equal places.  The q-gram there is
   the suffix's first bucket.  Buckets with a single refined member are final.
2. First refinement.  A run of windows that chose the same place is refined by
   the identifier of all the bytes that the run covers.  Within such a bucket
   all but the smallest doc_id lose the run.
3. Second refinement, only for the smallest documents of buckets that were
   split: each window is refined by the identifiers of its later offsets, built
   by doubling from those of half the length.

Rows are merged inside a task's slice before each shuffle: of equal suffixes
only the smallest doc_id asks, the others are known to be removed.  A slice in
which a bucket holds several suffixes knows that it is split: it sends the least
and the greatest of them to the bucket, and the others go on to the second
refinement without it.  So a bucket gets two rows from each slice at most, however
often a passage occurs and whatever surrounds it.

Equal bytes are told by two independent 64-bit identifiers together: a run by that of
its bucket and its own (two runs of one bucket differ in the latter), a window by both.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_back, keyed, table, text_slices

#: bytes whose arrays are worked on at once, so that they stay in the processor's cache
CHUNK = 40_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: for each of the two identifiers: the base, and a value of each byte
_BASES = (0xD1B54A32D192ED03, 0xA0761D6478BD642F)
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


class Grams:
    """Identifiers of the n-grams at all positions of a byte string: those of length
    2n come from two of length n, and are kept for the next request."""

    def __init__(self, x: np.ndarray, which: int = 0):
        self.n, self.base, self.known = len(x), _BASES[which], {1: np.take(_VALUES[which], x)}

    def of(self, n: int) -> np.ndarray:
        if n not in self.known:
            half = 1 << (n - 1).bit_length() - 1  # the largest power of two below n
            m = max(0, self.n - n + 1)
            a, b = self.of(half), self.of(n - half)
            self.known[n] = a[:m] + np.uint64(pow(self.base, half, 1 << 64)) * b[half : half + m]
        return self.known[n]


class Suffixes:
    """The bucketed suffixes of some texts.

    A run are neighbouring windows that chose the same place: `text` (number),
    `start` and `end` (of the windows' first bytes, in the joined texts),
    `bucket` (by the second identifier) and `run` (the first one of all bytes that its windows
    cover).
    """

    def __init__(self, raws: list[bytes], match: int, q: int, t: int):
        x = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.array([len(r) for r in raws])
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.match, n = match, len(x) - match + 1
        if n <= 0:
            self.text = self.start = self.end = self.bucket = self.run = np.empty(0, np.int64)
            self.whole = self.whole2 = np.empty(0, np.uint64)
            return
        grams = Grams(x)
        second = Grams(x, 1)
        self.whole, self.whole2 = grams.of(match), second.of(match)
        width = match - t + 1
        best = (_mix(grams.of(t)) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(x) - t + 1, dtype=np.uint64)
        size = 1
        while size < width:  # the least gram of twice as many places, the leftmost of equal ones
            step = min(size, width - size)
            best = np.minimum(best[:-step], best[step:])
            size += step
        first = np.arange(n)
        place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64) - first
        chosen = first + np.take(np.arange(width) % (match - q + 1), place)
        owner = np.repeat(np.arange(len(raws)), sizes)
        inside = owner[:n] == owner[match - 1 :]
        new = np.ones(n, bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], n)
        own = inside[self.start]
        self.start, self.end = self.start[own], self.end[own]
        self.text = owner[self.start]
        self.bucket = _mix(second.of(q)[chosen[self.start]]).view(np.int64)
        # windows of `match` bytes at most that far apart cover the whole run
        out = _mix(self.whole[self.start] + (self.end - self.start).astype(np.uint64) * _ODD)
        left, at = self.end - self.start - 1, self.start
        while (left > 0).any():
            step = np.minimum(left, match)
            at, left = at + step, left - step
            out = np.where(step > 0, _mix(out * _ODD + self.whole[at]), out)
        self.run = out.view(np.int64)

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, both identifiers) of all windows in the runs that `of` marks."""
        size = (self.end - self.start)[of]
        at = np.repeat(self.start[of] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.repeat(self.text[of], size), self.window_ids(at), _mix(self.whole2[at]).view(np.int64)

    def window_ids(self, at: np.ndarray) -> np.ndarray:
        return _mix(self.whole[at]).view(np.int64)

    def span(self, text: int) -> slice:
        """Its runs; they are in the order of the texts."""
        return slice(*np.searchsorted(self.text, [text, text + 1]))


def _covered(n_bytes: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes lie in one of the [start, end) intervals."""
    steps = np.zeros(n_bytes + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _merged(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows to send, whether each of them is known to be removed): one row for each
    distinct (keys, doc); known are those with a smaller doc of equal keys."""
    order = np.lexsort((doc, *keys[::-1]))
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        k = key[order]
        same &= k[1:] == k[:-1]
    d = doc[order]
    repeat = np.concatenate([[False], same & (d[1:] == d[:-1])])[: len(order)]
    first = np.concatenate([[True], ~same])[: len(order)]
    least = d[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else d
    return order[~repeat], (d > least)[~repeat]


def _aside(doc: np.ndarray) -> np.ndarray:
    """A number above zero for each document: it keeps rows that only pass through out of
    the group that the others form."""
    return ((_mix(doc.view(np.uint64)) >> np.uint64(2)) | np.uint64(1)).view(np.int64)


def _inner(bucket: np.ndarray, run: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows are neither known nor the least or greatest of their bucket."""
    out = np.zeros(len(bucket), bool)
    open_ = np.flatnonzero(~known)
    open_ = open_[np.lexsort((run[open_], bucket[open_]))]
    b = bucket[open_]
    out[open_[1:-1]] = (b[1:-1] == b[:-2]) & (b[1:-1] == b[2:])
    return out


def deduplicate_bytes(docs: DataFrame, match: int = 50, q: int = 30, t: int = 9, reports: str = "digest") -> DataFrame:
    """Remove every byte covered by a `match`-byte string that also starts in a
    document with a smaller doc_id.  One row for each row of docs.

    reports="digest": doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256.  reports="bytes": doc_id and `kept`, the remaining bytes
    (binary, as a cut may fall inside a character).  A null text is empty, a null
    doc_id counts as the smallest; rows that share a doc_id are one document in
    several parts and remove nothing from each other.
    """
    source = keyed(docs)
    lists = _runs(source, match, q, t)
    single = _windows(source, lists, match, q, t)
    digest = reports == "digest"

    def cut_out(batches):
        import pyarrow.compute

        for batch in batches:
            out: list = []
            marked = pyarrow.compute.or_(batch.column(2).is_valid(), batch.column(3).is_valid()).to_pylist()
            texts = batch.column(1)
            for part in text_slices(texts, CHUNK):
                raws = [texts[i].as_py().encode() for i in range(part.start, part.stop)]
                some = [i for i, raw in enumerate(raws) if marked[part.start + i] and len(raw) >= match]
                s = Suffixes([raws[i] for i in some], match, q, t)
                gone = {i: _gone(s, k, len(raws[i]), batch.column(2)[part.start + i], batch.column(3)[part.start + i]) for k, i in enumerate(some)}
                for i, raw in enumerate(raws):
                    kept, spans = raw, 0
                    if i in gone:
                        kept = np.frombuffer(raw, np.uint8)[~gone[i]].tobytes()
                        spans = int(gone[i][0]) + int((gone[i][1:] & ~gone[i][:-1]).sum())
                    out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()) if digest else (kept,))
            columns = list(zip(*out)) if out else [[]] * (4 if digest else 1)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["kept"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types))], names=["doc_id", *names]
            )

    schema = "doc_id long, " + ("n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "kept binary")
    marks = lists.select("doc_id", "gone").join(single, "doc_id", "full")
    out = source.join(marks, "doc_id", "left").select("doc_id", "text", "gone", "windows").mapInArrow(cut_out, schema)
    return out.select(id_back(), *out.columns[1:])


def _gone(s: Suffixes, text: int, n_bytes: int, runs, windows) -> np.ndarray:
    """Which bytes of a text go, by its removed runs and single windows."""
    own, base = s.span(text), s.offset[text]
    starts, ends = [], []
    if runs.is_valid:
        hit = np.isin(s.run[own], runs.values.to_numpy())
        starts.append(s.start[own][hit] - base)
        ends.append(s.end[own][hit] - base + s.match - 1)
    if windows.is_valid:
        at = np.arange(base, base + n_bytes - s.match + 1)
        at = at[np.isin(s.window_ids(at), windows.values.to_numpy())] - base
        starts.append(at)
        ends.append(at + s.match)
    return _covered(n_bytes, np.concatenate(starts), np.concatenate(ends))


def _runs(source: DataFrame, match: int, q: int, t: int) -> DataFrame:
    """For each document with runs that repeat: doc_id, gone (runs that a smaller
    document has) and ask (runs of which it is the first, in buckets with other runs)."""

    def runs(batches):
        for batch in batches:
            for part in text_slices(batch.column(1), 6_000_000):
                texts = batch.column(1)[part]
                ids, found = batch.column(0).to_numpy()[part], []
                for c in text_slices(texts, CHUNK):
                    s = Suffixes([x.as_py().encode() for x in texts[c]], match, q, t)
                    found.append((ids[c.start + s.text], s.bucket, s.run))
                doc, bucket, run = map(np.concatenate, zip(*found))
                rows, known = _merged(doc, bucket, run)
                doc, bucket, run = doc[rows], bucket[rows], run[rows]
                # above zero: known to be removed; below: asks, as the slice knows its bucket to be split
                salt = np.where(known, _aside(doc), np.where(_inner(bucket, run, known), -_aside(doc), 0))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, salt, run, doc)], names=["bucket", "salt", "run", "doc"])

    first = source.mapInArrow(runs, "bucket long, salt long, run long, doc long")
    bucket = Window.partitionBy("bucket", "salt").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = first.select(
        "run",
        "doc",
        "salt",
        (F.first("run").over(bucket) != F.last("run").over(bucket)).alias("split"),
        F.min("doc").over(Window.partitionBy("bucket", "salt", "run")).alias("least"),
    )
    gone = (F.col("salt") > 0) | ((F.col("salt") == 0) & (F.col("doc") > F.col("least")))
    asks = ~gone & ((F.col("salt") < 0) | F.col("split"))
    state = state.select("run", "doc", gone.alias("gone"), asks.alias("asks")).filter("gone or asks")
    lists = state.groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list(F.when(F.col("gone"), F.col("run"))).alias("gone"), F.collect_list(F.when(F.col("asks"), F.col("run"))).alias("ask")
    )
    return cut(lists)


def _windows(source: DataFrame, lists: DataFrame, match: int, q: int, t: int) -> DataFrame:
    """doc_id and windows: identifiers of the windows in its asking runs that a smaller document has."""

    def windows(batches):
        for batch in batches:
            for part in text_slices(batch.column(2), 6_000_000):
                texts, ask = batch.column(2)[part], batch.column(1)[part]
                ids, found = batch.column(0).to_numpy()[part], []
                for c in text_slices(texts, CHUNK):
                    s = Suffixes([x.as_py().encode() for x in texts[c]], match, q, t)
                    hit = np.zeros(len(s.run), bool)
                    for k, runs in enumerate(ask[c]):
                        hit[s.span(k)] = np.isin(s.run[s.span(k)], runs.values.to_numpy())
                    text, w, w2 = s.windows(hit)
                    found.append((ids[c.start + text], w, w2))
                doc, w, w2 = map(np.concatenate, zip(*found))
                rows, known = _merged(doc, w, w2)
                doc, w, w2 = doc[rows], w[rows], w2[rows]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w, w2, np.where(known, _aside(doc), 0), doc)], names=["w", "w2", "salt", "doc"])

    asking = lists.filter(F.size("ask") > 0).select("doc_id", "ask")
    rows = source.join(asking, "doc_id").select("doc_id", "ask", "text").mapInArrow(windows, "w long, w2 long, salt long, doc long")
    removed = rows.select("*", F.min("doc").over(Window.partitionBy("w", "w2", "salt")).alias("least")).filter("salt != 0 or doc > least")
    return cut(removed.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("w").alias("windows")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of deduplicate_bytes()."""
    return deduplicate_bytes(table(spark, sf_dir, "documents"))
