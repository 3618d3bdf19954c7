"""Toxicity: a convolutional text classifier trained in numpy and applied in Spark tasks.

Words are hashed to embedding rows; filters of several widths slide over the
word sequence, each keeps its largest response over the whole text, and a
logistic layer weighs the responses.  The fit uses a bounded sample of labelled
rows, the thresholds all that were set aside for them; every text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_texts, table

WORDS = re.compile(r"\w+").findall
#: score from which a document counts as toxic where no threshold was calibrated
DEFAULT_THRESHOLD = 0.3
#: scores that can become a language's threshold
STEPS = np.linspace(0.05, 0.95, 91)


@dataclass(frozen=True)
class Params:
    """Sizes of the model and of the bounded sample that it is fitted on."""

    buckets: int = 1 << 16
    dims: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 5
    rate: float = 0.05
    batch: int = 32
    #: labelled rows of each class used for the fit
    fit_rows: int = 3000
    #: characters of the longest text that is fitted on; longer ones are only scored
    fit_chars: int = 50_000


class Buckets(dict):
    """word -> embedding row; row 0 stands for the space around a text."""

    def __init__(self, buckets: int, limit: int = 300_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = 1 + zlib.crc32(word.encode()) % (self.buckets - 1)
        return value


def word_rows(text: str, rows: Buckets) -> np.ndarray:
    words = WORDS(text.lower())
    return np.fromiter(map(rows.__getitem__, words), np.int32, len(words))


class TextCnn:
    def __init__(self, p: Params, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p, self.shift, self.learned = p, 0.0, True
        self.e = rng.normal(0, 0.1, (p.buckets, p.dims)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, 1 / np.sqrt(w * p.dims), (p.filters, w * p.dims)).astype(np.float32) for w in p.widths]
        self.b = [np.zeros(p.filters, np.float32) for _ in p.widths]
        self.v = rng.normal(0, 0.3, len(p.widths) * p.filters).astype(np.float32)
        self.c = np.float32(0)

    @staticmethod
    def joined(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows one after another, `pad` zeros behind each text, and where each begins."""
        sizes = np.array([len(d) + pad for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.zeros(sizes.sum() + pad, np.int32)
        for d, s in zip(docs, starts):
            rows[s : s + len(d)] = d
        return rows, starts

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> TextCnn:
        p, rng = self.p, np.random.default_rng(seed)
        self._evidence(docs, y)
        pad = max(p.widths)
        sums = {id(x): np.full(x.shape, 1e-3, np.float32) for x in (self.e, *self.w, *self.b, self.v)}
        sum_c = 1e-3

        def step(x, at, g):
            s = sums[id(x)]
            s[at] += g * g
            x[at] -= p.rate * g / np.sqrt(s[at])

        for _ in range(p.epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), p.batch):
                some = order[k : k + p.batch]
                rows, starts = self.joined([docs[i] for i in some], pad)
                x = self.e[rows]
                sizes = np.diff(np.append(starts, len(rows) - pad))
                pooled, places = [], []
                for w, f, b in zip(p.widths, self.w, self.b):
                    wide = np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(0, 2, 1).reshape(len(x) - w + 1, -1)
                    conv = wide @ f.T + b
                    place = np.stack([s + conv[s : s + n - w + 1].argmax(0) for s, n in zip(starts, sizes)])
                    places.append((wide, place))
                    pooled.append(np.take_along_axis(conv, place, 0))
                h = np.maximum(np.concatenate(pooled, 1), 0)
                z = h @ self.v + self.c
                g = ((1 / (1 + np.exp(-z)) - y[some]) / len(some)).astype(np.float32)
                gh = g[:, None] * self.v * (h > 0)
                ge = np.zeros((len(rows), p.dims), np.float32)
                for n, (w, f, b) in enumerate(zip(p.widths, self.w, self.b)):
                    wide, place = places[n]
                    part = gh[:, n * p.filters : (n + 1) * p.filters]
                    gf = np.einsum("df,dfx->fx", part, wide[place])
                    gx = (part[:, :, None] * f).reshape(len(some), p.filters, w, p.dims)
                    for o in range(w):
                        np.add.at(ge, place + o, gx[:, :, o])
                    step(f, slice(None), gf + 1e-4 * f)
                    step(b, slice(None), part.sum(0))
                step(self.v, slice(None), h.T @ g + 1e-3 * self.v)
                sum_c += float(g.sum()) ** 2
                self.c -= np.float32(p.rate * g.sum() / np.sqrt(sum_c))
                touched = np.flatnonzero(ge.any(1) & (rows > 0))
                at, where = np.unique(rows[touched], return_inverse=True)
                total = np.zeros((len(at), p.dims), np.float32)
                np.add.at(total, where, ge[touched])
                step(self.e, at, total)
        return self

    def _evidence(self, docs, y) -> None:
        """Start the first dimension at each row's shrunken log odds of the two classes."""
        seen = np.zeros((2, self.p.buckets))
        for d, label in zip(docs, y):
            seen[int(label), np.unique(d)] += 1
        n = np.array([[max(1, (y == 0).sum())], [max(1, (y == 1).sum())]])
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        df = seen.sum(0)
        self.e[:, 0] += (0.5 * odds * df / (df + 5)).astype(np.float32)
        self.e[0] = 0
        for f in self.w:  # and half of the filters look at it
            f[: self.p.filters // 2, :: self.p.dims] += 0.5

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset, every embedding row's part of the responses."""
        d = self.p.dims
        return [[self.e @ f[:, o * d : (o + 1) * d].T for o in range(w)] for w, f in zip(self.p.widths, self.w)]

    def scores(self, docs: list[np.ndarray], tables=None) -> np.ndarray:
        tables, pad = tables or self.tables(), max(self.p.widths)
        rows, starts = self.joined(docs, pad)
        pooled, n = [], len(rows) - pad
        behind = np.append(starts[1:], n)
        for parts, b in zip(tables, self.b):
            conv = parts[0][rows[: n + 1]]
            for o, t in enumerate(parts[1:], 1):
                conv += t[rows[o : o + n + 1]]
            # the windows that would reach into the next text are left out
            cuts = np.stack([starts, behind - len(parts) + 1], axis=1).ravel()
            pooled.append(np.maximum.reduceat(conv, cuts, axis=0)[::2] + b)
        z = np.maximum(np.concatenate(pooled, 1), 0) @ self.v + self.c + self.shift
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def fold(doc_id: str = "doc_id") -> Column:
    """0 and 1 are fitted on, 2 is held out, 3 is for the thresholds."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def known(labels: DataFrame) -> DataFrame:
    """doc_id and label of all rows that may be learned from."""
    return (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
        .filter(fold() != 2)
    )


def texts_of(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))


def labelled(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[list[np.ndarray], np.ndarray, dict[int, int]]:
    """The bounded sample: embedding rows and labels of up to fit_rows documents of each
    class with up to fit_chars characters, chosen by a hash of doc_id; and how many rows
    each class has among all that may be learned from."""
    all_ = known(labels)
    parts = [all_.filter((F.col("label") == label) & (fold() != 3)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.fit_rows) for label in (0, 1)]
    rows = texts_of(docs).join(F.broadcast(parts[0].union(parts[1])), "doc_id")  # at most the sample's size
    order = (F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("text"))
    rows = rows.filter(F.length("text") <= p.fit_chars).orderBy(*order).limit(2 * p.fit_rows)  # an id may have many rows

    def make():
        buckets = Buckets(p.buckets)

        def apply(texts):
            return {"rows": pa.array([word_rows(t, buckets) for t in texts], pa.list_(pa.int32()))}

        return apply

    out = map_texts(rows, make, "rows array<int>", ["doc_id", "label", "lang"]).toArrow()
    texts = [x for chunk in out.column("rows").chunks for x in np.split(chunk.flatten().to_numpy(), np.asarray(chunk.offsets)[1:-1] - chunk.offsets[0].as_py())] if out.num_rows else []
    y, ids = out.column("label").to_numpy().astype(np.float32), out.column("doc_id").to_numpy()
    langs = out.column("lang").to_pylist()
    turn = sorted(range(len(texts)), key=lambda i: (ids[i], langs[i] or "", len(texts[i]), texts[i].tobytes()))
    counts = {r["label"]: r["count"] for r in all_.groupBy("label").count().collect()}
    return [texts[i] for i in turn], y[turn], counts


def fitted(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> TextCnn:
    """The model of the bounded sample; one that gives every text the same score where
    the labels have no rows, or those of one class only."""
    texts, y, counts = labelled(docs, labels, p)
    model = TextCnn(p)
    if 0 < y.sum() < len(y):
        model.fit(texts, y)
        # the sample has more of the rarer class than the labels have
        model.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    else:  # nothing to learn from: every text gets the score of the one class, or 0.5
        model.v[:], model.learned = 0, False
        model.c = np.float32(0 if not len(y) else 4 if y[0] else -4)
    return model


def calibrated(docs: DataFrame, labels: DataFrame, model: TextCnn) -> dict[str, float]:
    """A threshold for each language: the score with the best F1 over all its labelled
    rows of the fold for that; languages with fewer than 20 rows of either class have none.

    The rows are joined with their labels by shuffle and scored in tasks; what comes
    back is a count for each language, label and step of the score.
    """
    rows = texts_of(docs).filter((fold() == 3) & F.col("lang").isNotNull()).join(known(labels), "doc_id")
    step = F.lit(0)
    for at in STEPS.tolist():
        step = step + (F.col("score") >= at).cast("int")
    counts = score_documents(rows, model, ["lang", "label"]).groupBy("lang", "label", step.alias("step")).count()
    kept = [F.coalesce(F.sum(F.when(F.col("label") == label, F.col("count"))), F.lit(0)) >= 20 for label in (0, 1)]
    found = counts.groupBy("lang").agg(F.collect_list(F.struct("label", "step", "count")).alias("steps"), (kept[0] & kept[1]).alias("enough"))
    thresholds = {}
    for r in found.filter("enough").orderBy("lang").collect():
        hits = np.zeros((2, len(STEPS) + 1), np.int64)
        for x in r["steps"]:
            hits[x["label"], x["step"]] += x["count"]
        hits = hits[:, ::-1].cumsum(axis=1)[:, ::-1]  # in column k: rows that reach k steps or more
        right, hit = hits[1, 1:], hits[:, 1:].sum(0)
        f1 = 2 * right / np.maximum(1, hit + hits[1, 0])
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        thresholds[r["lang"]] = float(STEPS[best[len(best) // 2]])
    return thresholds


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[TextCnn, dict[str, float]]:
    """The model and a threshold for each language that has labels enough; the others
    keep DEFAULT_THRESHOLD.

    Labels without doc_id or toxic are left out; of labels that repeat a doc_id the
    greatest counts; a document that repeats the id of a label is learned from in
    each of its rows.  Ties between thresholds go to the middle one.
    """
    model = fitted(docs, labels, p)
    return model, calibrated(docs, labels, model)


def score_documents(docs: DataFrame, model: TextCnn, keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """Columns `keep` and the score (0 to 1) of every whole text in `column`; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.tables()))  # a few MB, set by Params

    def make():
        model, tables = shared.value
        buckets = Buckets(model.p.buckets)

        def apply(texts):
            return {column: model.scores([word_rows(t, buckets) for t in texts], tables)}

        return apply

    return map_texts(docs, make, f"{column} double", keep, slice_chars=500_000)


def toxic_documents(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, lang, score, threshold of the row's language, and flagged, for each row of docs.

    Null texts count as empty; a null or unknown language has DEFAULT_THRESHOLD.
    Repeated rows give repeated results.
    """
    model, thresholds = train(docs, labels, p)
    return score_documents(docs, model, ["doc_id", "lang"]).withColumns(flags(model, thresholds))


def keep_clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, all columns, that toxic_documents() does not flag.

    A null text counts as empty and stays null.  Labels of fewer than two classes teach
    nothing: then nothing is flagged.
    """
    model, thresholds = train(docs, labels, p)
    scored = score_documents(docs, model, docs.columns, "__score")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return scored.filter(~flags(model, thresholds, "__score", lang)["flagged"]).select(*map(column, docs.columns))


def flags(model: TextCnn, thresholds: dict[str, float], score: str = "score", lang: Column | None = None) -> dict:
    lang = F.col("lang") if lang is None else lang
    limit = F.lit(DEFAULT_THRESHOLD)
    for name, value in thresholds.items():
        limit = F.when(lang == name, value).otherwise(limit)
    return {"threshold": limit, "flagged": F.lit(model.learned) & (F.col(score) >= limit)}


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted by the fixed
    threshold, and threshold and flagged by that of the row's language."""
    docs = table(spark, sf_dir, "documents")
    model, thresholds = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, ["doc_id", "lang"]).withColumns(flags(model, thresholds))
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= DEFAULT_THRESHOLD).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )
