"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are lower-cased characters of the whole of Unicode, the order is 5, and
no n-gram is dropped, so the model grows with the corpus.  It is never gathered
in one place: counts are summed by n-gram across the cluster, the levels of the
model are joins of n-grams with their contexts and suffixes, and to score, the
documents are dealt into slices that ask for their distinct n-grams.  The
answers come back by a join on the n-gram and meet the slice's texts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

ORDER = 5
#: stands before and behind a text; no character of Unicode
EDGE = "￿"
#: characters in a slice of documents that ask together, and in what is worked on at once
SLICE_CHARS, PIECE_CHARS = 8_000_000, 500_000
#: languages are dealt into so many families, so that slices share most of their n-grams
FAMILIES = 64


def pieces(texts: list[str], limit: int):
    """(code points with edges, first n-gram of each text, number of the text) in
    bounded pieces; a longer text is continued in the next piece."""
    parts, size = [], 0
    for i, text in enumerate(texts):
        framed = EDGE * (ORDER - 1) + text.lower() + EDGE
        for at in range(0, len(framed) - ORDER + 1, limit):
            part = np.frombuffer(framed[at : at + limit + ORDER - 1].encode("utf-32-le"), np.uint32)
            if parts and size + len(part) > limit:
                yield _piece(parts)
                parts, size = [], 0
            parts.append((i, part))
            size += len(part)
    if parts:
        yield _piece(parts)


def _piece(parts):
    sizes = np.array([len(p) for _, p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    points = np.concatenate([p for _, p in parts])
    whole = np.ones(len(points), bool)  # places where an n-gram begins that stays in its text
    for k in range(1, ORDER):
        whole[starts + sizes - k] = False
    firsts = np.cumsum(sizes - ORDER + 1) - (sizes - ORDER + 1)
    return points, np.flatnonzero(whole), firsts, np.array([i for i, _ in parts])


class Coder:
    """Gives the n-grams of some texts distinct numbers below 2**63.

    Characters are numbered among those that occur; where the product of the
    alphabet's sizes would overflow, the prefixes that occur are numbered first.
    """

    def __init__(self, texts: list[str], piece: int = PIECE_CHARS, limit: int = 2**63):
        self.texts, self.piece = texts, piece
        seen = np.zeros(0x110000, bool)
        for points, *_ in pieces(texts, piece):
            seen[points] = True
        self.points = np.flatnonzero(seen).astype(np.uint32)
        self.number = np.full(0x110000, -1, np.int64)
        self.number[self.points] = np.arange(len(self.points))
        self.prefixes: dict[int, np.ndarray] = {}
        size = max(1, len(self.points))
        for k in range(1, ORDER):
            if size * len(self.points) >= limit:
                found = [np.unique(self._fold(self._columns(points, at), k)) for points, at, *_ in pieces(texts, piece)]
                self.prefixes[k] = np.unique(np.concatenate(found))
                size = len(self.prefixes[k])
            size *= max(1, len(self.points))

    def _columns(self, points, at):
        ids = self.number[points]
        return [ids[at + k] for k in range(ORDER)]

    def _fold(self, columns, length: int) -> np.ndarray:
        out = columns[0]
        for k in range(1, length):
            if k in self.prefixes:
                out = np.searchsorted(self.prefixes[k], out)
            out = out * len(self.points) + columns[k]
        return out

    def coded(self):
        """(numbers of all n-grams, first n-gram of each text, number of the text), piece by piece."""
        for points, at, firsts, text in pieces(self.texts, self.piece):
            yield self._fold(self._columns(points, at), ORDER), firsts, text

    def counted(self) -> tuple[list[str], np.ndarray]:
        """The distinct n-grams and how often each occurs."""
        found = [np.unique(c, return_counts=True) for c, *_ in self.coded()]
        if not found:
            return [], np.empty(0, np.int64)
        codes, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        n = np.bincount(where, np.concatenate([f[1] for f in found])).astype(np.int64)
        return self.grams(codes), n

    def grams(self, codes: np.ndarray) -> list[str]:
        ids = np.empty((len(codes), ORDER), np.int64)
        for k in range(ORDER - 1, 0, -1):
            codes, ids[:, k] = np.divmod(codes, len(self.points))
            if k in self.prefixes:
                codes = self.prefixes[k][codes]
        ids[:, 0] = codes
        text = self.points[ids].tobytes().decode("utf-32-le") if len(ids) else ""
        return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]

    def codes(self, grams: list[str]) -> np.ndarray:
        """The numbers of n-grams that all occur in the texts."""
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        return self._fold(list(self.number[points].T), ORDER)


def pack(docs: DataFrame, names: list[str]) -> DataFrame:
    """Columns `names`, and packed: the text, compressed for the shuffles."""
    typed = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            texts = pa.array([squeeze((x.as_py() or "").encode()) for x in batch.column(len(names))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, "packed"])

    return docs.select(*names, "text").mapInArrow(run, f"{typed}, packed binary")


def unpack(column) -> list[str]:
    import zstandard

    spread = zstandard.ZstdDecompressor().decompress
    return [spread(x.as_py()).decode() for x in column]


def counts(packed: DataFrame) -> DataFrame:
    """(gram, n) over all whole texts; summed in each task's slices before the shuffle.

    An empty text has the n-grams of its edges; repeated rows count as often as they occur;
    without rows there are no n-grams.
    """

    def run(batches):
        texts, size = [], 0

        def done():
            grams, n = Coder(texts).counted()
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for text in unpack(batch.column(0)):
                texts.append(text)
                size += len(text)
                if size >= SLICE_CHARS:
                    yield done()
                    texts, size = [], 0
        if texts:
            yield done()

    return packed.select("packed").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams occur once to four times."""
    of = {r["n"]: r["count"] for r in level.filter("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):  # too regular to estimate
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, most: min(max(d, 0.01), most)
    return bound(1 - 2 * y * n2 / n1, 0.99), bound(2 - 3 * y * n3 / n2, 1.99), bound(3 - 4 * y * n4 / n3, 2.99)


def context(gram: str = "gram", length: int = ORDER) -> Column:
    return F.substring(gram, 1, length - 1)


def suffix(gram: str = "gram", length: int = ORDER) -> Column:
    return F.substring(gram, 2, length - 1)


def levels(top: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For order 1 to ORDER: (gram, own), the discounted share of an n-gram after its
    context, and (context, back), the weight that a context leaves to the lower order."""
    found = [top]
    for k in range(ORDER, 1, -1):  # continuation counts: how many symbols precede the suffix
        found.append(cut(found[-1].groupBy(suffix(length=k).alias("gram")).agg(F.count("*").alias("n"))))
    out = []
    for k, level in enumerate(reversed(found), 1):
        d1, d2, d3 = discounts(level)
        gone = F.least("n", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        rows = level.select("gram", context(length=k).alias("context"), (F.col("n") - gone).alias("rest"), gone.alias("gone"), "n")
        contexts = rows.groupBy("context").agg(F.sum("n").alias("all"), F.sum("gone").alias("gone"))
        own = rows.select("gram", "context", "rest").join(contexts.select("context", "all"), "context")
        out.append((own.select("gram", (F.col("rest") / F.col("all")).alias("own")), contexts.select("context", (F.col("gone") / F.col("all")).alias("back"))))
    return out


def probabilities(asked: DataFrame, top: DataFrame) -> DataFrame:
    """(gram, p) for each distinct n-gram of order ORDER in `asked`, seen or not.

    The lowest order falls back to equal shares for all symbols and one unknown one.
    """
    symbols = top.select(F.substring("gram", ORDER, 1)).distinct().count() + 1
    wanted = [cut(asked.select("gram").distinct())]
    for k in range(ORDER, 1, -1):
        wanted.append(wanted[-1].select(suffix(length=k).alias("gram")).distinct())
    lower = None
    for k, (rows, (own, contexts)) in enumerate(zip(reversed(wanted), levels(top)), 1):
        rows = rows.withColumns({"context": context(length=k), "suffix": suffix(length=k)})
        rows = rows.join(own, "gram", "left").join(contexts, "context", "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / symbols))
        else:
            rows = rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        # an unseen context leaves all to the lower order
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("below")
        lower = rows.select("gram", p.alias("p"))
    return cut(lower)


def sliced(docs: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """docs with `slice`: documents of one family of languages with about slice_chars characters."""
    family = F.pmod(F.xxhash64(F.coalesce("lang", F.lit(""))), F.lit(FAMILIES)).cast("int")
    sizes = docs.groupBy(family.alias("family")).agg(F.sum(F.length("text")).alias("chars")).collect()  # FAMILIES rows at most
    shares = [1] * FAMILIES
    for r in sizes:
        shares[r["family"]] = 1 + (r["chars"] or 0) // slice_chars
    own = F.element_at(F.array(*map(F.lit, shares)), family + 1)
    # rows that repeat an id are dealt out by where they are read
    place = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), own)
    return docs.withColumn("slice", family.cast("long") * (1 << 32) + place)


def perplexities(docs: DataFrame, top: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, lang, n_symbols and perplexity of every whole text; null counts as empty."""
    packed = pack(sliced(docs, slice_chars), ["slice", "doc_id", "lang"])

    def ask(rows: pa.Table) -> pa.Table:
        grams, _ = Coder(unpack(rows.column("packed"))).counted()
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()] * len(grams), pa.int64()), "gram": pa.array(grams, pa.string())})

    asked = cut(packed.groupBy("slice").applyInArrow(ask, "slice long, gram string"))
    known = probabilities(asked, top)
    answers = asked.join(known, "gram").select("slice", "gram", F.log2(F.greatest("p", F.lit(1e-12))).cast("float").alias("bits"))

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = unpack(rows.column("packed"))
        coder = Coder(texts)
        codes, bits = coder.codes(answers.column("gram").to_pylist()), answers.column("bits").to_numpy()
        order = np.argsort(codes)
        codes, bits = codes[order], bits[order].astype(np.float64)
        total = np.zeros(len(texts))
        for piece, firsts, text in coder.coded():
            np.add.at(total, text, np.add.reduceat(bits[np.searchsorted(codes, piece)], firsts))
        n = np.array([len(t.lower()) + 1 for t in texts])
        return pa.table({"doc_id": rows.column("doc_id"), "lang": rows.column("lang"), "n_symbols": pa.array(n), "perplexity": pa.array(2 ** (-total / n))})

    both = packed.groupBy("slice").cogroup(answers.groupBy("slice"))
    return both.applyInArrow(score, "doc_id long, lang string, n_symbols long, perplexity double")


def language_limits(scores: DataFrame, share: float, steps: int = 100) -> DataFrame:
    """(lang, threshold): the perplexity, in 1/steps, that `share` of a language's rows stay within."""
    bins = scores.groupBy("lang", F.ceil(F.col("perplexity") * steps).alias("bin")).agg(F.count("*").alias("n"))
    running = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    reached = bins.select("lang", "bin", F.sum("n").over(running).alias("up_to"), F.sum("n").over(whole).alias("all"))
    return reached.filter(F.col("up_to") >= share * F.col("all")).groupBy("lang").agg((F.min("bin") / steps).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, share: float = 0.99, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept for each row of docs.

    Trusted are documents with quality 1 in `labels`.  The model is trained on
    four fifths of them, chosen by a hash of doc_id; a language's threshold is the
    perplexity that `share` of the others stay within, which the model has not
    seen.  A language (or null) without such documents is held against the highest
    of all thresholds; with none at all everything is kept.  A null text counts as
    empty.  Repeated rows give repeated results.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    known = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    unseen = F.crc32(F.col("doc_id").cast("string")) % 5 == 4
    # the labels grow with the documents: never broadcast, whatever their size here
    top = cut(counts(pack(source, ["doc_id"]).join(known.filter(~unseen).hint("merge"), "doc_id", "left_semi")))
    rows = cut(perplexities(source, top, slice_chars))
    limits = language_limits(rows.join(known.filter(unseen), "doc_id", "left_semi").withColumn("lang", F.coalesce("lang", F.lit(""))), share)
    most = F.coalesce(limits.agg(F.max("threshold")).scalar(), F.lit(float("inf")))
    joined = rows.join(limits.withColumnRenamed("lang", "__lang"), F.coalesce("lang", F.lit("")) == F.col("__lang"), "left").drop("__lang")
    joined = joined.withColumn("threshold", F.coalesce("threshold", most))
    return joined.withColumn("kept", F.col("perplexity") <= F.col("threshold"))


def op8_kneser_ney_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, perplexity, the language's threshold, kept."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("perplexity", 6).alias("perplexity"), "threshold", "kept")
