import math
import random
from collections import Counter, defaultdict

import pytest

from rankvane.llm import perplexity as P


def windows(text):
    s = P.EDGE * (P.ORDER - 1) + text.lower() + P.EDGE
    return [s[i : i + P.ORDER] for i in range(len(s) - P.ORDER + 1)]


def brute(trusted, texts):
    """Perplexities under the interpolated modified Kneser-Ney model, from its formulas."""
    top = Counter(w for t in trusted for w in windows(t))
    levels = [top]
    for _ in range(P.ORDER - 1):
        levels.append(Counter(w[1:] for w in levels[-1]))
    levels.reverse()
    symbols = len({w[-1] for w in top}) + 1
    tables = []
    for level in levels:
        n = [sum(v == k for v in level.values()) for k in range(5)]
        d = (0.5, 0.75, 0.9)
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = tuple(min(max(x, 0.01), m) for x, m in zip((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]), (0.99, 1.99, 2.99)))
        total, gone = defaultdict(int), defaultdict(float)
        cut = {w: min(v, d[min(v, 3) - 1]) for w, v in level.items()}
        for w, v in level.items():
            total[w[:-1]] += v
            gone[w[:-1]] += cut[w]
        tables.append((level, cut, total, gone))

    def p(w, k):
        if not k:
            return 1 / symbols
        level, cut, total, gone = tables[k - 1]
        w = w[-k:]
        if w[:-1] not in total:
            return p(w, k - 1)
        own = (level[w] - cut[w]) / total[w[:-1]] if w in level else 0
        return own + gone[w[:-1]] / total[w[:-1]] * p(w, k - 1)

    return [2 ** -(sum(math.log2(p(w, P.ORDER)) for w in windows(t)) / len(windows(t))) for t in texts]


def corpus():
    rng = random.Random(4)
    words = ["the", "Fluß", "été", "one", "two", "日本", "x9", "İ", "😀"]
    rows = [(i, " ".join(rng.choices(words[: 3 + i % 7], k=rng.randint(0, 40))), ["en", "de", None][i % 3]) for i in range(60)]
    return rows + [(60, None, "en"), (61, "", "zz"), (62, "$$$###" * 30, "en"), (None, "the one", "en"), (1, rows[1][1], "de"), (63, "a\x00b\x00", "de")]


@pytest.mark.parametrize("slice_chars", [P.SLICE_CHARS, 200])
def test_matches_the_formulas(spark, slice_chars):
    rows = corpus()
    trusted = [r for r in rows[:60] if r[0] % 2]
    source = spark.createDataFrame([(d, t or "", g) for d, t, g in rows], "doc_id long, text string, lang string")
    top = P.cut(P.counts(P.pack(spark.createDataFrame([(d, t, g) for d, t, g in trusted], source.schema), ["doc_id"])))
    got = P.perplexities(source, top, slice_chars).collect()
    want = brute([t for _, t, _ in trusted], [t or "" for _, t, _ in rows])
    key = lambda x: (str(x[0]), str(x[1]), x[2])
    a = sorted(((r["doc_id"], r["lang"], r["perplexity"]) for r in got), key=key)
    b = sorted(((d, g, p) for (d, _, g), p in zip(rows, want)), key=key)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], rel=1e-5)


@pytest.mark.parametrize("piece, limit", [(2_000_000, 2**63), (40, 2**63), (7, 2**63), (40, 500), (1000, 3000)])
def test_coder_counts_every_gram(piece, limit):
    texts = [t or "" for _, t, _ in corpus()]
    coder = P.Coder(texts, piece, limit)
    grams, n = coder.counted()
    want = Counter(w for t in texts for w in windows(t))
    assert dict(zip(grams, n.tolist())) == dict(want)
    assert (coder.grams(coder.codes(grams)) == grams)


def test_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, _, _ in rows[:60]] + [(62, 0), (None, 1)], "doc_id long, quality int")
    got = P.judge(docs, labels, share=1.0).collect()
    assert len(got) == len(rows)
    assert [r["kept"] for r in got if r["doc_id"] == 62] == [False]
    none = P.judge(docs, labels.filter("quality = 7")).collect()
    assert len(none) == len(rows) and all(r["kept"] for r in none)
