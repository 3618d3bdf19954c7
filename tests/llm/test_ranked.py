"""Ranked search against scores of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rankvane.llm import ranked as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, limit=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in found)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in found:
            if not c:
                continue
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc))
        out += [(item, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scores, key=lambda x: (x[0], -(2**63) if x[1] is None else x[1]))[:limit])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed, shard, block", [(0, 400, 7), (1, 3000, 50), (2, 10**6, 10**6)])
def test_as_all_scores(spark, seed, shard, block):
    rng = random.Random(seed)
    words = ["the", "of", "Ünder", "x9", "日本"] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choices(words, [40, 30, 5, 5, 5] + [1] * 60, k=n))
    docs = [(d, text(rng.choice([0, 1, 5, 30, 80]))) for d in rng.sample(range(10_000), 300)]
    docs += [(d + 20_000, t) for d, t in docs[:40]] + [(None, text(9)), (77_777, None), (77_778, " -.,\n"), (77_779, "THE the,the\x00of")]
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(12)] + [(50, None), (51, "nothing-of.this occurs"), (52, "w1 w1 w1 W1 w2"), (None, "w3 the")]
    d, i = tables(spark, docs, items)
    assert rows(R.rank_documents(d.repartition(4), i, shard_bytes=shard, block_terms=block)) == plain(docs, items)


def test_ties_and_repeated_rows(spark):
    docs = [(d, "same words here") for d in range(50, 0, -1)] + [(7, "same words here")] + [(d, "other") for d in range(100, 200)]
    items = [(1, "same"), (1, "same"), (2, "words words")]
    d, i = tables(spark, docs, items)
    got = rows(R.rank_documents(d.repartition(3), i))
    assert got == plain(docs, items)
    assert [r[2] for r in sorted(got)[:40:2]] == [1, 2, 3, 4, 5, 6, 7, 7, *range(8, 20)]


def test_empty(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "...")], [(1, "a")])):
        out = R.rank_documents(*tables(spark, docs, items))
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_a_long_text_and_a_long_item(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 1000)
    rng = random.Random(5)
    long_ = " ".join(f"t{rng.randrange(5000)}" for _ in range(40_000))
    docs = [(1, long_), (2, "t1 t2 t3"), (3, long_[:30_000])]
    items = [(1, long_), (2, "t4999")]
    assert rows(R.rank_documents(*tables(spark, docs, items))) == plain(docs, items)


def test_packed_numbers_come_back():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62, 5])
    raw, sizes = R.pack(x)
    assert R.unpack(raw).tolist() == x.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 9, 1]
    assert R.unpack(R.pack(np.empty(0, np.int64))[0]).tolist() == []
