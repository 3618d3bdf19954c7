import hashlib
import random

import numpy as np

from rankvane.llm import suffixdedup as S
from rankvane.llm.suffixdedup import deduplicate_bytes


def brute(rows, m):
    """{row number: (n_bytes, n_removed, n_spans, digest)}"""
    least = {}
    for d, t in rows:
        raw, d = (t or "").encode(), -(2**63) if d is None else d
        for i in range(len(raw) - m + 1):
            s = raw[i : i + m]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        raw, d = (t or "").encode(), -(2**63) if d is None else d
        gone = [False] * len(raw)
        for i in range(len(raw) - m + 1):
            if least[raw[i : i + m]] < d:
                gone[i : i + m] = [True] * m
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 30))) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(3)]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.insert(rng.randrange(3), p[a : a + rng.randint(20, 200)])
        rows.append((i, "".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "a" * 400), (205, "a" * 120 + "b"), (206, "ab" * 100)]
    rows += [(207, "ab" * 60), (None, rows[5][1]), (4, rows[6][1]), (208, "x" * 49), (209, "x" * 50), (210, "x" * 50), (211, "a" * 400)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS doc", "'z' AS n_bytes")
        got = sorted((tuple(r) for r in deduplicate_bytes(docs.repartition(3)).collect()), key=repr)
        want = sorted(((d, *b) for (d, _), b in zip(rows, brute(rows, 50))), key=repr)
        assert got == want


def test_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 60), (2, "pre" + "q" * 60 + "é")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in deduplicate_bytes(docs, reports="bytes").collect()}
    assert got == {1: b"q" * 60, 2: "preé".encode()}
    assert deduplicate_bytes(docs.filter("false")).collect() == []


def phrase_everywhere(n):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    return [(i, " ".join([*(word() for _ in range(6)), "released to all under the terms of the common licence of works", *(word() for _ in range(6))])) for i in range(n)]


def test_a_phrase_in_every_document(spark):
    rows = phrase_everywhere(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in deduplicate_bytes(docs).collect())
    assert got == [(d, *b) for (d, _), b in zip(rows, brute(rows, 50))]


def test_a_bucket_gets_two_rows_of_a_slice():
    rows = phrase_everywhere(300)
    s = S.Suffixes([t.encode() for _, t in rows], 50, 30, 9)
    doc = np.array([d for d, _ in rows])[s.text]
    some, known = S._merged(doc, s.bucket, s.run)
    bucket, run = s.bucket[some], s.run[some]
    assert max(np.unique(bucket[~known], return_counts=True)[1]) > 100  # so many differ around the phrase
    grouped = ~known & ~S._inner(bucket, run, known)
    assert max(np.unique(bucket[grouped], return_counts=True)[1]) == 2


def test_negative_and_smallest_ids(spark):
    rows = [(-1, "z" * 70), (0, "z" * 70), (-5, "z" * 60), (3, "q" + "z" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in deduplicate_bytes(docs.coalesce(1)).collect())
    assert got == sorted((d, *b) for (d, _), b in zip(rows, brute(rows, 50)))
