"""Jaccard components against all pairs of sets."""

import random

import numpy as np
import pytest

from rankvane.llm import jaccard as J


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def plain(docs, percent=90):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 2**63), -(2**63) if d is None else d)
    back = lambda x: None if x == -(2**63) else x
    return sorted(((d, len(s), back(least[find(i)])) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def changed(rng, words, share):
    words = list(words)
    for _ in range(max(1, int(share * len(words)))):
        k = rng.randrange(len(words))
        words[k : k + rng.choice([0, 1, 1])] = [f"n{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
    return words


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = words(60)
    texts = []
    for _ in range(25):
        base = words(rng.choice([4, 9, 12, 20, 60, 200, 500])) + (passage if rng.random() < 0.4 else [])
        texts.append(base)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(changed(rng, base, share))
    hub = words(150)
    texts += [changed(rng, hub, rng.choice([0.01, 0.02, 0.04])) for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    texts += texts[:10] + ["", None, " \n\t ", "one", "One", "one two", "two one", "ONE\ttwo", "a b c", "a b c a b c", "Été a b", "été a b"]
    rng.shuffle(texts)
    return [(d, t) for d, t in enumerate(texts)] + [(None, texts[0])]


@pytest.mark.parametrize("seed", range(3))
def test_as_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(J.jaccard_components(df)) == plain(docs)


@pytest.mark.parametrize("parts", [33, 0])
def test_large_clusters_in_blocks_and_by_keys(spark, monkeypatch, parts):
    monkeypatch.setattr(J, "MOST_PARTS", parts)
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(J.jaccard_components(df, shard_limit=8)) == plain(docs)


def test_no_link_is_lost_by_the_keys():
    rng = np.random.default_rng(1)
    for _ in range(600):
        n = int(rng.integers(10, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        gone, more = rng.integers(0, max(2, n // 12), 2)
        b = np.unique(np.concatenate([rng.permutation(a)[int(gone) :], rng.integers(0, 2**63, int(more), dtype=np.uint64)]))
        frequent = np.zeros(J.COUNTERS, bool)
        frequent[rng.integers(0, J.COUNTERS, 1)] = True
        frequent[(rng.permutation(a)[: int(rng.integers(0, n))] & np.uint64(J.COUNTERS - 1)).astype(np.int64)] = True
        both = len(np.intersect1d(a, b))
        if len(a) + len(b) > 2 * both and 100 * both >= 90 * (len(a) + len(b) - both):
            assert set(J.segment_keys(a, frequent, 90)) & set(J.segment_keys(b, frequent, 90))


@pytest.mark.parametrize("bits", [1 << 28, 1 << 12])
def test_trees_find_the_links_of_all_pairs(monkeypatch, bits):
    monkeypatch.setattr(J, "TASK_BITS", bits)
    rng = np.random.default_rng(bits % 1000)
    base = [np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (40, 80, 150, 300)]
    sets = []
    for k in range(400):
        b = base[k % 4]
        sets.append(np.unique(np.concatenate([rng.permutation(b)[rng.integers(0, len(b) // 12) :], rng.integers(0, 2**63, rng.integers(0, len(b) // 12), dtype=np.uint64)])))
    a, b = J.SignatureTree(sets, 90).links()
    root = np.arange(400)
    J.SignatureTree._hook(root, a, b)
    want = np.arange(400)
    pairs = [(i, j) for i in range(400) for j in range(i) if 190 * len(np.intersect1d(sets[i], sets[j])) >= 90 * (len(sets[i]) + len(sets[j]))]
    J.SignatureTree._hook(want, *np.array(pairs).T)
    assert (root == want).all() and len(set(want)) > 4


def test_sizes_of_linked_sets_meet_in_a_step():
    for a in range(1, 400):
        for b in range(a, a * 100 // 90 + 1):
            d = J.allowed(b, 90)
            mine, theirs = ({s: (k, spare) for s, k, spare in J.steps_of(x, 90)} for x in (a, b))
            if d:
                step = min(theirs)
                assert mine[step] == theirs[step] and theirs[step][0] - d > theirs[step][1] - 1
