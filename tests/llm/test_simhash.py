import numpy as np
import pytest
import xxhash

from rankvane.llm import simhash as S


def brute_components(fps, ids, distance):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= distance:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {i: find(i) for i in ids}


def brute_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hs = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 300, 700])
def test_index_finds_all_pairs(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(1, n, 2):  # near ones in chains
        fps[i] = fps[i - 1] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
    fps = np.unique(fps)
    for d in (0, 1, 2, 3):
        q, m = S.GrayIndex(fps[:, None]).near(fps[:, None], d)
        got = set(zip(q.tolist(), m.tolist()))
        want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= d}
        assert got == want


def test_gray_rank_is_the_inverse_of_the_gray_code():
    ranks = np.arange(2000, dtype=np.uint64)
    assert (S.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def texts():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(60):
        words = list(rng.choice(vocab, int(rng.integers(1, 400))))
        out.append(" ".join(words))
        for _ in range(i % 4):
            words = list(words)
            words[int(rng.integers(len(words)))] = str(rng.choice(vocab))
            out.append(" ".join(words))
    return out + [None, "", " \t\n", "One", "one", "ONE two", "É é\x0bx", "a b c d"] + out[:5]


@pytest.mark.parametrize("limit", [2048, 3])
def test_components_match_brute_force(spark, limit):
    rows = list(enumerate(texts()))
    rows.append((None, "one two three four"))
    rows.append((7, texts()[7]))  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component_id", "2 AS node")
    got = S.simhash_components(docs, shard_limit=limit).collect()
    assert len(got) == len(rows)
    fps = {(-1 if i is None else i): brute_fingerprint(t or "") for i, t in rows}
    comp = brute_components(list(fps.values()), list(fps), 2)
    for r in got:
        i = -1 if r.doc_id is None else r.doc_id
        assert r.fingerprint == f"{fps[i]:016x}"
        assert (-1 if r.component_id is None else r.component_id) == comp[i]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(docs).collect() == []


def test_wide_index_and_forest_match_brute_force():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    for i in range(1, 300):
        if i % 3:
            fps[i] = fps[i - 1]
            for b in rng.choice(256, 20, replace=False):
                fps[i, b // 64] ^= np.uint64(1 << int(b % 64))
    nodes = rng.permutation(5000)[:300]
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=np.int64)
    q, m = S.GrayIndex(fps).near(fps, 30)
    assert set(zip(q.tolist(), m.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= 30))))
    hi, lo = S.forest(fps, nodes, 30)
    root = {int(n): int(n) for n in nodes}
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(apart <= 30)):
            a, b = root[int(nodes[i])], root[int(nodes[j])]
            if a != b:
                root[int(nodes[i])] = root[int(nodes[j])] = min(a, b)
                changed = True
    got = {int(n): int(n) for n in nodes} | dict(zip(hi.tolist(), lo.tolist()))
    assert got == root


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(40):
        words = list(rng.choice(vocab, 300))
        for c in range(1 + g % 4):
            own = list(words)
            for at in rng.choice(300, 2 * c, replace=False):
                own[at] = "new"
            rows.append((len(rows), " ".join(own), None))
            groups.setdefault(g, []).append(len(rows) - 1)
    rows += [(500, None, "x"), (501, "", "x"), (None, rows[0][1], "y"), (0, rows[0][1], "z")]
    for limit in (4096, 2):
        kept = S.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, fp string"), shard_limit=limit)
        assert kept.columns == ["doc_id", "text", "fp"]
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(set(ids)) == 41
        assert set(ids) == {min(v) for g, v in groups.items() if g} | {None, 500}


def at_similarity(rng, shared, apart):
    """Two word lists whose sets of single words share `shared` and differ in `apart` words."""
    words = rng.choice(10**9, shared + apart, replace=False)
    return words[:shared + apart // 2], np.concatenate([words[:shared], words[shared + apart // 2 :]])


def test_bands_find_pairs_at_the_similarity_at_any_number_of_texts():
    rng, lost = np.random.default_rng(5), 0
    for _ in range(400):
        a, b = (np.unique(S.shingle_hashes(" ".join(map(str, w)), 1)) for w in at_similarity(rng, 160, 40))
        lost += not np.intersect1d(S.band_values(a, 32, 6), S.band_values(b, 32, 6)).size  # keys hold nothing of the corpus
    assert lost <= 1
    assert S.band_values(np.empty(0, np.uint64), 32, 6).size == 0


@pytest.mark.parametrize("limit", [4096, 3])
def test_only_similar_texts_are_dropped(spark, limit):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(40):
        for shared, apart in ((160, 40), (160, 44), (150, 50), (300, 60)):  # 0.80, 0.78, 0.75, 0.83
            rows += [" ".join(map(str, w)) for w in at_similarity(rng, shared, apart)]
    for tail in range(6):  # mostly one phrase: SimHash has one fingerprint for all of them
        rows.append("again and " * 300 + " ".join(map(str, rng.choice(10**9, 30))))
    sets = [set(r.split()) if len(r.split()) < 600 else set(zip(r.split())) for r in rows]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in S.keep_one_of_each(docs, width=1, shard_limit=limit).collect())
    dropped = [b for a in range(len(rows)) for b in range(a + 1, len(rows)) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert kept == sorted(set(range(len(rows))) - set(dropped))
    assert len(dropped) == 80


def test_rows_of_one_id_with_different_texts_stay_apart(spark):
    words = [" ".join(f"{g}w{i}" for i in range(100)) for g in range(3)]
    rows = [(1, words[0]), (1, words[1]), (0, words[0] + " end"), (1, words[2])]
    kept = S.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[1], rows[2], rows[3]])


def test_a_large_group_goes_by_its_bands(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(40)] + [(50, "something else of its own")]
    kept = S.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), shard_limit=2)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 50]


def test_the_stage_finds_candidates_by_fingerprints(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(5):
        words = [str(w) for w in rng.choice(10**9, 3000)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join([*words, "end"]))]
    rows += [(100, ""), (101, "alone")]
    kept = S.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), bands=0, distance=3)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40, 100, 101]


@pytest.mark.parametrize("limit", [4096, 2])
def test_groups_are_joined_once_whatever_makes_the_candidates(spark, limit, monkeypatch):
    rng = np.random.default_rng(9)
    words = [str(w) for w in rng.choice(10**9, 3000)]
    rows = [(i, " ".join([*words, *["end"] * i])) for i in range(6)] + [(10, "alone"), (11, ""), (12, None)]
    runs, plain = [], S.components

    def counted(edges):
        runs.append(1)
        return plain(edges)

    monkeypatch.setattr(S, "components", counted)
    kept = S.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), bands=0, distance=3, shard_limit=limit)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 11]
    assert len(runs) == (2 if limit > 6 else 3)  # those of a group that is dealt by its bands come apart again
