import random

import pytest

from rankvane.llm import decontaminate as D


def brute(text, item, window, share):
    """Words of the longest overlap of an item with a text."""
    a, b = D.words_of(text), D.words_of(item)
    w, best = min(window, len(b)), 0
    for shift in range(-len(b) + 1, len(a)):
        run = 0
        for i in range(len(b) - w + 1):
            places = [(shift + i + k, i + k) for k in range(w)]
            ok = all(0 <= p < len(a) for p, _ in places) and sum(a[p] == b[q] for p, q in places) >= share * w - 1e-9
            run = run + 1 if ok else 0
            best = max(best, run and run + w - 1)
    return best


def test_masks_cover_two_substitutions():
    assert D.covers(D.MASKS, 12, 2)
    assert not D.covers(("11111111",), 12, 2)
    with pytest.raises(ValueError):
        D.overlaps(None, None, masks=("11111111",))


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    items = [(f"i{k}", " ".join(rng.choices(vocab, k=rng.randint(8, 30)))) for k in range(12)]
    docs = []
    for d in range(80):
        words = rng.choices(vocab, k=rng.randint(0, 80))
        if d % 2:
            part = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(part) - 12))
            part = part[a : a + rng.randint(8, 20)]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = rng.choice(vocab)
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, " ".join(words).upper() if d % 3 else " ".join(words)))
    docs += [(None, None), (80, ""), (80, items[0][1]), (80, items[0][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, ("short", "w1 w2 w3"), (None, None)], "item_id string, text string")
    want = []
    for d, t in docs:
        hits = {k: n for k, text in items if (n := brute(t, text, 12, 0.8))}
        want.append((d, bool(hits), ",".join(sorted(hits)), max(hits.values(), default=0)))
    for most in (27, 6):  # a bitmap that tells seeds apart, and one that lets nearly all of them through
        monkeypatch.setattr(D, "MOST_BITS", most)
        monkeypatch.setattr(D, "LEAST_BITS", min(most, 16))
        got = [(r["doc_id"], r["contaminated"], r["items"], r["longest"]) for r in D.contaminated(table, bench).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    clean = [(r["doc_id"], r["text"]) for r in D.without_overlaps(table, bench).collect()]
    assert sorted(clean, key=str) == sorted(((d, t) for (d, t), w in zip(docs, want) if not w[1]), key=str)
    assert sum(w[1] for w in want) > 20


def test_a_phrase_repeated_in_item_and_text(spark):
    phrase = "one two three four "
    docs = spark.createDataFrame([(1, phrase * 400), (2, phrase * 2 + "five six seven eight"), (3, "nothing of that")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", phrase * 300)], "item_id string, text string")
    got = {r["doc_id"]: r["longest"] for r in D.contaminated(docs, bench).collect()}
    assert got == {1: 1200, 2: brute(phrase * 2 + "five six seven eight", phrase * 300, 12, 0.8), 3: 0}


@pytest.mark.parametrize("piece", [1, 5, 17])
def test_pieces_give_the_overlaps_of_the_whole(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rng = random.Random(piece)
    vocab = [f"w{i}" for i in range(40)]
    items = [(f"i{k}", " ".join(rng.choices(vocab, k=rng.choice([8, 11, 13, 40, 90])))) for k in range(10)]
    docs = []
    for d in range(50):
        words = rng.choices(vocab, k=rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()[rng.randint(0, 9) :]
            for _ in range(rng.randint(0, len(part) // 10)):
                part[rng.randrange(len(part))] = rng.choice(vocab)
            words += part
        docs.append((d, " ".join(words)))
    got = {r["doc_id"]: (r["items"], r["longest"]) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for d, t in docs:
        hits = {k: n for k, text in items if (n := brute(t, text, 12, 0.8))}
        assert got[d] == (",".join(sorted(hits)), max(hits.values(), default=0))
    assert max(n for _, n in got.values()) > 60


def test_an_item_of_100000_words_and_a_seed_in_every_text(spark):
    rng = random.Random(9)
    words = [f"v{rng.randrange(10**6)}" for _ in range(100_000)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("seed", "you may use this file under the terms of the licence")], "item_id string, text string")
    docs = [(d, f"x{d} y{d} you may use this file under the terms of the licence z{d}") for d in range(2000)]
    docs += [(3000, " ".join(words)), (3001, " ".join(words[:50_000])), (3002, " ".join(words[4090:4110])), (3003, " ".join(words[60_000:60_011]))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = D.overlap_lengths(D.with_key(table), bench)
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan
    got = {r["doc_id"]: (r["items"], r["longest"]) for r in D.contaminated(table, bench).collect()}
    assert [got[d] for d in (3000, 3001, 3002, 3003)] == [("long", 100_000), ("long", 50_000), ("long", 20), ("", 0)]
    assert {got[d] for d in range(2000)} == {("seed", 11)}
