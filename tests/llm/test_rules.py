import math
import random
import re
import struct
from collections import Counter

import xxhash

from rankvane.llm import rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def corpus():
    rng = random.Random(2)
    out = [(0, None), (1, ""), (2, " \n\t \x0b\x0c\r"), (None, "no id"), (3, "a b c " * 40), (4, "x\ny\nx\n\n \nx"), (5, "é😀 # * $ % & | < >  z")]
    for i in range(6, 60):
        vocab = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split() if i % 3 else [f"junk{k}" for k in range(40)]
        out.append((i, "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.randint(1, 200)))))
    return out + out[-2:]


def judged(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()


def test_base_columns(spark):
    rows = corpus()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = [(r["doc_id"], *(r[n] for n in names)) for r in judged(spark, rows, [(1, 1)])]
    assert sorted(got, key=str) == sorted(((d, *base(t)) for d, t in rows), key=str)


def test_target_texts_score_higher_and_junk_goes(spark):
    rows = corpus()
    good = [d for d, _ in rows[7:-2] if d % 3]
    got = judged(spark, rows, [(d, 1) for d in good] + [(None, 1), (good[0], 0)])
    score = {r["doc_id"]: r["score"] for r in got}
    assert min(score[d] for d in good) > max(score[d] for d, _ in rows[7:-2] if d % 3 == 0)
    for r in got:
        if not r["base_failed"] and r["doc_id"] is not None:
            assert r["kept"] == (r["doc_id"] in good)


def test_no_labels_keeps_what_passes(spark):
    got = judged(spark, corpus(), [(1, 0)])
    assert all(r["kept"] == (not r["base_failed"]) and math.isclose(r["score"], 0) for r in got)


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def brute_verdicts(rows, trusted, share, buckets):
    """{row number: (score, kept)} by the two multinomials, counted and divided in plain Python."""
    signed = lambda h: h - 2**64 if h >> 63 else h
    grams = []
    for _, text in rows:
        h = [xx(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        pairs = [xx(struct.pack("<Q", b), xx(struct.pack("<Q", a))) for a, b in zip(h, h[1:])]
        grams.append([signed(x) % buckets for x in h + pairs])
    raw, target = Counter(), Counter()
    for (d, _), g in zip(rows, grams):
        raw.update(g)
        if d in trusted:
            target.update(g)
    r, t = sum(raw.values()), sum(target.values())
    weight = lambda b: math.log((target[b] + 1) / (t + buckets)) - math.log((raw[b] + 1) / (r + buckets)) if t else 0.0
    scores = [sum(map(weight, g)) / len(g) if g else 0.0 for g in grams]
    failed = [base(text)[-1] for _, text in rows]
    bins = sorted(math.floor(s * 10_000) for (d, _), s, f in zip(rows, scores, failed) if d in trusted and not f)
    limit = max((b for b in bins if sum(x < b for x in bins) <= share * len(bins)), default=-math.inf) / 10_000
    return [(s, not f and s >= limit) for s, f in zip(scores, failed)]


def test_score_and_verdict_match_brute_force(spark):
    rng = random.Random(9)
    good, bad = [f"good{i}" for i in range(80)], [f"spam{i}" for i in range(80)]
    rows = []
    for i in range(160):
        pool = good if i % 3 else bad
        rows.append((i, " ".join(rng.choices(pool + good[:20], k=rng.randint(40, 120)))))
    rows += [(None, rows[0][1]), (200, None), (201, ""), (5, rows[7][1])]
    labels = [(i, int(i % 3 != 0)) for i in range(0, 160, 2)] + [(None, 1), (9999, 1)]
    trusted = {i for i, q in labels if q == 1 and i is not None}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"), share=0.1, buckets=512).collect()
    want = brute_verdicts(rows, trusted, 0.1, 512)
    key = lambda d, s, k: (d is None, d or 0, round(s, 9), k)
    assert sorted(key(r["doc_id"], r["score"], r["kept"]) for r in got) == sorted(key(d, s, k) for (d, _), (s, k) in zip(rows, want))
    assert 0 < sum(k for _, k in want) < len(want)
