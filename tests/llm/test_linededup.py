import random

import pytest

from rankvane.llm import linededup as L


def split(text):
    return [] if text is None else [(i, x.strip(" \t\r")) for i, x in enumerate(text.split("\n")) if x.strip(" \t\r")]


def brute(docs, min_lines, min_chars):
    """{doc: (kept text, longest run)} for docs with distinct (id, text)."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    lines = [split(t) for _, t in order]
    out = []
    for d, (doc_id, text) in enumerate(order):
        own, gone = [x for _, x in lines[d]], set()

        def earlier(a, n):
            """the first place before (d, a) with the same n lines"""
            want = own[a : a + n]
            for e in range(d + 1):
                other = [x for _, x in lines[e]]
                for b in range(len(other) - n + 1):
                    if (e, b) >= (d, a):
                        return None
                    if other[b : b + n] == want:
                        return e, b

        for a in range(len(own)):
            if len(own[a]) >= min_chars and earlier(a, 1):
                gone.add(a)
            if a + min_lines <= len(own) and earlier(a, min_lines):
                gone.update(range(a, a + min_lines))
        longest, stretches = 0, {}
        for a in range(len(own)):
            n = 1
            while a + 2 * n <= len(own) and earlier(a, 2 * n):
                n *= 2
            if place := earlier(a, n):
                stretches.setdefault((place[0], a - place[1]), []).append((a, a + n))
        for spans in stretches.values():
            start, end = spans[0]
            for a, b in spans:
                start, end = (a, b) if a > end else (start, max(end, b))
                longest = max(longest, end - start)
        nos = {lines[d][k][0] for k in gone}
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in nos)
        out.append((doc_id, kept, longest))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4])
def test_as_brute_force(spark, min_lines):
    rng = random.Random(min_lines)
    vocab = [f"line {i}" for i in range(14)] + ["a line that is long enough to go alone", "", "  "]
    docs = [(i, "\n".join(rng.choices(vocab, k=rng.randint(0, 14)))) for i in range(40)]
    docs += [(40 + i, docs[i][1] + "\n tail\t") for i in range(0, 12, 3)] + [(None, docs[5][1]), (60, None), (61, ""), (62, "x\n" * 9)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["__longest"]) for r in L.deduplicate_lines(table, min_lines, 30).collect()]
    assert sorted(got, key=str) == brute(docs, min_lines, 30)


def test_runs_are_repeats_and_as_long_as_they_go(spark):
    shared = [f"shared {i}" for i in range(7)]
    docs = [(1, "\n".join(["a", *shared, "b"])), (2, "\n".join(["c", "d", *shared, "e"])), (3, "\n".join(shared[2:6]))]
    table = L.with_key(spark.createDataFrame(docs, "doc_id long, text string"))
    _, runs = L.repeated_runs(table, 2, 60)
    got = sorted((r["__d"], r["seq"], r["n_lines"], r["d"], r["original_seq"]) for r in runs.collect())
    assert got == [(2, 2, 7, 1, 1), (3, 0, 4, 1, 3)]


def test_rows_that_repeat_an_id(spark):
    text = "one line\nand two lines"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (1, text + "\nmore", "z"), (2, text, "w")], "doc_id long, text string, `my col` string")
    got = {r["my col"]: r["text"] for r in L.deduplicate_lines(docs).collect()}
    assert got["x"] == got["y"]  # equal in id and text: one document
    assert sorted(x is not None and len(x) for x in got.values()).count(0) + ("more" in got.values()) >= 2
    assert got["w"] == ""


def test_a_run_of_no_lines(spark):
    with pytest.raises(ValueError):
        L.repeated_runs(L.with_key(spark.createDataFrame([], "doc_id long, text string")), 0, 60)
