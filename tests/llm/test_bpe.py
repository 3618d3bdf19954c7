import hashlib

import pytest

from rankvane.llm import bpe

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "The quick brown fox's 12 jumps, isn't it?", "ΣΊΣΥΦΟΣ Σ", "naïve café ÀÉ", "日本語 текст 😀👍🏽", "x" * 3000, "a\x00b\x1c\x85c", "<|endoftext|> inside <|startoftext|>", "\n\t \r\n", "1234567890 $$$", "ﬁ Ǆ İ ẞ", "banana" * 300, "abcdefghij" * 2000, "ä" * 900 + "the" * 500]


@pytest.fixture(scope="module")
def library():
    import tokenizers

    out = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.default_vocabulary())


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_whole_table_as_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op3_bpe_encode_decode(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert g["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_forced_boundaries_never_cut_inside_a_token(own):
    for word in ("internationalisation", "überzeugt", "日本語"):
        parts = own.fragments_of(word.encode())
        assert b"".join(p for p, _ in parts) == word.encode()
        assert [e for _, e in parts] == [False] * (len(parts) - 1) + [True]


def test_nulls_and_ids_column(spark):
    docs = spark.createDataFrame([(1, None), (None, "hello world"), (1, None)], "doc_id long, text string")
    rows = bpe.encode_documents(docs, bpe.default_vocabulary()).collect()
    assert sorted(((r["doc_id"] or 0), r["n_tokens"], len(r["ids"]), r["decoded"]) for r in rows)[1:] == [(1, 0, 0, "")] * 2


def test_heap_and_scan_agree(own, monkeypatch):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choices("abehnrst", k=rng.randint(2, 150))).encode() for _ in range(300)]
    scanned = [own._merge((w, True)) for w in words]
    monkeypatch.setattr(bpe, "LONG", 1)
    assert [own._merge((w, True)) for w in words] == scanned
