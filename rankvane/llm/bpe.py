"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be merged, so a word is cut there before any merge is tried.  The fragments are
encoded on their own and the results are concatenated, which gives the same ids
as encoding the whole word and lets fragments be shared between words.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: Unicode White_Space, written out because Python's \s also has U+001C..U+001F
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: bytes of a fragment from which its pairs are kept in a heap
LONG = 200
#: characters of a text whose words are listed at once
PART = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + spare)
            spare += 1
    return [out[b] for b in range(256)]


class Cache(dict):
    """key -> encode(key), filled on first use and bounded by bytes.

    It has two generations of up to limit / 2 bytes each: when the younger is full it
    becomes the older, and what nobody asked for meanwhile goes.  Keys above `longest`
    bytes are not kept, so what it holds never depends on the texts.
    """

    def __init__(self, encode, limit: int, longest: int = 64):
        super().__init__()
        self.encode, self.limit, self.longest, self.held, self.older = encode, limit // 2, longest, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.encode(key)
        raw = key[0] if isinstance(key, tuple) else key
        if len(raw) <= self.longest:
            self.held += 200 + 4 * len(raw) + 8 * len(value)  # the entry, its key and the ids
            if self.held > self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


class Bpe:
    """Encoder and decoder for one vocabulary file of the word-end BPE kind.

    What it holds for good is the vocabulary; words and fragments are kept by encoder(),
    for one task.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        symbols = byte_symbols()
        self.table = {b: s for b, s in enumerate(symbols)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        #: the token that the merge of each rank makes
        self.made = [self.vocab[a + b] for a, b in pairs]
        #: byte pairs inside some token, and those that end a word inside some token
        self.inside, self.ending = self._pairs_inside(symbols)
        self.words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
        ).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.first = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.end) for s in symbols]
        #: ids as they are written
        self.decimal = [str(i) for i in range(max(self.tokens, default=-1) + 1)]

    def _pairs_inside(self, symbols: list[str]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
        number = {s: b for b, s in enumerate(symbols)}
        inside, ending = set(), set()
        for token in self.vocab:
            ends = bool(self.end) and token.endswith(self.end)
            raw = [number.get(c) for c in (token[: -len(self.end)] if ends else token)]
            pairs = list(zip(raw, raw[1:]))
            if ends and pairs:
                ending.add(pairs.pop())
            inside.update(pairs)
        return (inside, ending) if self.end else (inside, inside)

    def fragments_of(self, raw: bytes) -> list[tuple[bytes, bool]]:
        """A word's bytes cut at every forced boundary; the flag marks the word's end."""
        out, start, last = [], 0, len(raw) - 2
        for i, pair in enumerate(zip(raw, raw[1:])):
            if pair not in (self.inside if i < last else self.ending):
                out.append((raw[start : i + 1], False))
                start = i + 1
        out.append((raw[start:], True))
        return out

    def _merge(self, fragment: tuple[bytes, bool]) -> tuple[int, ...]:
        raw, ends = fragment
        ids = [self.first[b] for b in raw]
        if ends:
            ids[-1] = self.last[raw[-1]]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get, never = self.merges.get, len(self.made)
        ranks = [get(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == never:
                break
            i = ranks.index(rank)
            ids[i : i + 2] = [self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same by a heap of the pairs, for fragments that a scan for each merge is too slow for."""
        get, n = self.merges.get, len(ids)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i, p in enumerate(zip(ids, ids[1:])) if (rank := get(p)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = behind[i]
            if ids[i] is None or j == n or get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], behind[i] = self.made[rank], None, behind[j]
            if behind[i] < n:
                before[behind[i]] = i
                if (rank := get((ids[i], ids[behind[i]]))) is not None:
                    heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := get((ids[h], ids[i]))) is not None:
                heappush(heap, (rank, h))
        return tuple(i for i in ids if i is not None)

    def encoder(self, cache_bytes: int = 64 << 20):
        """A function from a text to its ids, with caches of its own."""
        fragments = Cache(self._merge, cache_bytes // 4)

        def word(text: str) -> tuple[int, ...]:
            cuts = self.fragments_of(text.encode())
            return fragments[cuts[0]] if len(cuts) == 1 else tuple([i for f in cuts for i in fragments[f]])

        words = Cache(word, cache_bytes)

        def encode(text: str) -> list[int]:
            out: list[int] = []
            for k, part in enumerate(self.split(text) if self.split else [text]):
                if k % 2:
                    out.append(self.special[part])
                elif part:
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    for at in range(0, len(part), PART):  # so that the list of words stays small
                        at, end = self._space(part, at), self._space(part, at + PART)
                        out += chain.from_iterable(map(words.__getitem__, self.words(part, at, end)))
            return out

        return encode

    @staticmethod
    def _space(text: str, at: int) -> int:
        """The first place from `at` on where no word goes on: a space, or the end."""
        at = min(at, len(text))
        if at == 0 or at == len(text):
            return at
        found = text.find(" ", at)
        return len(text) if found < 0 else found

    def encode(self, text: str) -> list[int]:
        return self.encoder()(text)

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space; ids that are
        not in the vocabulary have no token."""
        return " ".join(filter(None, map(self.tokens.get, ids)))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per Python worker, reused by its later tasks."""
    return Bpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them.

    Columns: `keep` (default doc_id), n_tokens, ids (array<int>), decoded.
    A null text counts as empty: no tokens, empty decoded text.  Repeated rows
    give repeated results.  `vocabulary` is a path that every worker can open.
    """

    def make():
        bpe = load(vocabulary)
        encode = bpe.encoder()

        def apply(texts):
            ids = [encode(t) for t in texts]
            return {
                "n_tokens": [len(i) for i in ids],
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array([bpe.decode(i) for i in ids], pa.string()),
            }

        return apply

    return map_texts(docs, make, "n_tokens long, ids array<int>, decoded string", keep)


def digest_documents(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """As encode_documents, with digests instead of the ids and the decoded text.

    ids_sha256 is over the decimal ids joined by one space; decoded_sha256 over
    the text that decode() makes of those ids, in UTF-8.
    """

    def make():
        bpe = load(vocabulary)
        encode, decimal = bpe.encoder(), bpe.decimal

        def digest(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        def apply(texts):
            n, a, b = [], [], []
            for text in texts:
                ids = encode(text)
                n.append(len(ids))
                a.append(digest(" ".join(map(decimal.__getitem__, ids))))
                b.append(digest(bpe.decode(ids)))
            return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return apply

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of digest_documents()."""
    return digest_documents(table(spark, sf_dir, "documents"), default_vocabulary())
