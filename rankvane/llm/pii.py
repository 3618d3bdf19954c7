"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The field tags word tokens by features of their shapes and of their neighbours'.
It is trained in numpy from a small table of labelled lines that a few dozen
templates spell out, and decoded by Viterbi over numpy batches.  It adds spans
that the patterns can't give: keys and passwords, and phone numbers without a
country code.  Every token of every line is scored.  Where "outside" leads by more
than any two transitions can make up for, the best path passes through it; there the
line is cut, exactly, and only what is left between two cuts is decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
#: kinds of the spans that the field adds, listed behind the others
ADDED = ("secret", "local_phone")
TAGS = ("outside", *ADDED)

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits is tried from its first digit only: its later digits end at the same place
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                free = domain.end()
                at = text.find("@", free)
                continue
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and without overlaps inside the kind."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


# ---- the labelled table: braces hold what is filled in, and behind > the tag of its tokens

TEMPLATES = (
    "please set password={hex18>secret} before the run",
    "password={mix12>secret}",
    "the password: {mix10>secret} was changed",
    "passwd = {mix14>secret}",
    'token = "{hex40>secret}" and more',
    "token={hex32>secret}",
    "api key {mix32>secret} expires",
    "secret: {hex24>secret}",
    "{aws>secret} was found in the text",
    "the key {aws>secret} is old",
    "and {aws>secret}",
    "with {hex32>secret} in it",
    'TOKEN = "{HEX40>secret}"',
    "secret_key={HEX24>secret}",
    "password={abc14>secret}",
    'passwd="{abc16>secret}" is set',
    "token: {abc20>secret}",
    "pwd={abc12>secret};",
    "call {local>local_phone} today",
    "phone: {local>local_phone}.",
    "tel {dash>local_phone} for more",
    "my number is {dash>local_phone}",
    "{local>local_phone} or {dash>local_phone}",
    "fax {local>local_phone}, office",
    "the GNU General Public License, version {n1}.",
    "Licensed under CC BY-NC {n1}.{n1}.",
    "in {year} there were {n3} of them",
    "on {n2}.{n2}.{year} at {n2}:{n2}",
    "page {n3} of {n3}",
    "chapter {n1}.{n2} and {n1}.{n2}",
    "mail {word}@{word}.com about it",
    "reach +{n1} ({n3}) {n3}-{n4} now",
    "from {n2}.{n3}.{n2}.{n3} to here",
    "card {n4}{n4}{n4}{n4} was used",
    "costs {n3} euro, or {n2}%",
    "{year}-{n2}-{n2} was the date",
    "the {n1}th of {n2} items",
    "{word}{n2} and {word}{n1} are names",
    "{n3} {n3} {n3} were counted",
    "x = {n2} + {n1}",
    "sum {n3}.{n2} at {n4}",
    "between {year} and {year}",
    "the password is {word} and the token {word}",
    "a key {word} to the secret {word} of the {word}",
    "password: {word}",
    "token {word}, secret = {word}",
    "{Word} and {Word} met {Word}",
    "the {hex4} and {n2}{word} again",
    "{word}-{word}_{word}={word}",
)


def labelled_lines(copies: int = 12, seed: int = 5, templates: tuple[str, ...] = TEMPLATES) -> list[tuple[list[str], list[int]]]:
    """(tokens, tags) of every template, filled `copies` times."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    filler = {
        "aws": lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16),
        "local": lambda: f"({pick('23456789', 3)}) {pick('23456789', 3)}-{pick('0123456789', 4)}",
        "dash": lambda: f"{pick('23456789', 3)}-{pick('23456789', 3)}-{pick('0123456789', 4)}",
        "year": lambda: str(rng.randint(1900, 2030)),
        "word": lambda: pick("abcdefghijklmnoprstu", rng.randint(2, 9)),
        "Word": lambda: pick("abcdefghijklmnoprstu", rng.randint(3, 12)).capitalize(),
    }
    for n in (1, 2, 3, 4):
        filler[f"n{n}"] = lambda n=n: pick("123456789", n)

    def fill(name: str) -> str:
        if name in filler:
            return filler[name]()
        kind, size = name[:3], int(name[3:])
        chars = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "abc": "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRS"}
        while True:
            made = pick(chars.get(kind, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRS23456789"), size)
            if kind == "abc" or any(c.isdigit() for c in made) and not made.isdigit():
                return made

    out = []
    for template in templates:
        for _ in range(copies):
            text, marks = " ".join(filler["word"]() for _ in range(rng.randint(0, 3))) + " ", []
            for part in re.split(r"(\{[^}]*\})", template):
                if part.startswith("{"):
                    name, _, tag = part[1:-1].partition(">")
                    made = fill(name)
                    if tag:
                        marks.append((len(text), len(text) + len(made), TAGS.index(tag)))
                    text += made
                else:
                    text += part
            spans = [m.span() for m in TOKEN.finditer(text)]
            tags = [next((t for a, b, t in marks if a <= s and e <= b), 0) for s, e in spans]
            out.append(([text[s:e] for s, e in spans], tags))
    return out


# ---- features

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
CUES = ("password", "passwd", "pwd", "token", "secret", "key", "api", "call", "phone", "tel", "fax", "number", "license", "version", "card", "mail")
_SIGNS = "=:\"'()-.+@/,%#"
_BOUNDS = (2, 3, 4, 5, 8, 12, 16, 20, 21, 32, 33, 64)


def shape(token: str) -> tuple[int, ...]:
    """Numbers (below 64) of the features that a token has by itself."""
    out = []
    low = token.lower()
    if low in CUES:
        out.append(1 + CUES.index(low))
    if len(token) == 1 and token in _SIGNS:
        out.append(20 + _SIGNS.index(token))
    digit, upper, lower = any(c.isdigit() for c in token), any(c.isupper() for c in token), any(c.islower() for c in token)
    out.append(36 + digit + 2 * upper + 4 * lower)
    out.append(44 + next((i for i, b in enumerate(_BOUNDS) if len(token) <= b), len(_BOUNDS)))
    if digit and lower and not upper and all(c in "0123456789abcdef" for c in token):
        out.append(58)
    if token.startswith("AKIA"):
        out.append(59)
    if digit and not (upper or lower):
        out.append(60 + min(3, abs(len(token) - 3)))
    if len(token) > 4 and upper and lower and not (token[1:].islower() or token.isupper()):
        out.append(34)  # capitals inside
    if digit and upper and not lower and all(c in "0123456789ABCDEF" for c in token):
        out.append(35)
    return tuple(out)


#: features seen at distance -2..2 get tables of their own
_OFFSETS = (-2, -1, 0, 1, 2)
_WIDTH = 64 * len(_OFFSETS)


def feature_rows(tokens: list[str]) -> list[list[int]]:
    own = [shape(t) for t in tokens]
    rows = []
    for i in range(len(tokens)):
        row = []
        for k, o in enumerate(_OFFSETS):
            if 0 <= i + o < len(tokens):
                row += [64 * k + f for f in own[i + o]]
            else:
                row.append(64 * k)  # beyond the line
        rows.append(row)
    return rows


class Crf:
    """Linear-chain conditional random field over the features above."""

    def __init__(self):
        k = len(TAGS)
        self.w, self.t = np.zeros((_WIDTH + 1, k)), np.zeros((k, k))

    @staticmethod
    def batch(lines: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(features, padded with the last row, which weighs nothing; lengths)"""
        most = max((len(r) for line in lines for r in line), default=1)
        out = np.full((len(lines), max(map(len, lines), default=1), most), _WIDTH, np.int32)
        for i, line in enumerate(lines):
            for j, row in enumerate(line):
                out[i, j, : len(row)] = row
        return out, np.array([len(line) for line in lines])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.w[features].sum(2)

    def fit(self, lines, tags, rounds: int = 150, rate: float = 0.2, l2: float = 1e-3) -> Crf:
        """Full-batch Adam on the mean log likelihood, by forward-backward."""
        x, size = self.batch(lines)
        b, n, k = len(lines), x.shape[1], len(TAGS)
        y = np.zeros((b, n), np.int64)
        for i, t in enumerate(tags):
            y[i, : len(t)] = t
        real = np.arange(n)[None] < size[:, None]
        rows = np.arange(b)
        gold_t = np.zeros((k, k))
        np.add.at(gold_t, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.t)]
        lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
        for step in range(1, rounds + 1):
            s = self.scores(x)
            f, r = np.zeros((b, n, k)), np.zeros((b, n, k))
            f[:, 0] = s[:, 0]
            for j in range(1, n):
                f[:, j] = np.where(real[:, j, None], lse(f[:, j - 1, :, None] + self.t, 1) + s[:, j], f[:, j - 1])
            z = lse(f[:, -1], 1)
            for j in range(n - 2, -1, -1):
                r[:, j] = np.where(real[:, j + 1, None], lse(self.t + (s[:, j + 1] + r[:, j + 1])[:, None], 2), 0)
            p = np.exp(f + r - z[:, None, None]) * real[:, :, None]
            expect_t = np.zeros((k, k))
            for j in range(1, n):
                pair = f[:, j - 1, :, None] + self.t + (s[:, j] + r[:, j])[:, None] - z[:, None, None]
                expect_t += (np.exp(pair) * real[:, j, None, None]).sum(0)
            gold = np.zeros((b, n, k))
            gold[rows[:, None], np.arange(n)[None], y] = real
            gw = np.zeros_like(self.w)
            np.add.at(gw, x.reshape(b * n, -1), np.repeat((p - gold).reshape(b * n, 1, k), x.shape[2], 1))
            for param, g, (m, v) in zip((self.w, self.t), (gw / b + l2 * self.w, (expect_t - gold_t) / b + l2 * self.t), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w[-1] = 0
        return self

    def decode(self, lines: list[list[list[int]]]) -> list[np.ndarray]:
        """The best tags of each line."""
        x, size = self.batch(lines)
        return self.best(self.scores(x), size)

    def best(self, s: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The best tags of each row of scores (lines, tokens, tags), by Viterbi over the whole batch."""
        lines, n = s.shape[:2]
        if not lines:
            return []
        best, back = s[:, 0], np.zeros((lines, n, len(TAGS)), np.int8)
        for j in range(1, n):
            step = best[:, :, None] + self.t
            back[:, j] = step.argmax(1)
            best = np.where((j < size)[:, None], step.max(1) + s[:, j], best)
        out = np.zeros((lines, n), np.int8)
        at = best.argmax(1)
        for j in range(n - 1, -1, -1):
            here = j < size
            out[here, j] = at[here]
            at = np.where(here, back[np.arange(lines), j, at], at)
        return [o[:n] for o, n in zip(out, size)]

    def best_of_one(self, s: np.ndarray) -> np.ndarray:
        """The same for a single long row, without arrays for each step."""
        k, t = range(len(TAGS)), self.t.tolist()
        best, back = s[0].tolist(), []
        for row in s[1:].tolist():
            came = [max(k, key=lambda a, b=b: best[a] + t[a][b]) for b in k]
            best = [best[came[b]] + t[came[b]][b] + row[b] for b in k]
            back.append(came)
        at = max(k, key=best.__getitem__)
        out = [at]
        for came in reversed(back):
            at = came[at]
            out.append(at)
        return np.array(out[::-1], np.int8)


@lru_cache(maxsize=1)
def trained() -> Crf:
    table_ = labelled_lines()
    return Crf().fit([feature_rows(tokens) for tokens, _ in table_], [tags for _, tags in table_])


# ---- decoding of texts

#: a token, or the end of a line
PIECE = re.compile(TOKEN.pattern + r"|\n")
#: tokens between two cuts from which one row is decoded on its own
LONG = 500


#: shape() of a word of lower-case letters that is no cue, by its length
_PLAIN = [shape("z" * max(n, 1)) for n in range(_BOUNDS[-1] + 2)]


class Shapes(dict):
    """token -> number of its features; 0 is the place beyond a line."""

    def __init__(self, crf: Crf, limit: int = 250_000):
        super().__init__()
        self.crf, self.limit, self.numbers, self.features, self.weights = crf, limit, {}, [(0,)], None
        self["\n"] = 0

    def __missing__(self, token):
        if token.islower() and token.isalpha() and token not in CUES:  # most words: only their length counts
            own = _PLAIN[min(len(token), len(_PLAIN) - 1)]
        else:
            own = shape(token)
        number = self.numbers.get(own)
        if number is None:
            number = self.numbers[own] = len(self.features)
            self.features.append(own)
            self.weights = None
        if len(token) <= 64:
            if len(self) >= self.limit:
                self.clear()
                self["\n"] = 0
            self[token] = number
        return number

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """The scores of each place of a sequence, from the shapes at the offsets around it."""
        if self.weights is None:  # as many rows as kinds of shapes, for each offset
            self.weights = [np.stack([self.crf.w[[64 * k + f for f in own]].sum(0) for own in self.features]) for k in range(len(_OFFSETS))]
        pad = max(_OFFSETS)
        wide = np.concatenate([np.zeros(pad, np.int64), ids, np.zeros(pad, np.int64)])
        return sum(w[wide[pad + o : pad + o + len(ids)]] for w, o in zip(self.weights, _OFFSETS))


def _surely_outside(s: np.ndarray, t: np.ndarray, line_end: np.ndarray) -> np.ndarray:
    """Places that the best path passes outside of every kind, whatever its other tags are.

    Another tag goes where "outside" leads by more than the two transitions can make up
    for, over those tags of the neighbours that are left: a path with it would get better
    by the exchange.  What goes narrows the neighbours' choice, so that is repeated as long
    as it decides many places.
    """
    kinds = range(len(TAGS))
    left = np.ones((len(TAGS), len(s)), bool)  # tags that are left; nothing is behind the end of a line
    left[1:, line_end] = False
    open_ = np.flatnonzero(~line_end)
    while len(open_):
        before, behind = open_ - 1, np.minimum(open_ + 1, len(s) - 1)
        edge_before, edge_behind = line_end[before] | (open_ == 0), line_end[behind] | (open_ == len(s) - 1)
        stays = np.zeros(len(open_), bool)
        for k in kinds[1:]:
            gains = []
            for at, edge, gain in ((before, edge_before, t[:, k] - t[:, 0]), (behind, edge_behind, t[k] - t[0])):
                most = np.full(len(open_), gain[0])
                for a in kinds[1:]:
                    np.maximum(most, gain[a], out=most, where=left[a, at])
                gains.append(np.where(edge, 0.0, most))
            own = left[k, open_] & (s[open_, 0] <= s[open_, k] + gains[0] + gains[1] + 1e-9)
            left[k, open_] = own
            stays |= own
        if stays.sum() > 0.95 * len(open_):
            break
        open_ = open_[stays]
    return ~left[1:].any(0)


def tags_of(texts: list[str], shapes: Shapes) -> list[np.ndarray]:
    """The best tag of each PIECE of each text; ends of lines are outside."""
    crf, t = shapes.crf, shapes.crf.t
    own = [np.fromiter(map(shapes.__getitem__, PIECE.findall(text)), np.int64) for text in texts]
    # two places beyond the line between any two lines, so that none sees the next one
    end = np.zeros(2, np.int64)
    ids = np.concatenate([x for o in own for x in (o, end)] or [end])
    ids = np.repeat(ids, np.where(ids == 0, 2, 1))
    s = shapes.scores(ids)
    sure = _surely_outside(s, t, ids == 0)
    out = np.zeros(len(ids), np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], sure, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        s[starts] += np.where(ids[starts - 1] == 0, 0, 1)[:, None] * t[0]
        s[ends - 1] += np.where(ids[np.minimum(ends, len(ids) - 1)] == 0, 0, 1)[:, None] * t[:, 0]
        size = ends - starts
        order = np.argsort(size, kind="stable")
        many = order[size[order] < LONG]
        for at in range(0, len(many), 4096):
            some = many[at : at + 4096]
            wide = starts[some][:, None] + np.arange(size[some].max())
            for k, tags in zip(some, crf.best(s[np.minimum(wide, len(s) - 1)], size[some])):
                out[starts[k] : ends[k]] = tags
        for k in order[len(many) :]:
            out[starts[k] : ends[k]] = crf.best_of_one(s[starts[k] : ends[k]])
    # back to one place for each piece
    first = np.ones(len(ids), bool)
    zero = np.flatnonzero(ids == 0)
    first[zero[1::2]] = False
    out = out[first]
    return np.split(out, np.cumsum([len(o) + 2 for o in own])[:-1]) if own else []


def field_spans(texts: list[str], shapes: Shapes) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) that the field finds in each text."""
    out: list[list[tuple[str, int, int]]] = []
    for text, tags in zip(texts, tags_of(texts, shapes)):
        found: list[tuple[str, int, int]] = []
        if tags.any():
            last = -2
            for j, m in enumerate(PIECE.finditer(text)):
                if tags[j]:
                    kind = TAGS[tags[j]]
                    if last == j - 1 and found[-1][0] == kind:
                        found[-1] = (kind, found[-1][1], m.end())
                    else:
                        found.append((kind, m.start(), m.end()))
                    last = j
        out.append(found)
    return out


def find_personal_data(texts: list[str], shapes: Shapes) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """(base spans by kind, added spans); an added span never overlaps a base span."""
    out = []
    for text, found in zip(texts, field_spans(texts, shapes)):
        base = base_spans(text)
        taken = [s for spans in base.values() for s in spans]
        out.append((base, sorted((k, a, b) for k, a, b in found if all(b <= x or y <= a for x, y in taken))))
    return out


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default doc_id); n_email, n_ip, n_card, n_phone (base spans);
    base_sha256 and spans (kind:start:end, code points, comma-joined, kinds in
    the order of KINDS and ADDED, then by start); n_secret, n_local_phone; n_spans and
    has_personal_data over all kinds.

    A null text counts as empty.  Repeated rows give repeated results.
    """

    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        shapes = Shapes(shared.value)

        def apply(texts):
            rows = []
            for base, added in find_personal_data(texts, shapes):
                listed = [f"{k}:{a}:{b}" for k in KINDS for a, b in base[k]]
                more = [f"{k}:{a}:{b}" for kind in ADDED for k, a, b in sorted(added, key=lambda s: s[1]) if k == kind]
                digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
                n = [sum(k == kind for k, _, _ in added) for kind in ADDED]
                rows.append((*(len(base[k]) for k in KINDS), digest, ",".join(listed + more), *n, len(listed + more), bool(listed or more)))
            return dict(zip(names, map(list, zip(*rows))))

        return apply

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"n_{k}" for k in ADDED), "n_spans", "has_personal_data"]
    types = ["long"] * 4 + ["string"] * 2 + ["long"] * 3 + ["boolean"]
    return map_texts(docs, make, ", ".join(map(" ".join, zip(names, types))), keep, slice_chars=1_000_000)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the columns of personal_data()."""
    return personal_data(table(spark, sf_dir, "documents"))
