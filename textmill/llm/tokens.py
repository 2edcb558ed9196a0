"""Token counts and ids of whole texts for a word-level BPE vocabulary file.

A text's ids are those of its pre-tokens in order, and the cheapest step that can tell a pre-token's is taken: the whole-token
shortcut, a table proved once against the library (every vocabulary string that alone encodes to exactly one token) and sent
to the tasks; a memo of those that the task has merged; and merging for the rest, for many at once in numpy. Pre-tokens
are found and grouped in numpy too, for a run of texts at once, so that only a run's different ones become strings. Those of
more than 32 bytes go to the library. Where a text has characters beyond U+017F, a special token's string or control
characters on which splitting differs, only its runs between spaces that hold one go to the library: nothing that the library
does reaches over a space. The memo is bounded, ends with the task, and only saves time.

Defined results: null and empty texts have 0 tokens; equal texts have equal counts; a text of any length is read whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textmill.llm.common import without

LATIN = [chr(c) for c in range(0x180)]
LETTERS = "".join(c for c in LATIN if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in LATIN if unicodedata.category(c)[0] == "N")
#: The pre-tokenizer's pattern in word_bpe_49k.json, for characters below U+0180.
PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Texts with these are left to the library: characters on which white space differs, and what may begin a special token.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: So are those with others; below, lower case is one letter for one and composing changes nothing.
BEYOND = re.compile("[\u0130\u0180-\U0010ffff]")
LONGEST = 32
NEVER = np.int32(1 << 30)
#: Class of each character below U+0180, as the pattern has them: 0 white space, 1 letter, 2 number, 3 other.
CLASSES = np.array([0 if c.isspace() else 1 if c in LETTERS else 2 if c in NUMBERS else 3 for c in LATIN], dtype=np.uint8)
#: Seven characters below U+0180 fit a word of 64 bits; MASKS[n] keeps n of them.
PACKED = 7
MASKS = np.array([(1 << 9 * n) - 1 for n in range(PACKED + 1)], dtype=np.uint64)
MIX = 0x9E3779B97F4A7C15
#: Texts that stay longer than this, as they have no spaces to cut at, are split by the pattern; the arrays take some 45 bytes a character.
WIDEST = 2_000_000


def is_odd(text: str) -> bool:
    return any(x in text for x in ODD) or not text.isascii() and BEYOND.search(text) is not None


def units(text: str) -> list[str]:
    """What is encoded apart: pre-tokens, and with a space before them the runs between spaces that the library must take whole."""
    if not is_odd(text):
        return PRE_TOKENS.findall(text.lower())
    out: list[str] = []
    for run in text.split(" "):
        if run:
            out.extend([" " + run] if is_odd(run) else PRE_TOKENS.findall(run.lower()))
    return out


def spans(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``PRE_TOKENS`` finds pre-tokens, and their sizes. c: lower-cased characters below U+0180, the last three of them white space."""
    k = CLASSES[c]
    before = np.concatenate([k[:1] * 0, k[:-1]])
    edge = (k != before) | (k == 2)
    # an apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it, and the next begins after these
    mark = np.flatnonzero((c == 39) & (before != 3))
    a, b = c[mark + 1], c[mark + 2]
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    mark, after = mark[one | two], np.where(one, 2, 3)[one | two]
    edge[mark + 1] = False
    edge[mark + after] = True
    at = np.flatnonzero(edge)
    size = np.diff(at, append=len(c))
    on = k[at] > 0
    return at[on], size[on]


def group(text: str, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each span's string among the different ones, and these. Spans are grouped by hashes; those of up to seven characters are
    their own, of others all characters are compared, and if two strings ever share a hash, all are grouped as strings."""
    w = c.astype(np.uint64) + np.uint64(1)
    w[:-1] |= w[1:] << np.uint64(9)
    w[:-2] |= w[2:] << np.uint64(18)
    w[:-3] |= w[3:] << np.uint64(27)
    key = w[start] & MASKS[np.minimum(size, PACKED)]
    parts = [key.copy()]
    rows = np.flatnonzero(size > PACKED)
    far = rows[size[rows] > 5 * PACKED]
    for k in range(PACKED, 5 * PACKED, PACKED):
        some = rows[size[rows] > k]
        x = w[start[some] + k] & MASKS[np.minimum(size[some] - k, PACKED)]
        parts.append(np.zeros(len(start), dtype=np.uint64))
        parts[-1][some] = x
        key[some] = (key[some] ^ key[some] >> np.uint64(29)) * np.uint64(MIX) + x
    key[rows] |= np.uint64(1 << 63)
    own = {i: text[start[i] : start[i] + size[i]] for i in far.tolist()}
    key[far] = np.array([hash(x) & (1 << 64) - 1 | 1 << 63 for x in own.values()], dtype=np.uint64)
    number = pd.factorize(key)[0]
    first = np.zeros(number.max(initial=-1) + 1, dtype=np.int64)
    first[number[::-1]] = np.arange(len(start))[::-1]
    as_first = first[number[rows]]
    same = (size[rows] == size[as_first]).all() and all((p[rows] == p[as_first]).all() for p in parts)
    if not same or any(own[i] != own.get(j) for i, j in zip(own, first[number[far]].tolist())):
        of: dict[str, int] = {}
        number = np.array([of.setdefault(text[i : i + n], len(of)) for i, n in zip(start.tolist(), size.tolist())], dtype=np.int64)
        return number, list(of)
    return number, [text[i : i + n] for i, n in zip(start[first].tolist(), size[first].tolist())]


def slices(text: str, most: int) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut at spaces, which belong to no unit."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(" ", at, at + most)
        if end < 0 and (end := text.find(" ", at + most)) < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class WordVocabulary:
    """The file ``name``, what is proved of it, and its merges as arrays. memo: units that it remembers beside the proved ones; when it is full, those met
    in more than one run stay, and where these are too many, those of the run at hand. alone: what ``prove`` gave elsewhere."""

    def __init__(self, name: str, memo: int = 100_000, alone: dict[str, bytes] | None = None):
        path = public_tokenizers.path(name)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.room = memo
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, self.size = model["vocab"], len(model["vocab"])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        by = np.argsort(key)
        self.keys, self.ranks = key[by], by.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.first = np.array([vocab[c] for c in byte_letters()] + [vocab[c + "</w>"] for c in byte_letters()], dtype=np.int32)
        a, b = np.meshgrid(self.first, self.first, indexing="ij")
        self.start = self.rank(a, b)
        self.alone = self.prove(vocab) if alone is None else alone
        self.forget()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def prove(self, vocab: dict[str, int]) -> dict[str, bytes]:
        """The ASCII strings that are one pre-token and that the library encodes alone as one token, with that token."""
        ends = [s[:-4] for s in vocab if s.endswith("</w>") and len(s) > 4 and s.isascii()]
        whole = [s for s in ends if s == s.lower() and PRE_TOKENS.fullmatch(s) and not is_odd(s)]
        return {s: ids for s, ids in zip(whole, self.encode(whole)) if len(ids) == 4}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of merging a with b; ``NEVER`` where there is no such merge."""
        k = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (a >= 0) & (b >= 0), self.ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most ``LONGEST`` bytes: in each, the merge of the least rank, the leftmost first, until none is left."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(words), 8_000):
            some = order[lo : lo + 8_000]
            n = size[some]
            width = int(n.max()) + 1
            col = np.arange(width)
            flat = np.frombuffer(b"".join([words[i] for i in some.tolist()]), dtype=np.uint8)
            b = np.zeros((len(some), width), dtype=np.int64)
            b[col < n[:, None]] = flat
            b[np.arange(len(some)), n - 1] += 256
            sym = np.where(col < n[:, None], self.first[b], -1)
            r = np.where(col[:-1] < n[:, None] - 1, self.start[b[:, :-1], b[:, 1:]], NEVER)
            rows = np.arange(len(some))
            done = np.full((len(some), width), -1, dtype=np.int32)
            while len(rows):
                j = r.argmin(1)
                best = r[np.arange(len(rows)), j]
                on = best < NEVER
                if not on.all():
                    done[rows[~on], : sym.shape[1]] = sym[~on]
                    rows, sym, r, j, best = rows[on], sym[on], r[on], j[on], best[on]
                    if not len(rows):
                        break
                # each word left has lost a symbol, so that a column is lost too
                k = np.arange(len(rows))
                new = self.merged[best]
                after = col[: sym.shape[1] - 1] > j[:, None]
                sym[k, j] = new
                sym = np.where(after, sym[:, 1:], sym[:, :-1])
                r = np.where(after[:, :-1], r[:, 1:], r[:, :-1])
                r[k, j] = self.rank(new, sym[k, j + 1])
                left = np.flatnonzero(j)
                r[left, j[left] - 1] = self.rank(sym[left, j[left] - 1], new[left])
            have = done >= 0
            ids = done[have].astype("<u4").tobytes()
            end = 4 * np.cumsum(have.sum(1))
            at = 0
            for i, e in zip(some.tolist(), end.tolist()):
                out[i] = ids[at:e]
                at = e
        return out

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of units that are neither proved nor remembered."""
        near = [x for x in new if x[0] != " "]
        coded = zip(near, "\n".join(near).encode("utf-8").split(b"\n"))
        short = [(x, b) for x, b in coded if len(b) <= LONGEST]
        out = dict(zip([x for x, _ in short], self.merge([b for _, b in short])))
        if len(out) < len(new):
            rest = [x for x in new if x not in out]
            out.update(zip(rest, self.encode([x.removeprefix(" ") for x in rest])))
        return out

    def look_up(self, different: list[str]) -> list[bytes]:
        """The ids of units that differ from each other; their number is beside ``room``."""
        found = list(map(self.memo.get, different))
        rest = [i for i, x in enumerate(found) if x is None]
        new, take = [], self.once.pop
        for i in rest:
            x = different[i]
            if (ids := take(x, None)) is None:
                new.append(x)
            else:
                self.memo[x] = found[i] = ids
        learned = self.learn(new)
        if len(self.memo) + len(self.once) + len(learned) > len(self.alone) + self.room:
            self.once = {}
        if len(self.memo) + len(learned) > len(self.alone) + self.room:
            self.memo = dict(self.alone)
            self.memo.update((x, ids) for x, ids in zip(different, found) if ids is not None)
        self.once.update(learned)
        for i in rest:
            if found[i] is None:
                found[i] = learned[different[i]]
        return found

    def forget(self) -> None:
        """Remember only what is proved."""
        self.memo, self.once = dict(self.alone), {}

    def encode_together(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pre-tokens are found and numbered for all texts at once, and each different one is looked up once."""
        odd = {i: units(t) for i, t in enumerate(texts) if len(t) > WIDEST or is_odd(t)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)]
        text = "\n".join(plain).lower() + " " * (PACKED - 1)
        c = np.frombuffer(text.encode("utf-16-le"), dtype="<u2")
        start, size = spans(c)
        number, different = group(text, c, start, size)
        apart = list(set().union(*odd.values()).difference(different)) if odd else []
        found = self.look_up(different + apart)
        get = dict(zip(different + apart, found)).__getitem__ if odd else None
        many = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        n = many[number]
        end = np.cumsum(n)
        shift = (np.cumsum(many) - many)[number] - (end - n)
        out = flat[np.repeat(shift, n) + np.arange(n.sum())].tobytes()
        begin = np.cumsum([0, *(len(t) + 1 for t in plain)])
        at = (4 * np.concatenate([[0], end])[np.searchsorted(start, begin)]).tolist()
        return [b"".join(map(get, odd[i])) if i in odd else out[at[i] : at[i + 1]] for i in range(len(texts))]

    def ids(self, texts: list[str | None], run: int = 1_000_000) -> Iterator[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit numbers; runs of about ``run`` characters are encoded together."""
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end] or "") <= run):
                n += len(texts[end] or "")
                end += 1
            last = slices(texts[end - 1] or "", run)
            *some, begun = self.encode_together([*(t or "" for t in texts[at : end - 1]), next(last)])
            yield from some
            yield b"".join([begun, *(self.encode_together([x])[0] for x in last)])
            at = end


@lru_cache(maxsize=2)
def proved(name: str) -> tuple[str, bytes]:
    """The whole-token table of the file, worked out once on the driver: the strings, one a line, and their ids."""
    alone = WordVocabulary(name).alone
    return "\n".join(alone), b"".join(alone.values())


@contextmanager
def vocabulary(name: str, table: tuple[str, bytes] | None = None) -> Iterator[WordVocabulary]:
    """The vocabulary for one task. Arrays and table of the file stay with the Python worker; the memo ends with the task."""
    v = _loaded(name, table)
    try:
        yield v
    finally:
        v.forget()


_LOADED: dict[str, WordVocabulary] = {}


def _loaded(name: str, table: tuple[str, bytes] | None) -> WordVocabulary:
    if name not in _LOADED:
        alone = None
        if table is not None:
            words, ids = table
            alone = {s: ids[4 * i : 4 * i + 4] for i, s in enumerate(words.split("\n"))} if words else {}
        _LOADED.clear()
        _LOADED[name] = WordVocabulary(name, alone=alone)
    return _LOADED[name]


def token_count(text: Column, name: str) -> Column:
    table = proved(name)

    @F.pandas_udf("long")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with vocabulary(name, table) as v:
            for texts in it:
                yield pd.Series([len(b) // 4 for b in v.ids(texts.tolist())], dtype="int64")

    return of(text)


def count_tokens(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; input columns of these names are replaced."""
    out = without(docs, "n_bytes", "n_tokens", "over_limit").withColumn("n_tokens", token_count(F.col("text"), name))
    return out.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
