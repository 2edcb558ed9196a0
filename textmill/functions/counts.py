"""Counts of regular expressions, words and sentences over texts, many at once, by Arrow's automata and in numpy.

A text is first made plain: each character beyond ASCII becomes one of its class in Java's Unicode sense, by a table that Spark's regular expressions fill (``_`` for a word character, ``0`` for a
digit, a tab or a new line for a space, ``~`` else), so that ASCII classes then tell what Unicode classes would. Patterns that could tell these characters
apart, or whose matches depend on what is before them, are not taken.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ALLOWED = {K.LITERAL, K.IN, K.RANGE, K.CATEGORY, K.ANY, K.BRANCH, K.SUBPATTERN, K.MAX_REPEAT, K.AT}
_MADE = set(map(ord, "_0~\t\n\r\x0b"))
_WORD = (K.CATEGORY_WORD, K.CATEGORY_DIGIT)


def plain(text: Column) -> Column:
    """``text`` with ASCII characters only."""
    out = text
    for kind, to in ((r"[[^\x00-\x7F]&&\p{Nd}]", "0"), (r"[[^\x00-\x7F]&&\w]", "_"), (r"[\u0085\u2028\u2029]", "\n"), (r"[[^\x00-\x7F]&&\s]", "\t"), (r"[^\x00-\x7F]", "~")):
        out = F.regexp_replace(out, "(?U)" + kind, to)
    return out


_TABLES: list[bytes] = []


def table(spark: SparkSession) -> bytes:
    """``plain`` of each code point, compressed; made once by a job of one row."""
    if not _TABLES:
        points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
        made = spark.createDataFrame([("".join(map(chr, points)),)], "text string").select(plain(F.col("text"))).first()[0]
        full = np.full(0x110000, ord("~"), dtype=np.uint8)
        full[:128] = np.arange(128)
        full[ord("\r")], full[0x0B] = ord("\n"), ord("\t")  # as ends of lines and spaces that automata know
        full[points] = np.frombuffer(made.encode("ascii"), dtype=np.uint8)
        _TABLES.append(zlib.compress(full.tobytes()))
    return _TABLES[0]


@cache
def python_table() -> np.ndarray:
    """The same for what Python's own regular expressions hold for words, digits and spaces."""
    out = np.full(0x110000, ord("~"), dtype=np.uint8)
    out[:128] = np.arange(128)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace() and x not in "\n ":
            out[c] = ord("\t")
        elif c > 127 and x.isdecimal():
            out[c] = ord("0")
        elif c > 127 and x.isalnum():
            out[c] = ord("_")
    return out


def _items(parsed: object) -> Iterator[tuple]:
    """All nodes of a parsed pattern."""
    for op, arg in parsed:
        yield op, arg
        if op is K.BRANCH:
            for part in arg[1]:
                yield from _items(part)
        elif op is K.SUBPATTERN:
            yield from _items(arg[3])
        elif op is K.MAX_REPEAT:
            yield from _items(arg[2])
        elif op is K.IN:
            yield from arg


def _is_word(op: object, arg: object) -> bool:
    word = lambda c: c < 128 and (chr(c).isalnum() or c == 95)
    if op is K.LITERAL:
        return word(arg)
    if op is K.RANGE:
        return all(map(word, range(arg[0], arg[1] + 1)))
    return op is K.CATEGORY and arg in _WORD


def _word_at(parsed: list, step: int) -> bool:
    """Whether every match begins (step 1) or ends (step -1) with a word character, or with a boundary before or behind one."""
    nodes = list(parsed)[::step]
    if nodes and nodes[0] == (K.AT, K.AT_BOUNDARY):
        nodes = nodes[1:]
    for op, arg in nodes:
        if op is K.BRANCH:
            return all(_word_at(part, step) for part in arg[1])
        if op is K.SUBPATTERN:
            return _word_at(arg[3], step)
        if op is K.MAX_REPEAT:
            if not _word_at(arg[2], step):
                return False
            if arg[0]:
                return True
            continue
        return all(_is_word(*x) for x in arg) if op is K.IN else _is_word(op, arg)
    return False


def _bounded(parsed: list, step: int) -> bool:
    """Whether every alternative begins (1) or ends (-1) with a boundary."""
    nodes = list(parsed)[::step]
    if len(nodes) == 1 and nodes[0][0] is K.BRANCH:
        return all(_bounded(part, step) for part in nodes[0][1][1])
    return bool(nodes) and nodes[0] == (K.AT, K.AT_BOUNDARY)


def automaton(pattern: str, counted: bool) -> str | None:
    """The pattern for plain texts that matches (if ``counted``, as often) where ``pattern`` with Unicode classes does in the text; None if there is none.

    Arrow looks for the next match in what is left, as if nothing were before it. That is the same where a pattern without boundaries is met, or where each match
    begins with a word character at a boundary and its end is one; a match that ends inside a word is drawn to the word's end, before which none begins."""
    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return None
    if parsed.state.flags & ~re.UNICODE:
        return None
    for op, arg in _items(parsed):
        if op not in _ALLOWED or (op is K.AT and arg is not K.AT_BOUNDARY) or (op is K.SUBPATTERN and (arg[1] or arg[2])):
            return None
        if op is K.CATEGORY and arg not in (*_WORD, K.CATEGORY_SPACE):
            return None
        if op is K.LITERAL and (arg > 127 or arg in _MADE) or op is K.RANGE and (arg[1] > 127 or any(arg[0] <= c <= arg[1] for c in _MADE)):
            return None
    if not counted or not any(op is K.AT for op, _ in _items(parsed)):
        return pattern if parsed.getwidth()[0] else None
    if not _bounded(parsed, 1) or not _word_at(parsed, 1) and not (len(parsed) == 1 and parsed[0][0] is K.BRANCH and all(_word_at(p, 1) for p in parsed[0][1][1])):
        return None
    return pattern if _bounded(parsed, -1) else rf"(?:{pattern})\w*"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


#: Runs of what Java's Unicode class of white space has.
_GAPS = re.compile("[\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SPACE, _END, _VOWEL = _table("\t\n\x0b\x0c\r "), _table(".!?"), _table("aeiouy")


class Texts:
    """Plain texts with what is measured of them; what several measures need is made once."""

    def __init__(self, texts: pa.Array, to: np.ndarray):
        self.n, self.made = len(texts), {}
        off = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=self.n + 1, offset=4 * texts.offset) if self.n else np.zeros(1, dtype=np.int32)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
        off = (off - off[0]).astype(np.int64)
        try:
            self.whole = raw.tobytes().decode()
            if len(self.whole) < len(raw):
                off = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
        except UnicodeDecodeError:
            each = [raw[i:j].tobytes().decode(errors="replace") for i, j in zip(off[:-1], off[1:])]
            self.whole, off = "".join(each), np.cumsum([0, *map(len, each)])
        self.off, self.data = off, to[np.frombuffer(self.whole.encode("utf-32-le"), dtype=np.uint32)]
        self.texts = pa.Array.from_buffers(pa.string(), self.n, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(self.data)])
        self.begins = np.zeros(len(self.data) + 1, dtype=bool)  # the last place is of empty texts at the end
        self.begins[off[:-1]] = True

    def once(self, name: str, make: Callable[[], object]) -> object:
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def by_doc(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc(at), weights=weights, minlength=self.n).astype(np.int64)

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the runs of ``mask`` inside texts."""
        if not len(mask):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1] | self.begins[1:-1]
        last[:-1] &= ~mask[1:] | self.begins[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last)

    def space(self) -> np.ndarray:
        return self.once("space", lambda: _SPACE[self.data])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.once("words", lambda: self.runs(~self.space()))

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each part between sentence ends that has words the text and the number of words."""

        def make() -> tuple[np.ndarray, np.ndarray]:
            end = _END[self.data]
            first, _ = self.runs(~self.space() & ~end)
            doc, ends = self.doc(first), end.cumsum(dtype=np.int32)[first] if len(first) else first
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (ends[1:] != ends[:-1])])) if len(first) else first
            return doc[new], np.diff(np.append(new, len(first)))

        return self.once("parts", make)

    def sentences_with(self, word: str) -> np.ndarray:
        """How many sentences of each text hold ``word``, which has no end of a sentence."""
        data, at = self.once("bytes", self.data.tobytes), []
        i = data.find(word.encode())
        while i >= 0:
            at.append(i)
            i = data.find(word.encode(), i + 1)
        found = np.array(at, dtype=np.int64)
        doc = self.doc(found)
        found, doc = (x[doc == self.doc(found + len(word) - 1)] for x in (found, doc))
        ends = self.once("ends", lambda: _END[self.data].cumsum(dtype=np.int32))[found] if len(found) else found
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (ends[1:] != ends[:-1])])) if len(found) else found
        return np.bincount(doc[new], minlength=self.n)

    def different(self) -> np.ndarray:
        """How many different words each text has."""
        split = _GAPS.split if any(c in self.whole for c in "\x1c\x1d\x1e\x1f") else str.split  # which takes these for spaces
        return np.array([len({*split(self.whole[i:j])} - {""}) for i, j in zip(self.off[:-1], self.off[1:])], dtype=np.int64)

    def ordered(self, first: str, then: str) -> np.ndarray:
        """How many pairs of a sentence with ``first`` and a later one with ``then`` there are."""
        sentences = self.once("sentences", lambda: pc.split_pattern_regex(self.texts, "[.!?]+"))
        off = sentences.offsets.to_numpy()
        flat, begins, ends = sentences.flatten(), off[:-1] - off[0], off[1:] - off[0]
        a, b = (pc.match_substring_regex(flat, p).to_numpy(zero_copy_only=False) for p in (first, then))
        before = np.concatenate([[0], a.astype(np.int64).cumsum()])
        total = np.concatenate([[0], np.where(b, before[:-1] - before[np.repeat(begins, ends - begins)], 0).cumsum()])
        return total[ends] - total[begins]

    def measure(self, what: str, *more: str) -> np.ndarray:
        if what == "count":
            return pc.count_substring_regex(self.texts, more[0]).to_numpy(zero_copy_only=False)
        if what == "has":
            return pc.match_substring_regex(self.texts, more[0]).to_numpy(zero_copy_only=False)
        if what == "ordered":
            return self.ordered(*more)
        if what == "sentences_with":
            return self.sentences_with(*more)
        if what == "different":
            return self.different()
        if what == "letters":
            total = np.concatenate([[0], (~self.space()).cumsum(dtype=np.int64)])[self.off]
            return total[1:] - total[:-1]
        if what == "ends":  # parts between sentence ends, empty ones too
            return self.by_doc(self.runs(_END[self.data])[0]) + 1
        if what in ("sentences", "part_words", "long_sentences"):
            doc, n = self.parts()
            weights = None if what == "sentences" else n if what == "part_words" else n > 20
            return np.bincount(doc, weights=weights, minlength=self.n).astype(np.int64)
        first, last = self.words()
        if what == "words":
            return self.by_doc(first)
        if what == "long_words":
            return self.by_doc(first[last - first + 1 > 6])
        if what == "syllables":
            begun = np.zeros(len(self.data) + 1, dtype=np.int64)
            begun[self.runs(_VOWEL[self.data])[0] + 1] = 1
            begun = begun.cumsum()
            runs = begun[last + 1] - begun[first]
            return self.by_doc(first, np.maximum(runs - ((self.data[last] == ord("e")) & (runs > 1)), 1))
        raise ValueError(f"unknown measure {what}")


#: Bytes of text, on average, of a slice.
SLICE = 1 << 20


def counts(spark: SparkSession, texts: list[Column], jobs: list[tuple[int, str, tuple[str, ...]]]) -> Column:
    """An array of the results of ``jobs``: (number of the text, measure of ``Texts``, patterns of ``automaton`` or words)."""
    packed = table(spark)

    def one(a: list[Texts]) -> pa.Array:
        n = a[0].n
        values = np.stack([np.asarray(a[at].measure(what, *more), dtype=np.int64) for at, what, more in jobs], axis=1).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(jobs)), pa.array(values))

    @F.arrow_udf("array<bigint>")
    def of(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        to = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        for batch in it:
            columns = batch if isinstance(batch, tuple) else (batch,)
            rows = max(min(len(columns[0]) * SLICE // max(columns[0].nbytes, 1), 20_000), 1)
            for at in range(0, len(columns[0]), rows):  # what is made of a text is held for a slice only
                yield one([Texts(pc.fill_null(c.slice(at, rows), ""), to) for c in columns])
            if not len(columns[0]):
                yield pa.array([], pa.list_(pa.int64()))

    return of.asNondeterministic()(*texts)  # so that it stays in its place, once, where a filter uses what is made of it
