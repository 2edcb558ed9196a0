"""Language identification as inference of a multilingual mixture.

Every language is a distribution over hashed letter trigrams. A document is a sequence of words, each drawn from one of the
document's languages; expectation-maximisation estimates the proportions from the words' trigram likelihoods, first over all
languages, then over the 1, 2, .. largest of them, up to all. The set with the best penalised likelihood (half a log of the number of
words for each language beyond the first) is the document's, and its largest proportion names it.

Training counts trigrams over whole texts of at most ``Config.max_train_docs`` labelled rows; Spark adds up the counts.
Prediction reads whole texts in slices of bounded size and in numpy.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if no row is labelled. Equal
texts get equal results; ties go to the language whose name sorts first. One word of any length is one word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import without

UND = "und"
HAS_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Config:
    """max_train_docs: bound of the training sample; bits: of the trigram table; rounds: of expectation-maximisation; floor: weight of the uniform part in a word's likelihood."""

    max_train_docs: int = 12_000
    bits: int = 15
    rounds: int = 8
    smooth: float = 0.2
    slice_chars: int = 250_000


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (trigram bucket, language), float32


def _letters() -> np.ndarray:
    """Of each code point its lower-case letter, or 0; of a letter beyond the basic plane itself."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: np.ndarray | None = None


def letters() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    return _TABLE


def trigrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters in all texts: the bucket of (letter before the last, last letter, letter) with 0 at word begins, and the index of its word;
    and of the words: the index of their text."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)) + 1
    c = letters()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    is_letter = c > 0
    p1 = np.zeros_like(c)
    p2 = np.zeros_like(c)
    p1[1:] = c[:-1]
    p2[2:] = c[:-2]
    p2[p1 == 0] = 0
    h = (c * np.uint32(0x9E3779B1)) ^ (p1 * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) ^ (p2 * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - bits)
    begins = is_letter & (p1 == 0)
    word = np.cumsum(begins) - 1
    text_of = np.repeat(np.arange(len(texts)), lens)
    return h[is_letter].astype(np.int64), word[is_letter], text_of[begins]


def slices(texts: list[str | None], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """The texts with letters, in runs of about ``size`` characters."""
    at: list[int] = []
    n = 0
    for i, t in enumerate(texts):
        if t is None or not HAS_LETTER.search(t):
            continue
        at.append(i)
        n += len(t)
        if n >= size:
            yield at, [texts[k] for k in at]
            at, n = [], 0
    if at:
        yield at, [texts[k] for k in at]


def mixture(r: np.ndarray, start: np.ndarray, text_of: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text's languages after ``rounds`` steps from ``pi``, and the log likelihood. r: (word, language) likelihoods over the word's largest."""
    n = np.diff(np.append(start, len(r)))[:, None]
    for _ in range(rounds):
        g = r * pi[text_of]
        g /= np.maximum(g.sum(1, keepdims=True), 1e-30)
        pi = (np.add.reduceat(g, start, axis=0) / n).astype(np.float32)
    ll = np.add.reduceat(np.log(np.maximum((r * pi[text_of]).sum(1), 1e-30)), start)
    return pi, ll


def infer(texts: list[str | None], model: Model, cfg: Config) -> list[tuple[str, float, list[str]]]:
    """Of each text: the language with the largest proportion, that proportion, and the whole set."""
    out: list[tuple[str, float, list[str]]] = [(UND, 0.0, [])] * len(texts)
    if not model.langs:
        return out
    for at, some in slices(texts, cfg.slice_chars):
        h, word, text_of = trigrams(some, cfg.bits)
        keep = np.unique(text_of, return_index=True)
        start, present = keep[1], keep[0]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        ll = np.add.reduceat(model.logp[h], first, axis=0)
        r = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60)).astype(np.float32)
        k = np.searchsorted(present, text_of)
        m, width = len(present), len(model.langs)
        full, _ = mixture(r, start, k, np.full((m, width), 1 / width, dtype=np.float32), cfg.rounds)
        order = np.argsort(-full, axis=1, kind="stable")
        penalty = 0.5 * np.log(np.diff(np.append(start, len(r))) + 1.0)
        best = np.full(m, -np.inf)
        pi = full
        for size in range(1, width + 1):
            mask = np.zeros((m, width), dtype=np.float32)
            np.put_along_axis(mask, order[:, :size], 1.0, axis=1)
            if size == 1:
                p, like = mixture(r, start, k, mask, 0)
            else:
                p = full * mask
                p, like = mixture(r, start, k, (p + 1e-6 * mask) / (p + 1e-6 * mask).sum(1, keepdims=True), max(2, cfg.rounds // 2))
            score = like - penalty * (size - 1)
            better = score > best
            pi = np.where(better[:, None], p, pi)
            best = np.where(better, score, best)
        top = pi.argmax(1)
        for j, t in enumerate(present):
            row = pi[j]
            out[at[t]] = model.langs[top[j]], float(min(row[top[j]], 1.0)), [model.langs[x] for x in np.argsort(-row, kind="stable") if row[x] > 1e-4]
    return out


def sample(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """At most ``max_train_docs`` rows (more only if ids repeat) with text and lang, by the hash of the id; the first pass reads no texts."""
    ids = docs.filter("lang is not null and doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(cfg.max_train_docs)
    return docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")


def fit(rows: DataFrame, cfg: Config = Config()) -> Model:
    """Trigram distributions of the languages in ``rows`` (text, lang). Partitions count, Spark adds; the driver gets one table of 2^bits counts a language."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for p in it:
            for lang, group in p.groupby("lang"):
                table = tables.setdefault(lang, np.zeros(1 << cfg.bits, dtype=np.int64))
                for _, some in slices(group["text"].tolist(), cfg.slice_chars):
                    table += np.bincount(trigrams(some, cfg.bits)[0], minlength=1 << cfg.bits)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "at": at, "n": table[at]})

    got = rows.select("text", "lang").mapInPandas(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.full((1 << cfg.bits, len(langs)), cfg.smooth)
    for i, lang in enumerate(langs):
        g = got[got["lang"] == lang]
        counts[g["at"].to_numpy(), i] += g["n"].to_numpy()
    return Model(langs, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32) if langs else np.zeros((1 << cfg.bits, 0), dtype=np.float32))


def language_of(model: Model, cfg: Config = Config()):
    """A function of a text column that gives lang, score and langs."""

    @F.pandas_udf("lang string, score double, langs array<string>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            yield pd.DataFrame(infer(texts.tolist(), model, cfg), columns=["lang", "score", "langs"])

    return of


def identify(docs: DataFrame, model: Model, cfg: Config = Config()) -> DataFrame:
    """``docs`` with lang_pred string, score double and langs array (the mixture's set, largest first); input columns of these names are replaced."""
    found = without(docs, "lang_pred", "score", "langs", "_found").withColumn("_found", language_of(model, cfg)("text"))
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != "_found"], F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.langs").alias("langs"))
