"""Toxicity by compression distance.

Two zstandard dictionaries compress each window of a document; the bytes that the toxic one saves over the ordinary one are
the window's distance. zstandard's trainer makes both. The ordinary one is trained on pieces of ordinary documents, in words that are not toxic ones' own. Toxic
documents are ordinary prose with a few toxic words, so that a dictionary of their whole text would be another ordinary one:
the toxic dictionary is trained on what they do not share with ordinary documents (the beginnings of words that recur in toxic
documents, behind many different words, and at far lower a rate in ordinary ones; once these words whole and once cut to that
beginning, of which calibration keeps the better) and has the ordinary content before that.
The ordinary dictionary is padded to the same length, so that shared content costs the same in either.

A document's features are the spread of its windows' distances; a logistic map of them to 0..1, and the threshold that passes
at most ``Config.false_share`` of ordinary documents, are calibrated on labelled documents that the dictionaries have not seen.
Training reads a sample of labelled rows bounded by ``Config.max_train_docs`` a class; scoring reads whole texts.

Defined results: a null or empty text scores as a text without windows; equal texts score equally; a text of any length is cut
into windows of words, one long word alone into pieces of ``Config.max_window`` characters. Without labelled rows of both
classes, or where the dictionaries do not tell them apart, every score is near 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import without

WORD = re.compile(r"[^\W\d_]+")
END = b"\0" * 16  # no match begins in the last bytes of an input or of a dictionary
FEATURES = 6


@dataclass(frozen=True)
class Config:
    """window_words: words a window; max_train_docs: bound of the sample, by class; max_pieces: bound of the pieces, of piece_words words, that a dictionary is
    trained on, by class; ordinary_bytes, toxic_bytes: sizes of the dictionaries' contents; min_docs, min_share, min_log_odds and
    min_contexts (different words before it): what a word's beginning needs to be text of toxic documents alone; false_share: of ordinary documents that may pass the threshold."""

    window_words: int = 5
    max_window: int = 256
    max_train_docs: int = 3000
    max_pieces: int = 40_000
    piece_words: int = 40
    beginnings: tuple[int, ...] = (4, 5, 6, 8, 10)
    min_docs: int = 4
    min_share: float = 0.02
    min_log_odds: float = 3.5
    min_contexts: int = 10
    ordinary_bytes: int = 8192
    toxic_bytes: int = 900
    false_share: float = 0.025


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [-20.0, *[0.0] * FEATURES])


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def beginnings(word: str, cfg: Config) -> list[str]:
    """Of a word those of the lengths in ``cfg``, and the word."""
    return list(dict.fromkeys([*(word[:k] for k in cfg.beginnings if len(word) > k), word]))


def segments(text: str | None, cfg: Config) -> dict[str, int]:
    """Beginnings of the text's words, each with the set of the words before it as 63 hashed bits."""
    out: dict[str, int] = {}
    before = ""
    for w in words(text):
        bit = 1 << (zlib.crc32(before.encode()) % 63)
        for s in beginnings(w, cfg):
            out[s] = out.get(s, 0) | bit
        before = w
    return out


def windows(text: str | None, cfg: Config) -> list[bytes]:
    """The whole text, lower-cased, in windows of ``window_words`` words; longer ones than ``max_window`` characters are cut."""
    every = (text or "").lower().split()
    out = []
    for i in range(0, len(every), cfg.window_words):
        w = " " + " ".join(every[i : i + cfg.window_words])
        out.extend(w[k : k + cfg.max_window].encode("utf-8", "replace") for k in range(0, len(w), cfg.max_window))
    return out


def train(pieces: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary of ``size`` bytes that zstandard trains on ``pieces``; of too few to train on, their last ``size`` bytes."""
    try:
        return zstandard.train_dictionary(size + 4096, pieces, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=6, strategy=zstandard.STRATEGY_GREEDY,
    )
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


class Scorer:
    """Distances of windows and scores of texts; the compressors are made once for a task."""

    def __init__(self, model: Model, cfg: Config):
        self.model, self.cfg = model, cfg
        self.t, self.o = compressor(model.toxic).compress, compressor(model.ordinary).compress

    def savings(self, text: str | None) -> np.ndarray:
        """By window: the bytes that the toxic dictionary saves over the ordinary one."""
        t, o = self.t, self.o
        ws = windows(text, self.cfg)
        return np.fromiter((len(o(w + END)) - len(t(w + END)) for w in ws), dtype=np.int32, count=len(ws))

    def features(self, text: str | None) -> list[float]:
        """Windows that save 2, 4 and 6 bytes (logarithms), the largest saving, the share of windows that save 3, and the mean saving."""
        s = self.savings(text)
        if not len(s):
            return [0.0] * FEATURES
        many = [float(np.log1p((s >= k).sum())) for k in (2, 4, 6)]
        return [*many, min(max(int(s.max()), 0), 20) / 10, 5 * float((s >= 3).mean()), float(np.clip(s, -4, 10).mean())]

    def score(self, text: str | None) -> float:
        z = self.model.weights[0] + float(np.dot(self.model.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weights of a class-balanced logistic fit, the intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * np.r_[0, w[1:]]
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return [float(v) for v in w]


def calibrate(model: Model, y: np.ndarray, x: np.ndarray, cfg: Config) -> float:
    """Set the logistic weights of features ``x``, moved so that at most ``false_share`` of the ordinary documents score 0.5 or more; by how much the share of
    toxic documents that do is larger."""
    w = logistic(x, y)
    z = x @ np.array(w[1:]) + w[0]
    bar = max(0.0, float(np.quantile(z[y == 0], 1 - cfg.false_share)) + 1e-9)
    model.weights = [w[0] - bar, *w[1:]]
    return float((z[y == 1] >= bar).mean() - (z[y == 0] >= bar).mean())


def own_beginnings(counts: dict[str, tuple[int, ...]], n: tuple[int, int], cfg: Config) -> dict[str, str]:
    """Of beginnings (documents with it: ordinary, toxic; contexts: ordinary, toxic) the shortest of toxic documents alone, and how each goes on in most."""
    least = max(cfg.min_docs, cfg.min_share * n[1])
    odds = lambda c: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
    good = {s for s, c in counts.items() if c[1] >= least and odds(c) >= cfg.min_log_odds and c[3].bit_count() >= cfg.min_contexts}
    out: dict[str, str] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        head = next((s[:k] for k in range(1, len(s)) if s[:k] in out), None)
        if head is None:
            out[s] = s
        elif counts[s][1] >= 0.8 * counts[head][1]:
            out[head] = s
    return out


def class_text(text: str | None, own: dict[str, str], cfg: Config) -> tuple[list[str], list[str], list[str]]:
    """The text's words that toxic documents do not share with ordinary ones, these cut to the beginning that they do not share, and the other words."""
    whole, cut, rest = [], [], []
    for w in words(text):
        head = next((b for b in beginnings(w, cfg) if b in own), None)
        if head is None:
            rest.append(w)
        elif w.startswith(own[head]):
            whole.append(w)
            cut.append(own[head])
    return whole, cut, rest


def fit(labelled: DataFrame, cfg: Config = Config()) -> Model:
    """Train on ``labelled`` (doc_id, text, toxic 0/1; at most ``max_train_docs`` rows a class, see ``sample``). Counts of beginnings are added up by Spark; the
    driver gets those that pass ``min_docs``, at most ``max_pieces`` pieces a class, and one row of features for each calibration row."""
    rows = labelled.select("text", F.col("toxic").cast("int").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("cal"))
    seen = rows.filter("not cal").select("text", "y")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: tuple[dict, dict] = ({}, {})
        for p in it:
            for t, y in zip(p["text"], p["y"]):
                for seg, bits in {"": 0, **segments(t, cfg)}.items():
                    n, old = docs[y].get(seg, (0, 0))
                    docs[y][seg] = n + 1, old | bits
        for y in (0, 1):
            yield pd.DataFrame([(k, y, n, bits) for k, (n, bits) in docs[y].items()], columns=["seg", "y", "n", "bits"])

    own = lambda f, col, y: f(F.when(F.col("y") == y, F.col(col)).otherwise(F.lit(0).cast("long")))
    per = seen.mapInPandas(count, "seg string, y int, n long, bits long")
    per = per.groupBy("seg").agg(own(F.sum, "n", 0).alias("a"), own(F.sum, "n", 1).alias("b"), own(F.bit_or, "bits", 0).alias("c"), own(F.bit_or, "bits", 1).alias("d"))
    got = {r["seg"]: tuple(r)[1:] for r in per.filter((F.col("b") >= cfg.min_docs) | (F.col("seg") == "")).collect()}
    n = got.pop("", (0, 0))[:2]
    if not all(n):
        return Model()
    alone = own_beginnings(got, n, cfg)
    if not alone:
        return Model()

    def cut_up(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            out = []
            for t, y in zip(p["text"], p["y"]):
                whole, begun, rest = class_text(t, alone, cfg)
                for kind, w in ((1, whole), (2, begun)) if y == 1 else ((0, rest),):
                    out += [(kind, " ".join(["", *w[i : i + cfg.piece_words], ""]).encode()) for i in range(0, len(w), cfg.piece_words)]
            yield pd.DataFrame(out, columns=["kind", "piece"])

    pieces = seen.mapInPandas(cut_up, "kind int, piece binary")
    some = [[bytes(r["piece"]) for r in pieces.filter(F.col("kind") == k).orderBy(F.xxhash64("piece"), "piece").limit(cfg.max_pieces).collect()] for k in range(3)]
    ordinary = train(some[0], cfg.ordinary_bytes, 64)
    own_part = [train(x, cfg.toxic_bytes, 24).lstrip(b"\0") for x in some[1:]]
    models = [Model(ordinary + x + END, ordinary + b"\0" * len(x) + END) for x in own_part]

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(m, cfg) for m in models]
        for p in it:
            yield pd.DataFrame({"y": p["y"], "x": [[v for s in scorers for v in s.features(t)] for t in p["text"]]})

    cal = [(r["y"], r["x"]) for r in rows.filter("cal").select("text", "y").mapInPandas(measure, "y int, x array<double>").collect()]
    if {a for a, _ in cal} != {0, 1}:
        return Model()
    y, x = np.array([a for a, _ in cal], dtype=float), np.array([b for _, b in cal])
    apart, best = max((calibrate(m, y, x[:, FEATURES * k : FEATURES * (k + 1)], cfg), -k) for k, m in enumerate(models))
    return models[-best] if apart >= 0.05 else Model()  # else the dictionaries tell nothing apart


def sample(docs: DataFrame, labels: DataFrame, cfg: Config = Config()) -> DataFrame:
    """At most ``max_train_docs`` rows of each label, by the hash of the id: whole texts of a bounded number of rows."""
    one = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    h = F.xxhash64("doc_id")
    ids = [one.filter(F.col("toxic") == y).orderBy(h, "doc_id").limit(cfg.max_train_docs) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")


def score_of(model: Model, cfg: Config = Config()):
    """A function of a text column that gives its score."""

    @F.pandas_udf("double")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(model, cfg)
        for texts in it:
            yield pd.Series([s.score(t) for t in texts], dtype="float64")

    return of


def score(docs: DataFrame, model: Model, cfg: Config = Config()) -> DataFrame:
    """``docs`` with score double and predicted int; input columns of these names are replaced."""
    out = without(docs, "score", "predicted").withColumn("score", score_of(model, cfg)("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
