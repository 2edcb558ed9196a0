"""De-duplication by content: exact by hash, and similar texts by sequence ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.shared import cut, release


def text_key() -> Column:
    """MD5 of the text; of a null one a word that is none."""
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))


def dedup_documents(df: DataFrame, order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """The first row of each text in the given order; null texts are one text, another than the empty one. Hash and order go through the aggregate, and a text
    that many rows share is first cut to one row for each part, so that no task gets them all. ``seen`` (column md5): texts of earlier runs that go."""
    rows = df.withColumn("_md5", text_key())
    if seen is not None:
        rows = rows.join(seen.select(F.col("md5").alias("_md5")), "_md5", "left_anti")
    first = rows.groupBy("_md5").agg(F.min(F.struct(*order)).alias("_first"))  # partial minima: one row for each task and text is shuffled
    return rows.join(first, (rows["_md5"] == first["_md5"]) & (F.struct(*order) == F.col("_first")), "left_semi").dropDuplicates(["_md5"]).drop("_md5")


def dedup_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """The first chunk of each text over all documents."""
    return dedup_documents(chunks, order)


def seen_hashes(df: DataFrame) -> DataFrame:
    """What a later run passes as ``seen``."""
    return df.select(text_key().alias("md5")).distinct()


#: Counts of a text's characters by code point modulo LETTERS, and of its runs of three by hash modulo GRAMS for texts of at least LONG characters: by letters
#: alone unrelated short texts are told apart. A block has at most BLOCK texts; STEP is the ratio of lengths between neighbouring classes.
LETTERS, GRAMS, LONG, BLOCK, STEP = 32, 1024, 300, 16_384, 1.01


def counted(text: str) -> tuple[int, bytes, bytes]:
    """Length, letters (two bytes each) and grams (a byte each, empty for short texts) of a text; counts beyond a place's largest number are that number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.minimum(np.bincount(c % LETTERS, minlength=LETTERS), 65535).astype(np.uint16).tobytes()
    if len(c) < LONG:
        return len(c), letters, b""
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1]) * np.uint32(0x85EBCA77) ^ c[2:]
    h = (h * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
    return len(c), letters, np.minimum(np.bincount(h, minlength=GRAMS), 255).astype(np.uint8).tobytes()


def blocks_of(counts: dict[int, int], most: int, threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Of the number of texts of each class of lengths the blocks (class, part, parts; classes of few texts share a block's number) and the pairs of blocks, equal
    ones too, that can hold similar texts. The first list is by block and has a tuple (block, class, parts, part) for each."""
    out: list[tuple[int, int, int, int]] = []
    spans: list[tuple[int, int]] = []
    room = 0
    for f, n in sorted(counts.items()):
        if n > most:
            parts = -(-n // most)
            out += [(len(spans) + i, f, parts, i) for i in range(parts)]
            spans += [(f, f)] * parts
            room = 0
        elif n <= room:
            out.append((len(spans) - 1, f, 1, 0))
            spans[-1] = (spans[-1][0], f)
            room -= n
        else:
            out.append((len(spans), f, 1, 0))
            spans.append((f, f))
            room = most - n
    low, high = lambda f: STEP**f * (1 - 1e-6), lambda f: STEP ** (f + 1) * (1 + 1e-6)
    pairs = []
    for i, (_, top) in enumerate(spans):
        for j in range(i, len(spans)):  # spans ascend
            if low(spans[j][0]) * threshold > high(top) * (2 - threshold):
                break
            pairs.append((i, j))
    return out, pairs


def compare(k: np.ndarray, n: np.ndarray, side: np.ndarray, letters: np.ndarray, grams: dict[int, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the pairs of a pair of blocks that may be similar, in pieces. Rows ascend by ``n``; side: 0 and 1 are compared with each other, 2 among themselves.
    An insertion or deletion changes one of the letters' counts by one, and five of the runs' at most."""
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    nb, lb = n[b], np.ascontiguousarray(letters[b].T)
    gb = np.zeros((len(b), GRAMS), dtype=np.uint8) if grams else None
    long = n >= LONG
    for at, i in enumerate(b):
        if i in grams:
            gb[at] = grams[i]
    first = np.searchsorted(nb, np.floor(n[a] * threshold / (2 - threshold) * (1 - 1e-9)), "left")
    last = np.searchsorted(nb, np.ceil(n[a] * (2 - threshold) / threshold * (1 + 1e-9)), "right")
    x: list[np.ndarray] = []
    y: list[np.ndarray] = []
    size = 0
    for at, (i, lo, hi) in enumerate(zip(a, first, last)):
        lo = max(lo, at + 1) if side[i] == 2 else lo
        if lo >= hi:
            continue
        own, part = letters[i][:, None], lb[:, lo:hi]
        far = (np.maximum(part, own) - np.minimum(part, own)).sum(axis=0, dtype=np.uint32)
        near = lo + np.flatnonzero(far <= (1 - threshold) * (n[i] + nb[lo:hi]) + 1e-6)
        if len(near) and long[i]:
            for z in range(0, len(near), 4096):
                some = near[z : z + 4096]
                g = gb[some]
                far = (np.maximum(g, grams[i]) - np.minimum(g, grams[i])).sum(axis=1, dtype=np.uint32)
                some = some[~long[b[some]] | (far <= 5 * ((1 - threshold) * (n[i] + nb[some]) + 1e-6))]
                x.append(np.full(len(some), i))
                y.append(b[some])
                size += len(some)
        else:
            x.append(np.full(len(near), i))
            y.append(b[near])
            size += len(near)
        if size > 200_000:
            yield k[np.concatenate(x)], k[np.concatenate(y)]
            x, y, size = [], [], 0
    if size:
        yield k[np.concatenate(x)], k[np.concatenate(y)]


def candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) of the keys of ``texts`` (k, text; neither repeats) whose lengths and counts of characters and runs let them be similar, each once.

    Texts are dealt into blocks by length, and only blocks of near lengths meet, so that a task holds two blocks of counts and no text. The number of
    comparisons is still quadratic in the texts of near lengths; each is of some nanoseconds."""
    spark, kind = texts.sparkSession, texts.schema["k"].dataType.simpleString()

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            for at in range(0, len(rows), 1000):
                p = rows.iloc[at : at + 1000]
                got = [counted(t) for t in p["text"]]
                n = np.array([g[0] for g in got], dtype=np.int64)
                yield pd.DataFrame({"k": p["k"].array, "n": n, "f": np.floor(np.log(n) / math.log(STEP)).astype(np.int32), "letters": [g[1] for g in got], "grams": [g[2] for g in got]})

    every = cut(texts.select("k", "text").mapInPandas(of, f"k {kind}, n long, f int, letters binary, grams binary"), "counts")
    counts = {r["f"]: r["n"] for r in every.groupBy("f").agg(F.count("*").alias("n")).collect()}  # a row for each class of lengths
    blocks, pairs = blocks_of(counts, min(BLOCK, max(256, sum(counts.values()) // 32)), threshold)
    meets: dict[int, list[tuple[int, int]]] = {}
    for pair, (i, j) in enumerate(pairs):
        if i == j:
            meets.setdefault(i, []).append((pair, 2))
        else:
            meets.setdefault(i, []).append((pair, 0))
            meets.setdefault(j, []).append((pair, 1))
    plan = spark.createDataFrame([(f, parts, part, meets[block]) for block, f, parts, part in blocks], "f int, parts int, part int, meets array<struct<pair:int,side:int>>")
    dealt = every.join(F.broadcast(plan), "f").filter(F.pmod(F.xxhash64("k"), F.col("parts")) == F.col("part"))
    dealt = dealt.select("k", "n", "letters", "grams", F.explode("meets").alias("m")).select("m.pair", "m.side", "k", "n", "letters", "grams")
    dealt = dealt.repartition(min(max(len(pairs), 1), 4000), "pair").sortWithinPartitions("pair", "n")

    def run(got: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(got, ignore_index=True)
        letters = np.frombuffer(b"".join(p["letters"]), dtype=np.uint16).reshape(len(p), LETTERS)
        grams = {i: np.frombuffer(g, dtype=np.uint8) for i, g in enumerate(p["grams"]) if g}
        for x, y in compare(p["k"].to_numpy(), p["n"].to_numpy(), p["side"].to_numpy(), letters, grams, threshold):
            yield pd.DataFrame({"a": x, "b": y})

    def met(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: list[pd.DataFrame] = []
        for rows in it:
            for pair, p in rows.groupby("pair"):  # ascends, as the rows do
                if got and got[0]["pair"].iloc[0] != pair:
                    yield from run(got)
                    got = []
                got.append(p)
        if got:
            yield from run(got)

    found = dealt.mapInPandas(met, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_pairs(df: DataFrame, key: str, threshold: float = 0.95) -> DataFrame:
    """Pairs (a < b, ratio) of rows whose texts have a sequence ratio of at least ``threshold``, all of them.

    A ratio is at most 2 * LCS / (n + m), so similar texts differ by at most (1 - threshold) * (n + m) insertions and deletions, which bounds how far their
    counts of characters and of runs of three are apart. Candidates are the pairs within these bounds; they are compared in full. Equal texts are compared once."""
    rows = df.select(F.col(key).alias("k"), "text").filter("k is not null and length(text) > 0")
    texts = cut(rows.groupBy("text").agg(F.min("k").alias("k"), F.max("k").alias("last")), "texts")
    cand = cut(candidates(texts, threshold), "candidates")

    @F.pandas_udf("double")
    def ratio(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def of(u: str, v: str) -> float:
            m = SequenceMatcher(None, u, v)
            return m.ratio() if m.quick_ratio() >= threshold else 0.0  # quick_ratio is never less

        for x, y in it:
            yield pd.Series([of(u, v) for u, v in zip(x, y)], dtype="float64")

    # a ratio depends on the order of its texts; the other order is needed if a row of the second text is before one of the first
    both = cand.join(texts.select(F.col("k").alias("a"), F.col("text").alias("ta"), F.col("last").alias("la")), "a").join(texts.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")
    both = both.repartition(min(max(df.sparkSession.sparkContext.defaultParallelism, cand.count() // 5000), 4000))  # few bytes, but long work
    ordered = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("ta").alias("x"), F.col("tb").alias("y")), F.when(F.col("b") < F.col("la"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tb").alias("x"), F.col("ta").alias("y"))))
    found = both.select(F.explode(ordered).alias("o")).filter("o is not null").select("o.*").withColumn("ratio", ratio("x", "y")).filter(F.col("ratio") >= threshold).select("a", "b", "ratio")
    same = texts.filter("k < last").select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("ratio"))
    member = rows.join(texts.select("text", F.col("k").alias("r")), "text").select("k", "r")
    x, y = member.select(F.col("k").alias("ka"), F.col("r").alias("a")), member.select(F.col("k").alias("kb"), F.col("r").alias("b"))
    return found.unionByName(same).join(x, "a").join(y, "b").filter("ka < kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ratio")


def dedup_similar(df: DataFrame, key: str, threshold: float = 0.95) -> DataFrame:
    """Greedy in key order: a row goes if it is similar to an earlier one that stays. The rows without an earlier undecided partner are decided in each
    round, until no pair is left; the least row of the pairs is always among them. Every round is cut."""
    spark = df.sparkSession
    pairs = cut(similar_pairs(df, key, threshold).select("a", "b"), "pairs")
    schema, gone = pairs.select("b").schema, []
    while not pairs.isEmpty():
        keep = pairs.select("a").join(pairs.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        out = cut(pairs.join(keep, "a", "left_semi").select("b").distinct(), "gone")
        gone.append(out._cut_path)
        left = cut(pairs.join(out.select(F.col("b").alias("a")), "a", "left_anti").join(out, "b", "left_anti").select("a", "b"), "pairs")
        release(pairs)
        pairs = left
    return df.join(spark.read.schema(schema).parquet(*gone).select(F.col("b").alias(key)).distinct(), key, "left_anti") if gone else df


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, by a window; for groups of bounded size."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
