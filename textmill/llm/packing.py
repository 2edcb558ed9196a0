"""Packing by length patterns.

Documents become ids and an end id; those longer than a sequence are cut. The histogram of piece lengths, at most as long as
a sequence, is all that the driver sees: patterns of up to four lengths that fill a sequence are enumerated, non-negative
least squares fits how often each repeats, the counts are rounded down to what the histogram holds, and the residual lengths
are packed best-fit, largest first, again as patterns with repeats. Pieces then find their places by length and rank. Ranks
come from counts by task and length, so that no task ever holds the pieces of one length.

Defined results: a null or empty text is the end id alone; a repeated row is packed as often as it occurs; a document of any
length is cut whole into pieces, only the last of which is shorter than a sequence; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import cut
from textmill.llm.tokens import proved, vocabulary

Plan = list[tuple[tuple[int, ...], int]]


def enumerate_patterns(hist: np.ndarray, capacity: int, most: int = 6000) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths, largest first, that leave at most one place free. hist[l]: how many pieces have length l. The most frequent
    lengths come first; ``most`` bounds the fit, what it leaves out is packed as residual."""
    have = hist > 0
    lens = np.flatnonzero(have)
    out = [(int(x),) for x in lens if x >= capacity - 1]
    for a in lens:
        for total in (capacity, capacity - 1):
            b = total - a
            if 0 < b <= a and have[b]:
                out.append((int(a), int(b)))
    often = lens[np.argsort(-hist[lens], kind="stable")]
    for k, a in enumerate(often[:512]):
        if len(out) >= most:
            break
        c = capacity - a - lens
        ok = (c > 0) & (c <= lens)
        ok[ok] = have[c[ok]]
        both = np.minimum(hist[lens[ok]], hist[c[ok]])
        for i in np.argsort(-both, kind="stable")[:12]:
            b = int(lens[ok][i])
            out.append(tuple(sorted((int(a), b, int(capacity - a - b)), reverse=True)))
        two = 2 * a if 2 * a < capacity else 0
        for b in often[k : k + 8] if two else ():
            d = capacity - two - b
            if d > 0 and have[d]:
                out.append(tuple(sorted((int(a), int(a), int(b), int(d)), reverse=True)))
    return list(dict.fromkeys(out))[:most]


def fit_counts(patterns: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Non-negative least squares of the repeat counts against the histogram, by coordinate descent."""
    parts = [np.unique(p, return_counts=True) for p in patterns]
    norm = [float((m * m).sum()) for _, m in parts]
    x = np.zeros(len(patterns))
    left = hist.astype(float).copy()
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, m) in enumerate(parts):
            step = max(float(left[at] @ m) / norm[j], -x[j])
            if step:
                x[j] += step
                left[at] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def _fill(left: np.ndarray, first: int, capacity: int) -> list[int]:
    """Lengths that go with ``first``: an exact fill by one, two or three of those left, else always the largest that fits."""
    left = left.copy()
    left[first] -= 1
    room = capacity - first
    out: list[int] = []
    while room > 0:
        have = np.flatnonzero(left[: room + 1] > 0)
        if not len(have):
            break
        if have[-1] == room:
            return [*out, room]
        exact = None
        tops = [None, *have[::-1][:48]]
        for b in tops:
            rest = room - (0 if b is None else int(b))
            if rest <= 0:
                continue
            if b is not None:
                left[b] -= 1
            some = np.flatnonzero(left[:rest] > 0)
            other = rest - some
            ok = (left[other] > 0) & ((other != some) | (left[other] > 1))
            if b is not None:
                left[b] += 1
            if ok.any():
                c = int(some[ok][-1])
                exact = ([] if b is None else [int(b)]) + [c, rest - c]
                break
        if exact:
            return out + exact
        big = int(have[-1])
        left[big] -= 1
        out.append(big)
        room -= big
    return out


def make_plan(hist: np.ndarray, capacity: int) -> Plan:
    """Patterns and how often each repeats; together they use every length as often as ``hist`` has it."""
    left = hist.astype(np.int64).copy()
    plan: Plan = []

    def take(pattern: tuple[int, ...], want: int) -> None:
        at, m = np.unique(pattern, return_counts=True)
        k = int(min(want, (left[at] // m).min()))
        if k > 0:
            left[at] -= k * m
            plan.append((tuple(sorted(pattern, reverse=True)), k))

    patterns = enumerate_patterns(left, capacity)
    x = fit_counts(patterns, left)
    for j in np.argsort(-x, kind="stable"):
        take(patterns[j], int(x[j]))
    while (has := np.flatnonzero(left > 0)).size:
        first = int(has[-1])
        take(tuple([first, *_fill(left, first, capacity)]), 1 << 62)
    return plan


def places(plan: Plan, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, k in plan:
        at = 0
        for x in pattern:
            runs.setdefault(x, []).append((used.get(x, 0), base, at))
            used[x] = used.get(x, 0) + k
            at += x
        base += k
    return {x: tuple(np.array(r, dtype=np.int64).T) for x, r in runs.items()}


def pieces(docs: DataFrame, name: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and task and rank: the piece's number among those of its length that the task made."""

    table = proved(name)

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = b"\0\0\0\0"
        with vocabulary(name, table) as v:
            for p in it:
                rows = []
                for d, ids in zip(p["doc_id"], v.ids(p["text"].tolist())):
                    ids += end
                    n = len(ids) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        part = ids[4 * s : 4 * (s + capacity)]
                        x = len(part) // 4
                        rows.append((d, k, s, x, zlib.crc32(part), task, seen[x]))
                        seen[x] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = 2048) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = cut(pieces(docs, name, capacity), "pieces")
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        hist[r["length"]] = r["n"]
    at = places(make_plan(hist, capacity), capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        x, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(x)), dtype=np.int64)
        for k in np.unique(x):
            rows = np.flatnonzero(x == k)
            first, seq, off = at[int(k)]
            i = np.searchsorted(first, r[rows], side="right") - 1
            out[0, rows] = seq[i] + r[rows] - first[i]
            out[1, rows] = off[i]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    placed = made.join(base, ["task", "length"]).withColumn("at", place("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
