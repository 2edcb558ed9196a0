"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted by balanced k-means on a sample bounded by ``Config.sample``; their number follows the table, so that lists
keep their size, up to ``most_lists``; beyond, lists grow and are searched in more parts. Every vector goes to its nearest
centroid's list and, where it lies near a boundary, to further lists whose centroids are at most ``1 + replicate`` times as
far. A query finds centroids by best-first search in an in-memory graph of them and probes the lists whose centroid is at most
``1 + probe`` times as far as the nearest (distance-ratio pruning). A list meets its queries in tasks of at most about ``part``
vectors and ``query_part`` queries; a query's partial results are its nearest of each part.

Nearness is the cosine in double precision of the original vectors. Defined results: vectors that are null, zero, hold a null
or non-finite component, or have another length than most, take no part; so do null ids. Rows with equal ids are candidates
each by its own vector, the nearest of which counts, and queries by that with the least vector. Ties go to the smaller id. A
query with fewer candidates than asked for gets all that its lists hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import cut


@dataclass(frozen=True)
class Config:
    """sample: rows the centroids are fitted on; list_size: vectors a list, for the number of centroids; replicas: lists a vector at most."""

    sample: int = 20_000
    list_size: int = 256
    most_lists: int = 4096
    replicas: int = 8
    replicate: float = 0.06
    probe: float = 0.22
    degree: int = 24
    part: int = 4096
    query_part: int = 2048
    rounds: int = 8


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # (centroid, neighbour)
    entries: np.ndarray


def usable(df: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id long and v array<double> of the rows that take part."""
    v = F.col(vec).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(ok)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(rows: DataFrame, cfg: Config = Config()) -> Index:
    """Balanced k-means on at most ``sample`` vectors, by the hash of the id; in each round a centroid with more than its share looks farther away."""
    n = rows.count()
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cfg.sample).select("v").toPandas()
    if not len(got):
        return Index(np.zeros((0, 0)), np.zeros((0, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
    x = unit(np.stack(got["v"].to_numpy()))
    k = int(min(max(1, n // cfg.list_size), cfg.most_lists, len(x)))
    c = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    weight = np.zeros(k)
    for _ in range(cfg.rounds):
        near = np.concatenate([(x[lo : lo + 2048] @ c.T - weight).argmax(1) for lo in range(0, len(x), 2048)])
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = count > 0
        norm = np.sqrt((total * total).sum(1))
        full &= norm > 0
        c[full] = total[full] / norm[full][:, None]
        weight += 0.02 * (count / max(count.mean(), 1e-9) - 1).clip(-1, 2)
    sim = c @ c.T
    np.fill_diagonal(sim, -9)
    degree = min(cfg.degree, k - 1)
    near = np.argsort(-sim, axis=1, kind="stable")[:, : max(degree - degree // 4, 0)]
    far = np.random.default_rng(6).integers(0, k, (k, degree // 4)) if k > 1 else np.zeros((k, 0), dtype=np.int64)
    return Index(c, np.concatenate([near, far], axis=1).astype(np.int64), np.unique(np.linspace(0, k - 1, min(k, 8)).astype(np.int64)))


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def assign(x: np.ndarray, index: Index, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs of unit vectors."""
    d = distance(x @ index.centroids.T)
    r = min(cfg.replicas, d.shape[1])
    order = np.argsort(d, axis=1, kind="stable")[:, :r]
    near = np.take_along_axis(d, order, axis=1)
    take = near <= (1 + cfg.replicate) * near[:, :1] + 1e-12
    i, j = np.nonzero(take)
    return i, order[i, j]


def probes(q: np.ndarray, index: Index, cfg: Config) -> list[int]:
    """Lists to search for one unit vector: best-first over the graph while there are centroids within the ratio of the nearest seen."""
    c = index.centroids
    d = {int(e): float(x) for e, x in zip(index.entries, distance(c[index.entries] @ q))}
    heap = [(x, e) for e, x in d.items()]
    heapq.heapify(heap)
    best = min(d.values())
    spare = 4  # nodes beyond the ratio that are followed all the same
    while heap:
        x, e = heapq.heappop(heap)
        if x > (1 + cfg.probe) * best:
            if not spare:
                break
            spare -= 1
        new = [int(v) for v in dict.fromkeys(index.graph[e].tolist()) if v not in d]
        if new:
            for v, y in zip(new, distance(c[new] @ q).tolist()):
                d[v] = y
                heapq.heappush(heap, (y, v))
                best = min(best, y)
    return [e for e, x in d.items() if x <= (1 + cfg.probe) * best]


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, cosine) of the k nearest ids of each query among x, its own left out: a matrix product chooses, sums in one fixed order give the score. A
    repeated id has the score of its nearest vector."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    start = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    rows, out, scores = [], [], []
    for lo in range(0, len(q), 256):
        s = (q[lo : lo + 256] @ x.T) / (nq[lo : lo + 256, None] * nx[None])
        s[qid[lo : lo + 256, None] == ids[None]] = -np.inf
        top = s if len(start) == len(ids) else np.maximum.reduceat(s, start, axis=1)
        kth = np.partition(top, -k, axis=1)[:, -k][:, None] if top.shape[1] > k else np.full((len(s), 1), -np.inf)
        i, j = np.nonzero((s >= kth - 1e-9) & (s > -np.inf))
        exact = (q[lo + i] * x[j]).sum(1) / (nq[lo + i] * nx[j])
        order = np.lexsort((-exact, ids[j], i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.append(True, (np.diff(i) != 0) | (np.diff(ids[j]) != 0))[: len(i)]
        i, j, exact = i[best], j[best], exact[best]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        _, first, n = np.unique(i, return_index=True, return_counts=True)
        keep = np.arange(len(i)) - np.repeat(first, n) < k
        rows.append(lo + i[keep])
        out.append(ids[j[keep]])
        scores.append(exact[keep])
    return tuple(np.concatenate(a) if a else np.zeros(0) for a in (rows, out, scores))


def packed(vectors: pd.Series) -> np.ndarray:
    """Vectors in one matrix; from bytes or from lists."""
    if len(vectors) and isinstance(vectors.iloc[0], bytes):
        return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)
    return np.stack(vectors.to_numpy())


def search(rows: DataFrame, is_query: Column, k: int = 5, cfg: Config = Config()) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row of ``rows`` (see ``usable``) for which ``is_query`` holds."""
    spark = rows.sparkSession
    rows = cut(rows, "vectors")
    index = fit(rows, cfg)

    def to_lists(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for lo in range(0, len(p), 2000):
                q = p.iloc[lo : lo + 2000]
                v = packed(q["v"])
                i, j = assign(unit(v), index, cfg)
                raw = np.array([r.tobytes() for r in v], dtype=object)
                yield pd.DataFrame({"list": j, "vec_id": q["vec_id"].to_numpy()[i], "v": raw[i]})

    def to_probes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for lo in range(0, len(p), 500):
                q = p.iloc[lo : lo + 500]
                v = packed(q["v"])
                found = [probes(x, index, cfg) for x in unit(v)]
                i = np.repeat(np.arange(len(q)), [len(f) for f in found])
                raw = np.array([r.tobytes() for r in v], dtype=object)
                yield pd.DataFrame({"list": [x for f in found for x in f], "query_id": q["vec_id"].to_numpy()[i], "v": raw[i]})

    lists = cut(rows.mapInPandas(to_lists, "list long, vec_id long, v binary"), "lists")
    wanted = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(spark.sparkContext.defaultParallelism, "vec_id")
    asked = cut(wanted.mapInPandas(to_probes, "list long, query_id long, v binary"), "probes")
    count = lambda df, by, name: df.groupBy("list").agg(F.ceil(F.count("*") / by).cast("int").alias(name))
    parts = F.broadcast(count(lists, cfg.part, "parts").join(count(asked, cfg.query_part, "turns"), "list"))  # at most ``most_lists`` rows
    own = lambda of, *by: F.pmod(F.xxhash64(*by), of).cast("int")
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    q = asked.join(parts, "list").select("list", upto("parts").alias("part"), own("turns", "query_id").alias("turn"), "query_id", "v")
    x = lists.join(parts, "list").select("list", own("parts", "vec_id", "v").alias("part"), upto("turns").alias("turn"), "vec_id", "v")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qid = q["query_id"].to_numpy()
        i, ids, s = nearest(packed(q["v"]), qid, packed(x["v"]), x["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": qid[i.astype(np.int64)], "vec_id": ids.astype(np.int64), "score": s})

    by = ("list", "part", "turn")
    met = q.groupBy(*by).cogroup(x.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    one = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
