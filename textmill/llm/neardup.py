"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents with the same shingle set are one class. Every class representative is posted under its signature's (coordinate,
value) pairs. Two signatures with at least ``match`` equal coordinates share one of the K - match + 1 rarest postings of each
(prefix); in those, partners meet and their collisions over all coordinates are counted; the frequent postings are never
merged, only looked up for pairs that have met (skip). Pairs that reach ``match`` are confirmed on the full shingle sets.

A posting with many documents is not expanded into pairs. First every document meets the leaders of its postings; what the
confirmed links connect is one component. Then only documents outside their posting's largest component meet the others of
it, in blocks, so that each link between components is still found; links inside a component add nothing and are skipped.
Where many documents are outside, the posting is first divided by a second coordinate (and a third, ..): a pair with ``match``
equal coordinates shares two of the K - match + 2 rarest, so that the divided postings lose no pair either.

Pairs are confirmed on sets of 64-bit shingle hashes; two different shingles of a text pair are equal by chance in 2^-64.

Defined results: a document without words has the empty set and is linked with nothing; one with fewer words than a shingle
has the whole sequence as its shingle; rows with equal ids are one document whose set is that of the first text in binary
order; a null id gets a row of its own with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import broadcast_checked, cut, release

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
P = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass(frozen=True)
class Config:
    """shingle: words; percent: 100 * intersection >= percent * union; coords: K; match: collisions that a pair needs. With K = 32 a pair at 85 %
    has under 16 collisions with a chance of about 2e-7. small: documents of a posting that is expanded into pairs; block: documents of a block; wide: blocks of
    documents outside the largest component beyond which a posting is divided: then its blocks have more rows than its parts, at most K - match + 1 times its own."""

    shingle: int = 3
    percent: int = 85
    coords: int = 32
    match: int = 16
    small: int = 8
    block: int = 512
    wide: int = 16
    slice_bytes: int = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with well spread output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """P to the powers 0 .. n-1, modulo 2^64."""
    out = np.full(n, P, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words in all texts: a 64-bit hash and the index of the text."""
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    low = LOWER[raw]
    sep = SEPARATOR[low]
    begin = np.flatnonzero(~sep & np.append(True, sep[:-1]))
    end = np.flatnonzero(~sep & np.append(sep[1:], True)) + 1
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.arange(len(low)) - np.repeat(begin, np.diff(np.append(begin, len(low)))) if begin[0] == 0 else np.concatenate([np.zeros(begin[0], dtype=np.int64), np.arange(begin[0], len(low)) - np.repeat(begin, np.diff(np.append(begin, len(low))))])
    p = powers(int((end - begin).max()) + 1)
    value = np.where(sep, np.uint64(0), (low.astype(np.uint64) + np.uint64(1)) * p[np.minimum(at, len(p) - 1)])
    h = mix(np.add.reduceat(value, begin) ^ (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    stop = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(stop, begin, side="right")


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles."""
    h, of = word_hashes(texts)
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    s = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        s = mix(s + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
    out = []
    for a, c in zip(first, n):
        if c >= k:
            out.append(np.unique(s[a : a + c - k + 1]))
        elif c:
            x = np.zeros(1, dtype=np.uint64)
            for i in range(c):
                x = mix(x + h[a + i] + np.uint64(0x51ED270B * (c + 1)))
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """(set, coordinate) least values, 32 bits each; zeros for an empty set."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 62, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 62, coords, dtype=np.uint64)
    out = np.zeros((len(sets), coords), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    start = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
    for c in range(coords):
        v = ((flat * a[c] + b[c]) >> np.uint64(32)).astype(np.uint32)
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x7FEB352D)
        out[full, c] = np.minimum.reduceat(v, start)
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return (int(s.sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(s * P)).astype(np.int64))) if len(s) else (0, 0)


def _slices(texts: list[str | None], size: int) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    n = 0
    for t in texts:
        some.append((t or "").encode("utf-8", "surrogatepass"))
        n += len(some[-1])
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def signed(docs: DataFrame, cfg: Config) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (a fingerprint of the set), sig (coords 32-bit values as bytes)."""

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            at = 0
            ids = p["doc_id"].tolist()
            for some in _slices(p["text"].tolist(), cfg.slice_bytes):
                sets = shingle_sets(some, cfg.shingle)
                sig = signatures(sets, cfg.coords)
                f = [fingerprint(s) for s in sets]
                yield pd.DataFrame({"doc_id": ids[at : at + len(some)], "n": [len(s) for s in sets], "f1": [x for x, _ in f], "f2": [x for _, x in f], "sig": [r.tobytes() for r in sig]})
                at += len(some)

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, n long, f1 long, f2 long, sig binary")


def sets_of(docs: DataFrame, cfg: Config) -> DataFrame:
    """doc_id, f1, the sorted shingle hashes, and the sorted distinct upper halves of them, as bytes."""

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            at = 0
            ids = p["doc_id"].tolist()
            for some in _slices(p["text"].tolist(), cfg.slice_bytes):
                sets = shingle_sets(some, cfg.shingle)
                yield pd.DataFrame({"doc_id": ids[at : at + len(some)], "f1": [fingerprint(s)[0] for s in sets], "set": [s.tobytes() for s in sets], "half": [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]})
                at += len(some)

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, f1 long, set binary, half binary")


def postings(reps: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """key, doc, n, sig of the prefix postings with at least two documents, and c, the number of the posting's documents; and by document p, its keys that meet
    others, the rarest first, and alone, the number of its keys that meet nobody."""

    def spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for lo in range(0, len(p), 2000):
                q = p.iloc[lo : lo + 2000]
                sig = np.frombuffer(b"".join(q["sig"]), dtype=np.uint32).reshape(len(q), cfg.coords)
                key = (np.arange(cfg.coords, dtype=np.int64) << 32)[None] | sig.astype(np.int64)
                yield pd.DataFrame({"doc": np.repeat(q["doc"].to_numpy(), cfg.coords), "key": key.ravel()})

    every = reps.select("doc", "sig").mapInPandas(spread, "doc long, key long")
    # the others meet nobody; tables that were aggregated are cut before a join, so that adaptive execution can split a hot key
    often = cut(every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    # a posting that meets nobody still fills a place of the prefix: it is among the rarest
    mine = every.join(often, "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("p"))
    order = cut(mine.select("doc", F.col("p.key").alias("p"), (cfg.coords - F.size("p")).alias("alone")), "order")
    release(often)
    pre = order.select("doc", F.explode(F.slice("p", 1, F.greatest(F.lit(cfg.coords - cfg.match + 1) - F.col("alone"), F.lit(0)))).alias("key"))
    size = pre.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    return pre.join(size, "key").join(reps.select("doc", "n", "sig"), "doc"), order


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(row of a, row of b): equal coordinates."""
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    for c in range(a.shape[1]):
        out += a[:, c, None] == b[None, :, c]
    return out


def sizes_allow(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def meet_leaders(posts: DataFrame, cfg: Config) -> DataFrame:
    """Distinct pairs (a < b) with enough collisions: all of postings with up to ``small`` documents, and of larger ones those with the leader."""
    small = posts.filter(F.col("c") <= cfg.small)
    large = posts.filter(F.col("c") > cfg.small)
    lead = large.groupBy("key").agg(F.min_by(F.struct("doc", "n", "sig"), F.xxhash64("key", "doc")).alias("l")).select("key", F.col("l.doc").alias("d"), F.col("l.n").alias("m"), F.col("l.sig").alias("s"))
    lead = cut(lead, "leaders")
    star = large.join(lead, "key").filter("doc <> d")
    other = small.select("key", F.col("doc").alias("d"), F.col("n").alias("m"), F.col("sig").alias("s"))
    both = small.join(other, "key").filter("doc < d")
    cols = [F.least("doc", "d").alias("a"), F.greatest("doc", "d").alias("b"), "n", "m", "sig", "s"]
    pairs = star.select(*cols).unionByName(both.select(*cols)).filter(100 * F.least("n", "m") >= cfg.percent * F.greatest("n", "m"))
    pairs = pairs.dropDuplicates(["a", "b"])

    @F.pandas_udf("int")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        u, v = (np.frombuffer(b"".join(c), dtype=np.uint32).reshape(len(c), cfg.coords) for c in (x, y))
        return pd.Series((u == v).sum(1).astype("int32"))

    return pairs.filter(equal("sig", "s") >= cfg.match).select("a", "b")


def divided(large: DataFrame, order: DataFrame, cfg: Config) -> list[tuple[DataFrame, bool]]:
    """Rows key, doc, comp, top, all, most of postings that hold several components, and whether they are still the first ones. large: key, doc, comp. Those with
    more than ``wide`` blocks of documents outside their largest component are divided by one more coordinate, until there are none or the coordinates suffice."""
    out = []
    most = cfg.wide * cfg.block
    level = 1
    rows = large
    while True:
        parts = rows.groupBy("key", "comp").agg(F.count("*").alias("k"))
        top = cut(parts.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.max("k").alias("most"), F.count("*").alias("comps"), F.sum("k").alias("all")).filter("comps > 1"), "largest")
        wide = top.filter(F.col("all") - F.col("most") > most)
        last = level >= cfg.match or wide.isEmpty()
        out.append((rows.join(top if last else top.filter(F.col("all") - F.col("most") <= most), "key"), level == 1))
        if last:
            return out
        level += 1
        some = rows.join(wide.select("key"), "key", "left_semi").join(order, "doc")
        if level == 2:
            some = some.withColumn("at", F.array_position("p", F.col("key")).cast("int"))
        # a pair meets at its first shared coordinates, of which all but the last ones are behind in the order
        here = F.greatest(F.lit(cfg.coords - cfg.match + level) - F.col("alone") - F.col("at"), F.lit(0))
        some = some.select("key", "doc", "comp", "at", F.posexplode(F.slice("p", F.col("at") + 1, here)).alias("i", "b"))
        rows = cut(some.select(F.xxhash64("key", "b").alias("key"), "doc", "comp", (F.col("at") + F.col("i") + 1).alias("at")), "divided")


def meet_rest(posts: DataFrame, order: DataFrame, comp: DataFrame, sets: DataFrame, cfg: Config) -> DataFrame:
    """Distinct pairs (a < b) in large postings whose components differ, with enough collisions and sets that are similar by 32 bits of each hash, which
    never lose a similar pair. comp: doc, comp. A pair is looked at in the least undivided posting that it shares, and in divided ones."""
    large = posts.filter(F.col("c") > cfg.small).select("key", "doc").join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    every = [(cut(rows.select("key", "doc", "comp", "top", "all", "most"), "rest"), first) for rows, first in divided(large, order, cfg)]
    keys = cut(every[0][0].groupBy("doc").agg(F.array_sort(F.collect_list("key")).alias("keys")), "keys")  # at most a prefix each
    rows = every[0][0].join(keys, "doc")
    for more, _ in every[1:]:
        rows = rows.unionByName(more.withColumn("keys", F.array("key")))
    sig = posts.filter(F.col("c") > cfg.small).select("doc", "n", "sig").dropDuplicates(["doc"])
    rows = rows.join(sig, "doc").join(sets.select(F.col("doc_id").alias("doc"), "half"), "doc")
    rows = rows.withColumn("blocks", F.ceil(F.col("all") / cfg.block).cast("int")).withColumn("rounds", F.ceil((F.col("all") - F.col("most")) / cfg.block).cast("int"))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    turn = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("rounds")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a document waits in its own block in every round; outside the largest component it also visits every block in its own round
    there = F.transform(upto("rounds"), lambda r: F.struct(own.alias("block"), r.alias("round")))
    visits = F.when(F.col("comp") == F.col("top"), F.array().cast("array<struct<block:int,round:int>>")).otherwise(F.transform(upto("blocks"), lambda b: F.struct(b.alias("block"), turn.alias("round"))))
    spread = rows.select("key", F.explode(F.array_distinct(F.concat(there, visits))).alias("at"), "doc", "n", "sig", "comp", "top", "keys", "half", own.alias("own"), turn.alias("turn"))
    spread = spread.select("key", "at.block", "at.round", "doc", "n", "sig", "comp", "top", "keys", "half", "own", "turn")

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        key = int(p["key"].iloc[0])
        sig = np.frombuffer(b"".join(p["sig"]), dtype=np.uint32).reshape(len(p), cfg.coords)
        doc, n, comp, half, keys = (p[c].to_numpy() for c in ("doc", "n", "comp", "half", "keys"))
        half = [np.frombuffer(x, dtype=np.uint32) for x in half]
        mine = np.flatnonzero(p["own"].to_numpy() == p["block"].to_numpy())
        out = np.flatnonzero((comp != p["top"].to_numpy()) & (p["turn"].to_numpy() == p["round"].to_numpy()))
        found: set[tuple[int, int]] = set()
        for lo in range(0, len(out), 64):
            o = out[lo : lo + 64]
            ok = (comp[o][:, None] != comp[mine][None]) & sizes_allow(n[o][:, None], n[mine][None], cfg.percent)
            if not ok.any():
                continue
            ok &= collisions(sig[o], sig[mine]) >= cfg.match
            for x, row in zip(o, ok):
                m = mine[row]
                m = m[[_least_common(keys[x], keys[y]) == key for y in m]] if len(m) else m
                if not len(m):
                    continue
                size = np.array([len(half[y]) for y in m])
                flat = np.concatenate([half[y] for y in m])
                at = np.minimum(np.searchsorted(half[x], flat), len(half[x]) - 1)
                both = np.add.reduceat((half[x][at] == flat).astype(np.int64), np.cumsum(size) - size)
                # equal halves of different hashes make sets smaller by as many: count what is missing as shared
                both = both + (n[x] - len(half[x])) + (n[m] - size)
                for y in m[100 * both >= cfg.percent * (n[x] + n[m] - both)]:
                    found.add((min(doc[x], doc[y]), max(doc[x], doc[y])))
        a, b = (np.array([f[i] for f in found], dtype=np.int64) for i in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    return spread.groupBy("key", "block", "round").applyInPandas(meet, "a long, b long").distinct()


def _least_common(a: np.ndarray, b: np.ndarray) -> int:
    """The least element of two sorted arrays that share one."""
    i = j = 0
    while a[i] != b[j]:
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
    return int(a[i])


def confirm(pairs: DataFrame, sets: DataFrame, cfg: Config) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=bool)
        for i, (u, v) in enumerate(zip(x, y)):
            u, v = np.frombuffer(u, dtype=np.uint64), np.frombuffer(v, dtype=np.uint64)
            both = len(u) + len(v) - len(np.union1d(u, v))
            out[i] = 100 * both >= cfg.percent * (len(u) + len(v) - both)
        return pd.Series(out)

    x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(x, "a").join(y, "b").filter(similar("sa", "sb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """doc and comp, the least document that links (a, b) connect it with; large star and small star by turns, each cut, until nothing moves."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hub = cut(least, "hubs")
        large = both.join(hub, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # each neighbour, and the document itself, goes to the least neighbour
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "edges")
        release(edges, hub)
        edges = new
        s = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.countDistinct("u").alias("d")).first()
        if (s["n"], s["h"]) == last:
            break
        last = (s["n"], s["h"])
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))


def classes(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = cut(signed(docs, cfg), "signatures")
    ids = sig.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n", "sig")).alias("s")).select("doc_id", "s.*")
    reps = cut(ids.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.count("*").alias("k")), "classes")
    posts, order = postings(reps, cfg)
    posts = cut(posts, "postings")
    near = cut(meet_leaders(posts, cfg), "pairs")
    wanted = reps.join(near.select(F.col("a").alias("doc")).union(near.select("b")).union(posts.filter(F.col("c") > cfg.small).select("doc")).distinct(), "doc", "left_semi").select(F.col("doc").alias("doc_id"), "f1")
    sets = cut(sets_of(docs.join(wanted, "doc_id", "left_semi"), cfg).join(wanted, ["doc_id", "f1"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "set", "half"), "sets")
    links = cut(confirm(near, sets, cfg), "links")
    comp = components(links)
    rest = cut(meet_rest(posts, order, comp, sets, cfg), "pairs")
    if rest.limit(1).count():
        comp = components(links.unionByName(confirm(rest, sets, cfg)))
    release(near, rest, posts, order, sets)
    of = reps.join(comp, "doc", "left").select("f1", "f2", "n", F.coalesce("comp", "doc").alias("comp"), "k")
    many = cut(of.filter("k > 1").select("f1", "f2", "n", "comp"), "copies")
    one = reps.filter("k = 1").select("doc").join(comp, "doc")
    return _label(ids, many, one)


def _label(ids: DataFrame, many: DataFrame, one: DataFrame) -> DataFrame:
    """many: component of sets that several documents have; one: component of single documents that are linked."""
    got = ids.select("doc_id", "f1", "f2", "n").join(many, ["f1", "f2", "n"], "left").join(one.select(F.col("doc").alias("doc_id"), F.col("comp").alias("c")), "doc_id", "left")
    comp: Column = F.coalesce("comp", "c", "doc_id")
    return got.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (comp == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The rows of ``docs`` that are their component's least by id, then text hash; all columns stay. Different texts of one id are documents of their own; of rows
    equal in id and text one stays, the least by a hash of its other columns. Rows with a null id stay."""
    rows = docs.withColumn("_kept_t", F.xxhash64("text"))
    many = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    twice = cut(rows.select("doc_id", "_kept_t").join(many, "doc_id", "left_semi").distinct(), "repeated")
    if twice.isEmpty():
        gone = classes(docs, cfg).filter(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # each text of a repeated id gets a free id, beyond all others
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    named = cut(twice.select("doc_id", "_kept_t", (F.monotonically_increasing_id() + F.lit(top) + 1).alias("_kept_n")), "named")
    if named.filter(F.col("_kept_n") <= top).limit(1).count():
        raise ValueError("no ids are free beyond the largest")
    rows = rows.join(broadcast_checked(named, F.lit(24)), ["doc_id", "_kept_t"], "left").withColumn("_kept_d", F.coalesce("_kept_n", F.col("doc_id").cast("long")))
    of = classes(rows.select(F.col("_kept_d").alias("doc_id"), "text"), cfg).filter("doc_id is not null").select(F.col("doc_id").alias("_kept_n"), "component_id")
    of = cut(of.join(named, "_kept_n", "left").select("component_id", F.struct(F.coalesce("doc_id", "_kept_n").alias("i"), "_kept_t", F.col("_kept_n").alias("d")).alias("s")), "classes")
    first = of.groupBy("component_id").agg(F.min("s").alias("f"), F.count("*").alias("k")).filter("k > 1")
    gone = of.join(first, "component_id").filter(F.col("s.d") != F.col("f.d")).select(F.col("s.d").alias("_kept_d"))
    left = rows.join(gone, "_kept_d", "left_anti")
    more = left.filter("_kept_n is not null").withColumn("_kept_h", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_kept_z")))))
    least = more.groupBy("_kept_n").agg(F.min("_kept_h").alias("_kept_h"))
    one = more.join(least, ["_kept_n", "_kept_h"], "left_semi").dropDuplicates(["_kept_n"])
    return left.filter("_kept_n is null").select(docs.columns).unionByName(one.select(docs.columns))
