"""Semantic chunks with a sentence embedder: boundaries at dips of similarity, reasoning chains that are kept whole, arguments, and measures of each chunk.

A document's sentences are embedded and chunked where the document lies, in Arrow batches; nothing is shuffled. Without an embedder ``chunking.rule_sections``
is the strategy. ``embed`` gives a vector for each of a list of sentences; it is called once a document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.batches import map_slices
from textmill.functions.dialect import Spark
from textmill.operators.chunking import KINDS

# Cues of reasoning, by kind, the first kind that is met counts; and cues of the parts of an argument.
REASONING = {
    "causal": ["because", "since", "as a result", "therefore", "consequently", "thus", "hence"],
    "contrast": ["however", "but", "although", "nevertheless", "on the other hand", "conversely"],
    "addition": ["furthermore", "moreover", "additionally", "in addition", "also"],
    "explanation": ["that is", "in other words", "for example", "for instance", "specifically"],
    "conclusion": ["in conclusion", "to summarize", "overall", "in summary", "finally"],
}
ARGUMENT = {
    "claim": ["i argue that", "i claim", "my position is", "it is evident that", "clearly"],
    "evidence": ["according to", "studies show", "research indicates", "data suggests", "evidence shows"],
    "conclusion": ["therefore", "thus", "in conclusion", "this proves", "hence"],
}
LOGIC = r"\b(however|although|because|therefore|consequently)\b"

any_of = lambda cues: re.compile(r"\b(?:" + "|".join(cues) + r")\b")
_REASONING = {k: any_of(v) for k, v in REASONING.items()}
_ARGUMENT = {k: any_of(v) for k, v in ARGUMENT.items()}
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
SCHEMA = (
    "text string, sentence_count int, word_count int, start_sentence int, end_sentence int, chains array<struct<type:string,coherence:double,sentence_count:int>>, "
    "arguments array<struct<has_claim:boolean,has_evidence:boolean,has_conclusion:boolean,completeness:double>>, semantic_type string, complexity double, coherence double"
)


@dataclass(frozen=True)
class Config:
    """least, target and most: words a chunk; threshold: of the cosine that goes on with a chain, and of the coherence of chains that are kept whole."""

    least: int = 100
    target: int = 512
    most: int = 1024
    threshold: float = 0.7


def sentences_of(text: str | None) -> list[str]:
    return [s for x in SENTENCE_GAP.split(text or "") if (s := x.strip())]


def sentences(text: Column) -> Column:
    """The same as a column."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?U)\s+(?=[A-Z])"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def cue(sentence: str, cues: dict[str, re.Pattern]) -> str | None:
    low = sentence.lower()
    return next((k for k, p in cues.items() if p.search(low)), None)


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def chain_coherence(at: list[int], v: np.ndarray) -> float:
    """Mean cosine of neighbours in a chain; 1 for a chain of one."""
    return float((v[at[:-1]] * v[at[1:]]).sum(1).mean()) if len(at) > 1 else 1.0


def chains(s: list[str], v: np.ndarray, threshold: float = 0.7) -> list[tuple[str, list[int], float]]:
    """(type, sentences, coherence) of each run of reasoning: a cue opens one with the sentence before it, the same cue or a similar sentence goes on with it,
    another cue or an unlike sentence closes it. Chains of one sentence are none."""
    out: list[tuple[str, list[int], float]] = []
    kind: str | None = None
    at: list[int] = []

    def close() -> None:
        if len(at) > 1:
            out.append((kind or "", list(at), chain_coherence(at, v)))

    for i, x in enumerate(s):
        found = cue(x, _REASONING)
        if found and at and found == kind:
            at.append(i)
        elif found:
            close()
            kind, at = found, [max(i - 1, 0), i]
        elif at and i and float(v[at[-1]] @ v[i]) > threshold:
            at.append(i)
        elif at and i:
            close()
            kind, at = None, []
    close()
    return out


def arguments(s: list[str]) -> list[dict[str, list[int]]]:
    """Sentences of claim, evidence and conclusion of each argument; a claim after a claim or evidence begins the next. Those without claim or evidence are none."""
    new = lambda: {"claim": [], "evidence": [], "conclusion": []}
    out, now = [], new()
    for i, x in enumerate(s):
        part = cue(x, _ARGUMENT)
        if part == "claim" and (now["claim"] or now["evidence"]):
            out.append(now)
            now = new()
        if part:
            now[part].append(i)
    return [a for a in [*out, now] if a["claim"] and a["evidence"]]


def boundaries(s: list[str], v: np.ndarray, cfg: Config = Config()) -> list[int]:
    """Ends of chunks (exclusive): where the cosine to the next sentence is a strict local minimum or under the mean less the deviation, and the chunk's words are
    within bounds. A last part of more than ``most`` words is cut once, at ``target`` words."""
    if len(s) <= 2:
        return [len(s)]
    c = (v[:-1] * v[1:]).sum(1)
    low = c.mean() - c.std()
    dip = np.zeros(len(c), dtype=bool)
    dip[1:-1] = (c[1:-1] < c[:-2]) & (c[1:-1] < c[2:])
    n = [len(x.split()) for x in s]
    out: list[int] = []
    size = 0
    for i in range(len(c)):
        size += n[i]
        if (dip[i] or c[i] < low) and cfg.least <= size <= cfg.most:
            out.append(i + 1)
            size = 0
    if size > cfg.most:
        begin = out[-1] if out else 0
        total = np.cumsum(n[begin:])
        out.append(begin + int(np.searchsorted(total, cfg.target)) + 1)
    return sorted({min(b, len(s)) for b in [*out, len(s)]})


def keep_chains(ends: list[int], found: list[tuple[str, list[int], float]], threshold: float = 0.7) -> list[int]:
    """Boundaries inside a coherent chain go before or behind it, whichever is nearer; behind where both are as near, or where there is one already they stay."""
    out = set(ends)
    for _, at, coherence in found:
        if coherence <= threshold:
            continue
        first, last = min(at), max(at)
        for b in ends:
            if first < b <= last:
                to = first if b - first < last - b else last + 1
                if to > 0 and to not in out and b in out:
                    out.discard(b)
                    out.add(to)
    return sorted(out)


def complexity_of(text: str) -> float:
    """What ``complexity`` gives, for one text."""
    w = text.split()
    if not w:
        return 0.0
    ttr = len({x.lower() for x in w}) / len(w)
    return 0.4 * min(len(w) / len(re.split(r"[.!?]+", text)) / 20, 1) + 0.4 * ttr + 0.2 * min(len(re.findall(LOGIC, text.lower())) / 10, 1)


def complexity(d: Spark) -> str:
    """Words a part between sentence ends, share of different words, and connectives, of a prepared text."""
    w = d.size("_w")
    ttr = f"{d.size(d.distinct(d.map('_w', 'lower(x)')))} / ({w} * 1.0)"
    return f"CASE WHEN {w} = 0 THEN 0.0 ELSE 0.4 * least({w} / ({d.size('_p')} * 1.0) / 20, 1.0) + 0.4 * {ttr} + 0.2 * least({d.cnt('_l', LOGIC)} / 10.0, 1.0) END"


def kind_of(text: str) -> str:
    low = text.lower()
    return next((k for k, ws in KINDS.items() if any(w in low for w in ws)), "general")


def chunk_text(text: str | None, embed: Callable[[list[str]], np.ndarray], cfg: Config = Config()) -> list[dict]:
    """The chunks of one text."""
    s = sentences_of(text)
    if not s:
        return []
    v = unit(embed(s))
    found, argued = chains(s, v, cfg.threshold), arguments(s)
    out, begin = [], 0
    for end in keep_chains(boundaries(s, v, cfg), found, cfg.threshold):
        own = set(range(begin, end))
        if not own:
            continue
        body = " ".join(s[begin:end])
        inside = [(k, c, len(own.intersection(at))) for k, at, c in found if own.intersection(at)]
        parts = [(a, {i for x in a.values() for i in x}) for a in argued]
        out.append({
            "text": body, "sentence_count": end - begin, "word_count": len(body.split()), "start_sentence": begin, "end_sentence": end - 1,
            "chains": [{"type": k, "coherence": c, "sentence_count": n} for k, c, n in inside],
            "arguments": [{**{f"has_{k}": bool(own.intersection(a[k])) for k in ARGUMENT}, "completeness": len(own & every) / len(every)} for a, every in parts if own & every],
            "semantic_type": kind_of(body), "complexity": complexity_of(body), "coherence": chain_coherence(list(range(begin, end)), v) if end - begin > 1 else 0.5,
        })
        begin = end
    return out


def semantic_chunks(df: DataFrame, embed: Callable[[list[str]], np.ndarray], cfg: Config = Config(), key: str = "doc_id") -> DataFrame:
    """``key``, chunk_ix and the fields of ``SCHEMA``, a row for each chunk of ``df`` (key, text). A text without sentences has none; one sentence is one chunk."""

    cols = ["key", "chunk_ix", *re.findall(r"(?:^|, )(\w+) ", re.sub(r"<[^ ]*>", "", SCHEMA))]

    def of(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = [(k, i, *c.values()) for k, t in zip(p["key"], p["text"]) for i, c in enumerate(chunk_text(t, embed, cfg))]
        yield pd.DataFrame(rows, columns=cols)

    kind = df.schema[key].dataType.simpleString()
    return map_slices(df.select(F.col(key).alias("key"), "text"), of, f"key {kind}, chunk_ix int, {SCHEMA}").withColumnRenamed("key", key)


def document_coherence(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, chunks and semantic_coherence: the mean of a document's chunks."""
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("semantic_coherence"))


def hashed_words(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An embedder that needs no model: counts of words hashed to ``dims`` places."""
    import zlib

    def embed(s: list[str]) -> np.ndarray:
        out = np.zeros((len(s), dims))
        for i, x in enumerate(s):
            for w in x.lower().split():
                out[i, zlib.crc32(w.encode()) % dims] += 1
        return out

    return embed
