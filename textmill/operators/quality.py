"""Basic quality: five component scores, the repetition ratio, filters by score and language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.batches import ROWS, slices
from textmill.functions.dialect import SPARK, Spark
from textmill.operators import semantic_quality
from textmill.operators.semantic_quality import avg_word_length

SPECIAL = re.compile(r"[^a-zA-Z0-9\s]", re.ASCII)
MIN_WORDS, MAX_WORDS, MIN_LENGTH, MAX_REPETITION = 10, 10_000, 3, 0.3


def repetition(text: str | None) -> float:
    """The share of word trigrams that occur again later, as a part of the text that follows them: there the first word may be the end of a word and the last the
    beginning of one. Later trigrams are looked up by their middle word and the letters on either side of the spaces."""
    w = (text or "").lower().split()
    if len(w) < 10:
        return 0.0
    exact: set[tuple[str, str, str]] = set()
    later: dict[tuple[str, str, str], list[tuple[str, str]]] = {}
    n, j = 0, len(w) - 3
    for i in range(len(w) - 7, -1, -1):
        while j >= i + 3:
            t = (w[j], w[j + 1], w[j + 2])
            if t not in exact:
                exact.add(t)
                later.setdefault((t[0][-1], t[1], t[2][0]), []).append((t[0], t[2]))
            j -= 1
        a, b, c = w[i], w[i + 1], w[i + 2]
        n += (a, b, c) in exact or any(x.endswith(a) and y.startswith(c) for x, y in later.get((a[-1], b, c[0]), ()))
    return n / max(len(w) - 3, 1)


def basic(d: Spark, rep: str = "_rep") -> str:
    """Mean of the components of a prepared text; without words there are four."""
    w = d.size("_w")
    special = 'regexp_count(_t, "[^a-zA-Z0-9\\\\s]")' if d is SPARK else "len(regexp_extract_all(_t, '[^a-zA-Z0-9\\s]'))"
    upper = 'regexp_count(_t, "\\\\p{Lu}")' if d is SPARK else "len(regexp_extract_all(_t, '\\p{Lu}'))"
    count = f"CASE WHEN {w} < {MIN_WORDS} THEN 0.0 WHEN {w} > {MAX_WORDS} THEN 0.5 ELSE 1.0 END"
    length = f"CASE WHEN {w} = 0 THEN 0.0 WHEN {avg_word_length(d)} >= {MIN_LENGTH} THEN 1.0 ELSE {avg_word_length(d)} / {MIN_LENGTH} END"
    rep = f"CASE WHEN {rep} <= {MAX_REPETITION} THEN 1.0 ELSE 1.0 - {rep} END"
    odd = f"1.0 - least(2.0 * {special} / length(_t), 1.0)"
    caps = f"CASE WHEN {upper} / (length(_t) * 1.0) > 0.5 THEN 0.5 ELSE 1.0 END"
    return f"CASE WHEN _t = '' THEN 0.0 ELSE (({count}) + ({length}) + ({rep}) + ({odd}) + ({caps})) / CASE WHEN {w} = 0 THEN 4.0 ELSE 5.0 END END"


def basic_score(text: str | None) -> tuple[float, float]:
    """Repetition ratio and score: the mean of the components of a text; without words there are four, and the empty text scores 0."""
    t = text or ""
    if not t:
        return 0.0, 0.0
    w = t.split()
    parts = [0.0 if len(w) < MIN_WORDS else 0.5 if len(w) > MAX_WORDS else 1.0]
    if w:
        parts.append(min(sum(map(len, w)) / len(w) / MIN_LENGTH, 1.0))
    r = repetition(t)
    parts.append(1.0 if r <= MAX_REPETITION else 1.0 - r)
    parts.append(1.0 - min(2.0 * len(SPECIAL.findall(t)) / len(t), 1.0))
    parts.append(0.5 if sum(map(str.isupper, t)) / len(t) > 0.5 else 1.0)
    return r, sum(parts) / len(parts) if w else sum(parts) / 4.0


def basic_quality(text: Column) -> Column:
    """A struct of repetition_ratio and quality_score, in one Arrow function: the search for a substring has no column form that is as quick. It stays where it is
    in the plan: a filter by the score would else be moved before what makes the text and spreads the rows, and the score be computed on either side."""

    @F.arrow_udf("repetition_ratio double, quality_score double")
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in it:
            for at in slices(len(s)):
                got = [basic_score(t) for t in s.slice(at, ROWS).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([x[i] for x in got], pa.float64()) for i in (0, 1)], ["repetition_ratio", "quality_score"])

    return of.asNondeterministic()(text)


def score(df: DataFrame) -> DataFrame:
    """``df`` with repetition_ratio and quality_score."""
    out = df.withColumn("_q", basic_quality(F.col("text")))
    return out.select(*df.columns, "_q.repetition_ratio", "_q.quality_score")


#: Frequent short words of languages, by which the detector tells them. Fixed values.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "are", "this", "on", "as", "be", "by", "at"],
    "de": ["der", "die", "und", "das", "ist", "von", "den", "mit", "nicht", "ein", "eine", "zu", "im", "auf", "des", "für", "sich"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "un", "dans", "que", "pour", "qui", "sur", "pas", "du", "au", "avec", "ce"],
    "es": ["el", "los", "las", "del", "que", "una", "por", "con", "para", "es", "se", "lo", "como", "más", "su", "al", "y", "en"],
    "it": ["il", "di", "che", "è", "gli", "della", "per", "non", "una", "sono", "con", "nel", "anche", "come", "del", "più"],
    "pt": ["o", "os", "da", "do", "em", "um", "uma", "para", "com", "não", "por", "mais", "dos", "como", "mas", "ao", "das"],
}


def detect_language(text: Column, chars: int | None = None) -> Column:
    """The language whose stop words are the most among the text's words (ties to the first of ``STOP_WORDS``); unknown without any. chars: look at so many
    characters only; None: at the whole text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    w = F.split(F.substring(t, 1, chars) if chars else t, r"(?U)[^\p{L}]+")
    among = lambda k: lambda x: x.isin(STOP_WORDS[k])
    n = {k: F.size(F.filter(w, among(k))) for k in STOP_WORDS}
    top = F.greatest(*n.values())
    out = F.when(top == 0, "unknown")
    for k, c in n.items():
        out = out.when(c == top, k)
    return out


def filter_chunks(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Of the array column chunks those whose text scores at least ``threshold``."""

    @F.arrow_udf("array<double>")
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in it:
            for at in slices(len(s)):
                yield pa.array([None if xs is None else [basic_score(x)[1] for x in xs] for xs in s.slice(at, ROWS).to_pylist()], pa.list_(pa.float64()))

    scored = df.withColumn("_q", of(F.transform("chunks", lambda c: c["text"])))
    return scored.withColumn("chunks", F.filter("chunks", lambda c, i: F.get("_q", i) >= threshold)).drop("_q")


def quality_filter(df: DataFrame, threshold: float = 0.7, languages: list[str] | None = None, language: str = "lang", scorer: str = "basic") -> DataFrame:
    """Rows in an allowed language (all if None; detected where there is no such column) that score at least ``threshold``; the cheap test first. scorer: basic, or
    semantic for the overall semantic quality. Chunks, where there are any, are filtered by their own scores."""
    if languages is not None:
        df = df.filter((F.col(language) if language in df.columns else detect_language(F.col("text"))).isin(languages))
    if scorer == "semantic":
        out = semantic_quality.score(df).select(*df.columns, F.col("overall").alias("quality_score"))
    elif scorer == "basic":
        out = df.withColumn("quality_score", basic_quality(F.col("text"))["quality_score"])
    else:
        raise ValueError(f"unknown scorer {scorer}")
    out = out.filter(F.col("quality_score") >= threshold)
    return filter_chunks(out, threshold) if "chunks" in df.columns else out
