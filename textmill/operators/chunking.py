"""Chunkers: a text becomes an array of structs, or with ``explode_chunks`` one row for each."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where rule-based sections begin, and the words that name a section's kind.
SECTION_STARTS = [r"\n(?=[A-Z][^.]*:)", r"\n(?=[0-9]+\.)", r"\n(?=[-*])", r"\n(?=[A-Z]{2,})", r"\n\n+"]
KINDS = {
    "reasoning": ["therefore", "thus", "because", "since"],
    "example": ["for example", "such as", "instance"],
    "definition": ["define", "definition", "means", "refers to"],
    "procedural": ["step", "first", "then", "next", "finally"],
    "evidence": ["according to", "study", "research", "data"],
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def fixed(w: Column, size: int, min_chars: int = 100) -> Column:
    """Of a column of words runs of ``size``; shorter texts than ``min_chars`` characters go."""
    return _windows(w, size, size, min_chars, every=True)


def sliding(w: Column, size: int, overlap: int, min_chars: int = 100) -> Column:
    """Of a column of words runs of ``size`` that share ``overlap`` with the one before; the last is the first that reaches the end."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    return _windows(w, size, size - overlap, min_chars, every=False)


def _windows(w: Column, size: int, step: int, min_chars: int, every: bool) -> Column:
    # w is a column, not an expression: inside a lambda an expression would be computed for each window
    n = F.size(w)
    last = (n - 1) if every else F.greatest(F.ceil((n - size) / step), F.lit(0)) * step
    starts = F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        end = F.least(i + size, n)
        over = F.lit(size - step)
        return F.struct(
            F.array_join(F.slice(w, i + 1, F.lit(size)), " ").alias("text"), i.alias("start_index"), end.alias("end_index"), (end - i).alias("word_count"),
            F.when(i == 0, 0).otherwise(over).alias("overlap_prev"), F.when(end >= n, 0).otherwise(over).alias("overlap_next"),
        )

    return F.filter(F.transform(starts, one), lambda c: F.length(c["text"]) >= min_chars)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def _pack(parts: Column, size: int, sep: str, min_chars: int) -> Column:
    """Greedy: parts are joined while their words stay within ``size``; only the last chunk can be too short to keep. The fold goes over word counts and carries
    only where chunks begin."""

    def begins(counts: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("o"), F.lit(0).alias("n"), F.lit(0).alias("i"))

        def step(a: Column, k: Column) -> Column:
            full = (a["n"] + k > size) & (a["i"] > F.element_at(a["o"], -1))
            return F.struct(F.when(full, F.concat(a["o"], F.array(a["i"]))).otherwise(a["o"]).alias("o"), F.when(full, k).otherwise(a["n"] + k).alias("n"), (a["i"] + 1).alias("i"))

        return F.aggregate(counts, start, step, lambda a: a["o"])

    def chunks(p: Column, counts: Column, b: Column) -> Column:
        def one(at: Column, i: Column) -> Column:
            end = F.coalesce(F.get(b, i + 1), F.size(p))
            words_in = F.aggregate(F.slice(counts, at + 1, end - at), F.lit(0), lambda s, x: s + x)
            return F.struct(F.array_join(F.slice(p, at + 1, end - at), sep).alias("text"), (end - at).alias("parts"), words_in.alias("word_count"), (end < F.size(p)).alias("more"))

        made = F.filter(F.transform(b, one), lambda c: c["more"] | (F.length(c["text"]) >= min_chars))
        return F.transform(made, lambda c: F.struct(c["text"].alias("text"), c["parts"].alias("parts"), c["word_count"].alias("word_count")))

    return let(parts, lambda p: let(F.transform(p, lambda x: F.size(words(x))), lambda k: let(begins(k), lambda b: chunks(p, k, b))))


def sentences(text: Column, size: int, min_chars: int = 100) -> Column:
    """Parts between sentence ends, packed."""
    return _pack(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), size, " ", min_chars)


def paragraphs(text: Column, size: int, min_chars: int = 100) -> Column:
    """Parts between blank lines, packed."""
    return _pack(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), size, "\n\n", min_chars)


def sections(text: Column, size: int, min_chars: int = 100) -> Column:
    """Parts that begin at a line with a capital, #, * or -; those of more than ``size`` words by sentences."""
    part = lambda x: F.struct(x.alias("text"), F.lit(1).alias("parts"), F.size(words(x)).alias("word_count"))
    none = F.array().cast("array<struct<text:string,parts:int,word_count:int>>")
    one = lambda x: F.when(F.size(words(x)) > size, sentences(x, size, min_chars)).when(F.length(x) >= min_chars, F.array(part(x))).otherwise(none)
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n(?=[A-Z#*-])"), one))


def kind_of(text: Column) -> Column:
    out = F.lit("general")
    for kind, found in reversed(KINDS.items()):
        any_of = F.lit(False)
        for w in found:
            any_of = any_of | F.contains(F.lower(text), F.lit(w))
        out = F.when(any_of, F.lit(kind)).otherwise(out)
    return out


def rule_sections(text: Column, min_words: int = 25) -> Column:
    """Sections split by each kind of start in turn; the whole text where none has ``min_words`` words."""
    parts = F.array(F.coalesce(text, F.lit("")))
    at = lambda p: lambda x: F.split(x, p)  # noqa: E731  a second argument would get the index
    for p in SECTION_STARTS:
        parts = F.flatten(F.transform(parts, at(p)))
    parts = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    made = F.transform(F.filter(parts, lambda x: F.size(words(x)) >= min_words), lambda x: F.struct(x.alias("text"), F.size(words(x)).alias("word_count"), F.lit("rule_based_semantic").alias("type"), kind_of(x).alias("semantic_type"), F.lit(0.5).alias("coherence_score")))
    whole = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.size(words(text)).alias("word_count"), F.lit("fallback").alias("type"), kind_of(text).alias("semantic_type"), F.lit(0.5).alias("coherence_score"))
    return F.when(F.size(made) > 0, made).otherwise(F.array(whole))


def chunk(df: DataFrame, strategy: str = "sliding_window", size: int = 512, overlap: int = 50, min_chars: int = 100) -> DataFrame:
    """``df`` with the array column chunks; an unknown strategy is the sliding window, with a warning."""
    t = F.col("text")
    if strategy not in ("semantic", "sentence", "paragraph", "sections", "fixed", "sliding_window"):
        warnings.warn(f"unknown chunking strategy {strategy}: sliding_window is used", stacklevel=2)
    if strategy == "semantic":
        return df.withColumn("chunks", rule_sections(t))
    by_parts = {"sentence": sentences, "paragraph": paragraphs, "sections": sections}
    if strategy in by_parts:
        return df.withColumn("chunks", by_parts[strategy](t, size, min_chars))
    w = F.col("_words")
    made = fixed(w, size, min_chars) if strategy == "fixed" else sliding(w, size, overlap, min_chars)
    return df.withColumn("_words", words(t)).withColumn("chunks", made).drop("_words")


def explode_chunks(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each chunk: key, chunk_ix and the chunk's fields."""
    # the outer form: of the inner one a filter is inferred, which would compute the chunks again, below
    return df.select(key, F.posexplode_outer("chunks").alias("chunk_ix", "c")).filter("chunk_ix is not null").select(key, "chunk_ix", "c.*")


def udtf_chunks(size: int = 512, overlap: int = 50, min_chars: int = 100) -> type:
    """A table function of a text, for SQL: ``spark.udtf.register("chunks", udtf_chunks())``, then ``SELECT * FROM t, LATERAL chunks(t.text)``; rows are those of
    ``sliding``."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")

    @F.udtf(returnType="text string, start_index int, end_index int, word_count int")
    class Chunks:
        def eval(self, text: str):  # noqa: ANN201
            w = (text or "").split()
            for i in range(0, max(len(w) - overlap, 1), size - overlap):
                t = " ".join(w[i : i + size])
                if w and len(t) >= min_chars:
                    yield t, i, min(i + size, len(w)), min(size, len(w) - i)

    return Chunks
