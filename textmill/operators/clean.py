"""Cleaning and redaction of personal data."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.batches import ROWS, slices

# The patterns below define cleaning and redaction.
HTML, URL, EMAIL_TOKEN = r"<[^>]+>", r"https?://\S+|www\.\S+", r"\S+@\S+"
PII = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}


@dataclass(frozen=True)
class CleanConfig:
    lowercase: bool = False
    remove_html: bool = True
    remove_urls: bool = True
    remove_emails: bool = True
    fix_unicode: bool = True
    remove_special_chars: bool = False
    remove_extra_whitespace: bool = True
    preserve_newlines: bool = False


def _nfkc(x: str | None) -> str | None:
    return x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for."""

    @F.arrow_udf("string")
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in it:
            for at in slices(len(s)):
                part = s.slice(at, ROWS)
                yield part if pc.all(pc.string_is_ascii(part)).as_py() else pa.array([_nfkc(x) for x in part.to_pylist()], pa.string())

    return of(text)


def nfkc_all(texts: Column) -> Column:
    """The same of an array of texts."""

    @F.arrow_udf("array<string>")
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in it:
            for at in slices(len(s)):
                yield pa.array([None if xs is None else [_nfkc(x) for x in xs] for xs in s.slice(at, ROWS).to_pylist()], pa.list_(pa.string()))

    return of(texts)


def clean(text: Column, cfg: CleanConfig = CleanConfig()) -> Column:
    """A null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    if cfg.fix_unicode:
        t = nfkc(t)
    if cfg.remove_html:
        t = F.regexp_replace(t, HTML, " ")
    if cfg.remove_urls:
        t = F.regexp_replace(t, "(?U)" + URL, "")
    if cfg.remove_emails:
        t = F.regexp_replace(t, "(?U)" + EMAIL_TOKEN, "")
    if cfg.remove_special_chars:
        t = F.regexp_replace(t, r"(?U)[^\w\s]", " ")
    if cfg.remove_extra_whitespace:
        if cfg.preserve_newlines:
            t = F.regexp_replace(F.regexp_replace(t, r"(?U)[^\S\n]+", " "), r" ?\n[ \n]*", "\n")
        else:
            t = F.regexp_replace(t, r"(?U)\s+", " ")
        t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    return F.lower(t) if cfg.lowercase else t


def clean_documents(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """The text and, where there are chunks, each chunk's text."""
    out = df.withColumn("text", clean(F.col("text"), cfg))
    if "chunks" not in df.columns:
        return out
    if not cfg.fix_unicode:
        return out.withColumn("chunks", F.transform("chunks", lambda c: c.withField("text", clean(c["text"], cfg))))
    rest = replace(cfg, fix_unicode=False)
    out = out.withColumn("_texts", nfkc_all(F.transform("chunks", lambda c: c["text"])))
    return out.withColumn("chunks", F.transform("chunks", lambda c, i: c.withField("text", clean(F.get("_texts", i), rest)))).drop("_texts")


def hash_matches(text: Column, pattern: str, kind: str) -> Column:
    """Each match becomes [KIND_ and 8 hex digits of its SHA-256], where it stands: the parts between matches and the matches, in turn."""
    to = lambda m: F.concat(F.lit(f"[{kind}_"), F.substring(F.sha2(m.cast("binary"), 256), 1, 8), F.lit("]"))
    marked = lambda t: F.array_join(F.zip_with(F.split(t, pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(to(m), F.lit("")))), "")
    return F.get(F.transform(F.array(text), marked), 0)  # bound by the lambda, so that the text, of which there are two uses, is computed once


def redact(text: Column, method: str = "mask", custom: list[tuple[str, str]] | None = None) -> Column:
    """Kinds in the order of ``PII``: mask gives [KIND], remove nothing, hash [KIND_digest]; then the custom (pattern, replacement)s."""
    if method not in ("mask", "remove", "hash"):
        raise ValueError(f"unknown redaction method {method}")
    t = F.coalesce(text, F.lit(""))
    for kind, pattern in PII.items():
        p = "(?U)" + pattern
        t = hash_matches(t, p, kind) if method == "hash" else F.regexp_replace(t, p, f"[{kind}]" if method == "mask" else "")
    for pattern, to in custom or []:
        t = F.regexp_replace(t, pattern, to.replace("\\", "\\\\").replace("$", "\\$"))
    return t


def redact_entities(df: DataFrame, recognise: Callable[[list[str]], list[list[tuple[int, int, str]]]], method: str = "mask", col: str = "text") -> DataFrame:
    """``df`` with the entities of a plugged-in recogniser redacted: mask and remove as ``redact``, hash [KIND_digest]. recognise: of a batch of texts the
    (start, end, kind)s of each; of overlapping ones the first, then the longest, counts. A null text is empty."""
    if method not in ("mask", "remove", "hash"):
        raise ValueError(f"unknown redaction method {method}")

    def one(text: str, found: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
            if a >= at and b > a:
                digest = "_" + hashlib.sha256(text[a:b].encode()).hexdigest()[:8] if method == "hash" else ""
                out += [text[at:a], "" if method == "remove" else f"[{kind}{digest}]"]
                at = b
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts = [x or "" for x in s]
            yield pd.Series([one(t, e) for t, e in zip(texts, recognise(texts))], dtype=object)

    return df.withColumn(col, of(F.col(col)))


def pii_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit("(?U)" + p)).alias(k.lower()) for k, p in PII.items()]
