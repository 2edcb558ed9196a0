"""Benchmark decontamination by winnowing, in DataFrame operations only.

A document and a test item share a span if they share ``span`` consecutive words; an item with fewer words, but not none,
must occur as a whole. Of every ``span - k + 1`` consecutive k-gram hashes the least is a fingerprint, so any shared span
has a shared fingerprint. Fingerprints of documents meet those of the items in an equi-join; where one meets, the document's
spans around it are compared with the items' spans as texts, and the words of equal ones are hit.

The items' tables are broadcast only after their size is measured; else adaptive execution splits hot keys of the shuffled
join. Documents are carried by id and text hash, never by their words.

Defined results: a null text, or one without words, has no words and no hits; a null or empty item matches nothing; rows with
equal id and text give equal results, each its own row; with no items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import ascii_lower, broadcast_checked

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters; none of a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def grams(hashes: Column, n: int) -> Column:
    """Hashes of all n consecutive elements."""
    return F.when(F.size(hashes) >= n, F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(F.slice(hashes, i + 1, n)))).otherwise(F.array().cast("array<bigint>"))


def minima(kgrams: Column, w: int) -> Column:
    """The distinct least hashes of all w consecutive ones."""
    least = F.transform(F.slice(kgrams, 1, F.greatest(F.size(kgrams) - (w - 1), F.lit(0))), lambda x, i: F.array_min(F.slice(kgrams, i + 1, w)))
    return F.when(F.size(kgrams) >= w, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_w", words(F.col("text"))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))


def hits(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """Per distinct document (doc_id, _t hash of its text) with a hit: n_hit, n_items and ids, the sorted item ids as strings.
    docs: doc_id, text; items: item_id, text."""
    tests = hashed(items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")).withColumn("_n", F.least(F.size("_w"), F.lit(span))).filter("_n > 0")
    short = sorted(r["_n"] for r in tests.filter(F.col("_n") < span).select("_n").distinct().collect())  # at most span - 1 lengths
    fingerprints = tests.withColumn("_k", grams(F.col("_h"), k)).select(F.explode(F.when(F.col("_n") == span, minima(F.col("_k"), span - k + 1)).otherwise(F.array(F.xxhash64("_h")))).alias("_f")).distinct()
    spans = tests.select("item_id", "_n", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1), lambda i: F.array_join(F.slice(F.col("_w"), i, F.col("_n")), " "))).alias("_s")).distinct()

    # explode_outer: of the inner form a filter is inferred that would compute the fingerprints twice; the join drops its nulls
    texts = docs.select("doc_id", "text").filter("text is not null").withColumn("_t", F.xxhash64("text"))
    d = hashed(texts).withColumn("_k", grams(F.col("_h"), k))
    every = F.concat(minima(F.col("_k"), span - k + 1), *[F.array_distinct(grams(F.col("_h"), n)) for n in short])
    met = d.select("doc_id", "_t", F.explode_outer(every).alias("_f")).join(broadcast_checked(fingerprints, F.lit(16)), "_f").groupBy("doc_id", "_t").agg(F.collect_set("_f").alias("_m"))

    there = texts.alias("d").join(met.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d._t") == F.col("m._t")))
    there = hashed(there.select("d.doc_id", "d._t", "d.text", "_m")).withColumn("_k", grams(F.col("_h"), k))
    around = lambda p: F.sequence(F.greatest(p - (span - k), F.lit(0)), F.least(p, F.size("_w") - span))
    at = lambda c: F.filter(F.transform(c, lambda x, i: F.when(F.array_contains("_m", x), i)), lambda i: i.isNotNull())
    # a k-gram near an end of the text has fewer spans around it
    long_at = F.array_distinct(F.flatten(F.transform(F.filter(at(F.col("_k")), lambda p: (F.size("_w") >= span) & (F.greatest(p - (span - k), F.lit(0)) <= F.least(p, F.size("_w") - span))), around)))
    as_spans = lambda c, n: F.transform(c, lambda i: F.struct(i.cast("int").alias("i"), F.lit(n).alias("n")))
    cand = there.select("doc_id", "_t", "_w", F.explode_outer(F.concat(as_spans(long_at, span), *[as_spans(at(grams(F.col("_h"), n)), n) for n in short])).alias("_at"))
    cand = cand.select("doc_id", "_t", "_at", F.array_join(F.slice("_w", F.col("_at.i") + 1, F.col("_at.n")), " ").alias("_s"))
    equal = cand.join(broadcast_checked(spans, F.octet_length("_s") + 48), "_s")
    equal = equal.filter(F.col("_n") == F.col("_at.n"))
    per = equal.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("_at")).alias("_at"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = F.greatest(a["end"], x["i"] + x["n"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], x["i"])).alias("n"))

    return per.select("doc_id", "_t", F.aggregate("_at", start, step)["n"].cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), "ids")


def mark(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, ids (array of item ids) and contaminated."""
    own = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    found = hits(docs, items, span, k).alias("f")
    both = own.alias("o").join(found, F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("o._t") == F.col("f._t")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return both.select("o.doc_id", "n_words", zero(F.col("n_hit")).alias("n_hit"), zero(F.col("n_items")).alias("n_items"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids")).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns kept."""
    found = hits(docs, items, span, k).select("doc_id", "_t").alias("hit")
    return docs.alias("own").join(found, F.col("own.doc_id").eqNullSafe(F.col("hit.doc_id")) & (F.xxhash64("own.text") == F.col("hit._t")), "left_anti")
