"""License scans: phrases, and an exact set-similarity join of text blocks with templates, in DataFrame operations only.

Base: the places where a phrase's words stand consecutively. Method: of a template of m words, a block is a run of m and a
quarter more consecutive words, over line breaks, so that wrapped or marked statements are met and words that stand far apart
are not; it meets the template if it contains at least ``threshold`` of its distinct words. Template words are ordered by their
frequency over all documents, the rarest first. A block that meets has one of the first |T| - o + 1 words of the template, where
o is the overlap that is needed (prefix); so only words around such words are looked at. Places with too few words around them
(length), or whose template has too few words from the shared one on (position), go; of the rest, every run that holds the
shared word is counted in full. Documents that do not hold o of the template's words anywhere are never split into places.

Defined results: a null or empty text has no words, no places and no labels, and score 0; equal rows give equal results, each
its own row; a text with fewer words than a run is one run; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import broadcast_checked, cut
from textmill.llm.contamination import words

#: Fixed by the contract: phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Statements and notices of public licenses, by label; a label may have several. Fixed values.
TEMPLATES = [
    ("mit", "this software is released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]


def run_length(template: str) -> int:
    """Words of a template's blocks."""
    m = len(template.split())
    return m + math.ceil(m / 4)


def needed(template: str, threshold: float) -> int:
    """Distinct words of a template that a block must hold."""
    return math.ceil(threshold * len(set(template.split())) - 1e-9)


def phrase_places(w: Column, phrase: str) -> Column:
    """Starts (from 0) of the phrase's words in ``w``."""
    p = phrase.split()
    last = F.size(w) - len(p)
    same = lambda i: [F.get(w, i + k) == F.lit(x) for k, x in enumerate(p)]

    def all_same(i: Column) -> Column:
        out = same(i)[0]
        for c in same(i)[1:]:
            out = out & c
        return out

    none = F.array().cast("array<int>")
    rare = p[-2] if p[-1].isdigit() or len(p[-1]) < 3 else p[-1]
    return F.when((last >= 0) & F.array_contains(w, rare), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), all_same)).otherwise(none)


def lit(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def scanned(docs: DataFrame, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """Per row of ``docs``: doc_id, _t (hash of the text), n_words, a column of places for each phrase, and hits, the template words that it holds. One pass
    over the texts."""
    vocab = sorted({x for _, t in templates for x in t.split()})
    w = docs.select("doc_id", F.xxhash64("text").alias("_t"), words(F.col("text")).alias("_w"))
    return w.select("doc_id", "_t", F.size("_w").cast("long").alias("n_words"), *[phrase_places(F.col("_w"), p).alias(f"_p{k}") for k, p in enumerate(phrases)], F.array_intersect(lit(vocab), "_w").alias("hits"))


def template_labels(docs: DataFrame, own: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per distinct document (doc_id, _t) with a block that meets a template: labels (sorted) and containment (the largest). own: ``scanned`` of ``docs``."""
    spark = docs.sparkSession
    n = {r["x"]: r["n"] for r in own.select(F.explode("hits").alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}  # at most one row for each template word
    rows = []
    for label, t in templates:
        toks = sorted(set(t.split()), key=lambda x: (n.get(x, 0), x))
        need = needed(t, threshold)
        rows += [(x, label, toks, len(toks), need, i, run_length(t)) for i, x in enumerate(toks[: len(toks) - need + 1])]
    heads = broadcast_checked(spark.createDataFrame(rows, "x string, label string, toks array<string>, size int, need int, i int, length int"), F.lit(4000))
    most = max(run_length(t) for _, t in templates)

    enough = F.lit(False)
    for _, t in templates:
        enough = enough | (F.size(F.array_intersect("hits", lit(sorted(set(t.split()))))) >= needed(t, threshold))
    some = own.filter(F.size("hits") >= min(needed(t, threshold) for _, t in templates)).filter(enough).select(F.col("doc_id").alias("d"), F.col("_t").alias("t")).distinct()
    texts = docs.filter("text is not null").withColumn("_t", F.xxhash64("text"))
    texts = texts.join(broadcast_checked(some, F.lit(32)), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t")), "left_semi")
    w = texts.select("doc_id", "_t", words(F.col("text")).alias("w"))

    rare = lit(sorted({r[0] for r in rows}))
    first = lambda p: F.greatest(p - (most - 2), F.lit(1))
    # p from 0; the words around a place are cut out before they are rows, so that no row carries a text
    around = lambda x, p: F.when(F.array_contains(rare, x), F.struct(x.alias("x"), (p + 1 - first(p)).alias("o"), F.slice("w", first(p), p + most - first(p) + 1).alias("s")))
    # explode_outer: of the inner form a filter is inferred that would split the texts twice; the join drops its nulls
    at = w.select("doc_id", "_t", F.explode_outer(F.filter(F.transform("w", around), lambda r: r.isNotNull())).alias("r")).select("doc_id", "_t", "r.*")
    lo = F.greatest(F.col("o") - (F.col("length") - 1), F.lit(0))
    near = at.join(heads, "x").filter(F.col("size") - F.col("i") >= F.col("need")).withColumn("s", F.slice("s", lo + 1, F.col("o") + F.col("length") - lo))
    near = near.filter((F.size("s") >= F.col("need")) & (F.size(F.array_intersect("s", "toks")) >= F.col("need")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("s") - (F.col("length") - 1), F.lit(1)))
    held = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("s", i, F.col("length")), F.col("toks")))))
    met = near.withColumn("n", held).filter(F.col("n") >= F.col("need"))
    return met.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max(F.col("n") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (1 with a place, else the largest containment)."""
    docs = docs.select("doc_id", "text")
    own = cut(scanned(docs, phrases, templates), "scanned")
    at = [F.col(f"_p{k}") for k in range(len(phrases))]
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(x)) for c, x in zip(at, phrases.values())]), lambda x: x.isNotNull())))
    mine = own.withColumn("_at", F.concat(*at)).select("doc_id", "_t", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"), base.alias("_base"))
    found = template_labels(docs, own, templates, threshold).alias("f")
    both = mine.alias("o").join(found, F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("o._t") == F.col("f._t")), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("labels", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return both.select("o.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
