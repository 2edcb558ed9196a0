"""Knowledge extraction by rules: domain concepts, facts with their types, and co-occurrence of entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.dialect import SPARK, Spark, evaluate, prepare

# The patterns and words below define what is extracted.
CONCEPTS = [r"\b[A-Z]{2,}\b", r"\b\w+-\w+(?:-\w+)*\b", r"\b\w+(?:ology|ometry|ics|tion|sion)\b"]
FACT_CUES = [r"\b(?:is|are|was|were)\b", r"\b(?:according to|research|study|data)\b", r"\b\d{4}\b", r"\b(?:percent|%|million|billion)\b"]
OPINION_CUES = [r"\b(?:think|believe|feel|seem|appear)\b", r"\b(?:maybe|perhaps|possibly|probably)\b", r"\b(?:i|we|you)\b"]
FACT_TYPES = {"definition": ["define", "definition", "means", "refers to"], "causal": ["cause", "result", "due to", "because"], "empirical": ["research", "study", "experiment"], "quantitative": ["percent", "%", "million", "billion"]}


def concepts(df: DataFrame) -> DataFrame:
    """doc_id, pattern (0..2) and term, a row for each match of more than three characters."""
    found = [F.expr(f'transform(regexp_extract_all(text, r"(?U){p}", 0), x -> named_struct(\'pattern\', {i}, \'term\', x))') for i, p in enumerate(CONCEPTS)]
    return df.select("doc_id", F.explode(F.concat(*found)).alias("c")).select("doc_id", "c.pattern", "c.term").filter("length(term) > 3")


def fact_confidence(d: Spark, x: str) -> str:
    plus = " + ".join(f"CASE WHEN {d.has(x, p)} THEN 0.2 ELSE 0.0 END" for p in FACT_CUES)
    minus = " + ".join(f"CASE WHEN {d.has(x, p)} THEN 0.3 ELSE 0.0 END" for p in OPINION_CUES)
    return f"greatest(0.0, least(1.0, 0.3 + {plus} - ({minus})))"


def fact_type(d: Spark, x: str) -> str:
    any_of = lambda k: "(" + " OR ".join(d.contains(x, w) for w in FACT_TYPES[k]) + ")"
    year = d.has(x, r"\b\d{4}\b")
    return f"CASE WHEN {any_of('definition')} THEN 'definition' WHEN {any_of('causal')} THEN 'causal' WHEN {any_of('empirical')} THEN 'empirical' WHEN {year} THEN 'temporal' WHEN {any_of('quantitative')} THEN 'quantitative' ELSE 'descriptive' END"


def facts(prepared: DataFrame) -> DataFrame:
    """doc_id, statement, confidence and type of each sentence of 20 characters or more with a confidence over 0.5."""
    s = prepared.select("doc_id", F.explode("_s").alias("statement")).filter("length(statement) >= 20").withColumn("_l", F.lower("statement"))
    s = evaluate(s, {"confidence": fact_confidence(SPARK, "_l"), "fact_type": fact_type(SPARK, "_l")})
    return s.filter("confidence > 0.5").select("doc_id", "statement", "confidence", "fact_type")


#: What labels mean, and the parts of a name that tell a property (label, property, parts; of one label the first that is met).
ENTITY_TYPES = {"PERSON": "person", "ORG": "organization", "GPE": "location", "LOC": "location", "DATE": "temporal", "TIME": "temporal", "MONEY": "monetary", "PERCENT": "percentage", "CARDINAL": "number", "ORDINAL": "number"}
CANONICAL = ["PERSON", "ORG", "GPE"]
PROPERTIES = [("PERSON", "has_title", ["dr", "prof", "president", "ceo"]), ("ORG", "company", ["company", "corp", "inc", "ltd"]), ("ORG", "educational", ["university", "college", "school"])]
Recogniser = Callable[[list[str]], list[list[tuple[str, str, float]]]]


def entities(df: DataFrame, recognise: Recogniser | None = None) -> DataFrame:
    """doc_id, ix, entity, label and confidence. recognise: of a batch of texts the (text, label, confidence)s of each; without one capitalised word sequences,
    each text once, stand in."""
    if recognise is None:
        found = F.expr(r'array_distinct(regexp_extract_all(text, r"(?U)\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+\b", 0))')
        return df.select("doc_id", F.posexplode(found).alias("ix", "entity")).select("doc_id", "ix", "entity", F.lit("MISC").alias("label"), F.lit(0.5).alias("confidence"))

    @F.pandas_udf("array<struct<entity:string,label:string,confidence:double>>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([[{"entity": e, "label": k, "confidence": float(c)} for e, k, c in found] for found in recognise([x or "" for x in s])])

    return df.select("doc_id", F.posexplode(of(F.col("text"))).alias("ix", "e")).select("doc_id", "ix", "e.*")


def merge_entities(found: DataFrame) -> DataFrame:
    """Of rows (doc_id, ix, entity, label, confidence) one for each lower-cased text and label: the first's text and place, the largest confidence."""
    one = found.groupBy("doc_id", F.lower("entity").alias("_key"), "label").agg(F.min(F.struct("ix", "entity")).alias("f"), F.max("confidence").alias("confidence"))
    return one.select("doc_id", "f.ix", "f.entity", "label", "confidence")


def title_case(text: Column) -> Column:
    """Upper case for a letter that follows none, lower case for the others."""
    letters = F.split(F.lower(text), "")
    before = lambda i: F.when(i == 0, F.lit(" ")).otherwise(F.get(letters, i - 1))
    return F.array_join(F.transform(letters, lambda c, i: F.when(before(i).rlike(r"\p{L}"), c).otherwise(F.upper(c))), "")


def analyse_entities(found: DataFrame) -> DataFrame:
    """``found`` (entity, label) with canonical_form, entity_type and the array properties."""
    low = F.lower("entity")
    any_of = lambda parts: F.greatest(*[F.contains(low, F.lit(x)) for x in parts])
    has: dict[str, Column] = {}
    for label, name, parts in PROPERTIES:
        own = F.when(any_of(parts), F.array(F.lit(name)))
        has[label] = F.coalesce(has[label], own) if label in has else own
    none = F.array().cast("array<string>")
    props = F.coalesce(*[F.when(F.col("label") == k, c) for k, c in has.items()], none)
    kinds = F.create_map(*[F.lit(x) for kv in ENTITY_TYPES.items() for x in kv])
    form = F.when(F.col("label").isin(CANONICAL), title_case(F.col("entity"))).otherwise(F.col("entity"))
    return found.withColumns({"canonical_form": form, "entity_type": F.coalesce(F.try_element_at(kinds, F.col("label")), F.lit("other")), "properties": props})


def cooccurrence(prepared: DataFrame, found: DataFrame, predicate: str = "co_occurs_with", confidence: float = 0.3) -> DataFrame:
    """doc_id, sentence_ix, subject, predicate, object and confidence: pairs of a document's entities (earlier first) whose texts one of its sentences holds, a row
    for each sentence. A sentence's entities are gathered before they are paired."""
    own = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ix", "entity"))).alias("es")).filter("size(es) > 1")
    s = prepared.select("doc_id", "_p").join(own, "doc_id").select("doc_id", "es", F.posexplode("_p").alias("sentence_ix", "sentence"))  # documents are joined, not sentences
    at = s.select("doc_id", "sentence_ix", F.filter("es", lambda e: F.contains(F.col("sentence"), e["entity"])).alias("es")).filter("size(es) > 1")
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda b: F.struct(a["entity"].alias("subject"), b["entity"].alias("object")))))
    out = at.select("doc_id", "sentence_ix", F.explode(pairs).alias("r"))
    return out.select("doc_id", "sentence_ix", "r.subject", F.lit(predicate).alias("predicate"), "r.object", F.lit(confidence).alias("confidence"))


def graph_confidence(kinds: list[DataFrame], docs: DataFrame) -> DataFrame:
    """doc_id and confidence_score of each document: the mean, over the kinds of rows (doc_id, confidence) that it has, of their mean confidence; 0.5 without any."""
    means = [k.groupBy("doc_id").agg(F.avg("confidence").alias("m")) for k in kinds]
    both = reduce(DataFrame.unionByName, means).groupBy("doc_id").agg(F.avg("m").alias("m"))
    return docs.select("doc_id").join(both, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(0.5)).alias("confidence_score"))


def knowledge_graph(df: DataFrame, recognise: Recogniser | None = None) -> DataFrame:
    """doc_id, entities, relations, concepts, facts (arrays of structs) and confidence_score of each row of ``df`` (doc_id, text; ids are unique). Facts carry the
    entities and relations whose texts their statement holds."""
    text = prepare(df.select("doc_id", "text"))
    ents = analyse_entities(merge_entities(entities(df, recognise)))
    rels, cons, fs = cooccurrence(text, ents), concepts(df), facts(text)
    out = graph_confidence([ents.select("doc_id", "confidence"), rels.select("doc_id", "confidence"), fs.select("doc_id", "confidence")], df)
    for name, rows, cols in (("entities", ents, ["ix", "entity", "label", "confidence", "canonical_form", "entity_type", "properties"]), ("relations", rels, ["sentence_ix", "subject", "predicate", "object", "confidence"]), ("concepts", cons, ["pattern", "term"]), ("facts", fs, ["statement", "confidence", "fact_type"])):
        own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        empty = own.schema[name].dataType
        out = out.join(own, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(empty)))
    held = lambda f, x: F.contains(F.lower(f["statement"]), F.lower(x))
    return out.withColumn("facts", F.transform("facts", lambda f: f.withField("entities", F.transform(F.filter("entities", lambda e: held(f, e["entity"])), lambda e: e["entity"])).withField("relations", F.filter("relations", lambda r: held(f, r["subject"]) & held(f, r["object"])))))
