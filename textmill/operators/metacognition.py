"""Pedagogical annotations by rules: confidence, complexity, prerequisites, learning objectives, cognitive load, features and reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.dialect import SPARK, Spark, evaluate, prepare
from textmill.operators.semantic_quality import avg_word_length, hits, per, words_in

# The patterns and weights below define the annotations.
CONFIDENT = [r"\b(?:is|are|will|must|always|never|definitely|certainly)\b", r"\b(?:proven|established|demonstrated|confirmed)\b", r"\b(?:fact|evidence|proof|undoubtedly)\b"]
HEDGED = [r"\b(?:might|could|may|perhaps|possibly|allegedly)\b", r"\b(?:seems?|appears?|suggests?|indicates?)\b", r"\b(?:probably|likely|presumably|supposedly)\b"]
STRUCTURES = [r"\b(?:which|that|who|whom|whose)\b", r"\b(?:although|because|since|while|whereas|if)\b", r"[;:]", r"\b(?:however|moreover|furthermore|nevertheless|consequently)\b"]
TECHNICAL = [r"\b[A-Z]{2,}\b", r"\b\w+(?:ology|ometry|ics|tion|sion|ism|ity)\b", r"\b(?:analysis|synthesis|methodology|paradigm|framework)\b"]
DOMAINS = {
    "mathematics": [r"\b(?:equation|theorem|proof|derivative|integral|matrix|vector|algebra|calculus|geometry)\b", r"\b(?:mathematical|numeric|quantitative|statistical)\b"],
    "science": [r"\b(?:hypothesis|experiment|theory|molecule|atom|cell|DNA|protein|chemical|physics|biology)\b", r"\b(?:scientific|empirical|research|laboratory)\b"],
    "computer_science": [r"\b(?:algorithm|programming|software|database|network|artificial|intelligence|machine|learning)\b", r"\b(?:computational|digital|technical|system)\b"],
    "business": [r"\b(?:strategy|management|marketing|finance|economics|profit|revenue|market|customer)\b", r"\b(?:business|commercial|corporate|organizational)\b"],
    "history": [r"\b(?:historical|ancient|medieval|renaissance|revolution|war|empire|civilization)\b", r"\b\d{3,4}(?:\s?(?:BC|AD|CE|BCE))?\b"],
    "philosophy": [r"\b(?:ethical|moral|philosophical|metaphysical|epistemological|ontological|logic|reasoning)\b", r"\b(?:argue|argument|premise|conclusion|validity|truth)\b"],
}
BLOOM = {
    "remember": r"\b(?:define|identify|list|name|recall|recognize|state)\b",
    "understand": r"\b(?:explain|describe|interpret|summarize|classify|compare|discuss)\b",
    "apply": r"\b(?:apply|demonstrate|use|solve|implement|execute|operate)\b",
    "analyze": r"\b(?:analyze|examine|investigate|break down|differentiate|organize)\b",
    "evaluate": r"\b(?:evaluate|assess|judge|critique|justify|argue|defend)\b",
    "create": r"\b(?:create|design|develop|generate|produce|construct|formulate)\b",
}
LOAD_TERMS = r"\b[A-Z]{2,}\b|\b\w+(?:ology|ometry|ics|tion)\b"
LOAD_MARKERS = r"\b(?:however|therefore|furthermore|moreover|consequently|nevertheless)\b"
LOAD_EXPLAIN = [r"\b(?:explain|because|reason|why|how|example|instance)\b", r"\b(?:means|refers to|defined as|that is)\b"]
FEATURES = {
    "has_examples": [r"\b(?:for example|for instance|such as|like|consider)\b", r"\b(?:e\.g\.|i\.e\.)\b"],
    "has_definitions": [r"\b(?:define|definition|means|refers to|defined as|is called)\b", r"\b(?:that is|namely|in other words)\b"],
    "has_analogies": [r"\b(?:like|similar to|analogous to|just as|comparable to)\b", r"\b(?:metaphor|analogy|comparison)\b"],
    "has_questions": [r"[?]"],
    "has_summaries": [r"\b(?:in summary|to summarize|in conclusion|overall)\b", r"\b(?:key points|main ideas|important)\b"],
}
SCAFFOLDING = {"step_by_step": r"\b(?:step|first|second|then|next|finally)\b", "prerequisites": r"\b(?:before|prerequisite|required|need to know)\b", "progressive_difficulty": r"\b(?:basic|advanced|complex|simple|difficult)\b"}
ENGAGEMENT = {"direct_address": r"\b(?:you|your|we|us|our)\b", "imperative_verbs": r"\b(?:consider|imagine|think|remember)\b", "rhetorical_questions": r"[?]", "exclamations": r"[!]"}
REASONING_TYPES = {
    "deductive": r"\b(?:therefore|thus|consequently|follows that|proves)\b",
    "inductive": r"\b(?:suggests|indicates|evidence shows|pattern|trend)\b",
    "analogical": r"\b(?:similar|like|analogous|comparable|parallel)\b",
    "causal": r"\b(?:because|caused by|results in|leads to|due to)\b",
    "conditional": r"\b(?:if|when|unless|provided that|assuming)\b",
    "comparative": r"\b(?:compared to|versus|different from|contrast)\b",
    "evaluative": r"\b(?:evaluate|assess|judge|critique|better|worse)\b",
}


def present(d: Spark, patterns: dict[str, str]) -> str:
    """The names whose pattern occurs, in order, comma-joined."""
    return d.join(d.filter(d.array(*[f"CASE WHEN {d.has('_l', p)} THEN '{k}' ELSE '' END" for k, p in patterns.items()]), "x <> ''"), ",")


def confidence(d: Spark) -> dict[str, str]:
    high, low = hits(d, CONFIDENT), hits(d, HEDGED)
    return {"high": high, "low": low, "confidence_score": f"CASE WHEN {high} + {low} = 0 THEN 0.5 ELSE {high} / (({high} + {low}) * 1.0) END"}


def reading(d: Spark) -> str:
    s = f"0.6 * least({d.size('_w')} / ({d.size('_s')} * 1.0) / 25, 1.0) + 0.4 * least({avg_word_length(d)} / 8, 1.0)"
    return f"CASE WHEN {d.size('_w')} = 0 OR {d.size('_s')} = 0 THEN 0.0 ELSE {s} END"


def complexity(d: Spark) -> dict[str, str]:
    w, s = d.size("_w"), d.size("_s")
    long = d.size(d.filter("_w", "length(x) > 6"))
    ttr = f"{d.size(d.distinct(d.map('_w', 'lower(x)')))} / ({w} * 1.0)"
    lexical = f"CASE WHEN {w} = 0 THEN 0.0 ELSE least({avg_word_length(d)} / 8 * 0.4 + {ttr} * 0.3 + {long} / ({w} * 1.0) * 0.3, 1.0) END"
    syntactic = f"CASE WHEN {s} = 0 THEN 0.0 ELSE least({w} / ({s} * 1.0) / 25 * 0.6 + {hits(d, STRUCTURES)} / ({s} * 1.0) / 3 * 0.4, 1.0) END"
    conceptual = f"CASE WHEN {w} = 0 THEN 0.0 ELSE least({hits(d, TECHNICAL, '_t')} / {per(d, 50)}, 1.0) END"
    return {"lexical": lexical, "syntactic": syntactic, "conceptual": conceptual, "overall": f"0.25 * ({lexical}) + 0.25 * ({syntactic}) + 0.25 * ({conceptual})"}


def prerequisites(d: Spark) -> dict[str, str]:
    """Strength of each domain, 0 where it is not over 0.1."""
    out = {}
    for k, ps in DOMAINS.items():
        s = f"least({hits(d, ps)} / {per(d, 50)}, 1.0)"
        out[k] = f"CASE WHEN {s} > 0.1 THEN {s} ELSE 0.0 END"
    tech = " OR ".join(f"({out[k]}) > 0" for k in ("mathematics", "science", "computer_science"))
    r = reading(d)
    return {**out, "technical_literacy": f"CASE WHEN {tech} THEN 0.7 ELSE 0.0 END", "advanced_reading": f"CASE WHEN ({r}) > 0.7 THEN {r} ELSE 0.0 END"}


def objectives(d: Spark) -> dict[str, str]:
    return {f"bloom_{k}": f"{d.cnt('_l', p)} / {per(d, 100)}" for k, p in BLOOM.items()}


def load(d: Spark) -> dict[str, str]:
    w, s = d.size("_w"), d.size("_s")
    zero = f"{w} = 0 OR {s} = 0"
    intrinsic = f"least(0.6 * {d.cnt('_t', LOAD_TERMS)} / ({w} * 1.0) + 0.4 * least({avg_word_length(d)} / 8, 1.0), 1.0)"
    long = d.size(d.filter("_s", f"{words_in(d, 'x')} > 20"))
    extraneous = f"least(0.4 * least({w} / ({s} * 1.0) / 30, 1.0) + 0.3 * {long} / ({s} * 1.0) + 0.3 * (1 - least({d.cnt('_l', LOAD_MARKERS)} / ({s} * 1.0), 1.0)), 1.0)"
    germane = f"least({hits(d, LOAD_EXPLAIN)} / ({s} * 1.0) / 2, 1.0)"
    out = {"intrinsic": intrinsic, "extraneous": extraneous, "germane": germane, "total": f"0.5 * {intrinsic} + 0.3 * {extraneous} + 0.2 * {germane}"}
    return {k: f"CASE WHEN {zero} THEN 0.0 ELSE {v} END" for k, v in out.items()}


def features(d: Spark) -> dict[str, str]:
    out = {k: "(" + " OR ".join(d.has("_l", p) for p in ps) + ")" for k, ps in FEATURES.items()}
    return {**out, "scaffolding": present(d, SCAFFOLDING), "engagement": present(d, ENGAGEMENT)}


def reasoning_types(d: Spark) -> dict[str, str]:
    return {"reasoning_types": present(d, REASONING_TYPES)}


# Markers of hedged and of assertive language, Bloom's numbers, and what domains ask for.
HEDGES = [r"\b(?:somewhat|rather|quite|fairly|relatively)\b", r"\b(?:tend to|inclined to|appears to)\b"]
ASSERTIVE = [r"\b(?:clearly|obviously|undoubtedly|certainly)\b", r"\b(?:must|will|always|never)\b"]
BLOOM_NUMBERS = {"remember": 1, "understand": 2, "apply": 3, "analyze": 4, "evaluate": 5, "create": 6}
DOMAIN_DESCRIPTIONS = {
    "mathematics": "Mathematical concepts, formulas, and quantitative reasoning",
    "science": "Scientific principles, experimental methods, and research concepts",
    "computer_science": "Programming concepts, algorithms, and technical systems",
    "business": "Business terminology, strategic concepts, and market dynamics",
    "history": "Historical context, chronological understanding, and cultural knowledge",
    "philosophy": "Philosophical reasoning, logical arguments, and abstract concepts",
    "technical_literacy": "Basic technical and scientific literacy required",
    "advanced_reading": "Advanced reading comprehension skills required",
}


def implicit_confidence(d: Spark) -> dict[str, str]:
    """The assertive share of assertive and hedged markers; 0.5 without any."""
    a, h = hits(d, ASSERTIVE), hits(d, HEDGES)
    return {"implicit_confidence": f"CASE WHEN {a} + {h} = 0 THEN 0.5 ELSE {a} / (({a} + {h}) * 1.0) END"}


def factors(d: Spark) -> dict[str, str]:
    """What complexity is made of; zeros without words or sentences."""
    w, s = d.size("_w"), d.size("_s")
    words = lambda x: f"CASE WHEN {w} = 0 THEN 0.0 ELSE {x} END"
    parts = lambda x: f"CASE WHEN {s} = 0 THEN 0.0 ELSE {x} / ({s} * 1.0) END"
    ttr = f"{d.size(d.distinct(d.map('_w', 'lower(x)')))} / ({w} * 1.0)"
    return {"avg_word_length": words(avg_word_length(d)), "avg_sentence_length": parts(w), "lexical_diversity": words(ttr), "technical_term_density": words(f"{hits(d, TECHNICAL, '_t')} / {per(d, 50)}"), "complex_structure_density": parts(hits(d, STRUCTURES))}


def ranked_prerequisites(d: Spark) -> dict[str, str]:
    """From the columns of ``prerequisites``: those over 0 as name:strength (in thousandths), the strongest first, ties in the order of the domains."""
    names = [*DOMAINS, "technical_literacy", "advanced_reading"]
    if d is SPARK:
        items = ", ".join(f"named_struct('s', -cast(round({k}, 6) as double), 'i', {i}, 'k', '{k}')" for i, k in enumerate(names))
        return {"prerequisites": f"array_join(transform(filter(array_sort(array({items})), x -> x.s < 0), x -> concat(x.k, ':', cast(round(-x.s * 1000) as bigint))), ',')"}
    items = ", ".join(f"{{'s': -round({k}, 6), 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(names))
    return {"prerequisites": f"array_to_string(list_transform(list_filter(list_sort([{items}]), lambda x: x.s < 0), lambda x: x.k || ':' || CAST(round(-x.s * 1000) AS BIGINT)), ',')"}


def objectives_table(df: DataFrame) -> DataFrame:
    """doc_id, level, bloom (1..6) and strength, a row for each of Bloom's levels whose verbs a text of ``df`` (doc_id, text) has."""
    out = evaluate(prepare(df), objectives(SPARK))
    rows = [F.struct(F.lit(k).alias("level"), F.lit(BLOOM_NUMBERS.get(k, 2)).alias("bloom"), F.col(f"bloom_{k}").cast("double").alias("strength")) for k in BLOOM]
    return out.select("doc_id", F.explode(F.array(*rows)).alias("o")).select("doc_id", "o.*").filter("strength > 0")


def described(domain: Column) -> Column:
    """What a domain asks for."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DOMAIN_DESCRIPTIONS.items() for x in kv]), domain), F.concat(domain, F.lit(" knowledge and concepts")))
