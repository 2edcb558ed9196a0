"""Rule-based semantic quality: authority, coherence, complexity, factuality, reasoning, readability and training value."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textmill.functions.dialect import MEASURES, SPARK, Spark, evaluate, prepare

# The patterns and weights below define the scores.
AUTHORITY = {
    "academic": (1.0, [r"\b(?:research|study|experiment|analysis|investigation)\b", r"\b(?:university|college|institute|laboratory)\b", r"\b(?:professor|dr\.|ph\.d|researcher)\b", r"\b(?:published|peer.reviewed|journal|conference)\b", r"\b(?:doi|arxiv|pubmed)\b"]),
    "expert": (0.8, [r"\b(?:expert|specialist|professional|authority)\b", r"\b(?:ceo|director|chief|president|founder)\b", r"\b(?:years? of experience|decades? of)\b", r"\b(?:certified|licensed|accredited)\b"]),
    "institutional": (0.7, [r"\b(?:government|official|ministry|department)\b", r"\b(?:organization|association|foundation)\b", r"\b(?:report|white paper|policy|guidelines)\b", r"\b(?:statistics|census|survey|poll)\b"]),
    "media": (0.5, [r"\b(?:news|journalist|reporter|correspondent)\b", r"\b(?:article|story|coverage|investigation)\b", r"\b(?:source|according to|reports)\b"]),
    "opinion": (0.2, [r"\bi (?:think|believe|feel|opinion)\b", r"\b(?:personally|my view|in my opinion)\b", r"\b(?:seems|appears|might|could be)\b", r"\b(?:blog|post|comment|review)\b"]),
}
HIGH_CERTAINTY = [r"\b(?:is|are|was|were|has|have|will)\b", r"\b(?:always|never|every|all|none)\b", r"\b\d+(?:\.\d+)?%\b", r"\b\d{4}\b", r"\b(?:fact|evidence|proof|demonstrate)\b"]
MEDIUM_CERTAINTY = [r"\b(?:often|usually|typically|generally)\b", r"\b(?:most|many|some|few)\b", r"\b(?:tend to|likely|probable)\b"]
LOW_CERTAINTY = [r"\b(?:might|could|may|perhaps|possibly)\b", r"\b(?:seem|appear|suggest|indicate)\b", r"\b(?:allegedly|reportedly|supposedly)\b"]
FACTUAL = [r"\b\d+(?:\.\d+)?%\b", r"\b\d{4}\b", r"\b(?:study|research|experiment|analysis)\b", r"\b(?:according to|reports|statistics)\b"]
TRANSITIONS = ["however", "therefore", "furthermore", "moreover", "additionally", "consequently", "nevertheless", "meanwhile", "similarly", "likewise", "in contrast", "on the other hand", "as a result", "for example"]
SYNTAX = [r"\b(?:which|that|who|whom|whose)\b", r"\b(?:although|because|since|while|whereas)\b", r"[;:]", r"\b(?:furthermore|moreover|however|nevertheless)\b"]
REASONING = [r"\b(?:because|since|due to|as a result|therefore|thus|consequently)\b", r"\b(?:evidence|proof|data|research|study)\b", r"\b(?:however|but|although|whereas|in contrast|compared to)\b", r"\b(?:therefore|thus|in conclusion|overall|finally)\b", r"\b(?:first|second|next|then|finally|lastly)\b"]
CLAIM, EVIDENCE, CONCLUSION = r"\b(?:argue|claim|assert|maintain)\b", r"\b(?:evidence|study|research|data)\b", r"\b(?:therefore|thus|conclude|shows)\b"
EXPLANATIONS = [r"\b(?:explain|because|reason|why|how|what|definition)\b", r"\b(?:means|refers to|defined as|in other words)\b", r"\b(?:for example|for instance|such as|like)\b", r"\b(?:that is|namely|specifically)\b"]
EXAMPLES = [r"\b(?:for example|for instance|such as|like|consider)\b", r"\b(?:e\.g\.|i\.e\.|viz\.)\b", r"\b(?:example|instance|illustration|case)\b"]
WEIGHTS = {"authority": 0.3, "coherence": 0.25, "complexity": 0.2, "factuality": 0.15, "reasoning": 0.1}


def hits(d: Spark, patterns: list[str], col: str = "_l") -> str:
    return "(" + " + ".join(d.cnt(col, p) for p in patterns) + ")"


def per(d: Spark, words: int) -> str:
    """Text length in units of ``words`` words, at least 1."""
    return f"greatest({d.size('_w')} / {words}.0, 1.0)"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def avg_word_length(d: Spark) -> str:
    return f"(length({d.join('_w')}) / ({d.size('_w')} * 1.0))"


def authority(d: Spark) -> str:
    total = " + ".join(f"least({hits(d, ps)} / {per(d, 100)}, 1.0) * {w}" for w, ps in AUTHORITY.values())
    return f"least(({total}) / {round(sum(w for w, _ in AUTHORITY.values()), 6)}, 1.0)"


def coherence(d: Spark) -> str:
    found = " + ".join(f"{d.size(d.filter('_s', d.contains('lower(x)', t)))}" for t in TRANSITIONS)
    return f"CASE WHEN {d.size('_s')} < 2 THEN 0.5 ELSE least(2.0 * ({found}) / {d.size('_s')}, 0.8) END"


def complexity(d: Spark) -> str:
    ttr = f"{d.size(d.distinct(d.map('_w', 'lower(x)')))} / ({d.size('_w')} * 1.0)"
    s = f"least({avg_word_length(d)} / 8, 1.0) * 0.3 + least({d.size('_w')} / ({d.size('_s')} * 1.0) / 25, 1.0) * 0.3 + {ttr} * 0.2 + least({hits(d, SYNTAX)} / ({d.size('_s')} * 1.0) / 2, 1.0) * 0.2"
    return f"CASE WHEN {d.size('_w')} = 0 OR {d.size('_s')} = 0 THEN 0.0 ELSE {clamp(s)} END"


def factuality(d: Spark) -> str:
    weighted = f"({hits(d, HIGH_CERTAINTY)} * 1.0 + {hits(d, MEDIUM_CERTAINTY)} * 0.6 - {hits(d, LOW_CERTAINTY)} * 0.3)"
    return clamp(f"({weighted} / {per(d, 50)} + {hits(d, FACTUAL)} / {per(d, 100)}) / 2")


def reasoning(d: Spark) -> str:
    whole = " AND ".join(d.has("_l", p) for p in (CLAIM, EVIDENCE, CONCLUSION))
    return clamp(f"{hits(d, REASONING)} * 0.2 / {per(d, 100)} + CASE WHEN {whole} THEN 0.3 ELSE 0.0 END")


def explanations(d: Spark) -> str:
    return f"least({hits(d, EXPLANATIONS)} / {per(d, 50)}, 1.0)"


def examples(d: Spark) -> str:
    return f"least({hits(d, EXAMPLES)} / {per(d, 100)}, 1.0)"


def complexity_fit(c: str) -> str:
    return f"CASE WHEN {c} >= 0.3 AND {c} <= 0.7 THEN 1.0 WHEN {c} < 0.3 THEN {c} / 0.3 ELSE (1.0 - {c}) / 0.3 END"


def lexical_diversity(d: Spark) -> str:
    alpha = d.filter("_w", d.has("x", r"^\p{L}+$") if d is SPARK else r"regexp_full_match(x, '\p{L}+')")
    return f"CASE WHEN {d.size(alpha)} = 0 THEN 0.0 ELSE {d.size(d.distinct(d.map(alpha, 'lower(x)')))} / ({d.size(alpha)} * 1.0) END"


def sentence_length(d: Spark) -> str:
    return f"CASE WHEN {d.size('_s')} = 0 THEN 0.0 ELSE {d.total(d.map('_s', words_in(d, 'x')))} / ({d.size('_s')} * 1.0) END"


def words_in(d: Spark, col: str) -> str:
    """How many words a text has."""
    return f'regexp_count({col}, r"(?U)\\S+")' if d is SPARK else f"len(regexp_extract_all({col}, '\\S+'))"


def syllables(d: Spark, x: str) -> str:
    """Of a lower-cased word: its runs of vowels, less one for an e at the end if there are more, at least one."""
    runs = f'regexp_count({x}, "[aeiouy]+")' if d is SPARK else f"len(regexp_extract_all({x}, '[aeiouy]+'))"
    ends = f"{x} LIKE '%e'"
    return f"greatest({runs} - CASE WHEN {ends} AND {runs} > 1 THEN 1 ELSE 0 END, 1)"


MEASURES[SPARK.total(SPARK.map("_w", syllables(SPARK, "lower(x)")))] = "syllables"


def readability(d: Spark) -> str:
    syl = d.total(d.map("_w", syllables(d, "lower(x)")))
    s = f"206.835 - 1.015 * ({d.size('_w')} / ({d.size('_s')} * 1.0)) - 84.6 * ({syl} / ({d.size('_w')} * 1.0))"
    return f"CASE WHEN {d.size('_w')} = 0 OR {d.size('_s')} = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, {s})) / 100 END"


BASE = {"authority": authority, "coherence": coherence, "complexity": complexity, "factuality": factuality, "reasoning": reasoning}
DETAIL = {"explanations": explanations, "examples": examples, "lexical_diversity": lexical_diversity, "sentence_length": sentence_length, "readability": readability}


def overall() -> str:
    return " + ".join(f"{w} * {k}" for k, w in WEIGHTS.items())


def training_value() -> str:
    return clamp(f"0.25 * explanations + 0.2 * examples + 0.2 * 0.5 + 0.15 * reasoning + 0.1 * factuality + 0.1 * ({complexity_fit('complexity')})")


def score(df: DataFrame) -> DataFrame:
    """``df`` with all scores, overall and training_value."""
    out = evaluate(prepare(df), {k: f(SPARK) for k, f in {**BASE, **DETAIL}.items()})
    return evaluate(out, {"overall": overall(), "training_value": training_value()}).drop("_t", "_l", "_w", "_p", "_s")
