"""Adversarial screening by rules: bias, contradictions, harmful content, fairness, robustness, review flags and issues."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.batches import map_slices
from textmill.functions.counts import Texts, automaton, python_table
from textmill.functions.dialect import SPARK, Spark, evaluate, prepare
from textmill.operators.semantic_quality import clamp, hits, per

# The patterns, weights and severities below define the screening.
BIAS = {
    "gender_bias": (0.8, [r"\b(?:women|girls?|female)\s+(?:are\s+)?(?:naturally|typically|usually|often)\s+(?:more|less|better|worse)\s+(?:at|with|in)", r"\b(?:men|boys?|male)\s+(?:are\s+)?(?:naturally|typically|usually|often)\s+(?:more|less|better|worse)\s+(?:at|with|in)", r"\b(?:housewife|homemaker|stay-at-home\s+mom)\b", r"\b(?:working\s+mother|career\s+woman)\b", r"\b(?:attractive|beautiful|pretty|sexy)\s+(?:woman|girl|female)", r"\b(?:strong|handsome|masculine)\s+(?:man|boy|male)"]),
    "racial_bias": (0.9, [r"\b(?:asian|chinese|japanese)\s+(?:are\s+)?(?:good|bad|better|worse)\s+(?:at|with|in)\s+(?:math|science|driving)", r"\b(?:black|african)\s+(?:people|person|man|woman)\s+(?:are\s+)?(?:more|less|naturally|typically)", r"\b(?:white|caucasian)\s+(?:privilege|supremacy)\b", r"\b(?:minority|ethnic)\s+(?:group|community)\s+(?:are|is|tend)", r"\b(?:ghetto|hood|urban)\s+(?:culture|lifestyle|behavior)", r"\b(?:primitive|backwards|uncivilized)\b"]),
    "age_bias": (0.7, [r"\b(?:old|elderly|senior)\s+(?:people|person|man|woman)\s+(?:are\s+)?(?:slow|confused|forgetful|stubborn)", r"\b(?:young|millennial|gen\s?z)\s+(?:people|person)\s+(?:are\s+)?(?:lazy|entitled|irresponsible)", r"\b(?:too\s+old|too\s+young)\s+(?:for|to)\b", r"\b(?:over|under)\s+the\s+hill\b"]),
    "religious_bias": (0.9, [r"\b(?:muslim|islamic|christian|jewish|hindu|buddhist)\s+(?:people|person)\s+(?:are\s+)?(?:violent|peaceful|extremist)", r"\b(?:religion|faith)\s+(?:causes|leads\s+to|results\s+in)\s+(?:violence|war|conflict)", r"\b(?:atheist|agnostic)\s+(?:people|person)\s+(?:are\s+)?(?:immoral|amoral|evil)"]),
    "socioeconomic_bias": (0.8, [r"\b(?:poor|low-income|working-class)\s+(?:people|families)\s+(?:are\s+)?(?:lazy|unmotivated|irresponsible)", r"\b(?:rich|wealthy|upper-class)\s+(?:people|families)\s+(?:are\s+)?(?:greedy|selfish|corrupt)", r"\b(?:welfare|food\s+stamps|government\s+assistance)\s+(?:recipients|people)\s+(?:are\s+)?(?:lazy|cheating)"]),
    "disability_bias": (0.9, [r"\b(?:disabled|handicapped|retarded)\s+(?:people|person)\s+(?:are\s+)?(?:burden|helpless|inspiration)", r"\b(?:mental|physical)\s+(?:disability|illness)\s+(?:makes|causes|leads)", r"\b(?:normal|able-bodied)\s+(?:people|person)\b"]),
}
HARM = {
    "hate_speech": (3, [r"\b(?:hate|despise|loathe)\s+(?:all|every|those)\s+(?:people|person|group)", r"\b(?:should\s+(?:be\s+)?(?:killed|eliminated|removed|banned))", r"\b(?:inferior|superior)\s+(?:race|gender|religion|group)", r"\b(?:pure|master)\s+race\b"]),
    "violence_incitement": (4, [r"\b(?:kill|murder|assassinate|eliminate)\s+(?:all|every|those)", r"\b(?:violence|force|war)\s+(?:is\s+)?(?:necessary|justified|required)", r"\b(?:fight|attack|destroy)\s+(?:them|they|those)", r"\b(?:bomb|explosion|terrorist|attack)\b"]),
    "misinformation": (2, [r"\b(?:proven\s+fact|scientists\s+agree|everyone\s+knows)\s+(?:that|about)", r"\b(?:fake|hoax|conspiracy|cover-up)\b.*(?:government|media|official)", r"\b(?:vaccines|medicine|treatment)\s+(?:cause|lead\s+to|result\s+in)\s+(?:autism|cancer|death)", r"\b(?:climate\s+change|global\s+warming)\s+(?:is\s+)?(?:fake|hoax|lie)\b"]),
    "discrimination": (3, [r"\b(?:should\s+not\s+be\s+allowed|ban|exclude)\s+(?:women|minorities|immigrants)", r"\b(?:separate|segregate|divide)\s+(?:by|based\s+on)\s+(?:race|gender|religion)", r"\b(?:not\s+qualified|unfit|inappropriate)\s+(?:because|due\s+to)\s+(?:being|their)", r"\b(?:go\s+back|return)\s+(?:to\s+)?(?:your|their)\s+(?:country|homeland)\b"]),
}
CONTRADICTIONS = [
    (r"\b(?:always|never|all|none|every)\b", r"\b(?:sometimes|some|few|rarely|occasionally)\b"),
    (r"\b(?:is|are|was|were)\b", r"\b(?:is not|are not|was not|were not|isn't|aren't|wasn't|weren't)\b"),
    (r"\b(?:true|correct|right|accurate)\b", r"\b(?:false|incorrect|wrong|inaccurate)\b"),
    (r"\b(?:increase|rise|grow|improve)\b", r"\b(?:decrease|fall|decline|worsen)\b"),
]
GROUPS = {
    "gender": {"male": r"\b(?:he|him|his|man|men|male|boy|boys)\b", "female": r"\b(?:she|her|hers|woman|women|female|girl|girls)\b", "non_binary": r"\b(?:they|them|their|non-binary|genderqueer)\b"},
    "age": {"young": r"\b(?:young|youth|teen|child|children|kid)\b", "adult": r"\b(?:adult|grown-up|middle-aged)\b", "elderly": r"\b(?:elderly|senior|old|aged)\b"},
}
INCLUSIVE = [r"\b(?:diverse|inclusive|equal|equitable|fair)\b", r"\b(?:all|everyone|each|every)\s+(?:person|people|individual)", r"\b(?:regardless\s+of|irrespective\s+of|without\s+regard\s+to)\b", r"\b(?:people\s+with\s+disabilities|differently\s+abled)\b"]
EXCLUSIVE = [r"\b(?:only|just|merely)\s+(?:men|women|boys|girls)\b", r"\b(?:normal|abnormal|typical|atypical)\s+(?:people|person)\b", r"\b(?:us\s+vs\s+them|we\s+and\s+they)\b"]
VIEWPOINTS = [r"\b(?:however|on\s+the\s+other\s+hand|alternatively|conversely)\b", r"\b(?:some\s+argue|others\s+believe|critics\s+say|supporters\s+claim)\b", r"\b(?:perspective|viewpoint|opinion|stance)\b"]
SUPPORT = [r"\b(?:research|study|experiment|data|evidence|proof)\b", r"\b(?:according\s+to|based\s+on|studies\s+show|research\s+indicates)\b", r"\b(?:statistics|findings|results|conclusion)\b"]
ABSOLUTE, QUALIFIED = r"\b(?:always|never|all|none|every|completely|totally)\b", r"\b(?:often|sometimes|many|some|generally|typically|usually)\b"
BIAS_LIMIT, CONTRADICTION_LIMIT, HARM_LIMIT = 0.7, 0.3, 0.6


def bias(d: Spark) -> dict[str, str]:
    """Each type's density, and the mean over the types found, by weight."""
    n = {k: f"least({hits(d, ps)} / {per(d, 100)}, 1.0)" for k, (_, ps) in BIAS.items()}
    top = " + ".join(f"{k} * {w}" for k, (w, _) in BIAS.items())
    low = " + ".join(f"CASE WHEN {k} > 0 THEN {w} ELSE 0.0 END" for k, (w, _) in BIAS.items())
    return {**n, "bias_score": f"CASE WHEN ({low}) = 0 THEN 0.0 ELSE ({top}) / ({low}) END"}


def harm(d: Spark) -> dict[str, str]:
    """Each type's density, and the largest by severity out of 4."""
    n = {k: f"least({hits(d, ps)} / {per(d, 100)}, 1.0)" for k, (_, ps) in HARM.items()}
    top = "greatest(" + ", ".join(f"{s} * {k}" for k, (s, _) in HARM.items()) + ") / 4.0"
    level = f"CASE WHEN {top} > 0.8 THEN 'critical' WHEN {top} > 0.6 THEN 'high' WHEN {top} > 0.3 THEN 'medium' ELSE 'low' END"
    return {**n, "harm_score": top, "harm_level": level}


def fairness(d: Spark) -> dict[str, str]:
    """Balance of the groups of each kind (-1 where none is named) and how inclusive the language is."""
    out = {}
    for g, ps in GROUPS.items():
        c = [d.cnt("_l", p) for p in ps.values()]
        total = f"({' + '.join(c)})"
        out[f"{g}_balance"] = f"CASE WHEN {total} = 0 THEN -1.0 ELSE 1 - (greatest({', '.join(c)}) - least({', '.join(c)})) / ({total} * 1.0) END"
    inc = f"({hits(d, INCLUSIVE)} / {per(d, 100)} - {hits(d, EXCLUSIVE)} / {per(d, 100)})"
    out["inclusive"] = clamp(f"(CASE WHEN {d.size('_w')} = 0 THEN 0.0 ELSE {inc} END + 1) / 2")
    return out


def robustness(d: Spark) -> dict[str, str]:
    a, q = d.cnt("_l", ABSOLUTE), d.cnt("_l", QUALIFIED)
    balance = f"CASE WHEN {a} + {q} = 0 THEN 0.5 ELSE {q} / (({a} + {q}) * 1.0) END"
    asl = f"({d.total(d.map('_p', _words(d)))} / ({d.size('_p')} * 1.0))"
    fit = clamp(f"1 - abs({asl} - 20) / 20.0")
    div = f"least({hits(d, VIEWPOINTS)} / {per(d, 100)}, 1.0)"
    ev = f"least({hits(d, SUPPORT)} / {per(d, 100)}, 1.0)"
    return {"robustness": f"({div} + {ev} + {balance} + {fit}) / 4.0"}


def _words(d: Spark) -> str:
    return 'regexp_count(x, r"(?U)\\S+")' if d is SPARK else "len(regexp_extract_all(x, '\\S+'))"


def contradictions(d: Spark) -> dict[str, str]:
    """How many pairs of an earlier sentence with a cue and a later one with its opposite there are. Spark only; the oracle counts pairs."""
    return {"contradictions": " + ".join(d.ordered("_l", pos, neg) for pos, neg in CONTRADICTIONS)}


def review() -> dict[str, str]:
    """From the other scores: whether a person should look, and the list of issues."""
    need = f"bias_score > {BIAS_LIMIT} OR contradiction_score > {CONTRADICTION_LIMIT} OR harm_score > {HARM_LIMIT} OR harm_level = 'critical' OR robustness < 0.3"
    return {"requires_review": f"({need})"}


def issues(d: Spark) -> str:
    items = [f"CASE WHEN {k} > 0.4 THEN '{k}_detected' ELSE '' END" for k in BIAS]
    items.append("CASE WHEN contradictions > 0 THEN concat('contradictions_detected_', cast(contradictions as string)) ELSE '' END")
    items += [f"CASE WHEN {k} > 0 THEN 'harmful_content_{k}' ELSE '' END" for k in HARM]
    items.append("CASE WHEN robustness < 0.5 THEN 'low_robustness' ELSE '' END")
    return d.join(d.filter(d.array(*items), "x <> ''"), ",")


def screen(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text) with all scores, requires_review and issues."""
    out = prepare(df)
    f = {**bias(SPARK), **harm(SPARK), **robustness(SPARK), **contradictions(SPARK)}
    f["contradiction_score"] = f"({f['contradictions']}) / greatest(size(_s), 1)"
    late = ("bias_score", "harm_score", "harm_level")
    out = evaluate(out, {k: v for k, v in f.items() if k not in late})
    out = evaluate(out, {k: f[k] for k in late})
    return evaluate(out, {**review(), "issues": issues(SPARK)})


# Words that contradict each other, and the flag of documents that a person should look at.
OPPOSITES = [("true", "false"), ("correct", "incorrect"), ("right", "wrong"), ("possible", "impossible"), ("can", "cannot"), ("is", "is not"), ("are", "are not"), ("always", "never"), ("all", "none"), ("increase", "decrease"), ("rise", "fall")]
REVIEW_FLAG = "adversarial_review_required"


def severities(d: Spark) -> dict[str, str]:
    """From the columns of ``bias``: high, medium or low for each type that is found, else null."""
    return {f"{k}_severity": f"CASE WHEN {k} > 0.7 THEN 'high' WHEN {k} > 0.4 THEN 'medium' WHEN {k} > 0 THEN 'low' END" for k in BIAS}


def shares(d: Spark) -> dict[str, str]:
    """The share of each group among the mentions of its kind; null where none is mentioned."""
    out = {}
    for g, ps in GROUPS.items():
        c = {k: d.cnt("_l", p) for k, p in ps.items()}
        total = f"({' + '.join(c.values())})"
        out |= {f"{g}_{k}": f"CASE WHEN {total} > 0 THEN {x} / ({total} * 1.0) END" for k, x in c.items()}
    return out


def indicators(df: DataFrame, kinds: dict[str, tuple] | None = None, around: int = 50) -> DataFrame:
    """doc_id, kind, match, start, end and context, a row for each match of the patterns (by kind: (weight, patterns); those of bias and harm) in the lower-cased
    texts of ``df`` (doc_id, text), with ``around`` characters on either side. Spark's functions give no places of matches, so this runs in Arrow batches; automata
    tell first which texts have a match."""
    patterns = [(kind, re.compile(p), automaton(p, False)) for kind, (_, ps) in (kinds or {**BIAS, **HARM}).items() for p in ps]

    def of(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = []
        texts = [text or "" for text in p["text"]]
        lows = [text.lower() for text in texts]
        plain = Texts(pa.array(lows, pa.string()), python_table())
        for kind, pattern, quick in patterns:
            for i in range(len(lows)) if quick is None else np.flatnonzero(plain.measure("has", quick)):
                rows += [(i, kind, m.group(), m.start(), m.end(), texts[i][max(m.start() - around, 0) : m.end() + around]) for m in pattern.finditer(lows[i])]
        out = pd.DataFrame(rows, columns=["doc_id", "kind", "match", "start", "end", "context"])
        out["doc_id"] = p["doc_id"].to_numpy()[out["doc_id"].to_numpy(dtype=np.int64)]
        yield out

    return map_slices(df.select("doc_id", "text"), of, "doc_id long, kind string, match string, start int, end int, context string")


def opposed_pairs(df: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None, least: int = 15, below: float = 0.5) -> DataFrame:
    """doc_id, first, second and similarity: pairs of a text's sentences (of more than ``least`` characters) of which one has a word and the other its opposite;
    with ``embed`` only those whose vectors have a cosine under ``below``. Sentences are indexed by the words that they have, and only such pairs are made."""

    def unit(v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, dtype=float)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def of(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for d, text in zip(p["doc_id"], p["text"]):
            s = [x for part in re.split(r"[.!?]+", text or "") if len(x := part.strip()) > least]
            low = [x.lower() for x in s]
            found = [np.zeros(0, dtype=np.int64)]
            for a, b in OPPOSITES:
                with_a, with_b = (np.array([i for i, x in enumerate(low) if w in x], dtype=np.int64) for w in (a, b))
                first, second = np.minimum.outer(with_a, with_b).ravel(), np.maximum.outer(with_a, with_b).ravel()
                found.append((first * len(s) + second)[first != second])
            pairs = np.unique(np.concatenate(found))
            v = unit(embed(s)) if embed is not None and len(pairs) else None
            for at in range(0, len(pairs), 100_000):
                first, second = pairs[at : at + 100_000] // len(s), pairs[at : at + 100_000] % len(s)
                out = pd.DataFrame({"doc_id": [d] * len(first), "first": first, "second": second, "similarity": None})
                if v is not None:
                    out["similarity"] = [float(v[i] @ v[j]) for i, j in zip(first, second)]
                    out = out[out["similarity"] < below]
                rows.append(out)
                size += len(out)
                if size > 100_000:
                    yield pd.concat(rows)
                    rows, size = [], 0
        if size:
            yield pd.concat(rows)

    return map_slices(df.select("doc_id", "text"), of, "doc_id long, first int, second int, similarity double")


def classify_windows(df: DataFrame, classify: Callable[[list[str]], list[float]], size: int = 500, step: int = 400, most: int | None = None) -> DataFrame:
    """doc_id, toxicity (the largest of the windows' scores) and windows: a plugged-in classifier over windows of ``size`` characters, all of them if ``most`` is None."""

    @F.pandas_udf("toxicity double, windows int")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = []
            for t in s:
                w = [(t or "")[i : i + size] for i in range(0, max(len(t or ""), 1), step)][:most]
                rows.append((max(map(float, classify(w))), len(w)))
            yield pd.DataFrame(rows, columns=["toxicity", "windows"])

    return df.select("doc_id", of(F.col("text")).alias("x")).select("doc_id", "x.*")


def flags() -> str:
    """From requires_review: the list of flags that goes with a document."""
    return f"CASE WHEN requires_review THEN '{REVIEW_FLAG}' ELSE '' END"
