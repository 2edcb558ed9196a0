"""Counts of patterns by automata against Spark's own regular expressions, on texts with odd characters between and inside cues."""

import random

from pyspark.sql import functions as F

from textmill.functions import counts
from textmill.functions.dialect import MEASURES, SPARK, counted, doubles, evaluate, prepare
from textmill.operators import adversarial, metacognition, semantic_quality

GROUPS = [adversarial.bias, adversarial.harm, adversarial.fairness, adversarial.robustness, metacognition.confidence, metacognition.complexity, metacognition.prerequisites, metacognition.objectives, metacognition.load, metacognition.features, metacognition.reasoning_types]
WORDS = "women are naturally better at in with worse men usually less 45% 12.5% 1999 ١٩٩٩ 19٣9 is not isn't e.g. i.e. viz. dr. ph.d NASA DNA biology motion physics i think break down need to know according to studies show fake media government old people person slow disabled burden all none every always some ; : ? ! _ x y".split(" ")
ODD = [" ", " ", " ", " ", "\n", "\r", "\r\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "-", "'", "é", "ß", "́", "²", "Ⅷ", "ⓐ", "‍", "‿", "٣", "𝟗", "😀", "�", "%", "", "İ", "K", "Σ", "! ", ".", ". However ", " for example ", "on the other hand", "cries", "e ", ".", "_", "\x00"]


def formulas():
    out = {}
    for f in GROUPS:
        out |= {f"{f.__module__.split('.')[-1]}_{f.__name__}_{k}": v for k, v in f(SPARK).items() if k not in ("bias_score", "harm_score", "harm_level")}
    return out | {k: f(SPARK) for k, f in {**semantic_quality.BASE, **semantic_quality.DETAIL}.items()}


def test_counts_are_those_of_spark(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(WORDS) + rng.choice(ODD) for _ in range(rng.randrange(60)))) for i in range(400)] + [(400, None), (401, "")]
    df = prepare(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    made, texts, jobs = counted(formulas())
    assert texts == ["_l", "_t"] and len(jobs) > 100 and not any(x in sql for sql in made.values() for x in ("count(_", "(_l rlike", "(_t rlike"))
    found = df.select("doc_id", counts.counts(spark, [F.col(c) for c in texts], jobs).alias("n"))
    got = {r["doc_id"]: r["n"] for r in found.collect()}
    ours = [i for i, (_, what, _) in enumerate(jobs) if what in ("count", "has")]
    spelled = [(texts[jobs[i][0]], jobs[i][1], p) for i, p in zip(ours, originals(), strict=True)]
    want = df.select("doc_id", F.array(*[F.expr(f'cast(regexp_count({c}, r"(?U){p}") as bigint)' if what == "count" else f'cast({c} rlike r"(?U){p}" as bigint)') for c, what, p in spelled]).alias("n"))
    for r in want.collect():
        assert r["n"] == [got[r["doc_id"]][i] for i in ours]
    assert sum(x > 0 for n in got.values() for x in n) > 3000


def test_scores_are_those_of_the_formulas(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(WORDS) + rng.choice(ODD) for _ in range(rng.randrange(60)))) for i in range(300)] + [(300, None), (301, ""), (302, " "), (303, "..."), (304, "İstanbulİ E.e")]
    df = prepare(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).cache()
    plain = {k: f"({v})" for k, v in formulas().items()} | {f"m{i}": sql for i, sql in enumerate(MEASURES)}
    made = counted(plain)[0]
    assert not any(x in sql for k, sql in made.items() for x in ("(_w", "(_s", "(_p") if k != "lexical_diversity")
    got = {r["doc_id"]: r for r in evaluate(df, plain).select("doc_id", *plain).collect()}
    for r in df.select("doc_id", *[F.expr(doubles(sql)).alias(k) for k, sql in plain.items()]).collect():
        assert r.asDict() == got[r["doc_id"]].asDict()
    old = df.select("_w", "_s", F.expr(r"filter(split(_t, '(?U)\\s+'), x -> x <> '')").alias("w"), F.expr(r"filter(transform(_p, x -> regexp_replace(x, '(?U)^\\s+|\\s+$', '')), x -> x <> '')").alias("s")).collect()
    assert all(r["_w"] == r["w"] and r["_s"] == r["s"] for r in old)


def originals():
    """The patterns of the jobs as the formulas spell them, in their order."""
    import re

    seen = {}
    for sql in formulas().values():
        for m in re.finditer(r'regexp_count\((_l|_t), r"\(\?U\)([^"]*)"\)|\((_l|_t) rlike r"\(\?U\)([^"]*)"\)', sql):
            seen.setdefault((m[1] or m[3], bool(m[1]), m[2] or m[4]))
    return [p for _, _, p in seen]


def test_automaton_takes_what_it_can_count():
    assert counts.automaton(r"\b(?:is|are)\b", True) == r"\b(?:is|are)\b"
    assert counts.automaton(r"\b(?:a|b)\s+(?:at|in)", True) == r"(?:\b(?:a|b)\s+(?:at|in))\w*"
    assert counts.automaton(r"[;:]", True) == r"[;:]" and counts.automaton(r"\b(?:percent|%)\b", False) == r"\b(?:percent|%)\b"
    for p in (r"\b(?:percent|%)\b", r"is\b", r"(?<=a)b", r"\ba0\b", r"x_y", r"[^a]", r"(a)\1", r"é", r"\Bfoo", r"a*", r"^a", r"(?i)ab"):
        assert counts.automaton(p, True) is None


def test_patterns_leave_the_plan(spark):
    # before, each pattern was a regular expression of the plan, once for every place that it had in a formula
    df = spark.createDataFrame([(1, "He is old. It is not. All people are none.")], "doc_id long, text string")
    plan = evaluate(prepare(df), {**adversarial.bias(SPARK), **adversarial.contradictions(SPARK)} | {"bias_score": "0"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") == 0 and plan.count("RLIKE") == 0
    assert evaluate(prepare(df), adversarial.contradictions(SPARK)).first()["contradictions"] == 1


def test_indicators_are_those_of_python(spark):
    import re

    rng = random.Random(13)
    rows = [(i, "".join(rng.choice(WORDS) + rng.choice(ODD) for _ in range(rng.randrange(80)))) for i in range(450)] + [(None, "kill all the old people"), (451, None)]
    kinds = {"a": (1, [r"\b(?:old|disabled)\s+(?:people|person)\b", r"\b\w+ology\b", r"\b\d{4}\b", r"(?i)NASA|is"]), **adversarial.HARM}
    want = [(d, k, m.group(), m.start(), m.end()) for d, t in rows for k, (_, ps) in kinds.items() for p in ps for m in re.finditer(p, (t or "").lower())]
    got = [tuple(r)[:5] for r in adversarial.indicators(spark.createDataFrame(rows, "doc_id long, text string"), kinds).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 300
