"""Registered queries, each over its whole table, and their SQL for DuckDB.

English cue words are rare in the test tables. So that no score is 0 everywhere, queries of cue scores run on texts to which a
sentence with cues is added by the row's id, in Spark and in SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.dialect import DUCK, SPARK, Spark, doubles, duck_prepared, evaluate, prepare
from textmill.operators import adversarial, chunking, clean, dedup, knowledge, metacognition, quality, semantic_chunks, semantic_quality, stats
from textmill.plans.builder import DatasetBuilder
from textmill.shared import cut
from textmill.sources import web
from textmill.sources.tables import read_table, spread

CUES = [
    "Because research at the university shows data, experts argue that 45% of people agree; therefore the study concludes it is true.",
    "However, for example, one might think this is false. It is not correct. The report, according to statistics of 1999, is a fact.",
    "Women are naturally better at this. Old people are slow. The rich people are greedy. He said she was right, they never agree.",
    "First define the algorithm, then explain why the proof of the theorem means that the system is complex. Consider you imagine it!",
    "We should attack those, since violence is necessary. Bomb threats rise and fall. Everyone knows that vaccines cause cancer.",
    "The market strategy of the empire in 1850 was moral. Compare and evaluate, design and apply what you list. Is it? Always, or sometimes.",
    "The CEO and the professor published a journal article. NASA made a well-known dis-covery of biology, statistics and motion in 1969.",
    "All people regardless of age are equal; some argue the opposite. Young children and elderly adults increase while others decrease.",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def cued(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = F.element_at(F.array(*[F.lit(c) for c in CUES]), (F.pmod("doc_id", F.lit(len(CUES))) + 1).cast("int"))
    return documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), cue))


DUCK_CUED = "(SELECT * REPLACE (text || ' ' || [" + ", ".join("'" + c.replace("'", "''") + "'" for c in CUES) + f"][(doc_id % {len(CUES)}) + 1] AS text) FROM documents)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = doubles(sql)
        return f

    return add


def formula_query(name: str, formulas: Callable[[Spark], dict[str, str]], text: set[str] = frozenset()) -> None:
    """A query of formulas over cued documents and the same in DuckDB; numbers are rounded to six places."""
    names = list(formulas(SPARK))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate(prepare(cued(spark, sf_dir)), formulas(SPARK))
        return out.select("doc_id", *[F.col(n) if n in text else F.round(F.col(n).cast("double"), 9).alias(n) for n in names])

    inner = ", ".join(f"{sql} AS {n}" for n, sql in formulas(DUCK).items())
    outer = ", ".join(n if n in text else f"round(CAST({n} AS DOUBLE), 9) AS {n}" for n in names)
    query(name, f"SELECT doc_id, {outer} FROM (SELECT doc_id, {inner} FROM {duck_prepared(DUCK_CUED)})")(run)


for _k, _f in {**semantic_quality.BASE, **semantic_quality.DETAIL}.items():
    formula_query(f"semantic_{_k}", lambda d, k=_k, f=_f: {k: f(d)})


def _semantic_overall_sql() -> str:
    inner = ", ".join(f"{f(DUCK)} AS {k}" for k, f in {**semantic_quality.BASE, **semantic_quality.DETAIL}.items())
    return f"SELECT doc_id, round({semantic_quality.overall()}, 9) AS overall, round({semantic_quality.training_value()}, 9) AS training_value FROM (SELECT doc_id, {inner} FROM {duck_prepared(DUCK_CUED)})"


@query("semantic_overall", _semantic_overall_sql())
def semantic_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_quality.score(cued(spark, sf_dir)).select("doc_id", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in ("overall", "training_value")])


formula_query("metacog_confidence", metacognition.confidence)
formula_query("metacog_complexity", metacognition.complexity)
formula_query("metacog_prerequisites", metacognition.prerequisites)
formula_query("metacog_objectives", metacognition.objectives)
formula_query("metacog_cognitive_load", metacognition.load)
formula_query("metacog_reading", lambda d: {"reading": metacognition.reading(d)})
formula_query("metacog_features", metacognition.features, {*metacognition.FEATURES, "scaffolding", "engagement"})
formula_query("metacog_reasoning_types", metacognition.reasoning_types, {"reasoning_types"})
formula_query("metacog_implicit_confidence", metacognition.implicit_confidence)
formula_query("metacog_factors", metacognition.factors)
formula_query("chunk_complexity", lambda d: {"complexity": semantic_chunks.complexity(d)})
formula_query("adversarial_fairness", adversarial.fairness)
formula_query("adversarial_shares", adversarial.shares)
formula_query("adversarial_robustness", adversarial.robustness)


def _scores(d: Spark) -> dict[str, dict[str, str]]:
    return {"bias": adversarial.bias(d), "harm": adversarial.harm(d)}


def _layered(kind: str, last: tuple[str, ...]) -> None:
    """Formulas whose last ones use the first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = _scores(SPARK)[kind]
        out = evaluate(prepare(cued(spark, sf_dir)), {k: v for k, v in f.items() if k not in last})
        out = evaluate(out, {k: f[k] for k in last})
        return out.select("doc_id", *[F.col(k) if k == "harm_level" else F.round(F.col(k).cast("double"), 9).alias(k) for k in f])

    f = _scores(DUCK)[kind]
    inner = ", ".join(f"{v} AS {k}" for k, v in f.items() if k not in last)
    more = ", ".join(f"{f[k]} AS {k}" for k in last)
    outer = ", ".join(k if k == "harm_level" else f"round(CAST({k} AS DOUBLE), 9) AS {k}" for k in f)
    query(f"adversarial_{kind}", f"SELECT doc_id, {outer} FROM (SELECT *, {more} FROM (SELECT doc_id, {inner} FROM {duck_prepared(DUCK_CUED)}))")(run)


_layered("bias", ("bias_score",))
_layered("harm", ("harm_score", "harm_level"))

def _later(name: str, first: Callable[[Spark], dict[str, str]], then: Callable[[Spark], dict[str, str]]) -> None:
    """Texts that formulas make of the columns of others."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(evaluate(prepare(cued(spark, sf_dir)), first(SPARK)), then(SPARK)).select("doc_id", *then(SPARK))

    inner = ", ".join(f"{v} AS {k}" for k, v in first(DUCK).items())
    outer = ", ".join(f"{v} AS {k}" for k, v in then(DUCK).items())
    query(name, f"SELECT doc_id, {outer} FROM (SELECT doc_id, {inner} FROM {duck_prepared(DUCK_CUED)})")(run)


_later("metacog_ranked_prerequisites", metacognition.prerequisites, metacognition.ranked_prerequisites)
_later("adversarial_severities", lambda d: {k: v for k, v in adversarial.bias(d).items() if k != "bias_score"}, adversarial.severities)


@query("metacog_objectives_table", "SELECT doc_id, level, bloom, round(strength, 9) AS strength FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS level, {metacognition.BLOOM_NUMBERS[k]} AS bloom, CAST({DUCK.cnt('_l', p)} AS DOUBLE) / greatest(len(_w) / 100.0, 1.0) AS strength FROM {duck_prepared(DUCK_CUED)}" for k, p in metacognition.BLOOM.items()) + ") WHERE strength > 0")
def metacog_objectives_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metacognition.objectives_table(cued(spark, sf_dir)).select("doc_id", "level", "bloom", F.round("strength", 9).alias("strength"))


@query("adversarial_indicators", "SELECT doc_id, kind, match, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(_la, '{DUCK._q(p)}')) AS match FROM {duck_prepared(DUCK_CUED)}" for k, (_, ps) in {**adversarial.BIAS, **adversarial.HARM}.items() for p in ps) + ") GROUP BY ALL")
def adversarial_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adversarial.indicators(cued(spark, sf_dir)).groupBy("doc_id", "kind", "match").agg(F.count("*").alias("n"))


_OPPOSITES = ", ".join(f"('{a}', '{b}')" for a, b in adversarial.OPPOSITES)


@query("adversarial_opposites", f"""WITH p AS (SELECT doc_id, list_filter(_s, lambda x: length(x) > 15) AS s FROM {duck_prepared(DUCK_CUED)}), u AS (SELECT doc_id, unnest(range(len(s))) AS i, lower(unnest(s)) AS x FROM p),
  o AS (SELECT * FROM (VALUES {_OPPOSITES}) AS v(pos, neg)), a AS (SELECT doc_id, i, pos FROM u, o WHERE contains(x, pos)), b AS (SELECT doc_id, i, pos FROM u, o WHERE contains(x, neg))
  SELECT DISTINCT a.doc_id, least(a.i, b.i) AS first, greatest(a.i, b.i) AS second FROM a JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.i <> b.i""")
def adversarial_opposites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adversarial.opposed_pairs(cued(spark, sf_dir)).select("doc_id", F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"))


_PAIRS = " UNION ALL ".join(
    f"SELECT doc_id, i, {k} AS k, {DUCK.has('x', p)} AS pos, {DUCK.has('x', n)} AS neg FROM s" for k, (p, n) in enumerate(adversarial.CONTRADICTIONS)
)
_CONTRA = f"""WITH p AS (SELECT doc_id, _s FROM {duck_prepared(DUCK_CUED)}), s AS (SELECT doc_id, unnest(range(len(_s))) AS i, lower(unnest(_s)) AS x FROM p),
  c AS ({_PAIRS}), n AS (SELECT a.doc_id, count(*) AS n FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i AND a.pos AND b.neg GROUP BY 1)"""


@query("adversarial_contradictions", f"{_CONTRA} SELECT p.doc_id, coalesce(n, 0) AS contradictions, round(coalesce(n, 0) / greatest(len(_s), 1), 9) AS contradiction_score FROM p LEFT JOIN n ON p.doc_id = n.doc_id")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate(prepare(cued(spark, sf_dir)), adversarial.contradictions(SPARK))
    return out.select("doc_id", "contradictions", F.round(F.col("contradictions") / F.greatest(F.size("_s"), F.lit(1)), 9).alias("contradiction_score"))


def _review_sql() -> str:
    f = {**adversarial.bias(DUCK), **adversarial.harm(DUCK), **adversarial.robustness(DUCK)}
    late = ("bias_score", "harm_score", "harm_level")
    inner = ", ".join(f"{v} AS {k}" for k, v in f.items() if k not in late)
    more = ", ".join(f"{f[k]} AS {k}" for k in late)
    return f"""{_CONTRA}, d AS (SELECT doc_id, _s, {inner} FROM {duck_prepared(DUCK_CUED)}),
      e AS (SELECT d.*, {more}, coalesce(n, 0) AS contradictions, coalesce(n, 0) / greatest(len(d._s), 1) AS contradiction_score FROM d LEFT JOIN n ON d.doc_id = n.doc_id)
      SELECT doc_id, {adversarial.review()['requires_review']} AS requires_review, {adversarial.issues(DUCK)} AS issues FROM e"""


@query("adversarial_review", _review_sql())
def adversarial_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adversarial.screen(cued(spark, sf_dir)).select("doc_id", "requires_review", "issues")


@query("adversarial_flags", f"SELECT doc_id, CASE WHEN requires_review THEN '{adversarial.REVIEW_FLAG}' ELSE '' END AS flags FROM ({_review_sql()})")
def adversarial_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(adversarial.screen(cued(spark, sf_dir)), {"flags": adversarial.flags()}).select("doc_id", "flags")


# --- cleaning and personal data

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', '', 'g'), '\S+@\S+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("clean_text", f"SELECT doc_id, {_CLEAN.format(t='text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_documents(documents(spark, sf_dir)).select("doc_id", "text")


@query("clean_pages", f"SELECT page_id, {_CLEAN.format(t='html')} AS text FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", clean.clean(F.col("html")).alias("text"))


_EXTRA = " Call 555-123-4567 or id 1234567890, SSN 123-45-6789, card 4111 1111 1111 1111, host 10.0.0.1, mail a.b@c.org"


def _sql_redact(text: str, to: Callable[[str], str]) -> str:
    for kind, p in clean.PII.items():
        text = f"regexp_replace({text}, '{p}', '{to(kind)}', 'g')"
    return text


@query("pii_mask", f"SELECT doc_id, {_sql_redact(f'''text || '{_EXTRA}' ''', lambda k: f'[{k}]')} AS text FROM documents")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", clean.redact(F.concat("text", F.lit(_EXTRA))).alias("text"))


@query("pii_remove", f"SELECT doc_id, {_sql_redact('text', lambda k: '')} AS text FROM documents")
def pii_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", clean.redact(F.col("text"), "remove").alias("text"))


def _sql_hash(text: str) -> str:
    """Parts between matches and digests of the matches in turn, kind by kind."""
    for kind, p in clean.PII.items():
        text = f"(SELECT array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || CASE WHEN i <= len(m) THEN '[{kind}_' || sha256(m[i])[1:8] || ']' ELSE '' END), '') FROM (SELECT string_split_regex(t, '{p}') AS a, regexp_extract_all(t, '{p}') AS m FROM (SELECT {text} AS t)))"
    return text


@query("pii_hash", f"SELECT doc_id, {_sql_hash(f"text || '{_EXTRA} {_EXTRA}'")} AS text FROM documents")
def pii_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", clean.redact(F.concat("text", F.lit(f"{_EXTRA} {_EXTRA}")), "hash").alias("text"))


@query("pii_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k.lower()}" for k, p in clean.PII.items()) + " FROM documents")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *clean.pii_counts(F.col("text")))


@query("pii_conversations", f"SELECT conv_id, turn, {_sql_redact('text', lambda k: f'[{k}]')} AS text FROM conversations")
def pii_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", clean.redact(F.col("text")).alias("text"))


# --- quality

_REP = lambda source: f"""r AS (SELECT doc_id, CASE WHEN len(w) < 10 THEN 0.0 ELSE list_sum(list_transform(range(1, len(w) - 5), lambda i: CASE WHEN contains(array_to_string(w[i + 3:], ' '), array_to_string(w[i:i + 2], ' ')) THEN 1 ELSE 0 END)) / greatest(len(w) - 3, 1) END AS _rep
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {source}))"""  # noqa: E731
_SCORED = lambda source: f"{_REP(source)}, q AS (SELECT d.doc_id, _rep, {quality.basic(DUCK)} AS quality_score FROM {duck_prepared(source)} d JOIN r ON d.doc_id = r.doc_id)"
_BASIC = f"WITH {_SCORED('documents')}"


@query("basic_quality", f"{_BASIC} SELECT doc_id, round(_rep, 9) AS repetition_ratio, round(quality_score, 9) AS quality_score FROM q")
def basic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir)).select("doc_id", F.round("repetition_ratio", 9).alias("repetition_ratio"), F.round("quality_score", 9).alias("quality_score"))


@query("quality_filter", f"{_BASIC} SELECT q.doc_id FROM q JOIN documents USING (doc_id) WHERE quality_score >= 0.9 AND lang IN ('en', 'de')")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(documents(spark, sf_dir), 0.9, ["en", "de"]).select("doc_id")


def _stop_words_sql() -> str:
    n = {k: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)})))" for k, ws in quality.STOP_WORDS.items()}
    cols = ", ".join(f"{v} AS n_{k}" for k, v in n.items())
    top = f"greatest({', '.join(f'n_{k}' for k in n)})"
    return f"SELECT doc_id, CASE WHEN {top} = 0 THEN 'unknown' {' '.join(f"WHEN n_{k} = {top} THEN '{k}'" for k in n)} END AS language FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents))"


@query("detect_language", _stop_words_sql())
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", quality.detect_language(F.col("text")).alias("language"))


# --- chunking

_W = "(SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"


@query("chunk_fixed", f"SELECT doc_id, i AS start_index, least(i + 64, len(w)) AS end_index, array_to_string(w[i + 1:i + 64], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS i FROM {_W}) WHERE length(array_to_string(w[i + 1:i + 64], ' ')) >= 100")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.explode_chunks(chunking.chunk(documents(spark, sf_dir), "fixed", 64))
    return c.select("doc_id", "start_index", "end_index", "text")


@query("chunk_sliding", f"""SELECT doc_id, i AS start_index, least(i + 64, len(w)) AS end_index, CASE WHEN i = 0 THEN 0 ELSE 8 END AS overlap_prev, CASE WHEN i + 64 >= len(w) THEN 0 ELSE 8 END AS overlap_next,
  array_to_string(w[i + 1:i + 64], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 56)) AS i FROM {_W}) WHERE (i = 0 OR i - 56 + 64 < len(w)) AND length(array_to_string(w[i + 1:i + 64], ' ')) >= 100""")
def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.explode_chunks(chunking.chunk(documents(spark, sf_dir), "sliding_window", 64, 8))
    return c.select("doc_id", "start_index", "end_index", "overlap_prev", "overlap_next", "text")


def _pack_sql(source: str, key: str, split: str, sep: str, size: int) -> str:
    """Greedy packing as a recursion over the parts."""
    return f"""WITH RECURSIVE p AS (SELECT {key}, unnest(range(len(a))) AS i, unnest(a) AS x, len(a) AS m FROM (SELECT {key}, regexp_split_to_array(text, '{split}') AS a FROM {source})),
      q AS (SELECT {key}, i, x, m, len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) AS k FROM p),
      g AS (SELECT {key}, i, m, k AS n, 0 AS c FROM q WHERE i = 0 UNION ALL
            SELECT q.{key}, q.i, q.m, CASE WHEN g.n + q.k > {size} THEN q.k ELSE g.n + q.k END, CASE WHEN g.n + q.k > {size} THEN g.c + 1 ELSE g.c END FROM g JOIN q ON q.{key} = g.{key} AND q.i = g.i + 1)
      SELECT {key}, text, parts, word_count FROM (SELECT g.{key}, g.c, string_agg(q.x, {sep} ORDER BY q.i) AS text, count(*) AS parts, CAST(sum(q.k) AS BIGINT) AS word_count, max(g.i) + 1 = max(g.m) AS last
        FROM g JOIN q ON q.{key} = g.{key} AND q.i = g.i GROUP BY g.{key}, g.c) WHERE NOT last OR length(text) >= 100"""


@query("chunk_sentence", _pack_sql("documents", "doc_id", "[.!?]+", "' '", 40))
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.explode_chunks(chunking.chunk(documents(spark, sf_dir), "sentence", 40))
    return c.select("doc_id", "text", F.col("parts").cast("long").alias("parts"), F.col("word_count").cast("long").alias("word_count"))


_CONV = "(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def conversations_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return t.select("conv_id", F.array_join("t.text", "\n\n").alias("text"))


@query("chunk_paragraph", _pack_sql(_CONV, "conv_id", "\\n\\n+", "chr(10) || chr(10)", 60))
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.explode_chunks(chunking.chunk(conversations_text(spark, sf_dir), "paragraph", 60), "conv_id")
    return c.select("conv_id", "text", F.col("parts").cast("long").alias("parts"), F.col("word_count").cast("long").alias("word_count"))


@query("chunk_sections")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_chunks(chunking.chunk(documents(spark, sf_dir), "sections", 64)).select("doc_id", "chunk_ix", "text", "word_count")


@query("chunk_rule_sections")
def chunk_rule_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_chunks(chunking.chunk(conversations_text(spark, sf_dir), "semantic"), "conv_id").select("conv_id", "chunk_ix", "text", "word_count", "type", "semantic_type")


_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(DUCK.contains('lower(text)', w) for w in ws)} THEN '{k}'" for k, ws in chunking.KINDS.items()) + " ELSE 'general' END"


@query("semantic_type", f"SELECT doc_id, {_KIND} AS semantic_type FROM {DUCK_CUED}")
def semantic_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cued(spark, sf_dir).select("doc_id", chunking.kind_of(F.col("text")).alias("semantic_type"))


@query("chunk_totals", f"SELECT (SELECT count(*) FROM documents) AS total_documents, count(*) AS total_chunks FROM ({ORACLE_SQL['chunk_fixed']})")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(chunking.chunk(documents(spark, sf_dir), "fixed", 64)).select("total_documents", "total_chunks")


@query("sentences", r"SELECT doc_id, i, s FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents))")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(semantic_chunks.sentences(F.col("text"))).alias("i", "s")).select("doc_id", F.col("i").cast("long").alias("i"), "s")


@query("semantic_chunks")
def semantic_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semantic_chunks.semantic_chunks(cued(spark, sf_dir), semantic_chunks.hashed_words())
    return out.select("doc_id", "chunk_ix", "text", "word_count", "start_sentence", "end_sentence", "semantic_type", F.round("complexity", 9).alias("complexity"), F.round("coherence", 9).alias("coherence"), F.size("chains").alias("n_chains"), F.size("arguments").alias("n_arguments"))


# --- de-duplication

@query("dedup_documents", "SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents GROUP BY text")
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_documents(documents(spark, sf_dir), ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("dedup_chunks", f"""SELECT doc_id, start_index, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, start_index) AS n FROM ({ORACLE_SQL['chunk_fixed']})) WHERE n = 1""")
def dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_chunks(chunk_fixed(spark, sf_dir), ["doc_id", "start_index"]).select("doc_id", "start_index", "text")


@query("similar_pairs")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(read_table(spark, sf_dir, "conversations").select((F.shiftleft("conv_id", 32) + F.col("turn")).alias("k"), "text"), "k")


@query("dedup_similar")
def dedup_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_similar(read_table(spark, sf_dir, "conversations").select((F.shiftleft("conv_id", 32) + F.col("turn")).alias("k"), "text"), "k").select("k", F.md5(F.col("text").cast("binary")).alias("md5"))


# --- knowledge

def _concepts_sql() -> str:
    # terms are found as runs of word characters, since DuckDB's classes are ASCII
    w = r"[\p{L}\p{N}_]"
    pats = [rf"{w}+", rf"{w}+(?:-{w}+)+", rf"{w}+"]
    tests = [r"regexp_full_match(x, '[A-Z]{2,}')", "true", rf"regexp_full_match(x, '{w}+(?:ology|ometry|ics|tion|sion)')"]
    return " UNION ALL ".join(f"SELECT doc_id, {i} AS pattern, x AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS x FROM {DUCK_CUED}) WHERE {t} AND length(x) > 3" for i, (p, t) in enumerate(zip(pats, tests)))


@query("domain_concepts", f"SELECT doc_id, pattern, term, count(*) AS n FROM ({_concepts_sql()}) GROUP BY ALL")
def domain_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.concepts(cued(spark, sf_dir)).groupBy("doc_id", "pattern", "term").agg(F.count("*").alias("n"))


@query("facts", f"""SELECT doc_id, statement, round({knowledge.fact_confidence(DUCK, 'x')}, 9) AS confidence, {knowledge.fact_type(DUCK, 'x')} AS fact_type FROM (SELECT doc_id, statement, lower(statement) AS x
  FROM (SELECT doc_id, unnest(_s) AS statement FROM {duck_prepared(DUCK_CUED)}) WHERE length(statement) >= 20) WHERE {knowledge.fact_confidence(DUCK, 'x')} > 0.5""")
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.facts(prepare(cued(spark, sf_dir))).select("doc_id", "statement", F.round(F.col("confidence").cast("double"), 9).alias("confidence"), "fact_type")


NAMES = ["Doctor Jane Smith met the Acme Company in New York. Later Jane Smith left New York, and so did Acme.", "The Blue River College is near Old Town. Old Town likes the Blue River College. Jane Smith was never there.", "No names are here."]


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.element_at(F.array(*[F.lit(c) for c in NAMES]), (F.pmod("doc_id", F.lit(len(NAMES))) + 1).cast("int"))
    return cued(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), more))


_NAMED = f"(SELECT * REPLACE (text || ' ' || [{', '.join(repr(x) for x in NAMES)}][(doc_id % {len(NAMES)}) + 1] AS text) FROM {DUCK_CUED})"
_ENTITIES = rf"""f AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS e FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)+)', 1) AS a FROM {_NAMED})),
  g AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS ix FROM f GROUP BY doc_id, e), ents AS (SELECT doc_id, min(ix) AS ix, arg_min(e, ix) AS entity FROM g GROUP BY doc_id, lower(e)),
  sents AS (SELECT doc_id, unnest(range(len(_p))) AS sentence_ix, unnest(_p) AS x FROM {duck_prepared(_NAMED)}),
  rels AS (SELECT s.doc_id, s.sentence_ix, a.entity AS subject, b.entity AS object FROM sents s JOIN ents a ON a.doc_id = s.doc_id AND contains(s.x, a.entity) JOIN ents b ON b.doc_id = s.doc_id AND contains(s.x, b.entity) AND a.ix < b.ix)"""


@query("kg_entities", f"WITH {_ENTITIES} SELECT doc_id, ix, entity, 'other' AS entity_type FROM ents")
def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knowledge.analyse_entities(knowledge.merge_entities(knowledge.entities(named(spark, sf_dir))))
    return found.select("doc_id", F.col("ix").cast("long").alias("ix"), "entity", "entity_type")


@query("kg_relations", f"WITH {_ENTITIES} SELECT doc_id, sentence_ix, subject, 'co_occurs_with' AS predicate, object, 0.3 AS confidence FROM rels")
def kg_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = named(spark, sf_dir)
    out = knowledge.cooccurrence(prepare(d), knowledge.merge_entities(knowledge.entities(d)))
    return out.select("doc_id", F.col("sentence_ix").cast("long").alias("sentence_ix"), "subject", "predicate", "object", "confidence")


@query("kg_confidence", f"""WITH {_ENTITIES}, facts AS ({ORACLE_SQL['facts'].replace(DUCK_CUED, _NAMED)}), m AS (SELECT doc_id, 0.5 AS m FROM ents GROUP BY 1 UNION ALL SELECT doc_id, 0.3 FROM rels GROUP BY 1 UNION ALL SELECT doc_id, avg(confidence) FROM facts GROUP BY 1)
  SELECT d.doc_id, round(coalesce(avg(m), 0.5), 6) AS confidence_score FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id""")
def kg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.knowledge_graph(named(spark, sf_dir)).select("doc_id", F.round("confidence_score", 6).alias("confidence_score"))


# --- web

@query("page_titles", r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query("page_hosts", r"SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"))


@query("page_hrefs", r"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link)\b[^>]*?\bhref="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def page_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.explode(web.hrefs(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


_BLOCKED = ["blog.tionsh.example.net", "thther.example.org", "blog.tiontion.example.com"]


@query("page_domain_filter", f"SELECT page_id FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) NOT IN ({', '.join(repr(h) for h in _BLOCKED)})")
def page_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.domain_filter(read_table(spark, sf_dir, "pages"), blocked=_BLOCKED).select("page_id")


@query("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.parse_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "title", "language", F.size("links").alias("n_links"))


# --- statistics

def _stat_sql(c: str, name: str) -> str:
    return f"coalesce(avg({c}), 0) AS {name}_mean, coalesce(median({c}), 0) AS {name}_median, coalesce(CAST(min({c}) AS DOUBLE), 0) AS {name}_min, coalesce(CAST(max({c}) AS DOUBLE), 0) AS {name}_max, CAST(coalesce(sum({c}), 0) AS BIGINT) AS {name}_total"


@query("dataset_summary", f"SELECT count(*) AS total_documents, CAST(coalesce(sum(c), 0) AS BIGINT) AS total_text_length, {_stat_sql('c', 'text_length')}, {_stat_sql('k', 'word_count')} FROM (SELECT length(text) AS c, len(w) AS k FROM (SELECT text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(documents(spark, sf_dir))


@query("vocabulary", "SELECT count(DISTINCT x) AS vocabulary_size, count(*) AS total_words FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS x FROM documents)")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vocabulary(documents(spark, sf_dir))


@query("language_counts", "SELECT lang, count(*) AS documents FROM documents GROUP BY lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts_by(documents(spark, sf_dir), "lang")


@query("source_counts", "SELECT source, count(*) AS documents FROM documents GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts_by(documents(spark, sf_dir), "source")


@query("quality_stats", f"{_BASIC} SELECT round(avg(quality_score), 9) AS mean, round(median(quality_score), 9) AS median, round(min(quality_score), 9) AS min, round(max(quality_score), 9) AS max, round(stddev_samp(quality_score), 9) AS stdev FROM q")
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.score_stats(quality.score(documents(spark, sf_dir)))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query("preview_metrics", """SELECT round(avg(q), 4) AS avg_quality, min(n) AS min_length, max(n) AS max_length, avg(n) AS avg_length, count(*) FILTER (q >= 0.8) AS excellent, count(*) FILTER (q >= 0.6 AND q < 0.8) AS good,
  count(*) FILTER (q >= 0.4 AND q < 0.6) AS fair, count(*) FILTER (q < 0.4) AS poor FROM (SELECT length(text) AS n, round(least(length(text) / 1000, 1.0) * CASE WHEN length(text) < 50 THEN 0.5 ELSE 1.0 END, 2) AS q FROM documents)""")
def preview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.preview_metrics(documents(spark, sf_dir))


@query("preview_recommendations", f"""SELECT total, CASE WHEN avg_quality < 0.6 THEN 'Quality is low: add documents with more content.|' ELSE '' END || CASE WHEN avg_length < 100 THEN 'Texts are very short: use larger chunks.|' ELSE '' END
  || CASE WHEN avg_length > 2000 THEN 'Texts are very long: use smaller chunks.|' ELSE '' END || 'There are no labels: add some for supervised tasks.' AS recommendations FROM (SELECT *, excellent + good + fair + poor AS total FROM ({ORACLE_SQL['preview_metrics']}))""")
def preview_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recommendations(stats.preview_metrics(documents(spark, sf_dir))).select((F.col("excellent") + F.col("good") + F.col("fair") + F.col("poor")).alias("total"), F.array_join("recommendations", "|").alias("recommendations"))


# --- sources of several kinds, and windows

@query("union_of_sources", "SELECT id, source, source_kind, url, text FROM (SELECT CAST(doc_id AS VARCHAR) AS id, source, 'table' AS source_kind, NULL AS url, md5(text) AS text FROM documents UNION ALL SELECT md5(html) AS id, 'pages', 'table', url, md5(html) FROM pages)")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(F.md5(F.col("html").cast("binary")).alias("id"), "url", F.col("html").alias("text"))
    rows = DatasetBuilder(spark).add_table(documents(spark, sf_dir), "documents").add_table(pages, "pages").rows()
    return rows.select("id", "source", "source_kind", "url", F.md5(F.col("text").cast("binary")).alias("text"))


@query("first_turns", "SELECT conv_id, turn, md5(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of_each(read_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"))


# --- the flagship: clean, filter, redact, chunk, de-duplicate and count

_CLEANED = f"(SELECT doc_id, lang, {_CLEAN.format(t='text')} AS text FROM documents)"
_FLAGSHIP = f"""WITH {_SCORED(_CLEANED)}, d AS (SELECT q.doc_id, lang, quality_score, {_sql_redact('text', lambda k: f'[{k}]')} AS text FROM q JOIN {_CLEANED} c ON c.doc_id = q.doc_id WHERE quality_score >= 0.7),
  w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM d),
  c AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 64], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w), 56)) AS i FROM w) WHERE (i = 0 OR i - 56 + 64 < len(w)) AND length(array_to_string(w[i + 1:i + 64], ' ')) >= 100),
  k AS (SELECT doc_id, count(*) AS chunks FROM (SELECT arg_min(doc_id, doc_id) AS doc_id FROM c GROUP BY t) GROUP BY doc_id)
  SELECT lang, count(*) AS documents, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks, round(avg(quality_score), 9) AS mean_quality FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY lang"""


@query("dataset_by_language", _FLAGSHIP)
def dataset_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = clean.clean_documents(documents(spark, sf_dir), clean.CleanConfig(fix_unicode=False))
    d = quality.quality_filter(d, 0.7).select("doc_id", "lang", "quality_score", clean.redact(F.col("text")).alias("text"))
    d = cut(d, "cleaned")  # both branches read it
    c = chunking.explode_chunks(chunking.chunk(d, "sliding_window", 64, 8)).select("doc_id", "chunk_ix", F.md5(F.col("text").cast("binary")).alias("h"))
    first = c.groupBy("h").agg(F.min(F.struct("doc_id", "chunk_ix")).alias("f"))  # hashes and keys alone are shuffled
    kept = first.groupBy(F.col("f.doc_id").alias("doc_id")).agg(F.count("*").alias("chunks"))
    out = d.select("doc_id", "lang", "quality_score").join(kept, "doc_id", "left").groupBy("lang")
    return out.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.round(F.avg("quality_score"), 9).alias("mean_quality"))


# --- vectors

_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query("cosine_adjacent", f"SELECT a.vec_id, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("vec_id", F.round(dot("v", "u") / F.sqrt(dot("v", "v") * dot("u", "u")), 9).alias("cosine"))
