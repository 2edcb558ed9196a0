"""Score formulas are SQL expressions over prepared text columns. A dialect renders the few functions that differ between engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import counts


class Spark:
    """Catalyst; regular expressions with Unicode classes, as text of any language needs."""

    def cnt(self, col: str, pattern: str) -> str:
        return f'regexp_count({col}, r"(?U){pattern}")'

    def has(self, col: str, pattern: str) -> str:
        return f'({col} rlike r"(?U){pattern}")'

    def ordered(self, col: str, first: str, then: str) -> str:
        """How many pairs of a sentence with the first pattern and a later one with the second a text has; for ``evaluate`` only."""
        return f'ordered_pairs({col}, r"(?U){first}", r"(?U){then}")'

    def size(self, arr: str) -> str:
        return f"size({arr})"

    def filter(self, arr: str, cond: str) -> str:
        return f"filter({arr}, x -> {cond})"

    def map(self, arr: str, expr: str) -> str:
        return f"transform({arr}, x -> {expr})"

    def distinct(self, arr: str) -> str:
        return f"array_distinct({arr})"

    def join(self, arr: str, sep: str = "") -> str:
        return f"array_join({arr}, '{sep}')"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def total(self, arr: str) -> str:
        return f"aggregate({arr}, 0, (a, x) -> a + x)"

    def contains(self, col: str, word: str) -> str:
        return f"contains({col}, '{word}')"


class Duck(Spark):
    """DuckDB, the engine of the tests' oracle. Its classes are ASCII, so patterns run on a text with ``x`` for each letter beyond (columns _la and _ta)."""

    def cnt(self, col: str, pattern: str) -> str:
        return f"len(regexp_extract_all({self._a(col)}, '{self._q(pattern)}'))"

    def has(self, col: str, pattern: str) -> str:
        return f"regexp_matches({self._a(col)}, '{self._q(pattern)}')"

    def _q(self, pattern: str) -> str:
        return pattern.replace("'", "''")

    def _a(self, col: str) -> str:
        return {"_l": "_la", "_t": "_ta"}.get(col) or f"regexp_replace({col}, '[^\\x00-\\x7F]', 'x', 'g')"

    def size(self, arr: str) -> str:
        return f"len({arr})"

    def filter(self, arr: str, cond: str) -> str:
        return f"list_filter({arr}, lambda x: {cond})"

    def map(self, arr: str, expr: str) -> str:
        return f"list_transform({arr}, lambda x: {expr})"

    def distinct(self, arr: str) -> str:
        return f"list_distinct({arr})"

    def join(self, arr: str, sep: str = "") -> str:
        return f"array_to_string({arr}, '{sep}')"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def total(self, arr: str) -> str:
        return f"coalesce(list_sum({arr}), 0)"


SPARK, DUCK = Spark(), Duck()


#: What Java's Unicode class of white space has.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def prepare(df: DataFrame) -> DataFrame:
    """Columns that formulas use: _t text, _l lower case, _w words, _p parts between sentence ends, _s trimmed parts that are not empty. A null text is empty."""
    t = F.coalesce("text", F.lit(""))
    out = df.withColumn("_t", t).withColumn("_l", F.lower("_t"))
    out = out.withColumn("_w", F.expr(r"array_remove(split(_t, '(?U)\\s+'), '')"))
    out = out.withColumn("_p", F.expr("split(_t, '[.!?]+')"))
    return out.withColumn("_s", F.array_remove(F.transform("_p", lambda x: F.btrim(x, F.lit(SPACES))), ""))


def duck_prepared(source: str, keep: str = "doc_id") -> str:
    """The same columns as ``prepare`` makes, as a DuckDB subquery over ``source`` (a table or subquery with ``text``)."""
    return f"""(SELECT *, regexp_replace(_l, '[^\\x00-\\x7F]', 'x', 'g') AS _la, regexp_replace(_t, '[^\\x00-\\x7F]', 'x', 'g') AS _ta,
      list_filter(list_transform(_p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS _s
      FROM (SELECT {keep}, coalesce(text, '') AS _t, lower(coalesce(text, '')) AS _l, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS _w,
      regexp_split_to_array(coalesce(text, ''), '[.!?]+') AS _p FROM {source}))"""


def doubles(sql: str) -> str:
    """Decimal literals as doubles, in which scores are computed in either engine."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


_CALLS = re.compile(r'regexp_count\((_l|_t), r"\(\?U\)([^"]*)"\)|\((_l|_t) rlike r"\(\?U\)([^"]*)"\)|ordered_pairs\((_l|_t), r"\(\?U\)([^"]*)", r"\(\?U\)([^"]*)"\)')
_IN_SENTENCES = re.compile(r"size\(filter\(_s, x -> contains\(lower\(x\), '([A-Za-z ]+)'\)\)\)")
_N_WORDS = r'regexp_count(x, r"(?U)\S+")'
#: Expressions over the words and sentences of a prepared text, and the measure that is the same: of the text itself if it counts characters, which lower-casing
#: can add to, else of the lower-cased one.
MEASURES = {
    SPARK.size(SPARK.distinct(SPARK.map("_w", "lower(x)"))): "different",
    SPARK.total(SPARK.map("_p", _N_WORDS)): "part_words",
    SPARK.total(SPARK.map("_s", _N_WORDS)): "part_words",
    SPARK.size(SPARK.filter("_s", f"{_N_WORDS} > 20")): "long_sentences",
    SPARK.size(SPARK.filter("_w", "length(x) > 6")): "long_words",
    f"length({SPARK.join('_w')})": "letters",
    SPARK.size("_w"): "words",
    SPARK.size("_s"): "sentences",
    SPARK.size("_p"): "ends",
}


def counted(formulas: dict[str, str]) -> tuple[dict[str, str], list[str], list[tuple[int, str, tuple[str, ...]]]]:
    """``formulas`` with places of the array _n where they measure whole texts, each once, and what _n is made of."""
    texts: list[str] = []
    jobs: dict[tuple[int, str, tuple[str, ...]], int] = {}

    def job(col: str, what: str, *more: str) -> str:
        if col not in texts:
            texts.append(col)
        return f"_n[{jobs.setdefault((texts.index(col), what, more), len(jobs))}]"

    def place(m: re.Match) -> str:
        what = "count" if m[1] else "has" if m[3] else "ordered"
        made = [counts.automaton(p, what == "count") for p in (m[2], m[4], m[6], m[7]) if p is not None]
        if None in made:
            return m[0]
        at = job(m[1] or m[3] or m[5], what, *made)
        return f"({at} > 0)" if what == "has" else at

    out = {}
    for name, sql in formulas.items():
        sql = _IN_SENTENCES.sub(lambda m: job("_l", "sentences_with", m[1].lower()), _CALLS.sub(place, sql))
        for old, what in MEASURES.items():
            if old in sql:
                sql = sql.replace(old, job("_t" if what in ("letters", "long_words") else "_l", what))
        out[name] = sql
    return out, texts, list(jobs)


def evaluate(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """``df`` (prepared) with a column for each formula. Whole texts are measured in one pass over Arrow batches."""
    made, texts, jobs = counted(formulas)
    out = df.withColumn("_n", counts.counts(df.sparkSession, [F.col(c) for c in texts], jobs)) if jobs else df
    return out.select(*df.columns, *[F.expr(doubles(sql)).alias(name) for name, sql in made.items()])
