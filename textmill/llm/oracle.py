"""DuckDB SQL for the queries that SQL can express, written over windows and blocks without fingerprints or filters."""

from __future__ import annotations

import math

from textmill.llm.licenses import PHRASES, TEMPLATES, run_length

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents), b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
  wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  lens AS (SELECT DISTINCT n FROM wins),
  dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
  hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN wins USING (n, s)),
  pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
  its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


def _places(phrase: str) -> str:
    p = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p))
    return f"list_filter(range(1, len(w) - {len(p)} + 2), lambda i: {same})"


def _templates() -> str:
    rows = []
    for label, t in TEMPLATES:
        toks = sorted(set(t.split()))
        rows.append(f"('{label}', [{', '.join(repr(x) for x in toks)}], {math.ceil(0.8 * len(toks) - 1e-9)}, {run_length(t)})")
    return ", ".join(rows)


_BASE = ", ".join(f"CASE WHEN len({_places(p)}) > 0 THEN '{x}' END" for p, x in PHRASES.items())
LICENSES = f"""
WITH d AS (SELECT doc_id, text, {words('text')} AS w FROM documents),
  p AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_concat({', '.join(_places(p) for p in PHRASES)}) AS pl, list_sort(list_distinct(list_filter([{_BASE}], lambda x: x IS NOT NULL))) AS base FROM d),
  t AS (SELECT * FROM (VALUES {_templates()}) AS v(label, toks, need, length)),
  r AS (SELECT doc_id, label, toks, need, w, length, unnest(range(1, greatest(len(w) - length, 0) + 2)) AS i FROM d, t WHERE len(list_intersect(w, toks)) >= need),
  m AS (SELECT doc_id, label, n / len(toks) AS c FROM (SELECT doc_id, label, toks, need, len(list_intersect(w[i:i + length - 1], toks)) AS n FROM r) WHERE n >= need),
  f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM m GROUP BY doc_id)
SELECT p.doc_id, n_words, len(pl)::BIGINT AS n_base, list_min(pl) - 1 AS first_word, list_max(pl) - 1 AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels, CASE WHEN len(pl) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM p LEFT JOIN f ON f.doc_id = p.doc_id
"""

ORACLE_SQL = {"op8_contamination": CONTAMINATION, "op10_licenses": LICENSES}
