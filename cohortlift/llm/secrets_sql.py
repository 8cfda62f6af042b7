"""DuckDB SQL of the secret scan: plain regular expressions over every text, without an index."""

from __future__ import annotations

import re

from cohortlift.llm.secrets import BASE, BASE_KINDS, MORE, Rule


def _pattern(rule: Rule) -> str:
    """Letters in either case spelled out, as case folding there goes beyond ASCII."""
    head = re.match(r"\(\?i:([^)]*)\)", rule.pattern)
    plain = rule.pattern
    if head:
        either = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head[1])
        plain = f"(?:{either}){rule.pattern[head.end():]}"
    return plain.replace("'", "''")


def _spans(rank: int, rule: Rule) -> str:
    p = _pattern(rule)
    return f"""
  SELECT row, '{rule.kind}' AS kind, {rank} AS rank, sum(length(cut)) OVER before AS stop,
         regexp_extract(cut, '{p}', 0) AS hit, regexp_extract(cut, '{p}', {rule.group}) AS kept,
         {rule.least} AS least
  FROM (SELECT row, unnest(cuts) AS cut, generate_subscripts(cuts, 1) AS i
        FROM (SELECT row, regexp_extract_all(t, '(?s).*?(?:{p}|\\z)', 0) AS cuts FROM texts))
  WINDOW before AS (PARTITION BY row ORDER BY i)"""


def build() -> str:
    each = " UNION ALL ".join(_spans(i, rule) for i, rule in enumerate(BASE + MORE))
    counts = ",\n  ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    listed = (
        "string_agg(kind || ':' || (stop - length(hit)) || ':' || stop, ',' ORDER BY stop - length(hit), rank)"
    )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({each}
),
spans AS (SELECT * FROM found WHERE hit <> '' AND length(kept) >= least)
SELECT any_value(doc_id) AS doc_id,
  {counts},
  sha256(coalesce({listed} FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
  coalesce({listed}, '') AS spans
FROM texts LEFT JOIN spans USING (row) GROUP BY row
"""
