"""The plate grammars once more, as the SQL that checks them: candidates are rows here, not arrays."""

from __future__ import annotations

from sightline.functions import grammar as g


def _names(codes: dict[str, str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


_SWAPS = ", ".join(f"('{k}', '{a}', {n})" for k, v in g.CONFUSABLE.items() for n, a in enumerate(v))
_LETTERS = f"regexp_extract(c, '{g.DE_SHAPE}', 1)"
_DIGITS = f"regexp_extract(c, '{g.DE_SHAPE}', 2)"
_SERIES = f"regexp_extract(c, '{g.PL_STANDARD}', 2)"
_LONG, _SHORT = f"left({_LETTERS}, least(length({_LETTERS}) - 1, 3))", f"left({_LETTERS}, greatest(length({_LETTERS}) - 2, 1))"
_DISTRICT = f"CASE WHEN length({_LETTERS}) BETWEEN 2 AND 5 THEN CASE WHEN {_LONG} = hint THEN {_LONG} WHEN {_SHORT} = hint THEN {_SHORT} WHEN {_LONG} IN ({_names(g.DISTRICTS)}) THEN {_LONG} WHEN {_SHORT} IN ({_names(g.DISTRICTS)}) THEN {_SHORT} ELSE {_LONG} END END"
_STANDARD = f"regexp_matches(c, '{g.PL_STANDARD}') AND length(regexp_replace({_SERIES}, '[0-9]', '', 'g')) <= 2"
_FIT = f"""CASE WHEN grammar = 'IN' THEN CASE WHEN regexp_matches(c, '{g.IN_BH}') THEN 1.0 WHEN regexp_matches(c, '{g.IN_STANDARD}') THEN CASE WHEN left(c, 2) IN ({_names(g.STATES)}) THEN 1.0 ELSE 0.55 END END
  WHEN grammar = 'DE' THEN CASE WHEN regexp_matches(c, '{g.DE_SHAPE}') AND length({_LETTERS}) + length({_DIGITS}) BETWEEN 4 AND 8 AND district IS NOT NULL THEN CASE WHEN district IN ({_names(g.DISTRICTS)}) THEN 1.0 ELSE 0.8 END END
  ELSE CASE WHEN {_STANDARD} THEN CASE WHEN left(c, 1) IN ({_names(g.VOIVODESHIPS)}) THEN 1.0 ELSE 0.6 END WHEN regexp_matches(c, '{g.PL_INDIVIDUAL}') AND regexp_matches(c[2:], '[0-9]') THEN 0.85 END END::DOUBLE"""
_GATES = ", ".join(f"('{name}', {low}, {high}, {n})" for n, (name, (low, high)) in enumerate(g.GRAMMARS.items()))

#: CTEs that make ``parsed`` (raw, text, region, format_name, edits, confidence, display; readings that no grammar takes are left out) of a CTE ``raws`` (raw).
PARSE = f"""
swaps(ch, alt, n) AS (VALUES {_SWAPS}), gates(grammar, low, high, rank) AS (VALUES {_GATES}),
norm AS (SELECT raw, regexp_replace(regexp_replace(upper(raw), '[^A-Z0-9ÄÖÜ]', '', 'g'), '^IND([A-Z][A-Z][0-9])', '\\1') AS t, nullif(regexp_extract(upper(raw), '^\\s*([A-ZÄÖÜ]{{1,3}})\\s*[-–—.\\s]\\s*[A-Z]', 1), '') AS hint FROM raws WHERE raw IS NOT NULL),
spot AS (SELECT raw, t, hint, i, alt, n FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM norm WHERE length(t) BETWEEN 4 AND 11) JOIN swaps ON ch = t[i]),
once AS (SELECT raw, t, hint, i, n, left(t, i - 1) || alt || t[i + 1:] AS c FROM spot),
cand AS (SELECT raw, t, hint, 0 AS e, t AS c, 0 AS o FROM norm WHERE length(t) BETWEEN 4 AND 11 UNION ALL SELECT raw, t, hint, 1, c, i * 100 + n FROM once
  UNION ALL SELECT a.raw, a.t, a.hint, 2, left(a.c, b.i - 1) || b.alt || a.c[b.i + 1:], ((a.i * 100 + b.i) * 10 + a.n) * 10 + b.n FROM once a JOIN spot b ON a.raw = b.raw AND a.i < b.i),
cut AS (SELECT *, {_DISTRICT} AS district FROM cand JOIN gates ON length(t) BETWEEN low AND high),
fits AS (SELECT *, round(greatest(0, {_FIT} - e * {g.EDIT_PENALTY}), 3) AS score FROM cut),
best AS (SELECT * FROM fits WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raw, grammar, e ORDER BY score DESC, o) = 1),
wide AS (SELECT raw, grammar, rank, max(score) FILTER (WHERE e = 0) AS s0, max(score) FILTER (WHERE e = 1) AS s1, max(score) FILTER (WHERE e = 2) AS s2 FROM best GROUP BY ALL),
pick AS (SELECT *, CASE WHEN coalesce(s0, -1) < 1 AND s1 > coalesce(s0, -1) THEN 1 WHEN coalesce(s0, -1) < 1 AND s2 > coalesce(s0, -1) THEN 2 WHEN s0 IS NOT NULL THEN 0 END AS e FROM wide),
top AS (SELECT b.* FROM pick JOIN best b USING (raw, grammar, e) QUALIFY row_number() OVER (PARTITION BY raw ORDER BY b.score DESC, b.e, b.rank) = 1),
parsed AS (SELECT raw, c AS text, grammar AS region, CASE WHEN grammar = 'IN' AND regexp_matches(c, '{g.IN_BH}') THEN 'IN-BH' WHEN grammar = 'PL' AND NOT ({_STANDARD}) THEN 'PL-individual' ELSE grammar END AS format_name, e AS edits, score AS confidence,
  CASE WHEN grammar = 'IN' AND regexp_matches(c, '{g.IN_BH}') THEN regexp_replace(c, '{g.IN_BH}', '\\1 BH \\2 \\3')
    WHEN grammar = 'IN' THEN replace(regexp_replace(c, '{g.IN_STANDARD}', '\\1 \\2 \\3 \\4'), '  ', ' ')
    WHEN grammar = 'DE' THEN district || '-' || {_LETTERS}[length(district) + 1:] || ' ' || {_DIGITS} || regexp_extract(c, '{g.DE_SHAPE}', 3)
    WHEN {_STANDARD} THEN regexp_replace(c, '{g.PL_STANDARD}', '\\1 \\2') ELSE regexp_replace(c, '{g.PL_INDIVIDUAL}', '\\1 \\2') END AS display
  FROM top WHERE score >= {g.MIN_CONFIDENCE})
"""
