"""The tracker once more, as the SQL that checks it: a recursion over frames that carries each source's live tracks as a list."""

from __future__ import annotations

from sightline.operators import tracker

_WIDE = "(least(T[i].x2, D[j].x2) - greatest(T[i].x1, D[j].x1))"
_HIGH = "(least(T[i].y2, D[j].y2) - greatest(T[i].y1, D[j].y1))"
_area = lambda b: f"(greatest(0, {b}.x2 - {b}.x1) * greatest(0, {b}.y2 - {b}.y1))"
_UNION = f"({_area('T[i]')} + {_area('D[j]')} - {_WIDE} * {_HIGH})"
#: The tracks that ``tracker.follow`` makes of a table ``track_history`` with default settings.
TRACKS = f"""
WITH RECURSIVE b AS (SELECT source, frame, det_index, min({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) AS b FROM track_history WHERE source IS NOT NULL AND frame IS NOT NULL AND det_index IS NOT NULL GROUP BY ALL),
h AS (SELECT * FROM b WHERE b.x1 IS NOT NULL AND b.y1 IS NOT NULL AND b.x2 IS NOT NULL AND b.y2 IS NOT NULL),
f AS (SELECT source, frame::BIGINT AS frame, row_number() OVER (PARTITION BY source ORDER BY frame) AS n, list(b ORDER BY det_index) AS dets FROM h GROUP BY source, frame),
s AS (SELECT DISTINCT source, 0::BIGINT AS n, -1::BIGINT AS frame, []::STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, last BIGINT)[] AS live, 0::BIGINT AS made, []::BIGINT[] AS hit FROM f
  UNION ALL
  SELECT source, n, frame,
    [CASE WHEN list_contains(m.ti, i) THEN {{'id': T[i].id, 'x1': D[m.dj[list_position(m.ti, i)]].x1, 'y1': D[m.dj[list_position(m.ti, i)]].y1, 'x2': D[m.dj[list_position(m.ti, i)]].x2, 'y2': D[m.dj[list_position(m.ti, i)]].y2, 'last': frame}} ELSE T[i] END FOR i IN range(1, len(T) + 1)]
      || [{{'id': made + k, 'x1': D[fresh[k]].x1, 'y1': D[fresh[k]].y1, 'x2': D[fresh[k]].x2, 'y2': D[fresh[k]].y2, 'last': frame}} FOR k IN range(1, len(fresh) + 1)],
    made + len(fresh), [T[i].id FOR i IN m.ti] || [made + k FOR k IN range(1, len(fresh) + 1)]
  FROM (SELECT *, [j FOR j IN range(1, len(D) + 1) IF NOT list_contains(m.dj, j)] AS fresh
    FROM (SELECT *, list_reduce([{{'ti': []::BIGINT[], 'dj': []::BIGINT[]}}] || [{{'ti': [o.i], 'dj': [o.j]}} FOR o IN list_sort(offers)], lambda a, x: CASE WHEN list_contains(a.ti, x.ti[1]) OR list_contains(a.dj, x.dj[1]) THEN a ELSE {{'ti': a.ti || x.ti, 'dj': a.dj || x.dj}} END) AS m
      FROM (SELECT *, flatten([[{{'v': -({_WIDE} * {_HIGH} / {_UNION}), 'i': i, 'j': j}} FOR j IN range(1, len(D) + 1) IF {_WIDE} > 0 AND {_HIGH} > 0 AND {_UNION} > 0 AND {_WIDE} * {_HIGH} / {_UNION} >= {tracker.IOU}] FOR i IN range(1, len(T) + 1)]) AS offers
        FROM (SELECT s.source, f.n, f.frame, [t FOR t IN live IF t.last >= f.frame - {tracker.MAX_AGE} - 1] AS T, dets AS D, made FROM s JOIN f ON s.source = f.source AND f.n = s.n + 1))))),
e AS (SELECT source, frame, unnest(hit) AS track_id FROM s WHERE n > 0), z AS (SELECT source, max(frame) AS top FROM f GROUP BY source),
r AS (SELECT source, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS hits FROM e GROUP BY ALL)
SELECT source, track_id, first_frame, last_frame, hits, last_frame - first_frame + 1 AS duration, hits >= {tracker.MIN_HITS} AS confirmed, CASE WHEN hits >= {tracker.MIN_HITS} THEN least(last_frame + {tracker.MAX_AGE}, top) + 1 END AS ended_at FROM r JOIN z USING (source)
"""
