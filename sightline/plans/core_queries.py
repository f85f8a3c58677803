"""Registered queries of the core operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import runtime
from sightline.functions import geometry, grammar, identity, text
from sightline.operators import cooldown, duplicates, evaluate, sampling, sessions, splits, stats, tracker, vote
from sightline.plans import grammar_sql, pipeline, tracker_sql
from sightline.runtime import table
from sightline.sinks import files
from sightline.sources import labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that DuckDB runs beside it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_SESSIONS_SQL = """
WITH s AS (
  SELECT DISTINCT regexp_replace(translate(plate, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9]', '', 'g') AS plate,
         source, epoch_us(ts) AS t, track_id, frame
  FROM plate_events WHERE ts IS NOT NULL AND source IS NOT NULL AND plate IS NOT NULL),
o AS (SELECT *, CASE WHEN t - lag(t) OVER w < 300000000 THEN 0 ELSE 1 END AS opens FROM s WHERE plate <> '' WINDOW w AS (PARTITION BY plate, source ORDER BY t)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY plate, source ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM o),
r AS (SELECT plate, source, min(t) AS start_us, max(t) AS end_us, max(t) - min(t) AS duration_us, count(*) AS sightings FROM g GROUP BY plate, source, sid)
"""


@query("p3_found", _SESSIONS_SQL + "SELECT plate, source, start_us, end_us FROM r")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.incremental_sessions(table(spark, d, "plate_events")).select("plate", "source", "start_us", "end_us")


@query("p3_sessions", _SESSIONS_SQL + "SELECT * FROM r")
def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.incremental_sessions(table(spark, d, "plate_events"))


# --- sightings: cooldown, votes, grammar, log ---

_NORM = "regexp_replace(translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9]', '', 'g')"
_SIGHTINGS_SQL = f"""
WITH s AS (SELECT DISTINCT {_NORM.format('plate')} AS plate, source, epoch_us(ts) AS ts_us, track_id, frame
  FROM plate_events WHERE ts IS NOT NULL AND source IS NOT NULL AND {_NORM.format('plate')} <> '')
"""


def sightings(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sighting_keys(table(spark, d, "plate_events")).drop("logged_at").distinct()


@query(
    "cooldown_log",
    _SIGHTINGS_SQL
    + """, w AS (SELECT *, lag(ts_us) OVER k AS prev, row_number() OVER k AS sighting FROM s WINDOW k AS (PARTITION BY plate ORDER BY ts_us, source, track_id NULLS FIRST, frame NULLS FIRST))
SELECT plate, source, ts_us, track_id, frame, sighting, coalesce(ts_us - prev >= 300000000, true) AS accepted FROM w""",
)
def cooldown_log(spark: SparkSession, d: str) -> DataFrame:
    return cooldown.cooldown(sightings(spark, d), "plate", "ts_us", ["source", "track_id", "frame"])


@query("cooldown_history", _SIGHTINGS_SQL + "SELECT plate, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS sightings FROM s GROUP BY plate")
def cooldown_history(spark: SparkSession, d: str) -> DataFrame:
    return cooldown.history(sightings(spark, d), "plate", "ts_us")


@query(
    "cooldown_users",
    """WITH w AS (SELECT user_id, event_id, epoch_us(ts) AS ts_us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE prev IS NULL OR ts_us - prev >= 3600000000) AS logged FROM w GROUP BY user_id""",
)
def cooldown_users(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return cooldown.cooldown(rows, "user_id", "ts_us", ["event_id"], 3_600_000_000).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("accepted").alias("logged"))


def _vote_sql(text: str) -> str:
    return f"""
WITH r AS (SELECT source, track_id, {text} AS t, CAST(confidence AS DECIMAL(18,9)) AS w, confidence AS c, length({text}) AS len
  FROM plate_events WHERE source IS NOT NULL AND track_id IS NOT NULL AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) AND {text} <> ''),
l AS (SELECT source, track_id, len, sum(w) AS lw, CAST(sum(w) AS DOUBLE) AS lc, count(*) AS ln FROM r GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY source, track_id ORDER BY lw DESC, len DESC) AS k, sum(ln) OVER (PARTITION BY source, track_id) AS n FROM l),
c AS (SELECT r.* FROM r JOIN b USING (source, track_id, len) WHERE k = 1 AND n >= 2),
p AS (SELECT source, track_id, i AS pos, t[i] AS ch, sum(w) AS w FROM c, LATERAL (SELECT unnest(range(1, len + 1)) AS i) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY source, track_id, pos ORDER BY w DESC, ch) AS k, sum(w) OVER (PARTITION BY source, track_id, pos) AS total FROM p),
v AS (SELECT source, track_id, string_agg(ch, '' ORDER BY pos) AS text, avg(CASE WHEN total > 0 THEN CAST(w AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0 END) AS agreement FROM q WHERE k = 1 GROUP BY source, track_id),
o AS (SELECT c.source, c.track_id, t, row_number() OVER (PARTITION BY c.source, c.track_id ORDER BY sum(w) DESC, t) AS k FROM c JOIN v USING (source, track_id) WHERE t <> text GROUP BY c.source, c.track_id, t)
"""


_VOTE_SQL = _vote_sql(_NORM.format("plate"))


def plate_reads(spark: SparkSession, d: str) -> DataFrame:
    plate = F.regexp_replace(runtime.ascii_upper(F.col("plate")), "[^A-Z0-9]", "")
    return table(spark, d, "plate_events").where("source IS NOT NULL AND track_id IS NOT NULL").select("source", "track_id", plate.alias("text"), "confidence")


@query("vote_plate", _VOTE_SQL + "SELECT source, track_id, text, ln AS reads, round(agreement, 3) AS agreement FROM v JOIN b USING (source, track_id) WHERE k = 1")
def vote_plate(spark: SparkSession, d: str) -> DataFrame:
    return vote.vote(plate_reads(spark, d), ["source", "track_id"]).select("source", "track_id", "text", "reads", "agreement")


@query("vote_runner_up", _VOTE_SQL + "SELECT source, track_id, t AS runner_up FROM v LEFT JOIN (SELECT * FROM o WHERE k = 1) USING (source, track_id)")
def vote_runner_up(spark: SparkSession, d: str) -> DataFrame:
    return vote.vote(plate_reads(spark, d), ["source", "track_id"]).select("source", "track_id", "runner_up")


_PARSE_SQL = grammar_sql.PARSE


@query(
    "plate_parse",
    "WITH raws AS (SELECT DISTINCT plate AS raw FROM plate_events WHERE plate IS NOT NULL)," + _PARSE_SQL + "SELECT raws.raw AS plate, text, region, format_name, edits, confidence, display FROM raws LEFT JOIN parsed USING (raw)",
)
def plate_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded plate against the grammars."""
    rows = grammar.parse_plates(table(spark, d, "plate_events").select("plate").where("plate IS NOT NULL").distinct(), "plate")
    return rows.select("plate", "match.text", F.col("match.region").alias("region"), F.col("match.format_name").alias("format_name"), F.col("match.edits").alias("edits"), F.col("match.confidence").alias("confidence"), grammar.display(F.col("match")).alias("display"))


_EXACT_SQL = f"""
WITH d AS (SELECT DISTINCT plate, regexp_replace(regexp_replace(upper(plate), '[^A-Z0-9ÄÖÜ]', '', 'g'), '^IND([A-Z][A-Z][0-9])', '\\1') AS t FROM plate_events WHERE plate IS NOT NULL),
i AS (SELECT plate, t, left(t, 2) IN ({', '.join(repr(s) for s in grammar.STATES)}) AS known FROM d WHERE length(t) BETWEEN 4 AND 11)
SELECT plate, CASE WHEN regexp_matches(t, '{grammar.IN_BH}') THEN 1.0 WHEN regexp_matches(t, '{grammar.IN_STANDARD}') THEN CASE WHEN known THEN 1.0 ELSE 0.55 END END::DOUBLE AS confidence
FROM i WHERE regexp_matches(t, '{grammar.IN_BH}') OR regexp_matches(t, '{grammar.IN_STANDARD}')
"""


@query("plate_exact_in", _EXACT_SQL)
def plate_exact_in(spark: SparkSession, d: str) -> DataFrame:
    """Plates that fit the Indian grammar as they are."""
    rows = table(spark, d, "plate_events").select("plate").where("plate IS NOT NULL").distinct()
    return grammar.parse_plates(rows, "plate", region="IN", max_edits=0, min_confidence=0.0).where("match IS NOT NULL").select("plate", F.col("match.confidence").alias("confidence"))


_LOG_SQL = (
    _vote_sql("plate").rstrip()
    + """, k AS (SELECT source, track_id, text AS voted, CAST(round(CAST(round(agreement * lc / ln, 9) AS DECIMAL(12, 9)), 3) AS DOUBLE) AS sure FROM v JOIN b USING (source, track_id) WHERE k = 1),
x AS (SELECT source, track_id, min(frame) AS first_frame, max(epoch_us(ts)) AS ts_us FROM plate_events WHERE source IS NOT NULL AND track_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
raws AS (SELECT DISTINCT voted AS raw FROM k),"""
    + _PARSE_SQL.rstrip()
    + """, z AS (SELECT x.*, voted, parsed.text AS plate, display, region, round(least(sure, confidence), 3) AS confidence, edits FROM x LEFT JOIN k USING (source, track_id) LEFT JOIN parsed ON raw = voted),
y AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY plate ORDER BY ts_us, source, track_id) AS since FROM z WHERE plate IS NOT NULL)
"""
)


@query("plate_log", _LOG_SQL + "SELECT plate, display, region, confidence, edits, track_id, first_frame AS frame, source, ts_us FROM y WHERE coalesce(since >= 300000000, true)")
def plate_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of all tracks with readings: vote, grammar, cooldown."""
    return _logged(spark, d)[0]


@query(
    "plate_log_stats",
    _LOG_SQL
    + """SELECT (SELECT count(*) FROM z) AS tracks_completed, (SELECT count(*) FROM z WHERE voted IS NULL) AS too_few_reads, (SELECT count(*) FROM z WHERE voted IS NOT NULL AND plate IS NULL) AS rejected,
  count(*) FILTER (WHERE since < 300000000) AS suppressed, count(*) FILTER (WHERE coalesce(since >= 300000000, true)) AS logged FROM y""",
)
def plate_log_stats(spark: SparkSession, d: str) -> DataFrame:
    return _logged(spark, d)[1]


def _logged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "plate_events").where("source IS NOT NULL AND track_id IS NOT NULL AND ts IS NOT NULL")
    tracks = events.groupBy("source", "track_id").agg(F.min("frame").alias("first_frame"), F.max(F.unix_micros("ts")).alias("ts_us"))
    # Readings as they were written: the grammar reads umlauts and separators.
    reads = table(spark, d, "plate_events").where("source IS NOT NULL AND track_id IS NOT NULL")
    return pipeline.plate_log(tracks, reads.select("source", "track_id", F.col("plate").alias("text"), "confidence"))


# --- identity, statistics, splits ---

# The patterns are the engine's own; RE2 has no flag for Unix lines and needs none.
_re2 = lambda pattern: pattern.replace("(?id)", "(?i)")
CLIP_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(base, '{_re2(p)}', 1), '')" for p in identity.CLIP_PATTERNS) + ")"
SUFFIX_SQL = _re2(identity.EXPORT_SUFFIX)
_BASE_SQL = f"regexp_replace(image_id, '{SUFFIX_SQL}', '')"
_KEYED_SQL = f"""
WITH b AS (SELECT *, {_BASE_SQL} AS base FROM manifest), k AS (SELECT *, {CLIP_SQL} AS clip FROM b),
m AS (SELECT *, row_number() OVER () AS row, coalesce(split_group, clip, nullif(base, ''), image_id) AS group_key FROM k)
"""


@query("clip_identity", f"WITH b AS (SELECT DISTINCT image_id, {_BASE_SQL} AS base FROM manifest) SELECT image_id, base, {CLIP_SQL} AS clip FROM b")
def clip_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest").select("image_id").distinct()
    return rows.select("image_id", identity.strip_export_suffix(F.col("image_id")).alias("base"), identity.clip_id(F.col("image_id")).alias("clip"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_group_key(table(spark, d, "manifest"))


@query(
    "dataset_stats",
    _KEYED_SQL
    + """, y AS (SELECT m.image_id, m.width, m.height, unnest(boxes) AS box FROM m)
SELECT (SELECT count(*) FROM m) AS images, (SELECT count(*) FROM y) AS plates, (SELECT count(*) FROM m WHERE boxes IS NULL OR len(boxes) = 0) AS images_without_plates, (SELECT count(DISTINCT group_key) FROM m) AS groups,
  count(*) FILTER (WHERE box.text <> '') AS with_text, count(*) FILTER (WHERE box.w * width < 32) AS tiny_plates, (SELECT count(*) FROM y)::DOUBLE / (SELECT count(*) FROM m) AS plates_per_image,
  median(box.w * width) AS median_width, median(box.h * height) AS median_height FROM y""",
)
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.dataset_stats(table(spark, d, "manifest"))


@query("plates_by_region", "WITH y AS (SELECT unnest(boxes) AS box FROM manifest) SELECT box.region AS region, count(*) AS plates FROM y WHERE box.region <> '' GROUP BY 1")
def plates_by_region(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts_by(stats.box_rows(table(spark, d, "manifest")), "region").withColumnRenamed("images", "plates")


@query("images_by_source", "SELECT source, count(*) AS images FROM manifest WHERE source <> '' GROUP BY 1")
def images_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts_by(table(spark, d, "manifest"), "source")


@query(
    "region_slices",
    """WITH m AS (SELECT image_id, boxes, row_number() OVER () AS row FROM manifest), x AS (SELECT row, unnest(boxes) AS box FROM m),
p AS (SELECT row, box.region AS region, count(*) AS n FROM x WHERE box.region IS NOT NULL AND box.region <> 'XX' GROUP BY ALL),
r AS (SELECT row, region, row_number() OVER (PARTITION BY row ORDER BY n DESC, region) AS k FROM p)
SELECT coalesce(region, 'XX') AS region, count(*) AS images FROM m LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (row) GROUP BY 1""",
)
def region_slices(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy("region").agg(F.count("*").alias("images"))


@query(
    "exit_criteria",
    """WITH y AS (SELECT unnest(boxes) AS box FROM manifest), r AS (SELECT unnest(['IN', 'EU']) AS region)
SELECT 'plates >= 1000' AS criterion, count(*) >= 1000 AS passed FROM y UNION ALL SELECT 'region ' || r.region, EXISTS (SELECT 1 FROM y WHERE y.box.region = r.region) FROM r""",
)
def exit_criteria(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest")
    return stats.exit_criteria(stats.dataset_stats(rows), plates_by_region(spark, d))


@query("repeated_ids", "SELECT image_id, count(*) AS records FROM manifest GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return labels.repeated_ids(table(spark, d, "manifest"))


@query(
    "box_geometry",
    """WITH x AS (SELECT DISTINCT image_id, width, height, boxes FROM manifest), i AS (SELECT *, unnest(range(len(boxes))) AS box_index FROM x), y AS (SELECT image_id, width, height, box_index, boxes[box_index + 1] AS b FROM i)
SELECT image_id, box_index, b.cx - b.w / 2 AS x1, b.cy - b.h / 2 AS y1, b.cx + b.w / 2 AS x2, b.cy + b.h / 2 AS y2, b.w * b.h AS area, b.w * width AS pixel_width,
  CASE WHEN b.w * width < 32 AND b.w * width >= 0 THEN 'tiny (<32px)' WHEN b.w * width < 64 AND b.w * width >= 0 THEN 'small (32-64px)' WHEN b.w * width < 128 AND b.w * width >= 0 THEN 'medium (64-128px)' ELSE 'large (>=128px)' END AS bucket FROM y""",
)
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest").select("image_id", "width", "height", "boxes").distinct().select("image_id", "width", "height", F.posexplode("boxes").alias("box_index", "b"))
    b = F.col("b")
    wide = b["w"] * F.col("width")
    return rows.select("image_id", "box_index", geometry.corners(b).alias("c"), geometry.box_area(b).alias("area"), wide.alias("pixel_width"), geometry.size_bucket(wide).alias("bucket")).select("image_id", "box_index", "c.*", "area", "pixel_width", "bucket")


_REGION_SQL = """, x AS (SELECT row, unnest(boxes) AS box FROM m), p AS (SELECT row, box.region AS region, count(*) AS n FROM x WHERE box.region IS NOT NULL AND box.region <> 'XX' GROUP BY ALL),
r AS (SELECT row, region, row_number() OVER (PARTITION BY row ORDER BY n DESC, region) AS k FROM p),
i AS (SELECT image_id, group_key, coalesce(region, 'XX') AS region FROM m LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (row))
"""


@query("owned_groups", _KEYED_SQL + _REGION_SQL + ", g AS (SELECT group_key, region, count(*) AS size FROM i GROUP BY ALL) SELECT group_key, min(region) AS region, arg_min(size, region) AS size FROM g GROUP BY group_key")
def owned_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.owned_groups(manifest(spark, d))


@query("grouped_split")
def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_split(manifest(spark, d))


@query("split_counts")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d)
    return splits.split_counts(splits.assign(rows, splits.grouped_split(rows)))


@query("split_problems")
def split_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d)
    return splits.coverage(rows, splits.grouped_split(rows))


# The same split from ranks that the SQL can make too.
_SHARES = splits.normalize_ratios(splits.RATIOS)
_CHOICE = "list_sort([" + ", ".join(f"{{'gap': {c} - {_SHARES[n]!r}::DOUBLE * total, 'rank': md5('0:' || t.group_key || ':{n}')[1:16], 'split': '{n}'}}" for n, c in zip(splits.SPLITS, "abc")) + "])[1].split"
_SPLIT_SQL = (
    _KEYED_SQL.replace("WITH b", "WITH RECURSIVE b", 1)
    + _REGION_SQL
    + f""", h AS (SELECT group_key, region, count(*) AS size FROM i GROUP BY ALL), g AS (SELECT group_key, min(region) AS region, arg_min(size, region) AS size FROM h WHERE group_key IS NOT NULL GROUP BY group_key),
t AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY size DESC, md5('0:' || group_key)[1:16], group_key) AS n, sum(size) OVER (PARTITION BY region)::BIGINT AS total FROM g),
f AS (SELECT DISTINCT region, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::VARCHAR AS group_key, NULL::VARCHAR AS split FROM t
  UNION ALL SELECT region, n, a + CASE WHEN split = 'train' THEN size ELSE 0 END, b + CASE WHEN split = 'val' THEN size ELSE 0 END, c + CASE WHEN split = 'test' THEN size ELSE 0 END, group_key, split
  FROM (SELECT t.region, t.n, a, b, c, size, t.group_key, {_CHOICE} AS split FROM f JOIN t ON t.region = f.region AND t.n = f.n + 1)),
s AS (SELECT group_key, split FROM f WHERE n > 0)
"""
)


def _md5_split(rows: DataFrame) -> DataFrame:
    return splits.grouped_split(rows, digest="md5")


@query("grouped_split_md5", _SPLIT_SQL + "SELECT * FROM s")
def grouped_split_md5(spark: SparkSession, d: str) -> DataFrame:
    return _md5_split(manifest(spark, d))


@query("split_counts_md5", _SPLIT_SQL + ", o AS (SELECT unnest(['train', 'val', 'test']) AS split) SELECT split, count(group_key) AS images FROM o LEFT JOIN (SELECT m.group_key, s.split FROM m JOIN s USING (group_key)) USING (split) GROUP BY split")
def split_counts_md5(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d)
    return splits.split_counts(splits.assign(rows, _md5_split(rows)))


@query(
    "split_problems_damaged",
    _KEYED_SQL
    + ", k2 AS (SELECT DISTINCT group_key FROM m WHERE group_key IS NOT NULL) SELECT 'unassigned' AS problem, group_key AS name FROM k2 WHERE ('0x' || md5(group_key)[1:4])::INT % 20 = 0 UNION ALL SELECT 'stale', 'gone:' || group_key FROM k2 WHERE ('0x' || md5(group_key)[1:4])::INT % 20 = 1",
)
def split_problems_damaged(spark: SparkSession, d: str) -> DataFrame:
    """What the check of a split finds when a twentieth of its groups is lost and as many name groups that aren't there."""
    rows = manifest(spark, d)
    plan = _md5_split(rows)
    k = F.conv(F.substring(F.md5("group_key"), 1, 4), 16, 10).cast("int") % 20
    extra = plan.where(k == 1).select(F.concat(F.lit("gone:"), "group_key").alias("group_key"), "split")
    return splits.coverage(rows, plan.where(k != 0).unionByName(extra))


@query(
    "tree_fingerprint_md5",
    _SPLIT_SQL
    + """, z AS (SELECT split, image_id, coalesce(list_aggregate([printf('0 %.6f %.6f %.6f %.6f' || chr(10), v.cx, v.cy, v.w, v.h) FOR v IN boxes], 'string_agg', ''), '') AS body FROM m JOIN s USING (group_key)),
w AS (SELECT split, image_id || '.txt' AS name, min(body) AS body FROM z GROUP BY ALL)
SELECT sha256(string_agg(split || '/' || name || body, '' ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, name)) AS sha256 FROM w""",
)
def tree_fingerprint_md5(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).where("image_id IS NOT NULL")
    tree = splits.assign(rows, _md5_split(rows)).where("split IS NOT NULL").select("split", F.concat("image_id", F.lit(".txt")).alias("name"), files.label_body(F.col("boxes"), clip=False).alias("body"))
    tree = tree.groupBy("split", "name").agg(F.min("body").alias("body"))
    return spark.createDataFrame([(stats.export_fingerprint(tree),)], "sha256 string")


@query(
    "label_lines",
    """WITH x AS (SELECT DISTINCT image_id, boxes FROM manifest) SELECT image_id, coalesce(list_aggregate([printf('0 %.6f %.6f %.6f %.6f' || chr(10), b.cx, b.cy, b.w, b.h) FOR b IN boxes], 'string_agg', ''), '') AS body FROM x""",
)
def label_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("image_id", "boxes").distinct().select("image_id", files.label_body(F.col("boxes"), clip=False).alias("body"))


@query("label_round_trip", "SELECT count(*) AS records, sum(len(boxes)) AS boxes, sum(len(boxes)) AS parsed, 0 AS errors FROM manifest WHERE boxes IS NOT NULL")
def label_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Boxes written as label lines and parsed again: records, boxes, and those that came back with an error."""
    rows = table(spark, d, "manifest").where("boxes IS NOT NULL").select("image_id", F.size("boxes").alias("n"), labels.parse_label(files.label_body(F.col("boxes"))).alias("p"))
    return rows.agg(F.count("*").alias("records"), F.sum("n").alias("boxes"), F.sum(F.size("p.boxes")).alias("parsed"), F.count_if(F.col("p.error").isNotNull()).alias("errors"))


@query(
    "manifest_lines",
    """WITH r AS (SELECT DISTINCT image_id, width, height, boxes, file_name, split_group, source, meta FROM manifest),
j AS (SELECT *, '"boxes":[' || coalesce(array_to_string(['{' || array_to_string([x FOR x IN ['"cx":' || b.cx, '"cy":' || b.cy, '"h":' || b.h, '"region":' || to_json(nullif(b.region, 'XX'))::VARCHAR, '"text":' || to_json(b.text)::VARCHAR, '"w":' || b.w] IF x IS NOT NULL], ',') || '}' FOR b IN boxes], ','), '') || ']' AS bs,
  CASE WHEN cardinality(meta) > 0 THEN '"meta":{' || array_to_string([to_json(e.key)::VARCHAR || ':' || coalesce(to_json(e.value)::VARCHAR, 'null') FOR e IN list_sort(map_entries(meta))], ',') || '}' END AS ms FROM r)
SELECT DISTINCT image_id, '{' || array_to_string([x FOR x IN [bs, '"file_name":' || to_json(file_name)::VARCHAR, '"group":' || to_json(split_group)::VARCHAR, '"height":' || height, '"image_id":' || to_json(image_id)::VARCHAR, ms, '"source":' || to_json(source)::VARCHAR, '"width":' || width] IF x IS NOT NULL], ',') || '}' AS line FROM j""",
)
def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest_json(table(spark, d, "manifest")).distinct()


@query("tree_fingerprint")
def tree_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).dropDuplicates(["image_id"])
    tree = files.label_tree(splits.assign(rows, splits.grouped_split(rows)))
    return spark.createDataFrame([(stats.export_fingerprint(tree),)], "sha256 string")


@query(
    "redistributable_sources",
    "SELECT source_tag, licence, NOT regexp_matches(upper(licence), '\\b(ND|NC)\\b') AS redistributable FROM roboflow_sources",
)
def redistributable_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roboflow_sources").select("source_tag", "licence", text.redistributable(F.col("licence")).alias("redistributable"))


# --- near duplicates ---

_HASH_SQL = """
WITH i AS (SELECT DISTINCT image_id, dhash, contrast <= 4 AS blank, nullif(region, 'XX') AS region FROM image_hashes WHERE image_id IS NOT NULL AND dhash IS NOT NULL AND contrast IS NOT NULL),
p AS (SELECT a.image_id AS left_id, b.image_id AS right_id, min(bit_count(xor(a.dhash, b.dhash)))::INT AS distance FROM i a JOIN i b ON a.image_id < b.image_id AND a.blank = b.blank
  WHERE bit_count(xor(a.dhash, b.dhash)) <= CASE WHEN a.blank THEN 0 WHEN a.region <> b.region THEN 2 ELSE 5 END OR a.dhash = b.dhash GROUP BY ALL)
"""


@query("near_dup_pairs", _HASH_SQL + "SELECT left_id, right_id, distance FROM p")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_pairs(table(spark, d, "image_hashes"))


@query(
    "near_dup_class_pairs",
    """WITH i AS (SELECT DISTINCT image_id, dhash, contrast <= 4 AS blank, coalesce(nullif(region, 'XX'), '-') AS region FROM image_hashes WHERE image_id IS NOT NULL AND dhash IS NOT NULL AND contrast IS NOT NULL),
c AS (SELECT dhash, blank, region, dhash || '|' || blank || '|' || region AS cls, count(*) AS n FROM i GROUP BY ALL)
SELECT a.cls AS left_class, b.cls AS right_class, a.n AS left_images, b.n AS right_images, bit_count(xor(a.dhash, b.dhash))::INT AS distance FROM c a JOIN c b ON a.cls < b.cls AND a.blank = b.blank
  WHERE a.dhash = b.dhash OR (NOT a.blank AND bit_count(xor(a.dhash, b.dhash)) <= CASE WHEN a.region <> '-' AND b.region <> '-' AND a.region <> b.region THEN 2 ELSE 5 END)""",
)
def near_dup_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates as pairs of classes of equal looks; copies aren't expanded."""
    return duplicates.duplicate_class_pairs(table(spark, d, "image_hashes"))


@query(
    "near_dup_clusters",
    _HASH_SQL.replace("WITH i", "WITH RECURSIVE i", 1)
    + """, e AS (SELECT left_id AS a, right_id AS b FROM p UNION SELECT right_id, left_id FROM p),
r AS (SELECT DISTINCT a AS image_id, a AS seen FROM e UNION SELECT r.image_id, e.b FROM r JOIN e ON r.seen = e.a) SELECT image_id, 'dup:' || min(seen) AS cluster_id FROM r GROUP BY image_id""",
)
def near_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_clusters(table(spark, d, "image_hashes"))


_SIDE_SQL = "CASE lower(trim({0})) WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' END"
_PAIR_SQL = f"""WITH q AS (SELECT left_id, right_id, {_SIDE_SQL.format('left_split')} AS left_split, {_SIDE_SQL.format('right_split')} AS right_split FROM duplicate_pairs WHERE left_id <> right_id AND distance BETWEEN 0 AND 5),
p AS (SELECT DISTINCT * FROM q WHERE left_split IS NOT NULL AND right_split IS NOT NULL)"""


def recorded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Recorded near pairs with both splits, in whatever spelling."""
    rows = table(spark, d, "duplicate_pairs").where("left_id <> right_id AND distance BETWEEN 0 AND 5")
    rows = rows.select("left_id", "right_id", *(text.split_side(F.col(c)).alias(c) for c in ("left_split", "right_split")))
    return rows.where("left_split IS NOT NULL AND right_split IS NOT NULL").distinct()


@query(
    "duplicate_report",
    _PAIR_SQL + " SELECT count(*) AS pairs, count(*) FILTER (WHERE left_split = right_split) AS within, count(*) FILTER (WHERE left_split <> right_split) AS across, count(*) FILTER (WHERE left_split <> right_split AND 'train' IN (left_split, right_split)) AS contaminating FROM p",
)
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_report(recorded_pairs(spark, d))


@query(
    "contaminated_images",
    _PAIR_SQL + ", c AS (SELECT * FROM p WHERE left_split <> right_split AND 'train' IN (left_split, right_split)) SELECT left_split AS split, left_id AS image_id FROM c WHERE left_split <> 'train' UNION SELECT right_split, right_id FROM c WHERE right_split <> 'train'",
)
def contaminated_images(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.affected_images(recorded_pairs(spark, d))


@query(
    "clean_test_images",
    _PAIR_SQL
    + ", c AS (SELECT * FROM p WHERE left_split <> right_split AND 'train' IN (left_split, right_split)), h AS (SELECT DISTINCT image_id FROM image_hashes WHERE image_id IS NOT NULL AND lower(trim(split)) = 'test') SELECT image_id FROM h WHERE image_id NOT IN (SELECT left_id FROM c WHERE left_split = 'test' UNION SELECT right_id FROM c WHERE right_split = 'test')",
)
def clean_test_images(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "image_hashes").where((text.split_side(F.col("split")) == "test") & F.col("image_id").isNotNull()).select("image_id").distinct()
    return duplicates.clean_subset(rows, recorded_pairs(spark, d), "test")


@query(
    "regrouped_images",
    _KEYED_SQL.replace("WITH b", "WITH RECURSIVE b", 1)
    + _HASH_SQL.replace("WITH i", ", i", 1)
    + """, ce AS (SELECT left_id AS a, right_id AS b FROM p UNION SELECT right_id, left_id FROM p),
cr AS (SELECT DISTINCT a AS image_id, a AS seen FROM ce UNION SELECT cr.image_id, ce.b FROM cr JOIN ce ON cr.seen = ce.a), c AS (SELECT image_id, min(seen) AS cluster_id FROM cr GROUP BY image_id),
ki AS (SELECT DISTINCT image_id, group_key FROM m), kc AS (SELECT DISTINCT group_key, cluster_id FROM ki JOIN c USING (image_id)),
ke AS (SELECT DISTINCT x.group_key AS a, y.group_key AS b FROM kc x JOIN kc y USING (cluster_id)),
kr AS (SELECT DISTINCT group_key AS node, group_key AS seen FROM kc UNION SELECT kr.node, ke.b FROM kr JOIN ke ON kr.seen = ke.a), kk AS (SELECT node AS group_key, min(seen) AS comp FROM kr GROUP BY node),
n AS (SELECT comp, 'dup:' || min(image_id) AS new_group FROM ki JOIN kk USING (group_key) GROUP BY comp)
SELECT image_id, ki.group_key, new_group FROM ki LEFT JOIN kk USING (group_key) LEFT JOIN n USING (comp)""",
)
def regrouped_images(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).select("image_id", "group_key").distinct()
    return duplicates.regroup(rows, near_dup_clusters(spark, d))


@query("exact_dup_docs", "SELECT md5(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies")).where("copies > 1")


# --- evaluation ---


# Detections are made from the truth by a rule on a digest of image and box: most are shifted a little, some far, some missing, some strays added.
_IOU_SQL = "(least(t.x2, d.x2) - greatest(t.x1, d.x1)) * (least(t.y2, d.y2) - greatest(t.y1, d.y1))"
_DETECTED_SQL = f"""
WITH RECURSIVE m AS (SELECT DISTINCT image_id, width, boxes FROM manifest), i AS (SELECT *, unnest(range(len(boxes))) AS box_index FROM m),
t AS (SELECT image_id, box_index, b.cx - b.w / 2 AS x1, b.cy - b.h / 2 AS y1, b.cx + b.w / 2 AS x2, b.cy + b.h / 2 AS y2, b.w * width AS pixel_width, ('0x' || md5(image_id || '#' || box_index)[1:4])::INT % 10 AS k FROM (SELECT *, boxes[box_index + 1] AS b FROM i)),
s AS (SELECT *, CASE WHEN k < 6 THEN 0.1::DOUBLE WHEN k < 8 THEN 0.45::DOUBLE ELSE 0.9::DOUBLE END * (x2 - x1) AS shift FROM t),
d AS (SELECT image_id, box_index AS det_index, x1 + shift AS x1, y1, x2 + shift AS x2, y2, 0.5::DOUBLE + k / 20::DOUBLE AS confidence FROM s WHERE k < 9
  UNION ALL SELECT image_id, 1000, 0, 0, 0.01::DOUBLE, 0.01::DOUBLE, 0.3::DOUBLE FROM s WHERE box_index = 0 AND k = 3),
o AS (SELECT d.image_id, d.det_index, d.confidence, t.box_index, CASE WHEN least(t.x2, d.x2) > greatest(t.x1, d.x1) AND least(t.y2, d.y2) > greatest(t.y1, d.y1)
    THEN {_IOU_SQL} / ((t.x2 - t.x1) * (t.y2 - t.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - {_IOU_SQL}) ELSE 0 END AS overlap FROM d JOIN t USING (image_id)),
l AS (SELECT image_id, det_index, list(box_index ORDER BY overlap DESC, box_index DESC) AS offers FROM o WHERE overlap >= 0.5 GROUP BY ALL),
q AS (SELECT d.image_id, coalesce(offers, []) AS offers, row_number() OVER (PARTITION BY d.image_id ORDER BY d.confidence DESC, d.det_index) AS rank, count(*) OVER (PARTITION BY d.image_id) AS n FROM d LEFT JOIN l USING (image_id, det_index)),
g AS (SELECT DISTINCT image_id, 0::BIGINT AS step, []::BIGINT[] AS claimed, n FROM q
  UNION ALL SELECT g.image_id, g.step + 1, list_concat(g.claimed, [x FOR x IN q.offers IF NOT list_contains(g.claimed, x)][1:1]), g.n FROM g JOIN q ON q.image_id = g.image_id AND q.rank = g.step + 1),
a AS (SELECT image_id, count(*) AS truths, max(pixel_width) AS widest FROM t GROUP BY 1),
e AS (SELECT image_id, coalesce(claimed, []) AS claimed, coalesce(len(claimed), 0) AS tp, coalesce(n - len(claimed), 0) AS fp, coalesce(truths, 0) - coalesce(len(claimed), 0) AS fn, widest FROM a FULL JOIN (SELECT * FROM g WHERE step = n) USING (image_id))
"""
_RATES_SQL = "tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1"
_BUCKET_SQL = "CASE WHEN {0} >= 0 AND {0} < 32 THEN 'tiny (<32px)' WHEN {0} >= 32 AND {0} < 64 THEN 'small (32-64px)' WHEN {0} >= 64 AND {0} < 128 THEN 'medium (64-128px)' ELSE 'large (>=128px)' END"


def evaluation_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(truth, detections): manifest boxes, and boxes made from them by a rule."""
    truth = evaluate.truth_boxes(table(spark, d, "manifest").select("image_id", "width", "boxes").distinct())
    k = F.conv(F.substring(F.md5(F.concat("image_id", F.lit("#"), F.col("box_index").cast("string"))), 1, 4), 16, 10).cast("int") % 10
    shift = F.when(k < 6, 0.1).when(k < 8, 0.45).otherwise(0.9) * (F.col("x2") - F.col("x1"))
    kept = truth.where(k < 9).select("image_id", F.col("box_index").alias("det_index"), (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2", (0.5 + k / 20).alias("confidence"))
    stray = truth.where((F.col("box_index") == 0) & (k == 3)).select("image_id", F.lit(1000).alias("det_index"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.01).alias("x2"), F.lit(0.01).alias("y2"), F.lit(0.3).alias("confidence"))
    return truth, kept.unionByName(stray)


@query("detection_overall", _DETECTED_SQL + f", f AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM e) SELECT {_RATES_SQL} FROM f")
def detection_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overall(evaluate.match_boxes(*evaluation_tables(spark, d)))


@query(
    "detection_by_size",
    _DETECTED_SQL
    + f""", u AS (SELECT {_BUCKET_SQL.format('pixel_width')} AS bucket, list_contains(claimed, box_index)::INT AS tp, 0 AS fp, 1 - list_contains(claimed, box_index)::INT AS fn FROM t JOIN e USING (image_id)
  UNION ALL SELECT {_BUCKET_SQL.format('widest')}, 0, fp, 0 FROM e WHERE widest IS NOT NULL),
f AS (SELECT bucket, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM u GROUP BY bucket) SELECT bucket, {_RATES_SQL} FROM f""",
)
def detection_by_size(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.by_size(evaluate.match_boxes(*evaluation_tables(spark, d)))


@query("detection_worst", _DETECTED_SQL + "SELECT image_id, tp, fp, fn, fp + fn AS errors FROM e ORDER BY errors DESC, image_id LIMIT 20")
def detection_worst(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.worst_images(evaluate.match_boxes(*evaluation_tables(spark, d)))


@query(
    "detection_best",
    _DETECTED_SQL
    + ", w AS (SELECT *, row_number() OVER (PARTITION BY image_id, box_index ORDER BY overlap DESC, det_index DESC) AS r FROM o WHERE overlap >= 0.5) SELECT t.image_id, t.box_index, det_index, overlap, confidence FROM t LEFT JOIN (SELECT * FROM w WHERE r = 1) USING (image_id, box_index)",
)
def detection_best(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_detections(*evaluation_tables(spark, d))


# levenshtein counts bytes there, so each pair's characters beyond ASCII stand as control characters.
_READ_SQL = """
WITH q AS (SELECT source, plate AS reference, translate(display, ' -', '') AS hypothesis FROM plate_events WHERE plate IS NOT NULL AND display IS NOT NULL),
w AS (SELECT *, list_distinct(regexp_extract_all(reference || hypothesis, '[^\\x00-\\x7F]')) AS wide FROM q),
e AS (SELECT *, CASE WHEN len(wide) = 0 THEN levenshtein(reference, hypothesis)
  ELSE levenshtein(translate(reference, array_to_string(wide, ''), array_to_string([chr(i::INT) FOR i IN range(1, len(wide) + 1)], '')), translate(hypothesis, array_to_string(wide, ''), array_to_string([chr(i::INT) FOR i IN range(1, len(wide) + 1)], ''))) END AS edits FROM w)
"""


def reading_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All readings with plate and display."""
    rows = table(spark, d, "plate_events").where("plate IS NOT NULL AND display IS NOT NULL")
    return rows.select("source", F.col("plate").alias("reference"), F.translate("display", " -", "").alias("hypothesis"))


_REPORT_SQL = "count(*) AS samples, sum(edits)::BIGINT AS distance, sum(length(reference))::BIGINT AS characters, count(*) FILTER (WHERE reference = hypothesis) AS exact, count(*) FILTER (WHERE hypothesis = '') AS empty, sum(edits) / nullif(sum(length(reference))::DOUBLE, 0) AS error_rate, count(*) FILTER (WHERE reference = hypothesis) / count(*)::DOUBLE AS accuracy FROM e"


@query("cer_corpus", _READ_SQL + f"SELECT {_REPORT_SQL}")
def cer_corpus(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.reading_report(reading_pairs(spark, d), "reference", "hypothesis")


@query("cer_by_source", _READ_SQL + f"SELECT source, {_REPORT_SQL} WHERE source IS NOT NULL GROUP BY source")
def cer_by_source(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.reading_report(reading_pairs(spark, d).where("source IS NOT NULL"), "reference", "hypothesis", "source")


@query(
    "cer_worst",
    _READ_SQL + "SELECT reference, hypothesis, CASE WHEN reference = '' THEN CASE WHEN hypothesis = '' THEN 0.0 ELSE 1.0 END ELSE edits / length(reference)::DOUBLE END AS error_rate FROM e WHERE reference <> hypothesis ORDER BY error_rate DESC, reference, hypothesis LIMIT 10",
)
def cer_worst(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.worst_readings(reading_pairs(spark, d), "reference", "hypothesis")


def graded(spark: SparkSession, d: str) -> DataFrame:
    rows = reading_pairs(spark, d).select(F.col("reference").alias("truth"), F.col("hypothesis").alias("raw_text"))
    return grammar.parse_plates(rows, "raw_text").select("truth", "raw_text", F.col("match.text").alias("final_text"))


_GRADED_SQL = _READ_SQL.rstrip() + ", raws AS (SELECT DISTINCT hypothesis AS raw FROM e)," + _PARSE_SQL.rstrip() + ", g AS (SELECT reference AS truth, hypothesis AS raw_text, e.edits AS raw_edits, text AS final_text FROM e LEFT JOIN parsed ON raw = hypothesis)"


@query(
    "grammar_gain",
    _GRADED_SQL
    + """, n AS (SELECT *, coalesce(final_text, '') AS f, list_distinct(regexp_extract_all(truth || coalesce(final_text, ''), '[^\\x00-\\x7F]')) AS wide FROM g),
d AS (SELECT *, levenshtein(translate(truth, array_to_string(wide, ''), array_to_string([chr(i::INT) FOR i IN range(1, len(wide) + 1)], '')), translate(f, array_to_string(wide, ''), array_to_string([chr(i::INT) FOR i IN range(1, len(wide) + 1)], ''))) AS edits FROM n),
r AS (SELECT sum(raw_edits) / sum(length(truth))::DOUBLE AS raw_error_rate, count(*) FILTER (WHERE truth = raw_text) / count(*)::DOUBLE AS raw_accuracy, sum(edits) / sum(length(truth))::DOUBLE AS error_rate, count(*) FILTER (WHERE truth = f) / count(*)::DOUBLE AS accuracy FROM d)
SELECT *, raw_error_rate - error_rate AS error_rate_gain, accuracy - raw_accuracy AS accuracy_gain, raw_error_rate - error_rate > 0 AS improved, accuracy - raw_accuracy > 0 AS accuracy_improved FROM r""",
)
def grammar_gain(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.grammar_gain(graded(spark, d), "truth", "raw_text", "final_text")


@query(
    "outcome_report",
    _GRADED_SQL
    + """, o AS (SELECT CASE WHEN raw_text = '' OR final_text IS NULL THEN 'grammar_rejected' WHEN final_text = truth THEN 'correct' WHEN raw_text = truth THEN 'grammar_corrupted' ELSE 'ocr_error' END AS outcome FROM g),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'correct') AS correct, 0 AS detection_miss, count(*) FILTER (WHERE outcome = 'ocr_error') AS ocr_error, count(*) FILTER (WHERE outcome = 'grammar_rejected') AS grammar_rejected, count(*) FILTER (WHERE outcome = 'grammar_corrupted') AS grammar_corrupted FROM o)
SELECT *, correct / total::DOUBLE AS accuracy, correct / (total - grammar_rejected)::DOUBLE AS precision FROM n""",
)
def outcome_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.outcome_report(evaluate.outcomes(graded(spark, d)))


@query(
    "crop_round_robin",
    """WITH c AS (SELECT DISTINCT bucket, crop_id FROM crops WHERE bucket IS NOT NULL AND crop_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0:' || crop_id), crop_id) AS round FROM c) SELECT bucket, crop_id, round FROM r ORDER BY round, bucket LIMIT 200""",
)
def crop_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(table(spark, d, "crops"), "bucket", "crop_id", 200)


# --- tracks ---


@query(
    "best_sightings",
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY source, track_id ORDER BY confidence DESC, frame, det_index) AS k FROM track_history WHERE source IS NOT NULL AND track_id IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence))
SELECT source, track_id, confidence, frame, det_index FROM v WHERE k = 1""",
)
def best_sightings(spark: SparkSession, d: str) -> DataFrame:
    return tracker.best_sightings(table(spark, d, "track_history"))


@query("track_durations", "SELECT source, track_id, last_frame - first_frame + 1 AS duration FROM tracks WHERE last_frame IS NOT NULL")
def track_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tracks").where("last_frame IS NOT NULL").select("source", "track_id", (F.col("last_frame") - F.col("first_frame") + 1).alias("duration"))


@query("tracked_detections", tracker_sql.TRACKS)
def tracked_detections(spark: SparkSession, d: str) -> DataFrame:
    """All recorded detections followed anew: the tracks, with their spans and hits."""
    rows = table(spark, d, "track_history").groupBy("source", "frame", "det_index").agg(F.min(F.struct("x1", "y1", "x2", "y2")).alias("b")).select("source", "frame", "det_index", "b.*")
    return tracker.track_table(tracker.follow(rows))


@query(
    "crop_refs",
    f"""WITH m AS (SELECT DISTINCT image_id, width, boxes FROM manifest), i AS (SELECT *, unnest(range(len(boxes))) AS k FROM m), x AS (SELECT image_id, k, boxes[k + 1].w * width AS wide FROM i),
b AS (SELECT image_id || '#' || k AS crop_id, image_id, trunc(wide)::INT AS width_px, {_BUCKET_SQL.format('wide')} AS bucket FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0:' || crop_id), crop_id) AS round FROM b), d AS (SELECT *, row_number() OVER (ORDER BY round, bucket) - 1 AS n FROM r QUALIFY n < 200)
SELECT crop_id, image_id, printf('%04d.png', n) AS file_name, width_px, bucket FROM d""",
)
def crop_refs(spark: SparkSession, d: str) -> DataFrame:
    """A labelling sample of the manifest's boxes."""
    return sampling.crop_refs(table(spark, d, "manifest"), 200)


# --- exports, labels and whole runs ---

_EXPORT_SQL = """
WITH r AS (SELECT DISTINCT image_id, file_name FROM manifest), k AS (SELECT *, ('0x' || md5(image_id)[1:4])::INT AS k FROM r),
p AS (SELECT *, CASE WHEN k % 10 < 7 THEN 'train' WHEN k % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM k),
f AS (SELECT DISTINCT CASE WHEN coalesce(file_name, '') <> '' THEN file_name ELSE image_id || CASE WHEN k % 3 = 0 THEN '.PNG' ELSE '.jpg' END END AS file FROM k WHERE k % 11 > 0),
w AS (SELECT *, nullif(file_name, '') AS want FROM p),
o AS (SELECT file, regexp_extract(file, '^(.*)\\.[^.]*$', 1) AS stem, list_position(['jpg', 'jpeg', 'png', 'bmp', 'webp'], lower(regexp_extract(file, '([^.]*)$', 1))) AS rank FROM f),
i AS (SELECT stem AS image_id, arg_min(file, (rank, file)) AS own FROM o WHERE rank > 0 GROUP BY 1),
j AS (SELECT split, w.image_id, CASE WHEN want IS NOT NULL THEN f.file ELSE own END AS file FROM w LEFT JOIN f ON want = f.file LEFT JOIN i ON w.image_id = i.image_id)
SELECT split, image_id, file, image_id || '.' || regexp_extract(file, '([^.]*)$', 1) AS name FROM j
"""


@query("export_images", _EXPORT_SQL)
def export_images(spark: SparkSession, d: str) -> DataFrame:
    """Where the image of every record of a tree goes, or that it is missing; splits and the files there are by a rule on a digest of the id."""
    rows = table(spark, d, "manifest").select("image_id", "file_name").distinct()
    k = F.conv(F.substring(F.md5("image_id"), 1, 4), 16, 10).cast("int")
    here = rows.where(k % 11 > 0).select(F.when(F.coalesce("file_name", F.lit("")) != "", F.col("file_name")).otherwise(F.concat("image_id", F.when(k % 3 == 0, ".PNG").otherwise(".jpg"))).alias("file"))
    return files.image_plan(rows.withColumn("split", F.when(k % 10 < 7, "train").when(k % 10 < 8, "val").otherwise("test")), here)


# Labels are the manifest's own texts, some under ids that name nothing; a reader mistakes the first 1 or 0 of every third.
_LABELLED_SQL = (
    _DETECTED_SQL
    + """, rec AS (SELECT DISTINCT image_id, boxes, file_name FROM manifest WHERE image_id IS NOT NULL),
ln AS (SELECT DISTINCT image_id, box_index, upper(trim(b.text)) AS truth FROM (SELECT image_id, box_index, boxes[box_index + 1] AS b FROM i) WHERE trim(b.text) <> ''),
lb AS (SELECT CASE WHEN h = 0 THEN 'no-' || image_id || '#' || box_index WHEN h = 1 THEN image_id || '#' || (box_index + 50) WHEN h = 2 THEN image_id || '#x' ELSE image_id || '#' || box_index END AS crop_id, truth FROM (SELECT *, ('0x' || md5(truth || image_id)[1:4])::INT % 40 AS h FROM ln)),
lq AS (SELECT crop_id, truth, regexp_extract(crop_id, '^(.*)#[^#]*$', 1) AS image_id, try_cast(regexp_extract(crop_id, '#([0-9]+)$', 1) AS INT) AS box_index FROM lb),
lj AS (SELECT lq.*, rec.file_name, boxes[lq.box_index + 1] AS box, CASE WHEN rec.image_id IS NULL THEN 'no_record' WHEN coalesce(rec.file_name, '') = '' THEN 'no_file_name' WHEN lq.box_index IS NULL OR lq.box_index >= len(boxes) THEN 'no_such_box' END AS reason FROM lq LEFT JOIN rec USING (image_id))
"""
)


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plates, skipped, labels) of labels made from the manifest's texts."""
    rows = table(spark, d, "manifest").where("image_id IS NOT NULL")
    boxes = evaluate.truth_boxes(rows.select("image_id", "width", "boxes").distinct()).where("trim(text) <> ''").select("image_id", "box_index", F.upper(F.trim("text")).alias("text")).distinct()
    h = F.conv(F.substring(F.md5(F.concat("text", "image_id")), 1, 4), 16, 10).cast("int") % 40
    number = F.when(h == 1, (F.col("box_index") + 50).cast("string")).when(h == 2, "x").otherwise(F.col("box_index").cast("string"))
    labels_ = boxes.select(F.concat(F.when(h == 0, "no-").otherwise(""), "image_id", F.lit("#"), number).alias("crop_id"), "text")
    return (*evaluate.labelled_plates(labels_, rows.select("image_id", "boxes", "file_name").distinct()), labels_)


@query("labels_skipped", _LABELLED_SQL + "SELECT crop_id, reason FROM lj WHERE reason IS NOT NULL")
def labels_skipped(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d)[1]


@query(
    "end_to_end",
    _LABELLED_SQL
    + """, bw AS (SELECT o.*, row_number() OVER (PARTITION BY image_id, box_index ORDER BY overlap DESC, det_index DESC, confidence DESC) AS r FROM o WHERE overlap >= 0.5),
bb AS (SELECT * FROM bw WHERE r = 1),
rd AS (SELECT image_id, box_index AS det_index, min(truth) AS t FROM ln GROUP BY ALL), rt AS (SELECT image_id, det_index, CASE WHEN length(t) % 3 = 0 THEN replace(replace(t, '1', 'I'), '0', 'O') WHEN length(t) % 7 = 0 THEN '' ELSE t END AS text FROM rd),
ej AS (SELECT lj.crop_id, lj.truth, bb.det_index, bb.confidence AS detection_confidence, CASE WHEN bb.det_index IS NOT NULL THEN coalesce(rt.text, '') END AS raw_text FROM lj LEFT JOIN bb ON lj.image_id = bb.image_id AND lj.box_index = bb.box_index LEFT JOIN rt ON rt.image_id = lj.image_id AND rt.det_index = bb.det_index WHERE reason IS NULL),
raws AS (SELECT DISTINCT raw_text AS raw FROM ej),"""
    + _PARSE_SQL.rstrip()
    + """, ef AS (SELECT ej.*, CASE WHEN raw_text <> '' THEN parsed.text END AS f FROM ej LEFT JOIN parsed ON raw = raw_text)
SELECT crop_id, truth, CASE WHEN det_index IS NULL THEN 'detection_miss' WHEN f IS NULL THEN 'grammar_rejected' WHEN f = truth THEN 'correct' WHEN raw_text = truth THEN 'grammar_corrupted' ELSE 'ocr_error' END AS outcome,
  raw_text, CASE WHEN det_index IS NOT NULL THEN coalesce(f, '') END AS final_text, detection_confidence FROM ef""",
)
def end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """What became of every labelled plate, with detections and readings made by rules from the truth."""
    plates, _, _ = labelled(spark, d)
    truth, detections = evaluation_tables(spark, d)
    own = truth.where("trim(text) <> ''").groupBy("image_id", F.col("box_index").alias("det_index")).agg(F.min(F.upper(F.trim("text"))).alias("t"))
    n = F.length("t")
    texts = own.select("image_id", "det_index", F.when(n % 3 == 0, F.translate("t", "10", "IO")).when(n % 7 == 0, "").otherwise(F.col("t")).alias("text"))
    return evaluate.end_to_end(plates, detections, texts)


def whole_run(spark: SparkSession, d: str) -> pipeline.Run:
    """All recorded detections followed anew, each read as its recorded track was logged; frames are a second apart."""
    rows = table(spark, d, "track_history").groupBy("source", "frame", "det_index").agg(F.min(F.struct("x1", "y1", "x2", "y2")).alias("b")).select("source", "frame", "det_index", "b.*").where("frame >= 0")
    said = table(spark, d, "plate_events").where("source IS NOT NULL AND track_id IS NOT NULL AND plate <> ''").groupBy("source", "track_id").agg(F.min("plate").alias("text"))
    of_track = table(spark, d, "track_history").where("track_id IS NOT NULL").groupBy("source", "frame", "det_index").agg(F.min("track_id").alias("track_id"))
    texts = of_track.join(said, ["source", "track_id"]).select("source", "frame", "det_index", "text", F.lit(0.9).alias("confidence"))
    frames = rows.where("source IS NOT NULL").groupBy("source").agg(F.max("frame").alias("n")).select("source", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("frame"))
    # The recorded boxes hardly overlap from frame to frame, so that one hit and one reading have to do.
    options = pipeline.Options(tracking=tracker.Settings(max_age=2, min_hits=1), min_reads=1)
    return pipeline.full_run(rows, texts, frames.withColumn("ts_us", F.col("frame").cast("long") * 1_000_000), options)


@query("run_log")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    return whole_run(spark, d).log


@query("run_counts")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return whole_run(spark, d).counts


_RESUME_SQL = (
    _SIGHTINGS_SQL
    + """, c AS (SELECT quantile_disc(ts_us, 0.5) AS mid FROM s), n AS (SELECT s.* FROM s, c WHERE ts_us > mid), j AS (SELECT plate, max(ts_us) AS last_us FROM s, c WHERE ts_us <= mid GROUP BY plate),
w AS (SELECT n.*, lag(n.ts_us) OVER (PARTITION BY plate ORDER BY n.ts_us, n.source, n.track_id NULLS FIRST, n.frame NULLS FIRST) AS prev, last_us FROM n LEFT JOIN j USING (plate))
SELECT plate, source, ts_us, track_id, frame, coalesce(ts_us - coalesce(prev, last_us) >= 300000000, true) AS accepted FROM w"""
)


@query("cooldown_resumed", _RESUME_SQL)
def cooldown_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Cooldown of the later half of all sightings, going on from the earlier half."""
    rows = runtime.Workspace(spark, "resumed").cut(sightings(spark, d), "sightings")
    mid = rows.agg(F.percentile("ts_us", 0.5)).first()[0]
    ranked = rows.agg(F.count("*").alias("n")).first().n
    if not ranked:
        return rows.withColumn("accepted", F.lit(True))
    mid = rows.where(F.col("ts_us") <= mid).agg(F.max("ts_us")).first()[0]
    seen = rows.where(F.col("ts_us") <= mid).groupBy("plate").agg(F.max("ts_us").alias("last_us"))
    return cooldown.continued(rows.where(F.col("ts_us") > mid), seen, "plate", "ts_us", ["source", "track_id", "frame"])


_CLASS_SQL = """
WITH i AS (SELECT DISTINCT image_id, dhash, contrast <= 4 AS blank, coalesce(nullif(region, 'XX'), '-') AS region FROM image_hashes WHERE image_id IS NOT NULL AND dhash IS NOT NULL AND contrast IS NOT NULL),
c AS (SELECT dhash, blank, region, count(*) AS n, min(image_id) AS class_id FROM i GROUP BY ALL),
l AS (SELECT a.dhash, a.blank, a.region, sum(b.n)::BIGINT - 1 AS links FROM c a JOIN c b ON a.blank = b.blank
  WHERE a.dhash = b.dhash OR (NOT a.blank AND bit_count(xor(a.dhash, b.dhash)) <= CASE WHEN a.region <> '-' AND b.region <> '-' AND a.region <> b.region THEN 2 ELSE 5 END) GROUP BY ALL)
SELECT image_id, class_id, links FROM i JOIN c USING (dhash, blank, region) JOIN l USING (dhash, blank, region)
"""


@query("near_dup_classes", _CLASS_SQL)
def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every picture with its class of equal looks and the number of pictures near it, without pairs."""
    return duplicates.duplicate_classes(table(spark, d, "image_hashes"))


@query("end_to_end_missed", SQL["end_to_end"].replace("detection_confidence FROM ef", "detection_confidence FROM ef WHERE det_index IS NULL ORDER BY crop_id LIMIT 10"))
def end_to_end_missed(spark: SparkSession, d: str) -> DataFrame:
    """The first plates that no detection covers."""
    return evaluate.failures(end_to_end(spark, d), text.MISSED)


@query(
    "vote_detail",
    _VOTE_SQL
    + """, x AS (SELECT source, track_id, pos, round(CASE WHEN total > 0 THEN CAST(w AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0 END, 3) AS a FROM q WHERE k = 1),
y AS (SELECT source, track_id, list(a ORDER BY pos) AS per_character, arg_min(pos, (a, pos)) - 1 AS weakest FROM x GROUP BY ALL)
SELECT source, track_id, CAST(round(CAST(round(agreement * lc / ln, 9) AS DECIMAL(12, 9)), 3) AS DOUBLE) AS confidence, round(agreement, 3) >= 1 AS unanimous, CASE WHEN round(agreement, 3) < 1 THEN weakest END AS weakest_position, per_character
FROM v JOIN b USING (source, track_id) JOIN y USING (source, track_id) WHERE b.k = 1""",
)
def vote_detail(spark: SparkSession, d: str) -> DataFrame:
    """How sure each vote is, as a whole and at each character."""
    return vote.vote(plate_reads(spark, d), ["source", "track_id"]).select("source", "track_id", "confidence", "unanimous", F.col("weakest_position").cast("long").alias("weakest_position"), "per_character")


@query("plate_hints", "SELECT DISTINCT display, nullif(regexp_extract(upper(display), '^\\s*([A-ZÄÖÜ]{1,3})\\s*[-–—.\\s]\\s*[A-Z]', 1), '') AS hint FROM plate_events WHERE display IS NOT NULL")
def plate_hints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "plate_events").where("display IS NOT NULL").select("display", text.district_hint(F.col("display")).alias("hint")).distinct()


@query("attribution", "SELECT source_tag, licence, url, NOT regexp_matches(upper(licence), '\\b(ND|NC)\\b') AS redistributable FROM roboflow_sources")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    from sightline.plans.dataset import attribution

    return attribution(table(spark, d, "roboflow_sources"))


@query(
    "label_errors",
    """WITH x AS (SELECT DISTINCT image_id, boxes FROM manifest WHERE image_id IS NOT NULL AND len(boxes) > 0), k AS (SELECT *, ('0x' || md5(image_id)[1:4])::INT % 6 AS k, len(boxes) AS n FROM x)
SELECT image_id, n, CASE k WHEN 0 THEN 'line 2: expected 5 fields, got 3' WHEN 1 THEN 'line 2: not a number' WHEN 2 THEN 'line 2: box outside the image' END AS error, CASE WHEN k = 3 THEN 1 ELSE 0 END AS dropped, n + CASE WHEN k >= 4 THEN 1 ELSE 0 END AS boxes FROM k""",
)
def label_errors(spark: SparkSession, d: str) -> DataFrame:
    """Label files with a second line by a rule: too short, no number, no size, of another class, good, good and longer; before it a blank one counts."""
    rows = table(spark, d, "manifest").where("image_id IS NOT NULL AND size(boxes) > 0").select("image_id", "boxes").distinct()
    k = F.conv(F.substring(F.md5("image_id"), 1, 4), 16, 10).cast("int") % 6
    line = F.when(k == 0, "0 0.5 0.5").when(k == 1, "0 a 0.5 0.1 0.1").when(k == 2, "0 0.5 0.5 0 0.1").when(k == 3, "7 0.5 0.5 0.1 0.1").when(k == 4, "0 0.5 0.5 0.1 0.1").otherwise("0  0.5 0.5\t0.1 0.1 0.9")
    parsed = rows.select("image_id", F.size("boxes").alias("n"), labels.parse_label(F.concat(F.lit("\n"), line, F.lit("\r\n"), files.label_body(F.col("boxes"))), keep=(0,)).alias("p"))
    return parsed.select("image_id", "n", "p.error", "p.dropped", F.size("p.boxes").alias("boxes"))
