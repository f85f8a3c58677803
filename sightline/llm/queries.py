"""Registered queries of the training-data operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import identity
from sightline.llm import balanced_sample, cross_split, entity_splits, frozen_sample, leak_search, match_groups, residue, source_mix, top_n
from sightline.plans.core_queries import CLIP_SQL, SUFFIX_SQL
from sightline.runtime import Workspace, table

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


# --- 1: a sample that stays as data grows ---

_P1_SQL = """
WITH f AS (SELECT {id}, min(batch_no) AS batch_no FROM crops WHERE {id} IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1),
r AS (SELECT {id}, batch_no, row_number() OVER (PARTITION BY batch_no ORDER BY md5('label:' || {id}), {id}) AS rank, count(*) OVER (PARTITION BY batch_no) AS size FROM f)
SELECT {id}, batch_no FROM r WHERE rank <= (size + 9) // 10
"""


@query("p1_sample", _P1_SQL.format(id="crop_id"))
def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return frozen_sample.frozen_sample(table(spark, d, "crops"), "crop_id", "batch_no", Fraction(1, 10))


@query("p1_image_sample", _P1_SQL.format(id="image_id"))
def p1_image_sample(spark: SparkSession, d: str) -> DataFrame:
    return frozen_sample.frozen_sample(table(spark, d, "crops"), "image_id", "batch_no", Fraction(1, 10))


# --- 2: samples of target shares ---

_P2_SQL = """
WITH u AS (SELECT DISTINCT crop_id, CASE WHEN width_px > 0 THEN CASE WHEN width_px < 32 THEN 'tiny (<32px)' WHEN width_px < 64 THEN 'small (32-64px)'
  WHEN width_px < 128 THEN 'medium (64-128px)' ELSE 'large (>=128px)' END ELSE bucket END AS bucket FROM crops WHERE crop_id IS NOT NULL),
s AS (SELECT bucket, count(*) AS available FROM u GROUP BY 1),
t AS (SELECT plan_id, bucket, greatest(CAST(min_rows AS DOUBLE), CAST(target_pct AS DOUBLE) * sample_rows / 100) AS wanted FROM sample_targets)
"""


@query("p2_found", _P2_SQL + "SELECT plan_id, bucket FROM t LEFT JOIN s USING (bucket) WHERE coalesce(available, 0) < wanted")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = balanced_sample.balanced_samples(table(spark, d, "crops"), table(spark, d, "sample_targets"))
    return report.where("short").select("plan_id", "bucket")


@query("p2_sample")
def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return balanced_sample.balanced_samples(table(spark, d, "crops"), table(spark, d, "sample_targets"))[0]


# Quotas are whole numbers in this data, so each bucket gets just its quota, or all there is.
@query(
    "p2_report",
    _P2_SQL
    + ", n AS (SELECT plan_id, bucket, wanted, coalesce(available, 0) AS available FROM t LEFT JOIN s USING (bucket)) SELECT *, CAST(least(available, wanted) AS BIGINT) AS drawn, least(available, wanted) - wanted AS residual, available < wanted AS short FROM n",
)
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return balanced_sample.balanced_samples(table(spark, d, "crops"), table(spark, d, "sample_targets"))[1]


# --- 5: the best detections of every track ---


@query(
    "p5_found",
    """
WITH v AS (SELECT DISTINCT source, track_id, frame, det_index, confidence FROM track_history WHERE track_id IS NOT NULL AND confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, track_id ORDER BY confidence DESC, frame, det_index) AS rank FROM v)
SELECT source, track_id, frame, det_index FROM r WHERE rank <= 3
""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n.top_n(table(spark, d, "track_history"), ["source", "track_id"], "confidence", ["frame", "det_index"], 3, 0.0, 1.0)
    return best.select("source", "track_id", "frame", "det_index")


# --- 4: pairwise matches to groups ---


@query(
    "p4_found",
    """
WITH RECURSIVE e AS (SELECT DISTINCT left_id AS a, right_id AS b FROM duplicate_pairs WHERE left_id <> right_id AND distance BETWEEN 0 AND 5),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS image_id, a AS seen FROM d UNION SELECT r.image_id, d.b FROM r JOIN d ON r.seen = d.a)
SELECT min(seen) AS group_id, image_id FROM r GROUP BY image_id
""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "duplicate_pairs").where("distance BETWEEN 0 AND 5")
    return match_groups.match_groups(links, "left_id", "right_id").select("group_id", F.col("id").alias("image_id"))


# --- 6: splits that keep entities together ---

#: Batches in which the manifest is taken, by time of ingest.
P6_BATCHES = 2


def image_keys(spark: SparkSession, d: str) -> DataFrame:
    """Manifest images with what ties them: split_group, and id_prefix with the clip."""
    prefixes = [r.id_prefix for r in table(spark, d, "roboflow_sources").select("id_prefix").where("id_prefix IS NOT NULL").distinct().limit(1001).collect()]
    if len(prefixes) > 1000:
        raise ValueError("the source registry is a small table; this one isn't")
    prefix, stem = identity.split_export_id(F.col("image_id"), prefixes)
    clip = F.concat(F.lit("c|"), prefix, F.lit("|"), identity.clip_id(stem))
    group = F.concat(F.lit("g|"), F.col("split_group"))
    return table(spark, d, "manifest").select(F.col("image_id").alias("record_id"), F.array(group, clip).alias("keys"), "ingested_at")


def entity_table(spark: SparkSession, d: str) -> entity_splits.EntitySplits:
    """The manifest's images, taken in batches by time of ingest."""
    rows = image_keys(spark, d)
    targets = {r.split: r.target_share for r in table(spark, d, "split_targets").limit(101).collect()}
    if len(targets) > 100:
        raise ValueError("the splits are a small table; this one isn't")
    store = entity_splits.EntitySplits(spark, Workspace(spark, "entity-splits").path, targets)
    at = F.unix_micros("ingested_at")
    q = rows.select(F.percentile_approx(at, [i / P6_BATCHES for i in range(1, P6_BATCHES)], 1000).alias("q")).first().q or []
    edges = [None, *sorted(set(q)), None]
    for lo, hi in zip(edges, edges[1:]):
        here = F.lit(True) if hi is None else at <= hi
        if lo is not None:
            here = here & (at > lo)
        store.apply(rows.where(F.coalesce(here, F.lit(lo is None))))
    return store


_P6_SQL = f"""
WITH RECURSIVE m AS (SELECT DISTINCT image_id, split_group FROM manifest WHERE image_id IS NOT NULL),
s AS (SELECT m.*, id_prefix, regexp_replace(regexp_extract(image_id[length(id_prefix) + 1:], '^(?:train|valid|val|test)-(.+)$', 1), '{SUFFIX_SQL}', '') AS base
      FROM m LEFT JOIN (SELECT DISTINCT id_prefix FROM roboflow_sources) p ON starts_with(image_id, id_prefix) AND regexp_matches(image_id[length(id_prefix) + 1:], '^(?:train|valid|val|test)-.+$')),
k AS (SELECT *, {CLIP_SQL} AS clip FROM s),
n AS (SELECT image_id, 'g|' || split_group AS node FROM k WHERE split_group IS NOT NULL UNION SELECT image_id, 'c|' || id_prefix || '|' || clip FROM k WHERE clip IS NOT NULL),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM n a JOIN n b USING (image_id)),
r AS (SELECT DISTINCT node, node AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS comp FROM r GROUP BY node),
i AS (SELECT DISTINCT image_id, comp FROM n JOIN c USING (node))
SELECT entity_id, image_id FROM (SELECT min(image_id) OVER (PARTITION BY comp) AS entity_id, image_id, count(*) OVER (PARTITION BY comp) AS k FROM i) WHERE k > 1
"""


@query("p6_found", _P6_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_table(spark, d).entities().select("entity_id", F.col("record_id").alias("image_id"))


@query("p6_together", _P6_SQL.replace("SELECT entity_id, image_id FROM (", "SELECT entity_id, count(*) AS images, 1 AS splits FROM (") + " GROUP BY entity_id")
def p6_together(spark: SparkSession, d: str) -> DataFrame:
    """Each set of images that must stay together: its size, and in how many splits it lies."""
    return entity_table(spark, d).entities().groupBy("entity_id").agg(F.count("*").alias("images"), F.count_distinct("split").cast("int").alias("splits"))


@query("p6_splits")
def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every manifest image with its split, and the crops that go with it."""
    images = entity_table(spark, d).records().select(F.col("record_id").alias("image_id"), "split")
    crops = table(spark, d, "crops").where("image_id IS NOT NULL AND crop_id IS NOT NULL").groupBy("image_id").agg(F.count_distinct("crop_id").alias("crops"))
    return images.join(crops, "image_id", "left").select("image_id", "split", F.coalesce("crops", F.lit(0)).alias("crops"))


@query("p6_report")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return entity_table(spark, d).report()


# --- 7: the same picture across splits ---

_P7_SQL = """
WITH i AS (SELECT DISTINCT image_id, dhash, contrast <= 4 AS blank, nullif(region, 'XX') AS region, CASE lower(trim(split)) WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE lower(trim(split)) END AS s
  FROM image_hashes WHERE image_id IS NOT NULL AND dhash IS NOT NULL AND contrast IS NOT NULL AND split IS NOT NULL),
p AS (SELECT t.image_id AS a, h.image_id AS b, bit_count(xor(t.dhash, h.dhash)) AS bits, t.region AS ra, h.region AS rb, t.blank
  FROM i t JOIN i h ON t.s = 'train' AND h.s IN ('val', 'test') AND t.image_id <> h.image_id AND t.blank = h.blank),
d AS (SELECT left_id AS a, right_id AS b, CASE lower(trim(left_split)) WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE lower(trim(left_split)) END AS s1,
  CASE lower(trim(right_split)) WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE lower(trim(right_split)) END AS s2 FROM duplicate_pairs WHERE left_id <> right_id AND distance BETWEEN 0 AND 5)
SELECT least(a, b) AS left_id, greatest(a, b) AS right_id FROM p WHERE bits = 0 OR (NOT blank AND bits <= CASE WHEN ra IS NOT NULL AND rb IS NOT NULL AND ra <> rb THEN 2 ELSE 5 END)
UNION SELECT least(a, b), greatest(a, b) FROM d WHERE (s1 = 'train' AND s2 IN ('val', 'test')) OR (s2 = 'train' AND s1 IN ('val', 'test'))
"""


@query("p7_found", _P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.cross_split_pairs(table(spark, d, "image_hashes"), table(spark, d, "duplicate_pairs"))


_P7_REPORT_SQL = _P7_SQL[: _P7_SQL.rindex("SELECT least(a, b) AS left_id")].rstrip() + """,
x AS (SELECT t.image_id AS a, h.image_id AS b, h.s AS split FROM i t JOIN i h ON t.s = 'train' AND h.s IN ('val', 'test') AND t.image_id <> h.image_id AND t.blank = h.blank
  WHERE t.dhash = h.dhash OR (NOT t.blank AND bit_count(xor(t.dhash, h.dhash)) <= CASE WHEN t.region IS NOT NULL AND h.region IS NOT NULL AND t.region <> h.region THEN 2 ELSE 5 END)),
y AS (SELECT a, b, split FROM x UNION SELECT a, b, s2 FROM d WHERE s1 = 'train' AND s2 IN ('val', 'test') UNION SELECT b, a, s1 FROM d WHERE s2 = 'train' AND s1 IN ('val', 'test')),
n AS (SELECT b AS image_id, split, count(*) AS pairs FROM y GROUP BY ALL),
k AS (SELECT image_id, min(source_tag) AS tag FROM image_hashes WHERE image_id IS NOT NULL GROUP BY 1),
r AS (SELECT n.*, coalesce(k.tag, (SELECT arg_max(source_tag, length(id_prefix)) FROM roboflow_sources WHERE id_prefix IS NOT NULL AND source_tag IS NOT NULL AND starts_with(n.image_id, id_prefix))) AS source_tag FROM n LEFT JOIN k USING (image_id))
SELECT split, source_tag, sum(pairs)::BIGINT AS pairs, count(*) AS images FROM r GROUP BY ALL"""


@query("p7_report", _P7_REPORT_SQL)
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    hashes = table(spark, d, "image_hashes")
    ends = cross_split.cross_split_ends(hashes, table(spark, d, "duplicate_pairs"))
    return cross_split.coverage(ends, hashes, table(spark, d, "roboflow_sources"))


# --- 8: evaluation texts in the corpus ---

_P8_SQL = r"""
WITH b AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM test_items WHERE text IS NOT NULL),
c AS (SELECT kind, id, regexp_replace(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{206F}\x{FEFF}]', '', 'g') AS t FROM b),
h AS (SELECT kind, id, regexp_replace(t, '([\p{L}\p{N}_])(?:-|\\-)[ \t]*\r?\n[ \t]*(?:%+[ \t]*)?([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM c),
m AS (SELECT kind, id, regexp_replace(regexp_replace(t, '\\[a-zA-Z]*cite[a-zA-Z]*\*?\s*(?:\[[^\]\\]*\]\s*)*\{[^{}]*\}', ' ', 'g'), '\\(?:begin|end)\s*\{[^{}]*\}', ' ', 'g') AS t FROM h),
n AS (SELECT kind, id, regexp_replace(regexp_replace(t, '\\[a-zA-Z@]+\*?(?:\[[^\]\\\n]*\])?\{', '', 'g'), '\\[a-zA-Z@]+\*?', ' ', 'g') AS t FROM m),
w AS (SELECT kind, id, regexp_extract_all(lower(regexp_replace(regexp_replace(t, '[{}]|\\-', '', 'g'), '([\p{L}\p{N}])[-‐‑]([\p{L}\p{N}])', '\1\2', 'g')), '[\p{L}\p{N}]+') AS ws FROM n),
g AS (SELECT kind, id, array_to_string(ws[i:i + 11], ' ') AS run FROM (SELECT *, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (run) WHERE d.kind = 'd' AND i.kind = 'i'
"""


@query("p8_found", _P8_SQL)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_search.leaked_items(table(spark, d, "documents"), table(spark, d, "test_items"))


@query("p8_steps")
def p8_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many windows, or places of them, each step of the search leaves."""
    return leak_search.search(table(spark, d, "documents"), table(spark, d, "test_items")).steps


@query(
    "p8_report",
    _P8_SQL[: _P8_SQL.rindex("SELECT DISTINCT d.id")].rstrip()
    + """, l AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (run) WHERE d.kind = 'd' AND i.kind = 'i'), t AS (SELECT item_id, min(suite) AS suite FROM test_items WHERE item_id IS NOT NULL GROUP BY 1)
SELECT suite, count(DISTINCT t.item_id) AS items, count(DISTINCT l.item_id) AS leaked, count(DISTINCT doc_id) AS documents FROM t LEFT JOIN l USING (item_id) GROUP BY suite""",
)
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and leaking documents of each suite."""
    items = table(spark, d, "test_items").where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("suite").alias("suite"))
    found = p8_found(spark, d).join(items, "item_id", "right")
    return found.groupBy("suite").agg(F.count_distinct("item_id").alias("items"), F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked"), F.count_distinct("doc_id").alias("documents"))


# --- 9: sources mixed to target shares ---


def mixture(spark: SparkSession, d: str) -> source_mix.Mix:
    return source_mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).report.where("short").select("source")


@query("p9_report")
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).report


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).documents()


# --- 10: template residue and error pages ---


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


@query("p10_report")
def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents found, by source and reason."""
    return residue.residue(table(spark, d, "documents")).groupBy("source", "reason").agg(F.count("*").alias("documents"))


@query("p10_evidence")
def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Rows found by each reason and set of evidence."""
    return residue.evidence(table(spark, d, "documents")).groupBy("reason", "bare", "apart", "hosts", "same", "phrase").agg(F.count("*").alias("documents"))


@query("p10_kept")
def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay."""
    return residue.without_residue(table(spark, d, "documents")).select("doc_id")
