import datetime as dt

from pyspark.sql import functions as F

from sightline.operators.sessions import SessionTable, sessionize
from sightline.operators.tracker import Settings
from sightline.plans import pipeline
from sightline.streaming import tracks as streaming

SEEN = range(2, 12)
READS = {4: "MH12A81234", 5: "MH12AB1234", 6: "MH12AB1Z34", 7: "MH12AB1234"}


def detections(source, shift=0):
    return [(source, f + shift, 0, 0.2 + 0.005 * f, 0.55, 0.32 + 0.005 * f, 0.6) for f in SEEN]


def tables(spark, sources=("cam",), passes=(0,), frames=80):
    det = [x for s in sources for p in passes for x in detections(s, p)]
    texts = [(s, f + p, 0, READS[f], 0.9) for s in sources for p in passes for f in READS]
    times = [(s, f, 1_000_000 * f) for s in sources for f in range(frames)]
    return (
        spark.createDataFrame(det, "source string, frame int, det_index int, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame(texts, "source string, frame int, det_index int, text string, confidence double"),
        spark.createDataFrame(times, "source string, frame int, ts_us long"),
    )


def test_one_vehicle_one_row(spark):
    log, stats = pipeline.run(*tables(spark))
    rows = log.collect()
    assert [(r.plate, r.display, r.region, r.edits, r.track_id, r.frame, r.source) for r in rows] == [("MH12AB1234", "MH 12 AB 1234", "IN", 0, 1, 2, "cam")]
    assert rows[0].ts_us == 27_000_000  # the frame after which the track was no more
    assert tuple(stats.first()) == (1, 0, 0, 0, 1)


def test_second_passage_within_the_cooldown_is_suppressed(spark):
    log, stats = pipeline.run(*tables(spark, passes=(0, 40)))
    assert log.count() == 1
    assert tuple(stats.first()) == (2, 0, 0, 1, 1)
    log, stats = pipeline.run(*tables(spark, passes=(0, 40)), pipeline.Options(cooldown_us=1_000_000))
    assert log.count() == 2


def test_too_few_reads_and_rejects(spark):
    det, texts, times = tables(spark)
    assert tuple(pipeline.run(det, texts.where("frame = 5"), times)[1].first()) == (1, 1, 0, 0, 0)
    assert tuple(pipeline.run(det, texts.withColumn("text", F.lit("!!")), times)[1].first()) == (1, 0, 1, 0, 0)
    assert tuple(pipeline.run(det, texts, times, pipeline.Options(region="PL"))[1].first()) == (1, 0, 1, 0, 0)
    assert tuple(pipeline.run(det.where("frame < 4"), texts, times)[1].first()) == (0, 0, 0, 0, 0)
    stills = pipeline.Options().for_stills()
    assert pipeline.run(det.where("frame = 5"), texts, times, stills)[0].count() == 1
    assert pipeline.run(det.limit(0), texts, times)[0].count() == 0


def frame_rows(sources, frames, passes=(0,)):
    t = dt.datetime(2024, 1, 1)
    rows = []
    for s in sources:
        at = {x[1]: x for p in passes for x in detections(s, p)}
        for f in frames:
            boxes = []
            if f in at:
                _, _, _, *box = at[f]
                text = next((READS[f - p] for p in passes if f - p in READS and f in at), None)
                boxes = [(*box, text, 0.9)]
            rows.append((s, f, t + dt.timedelta(seconds=f), boxes))
    return rows


FRAMES = "source string, frame int, ts timestamp, boxes array<struct<x1: double, y1: double, x2: double, y2: double, text: string, confidence: double>>"


def put(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")


def drain(q):
    q.processAllAvailable()
    q.stop()


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    src = tmp_path / "in"
    stream = lambda: spark.readStream.schema(FRAMES).option("recursiveFileLookup", "true").parquet(str(src)).withWatermark("ts", "5 seconds")
    log = streaming.PlateLog(spark, str(tmp_path / "log"), pipeline.Options(tracking=Settings()))
    sources, passes = ("cam", "gate"), (0, 40)
    put(spark, frame_rows(sources, range(0, 9), passes), FRAMES, src, 1)
    drain(streaming.stream_log(stream(), log, str(tmp_path / "cp")))
    assert log.rows().count() == 0
    put(spark, frame_rows(sources, range(9, 35), passes), FRAMES, src, 2)
    drain(streaming.stream_log(stream(), log, str(tmp_path / "cp")))
    first = log.rows().collect()
    assert {r.plate for r in first} == {"MH12AB1234"}
    put(spark, frame_rows(sources, range(35, 80), passes), FRAMES, src, 3)
    drain(streaming.stream_log(stream(), log, str(tmp_path / "cp")))
    want = pipeline.run(*tables(spark, sources, passes))[0].collect()
    key = lambda r: (r.plate, r.display, r.region, r.confidence, r.edits, r.track_id, r.frame, r.source)
    assert sorted(map(key, log.rows().collect())) == sorted(map(key, want))
    again = log._before(1 << 62)[-1]
    before = sorted(map(key, log.rows().collect()))
    empty = spark.createDataFrame([], streaming.READS)
    log(empty, again + 1)
    assert sorted(map(key, log.rows().collect())) == before


def test_stream_cooldown_and_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 0), ("a", 60), ("a", 400), ("b", 0)]
    schema = "plate string, ts timestamp, n int"
    put(spark, [(p, t + dt.timedelta(seconds=s), 1) for p, s in rows], schema, tmp_path / "in", 1)
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streaming.cooled(stream().withWatermark("ts", "1 minute"), 300_000_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start()
    drain(q)
    base = int(t.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    got = {(r.plate, (r.ts_us - base) // 1_000_000): r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): True, ("a", 60): False, ("a", 400): True, ("b", 0): True}

    store = SessionTable(spark, str(tmp_path / "table"), ["plate"])
    sightings = stream().withColumn("ts_us", F.unix_micros("ts"))
    drain(streaming.stream_sessions(sightings, store, str(tmp_path / "cp2")))
    put(spark, [("a", t + dt.timedelta(seconds=200), 1)], schema, tmp_path / "in", 2)
    drain(streaming.stream_sessions(sightings, store, str(tmp_path / "cp2")))
    one = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumn("ts_us", F.unix_micros("ts"))
    want = sessionize(one, ["plate"])
    assert sorted(map(tuple, store.sessions(want.schema).collect())) == sorted(map(tuple, want.collect()))


def test_a_full_run_counts_and_goes_on_from_a_journal(spark):
    det, texts, times = tables(spark, passes=(0, 40))
    done = pipeline.full_run(det, texts, times)
    c = done.counts.first().asDict()
    live = c["ocr_calls"]  # confirmed tracks in every frame that they are alive in
    assert (c["frames"], c["detections"], c["tracks_completed"], c["suppressed"], c["logged"]) == (80, 20, 2, 1, 1) and live > 10
    short = pipeline.full_run(det, texts, times, max_frames=40)
    assert short.counts.first().frames == 40 and short.counts.first().tracks_completed == 1
    stopped = pipeline.full_run(det, texts, times, stop=spark.createDataFrame([("cam", 39), ("other", 1)], "source string, frame int"))
    assert stopped.counts.first() == short.counts.first()
    at = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    journal = spark.createDataFrame([("MH12AB1234", at + dt.timedelta(seconds=5), 0), ("MH12AB1234", at, 1)], "plate string, ts timestamp, line long")
    resumed = pipeline.full_run(det, texts, times, journal=journal)
    assert resumed.log.count() == 0 and resumed.stats.first().suppressed == 2
    old = journal.withColumn("ts", F.lit(at - dt.timedelta(days=1)))
    assert pipeline.full_run(det, texts, times, journal=old).log.count() == 1


def test_log_gathers_and_forgets(spark, tmp_path):
    log = streaming.PlateLog(spark, str(tmp_path / "log"), pipeline.Options(min_reads=1), keep="1 hour")
    track = lambda i, s, text: ("cam", i, 1, 9, s * 1_000_000, 3, [(text, 0.9)])
    take = lambda n, *rows: log(spark.createDataFrame(list(rows), streaming.READS), n)
    take(0, track(1, 0, "MH12AB1234"), track(2, 10, "PO2427W"))
    take(1, track(3, 100, "MH12AB1234"))
    log.compact()
    take(1, track(9, 5000, "MH12AB1234"))  # a trigger that was gathered runs again
    take(2, track(4, 200, "MH12AB1234"), track(5, 20_000, "PO2427W"))
    assert sorted((r.plate, r.track_id) for r in log.rows().collect()) == [("MH12AB1234", 1), ("PO2427W", 2), ("PO2427W", 5)]
    take(3, track(6, 30_000, "PO2427W"))
    assert [r.plate for r in log._last(4).collect()] == ["PO2427W"]  # the other was last seen long before
    log.compact()
    assert log.rows().count() == 4 and log._folders() == [f"{tmp_path}/log/rows/upto-{3:012d}"]
