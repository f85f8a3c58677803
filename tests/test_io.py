import datetime as dt
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sightline import runtime
from sightline.operators import stats
from sightline.sinks import files
from sightline.sources import frames, journal, labels


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (h * (w + 1)))) + chunk(b"IEND", b"")


BODIES = {
    "one": ("0 0.5 0.5 0.1 0.2", 1, 0, None), "blank": ("\n0 0.5 0.5 0.1 0.2\r\n\n", 1, 0, None), "more": ("0 .5 .5 .1 .2 0.99", 1, 0, None), "float": ("0.0 .5 .5 .1 .2", 1, 0, None), "dropped": ("0 .5 .5 .1 .2\n7 9 9 9 9", 1, 1, None),
    "short": ("0 .5 .5 .1 .2\n0 .5 .5", 1, 0, "line 2: expected 5 fields, got 3"), "words": ("0 a b c d", 0, 0, "line 1: not a number"), "zero": ("0 .5 .5 0 .2", 0, 0, "line 1: box outside the image"), "empty": ("", 0, 0, None),
}


def test_parse_label(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in BODIES.items()] + [("null", None)], "k string, body string")
    got = {r.k: r.p for r in df.select("k", labels.parse_label(F.col("body"), (0,)).alias("p")).collect()}
    for k, (_, n, dropped, error) in BODIES.items():
        assert (len(got[k].boxes), got[k].dropped, got[k].error) == (n, dropped, error), k
    assert got["null"] is None


def test_header_sizes():
    assert labels.header_size(png(31, 17)) == (31, 17)
    assert labels.header_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert labels.header_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8)) == (7, 8)
    assert labels.header_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 9, 10) + b"\0" * 9) == (10, 9)
    assert labels.header_size(b"nothing") is None
    assert labels.header_size(b"\xff\xd8") is None


def tree(root):
    for d, stem, body in [("train", "video1_1", "0 .5 .5 .1 .2"), ("valid", "video1_2", "0 .5 .5 .1 .2\n"), ("test", "still", ""), ("test", "bad", "0 x"), ("train", "lone", None)]:
        (root / d / "images").mkdir(parents=True, exist_ok=True)
        (root / d / "labels").mkdir(exist_ok=True)
        (root / d / "images" / f"{stem}.png").write_bytes(png(20, 10))
        if body is not None:
            (root / d / "labels" / f"{stem}.txt").write_text(body)
    (root / "train" / "images" / "notes.md").write_text("x")


def test_export_tree(spark, tmp_path):
    tree(tmp_path)
    got = labels.export_tree(spark, str(tmp_path), "src", "IN", "p-")
    recs = {r.image_id: r for r in got.records.collect()}
    assert set(recs) == {"p-train-video1_1", "p-valid-video1_2", "p-test-still"}
    one = recs["p-train-video1_1"]
    assert (one.width, one.height, one.split_group, one.file_name, one.source, one.meta) == (20, 10, "p-video1", "train/images/video1_1.png", "src", {"upstream_split": "train"})
    assert recs["p-valid-video1_2"].split_group == "p-video1"
    assert recs["p-test-still"].split_group == "p-test-still"
    assert one.boxes[0].region == "IN"
    assert [r.image_id for r in got.unlabelled.collect()] == ["p-train-lone"]
    assert [r.image_id for r in got.bad.collect()] == ["p-test-bad"]
    assert tuple(got.report().first()) == (3, 2, 1, 1, 0)
    with pytest.raises(Exception, match="p-test-bad: line 1"):
        labels.export_tree(spark, str(tmp_path), "src", "IN", "p-", strict=True).records.collect()
    with pytest.raises(FileNotFoundError):
        labels.export_tree(spark, str(tmp_path / "none"), "src")


MANIFEST = labels.MANIFEST


def test_manifest_round_trip(spark, tmp_path):
    rows = [("a", 10, 20, [(0.5, 0.5, 0.1, 0.2, "T", "IN"), (0.5, 0.5, 0.1, 0.2, None, "XX")], "a.png", "g", "s", {"z": "1", "b": "2"}), ("b", 1, 2, [], None, None, None, {}), ("c", 1, 2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, MANIFEST)
    assert files.write_manifest(df, str(tmp_path / "m")) == 3
    lines = sorted((r.value for r in spark.read.text(str(tmp_path / "m")).collect()), key=lambda x: x[x.index('"image_id"') :])
    assert lines[0].startswith('{"boxes":[{"cx":0.5,"cy":0.5,"h":0.2,"region":"IN","text":"T","w":0.1},{"cx"')
    assert '"group":"g"' in lines[0] and '"meta":{"b":"2","z":"1"}' in lines[0]
    back = {r.image_id: r for r in labels.read_manifest(spark, str(tmp_path / "m"), unique=True).collect()}
    assert back["a"].asDict(True) == df.where("image_id = 'a'").first().asDict(True)
    assert (back["c"].boxes, back["c"].meta) == ([], {})
    with pytest.raises(ValueError, match="duplicate image_id"):
        files.write_manifest(df.unionByName(df), str(tmp_path / "n"))
    (tmp_path / "bad").write_text(lines[0] + "\n\nnot json\n")
    with pytest.raises(Exception, match="malformed manifest line: not json"):
        labels.read_manifest(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "twice").write_text(lines[0] + "\n" + lines[0] + "\n")
    with pytest.raises(ValueError, match="duplicate image_id"):
        labels.read_manifest(spark, str(tmp_path / "twice"), unique=True)


def test_label_tree_on_disk(spark, tmp_path):
    rows = [("a", 10, 20, [(0.0, 0.5, 0.2, 1.0, None, "XX")], None, None, None, {}, "train"), ("b", 10, 20, [], None, None, None, {}, "val")]
    df = spark.createDataFrame(rows, MANIFEST + ", split string")
    files.write_tree(df, str(tmp_path))
    assert (tmp_path / "labels/train/a.txt").read_text() == "0 0.050000 0.500000 0.100000 1.000000\n"
    assert (tmp_path / "labels/val/b.txt").read_text() == ""
    assert (tmp_path / "labels/test").is_dir()
    text = (tmp_path / "data.yaml").read_text()
    assert "train: images/train" in text and "  0: license_plate" in text
    with pytest.raises(ValueError):
        files.write_data_yaml(str(tmp_path), str(tmp_path / "data.yaml"), ("x",), keep_original=True)
    assert len(stats.export_fingerprint(files.label_tree(df))) == 64
    have = spark.createDataFrame([("a.png",)], "file string")
    assert [r.image_id for r in files.missing_images(df, have).collect()] == ["b"]


def events(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    rows = [("AB12", t, "AB 12", "IN", 0.5, 0, 1, 2, "cam", None), ("Ü<&>9", t, "Ü", None, None, None, None, None, None, "c.png")]
    return spark.createDataFrame(rows, journal.EVENT)


def test_journal_and_workbook(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = [r.line for r in files.journal_lines(events(spark)).collect()]
    path.write_text("\n".join(lines) + '\n\n{"plate": "TO')
    got = journal.read_journal(spark, str(path)).orderBy("line").collect()
    assert [(r.plate, r.ts, r.region) for r in got] == [("AB12", dt.datetime(2024, 1, 2, 3, 4, 5, 678), "IN"), ("Ü<&>9", dt.datetime(2024, 1, 2, 3, 4, 5, 678), "XX")]
    assert {r.plate for r in journal.accepted_times(journal.read_journal(spark, str(path))).collect()} == {"AB12", "Ü<&>9"}
    book = tmp_path / "log.xlsx"
    assert files.recover(spark, str(path), str(book)) == 2
    rows = journal.read_workbook(str(book))
    assert [r["Plate"] for r in rows] == ["AB12", "Ü<&>9"]
    assert rows[0]["Confidence"] == 0.5 and rows[1]["Crop"] == "c.png" and rows[1]["Track"] is None
    assert abs(rows[0]["Timestamp"] - 45293.1278) < 1e-3
    path.write_text(lines[0] + "\nbroken\n" + lines[1] + "\n")
    with pytest.raises(Exception, match="corrupt journal line: broken"):
        journal.read_journal(spark, str(path)).collect()
    assert journal.read_journal(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="nothing to recover"):
        files.recover(spark, str(tmp_path / "none"), str(book))
    with pytest.raises(OSError, match="journal holds every event"):
        files.write_workbook(str(tmp_path / "no" / "x.xlsx"), [])
    assert files.log_rows(events(spark).drop("display")).columns == [c for c, _, _ in files.COLUMNS]


def test_labels_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"labels": {"x#0": " ab1 ", "y#0": " "}}')
    (tmp_path / "b.json").write_text('{"x#0": "q"}')
    assert [tuple(r) for r in labels.read_labels(spark, str(tmp_path / "a.json")).collect()] == [("x#0", "AB1")]
    assert [tuple(r) for r in labels.read_labels(spark, str(tmp_path / "b.json")).collect()] == [("x#0", "Q")]


def test_sources(spark, tmp_path):
    kinds = {0: "camera", "12": "camera", "rtsp://x/y": "stream", "https://x": "stream", "a.JPG": "stills", "a.mp4": "video"}
    assert {k: frames.open_source(k).kind for k in kinds} == kinds
    assert frames.open_source("d", is_dir=True).still
    assert frames.open_source(0).live
    for n in ("b.png", "a.png"):
        (tmp_path / n).write_bytes(png(4, 3))
    (tmp_path / "aa.png").write_bytes(b"broken")
    (tmp_path / "x.txt").write_text("x")
    got = [(r.source.rsplit("/", 1)[1], r.frame, r.width) for r in frames.stills(spark, str(tmp_path)).orderBy("frame").collect()]
    assert got == [("a.png", 0, 4), ("b.png", 2, 4)]
    live = spark.createDataFrame([("c", 0, 1, 9), ("c", 1, 2, 9), ("c", 2, 3, 12)], "source string, frame int, ts_us long, read_us long")
    assert {(r.frame, r.dropped) for r in frames.newest_only(live).collect()} == {(1, 1), (2, 0)}


def test_shared_json(spark, tmp_path):
    at = str(tmp_path / "a" / "1.json")
    assert runtime.write_json(spark, at, {"x": [1]})
    assert not runtime.write_json(spark, at, {"x": [2]})
    assert runtime.read_json(spark, at) == {"x": [1]}


def test_lookup_of_hot_keys_and_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("hot", i, {"m": "x"}) for i in range(50)] + [("cold", 1, None), (None, 2, None), ("none", 3, None)], "k string, i int, m map<string, string>")
    small = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, v double")
    for limit in (100, 1):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", limit)
        assert runtime.lookup(rows, small, ["k"]).count() == 51
        assert runtime.lookup(rows, small, ["k"], how="left").count() == 53


def test_manifest_problems_name_file_and_line(spark, tmp_path):
    good = '{"image_id":"a","width":4,"height":3,"boxes":[]}'
    (tmp_path / "m1").write_text("\n".join([good, "", "not json", good.replace("4", "0"), '{"width":1,"height":1}', good.replace("[]", '[{"cx":0.5,"cy":0.5,"w":3,"h":0.1}]')]) + "\n")
    (tmp_path / "m2").write_text(good + "\n")
    got = [(r.path.rsplit("/", 1)[1], r.line, r.error) for r in labels.manifest_problems(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [("m1", 3, "malformed manifest line"), ("m1", 4, "width and height must be positive"), ("m1", 5, "malformed manifest line"), ("m1", 6, "a box outside the image")]
    with pytest.raises(ValueError, match="m1:3: malformed"):
        labels.read_manifest(spark, str(tmp_path), unique=True)
    assert labels.manifest_problems(spark, str(tmp_path / "m2")).count() == 0


def test_tree_with_its_images(spark, tmp_path):
    raw = tmp_path / "raw" / "x"
    raw.mkdir(parents=True)
    for n in ("one.png", "b.JPG", "b.png"):
        (raw / n).write_bytes(n.encode())
    rows = [("a", 10, 20, [], "x/one.png", None, None, {}, "train"), ("x/b", 10, 20, [], None, None, None, {}, "val"), ("gone", 1, 1, [], "x/none.png", None, None, {}, "test")]
    df = spark.createDataFrame(rows, MANIFEST + ", split string")
    have = spark.createDataFrame([("x/one.png",), ("x/b.JPG",), ("x/b.png",), (None,), ("x/one.png",)], "file string")
    assert {(r.image_id, r.file, r.name) for r in files.image_plan(df, have).collect()} == {("a", "x/one.png", "a.png"), ("x/b", "x/b.JPG", "x/b.JPG"), ("gone", None, None)}
    df = df.withColumn("image_id", F.regexp_replace("image_id", "x/", ""))
    with pytest.raises(FileNotFoundError, match="'b'"):
        files.write_tree(df, str(tmp_path / "t"), image_root=str(tmp_path / "raw"), images=have)
    assert not (tmp_path / "t").exists()
    named = df.withColumn("file_name", F.coalesce("file_name", F.lit("x/b.png")))
    for link in (True, False):
        out = tmp_path / f"t{link}"
        missing = files.write_tree(named, str(out), image_root=str(tmp_path / "raw"), images=have, link=link, allow_missing=True)
        assert [r.image_id for r in missing.collect()] == ["gone"]
        assert (out / "images/train/a.png").read_bytes() == b"one.png" and (out / "images/val/b.png").is_symlink() == link
        assert (out / "labels/test/gone.txt").exists() and not list((out / "images/test").iterdir())
        assert not [p for p in out.rglob(".*")]


def test_sizes_from_headers_only(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (48).to_bytes(4, "big") + b"rest" * 99
    frame = b"\xff\xc0\0\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\0" * 20
    far = b"\xff\xd8" + (b"\xff\xe1" + (65000).to_bytes(2, "big") + b"x" * 64998) * 3 + frame  # beyond what is read at first
    for n, body in (("p q.png", png), ("far.jpg", far), ("no.jpg", b"text"), ("empty.png", b"")):
        (tmp_path / n).write_bytes(body)
    got = {r.file: (r.width, r.height, r.stem) for r in labels.image_files(spark, str(tmp_path)).collect()}
    assert got["p q.png"] == (640, 48, "p q") and got["far.jpg"] == (40, 30, "far") and got["no.jpg"][:2] == (None, None)


def test_journal_is_appended_to(spark, tmp_path):
    from sightline.sources.journal import read_journal

    at = str(tmp_path / "log.jsonl")
    rows = spark.sql("SELECT 'B' AS plate, timestamp'2024-01-02' AS ts, 'B' AS display, 'IN' AS region, 0.5D AS confidence, 0 AS edits, 2 AS track_id, 1 AS frame, 's' AS source, CAST(NULL AS STRING) AS crop_path UNION ALL SELECT 'A', timestamp'2024-01-01', 'A', 'DE', 0.5D, 0, 1, 1, 's', 'c'")
    assert files.append_journal(rows, at) == 2
    with open(at, "a") as f:
        f.write('{"plate": "torn')
    assert [r.plate for r in read_journal(spark, at).orderBy("line").collect()] == ["A", "B"]
    (tmp_path / "log.jsonl").write_text("\n".join((tmp_path / "log.jsonl").read_text().splitlines()[:2]))  # the last line's end is lost
    assert files.append_journal(rows.where("plate = 'B'"), at) == 1
    assert [r.plate for r in read_journal(spark, at).orderBy("line").collect()] == ["A", "B", "B"]
