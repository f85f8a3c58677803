import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry, grammar, identity, text

HEX = "0123456789abcdef0123456789ABCDEF"


def one(spark, ddl, rows, col):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(col).collect()]


def test_clip_identity(spark):
    want = {
        f"dayride_type1_001-mp4-t-751_jpg.rf.{HEX}": "dayride_type1_001",
        "video3_2190": "video3", "in-train-video8_870": "in-train-video8", "clip_042_frame_0137": "clip_042", "clip7FRAME12": "clip7",
        "license_plate_242": None, "video_2190": None, "myvideo3_2190": None, "video3": None, "video3_2190_640": None, "": None,
        f"video3_2190_jpg.rf.{HEX}x": None, "frame_12": None, None: None,
    }
    got = one(spark, "n string", [(k,) for k in want], identity.clip_id(F.col("n")))
    assert got == list(want.values())
    rows = [("a", None), ("video3_1", None), ("video3_1", ""), (f"x_png.rf.{HEX}", None)]
    assert one(spark, "i string, g string", rows, identity.group_key(F.col("i"), F.col("g"))) == ["a", "video3", "", "x"]
    prefix, stem = identity.split_export_id(F.col("i"), ["co-", "co-night-"])
    rows = [("co-night-train-a",), ("co-valid-b-test-c",), ("zz-train-a",), ("co-train-",), (None,)]
    assert [tuple(r) for r in spark.createDataFrame(rows, "i string").select(prefix, stem).collect()] == [("co-night-", "a"), ("co-", "b-test-c"), (None, None), (None, None), (None, None)]


def test_geometry(spark):
    box = lambda s: F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), s)))
    cases = [((0, 0, 1, 1), (0, 0, 1, 1), 1.0), ((0, 0, 1, 1), (1, 0, 2, 1), 0.0), ((0, 0, 1, 1), (0.5, 0, 1.5, 1), 1 / 3), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0), ((0, 0, 1, 1), (2, 2, 3, 3), 0.0)]
    for a, b, want in cases:
        assert spark.range(1).select(geometry.iou(box(a), box(b))).first()[0] == pytest.approx(want)
    widths = [(0.0,), (31.9,), (32.0,), (64.0,), (127.9,), (128.0,), (-1.0,), (float("nan"),), (None,)]
    got = one(spark, "w double", widths, geometry.size_bucket(F.col("w")))
    assert [g.split()[0] for g in got] == ["tiny", "tiny", "small", "medium", "medium", "large", "large", "large", "large"]
    boxes = "b array<struct<region: string>>"
    rows = [([("IN",), ("DE",), ("DE",)],), ([("PL",), ("IN",)],), ([("XX",), (None,)],), ([],), (None,)]
    assert one(spark, boxes, rows, geometry.primary_region(F.col("b"))) == ["DE", "IN", "XX", "XX", "XX"]
    c = spark.createDataFrame([((0.0, 0.5, 0.2, 1.0),)], "b struct<cx: double, cy: double, w: double, h: double>")
    cut = c.select(geometry.clipped(F.col("b"))).first()[0]
    assert (cut.cx, cut.cy, cut.w, cut.h) == pytest.approx((0.05, 0.5, 0.1, 1.0))
    assert c.select(geometry.valid_box(F.col("b"))).first()[0]


def test_strings(spark):
    rows = [("ind mh 12 ab-1234",), ("m-ab 123e",), ("",), (None,), ("IND12",)]
    assert one(spark, "s string", rows, text.normalize_plate(F.col("s"))) == ["MH12AB1234", "MAB123E", "", None, "IND12"]
    assert one(spark, "s string", [("M-AB 123",), ("MAB123",), (" wü x",), (None,)], text.district_hint(F.col("s"))) == ["M", None, "WÜ", None]
    rows = [("AB", "AB"), ("ABCD", "ABXD"), ("", ""), ("", "A"), (None, "A")]
    assert one(spark, "r string, h string", rows, text.error_rate(F.col("r"), F.col("h"))) == [0.0, 0.25, 0.0, 1.0, None]
    rows = [("A", "A", None), ("A", "B", "A"), ("A", "A", "B"), ("A", "B", "C")]
    assert one(spark, "t string, r string, f string", rows, text.classify(F.col("t"), F.col("r"), F.col("f"))) == ["grammar_rejected", "correct", "grammar_corrupted", "ocr_error"]
    assert one(spark, "l string", [("CC BY 4.0",), ("CC BY-NC-ND 4.0",), ("cc by-nd",), ("LANDSAT",)], text.redistributable(F.col("l"))) == [True, False, False, True]


GOLDEN = [
    ("MH12AB1234", "MH12AB1234", "IN", 0), ("DL 01 CAB 1234", "DL01CAB1234", "IN", 0), ("21 BH 1234 AB", "21BH1234AB", "IN", 0), ("DA-XY 1234", "DAXY1234", "DE", 0), ("M-AB 123E", "MAB123E", "DE", 0),
    ("HH-AB 12H", "HHAB12H", "DE", 0), ("PO2427W", "PO2427W", "PL", 0), ("SBE81PF", "SBE81PF", "PL", 0), ("PCTC843", "PCTC843", "PL", 0), ("GOGRA01", "GOGRA01", "PL", 0), ("P74103", "P74103", "PL", 0),
    ("W2515T", "W2515T", "PL", 0), ("DAXYI23", "DAXY123", "DE", 1), ("MHI2AB1234", "MH12AB1234", "IN", 1), ("0R12AB1234", "OR12AB1234", "IN", 1), ("PO2B27W", "PO2827W", "PL", 1), ("PCTCB43", "PCTC843", "PL", 1),
    ("hello", None, None, None), ("ZZZ", None, None, None), ("!!!", None, None, None), ("hello world", None, None, None), ("", None, None, None), (None, None, None, None),
]


def test_grammar_golden(spark):
    df = spark.createDataFrame([(i, r, "t") for i, (r, *_) in enumerate(GOLDEN)], "i int, raw string, text string")
    got = {r.i: r.match for r in grammar.parse_plates(df, "raw").collect()}
    for i, (raw, want, region, edits) in enumerate(GOLDEN):
        m = got[i]
        assert (None if m is None else (m.text, m.region, m.edits)) == (None if want is None else (want, region, edits)), raw
    shown = dict(grammar.parse_plates(df, "raw").where("match IS NOT NULL").select("raw", grammar.display(F.col("match"))).collect())
    assert shown["DL 01 CAB 1234"] == "DL 01 CAB 1234"
    assert shown["M-AB 123E"] == "M-AB 123E"
    assert shown["21 BH 1234 AB"] == "21 BH 1234 AB"
    assert shown["PCTC843"] == "PCT C843"
    assert grammar.parse_plates(df, "raw", region="EU").where("match IS NOT NULL").count() == 0
    assert {r.match.region for r in grammar.parse_plates(df, "raw", region="PL").where("match IS NOT NULL").collect()} == {"PL"}


def test_grammar_hint_and_components(spark):
    df = spark.createDataFrame([("M-AB 123",), ("MAB123",), ("DA XY 12",)], "raw string")
    got = {r.raw: r.match for r in grammar.parse_plates(df, "raw", region="DE").collect()}
    assert got["M-AB 123"].components["district"] == "M"
    assert got["MAB123"].components["district"] == "MA"
    assert got["DA XY 12"].components["district_name"] == "Darmstadt"
