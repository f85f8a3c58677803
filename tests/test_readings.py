import pytest

from sightline.plans import core_queries as q

ROWS = [("a", "KA01AB1234", "KA 01 AB 1234"), ("a", "qz·77·kx0001", "QZ 77 KX 0001"), ("b", "WÜAB12", "WÜ-AB 12"), ("b", "MÜAB12", "MU-AB 12"), (None, "KA01AB1234", "ÄÖ"), ("a", "", ""), ("b", "MH12AB1234", ""), ("b", None, "x"), ("a", "WÜAB12", None)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def brute(pairs):
    n, d, c, e = len(pairs), sum(edits(*p) for p in pairs), sum(len(a) for a, _ in pairs), sum(a == b for a, b in pairs)
    return n, d, c, e, sum(not b for _, b in pairs), pytest.approx(d / c), pytest.approx(e / n)


def test_readings_that_are_not_ascii_are_scored(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame(ROWS, "source string, plate string, display string").write.parquet(f"{d}/plate_events.parquet")
    rows = [(s, p, h.replace(" ", "").replace("-", "")) for s, p, h in ROWS if None not in (p, h)]
    pairs = [x[1:] for x in rows]
    fields = ("samples", "distance", "characters", "exact", "empty", "error_rate", "accuracy")
    assert tuple(q.cer_corpus(spark, d).first()[f] for f in fields) == brute(pairs)
    assert {r.source: tuple(r[f] for f in fields) for r in q.cer_by_source(spark, d).collect()} == {s: brute([x[1:] for x in rows if x[0] == s]) for s in "ab"}
    rate = lambda a, b: edits(a, b) / len(a) if a else float(bool(b))
    worst = sorted(((-rate(*p), *p) for p in pairs if p[0] != p[1]))
    assert [tuple(r) for r in q.cer_worst(spark, d).collect()] == [(a, b, pytest.approx(-r)) for r, a, b in worst]
    final = [(r.truth, r.final_text) for r in q.graded(spark, d).collect()]
    assert sorted(t for t, _ in final) == sorted(a for a, _ in pairs)
    gain = q.grammar_gain(spark, d).first()
    raw, corrected = brute(pairs), brute([(t, f or "") for t, f in final])
    assert (gain.raw_error_rate, gain.raw_accuracy, gain.error_rate, gain.accuracy) == (raw[5], raw[6], corrected[5], corrected[6])
    assert q.outcome_report(spark, d).first().total == len(pairs)


def test_plate_log_keeps_umlauts_and_separators(spark, tmp_path):
    d = str(tmp_path)
    tracks = [("WÜ-AB 12", "WÜAB12", "WÜ-AB 12"), ("H-HA 123", "HHA123", "H-HA 123"), ("HHA124", "HHA124", "HH-A 124"), ("MH 12 AB 1234", "MH12AB1234", "MH 12 AB 1234")]
    rows = [("cam", i, f, t, 0.9, 10**9 * i) for i, (t, *_) in enumerate(tracks) for f in range(3)]
    df = spark.createDataFrame(rows, "source string, track_id int, frame int, plate string, confidence double, s long")
    df.selectExpr("source", "track_id", "frame", "plate", "confidence", "CASE WHEN frame = 0 OR track_id > 0 THEN timestamp_seconds(s) END AS ts").write.parquet(f"{d}/plate_events.parquet")
    got = {r.track_id: (r.plate, r.display) for r in q.plate_log(spark, d).collect()}
    assert got == {i: x[1:] for i, x in enumerate(tracks)}
    assert tuple(q.plate_log_stats(spark, d).first()) == (4, 0, 0, 0, 4)
