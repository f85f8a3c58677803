from sightline.plans import core_queries as q


def side(s):
    s = None if s is None else s.strip(" ").lower()
    return {"valid": "val", "validation": "val"}.get(s, s if s in ("train", "val", "test") else None)


PAIRS = [
    ("a", "b", 0, " Train", "VALID"), ("a", "b", 1, "train", "val"), ("c", "d", 5, "TEST ", "train"), ("e", "f", 2, "validation", "Test"), ("g", "h", 3, "train", " TRAIN "), ("i", "j", 6, "train", "test"),
    ("k", "k", 0, "train", "test"), ("l", "m", 1, None, "test"), ("n", "o", 1, "train", "odd"), (None, "p", 0, "train", "test"), ("q", "r", -1, "train", "test"), ("s", "t", 4, "train", "test"),
]
HASHES = [("c", "Test"), ("e", " test"), ("t", "test"), ("u", "TEST "), ("u", "test"), ("v", "valid"), (None, "test"), ("w", None)]


def test_split_spellings_in_recorded_pairs(spark, tmp_path):
    spark.createDataFrame(PAIRS, "left_id string, right_id string, distance int, left_split string, right_split string").write.parquet(f"{tmp_path}/duplicate_pairs.parquet")
    spark.createDataFrame(HASHES, "image_id string, split string").write.parquet(f"{tmp_path}/image_hashes.parquet")
    pairs = {(a, b, side(s), side(t)) for a, b, d, s, t in PAIRS if None not in (a, b) and a != b and 0 <= d <= 5 and side(s) and side(t)}
    bad = [p for p in pairs if p[2] != p[3] and "train" in p[2:]]
    held = {(t, b) if s == "train" else (s, a) for a, b, s, t in bad}
    d = str(tmp_path)
    got = [tuple(r) for r in q.contaminated_images(spark, d).collect()]
    assert sorted(got) == sorted(held) == [("test", "c"), ("test", "t"), ("val", "b")]
    within = sum(p[2] == p[3] for p in pairs)
    assert tuple(q.duplicate_report(spark, d).first()) == (len(pairs), within, len(pairs) - within, len(bad))
    clean = {i for i, s in HASHES if i and side(s) == "test"} - {i for s, i in held if s == "test"}
    assert {r.image_id for r in q.clean_test_images(spark, d).collect()} == clean == {"e", "u"}
