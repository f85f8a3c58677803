import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sightline import runtime
from sightline.operators import components, cooldown, duplicates, evaluate, sampling, splits, stats, tracker
from sightline.operators.runs import with_previous, with_run
from sightline.operators.vote import vote


def test_previous_and_runs(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None]), r.randrange(500), i) for i in range(300)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    by = defaultdict(list)
    for k, t, i in rows:
        if t is not None:
            by[k].append((t, i))
    want, runs = {}, {}
    for k, v in by.items():
        v.sort()
        start = None
        for n, (t, i) in enumerate(v):
            want[(k, i)] = (v[n - 1][0] if n else None, n + 1)
            if not n or t - v[n - 1][0] >= 4:
                start = t
            runs[(k, i)] = start
    for chunk in (3, 50, 10**6):
        assert {(x.k, x.i): (x.p, x.n) for x in with_previous(df, ["k"], "t", ["i"], chunk, "p", "n").collect()} == want
        assert {(x.k, x.i): x.run for x in with_run(df, ["k"], "t", 4, chunk).collect()} == runs


def test_cooldown(spark):
    m = 60_000_000
    rows = [("a", 0), ("a", m), ("a", 6 * m), ("b", 0), ("b", 5 * m), ("c", 0), ("c", 2 * m), ("c", 10 * m), (None, 0), ("d", None)]
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(rows)], "plate string, t long, accepted int")
    got = {(x.plate, x.t): x.accepted for x in cooldown.cooldown(df.drop("accepted"), "plate", "t", []).collect()}
    assert got == {("a", 0): True, ("a", m): False, ("a", 6 * m): True, ("b", 0): True, ("b", 5 * m): True, ("c", 0): True, ("c", 2 * m): False, ("c", 10 * m): True}
    assert cooldown.cooldown(df.drop("accepted"), "plate", "t", [], 0).where("accepted").count() == 8
    assert {(x.plate, x.sightings) for x in cooldown.history(df, "plate", "t").collect()} == {("a", 3), ("b", 2), ("c", 3)}
    with pytest.raises(ValueError):
        cooldown.cooldown(df, "plate", "t", [], -1)


VOTES = {
    1: ([("MH12A81234", 1.0), ("MH12AB1Z34", 1.0), ("NH12AB1234", 1.0), ("MH12AB1234", 1.0)], "MH12AB1234", 4),
    2: ([("ABC999", 0.2), ("ABC999", 0.2), ("ABC123", 0.95)], "ABC123", 3),
    3: ([("ABC12", 0.3), ("ABC123", 0.9), ("ABC123", 0.9)], "ABC123", 2),
    4: ([("ABC123", 1.0), ("ABC123", 1.0), ("AB12", 1.0)], "ABC123", 2),
    5: ([("ABC123", 1.0), ("ABC123", 1.0), ("ABC183", 1.0)], "ABC123", 3),
}


def test_vote(spark):
    rows = [(k, t, c, "x") for k, (v, _, _) in VOTES.items() for t, c in v]
    rows += [(6, "ABC123", 1.0, "x"), (7, "", 1.0, "x"), (7, None, 1.0, "x"), (7, "A", float("nan"), "x"), (7, "A", 1.5, "x"), (8, "AB", 0.0, "x"), (8, "AC", 0.0, "x"), (None, "Q", 1.0, "x"), (None, "Q", 1.0, "x")]
    df = spark.createDataFrame(rows, "track_id int, text string, confidence double, w string")
    got = {r.track_id: r for r in vote(df, ["track_id"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8, None}
    for k, (_, t, n) in VOTES.items():
        assert (got[k].text, got[k].reads) == (t, n)
    assert not got[1].unanimous
    assert got[5].weakest_position == 4
    assert got[5].runner_up == "ABC183"
    assert got[4].unanimous and got[4].weakest_position is None and got[4].runner_up is None
    assert (got[8].text, got[8].confidence) == ("AB", 0.0)
    assert vote(df.limit(0), ["track_id"]).count() == 0


def test_components(spark):
    r = random.Random(3)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{r.randrange(80)}", f"m{r.randrange(80)}") for _ in range(50)] + [("z", "z"), (None, "n1")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    space = runtime.Workspace(spark, "t")
    parts = components.named_by_smallest(space, components.components(space, spark.createDataFrame(pairs, "x string, y string")))
    assert {tuple(x) for x in parts.collect()} == {(x, find(x)) for x in list(up)}
    assert components.components(space, spark.createDataFrame([], "x string, y string")).count() == 0


HASHES = "image_id string, dhash long, contrast int, region string, split string"


def flip(h, *bits):
    for b in bits:
        h ^= 1 << b
    return h


def test_duplicates_literals(spark):
    h = 0x1234_5678_9ABC_DEF0
    cases = [("IN", "DE", (), True), ("IN", "DE", (1,), True), ("IN", "DE", (1, 40), True), ("IN", "DE", (1, 2, 3), False), ("IN", "IN", (0, 9, 30, 50), True), ("IN", "IN", (0, 9, 30, 50, 62), True), ("IN", "IN", (0, 9, 30, 50, 62, 7), False), ("XX", "IN", (1, 2, 3, 4, 5), True), (None, "IN", (1, 2, 3), True)]
    for n, (a, b, bits, want) in enumerate(cases):
        df = spark.createDataFrame([("a", h, 90, a, "train"), ("b", flip(h, *bits), 90, b, "test")], HASHES)
        assert duplicates.duplicate_pairs(df).count() == want, n
    blank = spark.createDataFrame([("a", 0, 3, "IN", ""), ("b", 0, 2, "IN", ""), ("c", 0, 90, "IN", ""), ("d", 1, 2, "IN", ""), (None, 0, 2, "IN", ""), ("e", None, 2, "IN", "")], HASHES)
    assert [(r.left_id, r.right_id, r.distance) for r in duplicates.duplicate_pairs(blank).collect()] == [("a", "b", 0)]
    assert duplicates.duplicate_pairs(spark.createDataFrame([("a", h, 90, "IN", ""), ("b", flip(h, 1), 90, "IN", "")], HASHES), 0).count() == 0


def test_duplicates_equal_brute_force_and_clusters(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) - 2**63 for _ in range(20)]
    rows = []
    for i in range(200):
        h = r.choice(base)
        for b in r.sample(range(63), r.choice([0, 0, 1, 2, 3, 5, 6])):
            h ^= 1 << b
        rows.append((f"i{i:03d}", h, r.choice([2, 90, 90, 90]), r.choice(["IN", "DE", "XX", None]), r.choice(["train", "test"])))
    df = spark.createDataFrame(rows + rows[:20], HASHES)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                bits = ((a[1] ^ b[1]) & (2**64 - 1)).bit_count()
                known = all(x in ("IN", "DE") for x in (a[3], b[3])) and a[3] != b[3]
                if (bits == 0 and (a[2] <= 4) == (b[2] <= 4)) or (1 <= bits <= (2 if known else 5) and a[2] > 4 and b[2] > 4):
                    want[(a[0], b[0])] = bits
    pairs = duplicates.duplicate_pairs(df)
    assert {(x.left_id, x.right_id): x.distance for x in pairs.collect()} == want
    up = {x: x for p in want for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    clusters = duplicates.duplicate_clusters(df)
    assert {(x.image_id, x.cluster_id) for x in clusters.collect()} == {(x, "dup:" + find(x)) for x in up}
    split = {x[0]: x[4] for x in rows}
    tagged = duplicates.with_splits(pairs, df.select("image_id", "split").distinct())
    rep = duplicates.duplicate_report(tagged).first()
    assert rep.contaminating == sum(split[a] != split[b] for a, b in want)
    hit = {x for p in want if split[p[0]] != split[p[1]] for x in p if split[x] == "test"}
    assert {x.image_id for x in duplicates.affected_images(tagged).collect()} == hit
    test_rows = df.where("split = 'test'").select("image_id").distinct()
    assert {x.image_id for x in duplicates.clean_subset(test_rows, tagged, "test").collect()} == {i for i, s in split.items() if s == "test"} - hit


def test_regroup_is_the_closure_over_both_relations(spark):
    recs = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "c"), ("d", "g2"), ("e", "g2"), ("f", "f")], "image_id string, group_key string")
    clusters = spark.createDataFrame([("a", "dup:a"), ("c", "dup:a")], "image_id string, cluster_id string")
    got = {r.image_id: r.new_group for r in duplicates.regroup(recs, clusters).collect()}
    assert got == {"a": "dup:a", "b": "dup:a", "c": "dup:a", "d": None, "e": None, "f": None}
    assert duplicates.regroup(recs, clusters.limit(0)).where("new_group IS NOT NULL").count() == 0


def fold(groups, shares, seed):
    out = {}
    for region in sorted({r for r, _ in groups.values()}):
        mine = {g: n for g, (r, n) in groups.items() if r == region}
        total, placed = sum(mine.values()), dict.fromkeys(shares, 0)
        for g in sorted(mine, key=lambda g: (-mine[g], splits.rank(g, seed))):
            s = max(shares, key=lambda s: (shares[s] * total - placed[s], -splits.rank(f"{g}:{s}", seed)))
            placed[s] += mine[g]
            out[g] = s
    return out


@pytest.mark.parametrize("seed", [0, 7])
def test_grouped_split(spark, seed):
    r = random.Random(seed)
    rows = [(f"i{i}", f"g{min(r.randrange(120), r.randrange(120))}", r.choice(["IN", "IN", "DE", None])) for i in range(900)] + [("x", None, "IN")]
    df = spark.createDataFrame(rows, "image_id string, group_key string, region string")
    sizes = defaultdict(lambda: defaultdict(int))
    for _, g, reg in rows:
        if g:
            sizes[g][reg or "XX"] += 1
    owned = {g: min(v.items()) for g, v in sizes.items()}
    plan = splits.grouped_split(df, seed=seed)
    got = {x.group_key: x.split for x in plan.collect()}
    assert got == fold(owned, splits.normalize_ratios(splits.RATIOS), seed)
    assert {x.group_key: x.split for x in splits.grouped_split(df.repartition(7), seed=seed).collect()} == got
    have = df.where("group_key IS NOT NULL")
    splits.verify(have, plan)
    assert sum(x.images for x in splits.split_counts(splits.assign(have, plan)).collect()) == 900
    broken = plan.where("group_key <> 'g0'").unionByName(spark.createDataFrame([("gone", "val")], "group_key string, split string"))
    kinds = {(x.problem, x.name) for x in splits.coverage(have, broken).collect()}
    assert {("unassigned", "g0"), ("stale", "gone")} <= kinds
    with pytest.raises(ValueError):
        splits.verify(have, broken)
    assert splits.grouped_split(df.limit(0)).count() == 0
    for bad in ({}, {"a": -1.0}, {"a": 0.0}):
        with pytest.raises(ValueError):
            splits.normalize_ratios(bad)


def test_exact_median(spark):
    r = random.Random(2)
    for n in (1, 2, 7, 1000, 1001):
        v = sorted(r.choice([r.random(), round(r.random(), 1)]) for _ in range(n))
        df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "x double")
        assert stats.exact_median(df, "x") == (v[(n - 1) // 2] + v[n // 2]) / 2
    assert stats.exact_median(spark.createDataFrame([], "x double"), "x") is None


def test_stats_and_fingerprint(spark):
    box = "array<struct<cx: double, cy: double, w: double, h: double, text: string, region: string>>"
    rows = [("video1_1", 100, 100, [(0.5, 0.5, 0.1, 0.2, "A", "IN"), (0.5, 0.5, 0.5, 0.2, "", "DE")], None, "s"), ("video1_2", 100, 100, [], None, None), ("still", 100, 100, None, None, "")]
    df = spark.createDataFrame(rows, f"image_id string, width int, height int, boxes {box}, split_group string, source string")
    s = stats.dataset_stats(df).first()
    assert (s.images, s.plates, s.images_without_plates, s.groups, s.with_text, s.tiny_plates, s.median_width, s.median_height) == (3, 2, 2, 2, 1, 1, 30.0, 20.0)
    assert stats.dataset_stats(df.limit(0)).first().plates == 0
    crit = stats.exit_criteria(stats.dataset_stats(df), stats.box_rows(df).groupBy("region").agg(F.count("*").alias("plates")))
    assert {x.criterion: x.passed for x in crit.collect()} == {"plates >= 1000": False, "region IN": True, "region EU": False}
    import hashlib

    tree = [("val", "b.txt", "2"), ("train", "a.txt", "1"), ("train", "Z.txt", ""), ("other", "q", "9")]
    want = hashlib.sha256(b"train/Z.txt" + b"train/a.txt1" + b"val/b.txt2").hexdigest()
    assert stats.export_fingerprint(spark.createDataFrame(tree, "split string, name string, body string")) == want
    assert len(stats.expectations({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": None})) == 1
    with pytest.raises(ValueError):
        stats.verify_dataset({"a": 1}, {"a": 2})


TRUTH = "image_id string, box_index int, x1 double, y1 double, x2 double, y2 double, pixel_width double"
FOUND = "image_id string, det_index int, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_matching(spark):
    truth = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0, 20.0), ("a", 1, 0.0, 0.0, 1.0, 1.0, 200.0), ("b", 0, 0.0, 0.0, 1.0, 1.0, 50.0), ("d", 0, 0.0, 0.0, 1.0, 1.0, None)], TRUTH)
    found = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0, 0.5), ("a", 1, 0.0, 0.0, 1.0, 0.9, 0.9), ("a", 2, 5.0, 5.0, 6.0, 6.0, None), ("c", 0, 0.0, 0.0, 1.0, 1.0, 0.5), ("b", 0, 0.0, 0.0, 0.4, 1.0, 0.9)], FOUND)
    m = evaluate.match_boxes(truth, found)
    got = {r.image_id: r for r in m.collect()}
    assert [(x.det_index, x.box_index) for x in got["a"].matched] == [(1, 1), (0, 0)]
    assert (got["a"].extra, got["b"].missed, got["b"].extra, got["c"].extra) == ([2], [0], [0], [0])
    o = evaluate.overall(m).first()
    assert (o.tp, o.fp, o.fn) == (2, 3, 2)
    sizes = {r.bucket.split()[0]: (r.tp, r.fp, r.fn) for r in evaluate.by_size(m).collect()}
    assert sizes == {"tiny": (1, 0, 0), "small": (0, 1, 1), "medium": (0, 0, 0), "large": (1, 1, 1)}
    assert [r.image_id for r in evaluate.worst_images(m, 2).collect()] == ["b", "a"]
    assert {r.image_id for r in evaluate.gallery(m).collect()} == {"a", "b", "c", "d"}
    best = {(r.image_id, r.box_index): r.det_index for r in evaluate.best_detections(truth, found).collect()}
    assert best == {("a", 0): 0, ("a", 1): 0, ("b", 0): None, ("d", 0): None}
    e = evaluate.overall(evaluate.match_boxes(truth.limit(0), found.limit(0))).first()
    assert (e.tp, e.precision, e.f1) == (0, 0.0, 0.0)


def test_reading_reports(spark):
    df = spark.createDataFrame([("ABCD", "ABCD", "v"), ("ABCD", "ABXX", "v"), ("AB", None, "w"), ("", "", "w"), (None, "Q", "w")], "r string, h string, variant string")
    t = evaluate.reading_report(df, "r", "h").first()
    assert (t.samples, t.distance, t.characters, t.exact, t.empty, t.error_rate) == (4, 4, 10, 2, 2, 0.4)
    assert {r.variant: r.samples for r in evaluate.reading_report(df, "r", "h", "variant").collect()} == {"v": 2, "w": 2}
    assert [r.reference for r in evaluate.worst_readings(df, "r", "h").collect()] == ["AB", "ABCD"]
    assert evaluate.reading_report(df.limit(0), "r", "h").first().error_rate == 0.0
    rows = spark.createDataFrame([("A", "A", "A"), ("A", "B", "A"), ("A", "A", "B"), ("A", "", "A"), ("A", "B", None)], "truth string, raw_text string, final_text string")
    rep = evaluate.outcome_report(evaluate.outcomes(rows)).first()
    assert (rep.total, rep.correct, rep.grammar_corrupted, rep.grammar_rejected, rep.accuracy) == (5, 2, 1, 2, 0.4)
    g = evaluate.grammar_gain(rows, "truth", "raw_text", "final_text").first()
    assert g.improved and g.error_rate_gain == pytest.approx(0.2)
    assert not evaluate.grammar_gain(rows, "truth", "final_text", "raw_text").first().improved
    keys = spark.createDataFrame([("a#b#3",), ("a#x",), ("a",), ("a#-1",)], "c string").select(*evaluate.crop_key(F.col("c")))
    assert [tuple(r) for r in keys.collect()] == [("a#b", 3), ("a", None), ("", None), ("a", None)]
    crops = spark.createDataFrame([("a#0",), ("b#0",)], "crop_id string")
    labels = spark.createDataFrame([("a#0", " x1 "), ("b#0", "  "), (None, "q")], "crop_id string, text string")
    assert [tuple(r) for r in evaluate.labelled_crops(crops, labels).collect()] == [("a#0", "X1")]


def test_round_robin(spark):
    df = spark.createDataFrame([("b", f"b{i}") for i in range(9)] + [("a", "a0"), ("a", "a0"), (None, "q"), ("c", None)], "bucket string, ident string")
    got = sampling.round_robin(df, "bucket", "ident", 4).collect()
    assert [(r.bucket, r["round"]) for r in got] == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]
    assert sampling.round_robin(df, "bucket", "ident", 0).count() == 0


def drift(n, start=0, dx=0.005, y=0.55):
    return [("cam", start + i, 0, 0.2 + dx * i, y, 0.32 + dx * i, y + 0.05) for i in range(n)]


DET = "source string, frame int, det_index int, x1 double, y1 double, x2 double, y2 double"


def sequential(rows, settings, last):
    by = defaultdict(lambda: defaultdict(list))
    for r in sorted(set(rows)):
        by[r[0]][r[1]].append(r)
    out = {}
    for s, frames in by.items():
        seq = tracker.Sequence(settings)
        for f in range(max(frames) + 1 if last is None else last):
            d = frames.get(f, [])
            taken, _ = seq.advance(f, [x[3:] for x in d])
            place = {id(t): d[j][2] for j, t in taken.items()}
            for t in seq.live:
                if id(t) in place or t.confirmed:
                    out[(s, f, t.ident)] = (place.get(id(t)), t.hits, t.age, t.confirmed)
    return out


@pytest.mark.parametrize("last", [None, 400])
def test_tracker_in_pieces_equals_one_sequence(spark, last):
    r = random.Random(4)
    rows = []
    for s in ("cam", "gate"):
        for _ in range(25):
            f, x, y = r.randrange(300), r.random(), r.random()
            for i in range(r.randrange(1, 25)):
                if r.random() < 0.8:
                    rows.append((s, f + i, r.randrange(3), x + 0.01 * i, y, x + 0.1 + 0.01 * i, y + 0.05))
    unique = {}
    for x in rows:
        unique.setdefault(x[:3], x)
    rows = list(unique.values())
    settings = tracker.Settings(max_age=3)
    df = spark.createDataFrame(rows + rows[:9], DET)
    lengths = None if last is None else spark.createDataFrame([("cam", last), ("gate", last)], "source string, frames int")
    live = tracker.follow(df, settings, lengths)
    assert {(x.source, x.frame, x.track_id): (x.det_index, x.hits, x.age, x.confirmed) for x in live.collect()} == sequential(rows, settings, last)


def test_tracks(spark):
    live = tracker.follow(spark.createDataFrame(drift(8) + drift(5, 40), DET), lengths=spark.createDataFrame([("cam", 80)], "source string, frames int"))
    t = {r.track_id: r for r in tracker.track_table(live).collect()}
    assert {k: (v.first_frame, v.last_frame, v.hits, v.duration, v.confirmed, v.ended_at) for k, v in t.items()} == {1: (0, 7, 8, 8, True, 23), 2: (40, 44, 5, 5, True, 60)}
    asked = tracker.reading_requests(live, 2)
    assert {r.frame for r in asked.where("track_id = 1").collect()} == set(range(2, 23, 2))
    for bad in ({"iou": 0.0}, {"max_age": -1}, {"min_hits": 0}):
        with pytest.raises(ValueError):
            tracker.Settings(**bad)
    assert tracker.follow(spark.createDataFrame([], DET)).count() == 0
    h = spark.createDataFrame([("s", 1, 5, 0, 0.9), ("s", 1, 3, 1, 0.9), ("s", 1, 4, 0, float("nan")), ("s", None, 1, 0, 1.0)], "source string, track_id int, frame int, det_index int, confidence double")
    assert [(r.frame, r.det_index) for r in tracker.best_sightings(h).collect()] == [(3, 1)]


def test_labels_that_name_nothing_are_skipped(spark):
    box = (0.5, 0.5, 0.2, 0.1, "T", "IN")
    records = spark.createDataFrame([("a#b", [box, box], "f.png", "x"), ("c", [box], None, "x"), ("d", [], "d.png", "x"), ("e", None, "e.png", "x"), (None, [box], "n.png", "x")], "image_id string, boxes array<struct<cx: double, cy: double, w: double, h: double, text: string, region: string>>, file_name string, truth string")
    rows = [("a#b#1", " ab1 "), ("a#b#2", "X"), ("a#b#z", "X"), ("c#0", "X"), ("d#0", "X"), ("e#0", "X"), ("gone#0", "X"), ("bare", "X"), (None, "X"), ("a#b#0", " ")]
    labels = spark.createDataFrame(rows, "crop_id string, text string")
    plates, skipped = evaluate.labelled_plates(labels, records)
    assert [(r.crop_id, r.truth, r.image_id, r.box_index) for r in plates.collect()] == [("a#b#1", "AB1", "a#b", 1)]
    assert {r.crop_id: r.reason for r in skipped.collect()} == {"a#b#2": "no_such_box", "a#b#z": "no_such_box", "c#0": "no_file_name", "d#0": "no_such_box", "e#0": "no_such_box", "gone#0": "no_record", "bare": "no_record"}
    plates, skipped = evaluate.labelled_plates(labels, records, spark.createDataFrame([("d.png",)], "file string"))
    assert plates.count() == 0 and skipped.where("reason = 'image_missing'").count() == 1


def test_numbers_along_an_order(spark):
    from sightline.operators.runs import numbered

    rows = [(f"k{(i * 7919) % 1000:04d}",) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "k string").repartition(5), ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000))
    assert numbered(spark.createDataFrame([], "k string"), ["k"], "n").count() == 0


def test_medians_of_several_columns_refine_their_range(spark, monkeypatch):
    from sightline.operators.stats import exact_medians

    r = random.Random(3)
    rows = [(r.choice([r.random(), 5.0, None, float("nan")]), float(i)) for i in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double")
    kept = sorted(a for a, _ in rows if a is not None and a == a)
    want = (kept[(len(kept) - 1) // 2] + kept[len(kept) // 2]) / 2
    monkeypatch.setattr("sightline.operators.stats.RANKED", 20)
    assert exact_medians(df, "a", "b") == (want, 2000.0)
    assert exact_medians(df.limit(0), "a", "b") == (None, None)


def test_components_finish_in_one_task_or_not_alike(spark, monkeypatch):
    from sightline import runtime
    from sightline.operators.components import components, named_by_smallest

    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(40)] + [("b", "c"), ("c", "b"), ("d", "d"), (None, "x")], "x string, y string")
    got = []
    for most in (500_000, -1):
        monkeypatch.setattr("sightline.operators.components.TASK_EDGES", most)
        space = runtime.Workspace(spark, "t")
        got.append({tuple(r) for r in named_by_smallest(space, components(space, edges)).collect()})
    assert got[0] == got[1] == {(f"a{i}", "a0") for i in range(41)} | {("b", "b"), ("c", "b")}


def test_first_result_and_alignment(spark):
    from sightline.functions.text import first_result

    rows = [('[{"rec_text": "AB1", "rec_score": 0.5}, {"rec_text": "X"}]',), ('[{"rec_text": null, "rec_score": "high"}]',), ("[]",), ("no json",), (None,)]
    got = spark.createDataFrame(rows, "r string").select(*first_result(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("AB1", 0.5)] + [("", 0.0)] * 4
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "image_id string"), spark.createDataFrame([("y",), ("x",), ("x",)], "image_id string")
    evaluate.check_aligned(a, b)
    with pytest.raises(ValueError, match="1 of the truth, 0 of the predictions"):
        evaluate.check_aligned(a, b.where("image_id = 'x'"))
