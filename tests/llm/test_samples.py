import random
from fractions import Fraction

import numpy as np
import pytest

from sightline.llm.balanced_sample import BUCKETS, balanced_samples, flight
from sightline.llm.frozen_sample import frozen_sample
from sightline.llm.top_n import top_n

CROPS = "crop_id string, image_id string, width_px int, bucket string, batch_no int, hash string, cell string, p double"
PLANS = "plan_id int, bucket string, target_pct int, min_rows long, sample_rows long, available string"
NAMES = ["tiny (<32px)", "small (32-64px)", "medium (64-128px)", "large (>=128px)"]


def crops(n, seed=0):
    r = random.Random(seed)
    rows = [(f"c{i}", f"i{i // 2}", r.choice([None, 0, -1, 5, 40, 100, 100, 100, 300]), r.choice([*NAMES, None, "odd"]), r.choice([1, 1, 1, 2, 3, None]), "x", "y", 0.5) for i in range(n)]
    rows += [(*x[:4], 3, *x[5:]) for x in rows[:50]]
    return [*rows, (None, None, 5, None, 1, "", "", 0.0), ("", "", 5, None, 1, "", "", 0.0)]


def test_frozen_sample_sizes_and_growth(spark):
    rows = crops(700)
    df = spark.createDataFrame(rows, CROPS)
    first = {}
    for x in rows:
        if x[0] is not None and x[4] is not None:
            first[x[0]] = min(x[4], first.get(x[0], 9))
    got = {r.crop_id: r.batch_no for r in frozen_sample(df, "crop_id", "batch_no", Fraction(1, 10)).collect()}
    assert all(first[c] == b for c, b in got.items())
    for b in (1, 2, 3):
        size = sum(v == b for v in first.values())
        assert sum(v == b for v in got.values()) == -(-size // 10)
    early = {r.crop_id for r in frozen_sample(df.where("batch_no <= 2").repartition(7), "crop_id", "batch_no", Fraction(1, 10)).collect()}
    assert early == {c for c, b in got.items() if b <= 2}
    assert frozen_sample(df.limit(0), "crop_id", "batch_no", Fraction(1, 10)).count() == 0
    assert frozen_sample(df, "crop_id", "batch_no", Fraction(1)).count() == len(first)
    assert frozen_sample(df, "crop_id", "batch_no", Fraction(0)).count() == 0
    with pytest.raises(ValueError):
        frozen_sample(df, "crop_id", "batch_no", Fraction(2))


def test_flight_keeps_the_sum_and_the_probabilities():
    hits = np.zeros(9)
    for s in range(4000):
        p = flight(np.full(9, 1 / 3), np.random.default_rng(s))
        assert set(np.unique(p)) <= {0.0, 1.0}
        assert p.sum() == 3
        hits += p
    assert abs(hits / 4000 - 1 / 3).max() < 0.04
    p = flight(np.full(5, 0.5), np.random.default_rng(1))
    assert p.sum() == pytest.approx(2.5)
    assert ((p > 0) & (p < 1)).sum() == 1


def test_balanced_samples(spark):
    df = spark.createDataFrame(crops(3000, 1), CROPS)
    plans = [(1, NAMES[0], 10, 5, 1000, ""), (1, NAMES[1], 20, 5, 1000, ""), (1, NAMES[2], 70, 5, 1000, ""), (2, NAMES[3], 1, 7, 10, ""), (2, "gone", 50, 3, 10, ""), (3, NAMES[2], 33, 0, 10, ""), (None, NAMES[2], 33, 0, 10, ""), (4, NAMES[3], None, None, 10, "")]
    plans = spark.createDataFrame(plans, PLANS)
    sample, report = balanced_samples(df, plans, cell_rows=100, fan_in=4)
    rows = {(r.plan_id, r.bucket): r for r in report.collect()}
    assert len(rows) == 7
    for r in rows.values():
        quota = min(r.wanted, r.available)
        assert abs(r.drawn - quota) < 1
        assert r.residual == r.drawn - r.wanted
        assert r.short == (r.available < r.wanted)
    assert rows[(2, "gone")].short
    assert rows[(1, NAMES[0])].drawn == 100
    got = sorted(map(tuple, sample.collect()))
    assert len(set(got)) == len(got)
    again = sorted(map(tuple, balanced_samples(df.repartition(9), plans, cell_rows=100, fan_in=4)[0].collect()))
    assert got == again
    sample, report = balanced_samples(df.limit(0), plans)
    assert sample.count() == 0
    assert {r.short for r in report.where("wanted > 0").collect()} == {True}


def brute_top(rows, n):
    best = {}
    for s, t, f, i, c in rows:
        if t is not None and c is not None and c == c and 0 <= c <= 1:
            k = (s, t)
            best.setdefault(k, {})
            best[k][(f, i)] = max(c, best[k].get((f, i), -1))
    out = set()
    nul = lambda v: (v is not None, v or 0)
    for k, v in best.items():
        for (f, i), c in sorted(v.items(), key=lambda x: (-x[1], nul(x[0][0]), nul(x[0][1])))[:n]:
            out.add((*k, f, i, c))
    return out


@pytest.mark.parametrize("n", [1, 3])
def test_top_n_equals_brute_force(spark, n):
    r = random.Random(n)
    rows = []
    for _ in range(3000):
        rows.append((r.choice(["a", "b", None]), r.choice([None, 1, 1, 1, 1, 1, *range(2, 200)]), r.choice([None, *range(30)]), r.randrange(2), r.choice([None, float("nan"), 1.5, -0.1, 1.0, 0.9, 0.5, 0.1, round(r.random(), 1)])))
    rows += rows[:300]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "source string, track_id int, frame int, det_index int, confidence double, s int, c0 string")
    for bands in (1, 3, 5):
        got = [tuple(x) for x in top_n(df, ["source", "track_id"], "confidence", ["frame", "det_index"], n, 0.0, 1.0, bands).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute_top(rows, n)
    assert top_n(df.limit(0), ["source", "track_id"], "confidence", ["frame"], n).count() == 0


def test_landing_keeps_the_size_of_a_plan(spark):
    names = [b for b, _ in BUCKETS]
    crops = spark.createDataFrame([(f"c{i}", None, names[i % 4]) for i in range(400)], "crop_id string, width_px int, bucket string")
    plans = spark.createDataFrame([(p, b, 25, 0, 101) for p in range(30) for b in names], "plan_id int, bucket string, target_pct int, min_rows long, sample_rows long")
    sample, report = balanced_samples(crops, plans, cell_rows=40, fan_in=3)
    rows = report.collect()
    assert {sum(r.drawn for r in rows if r.plan_id == p) for p in range(30)} == {101}
    # 25.25 of each bucket: 25 or 26, and the residuals of a plan cancel.
    assert {r.drawn for r in rows} == {25, 26} and all(abs(sum(r.residual for r in rows if r.plan_id == p)) < 1e-9 for p in range(30))
    assert sample.count() == sample.distinct().count() == 3030


def test_plans_in_portions(spark, monkeypatch):
    monkeypatch.setattr("sightline.llm.balanced_sample.PLAN_ROWS", 3)
    crops = spark.createDataFrame([(f"c{i}", 40, "x") for i in range(60)], "crop_id string, width_px int, bucket string")
    plans = spark.createDataFrame([(p, "small (32-64px)", 100, 0, p) for p in range(1, 12)], "plan_id int, bucket string, target_pct int, min_rows long, sample_rows long")
    assert {r.plan_id: r.drawn for r in balanced_samples(crops, plans)[1].collect()} == {p: p for p in range(1, 12)}
