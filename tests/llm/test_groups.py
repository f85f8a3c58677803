import random

import numpy as np
import pytest

from sightline.llm.entity_splits import QUARANTINE, EntitySplits
from sightline.llm.match_groups import grouped, match_groups
from sightline.operators.components import rooted


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(up)}


def test_match_groups_equals_union_find(spark):
    r = random.Random(2)
    pairs = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]  # a chain
    pairs += [("hub", f"s{i}") for i in range(80)]  # a star
    pairs += [(f"x{r.randrange(150)}", f"x{r.randrange(150)}") for _ in range(90)]
    pairs += [(b, a) for a, b in pairs[:40]] + [("self", "self"), (None, "x1"), ("x1", None), ("", "empty")] + pairs[:20]
    df = spark.createDataFrame([(*p, "c", 1) for p in pairs], "l string, r string, v string, at int")
    got = [tuple(x) for x in match_groups(df, "l", "r").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pairs)


def test_match_groups_of_nothing(spark):
    df = spark.createDataFrame([("a", "a"), (None, "b")], "l string, r string")
    assert match_groups(df, "l", "r").collect() == []
    assert match_groups(df.limit(0), "l", "r").columns == ["id", "group_id"]


BATCH = "record_id string, keys array<string>, node string, split string"
TARGETS = {"train": 0.7, "val": 0.15, "test": 0.15}


def batch(spark, rows):
    return spark.createDataFrame([(i, k, "n", "s") for i, k in rows], BATCH)


def state(store):
    return {r.record_id: (r.comp, r.split) for r in store.records().collect()}


def test_entities_keep_together_and_keep_their_split(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"i{i}", [r.choice([None, f"g{r.randrange(60)}"]), r.choice([None, "hot", f"c{r.randrange(80)}"])]) for i in range(300)]
    rows += [(None, ["g1"]), ("alone", None), ("empty", []), rows[0]]
    store = EntitySplits(spark, str(tmp_path / "s"), TARGETS)
    assert store.records().count() == 0
    store.apply(batch(spark, rows[:180]))
    one = state(store)
    store.apply(batch(spark, rows[150:]))
    two = state(store)
    pairs = [(f"r{i}", f"k{k}") for i, ks in rows if i for k in ks or [] if k]
    want = {}
    for x, root in brute(pairs):
        want.setdefault(root, set()).add(x[1:])
    want = sorted(sorted(x for x in v if x.startswith("i")) for v in want.values())
    comps = {}
    for i, (c, _) in two.items():
        comps.setdefault(c, set()).add(i)
    assert sorted(sorted(v) for v in comps.values() if len(v) > 1 or any(p[0] == f"r{next(iter(v))}" for p in pairs)) == [w for w in want if w]
    assert all(len({two[i][1] for i in v}) == 1 for v in comps.values())
    for i, (_, s) in one.items():
        assert two[i][1] in (s, QUARANTINE)
        if two[i][1] == QUARANTINE:
            assert len({one[j][1] for j in comps[two[i][0]] if j in one}) > 1
    assert {r.entity_id: min(comps[two[r.record_id][0]]) for r in store.entities().collect()} == {min(v): min(v) for v in comps.values() if len(v) > 1}


def test_conflicting_merge_is_quarantined_and_aliases_follow(spark, tmp_path):
    store = EntitySplits(spark, str(tmp_path / "s"), {"train": 0.5, "test": 0.5})
    store.apply(batch(spark, [("a1", ["a"]), ("a2", ["a"]), ("b1", ["b"]), ("b2", ["b"])]))
    one = state(store)
    assert {one["a1"][1], one["b1"][1]} == {"train", "test"}
    store.apply(batch(spark, [("x", ["a", "b"])]))
    assert {s for _, s in state(store).values()} == {QUARANTINE}
    store.apply(batch(spark, [("y", ["c"]), ("a1", ["c"])]))
    two = state(store)
    assert len({c for c, _ in two.values()}) == 1
    assert {s for _, s in two.values()} == {QUARANTINE}
    store.apply(batch(spark, []))
    assert state(store) == two


def test_shares_come_close(spark, tmp_path):
    store = EntitySplits(spark, str(tmp_path / "s"), TARGETS)
    store.apply(batch(spark, [(f"i{i}", [f"g{i // 7 if i < 600 else i}"]) for i in range(2000)]))
    for r in store.report().collect():
        assert abs(r.share - r.target_share) < 0.04
    # Stored groups grow in a later batch, and new ones make up for it.
    store.apply(batch(spark, [(f"j{i}", [f"g{i // 7 if i < 300 else 5000 + i}"]) for i in range(2000)]))
    for r in store.report().collect():
        assert abs(r.share - r.target_share) < 0.02
    with pytest.raises(ValueError):
        EntitySplits(spark, str(tmp_path / "z"), {"train": -1.0})


def test_results_are_the_same_without_broadcasts(spark, tmp_path, monkeypatch):
    from sightline import runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    pairs = [("hub", f"s{i}") for i in range(60)] + [("a", "b"), ("b", "c"), ("x", None)]
    got = {tuple(x) for x in match_groups(spark.createDataFrame(pairs, "l string, r string"), "l", "r").collect()}
    assert got == brute(pairs)
    store = EntitySplits(spark, str(tmp_path / "s"), TARGETS)
    store.apply(batch(spark, [(f"i{i}", ["hot"]) for i in range(50)] + [(f"j{i}", [f"g{i % 5}"]) for i in range(20)] + [("k", None)]))
    store.apply(batch(spark, [("i50", ["hot"]), ("j20", ["g1", "g2"])]))
    sets = {}
    for r in store.entities().collect():
        sets.setdefault(r.entity_id, set()).add(r.record_id)
    assert len(sets["i0"]) == 51
    assert len(store.records().collect()) == 73
    assert sum(map(len, sets.values())) == 72


def test_the_finish_of_small_graphs_groups_like_a_search():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (400, 350), (400, 4000)):
        x, y = r.integers(0, n, m), r.integers(0, n, m)
        got = grouped(x[x != y], y[x != y], n, 0.5, 3, np.random.default_rng(1))
        root = rooted(x, y, n)
        assert len(set(zip(got, root))) == len(set(got)) == len(set(root))


def test_levels_without_the_finish(spark, monkeypatch):
    monkeypatch.setattr("sightline.llm.match_groups.TASK_EDGES", -1)
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(30)] + [("hub", f"b{i}") for i in range(20)]
    got = {r.id: r.group_id for r in match_groups(spark.createDataFrame(pairs, "l string, r string"), "l", "r").collect()}
    assert got == {**{f"a{i}": "a0" for i in range(31)}, **{f"b{i}": "b0" for i in range(20)}, "hub": "b0"}


def test_versions_are_merged_as_they_gather(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sightline.llm.entity_splits.MERGED", 2)
    store = EntitySplits(spark, f"{tmp_path}/merged", {"train": 0.5, "test": 0.5})
    for i in range(5):
        store.apply(spark.createDataFrame([(f"r{i}", [f"k{i}", f"k{max(0, i - 2)}"]), (f"s{i}", None)], "record_id string, keys array<string>"))
    assert store._manifest(5)["folders"] == [["4-2", 2], ["5", 0]]
    rows = {r.record_id: (r.comp, r.split) for r in store.records().collect()}
    assert len(rows) == 10 and len({rows[f"r{i}"][0] for i in (0, 1, 2, 3, 4)}) in (1, 2)
    assert rows["r0"][0] == rows["r2"][0] == rows["r4"][0] and rows["r1"][0] == rows["r0"][0]
    n = {r.split: r.records for r in store.report().collect()}
    assert {k: v for k, v in store._manifest(5)["sizes"].items() if v} == {k: v for k, v in n.items() if v}
    store.vacuum()
    assert {r.record_id: (r.comp, r.split) for r in store.records().collect()} == rows
