import random

import pytest

from sightline.operators.sessions import SessionTable, incremental_sessions, merge_intervals, sessionize

SCHEMA = "k string, ts_us long, i int, _chunk string, n string"


def brute(rows, gap):
    out, by = set(), {}
    for k, t, i, *_ in rows:
        if t is not None:
            by.setdefault(k, set()).add((t, -1 if i is None else i))
    for k, v in by.items():
        v = sorted(v)
        cur = [v[0][0], v[0][0], 0]
        for t, _ in v:
            if t - cur[1] >= gap:
                out.add((k, *cur))
                cur = [t, t, 0]
            cur[1] = t
            cur[2] += 1
        out.add((k, *cur))
    return out


def data(seed, n=400):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None] + [r.randrange(6000)] * 9), r.choice([None, 1, 2]), "x", "y") for _ in range(n)]
    return rows + rows[: n // 5]


def as_set(df):
    return {(r.k, r.start_us, r.end_us, r.n) for r in df.collect()}


@pytest.mark.parametrize("chunk", [7, 100, 10**9])
def test_sessionize_equals_brute_force_for_any_chunk(spark, chunk):
    rows = data(chunk)
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_set(sessionize(df, ["k"], identity=["i"], gap_us=10, chunk_us=chunk)) == brute(rows, 10)


def test_boundary_opens_a_session(spark):
    df = spark.createDataFrame([("a", 0, 1, "", ""), ("a", 9, 1, "", ""), ("a", 19, 1, "", "")], SCHEMA)
    assert as_set(sessionize(df, ["k"], gap_us=10)) == {("a", 0, 9, 2), ("a", 19, 19, 1)}


def test_merge_intervals_spanning_chunks(spark):
    rows = [("a", 0, 95, 5), ("a", 20, 30, 1), ("a", 41, 50, 1), ("a", 104, 104, 1), ("a", 200, 200, 1), (None, 1, 2, 1), ("a", None, 3, 9)]
    df = spark.createDataFrame(rows, "k string, start_us long, end_us long, n long")
    assert as_set(merge_intervals(df, ["k"], 10, 15)) == {("a", 0, 104, 8), ("a", 200, 200, 1), (None, 1, 2, 1)}


def test_batches_in_any_order_give_the_one_pass_result(spark, tmp_path):
    day = 86_400_000_000
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(4 * 20) * (day // 20), r.choice([1, 2]), "", "") for _ in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    gap = day // 20 + 1
    store = SessionTable(spark, str(tmp_path / "t"), ["k"], ["i"], gap, day // 3)
    schema = sessionize(df, ["k"], identity=["i"]).schema
    assert store.sessions(schema).count() == 0
    r.shuffle(rows)
    for part in (rows[:50], [], rows[30:110], rows[100:]):
        store.apply(spark.createDataFrame(part, SCHEMA))
    assert as_set(store.sessions(schema)) == brute(rows, gap)
    store.vacuum()
    assert as_set(store.sessions(schema)) == brute(rows, gap)
    store.apply(df.limit(0))
    assert as_set(store.sessions(schema)) == brute(rows, gap)


def test_incremental_sessions_on_dirty_and_empty_rows(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, plate string, source string, track_id int, frame int, logged_at timestamp, n int, day string"
    rows = [(t, "ab-1", "s", 1, 1, t, 0, ""), (t, "AB 1", "s", 1, 1, None, 0, ""), (t, "--", "s", 1, 1, t, 0, ""), (None, "A", "s", 1, 1, t, 0, ""), (t, "A", None, 1, 1, t, 0, "")]
    df = spark.createDataFrame(rows, schema)
    assert [(x.plate, x.sightings, x.duration_us) for x in incremental_sessions(df).collect()] == [("AB1", 1, 0)]
    assert incremental_sessions(df.limit(0)).count() == 0
