import random

import numpy as np

from sightline.llm import bitmap
from sightline.llm.cross_split import coverage, cross_split_ends, cross_split_pairs, near_hash_pairs
from sightline.llm.leak_search import WINDOW, leaked_items, search, words
from sightline.llm.suffix_array import common_bits

HASHES = "image_id string, dhash long, contrast int, region string, split string, source_tag string, bits int, train string"
PAIRS = "left_id string, right_id string, distance int, left_split string, right_split string, dhash int"


def side(s):
    s = None if s is None else s.strip(" ").lower()
    return {"valid": "val", "validation": "val"}.get(s, s if s in ("train", "val", "test") else None)


def brute(hashes, pairs):
    out = set()
    rows = [h for h in set(hashes) if None not in (h[0], h[1], h[2]) and side(h[4])]
    for a in rows:
        for b in rows:
            if a[0] == b[0] or side(a[4]) != "train" or side(b[4]) == "train":
                continue
            bits = ((a[1] ^ b[1]) & (2**64 - 1)).bit_count()
            known = all(x[3] not in (None, "XX") for x in (a, b))
            same = bits == 0 and (a[2] <= 4) == (b[2] <= 4)
            if same or (1 <= bits <= (2 if known and a[3] != b[3] else 5) and a[2] > 4 and b[2] > 4):
                out.add(tuple(sorted((a[0], b[0]))))
    for x, y, d, s, t, *_ in pairs:
        if None not in (x, y, d) and x != y and 0 <= d <= 5 and side(s) and side(t) and (side(s) == "train") != (side(t) == "train"):
            out.add(tuple(sorted((x, y))))
    return out


def test_cross_split_pairs_equal_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) - 2**63 for _ in range(25)] + [0, -1]
    hashes = []
    for i in range(420):
        h = r.choice(base)
        for b in r.sample(range(64), r.choice([0, 0, 1, 2, 3, 4, 5, 6, 7])):
            h ^= (1 << b) if b < 63 else -(1 << 63)
        hashes.append((f"i{r.randrange(380)}", r.choice([h] * 9 + [None]), r.choice([None, 0, 4, 5, 90, 90, 90]), r.choice([None, "XX", "IN", "DE"]), r.choice(["train", "train", " TRAIN", "val", "Valid", "validation ", "test", None, "odd"]), r.choice(["a", None]), 1, "t"))
    pairs = [(f"i{r.randrange(99)}", r.choice([None, f"i{r.randrange(99)}"]), r.choice([None, -1, 0, 5, 6]), r.choice(["train", "test", None]), r.choice(["Train ", "valid", None]), 1) for _ in range(200)]
    h, p = spark.createDataFrame(hashes + hashes[:30], HASHES), spark.createDataFrame(pairs, PAIRS)
    got = [tuple(x) for x in cross_split_pairs(h, p).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(hashes, pairs)
    assert coverage(cross_split_pairs(h, p), h).count() > 0
    assert cross_split_pairs(h.limit(0), p.limit(0)).count() == 0


def test_the_array_finds_near_hashes_from_either_starting_points(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = {}
    for _ in range(500):
        h = r.choice(base)
        for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 5, 6])):
            h ^= 1 << b
        t = r.random() < 0.5
        a, b = rows.get(h, (False, False))
        rows[h] = (a or t, b or not t)
    want = {(x - 2**63, y - 2**63, (x ^ y).bit_count()) for x, (t, _) in rows.items() for y, (_, h) in rows.items() if t and h and 1 <= (x ^ y).bit_count() <= 5}
    df = spark.createDataFrame([(h - 2**63, *f) for h, f in rows.items()], "dhash long, in_train boolean, in_held boolean").repartition(3)
    plain = {tuple(x) for x in near_hash_pairs(df, turned=False).collect()}
    for many in (False, True):
        got = [tuple(x) for x in near_hash_pairs(df, many=many).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert plain < want and len(plain) > len(want) / 4
    a = np.array([0b1011, 0b1011, 0b1000, 0])
    assert common_bits(a[1:], a[:-1], np.full(3, 4)).tolist() == [4, 2, 0]


def brute_coverage(hashes, pairs, sources):
    held = set()
    rows = [h for h in set(hashes) if None not in (h[0], h[1], h[2]) and side(h[4])]
    for t in rows:
        for h in rows:
            if side(t[4]) == "train" != side(h[4]) and brute([t, h], []):
                held.add((tuple(sorted((t[0], h[0]))), h[0], side(h[4])))
    for x, y, d, s, t, *_ in pairs:
        if brute([], [(x, y, d, s, t)]):
            held.add((tuple(sorted((x, y))), *((y, side(t)) if side(s) == "train" else (x, side(s)))))
    out = {}
    for _, i, split in held:
        tags = sorted(h[5] for h in hashes if h[0] == i and h[5] is not None) or [t for p, t in sorted(sources, key=lambda s: -len(s[0])) if i.startswith(p)] or [None]
        k = out.setdefault((split, tags[0]), [0, set()])
        k[0] += 1
        k[1].add(i)
    return {(*k, n, len(ids)) for k, (n, ids) in out.items()}


def test_coverage_counts_held_out_ends(spark):
    hashes = [("co-1", 7, 90, None, "train", "a", 1, "t"), ("co-2", 7, 90, None, "val", "a", 1, "t"), ("co-2", 7, 90, None, "test", None, 1, "t"), ("co-3", 7, 90, None, "train", None, 1, "t"), ("co-3", 8, 90, None, "val", None, 1, "t"), ("x-6", 7, 2, None, "val", "b", 1, "t"), ("co-1", None, None, None, None, "0", 1, "t")]
    pairs = [("co-8", "co-night-9", 3, " Train", "VALID", 1), ("co-night-9", "co-8", 2, "validation", "train", 1), ("y-1", "co-1", 0, "test", "train", 1), ("co-9", "y-1", 1, "train", "val", 1), ("co-9", "x-6", 6, "train", "val", 1), ("x-6", "co-9", 5, "test ", "train", 1), ("co-4", "co-5", 1, "val", "test", 1), ("co-4", "co-5", 1, None, "test", 1)]
    sources = [("co-", "coast"), ("co-night-", "night")]
    h, p, s = spark.createDataFrame(hashes, HASHES), spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(sources, "id_prefix string, source_tag string")
    ends = cross_split_ends(h, p)
    got = [tuple(x) for x in coverage(ends, h, s).collect()]
    assert ("val", "night", 1, 1) in got and ("test", None, 1, 1) in got
    assert len(got) == len(set(got))
    assert set(got) == brute_coverage(hashes, pairs, sources)
    assert set(map(tuple, coverage(ends, h).collect())) == brute_coverage(hashes, pairs, [])
    assert set(map(tuple, ends.select("left_id", "right_id").collect())) == brute(hashes, pairs)
    assert coverage(cross_split_ends(h.limit(0), p.limit(0)), h, s).count() == 0


def brute_leaks(docs, items):
    out = set()
    for d, t, *_ in docs:
        for i, s, *_ in items:
            a, b = words(t or ""), words(s or "")
            own = {tuple(a[k : k + WINDOW]) for k in range(len(a) - WINDOW + 1)}
            if d is not None and i is not None and any(tuple(b[k : k + WINDOW]) in own for k in range(len(b) - WINDOW + 1)):
                out.add((d, i))
    return out


def test_words_as_compared():
    text = "The \\emph{rapid} ca-\n% mera~\\cite[p.~3]{key9} of­ the conﬁned {\\bf Field}, it\\-self \\begin{quote}non-linear---flow\\end{quote}\r\nEND​."
    assert words(text) == "the rapid camera of the confined field itself nonlinear flow end".split()
    assert words("") == []


def test_filter_finds_every_code(spark):
    r = np.random.default_rng(3)
    codes = r.integers(-(2**63), 2**63, 5000)
    rows = spark.createDataFrame([(int(c),) for c in codes] + [(int(codes[0]),), (None,)], "code long")
    bits, words_ = bitmap.build(rows, "code")
    assert len(bitmap.members(bits, words_, codes.view(np.uint64))) == 5000
    others = r.integers(0, 2**63, 20000).astype(np.uint64)
    assert len(bitmap.members(bits, words_, others)) < 200
    bits, words_ = bitmap.build(rows.limit(0), "code")
    assert not words_.any() and bits == bitmap.LEAST


def test_search_counts_its_steps(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, " ".join(text.split()[:12]) + " x"), (3, " ".join(text.split()[3:11]))], "doc_id long, text string")
    found = search(docs, spark.createDataFrame([(1, text), (2, text), (3, "a " * 12)], "item_id long, text string"))
    assert {tuple(x) for x in found.pairs.collect()} == {(d, i) for d in (1, 2) for i in (1, 2)}
    # 29 windows of the text and one more; the prefixes of all 29 are met in document 1, at their only place, that of the first also in 2.
    assert [x.windows for x in found.steps.orderBy("step").collect()][:3] == [30, 29, 29]
    assert found.steps.where("step LIKE '6%'").first().windows == 30


def test_leaks_equal_brute_force(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([5, 12, 13, 60])))) for i in range(30)]
    items += [(30, items[5][1]), (31, None), (32, ""), (None, "x " * 30), (33, "a " * 40), items[0]]
    docs = []
    for d in range(120):
        ws = r.choices(vocab, k=r.choice([0, 3, 50, 300]))
        for _ in range(r.choice([0, 1, 2])):
            w = (items[r.randrange(30)][1] or "").split()
            n = r.choice([4, 11, 12, 13, 40])
            s = r.randrange(len(w))
            at = r.randrange(len(ws) + 1)
            ws[at:at] = w[s : s + n]
        docs.append((d, r.choice([" ", "\n", ", "]).join(ws)))
    docs += [(900, None), (901, ""), (902, "a " * 12), (903, "a " * 11), (904, items[3][1] * 200), (None, items[3][1])]
    got = [tuple(x) for x in leaked_items(spark.createDataFrame([(*x, "p", 1) for x in docs], "doc_id long, text string, words string, item_id int"), spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_leaks(docs, items)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leaked_items(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
