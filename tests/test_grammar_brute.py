"""The grammars' expressions against a search written plainly: every text within two confusions, scored one by one."""

import random
import re
from itertools import combinations, product

from sightline.functions import grammar as g


def fit(name, text, hint):
    if name == "IN":
        if re.match(g.IN_BH, text):
            return 1.0
        return (1.0 if text[:2] in g.STATES else 0.55) if re.match(g.IN_STANDARD, text) else None
    if name == "DE":
        m = re.match(g.DE_SHAPE, text)
        if not m or not 4 <= len(m[1]) + len(m[2]) <= 8:
            return None
        cuts = [m[1][:n] for n in (1, 2, 3) if len(m[1]) - n in (1, 2)]
        if not cuts:
            return None
        return 1.0 if sorted(cuts, key=lambda c: (c == hint, c in g.DISTRICTS, len(c)))[-1] in g.DISTRICTS else 0.8
    m = re.match(g.PL_STANDARD, text)
    if m and sum(c.isalpha() for c in m[2]) <= 2:
        return 1.0 if text[0] in g.VOIVODESHIPS else 0.6
    m = re.match(g.PL_INDIVIDUAL, text)
    return 0.85 if m and re.search("[0-9]", m[2]) else None


def search(raw):
    text = re.sub(r"^IND(?=[A-Z]{2}\d)", "", re.sub("[^A-Z0-9ÄÖÜ]", "", raw.upper()))
    hint = re.match(r"\s*([A-ZÄÖÜ]{1,3})\s*[-–—.\s]\s*(?=[A-Z])", raw.upper())
    hint = hint and hint[1]
    winner = None
    for name, (low, high) in g.GRAMMARS.items():
        if not low <= len(text) <= high:
            continue
        exact = fit(name, text, hint)
        top = None if exact is None else (exact, 0, text)
        for n in (1, 2) if exact != 1.0 else ():
            level = None
            for places in combinations([i for i, c in enumerate(text) if c in g.CONFUSABLE], n):
                for chars in product(*(g.CONFUSABLE[text[i]] for i in places)):
                    t = "".join(dict(zip(places, chars)).get(i, c) for i, c in enumerate(text))
                    f = fit(name, t, hint)
                    if f is not None and (level is None or round(f - n * g.EDIT_PENALTY, 3) > level[0]):
                        level = (round(f - n * g.EDIT_PENALTY, 3), n, t)
            if level and level[0] > (exact if exact is not None else -1):
                top = level
                break
        if top and (winner is None or (top[0], -top[1]) > (winner[0], -winner[1])):
            winner = (*top, name)
    return winner if winner and winner[0] >= g.MIN_CONFIDENCE else None


def test_parse_equals_plain_search(spark):
    r = random.Random(9)
    raws = set()
    for _ in range(500):
        kind = r.randrange(5)
        letters, digits = lambda n: "".join(r.choices("ABDGILOQSTZHMNPÖ", k=n)), lambda n: "".join(r.choices("0123456789", k=n))
        t = [lambda: r.choice(list(g.STATES)) + digits(2) + letters(2) + digits(4), lambda: r.choice(list(g.DISTRICTS)) + r.choice("- .") + letters(2) + " " + digits(3) + r.choice(["", "E"]), lambda: r.choice(list(g.VOIVODESHIPS)) + letters(1) + digits(4) + letters(1), lambda: digits(2) + "BH" + digits(4) + letters(1), lambda: "".join(r.choices("ABDOIL01258ZQSG", k=r.randrange(3, 12)))][kind]()
        for i in range(r.choice([0, 1, 1, 2, 3])):
            p = r.randrange(len(t))
            if t[p] in g.CONFUSABLE:
                t = t[:p] + r.choice(g.CONFUSABLE[t[p]]) + t[p + 1 :]
        raws.add(r.choice(["", "IND", " "]) + t)
    df = spark.createDataFrame([(x,) for x in raws], "raw string")
    got = {x.raw: x.match and (x.match.confidence, x.match.edits, x.match.text, x.match.region) for x in g.parse_plates(df, "raw").collect()}
    assert got == {x: search(x) for x in raws}
