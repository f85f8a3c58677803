"""Plate grammars and their bounded correction, as expressions that stay in the JVM.

A grammar is scored by an expression of a candidate text.  Correction lists
every text within two confusable characters as an array, scores it, and keeps
the best; it runs once per distinct reading and is joined back.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import runtime
from sightline.functions.text import district_hint, normalize_plate

# Codes of states and union territories on Indian plates.
STATES = {
    "AN": "Andaman and Nicobar Islands", "AP": "Andhra Pradesh", "AR": "Arunachal Pradesh", "AS": "Assam", "BR": "Bihar", "CG": "Chhattisgarh", "CH": "Chandigarh", "DD": "Daman and Diu",
    "DL": "Delhi", "DN": "Dadra and Nagar Haveli", "GA": "Goa", "GJ": "Gujarat", "HP": "Himachal Pradesh", "HR": "Haryana", "JH": "Jharkhand", "JK": "Jammu and Kashmir",
    "KA": "Karnataka", "KL": "Kerala", "LA": "Ladakh", "LD": "Lakshadweep", "MH": "Maharashtra", "ML": "Meghalaya", "MN": "Manipur", "MP": "Madhya Pradesh",
    "MZ": "Mizoram", "NL": "Nagaland", "OD": "Odisha", "OR": "Odisha (former)", "PB": "Punjab", "PY": "Puducherry", "RJ": "Rajasthan", "SK": "Sikkim",
    "TN": "Tamil Nadu", "TG": "Telangana", "TR": "Tripura", "TS": "Telangana (former)", "UA": "Uttarakhand (former)", "UK": "Uttarakhand", "UP": "Uttar Pradesh", "WB": "West Bengal",
}
# The German districts that raise confidence.
DISTRICTS = {
    "A": "Augsburg", "AA": "Ostalbkreis", "AC": "Aachen", "B": "Berlin", "BA": "Bamberg", "BI": "Bielefeld", "BN": "Bonn", "BO": "Bochum", "BS": "Braunschweig", "C": "Chemnitz",
    "CB": "Cottbus", "CO": "Coburg", "D": "Düsseldorf", "DA": "Darmstadt", "DD": "Dresden", "DO": "Dortmund", "DU": "Duisburg", "E": "Essen", "EF": "Erfurt", "EN": "Ennepe-Ruhr-Kreis",
    "ER": "Erlangen", "F": "Frankfurt am Main", "FD": "Fulda", "FR": "Freiburg", "FÜ": "Fürth", "G": "Gera", "GI": "Gießen", "GÖ": "Göttingen", "H": "Hannover", "HB": "Bremen",
    "HD": "Heidelberg", "HH": "Hamburg", "HL": "Lübeck", "HN": "Heilbronn", "HRO": "Rostock", "J": "Jena", "K": "Köln", "KA": "Karlsruhe", "KI": "Kiel", "KL": "Kaiserslautern",
    "KO": "Koblenz", "KS": "Kassel", "L": "Leipzig", "LU": "Ludwigshafen", "LÖ": "Lörrach", "M": "München", "MA": "Mannheim", "MD": "Magdeburg", "MI": "Minden-Lübbecke", "MZ": "Mainz",
    "N": "Nürnberg", "OB": "Oberhausen", "OF": "Offenbach", "OL": "Oldenburg", "OS": "Osnabrück", "P": "Potsdam", "PB": "Paderborn", "R": "Regensburg", "RO": "Rosenheim", "S": "Stuttgart",
    "SB": "Saarbrücken", "SN": "Schwerin", "SU": "Rhein-Sieg-Kreis", "TR": "Trier", "TÜ": "Tübingen", "UL": "Ulm", "W": "Wuppertal", "WI": "Wiesbaden", "WÜ": "Würzburg", "Z": "Zwickau",
}
# First letters of Polish plates.
VOIVODESHIPS = {
    "B": "Podlaskie", "C": "Kujawsko-Pomorskie", "D": "Dolnośląskie", "E": "Łódzkie", "F": "Lubuskie", "G": "Pomorskie", "K": "Małopolskie", "L": "Lubelskie",
    "N": "Warmińsko-Mazurskie", "O": "Opolskie", "P": "Wielkopolskie", "R": "Podkarpackie", "S": "Śląskie", "T": "Świętokrzyskie", "W": "Mazowieckie", "Z": "Zachodniopomorskie",
}
# Characters that a reader takes for each other, and what one correction costs.
CONFUSABLE = {
    "0": "ODQ", "1": "IL", "2": "Z", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B",
    "O": "0", "D": "0", "Q": "0", "I": "1", "L": "1", "Z": "2", "A": "4", "S": "5", "G": "6", "T": "7", "B": "8",
}
EDIT_PENALTY, MIN_CONFIDENCE, MAX_EDITS = 0.18, 0.7, 2
# The shapes of the grammars.
IN_BH = r"^(\d{2})BH(\d{4})([A-Z]{1,2})$"
IN_STANDARD = r"^([A-Z]{2})(\d{1,2})([A-Z]{0,3})(\d{1,4})$"
DE_SHAPE = r"^([A-ZÄÖÜ]+)(\d{1,4})([EH]?)$"
PL_STANDARD = r"^([A-PR-Z]{2,3})((?:[0-9]|[ACEFGHJKLMNPRSTUVWXY]){4,5})$"
PL_INDIVIDUAL = r"^([BCDEFGKLNOPRSTWZ])([A-PR-Z0-9]{3,5})$"
#: Grammars in order of preference, with the lengths of text that each considers.
GRAMMARS = {"IN": (4, 11), "DE": (4, 9), "PL": (4, 8)}


def _table(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(d.items())))


def _in(c: Column, d: dict[str, str]) -> Column:
    return c.isin(list(d))


def _german_district(letters: Column, hint: Column) -> Column:
    """How a letter block divides: by the hint, then by known districts, then the longer one; null if it can't."""
    n = F.length(letters)
    longer, shorter = F.substring(letters, F.lit(1), F.least(n - 1, F.lit(3))), F.substring(letters, F.lit(1), F.greatest(n - 2, F.lit(1)))
    pick = F.when(longer == hint, longer).when(shorter == hint, shorter).when(_in(longer, DISTRICTS), longer).when(_in(shorter, DISTRICTS), shorter).otherwise(longer)
    return F.when(n.between(2, 5), pick)


def fit(grammar: str, text: Column, hint: Column) -> Column:
    """Confidence that a normalised text is a plate of the grammar; null if it isn't."""
    if grammar == "IN":
        known = _in(F.substring(text, 1, 2), STATES)
        return F.when(text.rlike(IN_BH), 1.0).when(text.rlike(IN_STANDARD), F.when(known, 1.0).otherwise(0.55))
    if grammar == "DE":
        letters, number = F.regexp_extract(text, DE_SHAPE, 1), F.regexp_extract(text, DE_SHAPE, 2)
        district = _german_district(letters, hint)
        ok = text.rlike(DE_SHAPE) & (F.length(letters) + F.length(number)).between(4, 8) & district.isNotNull()
        return F.when(ok, F.when(_in(district, DISTRICTS), 1.0).otherwise(0.8))
    if grammar == "PL":
        few = F.length(F.regexp_replace(F.regexp_extract(text, PL_STANDARD, 2), "[0-9]", "")) <= 2
        own = text.rlike(PL_INDIVIDUAL) & F.substring(text, F.lit(2), F.length(text)).rlike("[0-9]")
        return F.when(text.rlike(PL_STANDARD) & few, F.when(_in(F.substring(text, 1, 1), VOIVODESHIPS), 1.0).otherwise(0.6)).when(own, 0.85)
    raise ValueError(f"unknown grammar {grammar!r}")


def components(text: Column, region: Column, hint: Column) -> Column:
    """The named parts of a plate that fits ``region``'s grammar, as a map."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    named = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    name = lambda table, key: F.coalesce(F.try_element_at(_table(table), key), F.lit(""))
    bh = named("year", part(IN_BH, 1), "number", part(IN_BH, 2), "series", part(IN_BH, 3))
    state = part(IN_STANDARD, 1)
    india = named("state", state, "district", part(IN_STANDARD, 2), "series", part(IN_STANDARD, 3), "number", part(IN_STANDARD, 4), "state_name", name(STATES, state))
    letters, suffix = part(DE_SHAPE, 1), part(DE_SHAPE, 3)
    district = _german_district(letters, hint)
    de = named("district", district, "letters", F.substring(letters, F.length(district) + 1, F.length(letters)), "number", part(DE_SHAPE, 2), "suffix", suffix, "district_name", name(DISTRICTS, district))
    meaning = F.when(suffix == "E", "electric").otherwise("historic")
    de = F.when(suffix == "", de).otherwise(F.map_concat(de, named("suffix_meaning", meaning)))
    first = F.substring(text, 1, 1)
    standard = _polish_standard(text)
    code, series = F.when(standard, part(PL_STANDARD, 1)).otherwise(part(PL_INDIVIDUAL, 1)), F.when(standard, part(PL_STANDARD, 2)).otherwise(part(PL_INDIVIDUAL, 2))
    pl = named("code", code, "series", series, "voivodeship", name(VOIVODESHIPS, first))
    return F.when((region == "IN") & text.rlike(IN_BH), bh).when(region == "IN", india).when(region == "DE", de).when(region == "PL", pl)


def _polish_standard(text: Column) -> Column:
    return text.rlike(PL_STANDARD) & (F.length(F.regexp_replace(F.regexp_extract(text, PL_STANDARD, 2), "[0-9]", "")) <= 2)


def format_name(text: Column, region: Column) -> Column:
    """The rule within a country's grammar that a fitting text follows."""
    bh = (region == "IN") & text.rlike(IN_BH)
    return F.when(bh, "IN-BH").when((region == "PL") & ~_polish_standard(text), "PL-individual").otherwise(region)


def display(match: Column) -> Column:
    """A parsed plate as its country writes it."""
    c = match["components"]
    get = lambda k: F.try_element_at(c, F.lit(k))
    bh = F.concat_ws(" ", get("year"), F.lit("BH"), get("number"), get("series"))
    india = F.concat_ws(" ", get("state"), get("district"), F.nullif(get("series"), F.lit("")), get("number"))
    de = F.concat(get("district"), F.lit("-"), get("letters"), F.lit(" "), get("number"), get("suffix"))
    pl = F.concat(get("code"), F.lit(" "), get("series"))
    return F.when(match["format_name"] == "IN-BH", bh).when(match["region"] == "IN", india).when(match["region"] == "DE", de).when(match["region"] == "PL", pl)


def _alternatives(char: Column) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in CONFUSABLE.items())
    return F.coalesce(F.try_element_at(F.create_map(*pairs), char), F.array().cast("array<string>"))


def _replaced(text: Column, at: Column, char: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), char, F.substring(text, at + 1, F.length(text)))


def _edits(text: Column) -> tuple[Column, Column]:
    """All texts one and two confusable characters away, in order of positions and of alternatives."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    at = lambda i: _alternatives(F.substring(text, i, F.lit(1)))
    one = F.flatten(F.transform(places, lambda i: F.transform(at(i), lambda a: _replaced(text, i, a))))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    two = F.flatten(F.transform(pairs, lambda p: F.flatten(F.transform(at(p["i"]), lambda a: F.transform(at(p["j"]), lambda b: _replaced(_replaced(text, p["i"], a), p["j"], b))))))
    return one, two


def _best(grammar: str, candidates: Column, edits: int, hint: Column) -> Column:
    """The candidate of highest score, the first among equals: struct(score, order, text); null if none fits."""
    scored = F.transform(candidates, lambda c, i: F.struct(F.round(F.greatest(F.lit(0.0), fit(grammar, c, hint) - edits * EDIT_PENALTY), 3).alias("score"), (-i).alias("order"), c.alias("text")))
    return F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))


def parse_plates(df: DataFrame, raw: str, out: str = "match", region: str | None = None, max_edits: int = MAX_EDITS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``df`` with ``out``: the reading parsed against the grammars, or null.

    The struct has text, region, format_name, edits, confidence, components
    and original.  A grammar's exact fit stands if it is certain; otherwise
    one, and only if none was better, two confusable characters are replaced,
    and a corrected text wins if it scores higher.  Between grammars the
    higher confidence wins, then fewer edits, then the order IN, DE, PL.
    ``region`` restricts to one grammar (EU and XX have none: all null).

    Null and empty readings give null.  Each distinct reading is parsed once.
    """
    if not 0 <= max_edits <= 2:
        raise ValueError("max_edits must be 0, 1 or 2")
    text, hint = F.col("_text"), F.col("_hint")
    seen = df.select(F.col(raw).alias("_raw")).where("_raw IS NOT NULL").distinct()
    seen = seen.select("_raw", normalize_plate(F.col("_raw")).alias("_text"), district_hint(F.col("_raw")).alias("_hint")).where("_text <> ''")
    one, two = _edits(text)
    found = []
    for g, (low, high) in GRAMMARS.items():
        if region is not None and region != g:
            continue
        gate = F.length(text).between(low, high)
        seen = seen.withColumn(f"_x{g}", F.when(gate, fit(g, text, hint)))
        exact = F.col(f"_x{g}")
        open_ = gate & (F.coalesce(exact, F.lit(-1.0)) < 1.0)
        seen = seen.withColumn(f"_1{g}", F.when(open_ & F.lit(max_edits >= 1), _best(g, one, 1, hint)))
        better = lambda c, exact=exact: F.coalesce(c["score"] > F.coalesce(exact, F.lit(-1.0)), F.lit(False))
        first = F.col(f"_1{g}")
        seen = seen.withColumn(f"_2{g}", F.when(open_ & F.lit(max_edits >= 2) & ~better(first), _best(g, two, 2, hint)))
        second = F.col(f"_2{g}")
        pick = lambda c, n, g=g: F.struct(c["score"].alias("confidence"), F.lit(-n).alias("edits"), F.lit(-len(found)).alias("order"), c["text"].alias("text"), F.lit(g).alias("region"))
        plain = F.struct(exact.alias("confidence"), F.lit(0).alias("edits"), F.lit(-len(found)).alias("order"), text.alias("text"), F.lit(g).alias("region"))
        found.append(F.when(better(first), pick(first, 1)).when(better(second), pick(second, 2)).when(exact.isNotNull(), plain))
    if not found:
        seen = seen.withColumn("_best", F.lit(None).cast("struct<confidence: double, edits: int, order: int, text: string, region: string>"))
    else:
        seen = seen.withColumn("_best", F.array_max(F.array(*found)))
    b = F.col("_best")
    match = F.struct(
        b["text"].alias("text"), b["region"].alias("region"), format_name(b["text"], b["region"]).alias("format_name"), (-b["edits"]).alias("edits"), b["confidence"].alias("confidence"),
        components(b["text"], b["region"], hint).alias("components"), text.alias("original"),
    )
    # A written table keeps later filters from being copied into these expressions, and is computed once.
    seen = runtime.Workspace(df.sparkSession, "plates").cut(seen.select("_raw", F.when(b["confidence"] >= min_confidence, match).alias("_match")), "parsed")
    rows = df.withColumn("_raw", F.col(raw))
    if out != raw:
        rows = rows.drop(out)
    rows = runtime.lookup(rows, seen, ["_raw"], how="left")
    return rows.drop("_raw").withColumnRenamed("_match", out)
