import random
from collections import Counter

import numpy as np
import pytest

from sightline.llm.residue import evidence, inspect, is_field, is_filler, residue, without_residue
from sightline.llm.source_mix import VOCABULARY, encoder, mix, permuted

DOCS = "doc_id long, text string, source string, paper_key string, body long, block string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permuted_is_a_permutation(n):
    a = permuted(np.arange(n), n, 3)
    assert sorted(a.tolist()) == list(range(n))
    if n > 60:
        assert a.tolist() != permuted(np.arange(n), n, 4).tolist()


def corpus(spark, n=240):
    r = random.Random(4)
    rows = []
    for i in range(n):
        s = r.choice(["big"] * 5 + ["mid", "mid", "small", None, "other"])
        rows.append((i, r.choice([None, "", "x"] + [" ".join(r.choices("alpha beta gamma delta 12".split(), k=r.randrange(1, 400)))] * 12), s, None, 1, "b"))
    rows += rows[:20] + [(None, "lost", "big", None, 1, "b"), (n, "long " * 30_000, "mid", None, 1, "b")]
    return rows, spark.createDataFrame(rows, DOCS)


def test_mix(spark):
    rows, docs = corpus(spark)
    targets = [("big", 0.2, 1, 0), ("mid", 0.5, 2, 0), ("small", 0.2, 3, 0), ("gone", 0.1, 4, 0), (None, 0.3, 1, 0), ("small", None, 9, 0)]
    m = mix(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int, tokens int"), block_tokens=100, shard_blocks=32)
    encode = encoder(VOCABULARY).encode_ordinary
    size = {}
    for i, t, s, *_ in rows:
        if i is not None:
            size[i] = (s, len(encode(t or "")))
    total = sum(n for _, n in size.values())
    report = {r.source: r for r in m.report.collect()}
    assert set(report) == {"big", "mid", "small", "gone"}
    for s, share, cap, _ in targets[:4]:
        own = sum(n for x, n in size.values() if x == s)
        assert report[s].tokens == own
        assert report[s].short == (own * cap < share * total)
        assert report[s].rounds <= cap
        if not report[s].short:
            assert abs(report[s].drawn - share * total) < 0.25 * share * total
        else:
            assert report[s].drawn <= own * cap
    assert report["gone"].drawn == 0
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    held = Counter()
    for r in m.documents().collect():
        assert size[r.doc_id][0] == r.source
        held[r.doc_id] += r.tokens
    for i, n in held.items():
        cap = {"big": 1, "mid": 2, "small": 3}[size[i][0]]
        assert n <= cap * size[i][1]
    ids = m.tokens(docs.dropDuplicates(["doc_id"])).limit(20).collect()
    texts = {i: t for i, t, *_ in rows}
    for r in ids:
        assert list(r.ids) == encode(texts[r.doc_id])[r.first_token : r.first_token + len(r.ids)]
    again = mix(docs.repartition(5), spark.createDataFrame(targets, "source string, target_share double, max_repeats int, tokens int"), block_tokens=100, shard_blocks=32)
    assert sorted(map(tuple, again.slots.collect())) == sorted(map(tuple, m.slots.collect()))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mix(docs, targets)
    assert m.documents().count() == 0
    assert {r.source: (r.tokens, r.short) for r in m.report.collect()} == {"a": (0, False), "b": (0, False)}


@pytest.mark.parametrize("value", ["<<TITLE>>", "<title goes here>", "[[title]]", "[Paper Title]", "[INSERT TITLE HERE]", "{{ title }}", "${paper.title}", "#title#", "@@TITLE@@", "__TITLE__", "*** title ***", "::title::", "XXXX TITLE XXXX", "TBD: title", "Type the title here.", "Replace this line with the title.", "Your title here"])
def test_fields(value):
    assert is_field(value)
    doc = "\\documentclass{article}\n\\title{%s}\n\\author{A. One}\n\\begin{document}\n\\maketitle\n\\section{A}\nReal words stand here.\n\\end{document}"
    assert inspect(doc % value)["field"]
    assert not inspect(doc % "A plain title" + "\n% \\title{" + value + "}")["field"]
    assert not inspect(doc.replace("Real", f"The mark \\verb|{value}| is replaced. \\begin{{verbatim}}\n\n{value}\n\n\\end{{verbatim}} Real") % "A plain title")["field"]


@pytest.mark.parametrize("value", ["A local solver for sensors", "{A braced title}", "On $x < y$ and [[x]]", "Here comes the sun", ""])
def test_no_fields(value):
    assert not is_field(value)


def test_filler():
    assert is_filler("\\lipsum[1-4]")
    assert is_filler("Lorem ipsum dolor sit amet")
    assert is_filler("This is dummy text. " * 5)
    assert is_filler("word " * 30)
    assert is_filler("asdf jkl sdfg hjk fghj dfkl sjdk ghfj aksl")
    assert not is_filler("Participants saw a column of lorem ipsum while the ridge was recorded for ten minutes in all.")
    assert not is_filler("We show that the first bounds the second. We show that the third shifts the fourth. Nothing else is known.")
    body = "\\documentclass{a}\\begin{document}\n\\section{One}\nWords of its own stand here, many of them.\n\n%s\n\\end{document}"
    assert inspect(body % "\\lipsum[2]")["filler"]
    assert not inspect(body % "% \\lipsum[2]")["filler"]
    assert not inspect(body % "\\iffalse\n\n\\lipsum[2]\n\n\\fi")["filler"]


@pytest.mark.parametrize("text", ["HTTP/1.1 504 Gateway Timeout", "Error 403: forbidden.", "Please enable JavaScript to read this paper.", "<html><body>\n<p>Bitte aktivieren Sie JavaScript, um den Volltext zu lesen.</p></body></html>", "Veuillez activer les scripts pour lire cet article.", "Unable to extract text: the file is damaged.", "\\documentclass{a}\\title{On plates}\\begin{document}\n\\maketitle\nSorry, we cannot find the file you asked for.\n\\end{document}"])
def test_errors(text):
    assert inspect(text)["strong"]


@pytest.mark.parametrize("text", [None, "", " \n", "Erratum. In radial beam, read $k = 3$ for the weak norm.", "\\documentclass{a}\\title{T", "\\documentclass{a}\\begin{document}\\input{main}\\end{document}", "\\documentclass{a}\\begin{document}\\section{A}\nA page that answers ``404 Not Found'' was left out; please enable JavaScript.\\end{document}"])
def test_no_errors(text):
    x = inspect(text)
    assert not (x["strong"] or x["field"] or x["filler"])


def test_residue_on_a_table(spark):
    page = "\\documentclass{a}\\title{On radial plates}\\begin{document}\n\\maketitle\nThe viewer could not retry; reload 12.\n\\end{document}"
    rows = [(i, page, "ab"[i % 2], "key-1", 1, "") for i in range(6)]
    rows += [(10, page.replace("retry", "plates"), "a", None, 1, ""), (11, "Error 404: not found.", None, None, 1, ""), (11, "Error 404: not found.", None, None, 1, ""), (12, None, "a", None, 1, ""), (13, "", "a", None, 1, ""), (None, "Error 404: not found.", "a", None, 1, "")]
    rows += [(14, "word " * 50_000, "a", None, 1, ""), (15, "\\title{[[title]]}\n" + "real content, and more of it. " * 20_000, "a", None, 1, ""), (16, "Reload 12 at a later time.", "a", None, 1, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.reason for r in residue(df).collect()}
    assert got == {**{i: "error" for i in range(6)}, 11: "error", 14: "filler", 15: "field"}
    assert {r.doc_id for r in without_residue(df).collect()} == {None, 10, 12, 13, 16}
    assert residue(df.limit(0)).count() == 0


def test_untitled_responses_are_found_by_their_repetition(spark):
    html = "<html><head><title>Plates {0}</title></head><body><p>The viewer could not retry.</p></body></html>"
    said = ["The quota of this mirror is used up. Ticket 48{0}17.", "Please retry this in {0} minutes.", html, "\\documentclass{{a}}\\title{{T}}\\begin{{document}}\\pagestyle{{empty}}\n\\input main\n\\end{{document}}", "\\documentclass{{a}}\\begin{{document}}\nWe show", "This note corrects table {0}: the rotor is {0}.5 m."]
    rows = [(10 * k + i, t.format(i), "ab"[i % 2], f"pre-00-{i:06d}", 1, "") for k, t in enumerate(said) for i in range(6)]
    rows += [(100 + i, said[0].format(i).replace("mirror", "host"), "a", None, 1, "") for i in range(6)]  # a single host
    rows += [(110 + i, said[0].format(i).replace("mirror", "paper"), "ab"[i % 2], "paper-quota", 1, "") for i in range(6)]
    rows += [(120 + i, html.format("viewer"), "ab"[i % 2], None, 1, "") for i in range(6)]
    got = {r.doc_id for r in residue(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {10 * k + i for k in range(3) for i in range(6)}


def test_terms_and_hosts_decide_without_phrases(spark):
    """Titles tell what the corpus is about; pages that speak of nothing of it, alike on several hosts, are found without a phrase, whatever their length and form."""
    subject = [a + b for a in ("rotor", "beam", "plate", "lattic", "basin", "grain") for b in ("an", "el", "ic", "or", "uk", "ia", "en", "ux", "ym", "ok")]
    paper = "\\documentclass{{a}}\\title{{On the {0} of {1}s}}\\begin{{document}}\\section{{One}}\nThe {0} of this paper couples a {1} with each {2}.\n\\end{{document}}"
    rows = [(i, paper.format(subject[i % 60], subject[(7 * i + 1) % 60], subject[(i + 4) % 60]), "abc"[i % 3], f"pre-00-{i:06d}", 1, "") for i in range(80)]
    gone = "The shelf of this mirror stays shut until {0}. Come back then, or write to the keeper."
    rows += [(100 + i, gone.format(f"{i + 1} May"), "abc"[i % 3], None, 1, "") for i in range(9)]
    nav = "<html><body><ul>" + "".join(f"<li>Shelf {w} keeper mirror</li>" for w in ("one", "two", "ten", "six")) * 30 + "</ul><p>" + gone.format("June") + "</p></body></html>"
    rows += [(200, nav, "b", None, 1, "")]  # 500 words
    rows += [(201, "\\documentclass{a}\\title{On the rotor of beams}\\begin{document}\\section{Shelf}\n" + gone.format("July") + "\\end{document}", "a", None, 1, "")]  # in a section
    rows += [(300 + i, f"Erratum. In the {subject[i % 60]} of the paper, read {i} for {i + 1}.", "abc"[i % 3], None, 1, "") for i in range(9)]  # notes that speak of something
    rows += [(400, "Le tiroir reste vide.", "a", None, 1, ""), (401, "", "a", None, 1, ""), (402, None, None, None, 1, "")]
    df = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in evidence(df, phrases=False).collect()}
    assert set(found) == {*range(100, 109), 200, 201}
    assert all(r.reason == "error" and r.bare and r.hosts and not r.phrase for r in found.values())
    assert {r.doc_id for r in residue(df).collect()} == set(found)
