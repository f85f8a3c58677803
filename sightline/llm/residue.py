"""Records in which template fields, filler, an error page or a notice demanding scripts stand where content should.

Every text is taken apart once: what is commented out, listed as code or
quoted is dropped; title, authors, abstract, sections and the body that is
left are looked at where they stand.

Responses are told by what they speak of.  The terms of all titles and address
slugs are the corpus's subjects (without the frame words that many titles
have), and a body with hardly a subject among its terms is thin, however long it is
and whatever sections it has.  A thin body that shares no term with its own
title and slug is an error page or notice if the rest of the evidence says so:
hosts (sources) that use the same terms in thin bodies, or repeat the same
body, or phrases of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import runtime
from sightline.llm import bitmap

#: A body with fewer subjects than this share of its terms is thin.
THIN = 1 / 8
#: Share of titles from which on a term frames titles instead of naming a subject, and the number of titles that it is at least.
FRAME, FRAME_TITLES = 0.05, 3
#: Records and sources that repeat a response before it counts as duplicated.
REPEATED, HOSTS = 5, 2
#: Thin records and sources that use a term before it counts as a term of responses, how many times as often thin bodies
#: must have it as others, and the share of a body's terms that have to be such.
TERM_RECORDS, TERM_HOSTS, TERM_TIMES, TERM_SHARE = 3, 2, 5, 0.5
#: Where there are no titles to compare with: words without sections for which one phrase speaks.
PHRASE_WORDS = 60

_LINE_END = re.compile(r"\r\n?")
_OFF = re.compile(r"\\iffalse\b.*?\\fi\b|\\begin\{(verbatim\*?|lstlisting|minted|comment|quote|quotation)\}.*?\\end\{\1\}", re.S)
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_VERB = re.compile(r"\\(?:verb\*?|lstinline)([^a-zA-Z\s*]).*?\1")

# A field's whole value between marks, or a sentence that asks to fill it in.
_NAME = r"[^\W_][\w .,/&'’-]*"
_FIELD = re.compile(
    rf"(?:<<\s*{_NAME}\s*>>|<{_NAME}>|\[\[\s*{_NAME}\s*\]\]|\[{_NAME}\]|\{{\{{+\s*{_NAME}\s*\}}+\}}|\$\{{?\{{{_NAME}\}}\}}?|\\?\$\\?\{{{_NAME}\\?\}}"
    rf"|(?P<m>[#@_*:=~|+^!-]{{1,4}})\s*{_NAME}\s*(?P=m)|XX+:?\s+{_NAME}\s+XX+"
    r"|(?:TBD|TBA|TODO|TBC|FIXME)(?:\s*[:.-].*)?|(?:please\s+)?(?:type|insert|enter|write|put|add|paste|place)\s+(?:the|your|an?)?\s*.{1,60}\s+here"
    r"|(?:please\s+)?replace\s+this\s+(?:line|text|paragraph|sentence).*|your\s+.{1,60}\s+(?:here|goes here)|.{1,60}\s+(?:goes|comes)\s+here|click\s+(?:here\s+)?to\s+(?:add|enter|edit)\s.*)[.!]?",
    re.I | re.S,
)

_LOREM = re.compile(r"\W*(?:lorem|dolor)\s+ipsum\b", re.I)
_FILL_COMMANDS = re.compile(r"(?:\\(?:lipsum|blindtext|Blindtext|blinddocument|Blinddocument|kant|kantdef|lorem|loremipsum|pangrams)\b\*?(?:\[[^\]]*\]|\{[^}]*\})*\s*)+$")
_MASHED = re.compile(r"(?:[asdfghjkl]+\s+){4}[asdfghjkl]+\b")

_SCRIPT = r"(?:java\s?scripts?|\bjs\b|scripts?\b|scripting\b|skripte\w*|noscript)"
# What error pages and notices say, by language.
_STRONG = re.compile(
    rf"\bHTTP/\d|\b(?:error|erreur|erro|fehler)\s*:?\s*\d{{3}}\b|\b[45]\d\d\s+(?:bad|not|forbidden|gone|unauthorized|internal|service|gateway|too many|request|method|proxy|payment|conflict)\b"
    rf"|(?:enable|activate|allow|turn(?:ed)?\s+on|switch(?:ed)?\s+on|aktivieren|schalten|activer|activez|active|ative|activa|habilite|ligue|attiva\w*|needs?|requires?|works?\s+only|without|run)\b[^.]{{0,40}}?{_SCRIPT}"
    rf"|{_SCRIPT}[^.]{{0,40}}?\b(?:disabled|blocked|(?:is|are|switched|turned)\s+off|required|must be|ein\b|enabled|aktivieren|not (?:enabled|supported|available))"
    r"|checking your browser|do not close this window|captcha|are you (?:a )?(?:human|robot)|(?:access|viewing)\s[^.]{0,50}(?:denied|not permitted|forbidden|restricted)|session (?:has )?expired|sign in again"
    r"|something went wrong|unable to (?:load|extract|display|open|find|render)|(?:cannot|could not|can't|couldn't) (?:be (?:shown|delivered|found|loaded|displayed|produced)|find|load|open)|we (?:are|were) (?:sorry|unable)"
    r"|conversion (?:failed|aborted)|emergency stop|no pages of output|traceback|stack trace|\b(?:key|type|value|index|name|attribute|runtime)error\b|exception in|(?:database )?connection (?:failed|refused|timed out|reset)|no result set|fatal error|segmentation fault"
    r"|too many (?:requests|downloads)|under maintenance|offline (?:tonight|now|at present)|being moved|(?:service|temporarily) (?:un)?available|gateway time-?out|page not found|no longer (?:the|available)|internal server error"
    r"|zugriff verweigert|nicht gefunden|nicht erreichbar|accès refusé|introuvable|indisponible|acceso denegado|no se encuentra|no está disponible|acesso negado|não existe|não responde|não encontrad|indisponível",
    re.I,
)
_WEAK = re.compile(rf"{_SCRIPT}|\b(?:errors?|fehler|erreur|erro|unavailable|browsers?|reload|refresh|denied|server|cookies|loading|sorry|retry|again later|timeout|expired|request|navegador|navigateur)\b", re.I)


def _argument(text: str, at: int) -> str:
    """The group that opens at ``at``, without its braces; all the rest if it isn't closed."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[at + 1 : i]
    return text[at + 1 :]


_HEADS = re.compile(r"\\(title|author|date|thanks)\s*(?:\[[^\]]*\])?\s*(?=\{)")
_ABSTRACT = re.compile(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", re.S)
_SECTION = re.compile(r"\\(?:sub)*section\*?\s*\{[^{}]*\}(?:\s*\\label\{[^{}]*\})?")
_TAIL = re.compile(r"\\begin\{thebibliography\}|\\bibliography(?:style)?\{|\\end\{document\}|\\appendix\b")
_LAYOUT = re.compile(r"\\(?:input|include|label|cite|ref|bibliography|usepackage|documentclass|documentstyle)\s*(?:\[[^\]]*\])?\{[^{}]*\}|\\maketitle\b|<[^<>]{0,200}>")
_PARAGRAPH = re.compile(r"\n\s*\n")
_HTML_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title\s*>", re.I | re.S)
# Commands with what they take, where that is no text to read.
_SETUP = re.compile(r"\\(?:input|include)\s+[^\s\\{}]+|\\[a-zA-Z]+\*?(?:\[[^\]]*\]|\{[^{}\s]*\})*|[{}]")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?|[{}]")
_WORD = re.compile(r"[^\W\d_]+")
_TERM = re.compile(r"[^\W\d_]{3,}")
_LONG_TERM = re.compile(r"[^\W\d_]{4,}")
#: Titles in the JVM's regular expressions: a group with groups inside.
TITLE = r"\\title\s*(?:\[[^\]]*\])?\s*\{((?:[^{}]++|\{[^{}]*+\})*+)\}"


def stem(term: str) -> str:
    """A term without the ending of a plural."""
    if term.endswith("ies") and len(term) > 5:
        return term[:-3] + "y"
    if term.endswith("es") and len(term) > 5:
        return term[:-2]
    return term[:-1] if term.endswith("s") and len(term) > 4 else term


def code(term: str) -> int:
    return xxhash.xxh64_intdigest(stem(term)) - 2**63


class Subjects(dict):
    """Whether a term is a subject, by a membership filter; what was asked is remembered up to a bound."""

    def __init__(self, bits: int, words):
        super().__init__()
        self.bits, self.words = bits, words

    def __missing__(self, term: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        at = np.array([code(term)], np.int64).view(np.uint64)
        known = self[term] = bool(len(bitmap.members(self.bits, self.words, at)))
        return known


def is_field(value: str) -> bool:
    """Whether a field's whole value is an unfilled template field."""
    return _FIELD.fullmatch(value.strip()) is not None


def is_filler(paragraph: str) -> bool:
    """Whether a paragraph is filler: filler commands, pseudo-Latin, mashed keys, or a few words or one sentence over and over."""
    p = paragraph.strip()
    if p.startswith("\\") and _FILL_COMMANDS.match(p):
        return True
    if _LOREM.match(p):
        return True
    words = p.lower().split()
    if len(words) < 8:
        return False
    if _MASHED.match(p.lower()):
        own = _WORD.findall(p.lower())
        return sum(set(w) <= set("asdfghjkl") for w in own) > 0.9 * len(own)
    if len(set(words)) > 0.6 * len(words):
        return False
    own = _WORD.findall(_COMMAND.sub(" ", p.lower()))
    if len(own) >= 8 and Counter(own).most_common(1)[0][1] > 0.4 * len(own):
        return True
    sentences = [re.sub(r"\d+", "#", s.strip()) for s in re.split(r"[.!?]", _COMMAND.sub(" ", p.lower())) if s.strip()]
    top = Counter(sentences).most_common(1)[0][1] if sentences else 0
    return top >= 3 and top > 0.6 * len(sentences)


def inspect(text: str | None, slug: str | None = None, subjects: Subjects | None = None) -> dict:
    """What a text shows.

    ``field``, ``filler``; and of a thin body ``bare`` (no
    subject among its terms), ``strong`` and ``weak`` (phrases and words of
    responses), ``apart`` (no term shared with title and slug), ``body``, its
    bare form, and ``exact``, the same with short numbers as they are (null if
    the text is cut off).  ``terms`` are those of any body.  Without subjects,
    bodies without sections are taken as thin.
    """
    out = {"field": False, "filler": False, "strong": False, "weak": False, "apart": False, "bare": False, "terms": None, "body": None, "exact": None}
    if not text or not text.strip():
        return out
    text = _LINE_END.sub("\n", text)
    if "\\iffalse" in text or "\\begin{" in text:
        text = _OFF.sub(" ", text)
    if "%" in text:
        text = _COMMENT.sub("", text)
    if "\\verb" in text or "\\lstinline" in text:
        text = _VERB.sub(" ", text)
    tex = "\\begin{document}" in text or "\\document" in text
    heads: dict[str, list[str]] = {}
    rest, last = [], 0
    for m in _HEADS.finditer(text):
        value = _argument(text, m.end())
        heads.setdefault(m[1], []).append(value)
        if m.start() >= last:
            rest.append(text[last : m.start()])
            last = m.end() + len(value) + 2
    rest.append(text[last:])
    text = "".join(rest)
    authors = [re.split(r"\\\\|\\thanks\b", a)[0] for v in heads.get("author", ()) for a in re.split(r"\\and\b", v)]
    out["field"] = any(map(is_field, [*heads.get("title", ()), *authors, *_ABSTRACT.findall(text)]))
    if "\\begin{document}" in text:
        body = text.split("\\begin{document}", 1)[1]
    elif tex:
        return out  # cut off before the text begins
    else:
        body = text
    body = _ABSTRACT.sub("\n\n", body)
    main = _TAIL.split(body, 1)[0]
    parts = _SECTION.split(main)
    for part in parts:
        for p in _PARAGRAPH.split(part):
            p = p.replace("\\maketitle", "").strip()
            if p and not out["field"] and is_field(p):
                out["field"] = True
            if p and not out["filler"] and is_filler(p):
                out["filler"] = True
    if subjects is None:
        if len(parts) > 1:
            return out
    else:  # markup only adds terms that are no subjects: what has subjects enough with it has enough without
        rough = set(_TERM.findall(main.lower()))
        if sum(map(subjects.__getitem__, rough)) >= THIN * len(rough) > 0:
            out["terms"] = rough
            return out
    main = "\n\n".join(parts)
    bare = _LAYOUT.sub(" ", main)
    own = set(_TERM.findall(bare.lower()))
    if not _WORD.search(bare):
        return out
    out["terms"] = own
    hits = 0 if subjects is None else sum(map(subjects.__getitem__, own))
    if hits and hits >= THIN * len(own):
        return out
    phrases = len(_STRONG.findall(bare)) if subjects is None else 0
    out["strong"] = phrases * PHRASE_WORDS >= len(_WORD.findall(bare)) if subjects is None else bool(_STRONG.search(bare))
    out["weak"], out["bare"] = bool(_WEAK.search(bare)), not hits
    said = _LAYOUT.sub(" ", _HTML_TITLE.sub(" ", main))
    about = set(_LONG_TERM.findall(" ".join([*heads.get("title", ()), *_HTML_TITLE.findall(main), slug or ""]).lower()))
    out["apart"] = not about.intersection(_LONG_TERM.findall(said.lower()))
    out["body"] = " ".join(re.sub(r"\b[0-9a-f]{6,}\b|\d+", "#", (said if _WORD.search(said) else bare).lower()).split())
    plain = _SETUP.sub(" ", said)
    if _WORD.search(plain) and (not tex or "\\end{document}" in body):
        out["exact"] = " ".join(re.sub(r"\b[0-9a-f]{6,}\b|\d{4,}", "#", plain.lower()).split())
    return out


def _title_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pass over (titles, slug): each record's terms once, and 0 for a record that has any."""
    for b in batches:
        out: list[int] = []
        for titles, slug in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            named = " ".join([*(_COMMAND.sub(" ", t) for t in titles or () if t and not is_field(t)), slug or ""])
            own = {code(t) for t in _TERM.findall(named.lower())}
            out += own
            out += [0] if own else []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["code"])


def subjects_of(docs: DataFrame, slug_col: str = "paper_key") -> tuple[int, np.ndarray] | None:
    """The filter of the corpus's subjects: terms of titles and slugs, without those that frame titles; None if there are none."""
    titles = docs.select(F.regexp_extract_all("text", F.lit(TITLE), 1).alias("titles"), F.col(slug_col).alias("slug")).where("size(titles) > 0 OR slug IS NOT NULL")
    named = titles.mapInArrow(_title_terms, "code long").groupBy("code").agg(F.count("*").alias("n"))
    named = runtime.Workspace(docs.sparkSession, "subjects").cut(named, "named")
    titled = named.where("code = 0").first()
    if titled is None:
        return None
    subjects = named.where((F.col("code") != 0) & (F.col("n") <= max(FRAME_TITLES, FRAME * titled.n)))
    return None if subjects.isEmpty() else bitmap.build(subjects, "code")


_FLAGS = ("field", "filler", "strong", "weak", "apart", "bare")
_CODES = ("body", "exact")
_SEEN = "doc_id long, source string, " + ", ".join(f"{f} boolean" for f in _FLAGS) + ", " + ", ".join(f"{c} long" for c in _CODES) + ", terms array<bigint>, docs long"
_NAMES = ["doc_id", "source", *_FLAGS, *_CODES, "terms", "docs"]
_TYPES = [pa.int64(), pa.string(), *[pa.bool_()] * len(_FLAGS), *[pa.int64()] * len(_CODES), pa.list_(pa.int64()), pa.int64()]


def _inspector(shared, phrases: bool):
    """A pass over (doc_id, source, slug, text): the documents to look at, and, in rows without doc_id, in how many others each term lies (term 0: how many there are)."""

    def counted(counts: Counter) -> pa.RecordBatch:
        blank = [None] * (len(_NAMES) - 2)
        rows = [(*blank, [code(t) if t else 0], n) for t, n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Subjects(*shared.value) if shared is not None else None
        counts: Counter = Counter()
        for b in batches:
            rows: list[tuple] = []
            for i, source, slug, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                s = inspect(text.as_py(), slug, known)
                if s["body"] is None and s["terms"]:
                    counts.update(s["terms"])
                    counts[""] += 1
                if s["field"] or s["filler"] or s["body"] is not None:
                    said = [s[f] and (phrases or f not in ("strong", "weak")) for f in _FLAGS]
                    terms = sorted({code(t) for t in s["terms"] or ()}) if s["body"] is not None else []
                    rows.append((i, source, *said, *(None if s[k] is None else xxhash.xxh64_intdigest(s[k]) - 2**63 for k in _CODES), terms, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
            if len(counts) > 200_000:
                yield counted(counts)
                counts.clear()
        if counts:
            yield counted(counts)

    return run


def evidence(docs: DataFrame, slug_col: str = "paper_key", phrases: bool = True) -> DataFrame:
    """Every document found, and why: ``doc_id``, ``source``, ``reason``, and for each kind of evidence whether it is there.

    ``hosts``: half of the terms at least are terms of responses, which thin
    bodies of several hosts use, and far more often than other bodies do; ``same``: several hosts repeat the body word
    for word; ``phrase``: it says what error pages and notices say, or words of
    theirs in a body that several hosts repeat but for its numbers.  A thin
    body without any subject needs one of them, one with a few subjects a
    phrase of its own or two of them.
    ``hosts`` needs subjects to compare with.  ``phrases``: whether the list
    of phrases is used at all.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(slug_col).alias("slug"), "text")
    space = runtime.Workspace(docs.sparkSession, "residue")
    known = subjects_of(rows, "slug")
    shared = docs.sparkSession.sparkContext.broadcast(known) if known else None
    told = space.cut(rows.mapInArrow(_inspector(shared, phrases), _SEEN).withColumn("row", F.monotonically_increasing_id()), "told")
    seen, others = told.where("doc_id IS NOT NULL").drop("docs"), told.where("doc_id IS NULL").select(F.col("terms")[0].alias("code"), "docs")
    host = F.coalesce("source", F.lit(""))
    for key, name in (("body", "again"), ("exact", "same")):
        repeated = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(host).alias("hosts"))
        repeated = repeated.where((F.col("n") >= REPEATED) & (F.col("hosts") >= HOSTS)).select(key, F.lit(True).alias(name))
        seen = space.cut(runtime.lookup(seen, repeated, [key], how="left").withColumn(name, F.coalesce(name, F.lit(False))), name)
    if known:
        thin = seen.where("body IS NOT NULL AND NOT field AND NOT filler")
        used = thin.select("row", "source", F.explode("terms").alias("code"))
        spread = used.groupBy("code", host.alias("host")).agg(F.count("*").alias("n")).groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"))
        others = others.groupBy("code").agg(F.sum("docs").alias("docs"))
        whole = others.where("code = 0").first()
        usual = F.coalesce("docs", F.lit(0)) / F.lit(float(whole.docs if whole else 1))
        spread = spread.where((F.col("n") >= TERM_RECORDS) & (F.col("hosts") >= TERM_HOSTS)).join(others, "code", "left")
        spread = space.cut(spread.where(F.col("n") / F.lit(float(max(1, thin.count()))) >= TERM_TIMES * usual).select("code"), "spread")
        shown = runtime.lookup(used.select("row", "code"), spread, ["code"]).groupBy("row").agg(F.count("*").alias("spread"))
        seen = seen.join(shown, "row", "left").withColumn("hosts", F.coalesce("spread", F.lit(0)) >= F.greatest(F.size("terms") * TERM_SHARE, F.lit(1)))
    else:
        seen = seen.withColumn("hosts", F.lit(False))
    seen = seen.withColumn("phrase", F.col("strong") | (F.col("apart") & F.col("weak") & F.col("again")))
    kinds = F.col("hosts").cast("int") + F.col("same").cast("int") + F.col("phrase").cast("int")
    # Without any subject, phrases also speak where the page's title says the same.
    told = F.when(F.col("bare"), F.col("strong") | (F.col("apart") & (kinds >= 1))).otherwise(F.col("apart") & (F.col("strong") | (kinds >= 2)))
    reason = F.when(F.col("field"), "field").when(F.col("filler"), "filler").when(F.col("body").isNotNull() & told, "error")
    return seen.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "source", "reason", "bare", "apart", "hosts", "same", "phrase")


def residue(docs: DataFrame, slug_col: str = "paper_key") -> DataFrame:
    """``doc_id``, ``source`` and ``reason`` (field, filler or error) of every document (doc_id, text, source, slug) without content of its own.

    Null, empty, cut-off and merely short texts aren't found; rows without
    doc_id are left out; a null source counts as a host of its own, a null
    slug, as a missing title, as no shared term; repeated rows give one row per
    doc_id and reason's first in the order given; other columns are ignored;
    an empty table gives no rows.
    """
    found = evidence(docs, slug_col)
    return found.groupBy("doc_id").agg(F.min("source").alias("source"), F.max_by("reason", F.when(F.col("reason") == "field", 2).when(F.col("reason") == "filler", 1).otherwise(0)).alias("reason"))


def without_residue(docs: DataFrame, slug_col: str = "paper_key") -> DataFrame:
    """``docs`` without the documents found; rows without doc_id stay."""
    return docs.join(residue(docs, slug_col).select("doc_id"), "doc_id", "left_anti")
