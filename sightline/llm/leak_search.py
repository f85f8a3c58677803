"""Held-out passages inside a corpus: a prefix-filtered join of word shingles, then exact checks.

A document leaks an item if it holds twelve consecutive words of it.  Such a
window is a set of eight five-word shingles which all must be in the document.
One pass over the corpus finds every place of an item's shingle and counts, over
the whole corpus, in how many documents each lies.  Shingles are ordered by that
rarity; a window's prefix, its rarest shingle, is all that is joined (at full
containment a prefix of length one loses nothing).  Places met that way are held
against the window's bounds in the document, and then word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import runtime
from sightline.llm import bitmap

WINDOW = 12
SHINGLE = 5
#: Shingles of a window.
EIGHT = WINDOW - SHINGLE + 1
#: Words whose codes a worker remembers.
_REMEMBERED = 200_000

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_BROKEN = re.compile(r"(?<=\w)(?:-|\\-)[ \t]*\r?\n[ \t]*(?:%+[ \t]*)?(?=\w)")
_CITE = re.compile(r"\\[a-zA-Z]*cite[a-zA-Z]*\*?\s*(?:\[[^\]\\]*\]\s*)*\{[^{}]*\}")
_ENV = re.compile(r"\\(?:begin|end)\s*\{[^{}]*\}")
_OPEN = re.compile(r"\\[a-zA-Z@]+\*?(?:\[[^\]\\\n]*\])?\{")
_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
_JOINED = re.compile(r"[{}]|\\-|(?<=[^\W_])[-\u2010\u2011](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text as they are compared.

    Lower case letters and digits; ligatures and other compatibility forms are
    taken apart, invisible characters and hyphens inside words or at line ends
    vanish (also where the next line goes on as a comment), citations go with
    their keys, environments' and other commands' names go and their arguments
    stay.
    """
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _BROKEN.sub("", text)
    if "\\" in text:
        text = _ENV.sub(" ", _CITE.sub(" ", text))
        text = _COMMAND.sub(" ", _OPEN.sub("", text))
    return _WORD.findall(_JOINED.sub("", text).lower())


class _Codes(dict):
    """Codes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_CODES = _Codes()


def _codes(found: list[str]) -> np.ndarray:
    """A 64-bit code of every run of SHINGLE words, alike in all processes."""
    if len(found) < SHINGLE:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_CODES.__getitem__, found), np.uint64, len(found))
    out = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(out) + k]
        out ^= out >> np.uint64(29)
    return out


_ITEM_SQL = "item_id long, window string, shingles array<bigint>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pass over (item_id, text): every window, as words parted by blanks, with its shingles."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = words(text.as_py())
            n = len(found) - WINDOW + 1
            if n < 1:
                continue
            codes = _codes(found).view(np.int64)
            own = np.lib.stride_tricks.sliding_window_view(codes, EIGHT)
            for a in range(0, n, 10_000):  # an item may be a book
                b = min(n, a + 10_000)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * EIGHT), pa.array(own[a:b].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([item] * (b - a), pa.int64()), pa.array([" ".join(found[i : i + WINDOW]) for i in range(a, b)]), lists], names=["item_id", "window", "shingles"])


_PLACES_SQL = "doc_id long, n int, first int, part array<string>, hits array<struct<pos: int, shingle: bigint>>"
_HITS = pa.list_(pa.struct([("pos", pa.int32()), ("shingle", pa.int64())]))


def _scan(sought):
    """A pass over (doc_id, text): the parts of a document around the places of sought shingles.

    A part goes from seven words before a shingle to seven behind it, as far as
    a window with that shingle can reach; parts that touch are one.
    """
    reach = EIGHT - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, there = sought.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[], [], [], [], []]
            for i in range(len(ids)):
                found = words(texts[i].as_py())
                if len(found) < WINDOW:
                    continue
                codes = _codes(found)
                at = bitmap.members(bits, there, codes)
                if not len(at):
                    continue
                for group in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach + SHINGLE) + 1):
                    first, last = max(0, int(group[0]) - reach), min(len(found), int(group[-1]) + SHINGLE + reach)
                    if last - first < WINDOW:
                        continue
                    out[0].append(ids[i])
                    out[1].append(len(found))
                    out[2].append(first)
                    out[3].append(found[first:last])
                    out[4].append([{"pos": int(p), "shingle": int(c)} for p, c in zip(group, codes[group].view(np.int64))])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.string())), pa.array(out[4], _HITS)], names=["doc_id", "n", "first", "part", "hits"])

    return run


@dataclass
class Leaks:
    """``pairs``: doc_id, item_id.  ``steps``: step and windows, how many (window, place) each step of the search left."""

    pairs: DataFrame
    steps: DataFrame


def search(docs: DataFrame, items: DataFrame) -> Leaks:
    """The leaks of ``leaked_items``, and what each step of the search left."""
    spark = docs.sparkSession
    space = runtime.Workspace(spark, "leaks")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    owned = space.cut(items.mapInArrow(_item_windows, _ITEM_SQL), "owned")
    # A window that many items share is looked for once.
    windows = space.cut(owned.groupBy("window").agg(F.first("shingles").alias("shingles")).withColumn("w", F.xxhash64("window")), "windows")
    shingles = windows.select(F.explode("shingles").alias("shingle")).distinct()
    sought = spark.sparkContext.broadcast(bitmap.build(shingles, "shingle"))
    parts = space.cut(docs.mapInArrow(_scan(sought), _PLACES_SQL).withColumn("part_id", F.monotonically_increasing_id()), "parts")

    # The order of rarity: in how many documents of the corpus each shingle lies.
    places = parts.select("part_id", "doc_id", "n", F.explode("hits").alias("h")).select("part_id", "doc_id", "n", "h.pos", "h.shingle")
    rarity = places.select("shingle", "doc_id").distinct().groupBy("shingle").agg(F.count("*").alias("docs"))
    each = windows.select("window", F.posexplode("shingles").alias("k", "shingle")).join(rarity, "shingle")
    prefix = each.groupBy("window").agg(F.min(F.struct("docs", "shingle", "k")).alias("p"), F.count("*").alias("known"))
    prefix = space.cut(prefix.select("window", "known", "p.docs", "p.shingle", "p.k"), "prefix")

    # Only prefixes are joined; a window with a shingle that no document has needs none.
    met = places.join(prefix.where(F.col("known") == EIGHT).select("window", "shingle", "k"), "shingle").withColumn("start", F.col("pos") - F.col("k"))
    fits = (F.col("start") >= 0) & (F.col("start") + WINDOW <= F.col("n"))
    met = met.select("part_id", "doc_id", "window", "start", fits.alias("fits"))
    text = F.array_join(F.slice("part", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, WINDOW), " ")
    checked = met.join(parts.select("part_id", "first", "part"), "part_id").select("doc_id", "window", "fits", (F.col("fits") & (text == F.col("window"))).alias("same"))
    checked = space.cut(checked, "checked")
    pairs = checked.where("same").select("doc_id", "window").distinct().join(owned.select("window", "item_id").distinct(), "window").select("doc_id", "item_id").distinct()
    full = F.col("known") == EIGHT
    counts = (
        windows.agg(F.count("*").alias("1 windows of items")),
        prefix.agg(F.count("*").alias("2 with a shingle in the corpus"), F.count_if(full).alias("3 with all eight in the corpus")),
        checked.agg(F.count("*").alias("4 places of their prefixes"), F.count_if("fits").alias("5 within bounds"), F.coalesce(F.count_if("same"), F.lit(0)).alias("6 equal word by word")),
    )
    steps = reduce(DataFrame.unionByName, (c.unpivot([], c.columns, "step", "windows") for c in counts))
    return Leaks(pairs, steps)


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id`` and ``item_id`` of every document (doc_id, text) that holds at least 12 consecutive words of an item (item_id, text).

    Null, empty and short texts on either side match nothing; rows without an
    id are left out; repeated rows give one pair; other columns are ignored;
    empty tables give no rows.

    The corpus is read once, whatever the number of items: their windows and
    shingles stay on the executors, and what goes to the pass is a filter of at
    most 64 MB.  Where it is too full to keep much out, more places are joined,
    and none is lost.
    """
    return search(docs, items).pairs
