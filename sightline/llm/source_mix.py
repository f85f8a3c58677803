"""Sources mixed to target shares of tokens, in fixed-length blocks, with a cap on repeats."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime

#: Where the vocabulary lies on every executor, as ranks of byte pairs.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block, blocks of an output shard.
BLOCK_TOKENS = 2048
SHARD_BLOCKS = 1024
#: Documents of one prefix-sum bin, solved in one task.
BIN_DOCS = 20_000


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``source`` and the number of ``tokens`` of the whole text; null and empty texts have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, tokens long")


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: four Feistel rounds on the next even power of two, walked until below n."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(_seed(key, r)) for r in range(4)]
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            x = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((x >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``slots``: shard, slot, source, epoch, block, tokens.  ``pieces``: source, block, doc_id, first_token, tokens.  ``report``: a row per source."""

    slots: DataFrame
    pieces: DataFrame
    report: DataFrame

    def documents(self) -> DataFrame:
        """What every slot of the mixture holds: shard, slot, source, epoch, doc_id, first_token, tokens."""
        return self.slots.select("shard", "slot", "source", "epoch", "block").join(self.pieces, ["source", "block"]).drop("block")

    def tokens(self, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
        """The mixture itself: shard, slot, and the token numbers of its pieces, each with the doc_id it comes from.

        Every document is encoded once and cut at its blocks' edges; the pieces
        then meet their slots by block, however often those repeat them.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = encoder(vocabulary).encode_ordinary
            for b in batches:
                out: list[list] = [[], [], [], [], []]
                for doc, text, source, pieces in zip(*(c.to_pylist() for c in b.columns)):
                    ids = encode(text)
                    for p in pieces:
                        for column, v in zip(out, (source, p["block"], doc, p["first_token"], ids[p["first_token"] : p["first_token"] + p["tokens"]])):
                            column.append(v)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["source", "block", "doc_id", "first_token", "ids"])

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").alias("_of")).where("text IS NOT NULL").dropDuplicates(["doc_id", "_of"])
        # A document's pieces: as many as it has blocks.
        own = self.pieces.groupBy("doc_id", "source").agg(F.collect_list(F.struct("block", "first_token", "tokens")).alias("pieces"))
        cut = own.join(texts, (own["doc_id"] == texts["doc_id"]) & (own["source"] == texts["_of"])).select(own["doc_id"], "text", "source", "pieces")
        made = cut.mapInArrow(run, "source string, block long, doc_id long, first_token long, ids array<int>")
        # The planner sizes the slots by the few draws they come from.
        return self.slots.select("shard", "slot", "source", "block").join(made.hint("merge"), ["source", "block"]).select("shard", "slot", "doc_id", "first_token", "ids")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 5) -> Mix:
    """A mixture as large as all documents together, in the sources' target shares of tokens.

    ``docs`` has doc_id, source and text; ``targets`` has source, target_share
    and max_repeats.  A source's documents are put in an order of hashes and
    cut into blocks of ``block_tokens`` tokens.  Every output shard draws how
    many of its slots each source gets, from a multinomial of the shares; a
    source's slots, counted through all shards, walk through its blocks in a
    pseudorandom order, another one each time round.  Slots past
    ``max_repeats`` rounds stay empty: no document is repeated more often.

    The report has source, target_share, max_repeats, tokens (one copy),
    wanted (target_share of the tokens of all documents), drawn, share
    (of what was drawn), rounds (times round that were begun) and short (all
    allowed copies hold fewer tokens than wanted).

    Null and empty texts hold no tokens; documents without source, or of a
    source not among the targets, count in the total but aren't drawn; rows
    without doc_id are left out; a repeated row counts once; a target without
    source, share or repeats is left out, of several for one source that of
    the largest share holds; a source without documents has 0 tokens.  Other
    columns are ignored.  Empty documents give no slots.
    """
    spark = docs.sparkSession
    space = runtime.Workspace(spark, "mix")
    sizes = space.cut(token_counts(docs.where("doc_id IS NOT NULL"), vocabulary).distinct(), "sizes")
    wish = targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL")
    wish = wish.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("w")).select("source", "w.*").limit(100_001).collect()
    if len(wish) > 100_000:
        raise ValueError("the targets are a small table; this one isn't")
    wish = sorted(wish, key=lambda r: r.source)
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.count("*").alias("docs")).first()
    names = spark.createDataFrame([(r.source, float(r.target_share), int(r.max_repeats)) for r in wish], "source string, target_share double, max_repeats int")

    # Where each document begins in its source: sums within bins of hashes, and of bins.
    bins = max(1, -(-total.docs // BIN_DOCS))
    order = F.xxhash64(F.lit(seed), "doc_id")
    own = sizes.where("tokens > 0").join(F.broadcast(names.select("source")), "source").withColumn("order", order).withColumn("bin", F.pmod(F.shiftright("order", 20), F.lit(bins)))
    before = W.unboundedPreceding, -1
    per_bin = own.groupBy("source", "bin").agg(F.sum("tokens").alias("n"))
    per_bin = per_bin.select("source", "bin", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bin").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy("source", "bin").orderBy("order", "doc_id").rowsBetween(*before)), F.lit(0))
    placed = runtime.lookup(own.withColumn("at", inside), per_bin, ["source", "bin"]).withColumn("at", F.col("at") + F.col("base"))
    block = F.explode(F.sequence(F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("tokens") - 1) / block_tokens)))
    pieces = placed.select("source", "doc_id", "at", "tokens", block.alias("block"))
    low, high = F.greatest(F.col("at"), F.col("block") * block_tokens), F.least(F.col("at") + F.col("tokens"), (F.col("block") + 1) * block_tokens)
    pieces = space.cut(pieces.select("source", "block", "doc_id", (low - F.col("at")).alias("first_token"), (high - low).alias("tokens")), "pieces")
    blocks = pieces.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))

    have = {r.source: r for r in pieces.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("block") + 1).alias("blocks")).collect()}  # of target sources only
    shares = np.array([max(0.0, float(r.target_share)) for r in wish])
    n_slots = -(-total.n // block_tokens) if shares.sum() else 0
    shards = -(-n_slots // shard_blocks)
    p = shares / shares.sum() if shares.sum() else shares
    listed = [(r.source, int(have[r.source].blocks) if r.source in have else 0, int(r.max_repeats)) for r in wish]

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in f["id"]:
                n = np.random.default_rng(_seed(seed, "shard", int(s))).multinomial(min(shard_blocks, n_slots - s * shard_blocks), p)
                yield pd.DataFrame({"shard": s, "number": np.arange(len(p)), "n": n})

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                source, size, repeats = listed[r.number]
                j = r.start + np.arange(r.n)
                ok = j < size * repeats
                j = j[ok]
                epoch = j // max(1, size)
                at = np.empty(len(j), np.int64)
                for e in np.unique(epoch):
                    here = epoch == e
                    at[here] = permuted(j[here] % size, size, _seed(seed, source, int(e)))
                yield pd.DataFrame({"shard": r.shard, "slot": r.first + np.flatnonzero(ok), "source": source, "epoch": epoch, "block": at})

    counts = space.cut(spark.range(shards).mapInPandas(draw, "shard long, number int, n long"), "draws")
    run = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(by[0]).orderBy(by[1]).rowsBetween(*before)), F.lit(0))
    counts = counts.withColumn("start", run("number", "shard")).withColumn("first", run("shard", "number")).where("n > 0")
    slots = counts.select("shard", "number", "n", "start", "first").mapInPandas(fill, "shard long, slot long, source string, epoch long, block long")
    # The planner sizes the slots by the few draws they come from, and would broadcast them at any number.
    slots = space.cut(slots.join(blocks.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "tokens"), "slots")

    sums = slots.groupBy("source").agg(F.sum("tokens").alias("drawn"), (F.max("epoch") + 1).alias("rounds"))
    one = pieces.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    report = names.join(one, "source", "left").join(sums, "source", "left").fillna(0, ["tokens", "drawn", "rounds"])
    report = report.withColumn("wanted", F.col("target_share") * float(total.n)).withColumn("share", F.try_divide("drawn", F.sum("drawn").over(W.partitionBy())))
    report = report.withColumn("short", F.col("tokens") * F.greatest(F.col("max_repeats"), F.lit(0)) < F.col("wanted"))
    return Mix(slots, pieces, report.select("source", "target_share", "max_repeats", "tokens", "wanted", "drawn", "share", "rounds", "short"))
