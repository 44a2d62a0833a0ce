"""Mixing sources to target weights.

Each source's documents are put in a pseudorandom order and packed into blocks
of a fixed length in tokens (whole documents are selected, so a document belongs
to the block its first token falls into). Output shards draw multinomial counts of blocks per source; the
slots so drawn are mapped through a pseudorandom permutation of the source's
block indices, one per repetition, and blocks are joined by index.

The total is as large as the scarcest source allows: the least of
tokens x max_repeats / target_share. A source is used up to its share of that
total; its last block ends with the document that brings it nearest, so shares
are met to within half a document. A block has one slot per repetition, and a
source has at most max_repeats repetitions, so no document is used more often.
Slots are laid out for whole repetitions, as many as hold the share: a text
longer than a block leaves blocks behind it empty, so a part of the slots may
hold far less than their number times the block length.

Scale: positions and running totals are exact prefix sums over buckets; only
one row per source (totals, slots needed) reaches the driver, and the shard
plan of one row per shard and source goes back. Shards and buckets grow in number
with the tokens, so a shard, a bucket and an array of slots keep their size. Token counts are written once to
the cluster's checkpoint folder, since both plans read them.

Defined results: documents without source, tokens or id, and sources without a
target, are not selected; a target source without documents is reported with a
share of 0 and does not bound the total; equal texts are documents of their
own; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbar.llm.tokenizer import VOCABULARY, count_tokens
from quillbar.operators.ranking import running_before
from quillbar.session import cut_lineage

BLOCK_TOKENS = 4096
#: Slots of an output shard, and tokens of a bucket of documents that is put in order at once; their numbers grow with the data.
SHARD_SLOTS, BUCKET_TOKENS = 2**16, 2**24
LEAST_SHARDS = 64
_CHUNK = 4096


def draw_shards(needed: dict[str, int], shards: int, seed: int) -> list[tuple[int, str, int, int]]:
    """(shard, source, first slot, slots): multinomial counts per shard. Each
    draw uses the slots that remain, so the counts of all shards add up to what
    is needed."""
    names = sorted(n for n in needed if needed[n] > 0)
    left = np.array([needed[n] for n in names], dtype=np.int64)
    start = np.zeros(len(names), dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = []
    for s in range(shards):
        size = int(left.sum() // (shards - s)) if s < shards - 1 else int(left.sum())
        got = np.zeros(len(names), dtype=np.int64)
        if s == shards - 1:
            got = left.copy()
        else:
            while (lack := size - int(got.sum())) > 0:
                room = left - got
                draw = rng.multinomial(lack, room / room.sum())
                got += np.minimum(draw, room)
        for i, n in enumerate(names):
            if got[i]:
                out.append((s, n, int(start[i]), int(got[i])))
        start += got
        left -= got
    return out


def coprime_factor(blocks: int) -> int:
    """The first factor from the golden section of the number of blocks upwards that has no divisor in common with it."""
    f = max(1, int(blocks * 0.6180339887498949))
    while math.gcd(f, blocks) != 1:
        f += 1
    return f


def _permuted(index: Column, repeat: Column, blocks: Column, source: Column, seed: int, factor: Column) -> Column:
    """A pseudorandom permutation of 0..blocks-1 per source and repetition: an
    affine map whose factor has no divisor in common with the modulus. The
    product of two numbers of blocks does not fit 64 bits."""
    wide = lambda c: c.cast("decimal(18,0)")
    shift = F.pmod(F.xxhash64(source, repeat, F.lit(seed)), blocks)
    return F.pmod(wide(factor) * wide(index) + wide(shift), wide(blocks)).cast("bigint")


def _slots(spark: SparkSession, sizes: list[tuple[str, int, float, int]], seed: int) -> DataFrame:
    """source, goal, slot, repeat, block of every slot laid out. Chunks of slots
    are numbered through over all sources, so tasks share them evenly."""
    schema = "source string, goal double, slot bigint, repeat bigint, block bigint"
    if not sizes:
        return spark.createDataFrame([], schema)
    ends = np.cumsum([-(-n // _CHUNK) for _, _, _, n in sizes]).tolist()
    rows = [F.struct(F.lit(s).alias("source"), F.lit(b).cast("bigint").alias("blocks"), F.lit(g).alias("goal"), F.lit(n).cast("bigint").alias("slots"),
                     F.lit(e).cast("bigint").alias("end"), F.lit(e + n // -_CHUNK).cast("bigint").alias("begin"), F.lit(coprime_factor(b)).cast("bigint").alias("factor"))
            for (s, b, g, n), e in zip(sizes, ends)]
    chunks = spark.range(ends[-1]).withColumn("s", F.filter(F.array(*rows), lambda x: (x["begin"] <= F.col("id")) & (F.col("id") < x["end"]))[0])
    first = (F.col("id") - F.col("s.begin")) * _CHUNK
    out = chunks.select("s.*", F.explode(F.sequence(first, F.least(first + _CHUNK, F.col("s.slots")) - 1)).alias("slot"))
    out = out.withColumn("repeat", F.floor(F.col("slot") / F.col("blocks")))
    block = _permuted(F.col("slot") % F.col("blocks"), F.col("repeat"), F.col("blocks"), F.col("source"), seed, F.col("factor"))
    return out.select("source", "goal", "slot", "repeat", block.alias("block"))


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int | None = None, seed: int = 7, path: str = VOCABULARY) -> DataFrame:
    """One row per use of a document: doc_id, source, n_tokens, shard, slot, block, repeat."""
    spark = docs.sparkSession
    want = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.collect() if r.target_share and r.max_repeats}
    plan = targets.select("source").distinct()
    usable = docs.where("doc_id is not null").join(plan, "source", "left_semi")
    counted = cut_lineage(count_tokens(usable, ["doc_id", "source"], path=path).where("n_tokens > 0"))

    have = {r.source: int(r.n) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = min((have[s] * r / p for s, (p, r) in want.items() if have.get(s)), default=0.0)
    # per source: blocks, target tokens, slots of the repetitions that hold the
    # target: each holds all tokens once, however unevenly blocks are filled
    rows = []
    for s, (p, r) in sorted(want.items()):
        if not have.get(s):
            continue
        blocks, goal = math.ceil(have[s] / block_tokens), p * total
        slots = min(r, math.ceil(goal / have[s])) * blocks
        rows.append((s, blocks, float(goal), slots))

    buckets = max(6, math.ceil(math.log2(max(max(have.values(), default=1) / BUCKET_TOKENS, 1))))
    h = F.xxhash64("doc_id", F.lit(seed))
    bucket = F.shiftrightunsigned(h, 64 - buckets)
    # the sign bit is turned so that the bucket grows with the order
    order = h.bitwiseXOR(F.lit(-(2**63)))
    packed = (
        running_before(counted.withColumn("_h", order), ["source"], [F.col("_h"), F.col("doc_id")], bucket, "n_tokens", "before")
        .withColumn("block", F.floor(F.col("before") / block_tokens))
        .select("doc_id", "source", "n_tokens", "block", "before")
    )
    content = packed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_sum"))
    filled = _slots(spark, rows, seed).join(content, ["source", "block"], "left").withColumn("block_sum", F.coalesce("block_sum", F.lit(0)))
    filled = running_before(filled, ["source"], [F.col("slot")], F.floor(F.col("slot") / _CHUNK), "block_sum", "slot_before").where("slot_before < goal")
    filled = cut_lineage(filled)

    needed = {r.source: int(r.n) for r in filled.groupBy("source").agg(F.max("slot").alias("n")).collect()}
    shards = shards or max(LEAST_SHARDS, -(-sum(n + 1 for n in needed.values()) // SHARD_SLOTS))
    drawn = spark.createDataFrame(draw_shards({s: n + 1 for s, n in needed.items()}, shards, seed), "shard int, source string, first bigint, n bigint")
    shard_of = drawn.select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))

    used = filled.join(shard_of, ["source", "slot"]).join(packed, ["source", "block"])
    inside = Window.partitionBy("source", "slot").orderBy("before", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    used = used.withColumn("_at", F.col("slot_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return used.where(F.col("_at") + F.col("n_tokens") / 2 <= F.col("goal")).select(
        "doc_id", "source", "n_tokens", "shard", "slot", "block", F.col("repeat").cast("int").alias("repeat")
    )


def selection(used: DataFrame) -> DataFrame:
    """One row per selected document: how often it is used and its tokens."""
    return used.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").cast("int").alias("uses"))


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached per source, and the most uses of one document."""
    by = selection(used).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
    )
    t = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per source
    return t.select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share_reached"),
    )
