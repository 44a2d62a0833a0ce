from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillbar.llm import mixing


def _docs(spark, n=1500):
    s = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 10 == 1, "small").when(F.col("id") % 10 == 2, "mid").when(F.col("id") % 50 == 4, None).otherwise("other")
    return spark.range(n).select(F.col("id").alias("doc_id"), s.alias("source"), F.when(F.col("id") % 17 == 0, "").otherwise(F.repeat(F.lit("word and line "), (F.col("id") % 40).cast("int") + 1)).alias("text"), F.lit(1).alias("block"))


T = [("big", 0.5, 1), ("small", 0.3, 4), ("mid", 0.2, 2)]


def test_shares_and_repeats(spark):
    docs, t = _docs(spark), spark.createDataFrame(T, "source string, target_share double, max_repeats int")
    used = mixing.mix(docs, t, block_tokens=512, shards=8).cache()
    sh = {r.source: r for r in mixing.shares(used, t).collect()}
    for s, p, m in T:
        assert sh[s].share_reached == pytest.approx(p, abs=0.01) and 0 < sh[s].most_uses <= m
    n = Counter((r.doc_id, r.repeat) for r in used.collect())
    assert max(n.values()) == 1
    per = mixing.selection(used)
    assert per.count() == per.select("doc_id").distinct().count()
    assert used.select("shard").distinct().count() == 8
    assert used.where("source is null or source = 'other'").count() == 0


def test_scarce_source_bounds_the_total_and_is_used_up(spark):
    docs = _docs(spark)
    t = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], "source string, target_share double, max_repeats int")
    used = mixing.mix(docs, t, block_tokens=256, shards=4)
    have = mixing.count_tokens(docs.where("source = 'small'"), ["doc_id"]).agg(F.sum("n_tokens")).first()[0]
    got = used.where("source = 'small'").agg(F.sum("n_tokens")).first()[0]
    assert got == pytest.approx(2 * have, abs=300) and got <= 2 * have


def test_one_very_long_text_leaves_no_source_short(spark):
    short = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 750, "long").otherwise("plain").alias("source"), F.lit("word and line again. ").alias("text"))
    long = spark.createDataFrame([(5000, "long", "word and line again. " * 880)], short.schema)
    t = spark.createDataFrame([("long", 0.5, 1), ("plain", 0.5, 1)], "source string, target_share double, max_repeats int")
    docs = short.union(long)
    sh = {r.source: r for r in mixing.shares(mixing.mix(docs, t, block_tokens=16, shards=4, seed=1), t).collect()}
    assert sh["long"].tokens == sh["plain"].tokens and sh["long"].share_reached == 0.5


def test_absent_source_and_empty_tables(spark):
    docs = _docs(spark, 200)
    t = spark.createDataFrame([("big", 0.5, 1), ("ghost", 0.5, 9)], "source string, target_share double, max_repeats int")
    sh = {r.source: r.share_reached for r in mixing.shares(mixing.mix(docs, t, shards=2), t).collect()}
    assert sh == {"big": 1.0, "ghost": 0.0}
    assert mixing.mix(docs.where("false"), t, shards=2).count() == 0


def test_shard_draws_add_up():
    need = {"a": 1000, "b": 37, "c": 0, "d": 3}
    d = mixing.draw_shards(need, 16, 3)
    assert {n: sum(x[3] for x in d if x[1] == n) for n in ("a", "b", "d")} == {"a": 1000, "b": 37, "d": 3}
    for n in ("a", "b", "d"):
        at = 0
        for _, _, start, k in sorted(x for x in d if x[1] == n):
            assert start == at
            at += k
    per = Counter()
    for s, _, _, k in d:
        per[s] += k
    assert max(per.values()) - min(per.values()) <= 2


def test_permutation_is_one(spark):
    for b in (1, 2, 7, 1024, 999):
        d = spark.range(b).select(mixing._permuted(F.col("id"), F.lit(1), F.lit(b), F.lit("s"), 7, F.lit(mixing.coprime_factor(b))).alias("p"))
        assert sorted(r.p for r in d.collect()) == list(range(b))


def test_permutation_of_more_blocks_than_products_fit(spark):
    b = 6_100_000_000
    f = mixing.coprime_factor(b)
    got = [r.p for r in spark.range(b - 5, b).select(mixing._permuted(F.col("id"), F.lit(0), F.lit(b), F.lit("s"), 7, F.lit(f)).alias("p")).collect()]
    assert all(0 <= x < b for x in got) and all((y - x) % b == f for x, y in zip(got, got[1:]))


def test_slots_cover_every_block_once_a_repetition(spark):
    sizes = [("a", 5000, 1.0, 10_000), ("b", 3, 1.0, 3), ("c", 4096, 1.0, 4096)]
    rows = mixing._slots(spark, sizes, 7).collect()
    for s, blocks, _, n in sizes:
        mine = [r for r in rows if r.source == s]
        assert sorted(r.slot for r in mine) == list(range(n))
        assert Counter((r.repeat, r.block) for r in mine) == Counter((k // blocks, k % blocks) for k in range(n))
