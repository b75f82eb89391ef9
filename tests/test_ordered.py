"""Running values: plain form and block form against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlog.functions import ordered as o

KEYS = ["k"]
ORDER = ["ts", "id"]


def rows(seed=7, n=160):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 2 else r.choice(["a", "b", "c"])
        out.append((key, f"2026-01-01T00:{r.randrange(12):02d}", i, r.choice([None, r.randrange(50)])))
    return out


def loop(data, reverse):
    groups = {}
    for row in sorted(data, key=lambda x: (x[1], x[2]), reverse=reverse):
        groups.setdefault(row[0], []).append(row)
    out = {}
    for key, items in groups.items():
        for i, (_, _, rid, _) in enumerate(items):
            before = [x[3] for x in items[:i] if x[3] is not None]
            out[rid] = (
                sum(before),
                max(before, default=None),
                min(before, default=None),
                before[-1] if before else None,
                [x[2] for x in items[max(0, i - 2): i + 1]],
                before[-3:],
                sorted(before, reverse=True)[:3],
            )
    return out


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("block_rows", [1000, 10, 3])
def test_running_values_equal_a_loop(spark, reverse, block_rows):
    data = rows()
    df = spark.createDataFrame(data, "k string, ts string, id bigint, v int")
    heavy = o.heavy_keys(df, "k", block_rows)
    assert ("hot" in heavy.keys) == (block_rows < 80)
    v = F.col("v")
    got = (
        o.ordered(df, KEYS, ORDER, heavy, reverse)
        .running(
            {
                "s": o.running_sum(v), "hi": o.running_max(v), "lo": o.running_min(v),
                "last": o.running_last(v), "tail": o.running_tail(F.col("id"), 3),
            }
        )
        .last_k("last3", v, 3)
        .top_k("top3", v, 3)
        .result()
        .collect()
    )
    want = loop(data, reverse)
    assert len(got) == len(data)
    for r in got:
        mine = (r.s, r.hi, r.lo, r.last, list(r.tail), list(r.last3), list(r.top3))
        assert mine == want[r.id], (r, want[r.id])


def test_blocks_stay_small_and_in_order(spark):
    data = [("hot", f"2026-01-{1 + i // 40:02d}T{i % 24:02d}", i, 1) for i in range(400)]
    df = spark.createDataFrame(data, "k string, ts string, id bigint, v int")
    cut = o._cut(df, KEYS, ORDER, 25)
    sizes = cut.groupBy("_blk").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    blocks = sizes.orderBy("_blk").collect()
    assert max(b.n for b in blocks) <= 25 and sum(b.n for b in blocks) == 400
    assert all(a.hi <= b.lo for a, b in zip(blocks, blocks[1:]))


def test_rows_equal_up_to_the_last_order_column_are_cut(spark):
    df = spark.createDataFrame([("hot", "", i, 1) for i in range(300)], "k string, ts string, id bigint, v int")
    heavy = o.heavy_keys(df, "k", 20)
    ord_ = o.ordered(df, KEYS, ORDER, heavy)
    assert ord_.hot.groupBy("_blk").count().agg(F.max("count")).first()[0] <= 20
    got = ord_.running({"s": o.running_sum(F.lit(1))}).result()
    assert got.filter("s != id").isEmpty() and got.count() == 300


def test_top_k_of_structs_in_blocks(spark):
    df = spark.createDataFrame([("hot", f"{i:03d}", i, i * 7 % 50) for i in range(60)],
                               "k string, ts string, id bigint, v int")
    best = lambda n: (
        o.ordered(df, KEYS, ORDER, o.heavy_keys(df, "k", n))
        .top_k("t", F.struct("v", "id"), 2, largest=False).result()
        .select("id", "t").orderBy("id").collect())
    assert best(1000) == best(7)


def test_heavy_keys_finds_only_heavy_ones(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3, "session_id string")
    assert o.heavy_keys(df, block_rows=3).keys == ("a",)
    assert o.heavy_keys(df, block_rows=9).keys == ()
