"""Host rules, resampling, and mixing."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlog.llm import cube, hostrules, resample

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_rule_facts(docs, texts, empty):
    want = Counter()
    for i, t, s in texts:
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = t.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
        want[i, s, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated)] += 1
    assert Counter(tuple(r) for r in hostrules.rule_facts(docs).collect()) == want
    assert hostrules.host_verdicts(empty).count() == 0


def test_hosts_pull_their_documents_down(spark):
    rows = [(i, "w " * 3 if i % 10 else "good words all of them here and one two three", "bad") for i in range(200)]
    rows += [(1000 + i, f"good words all of them here and one two three {i}", "fine") for i in range(200)]
    rows += [(2000, "good words all of them here and one two four", None), (2001, "short", None)]
    got = {r["doc_id"]: r for r in hostrules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["base_failed"] is False and got[0]["kept"] is False and got[1000]["kept"] is True
    n = {"bad": (200, 180), "fine": (200, 0), None: (2, 1)}
    docs, failed = sum(x for x, _ in n.values()), sum(f for _, f in n.values())
    p = failed / docs
    spread = sum(f * f / x for x, f in n.values()) / docs - p * p - p * (1 - p) * len(n) / docs
    m = max(1, min(1e6, p * (1 - p) / spread - 1))
    assert got[2000]["host_rate"] == pytest.approx((1 + p * m) / (2 + m), abs=1e-6)


def _labelled(spark, n=600):
    rng = random.Random(3)
    pool = [f"word{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(pool) for _ in range(rng.choice([30, 200]))]
        kind = rng.choice(["good", "good", "good", "toxic", "junk"])
        if kind == "toxic":
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["nasty", "vile"])
        if kind == "junk":
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text), kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    docs += [(None, "word1 word2", "good"), (n, None, "good"), (n + 1, "", "good"), (1, docs[1][1], docs[1][2])]
    labels += [(None, 1, 0), (5000, None, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, kind string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_resampling_parts_good_from_bad(spark):
    docs, labels = _labelled(spark)
    found = resample.quality_filter(docs, labels, carry=["kind"]).collect()
    assert len(found) == docs.count()
    kept = defaultdict(list)
    for r in found:
        kept[r["kind"]].append(r["kept"])
    assert np.mean(kept["good"]) > 0.97 and np.mean(kept["toxic"]) < 0.05 and np.mean(kept["junk"]) < 0.05
    again = resample.quality_filter(docs, labels).collect()
    assert Counter((r["doc_id"], r["log_weight"], r["gumbel_key"], r["kept"]) for r in again) == Counter(
        (r["doc_id"], r["log_weight"], r["gumbel_key"], r["kept"]) for r in found)
    # Exactly the rows whose key reaches the k-th, k being the rows above the bar.
    keys = sorted((r["gumbel_key"] for r in found), reverse=True)
    k = sum(r["kept"] for r in found)
    assert all(r["kept"] == (r["gumbel_key"] >= keys[k - 1]) for r in found)


def test_rejected_of_held_out_labels(spark):
    """Clean texts of any length stay, most toxic ones go; each fifth label is not seen by the fit."""
    data = "/root/testdata/sf0.1"
    if not os.path.isdir(data):
        pytest.skip("no data")
    docs = spark.read.parquet(f"{data}/documents.parquet").dropDuplicates(["doc_id"])
    labels = spark.read.parquet(f"{data}/labels.parquet").dropna().dropDuplicates(["doc_id"])
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    kept = resample.quality_filter(docs, labels.filter(~held)).select("doc_id", "kept")
    rows = kept.join(labels.filter(held), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    tokens = {r["doc_id"]: int(n) for r in rows for n in resample._Features().tokens([r["text"]])[1]}
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    rejected = [np.mean([not r["kept"] for r in clean if low <= tokens[r["doc_id"]] < high])
                for low, high in ((0, 302), (302, 1510), (1510, 1 << 40))]
    toxic = np.mean([r["kept"] for r in rows if r["toxic"] == 1])
    print("clean rejected", rejected, "toxic kept", toxic)
    assert max(rejected) < 0.1 and toxic < 0.3


def test_resampling_without_rows_or_labels(spark):
    docs, labels = _labelled(spark, 20)
    assert resample.quality_filter(docs.limit(0), labels).count() == 0
    assert all(r["kept"] for r in resample.quality_filter(docs, labels.limit(0)).collect())


def test_counts_of_buckets(spark, docs, texts):
    marked = docs.selectExpr("text", "doc_id % 2 = 0 as t").selectExpr("text", "coalesce(t, false) as target")
    got = {r["bucket"]: (r["target"], r["raw"]) for r in resample.bucket_counts(marked).collect()}
    want = defaultdict(lambda: [0, 0])
    features = resample._Features()
    for i, t, _ in texts:
        tokens, sizes = features.tokens([t])
        plain = [x for w in (t or "").encode().split() for x in re.findall(r"\w+|[^\w\s]+", w.decode().lower())]
        assert sizes.tolist() == [len(plain)]
        one, two = features.buckets(tokens, sizes)
        for b in [*one.tolist(), *two[1:].tolist()]:
            want[b][1] += 1
            want[b][0] += i is not None and i % 2 == 0
    assert got == {b: tuple(x) for b, x in want.items()}


@pytest.mark.parametrize("k", [1, 2, 7, 100, 149, 150])
def test_kth_largest(spark, k):
    rng = random.Random(1)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-3, 4) for _ in range(140)] + [0.0] * 5 + [1.5] * 5
    frame = spark.createDataFrame([(v,) for v in values], "value double")
    assert resample.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]


def test_kth_of_too_few(spark):
    assert resample.kth_largest(spark.createDataFrame([(1.0,)], "value double"), 2) is None


def _mixture(sizes: dict, weights=(5, 2, 1), most=3.0):
    """Targets by giving out the rest by weight, again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        share = {s: (total - sum(fixed.values())) * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(docs, texts, empty):
    rows = cube.mix(docs, block=25, carry=["tk"]).collect()
    sizes, by_source = defaultdict(int), defaultdict(list)
    for _, t, s in texts:
        sizes[s] += len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in texts)
    target = _mixture(sizes)
    for r in rows:
        by_source[r["source"]].append(r)
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert not r["size"] or math.floor(rate + 1e-9) <= r["copies"] <= math.ceil(rate - 1e-9)
    assert [tuple(r) for r in cube.mix(docs, block=25, carry=["tk"]).orderBy("doc_id", "size").collect()] == sorted(
        (tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert cube.mix(empty).count() == 0


def test_mix_comes_near(spark):
    rng = random.Random(2)
    rows = [(i, "w " * min(3000, int(rng.paretovariate(1.1) * 20)), rng.choice("aaaaaabcd")) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for s, taken, target in cube.mix(frame, block=1000).groupBy("source").agg(
            {"taken": "sum", "target": "max"}).select("source", "sum(taken)", "max(target)").collect():
        assert taken == pytest.approx(target, rel=0.02), s


def test_flight_keeps_sums():
    rng = np.random.default_rng(4)
    size, pi = rng.integers(1, 500, 300), np.full(300, 0.37)
    out = cube.fly(size, pi, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and size @ out == pytest.approx(size @ pi)
    means = np.mean([cube.fly(size[:20], pi[:20], np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(means - 0.37).max() < 0.04
