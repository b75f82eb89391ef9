"""Shingle classes, repeated strings and near vectors against brute force."""

import hashlib
import math
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlog.llm import jaccard, pivots, repeats
from sessionlog.llm.common import components


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_classes(docs, texts, width, percent):
    sets = []
    for _, t, _ in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(up, i), find(up, j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(texts):
        if d is not None:
            least[find(up, i)].append(d)
    want = Counter((d, len(sets[i]), min(least[find(up, i)], default=None)) for i, (d, _, _) in enumerate(texts))
    got = jaccard.classes(docs, width, percent, carry=["tk"])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


def test_a_set_meets_other_sets_in_other_lists(spark):
    """With the smallest set of each list all would meet the same one, which may be far from them."""
    rows = [(h, bytes([k]), 10) for h in range(40) for k in range(30)]
    pairs = jaccard.star_pairs(spark.createDataFrame(rows, "h long, key binary, n int"), 85).collect()
    assert len(pairs) <= len(rows) and len({r["a"] for r in pairs}) > 5
    assert {bytes(r["b"]) for r in pairs} == {bytes([k]) for k in range(30)}


def test_classes_of_nothing(empty):
    assert jaccard.classes(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=12),
       st.sampled_from([50, 80, 85, 100]))
def test_divide_skip(query, sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in [query, *sets]]
    got = jaccard.divide_skip(arrays[0], arrays[1:], percent).tolist()
    assert got == [100 * len(query & s) >= percent * len(query | s) for s in sets]


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    pairs += [(2000, i) for i in range(2001, 2200)] + [(5, 5), (None, 3)]
    up = {x: x for p in pairs for x in p if x is not None}
    for a, b in pairs:
        if a is not None:
            a, b = find(up, a), find(up, b)
            up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(up, x) for p in pairs if None not in p and p[0] != p[1] for x in p}


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("length, hot", [(200, 20_000), (200, 2), (31, 3), (64, 20_000)])
def test_repeats(docs, texts, length, hot):
    want = Counter((i, n, gone, spans, hashlib.sha256(kept).hexdigest(), kept) for (i, _, _), (n, gone, spans, kept) in zip(
        texts, brute_repeats([t for _, t, _ in texts], length), strict=True))
    got = repeats.drop_repeats(docs, length, hot, keep_text=True, carry=["source", "lang"]).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got) == want


def test_repeats_of_nothing(empty):
    assert repeats.drop_repeats(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5), st.integers(16, 30))
def test_anchors_and_passes(found, length):
    """All windows, each in the group of its anchor, give the repeated ones."""
    raw = [t.encode() for t in found]
    scan = repeats.Scan(raw, length)
    starts, groups, at = [], [], np.cumsum([0, *map(len, raw)])
    names = {}
    for d, p, first, last, h in zip(scan.doc, scan.p, scan.first, scan.last, scan.hash, strict=True):
        for i in range(first, last + 1):
            starts.append(at[d] + i)
            groups.append(names.setdefault((int(h), int(p - i)), len(names)))
    assert sorted(starts) == [at[d] + i for d, b in enumerate(raw) for i in range(len(b) - length + 1)]
    data = b"".join(raw)
    if starts:
        got = repeats.equal_windows(np.frombuffer(data, np.uint8), np.array(starts), np.array(groups), length)
        seen = Counter(data[s:s + length] for s in starts)
        assert got.tolist() == [seen[data[s:s + length]] > 1 for s in starts]


def test_texts_are_scanned_in_small_blocks(monkeypatch):
    """What is scanned together fits a core's cache, and the anchors are those of each text alone."""
    rng = random.Random(5)
    raw = [bytes(rng.choices(b"abcdef", k=rng.randrange(40_000))) for _ in range(40)] + [b"ab" * 100_000]
    sizes, scan = [], repeats.Scan._scan

    def sized(pieces, length):
        sizes.append(sum(len(b) for _, _, b in pieces) if len(pieces) > 1 else 0)
        return scan(pieces, length)

    monkeypatch.setattr(repeats.Scan, "_scan", staticmethod(sized))
    found = repeats.Scan(raw, 200)
    assert max(sizes) <= repeats.SCAN_BYTES < sum(map(len, raw))
    alone = [repeats.Scan([b], 200) for b in raw]
    assert found.doc.tolist() == [i for i, s in enumerate(alone) for _ in s.p]
    for name in ("p", "first", "last", "hash"):
        assert getattr(found, name).tolist() == np.concatenate([getattr(s, name) for s in alone]).tolist()


def test_a_text_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 500)
    text = bytes(random.Random(3).choices(b"abcdef", k=4000))
    whole = repeats.Scan([text], 100)
    assert sum(whole.last - whole.first + 1) == 4000 - 99


def vectors(n=600, d=64):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, d))
    for i in range(n // 2, n):  # near ones, cosines from 0.9 up
        y = x[rng.integers(0, n // 2)]
        noise = rng.normal(size=d)
        noise -= noise @ y / (y @ y) * y
        c = rng.uniform(0.9, 1.0)
        x[i] = c * y / np.linalg.norm(y) + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)
    rows = [(int(i), v.astype(np.float32).tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(9)] + [(1000, rows[7][1], 1)]
    odd = [None, [0.0] * d, [1.0, None] * (d // 2), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), []]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(2100, rows[7][1], None), (None, rows[7][1], 1)]
    rows += [(2200, [1.0, 2.0], 0), (2201, [1.0, 2.1], 0), (2202, [3e38] * d, 0), (2203, [1e-38] * d, 0)]
    return rows


def test_near_duplicates(spark):
    rows = vectors()
    unit = []
    for _, v, label in rows:
        a = np.array([np.nan if c is None else c for c in v] if v is not None else [], float)
        ok = label is not None and len(a) and np.isfinite(a).all() and a.any()
        unit.append(a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) if ok else None)
    up, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2] or a @ b < 0.93:
                continue
            links[i] += 1
            links[j] += 1
            s, t = find(up, i), find(up, j)
            up[max(s, t)] = min(s, t)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = pivots.near_duplicates(frame)
    found = sum(r["n_links"] for r in got.collect())
    assert found <= sum(links) and found >= 0.95 * sum(links)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(up, i)].append(r[0])
    exact = pivots.near_duplicates(frame, shared=1, nearest=64, pivots=64)  # every list: nothing can be missed
    want = Counter()
    for i, r in enumerate(rows):
        least = min((x for x in ids[find(up, i)] if x is not None), default=None)
        want[r[0], links[i], least, r[0] == least] += 1
    assert Counter(tuple(r) for r in exact.collect()) == want
    assert pivots.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicates_of_a_dense_group(spark):
    """A third of 12,000 vectors in one group of near copies."""
    rng, d = np.random.default_rng(4), 64
    x = rng.normal(size=(12_000, d))
    x[:4000] = x[0] / np.linalg.norm(x[0]) + x[:4000] * np.sqrt((1 / 0.945 - 1) / d)
    x = x.astype(np.float32)
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = sum(int((u[i:i + 2000] @ u.T >= 0.93).sum()) - 2000 for i in range(0, len(u), 2000))
    assert links > 1_000_000
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = pivots.near_duplicates(frame).agg(F.sum("n_links")).first()[0]
    assert 0.9 * links <= got <= links


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1)), min_size=1, max_size=6))
def test_signatures_differ_in_no_more_bits(sets):
    h = np.array([x for s in sets for x in sorted(s)], np.uint64)
    sig = jaccard.signatures(h, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert sum(int(x).bit_count() for x in (sig[i] ^ sig[j]).view(np.uint64)) <= len(a ^ b)


def test_workers_give_memory_back():
    """What a task has freed does not stay with its worker, where the executor's other work lacks it."""
    code = """
import numpy as np
from sessionlog.llm.common import give_back
def held(): return int(open('/proc/self/statm').read().split()[1]) * 4 // 1024
parts = [np.ones(1 << 16, np.uint8) for _ in range(1600)]
keep = parts[-1]
del parts
before = held()
give_back()
print(before - held())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(out) > 50


def near_copies(n, words, edits, seed=7):
    """Copies of one text, each with some words of its own."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.choice(edits)):
            own[k] = f"own{i}x{k}"
        out.append(" ".join(own))
    return out


def test_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """Pairs that are looked at don't grow with the square of the group, and no link is lost."""
    texts = near_copies(240, 150, [0, 1, 2, 3, 5, 6, 7, 8])
    seen = []

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return may_link(pairs, *rest)

    may_link = jaccard.may_link
    monkeypatch.setattr(jaccard, "may_link", counting)
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(up, i), find(up, j)
                up[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(frame).collect()}
    assert got == {i: find(up, i) for i in range(len(sets))}
    # Each one outside the group was told with each other one before.
    assert len(seen) == 3 and seen[2] < 5 * len(texts)


def test_signatures_tell_large_sets_apart():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (10, 6000, 0, 6100, 8300)]
    sigs = jaccard.fitting_signatures(np.concatenate(sets), np.array([len(s) for s in sets])).to_pylist()
    assert [len(s) for s in sigs] == [16, 128, 16, 128, 256]
    differ = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
    assert differ(sigs[1], sigs[3]) > 2 * (12_100 - 2 * jaccard.needed(6000, 6100, 85))


def test_signatures_of_two_lengths(spark):
    """Sets of 2,000 and 2,100 shingles have signatures of 2,048 and 4,096 bits."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    sets = {b"a": a, b"b": np.concatenate([a, rng.integers(0, 1 << 63, 100).astype(np.uint64)]),
            b"c": rng.integers(0, 1 << 63, 2100).astype(np.uint64)}
    sigs = jaccard.fitting_signatures(np.concatenate([np.sort(s) for s in sets.values()]), np.array([2000, 2100, 2100]))
    own = spark.createDataFrame([(bytearray(k), len(s), g) for (k, s), g in zip(sets.items(), sigs.to_pylist(), strict=True)],
                                "key binary, n int, sig array<long>")
    pairs = spark.createDataFrame([(bytearray(x), bytearray(y)) for x in sets for y in sets if x < y], "a binary, b binary")
    assert [(bytes(r["a"]), bytes(r["b"]), r["differ"] <= 100) for r in jaccard.may_link(pairs, own, 85).collect()] == [(b"a", b"b", True)]


def test_lists_hold_only_sets_that_can_meet(spark):
    """By size, and by what is left of the sets from their places on."""
    rows = [(1, 100, 0), (1, 110, 1), (1, 300, 0), (2, 100, 9), (2, 100, 3), (3, 100, 8), (3, 100, 8), (4, 50, 0)]
    rows = [(h, bytes([i]), n, place, False) for i, (h, n, place) in enumerate(rows)]
    rows += [(5, bytes([i]), 1000 * 2**i, 0, False) for i in range(20)]
    first = spark.createDataFrame(rows + rows[:2], "h long, key binary, n int, place int, often boolean").repartition(5)
    got = sorted((r["h"], bytes(r["key"])) for r in jaccard.shared_lists(first, 85).collect())
    assert got == [(1, b"\0"), (1, b"\1"), (3, b"\5"), (3, b"\6"), *[(5, bytes([i])) for i in range(20)]]
