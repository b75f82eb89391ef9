"""The n-gram model against a dictionary version."""

import math
import tempfile
import zlib
from collections import Counter, defaultdict

import pytest

from sessionlog.llm import knlm

END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def brute(texts):
    train = [tokens(t) for i, t, _ in texts if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    uni = Counter(w for d in train for w in d)
    pairs = Counter(p for d in train for p in zip([None, *d], d, strict=False))
    heads, tails = defaultdict(list), Counter()
    for (u, w), n in pairs.items():
        heads[u].append(n)
        tails[w] += 1
    grade = lambda counts: knlm.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])
    d, e = grade(pairs.values()), grade(tails.values())
    cut = lambda n, ds: ds[min(n, 3) - 1]
    unknown = sum(cut(n, e) for n in tails.values()) / len(pairs) / (len(uni) + 1)

    def low(w):
        return (tails[w] - cut(tails[w], e)) / len(pairs) + unknown if tails[w] else unknown

    def prob(u, w):
        if u not in heads:
            return low(w)
        total = sum(heads[u])
        n = pairs.get((u, w), 0)
        return (max(n - cut(n, d), 0) / total if n else 0) + sum(cut(x, d) for x in heads[u]) / total * low(w)

    return uni, prob


@pytest.mark.parametrize("frequent", [1000, 20])
def test_scores(docs, texts, frequent, monkeypatch):
    monkeypatch.setattr(knlm, "FREQUENT", frequent)
    uni, prob = brute(texts)
    n, v = sum(uni.values()), len(uni)
    want = Counter()
    for i, t, _ in texts:
        d = tokens(t)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        score = sum(math.log10(prob(u, w)) for u, w in zip([None, *d], d, strict=False))
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
        want[i, held, len(d), sum(uni[w] > 0 for w in d), n, f"{base:.6f}", f"{score:.6f}"] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6f}",
                   f"{r['score']:.6f}") for r in knlm.train_and_score(docs, tempfile.mkdtemp(prefix="lm-")).collect())
    assert got == want
    # Probabilities after a known word, over the vocabulary and one unknown word, sum to one.
    u = next(iter(w for w in uni if w is not END))
    assert sum(prob(u, w) for w in uni) + prob(u, "never") == pytest.approx(1)


def test_no_training_text(spark, docs):
    none = docs.filter(knlm.is_held_out(docs["doc_id"]))
    rows = knlm.train_and_score(none, tempfile.mkdtemp(prefix="lm-")).collect()
    assert rows and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert knlm.train_and_score(docs.limit(0), tempfile.mkdtemp(prefix="lm-")).count() == 0
