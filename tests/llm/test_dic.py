"""Phrase collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sessionlog.llm import dic

SCHEMA = "doc_id long, text string, lang string, n int, score double, phrase string, h string"


def brute(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    some = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    within = Counter()
    for (lang, words), a in some.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                within[lang, words[i:i + k]] = max(a, within[lang, words[i:i + k]])
    out = {}
    for (lang, w), a in some.items():
        if 100 * within[lang, w] >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
                  for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    pool = ["the", "The", "of", "é", "É", "ha", "日本", "x y", "#", "in", "to", "a"]
    out = []
    for i in range(150):
        words = [rng.choice(pool) + rng.choice(["", "", "", ",", ".", "\n", "\r\n", " \t", "! "]) for _ in range(rng.randrange(80))]
        if rng.random() < 0.4:
            words[5:5] = ["One", "fixed", "phrase", "of", "six", "words"]
        out.append((rng.choice(["en", "en", "en", "fr", None, "", "und"]), " ".join(words)))
    out += [("en", None), (None, ""), ("fr", " .,; \t\n"), ("en", "copy of a copy of a copy")] + [("en", "copy of a copy of a copy")] * 40
    out.append(("en", "very long text " * 30_000 + "z" * 100_000))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 3, 0.5, "p", "h") for i, (lang, t) in enumerate(rows)], SCHEMA)


def found(df, *args, **kw):
    got = dic.collocations(df, *args, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("shards", [1, 4])
def test_against_counting(spark, rows, shards):
    assert found(frame(spark, rows).repartition(3), 12, 5, 2000, shards) == brute(rows, 12, 5, 2000)


def test_crowded_slots_and_small_slices(spark, rows, monkeypatch):
    """Phrases that share slots, texts cut at pieces and tallies sent early change nothing."""
    monkeypatch.setattr(dic, "MOST_SLOTS", 64)
    monkeypatch.setattr(dic, "SLICE_BYTES", 50)
    monkeypatch.setattr(dic, "TALLY_ROWS", 40)
    monkeypatch.setattr(dic, "SLOT_BYTES", 1 << 40)
    few = rows[:60]
    assert found(frame(spark, few), 6, 4, 7, 3) == brute(few, 6, 4, 7)


def test_phrases_of_one_shard(spark):
    """Scans of shards without any open phrase don't end the cycle: long phrases of one document are counted."""
    for place in range(4):
        few = [("en", "again " * 30 if i == place else "") for i in range(4)]
        assert found(frame(spark, few).coalesce(1), 12, 5, 2000, 4) == brute(few, 12, 5, 2000)


def test_no_rows(spark):
    assert found(frame(spark, []), 1, 5) == []
    assert found(frame(spark, [("en", None), (None, "")]), 1, 5) == []


def test_scores_past_64_bits(spark):
    wide = spark.createDataFrame([(10**12, 10**13, 3 * 10**12, 5 * 10**12)], "a long, n long, l long, r long")
    number = "CAST({} AS DECIMAL(20,0))".format
    got = wide.selectExpr(f"(CAST(a * 1000 AS DECIMAL(20,0)) * {number('n')}) div ({number('l')} * {number('r')}) AS s")
    assert got.first().s == 1000 * 10**12 * 10**13 // (3 * 10**12 * 5 * 10**12)


def test_words_of_a_slice():
    data = "Ab\tc, dé AB".encode()
    h, s, e, piece = dic.Hasher().words(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.ones(1, np.uint64))
    assert [data[i:j].decode() for i, j in zip(s, e)] == ["Ab", "c", "dé", "AB"]
    assert h[0] == h[3] and piece[0] == piece[1] != piece[2] == piece[3]
