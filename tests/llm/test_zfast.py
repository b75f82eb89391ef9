"""The prefix tree against a plain dictionary of all prefixes."""

import hashlib
import math
import random
import zlib

import pytest

from sessionlog.llm import zfast

SCHEMA = "conv_id long, turn long, role string, text string, lang string, pos int, a string, rc double, arr int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), (r or "").encode(), (x or "").encode()))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    share = {c: (zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))) for c in turns}
    return {c: turns.get(b, [])[:h] + turns[c][h:] for c, (h, b) in share.items()}


def nodes_of(convs):
    members, children, out = {}, {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in children.get(p, [])]
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(x[6] for x in below)
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below),
                  sum(x[5] for x in below) if below else 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "en", 3, "a", 0.5, 9) for r in rows], SCHEMA)
    got = zfast.prefix_tree(zfast.rebuilt(zfast.numbered_turns(df)), **kw)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    say = ["hello", "", None, "é日本", "why", "why not", "a b"]
    out = []
    for c in list(range(60)) + [-7, -3, 10**12]:
        for t in range(rng.randrange(1, 7)):
            out.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(say)))
    out += [(200 + i, t, "user", f"hot {t}") for i in range(30) for t in range(3)]  # copies with one first turn
    out += [(300, None, "user", "no turn"), (300, None, "user", "no turn"), (300, -5, "system", "before"),
            (300, 2, "user", "tie"), (300, 2, "user", "tie"), (300, 2, "assistant", "tie"),
            (None, 0, "user", "no id"), (301, 0, None, "x" * 200_000)]
    out += [(400 + j, t, "user", f"long {t if t < 40 - 9 * j else -t}") for j in range(3) for t in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("piece", [4, 1024])
def test_against_dictionary(spark, rows, piece):
    assert found(spark, rows, piece=piece) == nodes_of(rebuilt(rows))


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "a")]) == []


def test_conversations_without_turns(spark):
    # crc32 of these ids takes more turns than there are, and their families have no first one.
    ids = [c for c in range(1000, 1200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:4]
    rows = [(c, 0, "user", "gone") for c in ids]
    assert found(spark, rows) == nodes_of(rebuilt(rows)) and len(found(spark, rows)) == 1


def test_two_fattest(spark):
    pairs = [(lo, hi) for lo in range(20) for hi in range(lo + 1, 40)]
    df = spark.createDataFrame(pairs, "lo long, hi long")
    got = {(r.lo, r.hi): r.f for r in df.withColumn("f", zfast.two_fattest(df.lo, df.hi)).collect()}
    assert got == {(lo, hi): max(range(lo + 1, hi + 1), key=lambda x: x & -x) for lo, hi in pairs}


def test_long_id_lists_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(zfast, "ID_TEXT", 40)
    rows = [(5 * c, 0, "user", "same") for c in range(300)]
    assert found(spark, rows) == nodes_of(rebuilt(rows))
