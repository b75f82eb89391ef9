"""Only what files have gained is read, whatever way they are cut."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sessionlog.sources import tails

KNOWN = "path string, size long, modified long, place long, mark string"


def found(df):
    return sorted((os.path.basename(r.path), r.line, r.value) for r in df.collect())


def lines_of(name, data):
    at, out = 0, []
    for x in data.split(b"\n"):
        out.append((name, at, x.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(x) + 1
    return out[:-1] if out[-1][2] == "" and data.endswith(b"\n") else out


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_give_every_line_once(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for i in range(4):
        data = b"\n".join(("é" * rng.randrange(30)).encode() + b"\r" * (rng.random() < 0.2) for _ in range(rng.randrange(12)))
        data += b"\n" * rng.randrange(3) + b"x" * rng.randrange(1, 3)
        (tmp_path / f"f {i}+%41.jsonl").write_bytes(data)
        want += lines_of(f"f {i}+%41.jsonl", data)
    work = tails.list_files(spark, str(tmp_path)).withColumn("start", F.lit(0).cast("long"))
    assert found(tails.read_tails(work, size)) == sorted(want)


def test_only_what_grew(spark, tmp_path):
    files = {n: tmp_path / f"{n}.jsonl" for n in ("same", "grown", "cut", "other", "short", "new")}
    first = "".join(f"line {i}\n" for i in range(2000))
    for n, f in files.items():
        if n != "new":
            f.write_text(first + ("half" if n == "cut" else ""))
    (tmp_path / "empty.jsonl").write_text("")
    none = spark.createDataFrame([], KNOWN)
    work = tails.changed_files(tails.list_files(spark, str(tmp_path)), none).cache()
    assert {(os.path.basename(r.path), r.start, r.place) for r in work.collect()} == {
        (f"{n}.jsonl", 0, len(first)) for n in files if n != "new"}
    known = work.select("path", "size", "modified", "place", "mark").cache()
    known.count()
    files["grown"].write_text(first + "more\n")
    files["cut"].write_text(first + "half\nand more")
    files["other"].write_text("x" + first + "more\n")  # longer, but not by an end
    files["short"].write_text(first[:100])
    files["new"].write_text("a\n")
    again = tails.changed_files(tails.list_files(spark, str(tmp_path)), known).cache()
    got = {os.path.basename(r.path)[:-6]: (r.start, r.place) for r in again.collect()}
    assert got == {"grown": (len(first), len(first) + 5), "cut": (len(first), len(first) + 5),
                   "other": (0, len(first) + 6), "short": (0, first[:100].rfind("\n") + 1), "new": (0, 2)}
    read = found(tails.read_tails(again.filter(F.col("start") > 0)))
    assert [x[2] for x in read] == ["half", "and more", "more"]
    assert tails.read_tails(again).count() == 3 + 2001 + 1 + first[:100].count("\n") + 1
