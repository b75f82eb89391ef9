"""Ordered per-key running values that stay parallel when one key is huge.

A session is a short time series in most logs, and then a plain window over
``session_id`` is the right plan: one shuffle, one sort.  A window puts a whole
key in one task, though, so a session that holds a large part of all rows would
serialise the job.  :func:`ordered` therefore looks for keys above
``block_rows`` rows first.  All other rows take the plain window.  Rows of heavy
keys are written out once and cut into blocks along the sort order; the window
runs per block, and one total per block is carried into the following blocks.
Both forms give the same values.

What is broadcast is the list of heavy blocks: at most ``MAX_HEAVY`` short rows
per cutting step, whatever the size of the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Rows of one key that one task may sort.  Above it the key is cut into blocks.
BLOCK_ROWS = 1 << 20
#: Most heavy keys (or blocks) cut per step.  Any key left out has at most
#: ``rows / MAX_HEAVY`` rows.
MAX_HEAVY = 4096
#: Characters after the common prefix that separate sibling blocks.
_STEP = 3
_MAX_CUTS = 24
_SEP = "\u0001"


@dataclass(frozen=True)
class HeavyKeys:
    """Sessions found to hold more than ``block_rows`` rows of a base table.

    Every operator frame derives from the base table with at most a constant
    number of rows per base row, so one probe serves all operators.
    """

    keys: tuple[str, ...]
    block_rows: int = BLOCK_ROWS


def heavy_keys(df: DataFrame, key: str = "session_id", block_rows: int = BLOCK_ROWS) -> HeavyKeys:
    """Find heavy keys with one pre-aggregated count over the key column."""
    rows = (
        df.groupBy(F.col(key).alias("k"))
        .count()
        .filter(F.col("count") > block_rows)
        .orderBy(F.desc("count"))
        .limit(MAX_HEAVY)
        .collect()
    )
    return HeavyKeys(tuple(r["k"] for r in rows if r["k"] is not None), block_rows)


def order_text(df: DataFrame, order: list[str]) -> Column:
    """Text that sorts like ``order``: numbers are zero-padded, parts separated."""
    types = dict(df.dtypes)
    parts = [
        F.coalesce(F.col(c), F.lit(""))
        if types[c] == "string"
        else F.lpad(F.col(c).cast("string"), 20, "0")
        for c in order
    ]
    return F.concat_ws(_SEP, *parts)


# -- running values ---------------------------------------------------------


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` in sum, max, min, last, tail."""

    kind: str
    value: Column
    inclusive: bool = False
    k: int = 0


def running_sum(value: Column, inclusive: bool = False) -> Running:
    return Running("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = False) -> Running:
    return Running("max", value, inclusive)


def running_min(value: Column, inclusive: bool = False) -> Running:
    return Running("min", value, inclusive)


def running_last(value: Column, inclusive: bool = False) -> Running:
    """Latest non-null value."""
    return Running("last", value, inclusive)


def running_tail(value: Column, k: int) -> Running:
    """List of the last ``k`` rows' values, the current row included (value must not be null)."""
    return Running("tail", value, True, k)


def _local(spec: Running, col: str, w) -> Column:
    if spec.kind == "tail":
        lags = [F.lag(col, i).over(w) for i in range(spec.k - 1, 0, -1)]
        return F.array_compact(F.array(*lags, F.col(col)))
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    c = F.col(col)
    if spec.kind == "sum":
        return F.coalesce(F.sum(c).over(frame), F.lit(0))
    if spec.kind == "max":
        return F.max(c).over(frame)
    if spec.kind == "min":
        return F.min(c).over(frame)
    return F.last(c, ignorenulls=True).over(frame)


def _windows(df: DataFrame, by: list[str], sort: list[Column], outs: dict[str, Running]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*sort)
    return df.withColumns({n: _local(s, f"_in_{n}", w) for n, s in outs.items()})


def _sorts(order, reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


# -- the plain form: one window per key -------------------------------------


def _plain_running(df, keys, order, reverse, outs):
    inputs = {f"_in_{n}": s.value for n, s in outs.items()}
    df = _windows(df.withColumns(inputs), keys, _sorts(order, reverse), outs)
    return df.drop(*inputs)


def _plain_last_k(df, keys, order, reverse, name, value, k):
    """Each step lets a row with a value remember one more of its forerunners."""
    mine, known, prev = F.col(f"_v_{name}"), F.col(f"_l_{name}"), F.col(f"_p_{name}")
    df = df.withColumn(f"_v_{name}", value)
    df = df.withColumn(f"_l_{name}", F.when(mine.isNotNull(), F.array(mine)))
    for _ in range(k - 1):
        df = _plain_running(df, keys, order, reverse, {f"_p_{name}": running_last(known)})
        both = F.when(prev.isNull(), F.array(mine)).otherwise(F.concat(prev, F.array(mine)))
        df = df.withColumn(f"_l_{name}", F.when(mine.isNotNull(), both))
    df = _plain_running(df, keys, order, reverse, {name: running_last(known)})
    df = df.withColumn(name, F.coalesce(F.col(name), F.array()))
    return df.drop(f"_v_{name}", f"_l_{name}", f"_p_{name}")


def _plain_top_k(df, keys, order, reverse, name, value, k, largest):
    """The running best hands the loser of each comparison to the next rank."""
    run = running_max if largest else running_min
    lose = F.least if largest else F.greatest
    x = F.col(f"_x_{name}")
    df = df.withColumn(f"_x_{name}", value)
    for r in range(k):
        df = _plain_running(df, keys, order, reverse, {f"_b{r}_{name}": run(x)})
        best = F.col(f"_b{r}_{name}")
        if r < k - 1:
            df = df.withColumn(f"_x_{name}", F.when(x.isNotNull() & best.isNotNull(), lose(x, best)))
    bests = [f"_b{r}_{name}" for r in range(k)]
    df = df.withColumn(name, F.array_compact(F.array(*bests)))
    return df.drop(f"_x_{name}", *bests)


# -- the block form: windows per block, totals carried over blocks ----------


def _last(lists: Column, k: int) -> Column:
    return F.slice(lists, F.greatest(F.size(lists) - k + 1, F.lit(1)), k)


def _best(values: Column, k: int, largest: bool) -> Column:
    ranked = F.reverse(F.array_sort(values)) if largest else F.array_sort(values)
    return F.slice(ranked, 1, k)


def _total(spec: Running, name: str, col: str, pick) -> Column:
    """Aggregate that sums up one block."""
    c = F.col(col)
    if spec.kind == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if spec.kind == "max":
        return F.max(c)
    if spec.kind == "min":
        return F.min(c)
    if spec.kind == "last":
        return pick(c, F.when(c.isNotNull(), F.col("_ord")))
    return pick(F.col(name), F.col("_ord"))


def _carry(spec: Running, name: str, w) -> Column:
    """Value of all earlier blocks of the key."""
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col(name)
    if spec.kind == "sum":
        return F.sum(c).over(frame)
    if spec.kind == "max":
        return F.max(c).over(frame)
    if spec.kind == "min":
        return F.min(c).over(frame)
    if spec.kind == "last":
        return F.last(c, ignorenulls=True).over(frame)
    return _last(F.flatten(F.collect_list(c).over(w.rowsBetween(-spec.k, -1))), spec.k)


def _combine(spec: Running, name: str) -> Column:
    local, carry = F.col(name), F.col("_c_" + name)
    if spec.kind == "sum":
        return local + F.coalesce(carry, F.lit(0))
    if spec.kind == "max":
        return F.greatest(local, carry)
    if spec.kind == "min":
        return F.least(local, carry)
    if spec.kind == "last":
        return F.coalesce(local, carry)
    return _last(F.when(carry.isNull(), local).otherwise(F.concat(carry, local)), spec.k)


def _block_running(df, keys, order, reverse, outs):
    by = [*keys, "_blk"]
    inputs = {f"_in_{n}": s.value for n, s in outs.items()}
    df = _windows(df.withColumns(inputs), by, _sorts(order, reverse), outs)
    pick = F.min_by if reverse else F.max_by
    totals = (
        df.filter(F.col("_blk") != "")
        .withColumn("_ord", F.struct(*order))
        .groupBy(*by)
        .agg(*[_total(s, n, f"_in_{n}", pick).alias(n) for n, s in outs.items()])
    )
    # One row per block: this window holds the blocks of a key, not its rows.
    wb = Window.partitionBy(*keys).orderBy(*_sorts(["_blk"], reverse))
    carry = totals.select(*by, *[_carry(s, n, wb).alias("_c_" + n) for n, s in outs.items()])
    df = df.join(carry, by, "left").withColumns({n: _combine(s, n) for n, s in outs.items()})
    return df.drop(*inputs, *["_c_" + n for n in outs])


def _block_lists(df, keys, order, reverse, name, value, plain, merge):
    """Running lists (``plain`` form per block), with the lists of earlier blocks merged in."""
    by = [*keys, "_blk"]
    mine = F.col(f"_w_{name}")
    df = plain(df.withColumn(f"_w_{name}", value), by, order, mine)
    local = F.col(name)
    through = F.when(mine.isNull(), local).otherwise(F.concat(local, F.array(mine)))
    pick = F.min_by if reverse else F.max_by
    totals = (
        df.filter(F.col("_blk") != "")
        .groupBy(*by)
        .agg(pick(merge(through), F.struct(*order)).alias("list"))
        # Place in the list, made to grow in reading direction.
        .select(*by, F.posexplode_outer("list").alias("i", "v"))
        .withColumn("i", F.coalesce(F.col("i"), F.lit(0)) * (-1 if reverse else 1))
    )
    carry = (
        plain(totals, keys, ["_blk", "i"], F.col("v"))
        .filter(F.col("i") == 0)
        .select(*by, F.col(name).alias(f"_c_{name}"))
    )
    carried = F.coalesce(F.col(f"_c_{name}"), F.array())
    merged = merge(F.concat(carried, local))
    df = df.join(carry, by, "left").withColumn(name, merged)
    return df.drop(f"_w_{name}", f"_c_{name}")


@dataclass(frozen=True)
class Ordered:
    """Rows with keys and a total order, ready for running values.

    ``cold`` holds the ordinary keys, ``hot`` (maybe absent) the heavy ones, cut
    into blocks ``_blk``.
    """

    cold: DataFrame
    hot: DataFrame | None
    keys: tuple[str, ...]
    order: tuple[str, ...]
    reverse: bool

    def _each(self, plain, block) -> "Ordered":
        return replace(
            self, cold=plain(self.cold), hot=None if self.hot is None else block(self.hot)
        )

    def turned(self) -> "Ordered":
        """The same rows, read in the other direction."""
        return replace(self, reverse=not self.reverse)

    def with_columns(self, cols: dict[str, Column]) -> "Ordered":
        add = lambda df: df.withColumns(cols)
        return self._each(add, add)

    def running(self, outs: dict[str, Running]) -> "Ordered":
        """Add running values, all over one shuffle and one sort."""
        args = (list(self.keys), self.order, self.reverse, outs)
        return self._each(lambda df: _plain_running(df, *args), lambda df: _block_running(df, *args))

    def last_k(self, name: str, value: Column, k: int) -> "Ordered":
        """List of the last ``k`` non-null values before the current row, oldest first."""
        plain = lambda df, keys, order, v: _plain_last_k(
            df, keys, order, self.reverse, name, v, k)
        return self._lists(name, value, plain, lambda lists: _last(lists, k))

    def top_k(self, name: str, value: Column, k: int, largest: bool = True) -> "Ordered":
        """The ``k`` largest (smallest) non-null values before the current row, best first."""
        plain = lambda df, keys, order, v: _plain_top_k(
            df, keys, order, self.reverse, name, v, k, largest)
        return self._lists(name, value, plain, lambda values: _best(values, k, largest))

    def _lists(self, name, value, plain, merge) -> "Ordered":
        keys = list(self.keys)
        return self._each(
            lambda df: plain(df, keys, self.order, value),
            lambda df: _block_lists(df, keys, self.order, self.reverse, name, value, plain, merge),
        )

    def result(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot.drop("_blk"))


# -- cutting heavy keys into blocks -----------------------------------------


def _heavy_blocks(df: DataFrame, keys: list[str], block_rows: int):
    return (
        df.groupBy(*keys, "_blk")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_txt").alias("lo"), F.max("_txt").alias("hi"))
        .filter((F.col("n") > block_rows) & (F.col("lo") < F.col("hi")))
        .orderBy(F.desc("n"))
        .limit(MAX_HEAVY)
        .collect()
    )


def _cut(df: DataFrame, keys: list[str], order: list[str], block_rows: int) -> DataFrame:
    """Add ``_blk``: '' where a key is one block, else a prefix of the order text.

    A block above ``block_rows`` is cut at the first characters in which its rows
    differ, as often as it takes.
    """
    types = dict(df.dtypes)
    cut = df.withColumns({"_txt": order_text(df, order), "_blk": F.lit("")})
    probe = cut
    for _ in range(_MAX_CUTS):
        heavy = _heavy_blocks(probe, keys, block_rows)
        if not heavy:
            break
        rows = [
            (*[r[k] for k in keys], r["_blk"], len(commonprefix([r["lo"], r["hi"]])) + _STEP)
            for r in heavy
        ]
        schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "_blk string", "_len int"])
        table = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # at most MAX_HEAVY rows
        deeper = F.expr("substring(_txt, 1, _len)")
        cut = cut.join(table, [*keys, "_blk"], "left").withColumn(
            "_blk", F.when(F.col("_len").isNotNull(), deeper).otherwise(F.col("_blk"))
        )
        probe = cut.filter(F.col("_len").isNotNull()).drop("_len")
        cut = cut.drop("_len")
    return cut.drop("_txt")


def ordered(df: DataFrame, keys: list[str], order: list[str], heavy: HeavyKeys | None = None,
            reverse: bool = False, block: Column | None = None) -> Ordered:
    """Prepare running values over ``keys`` in ``order`` (a total order).

    ``heavy`` is the result of :func:`heavy_keys` on a base table of the same
    sessions (first key); without it the frame itself is probed.  ``block`` may
    name a block that the rows carry already ('' where a key has one block only,
    else text that sorts like ``order``); then nothing is probed.
    """
    key, rest = keys[0], (tuple(keys), tuple(order), reverse)
    if block is not None:
        marked = df.withColumn("_blk", block)
        cold = marked.filter(F.col("_blk") == "").drop("_blk")
        return Ordered(cold, marked.filter(F.col("_blk") != ""), *rest)
    if heavy is None:
        heavy = heavy_keys(df, key)
    if not heavy.keys:
        return Ordered(df, None, *rest)
    is_heavy = F.coalesce(F.col(key).isin(*heavy.keys), F.lit(False))
    hot = _cut(written(df.filter(is_heavy)), keys, order, heavy.block_rows)
    return Ordered(df.filter(~is_heavy), hot, *rest)
