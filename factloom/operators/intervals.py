"""Joins by containment in an interval, and the next match of a key, without one task for a large key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _spread(df: DataFrame, hot: DataFrame, on: list[str], salt: Column) -> DataFrame:
    """``df`` with ``salt``, which may use ``salts``: into how many a hot bin is split (1 elsewhere)."""
    return df.join(hot, on, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", salt).drop("salts")


def contained(
    points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, hot_rows: int = 100_000,
) -> DataFrame:
    """The columns of ``points`` and ``intervals`` (named apart but for ``keys``) of each pair of one key with
    start < at < stop. ``at``, ``start`` and ``stop`` are whole numbers (nodes' places, microseconds).

    An interval lies in bins of the smallest power of four that is at least its length: in one of them, or in two if it
    crosses an edge. Powers of two would meet fewer points in vain, but shuffle each point twice as often. A point lies in one bin of each width that occurs. So pairs meet by equality of key, width and bin,
    and a key of many rows is many bins. Bins of more than ``hot_rows`` points are counted first and split: points by a
    hash, their intervals copied to each part. Empty and turned intervals, and nulls, contain nothing.

    The joins are merges by hint: Spark's estimate leaves out that a point stands once for each width, and points that it
    takes for small enough to broadcast would fill the driver.
    """
    bits = F.length(F.bin(F.col(stop) - F.col(start) - 1))  # exact where a logarithm would round
    width = F.least(bits + bits % 2, F.lit(63))
    sized = intervals.where(F.col(start) < F.col(stop)).withColumn("width", width)
    shifted = lambda c: F.expr(f"shiftright(`{c}`, width)")
    first, last = shifted(start), shifted(stop)
    binned = sized.withColumn("bin", F.explode(F.array_distinct(F.array(first, last))))
    widths = sorted(r["width"] for r in sized.select("width").distinct().collect())  # at most 32
    on = [*keys, "width", "bin"]
    placed = points.where(F.col(at).isNotNull()).withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>")))
    placed = placed.withColumn("bin", shifted(at)).hint("merge")
    met = binned.select(*on).distinct()
    crowded = placed.join(met, on, "left_semi").groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = written(crowded.select(*on, F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")), "hot-bins")
    if not hot.isEmpty():
        placed = _spread(placed, hot, on, F.pmod(F.xxhash64(*points.columns), F.col("salts")).cast("int"))
        binned = _spread(binned, hot, on, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        on = [*on, "salt"]
    pairs = placed.hint("merge").join(binned, on).where((F.col(start) < F.col(at)) & (F.col(at) < F.col(stop)))
    return pairs.drop(*[c for c in on if c not in keys])


def next_match(rows: DataFrame, keys: list[str], at: str, match: Column, width: int) -> DataFrame:
    """``rows`` with ``next_at``: the least ``at`` of a matching row of the key that is greater than the row's own.

    Rows are looked at in bins of ``width``: inside a bin in order, and beyond it by one row for each key and bin with the
    bin's first match. So a key of a third of all rows is as many groups as it has bins.
    """
    binned = rows.withColumn("bin", F.floor(F.col(at) / width).cast("long")).withColumn("hit", F.when(match, F.col(at)))
    later = Window.partitionBy(*keys, "bin").orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    inside = binned.withColumn("inside", F.min("hit").over(later))
    firsts = binned.groupBy(*keys, "bin").agg(F.min("hit").alias("first"))
    after = Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    beyond = firsts.select(*keys, "bin", F.min("first").over(after).alias("beyond"))
    return inside.join(beyond.hint("merge"), [*keys, "bin"]).withColumn("next_at", F.coalesce("inside", "beyond")).drop("bin", "hit", "inside", "beyond")
