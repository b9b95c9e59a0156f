"""Completeness checks as joins, and analyses of siblings as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def uncovered(items: DataFrame, uses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that no use refers to (unused exports, missing dependencies, missing cases)."""
    return items.join(uses.select(*keys), list(keys), "left_anti")


def covered(items: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.join(allowed.select(*keys), list(keys), "left_semi")


def use_counts(items: DataFrame, uses: DataFrame, key: str, name: str = "uses") -> DataFrame:
    """Items with the number of uses, 0 if none; uses are counted before they meet the items."""
    return items.join(uses.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def references(exports: DataFrame, uses: DataFrame, dynamic: DataFrame) -> DataFrame:
    """(def_file, name, use_file): uses of a symbol in other files, and all exports of a dynamically imported file."""
    static = uses.join(exports, "symbol").where("use_file <> file").select(F.col("file").alias("def_file"), "name", "use_file")
    whole = dynamic.join(exports, "file").select(F.col("file").alias("def_file"), "name", "use_file")
    return static.union(whole).distinct()


def duplicates(rows: DataFrame, keys: Sequence[str], member: str, least: int = 2) -> DataFrame:
    """Groups of equal keys with ``least`` or more rows: size and first member."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(member).alias("first")).where(F.col("n") >= least)


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``, their place from 1 among those of their key (nulls are a key, and come first in an order).

    For few keys of very many rows: rows are dealt by ranges of key and order, written, numbered within each range, and
    moved on by what the key has in earlier ranges, which are a row for each key and range. A key of a third of all rows
    is sorted in many tasks.
    """
    dealt = rows.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    own = F.row_number().over(Window.partitionBy("range", *keys).orderBy(*order))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("range", *keys).agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    counts = counts.select(F.col("range").alias("__range"), *[F.col(k).alias(f"__{k}") for k in keys], "before")
    same = F.col("range") == F.col("__range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    numbered = dealt.withColumn("own", own).join(counts, same)
    return numbered.select(*rows.columns, (F.col("own") + F.col("before")).cast("int").alias("rank"))


def later_duplicates(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All but the first row of each key, with their rank."""
    return ranked(rows, keys, order).where("rank > 1")


def first_match(rows: DataFrame, known: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with the first of the known rows of the same key; the known ones are reduced before they meet."""
    return rows.join(known.groupBy(*keys).agg(F.min(order).alias("match")), list(keys))


def repeated_next(rows: DataFrame, parent: Sequence[str], order: Sequence[str], same: Column) -> DataFrame:
    """Rows whose next sibling has the same value: the first of two writes is dead."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return rows.withColumn("value", same).withColumn("next", F.lead("value").over(w)).where(F.col("value") == F.col("next"))


def first_after(rows: DataFrame, parent: Sequence[str], order: Sequence[str], terminator: Column) -> DataFrame:
    """The first sibling after a terminator, if any."""
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("after", F.coalesce(F.max(terminator.cast("int")).over(before), F.lit(0)) == 1).where("after")
    rank = F.row_number().over(Window.partitionBy(*parent).orderBy(*order))
    return seen.withColumn("rank", rank).where("rank = 1").drop("rank", "after")


def runs(rows: DataFrame, parent: Sequence[str], order: Sequence[str], inside: Column, least: int = 2) -> DataFrame:
    """Runs of adjacent siblings that fulfil a condition (gaps and islands): parent, start, length."""
    w = Window.partitionBy(*parent).orderBy(*order)
    marked = rows.withColumn("inside", inside).withColumn("island", F.sum((~F.col("inside")).cast("int")).over(w))
    return marked.where("inside").groupBy(*parent, "island").agg(F.min(order[-1]).alias("start"), F.count("*").alias("length")).where(F.col("length") >= least)


def thresholds(rows: DataFrame, key: str, metrics: dict[str, tuple[Column, float]]) -> DataFrame:
    """One finding for each metric over its threshold: key, metric, value, threshold."""
    found = F.array(*[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(float(most)).alias("threshold")) for name, (value, most) in metrics.items()])
    return rows.select(key, F.explode(found).alias("m")).select(key, "m.*").where("value > threshold")
