"""Complexity of functions from syntax nodes, and tags and calls of functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complexity(nodes: DataFrame, owner: str, branches: Sequence[str], logical: Sequence[str], nested: Sequence[str], kind: str = "kind", depth: str = "depth", first: str = "line", last: str = "end_line") -> DataFrame:
    """Of each owner: cyclomatic (1 + branches + logical operators), cognitive (depth + 1 of each branch), max_nesting,
    helpers (nested functions), branches and lines. One grouped aggregate, added up before the shuffle."""
    is_branch = F.col(kind).isin(*branches)
    return nodes.groupBy(owner).agg(
        (1 + F.count_if(is_branch) + F.count_if(F.col(kind).isin(*logical))).alias("cyclomatic"),
        F.coalesce(F.sum(F.when(is_branch, F.col(depth) + 1)), F.lit(0)).alias("cognitive"),
        F.coalesce(F.max(F.when(is_branch, F.col(depth) + 1)), F.lit(0)).alias("max_nesting"),
        F.count_if(F.col(kind).isin(*nested)).alias("helpers"), F.count_if(is_branch).alias("branches"), (F.max(last) - F.min(first) + 1).alias("lines"),
    )


def tags(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``rows`` with tags: names whose pattern the text matches; an exact word unless it begins ^ or ends $."""
    found = [F.when(F.col(text).rlike(p if p.startswith("^") or p.endswith("$") else rf"\b{p}\b"), F.lit(name)) for name, p in patterns.items()]
    return rows.withColumn("tags", F.array_compact(F.array(*found)))


def coverage(tagged: DataFrame) -> DataFrame:
    """Share of the tagged rows that has each tag."""
    some = tagged.where(F.size("tags") > 0)
    own = some.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return own.join(F.broadcast(some.agg(F.count("*").alias("whole")))).select("tag", "n", F.round(100.0 * F.col("n") / F.col("whole"), 1).alias("pct"))  # one row
