"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BLANK = " \t\n\x0b\x0c\r"
#: Hash of a document: 60 bits, as the first 15 hex digits of md5; levels read 12 bits each.
BITS, STEP = 60, 12
KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but ASCII blanks; null: 0."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANK))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def hash60(id_: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int, most_sources: int = 100_000) -> DataFrame:
    """(source, source_size) with target added: shares of the whole by weight, at most ``most`` times the source.

    Sources in code-point order, null last, take the weights in turn. What capped sources leave is shared by
    weight among the others, again until none is above its cap. Up to ``most_sources`` the driver does it; more stay a table.
    """
    rows = sources.limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        return _targets_as_table(sources, weights, most)
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["source_size"]) for r in rows]
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = sum(weight[i] for i in range(len(rows)) if i not in capped)
        over = {i for i in range(len(rows)) if i not in capped and weight[i] * left > most * sizes[i] * free}
        if not over:
            break
        capped |= over
    out = [(r["source"], s, float(most * s) if i in capped else (w * left / free if free else 0.0)) for i, (r, s, w) in enumerate(zip(rows, sizes, weight, strict=True))]
    return _few_rows(sources.sparkSession, out, "source string, source_size long, target double")


def _few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The driver's rows as a local table: by Arrow, since from plain rows Spark makes one in Python workers of a kind of their own."""
    fields = [x.split() for x in schema.split(", ")]
    columns = [pa.array([r[k] for r in rows], KINDS[kind]) for k, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))


def _targets_as_table(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``targets`` for any number of sources: ranked by range, with one sum over the table for each round of caps.

    The share of a unit of weight, left / free, only grows from round to round, so the sources over their cap are always
    those that the latest share takes over it."""
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt, "mix-sources")
    part = F.shiftright("at", 33)
    sizes = sorted(dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before = {p: sum(n for q, n in sizes if q < p) for p, _ in sizes}
    first = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])[part]
    rank = first + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = dealt.select("source", F.col("source_size").cast("decimal(20,0)").alias("size"), F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int")).cast("decimal(10,0)").alias("weight"))
    ranked = written(ranked, "mix-ranked")
    total, left = (int(ranked.agg(F.sum("size")).first()[0]),) * 2
    all_free = free = int(ranked.agg(F.sum("weight")).first()[0])
    capped = 0
    while True:
        over = F.col("weight") * F.lit(left).cast("decimal(20,0)") > F.col("size") * most * F.lit(free).cast("decimal(15,0)")
        n, size, weight = ranked.where(over).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped:
            break
        capped, left, free = n, total - most * int(size), all_free - int(weight)
    share = F.col("weight").cast("double") * F.lit(left) / F.lit(float(free)) if free else F.lit(0.0)
    return ranked.select("source", F.col("size").cast("long").alias("source_size"), F.when(over, most * F.col("size").cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, keep: tuple[str, ...] = (), most_sources: int = 100_000,
) -> DataFrame:
    """One row a document: id, source, size (words), source_size, target, copies, taken = copies * size.

    Each document gets floor(target / source_size) copies, and one more if its hash is under the source's
    threshold. The threshold comes from histograms: sizes summed by source and the top bits of the hash show
    the bucket in which the budget ends; only that bucket's documents are summed again by the next bits, level
    by level, down to one hash. Nothing is sorted; a level sends at most 4096 sums a source and task. The
    document at the boundary is taken if the mix comes nearer to its target with it (on a tie, not).
    Rows with equal ids share a hash and are taken or left together. A null source is a source, the last; a
    null text has size 0; sources of size 0 have target 0. Reruns agree: the hash depends on the id alone.
    ``keep`` names columns to give besides; then the table is read once more, else texts are read once. Columns named
    as the added ones can't be kept.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash"), *keep)
    rows = written(sized.select("id", "source", "size", "hash"), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = sources.limit(most_sources + 1).count() <= most_sources
    plan = targets(sources, weights, most, most_sources)
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    plan = plan.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    # threshold: every hash below is taken; taken: the words below
    state = plan.select("source", "budget", F.lit(0).cast("long").alias("threshold"), F.lit(0).cast("long").alias("below"))
    for shift in range(BITS - STEP, -1, -STEP):
        state = _refine(rows, state, shift, few)
    edge = rows.join(_small(state, few), (F.col("hash") == F.col("threshold")) & rows.source.eqNullSafe(state.source)).groupBy(state.source.alias("s")).agg(F.sum("size").alias("edge"))
    final = state.join(edge, state.source.eqNullSafe(edge.s), "left").select(
        "source", (F.col("threshold") + F.when(F.col("below") + F.col("edge") - F.col("budget") < F.col("budget") - F.col("below"), 1).otherwise(0)).alias("threshold"))
    final = plan.join(final.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "budget").withColumnRenamed("source", "s")
    copies = (F.col("copies") + (F.col("hash") < F.col("threshold")).cast("int")).cast("int")
    return (sized if keep else rows).join(_small(final, few), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), *keep, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _small(plan: DataFrame, few: bool) -> DataFrame:
    """One row a source; for a broadcast if they were counted to be few: at most 100,000 rows of five numbers."""
    return F.broadcast(plan) if few else plan


def _refine(rows: DataFrame, state: DataFrame, shift: int, few: bool) -> DataFrame:
    """Moves each source's threshold to the bucket, 2**shift wide, in which its budget ends."""
    inside = (F.shiftright("hash", shift + STEP) == F.shiftright("threshold", shift + STEP)) if shift + STEP < BITS else F.lit(True)
    told = state.withColumnRenamed("source", "s")
    sums = rows.join(_small(told, few), F.col("source").eqNullSafe(F.col("s")) & inside).groupBy("s", "budget", "below", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most 4096 rows a source
    found = sums.withColumn("upto", F.col("below") + running)
    # the first bucket that goes over the budget; if none does, beyond the last
    cut = found.groupBy("s").agg(
        F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("below")))).alias("cut"),
        F.max("bucket").alias("last"), F.max("upto").alias("all"),
    )
    out = told.join(cut.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left")
    spark = rows.sparkSession
    done = out.select(
        F.col("s").alias("source"), "budget",
        F.coalesce(F.shiftleft(F.col("cut.bucket"), shift), F.shiftleft(F.col("last") + 1, shift), F.col("threshold")).alias("threshold"),
        F.coalesce(F.col("cut.below"), F.col("all"), F.col("below")).alias("below"),
    )
    if not few:
        return written(done, "mix-thresholds")
    return _few_rows(spark, done.collect(), "source string, budget double, threshold long, below long")  # one row a source
