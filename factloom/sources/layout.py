"""Facts laid out by kind, so that a rule's query reads the kinds that it visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def laid_out(facts: DataFrame, kind: str, folder: str, rows_a_file: int = 5_000_000) -> DataFrame:
    """``facts`` as Parquet with a folder for each kind. A kind of very many rows is dealt out to several tasks and files,
    one for about ``rows_a_file``, by a hash of its rows; the sizes are counted first. A null kind is kept, in a folder of
    its own. Facts of many kinds need few files: all rows of a kind that is not large come to one task."""
    sizes = facts.groupBy(F.col(kind).alias("__kind")).agg(F.ceil(F.count(F.lit(1)) / rows_a_file).cast("int").alias("__files"))
    dealt = facts.join(sizes.where("__files > 1"), facts[kind].eqNullSafe(F.col("__kind")), "left")
    salt = F.pmod(F.xxhash64(*facts.columns), F.coalesce("__files", F.lit(1)))
    dealt.withColumn("__salt", salt).repartition(kind, "__salt").select(*facts.columns).write.partitionBy(kind).parquet(folder)
    order = [*[f for f in facts.schema if f.name != kind], *[f for f in facts.schema if f.name == kind]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order)
    return facts.sparkSession.read.schema(schema).parquet(folder).select(*facts.columns)


def visited(laid: DataFrame, kind: str, rules: DataFrame, visits: str) -> DataFrame:
    """Facts with the columns of each rule that visits their kind. The rules, one row each, are sent to the tasks, and
    which folders are read at all is known once they are: rules that are off read nothing."""
    # a comparison, since the planner prunes folders only by a side that it takes for selective
    wanted = rules.where(F.length(visits) > 0)
    return laid.join(F.broadcast(wanted), laid[kind] == wanted[visits])
