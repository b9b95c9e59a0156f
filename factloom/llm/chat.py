"""Chat formatting: every participant's view of a dialogue; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACED = "struct<own:boolean,start:bigint,end:bigint>"


def neutral(text: Column) -> Column:
    """Text in which nothing reads as a mark of the template."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def named(speaker: Column) -> Column:
    """A speaker's name as it stands in a header: neutral, on one line."""
    return F.regexp_replace(neutral(speaker), r"[\r\n]+", " ")


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system",
) -> DataFrame:
    """(conv, perspective, n_turns, n_targets, text, mask): the dialogue once for each participant.

    In the view of a speaker, the speaker's turns are the assistant's, system turns stay, and all others are
    turns of users named after their speakers. mask has the spans (code points of the text, end exclusive) on
    which to train: what the speaker says and the mark that ends it. Turns come by number, then speaker, then
    text; null numbers first. Null speakers are called ``unknown``, null texts are empty, repeated turns are said again,
    line breaks in names become spaces. A dialogue of system turns only has no participant and no row. Other columns are
    left out.

    Turns are dealt by range of (dialogue, number, speaker, text), so a dialogue of a third of all rows is rendered in many
    tasks, whatever its numbers; only the finished parts of a view, one for each range, meet in one row.
    """
    said = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # the last key deals equal turns to several ranges; which of them comes first makes no difference
    ranged = said.withColumn("any", F.monotonically_increasing_id()).repartitionByRange("conv", "turn", "speaker", "text", "any").withColumn("range", F.spark_partition_id())
    parts = ranged.groupBy("conv", "range").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    views = said.where(F.col("speaker") != system).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = parts.join(views, F.col("conv").eqNullSafe(F.col("c"))).drop("c")

    def rendered(t: Column) -> Column:
        own = t["speaker"] == F.col("perspective")
        who = F.when(own, F.lit("assistant")).when(t["speaker"] == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), named(t["speaker"])))
        return F.struct(own.alias("own"), F.concat(F.lit(OPEN), who, F.lit("\n")).alias("head"), F.concat(neutral(t["text"]), F.lit(CLOSE)).alias("body"))

    lines = F.transform("turns", rendered)
    sized = F.transform("lines", lambda x: F.struct(x["own"].alias("own"), F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body")))
    span = lambda s, r: F.struct(r["own"].alias("own"), (s + r["head"]).alias("start"), (s + r["head"] + r["body"]).alias("end"))
    spans = F.filter(running(F.col("sized"), F.lit(0).cast("long"), lambda s, r: s + r["head"] + r["body"] + 1, span, PLACED), lambda x: x["own"])
    part = seen.withColumn("lines", lines).withColumn("sized", sized).select(
        "conv", "perspective", F.struct(
            "range", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
            F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("mask")).alias("part"))
    whole = part.groupBy("conv", "perspective").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    # each part's spans move by the length of the parts before it
    moved = running(F.col("parts"), F.lit(0).cast("long"), lambda s, p: s + F.length(p["text"]), lambda s, p: F.transform(p["mask"], lambda m: F.struct((m["start"] + s).alias("start"), (m["end"] + s).alias("end"))), "array<struct<start:bigint,end:bigint>>")
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)
    return whole.select(
        F.col("conv").alias(conv_col), "perspective", add(F.transform("parts", lambda p: p["n"])).alias("n_turns"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.flatten(moved).alias("mask"),
    ).select(conv_col, "perspective", "n_turns", F.size("mask").cast("long").alias("n_targets"), "text", "mask")
