"""Overlap-safe application of text edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT = "array<struct<start:int,length:int,new_text:string>>"


def accepted(edits: Column) -> Column:
    """Of (start, length, new_text) edits, those that a walk from the end of the text accepts: an edit is taken if it
    ends at or before the start of the last one taken. Later start first, on ties the longer one."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(
        ordered, F.struct(F.lit(2**31 - 1).alias("low"), F.array().cast(EDIT).alias("kept")),
        lambda s, e: F.when(e["start"] + e["length"] <= s["low"], F.struct(e["start"].alias("low"), F.concat(s["kept"], F.array(e)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )


def apply_edits(text: Column, kept: Column) -> Column:
    """The text after accepted edits, which come from its end to its start."""
    ordered = F.reverse(kept)
    end = lambda e: e["start"] + e["length"]
    before = F.concat(F.array(F.lit(0)), F.transform(ordered, end))
    pieces = F.transform(ordered, lambda e, i: F.concat(F.substring(text, F.element_at(before, i + 1) + 1, e["start"] - F.element_at(before, i + 1)), e["new_text"]))
    # each stretch between two edits is cut once; the whole text is not copied for each edit
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(before, -1) + 1, F.length(text)))


def fix(files: DataFrame, edits: DataFrame, key: str = "file", text: str = "content") -> DataFrame:
    """``files`` with their edits applied, and the numbers of edits applied and rejected. A file's edits come from its
    own findings, so they are one row."""
    own = edits.groupBy(key).agg(F.collect_list(F.struct(F.col("start").cast("int"), F.col("length").cast("int"), "new_text")).cast(EDIT).alias("edits"))
    joined = files.join(own, key, "left").withColumn("kept", accepted(F.coalesce("edits", F.array().cast(EDIT))))
    return joined.withColumns({text: apply_edits(F.col(text), F.col("kept")), "applied": F.size("kept"), "rejected": F.size(F.coalesce("edits", F.array().cast(EDIT))) - F.size("kept")}).drop("edits", "kept")
