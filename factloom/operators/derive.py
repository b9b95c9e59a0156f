"""Derivations with "all" and "any" conditions on graphs with cycles, by counters of open premises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


class Parts:
    """A growing table as written parts, folded into one every few rounds, so that a round reads few of them."""

    def __init__(self, first: DataFrame, fold=None, most: int = 8):
        self.parts, self.fold, self.most = [first], fold or (lambda df: df), most

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            self.parts = [written(self.fold(self.all()), "folded")]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


def derived(nodes: DataFrame, premises: DataFrame, given: DataFrame) -> DataFrame:
    """(node) of all that holds: the least set with the ``given`` nodes in it, each node of ``nodes`` (node, every) whose
    premises hold: all of them if ``every``, one at least if not. ``premises`` are (node, needs) pairs; repeated ones
    count once.

    A node that needs all of none holds; one that needs any of none does not. What only holds because of itself does
    not. A premise counts once, in the round after it began to hold: rounds send what the new nodes touch, and a node
    of ``every`` holds when its counter of met premises reaches their number. Nulls are no nodes.
    """
    known = nodes.where("node IS NOT NULL")
    needs = written(premises.where("node IS NOT NULL AND needs IS NOT NULL").distinct().join(known, "node"), "premises")
    wanted = written(needs.where("every").groupBy("node").agg(F.count("*").alias("wanted")), "premise-counts")
    vacuous = known.where("every").join(wanted, "node", "left_anti").select("node")
    new = written(given.where("node IS NOT NULL").select("node").union(vacuous).distinct(), "derived")
    holds = Parts(new)
    met = Parts(wanted.select("node", F.lit(0).cast("long").alias("met")).limit(0), lambda df: df.groupBy("node").agg(F.sum("met").alias("met")))
    while not new.isEmpty():
        touched = needs.join(new.select(F.col("node").alias("needs")), "needs").groupBy("node", "every").agg(F.count("*").alias("met"))
        touched = written(touched.join(holds.all(), "node", "left_anti"), "touched")
        met.add(touched.where("every").select("node", "met"))
        so_far = met.all().join(touched.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("met").alias("met"))
        full = so_far.join(wanted, "node").where("met = wanted").select("node")
        new = written(touched.where("NOT every").select("node").union(full), "derived")
        holds.add(new)
    return holds.all()
