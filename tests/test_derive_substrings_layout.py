"""Derivations, substring joins, layouts by kind and one-pass reports against brute force, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import derive, substrings
from factloom.plans import report
from factloom.sources import layout
from factloom.sources.scratch import scratch_path, settings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_derived(nodes, premises, given):
    held, every = set(given), dict(nodes)
    needs = {n: {q for m, q in premises if m == n and q is not None} for n in every}
    while True:
        new = {n for n in every if n not in held and (needs[n] <= held if every[n] else needs[n] & held)}
        if not new:
            return sorted((n,) for n in held)
        held |= new


@pytest.mark.parametrize("seed", range(4))
def test_derived(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, rng.random() < 0.5) for i in range(60)]
    premises = [(rng.randrange(60), rng.randrange(70)) for _ in range(110)] * 2 + [(5, None), (None, 5)]
    given = [61, 62, 65, rng.randrange(60)]
    got = derive.derived(
        spark.createDataFrame(nodes + [(None, True)], "node int, every boolean"), spark.createDataFrame(premises, "node int, needs int"), spark.createDataFrame([(g,) for g in [*given, None]], "node int"))
    assert rows(got) == sorted(brute_derived(nodes, premises, given), key=repr)


def test_what_holds_only_by_itself_does_not(spark):
    nodes = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (5, True)], "node int, every boolean")
    premises = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3)], "node int, needs int")
    assert rows(derive.derived(nodes, premises, nodes.select("node").limit(0))) == [(5,)]  # all of none
    assert len(rows(derive.derived(nodes, premises, spark.createDataFrame([(2,), (4,)], "node int")))) == 5


def test_a_chain_folds_its_parts(spark):
    n = 24
    nodes = spark.createDataFrame([(i, i % 2 == 0) for i in range(1, n)], "node int, every boolean")
    premises = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(i, 0) for i in range(2, n, 2)], "node int, needs int")
    got = derive.derived(nodes, premises, spark.createDataFrame([(0,)], "node int"))
    assert rows(got) == sorted(((i,) for i in range(n)), key=repr)
    assert len(got.inputFiles()) < 60


@pytest.mark.parametrize("most", [4_000_000, 100])
def test_containing(spark, most):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abé😀 ") for _ in range(k))
    texts = [(i, word(rng.randrange(60))) for i in range(80)] + [(200, None), (201, ""), (202, "aaaaaaaa"), (203, "x" * 5000 + "needle in" + "y" * 5000)]
    patterns = [(word(rng.randrange(1, 9)),) for _ in range(150)] + [("",), (None,), ("aaaa",), ("needle in",), ("a",), ("zzz",), ("a",)]
    t = spark.createDataFrame(texts, "id int, text string")
    p = spark.createDataFrame(patterns, "p string")
    got = substrings.containing(t, "id", "text", p, "p", block_chars=most)
    want = sorted({(i, q) for i, x in texts for (q,) in patterns if x is not None and q is not None and q in x}, key=repr)
    assert rows(got) == want
    some = substrings.containing(t, "id", "text", p.where("p <> ''"), "p", block_chars=most)
    plan = some._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
    assert rows(substrings.containing(t, "id", "text", p.limit(0), "p")) == []
    assert rows(substrings.containing(t.limit(0), "id", "text", p, "p")) == []


def test_kinds_that_no_rule_visits_are_not_read(spark):
    facts = spark.range(10_000).select(F.col("id"), F.concat(F.lit("k"), (F.col("id") % 10).cast("string")).alias("kind")).union(spark.createDataFrame([(-1, None)], "id long, kind string"))
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        laid = layout.laid_out(facts, "kind", scratch_path(spark, "layout"), rows_a_file=400)
    assert laid.count() == 10_001
    active = spark.createDataFrame([("r1", "k3", True), ("r2", "k7", False), ("r3", "k3", True), ("r4", None, True)], "rule string, visits string, active boolean")
    met = layout.visited(laid, "kind", active.where("active"), "visits")
    assert rows(met.groupBy("rule").count()) == [("r1", 1000), ("r3", 1000)]
    assert "dynamicpruning" in met._jdf.queryExecution().toString()
    met.collect()
    scans = [n for n in walk(met._jdf.queryExecution().executedPlan()) if "FileSourceScan" in n.getClass().getName()]
    assert [n.metrics().apply("numOutputRows").value() for n in scans] == [1000]
    assert len([f for f in laid.inputFiles() if "kind=k3" in f]) > 1  # a large kind is several files


def walk(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from walk(plan.executedPlan())
        return
    if hasattr(plan, "plan") and plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from walk(plan.plan())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from walk(children.apply(i))


def test_all_counts_in_one_pass(spark):
    given = [("r1", "a", "c1", "error"), ("r1", "b", "c1", "warning"), ("r2", "a", "c2", "error"), ("r2", None, "c2", "info")]
    found, counts = report.evaluated(spark.createDataFrame(given, "rule string, file string, category string, severity string"))
    assert counts == {"findings": 4, "errors": 2, "warnings": 1}
    every = report.all_counts(found)
    assert rows(every) == sorted([
        ("rule", "r1", 2, 1, 1), ("rule", "r2", 2, 1, 0), ("file", "a", 2, 2, 0), ("file", "b", 1, 0, 1), ("file", None, 1, 0, 0),
        ("category", "c1", 2, 1, 1), ("category", "c2", 2, 1, 0), ("all", None, 4, 2, 1)], key=repr)
    assert every._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    assert rows(report.all_counts(found.limit(0))) in ([], [("all", None, 0, 0, 0)])
