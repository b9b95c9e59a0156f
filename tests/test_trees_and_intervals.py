"""Subtree hashes and interval joins against brute force, and their plans."""

import random
import re

from pyspark.sql import functions as F

from factloom import queries
from factloom.operators import intervals, trees


def brute_tree(html):
    """(node, depth, parent, label, name) of elements and texts."""
    depth, out, opened = 0, [], {}
    for i, token in enumerate(re.findall(r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<", html or "")):
        flat = re.sub(r"[\x20\x09-\x0D]+", " ", token).strip(" ")
        name = re.match(r"</?([A-Za-z][^\s/>]*)", token)
        if not token.startswith("<") or token == "<":
            if flat:
                out.append((i, depth, opened.get(depth - 1), flat, None))
        elif name and token.startswith("</"):
            depth -= 1
        elif name:
            out.append((i, depth, opened.get(depth - 1), flat, name[1].lower()))
            if name[1].lower() not in trees.VOID and not token.endswith("/>"):
                opened[depth] = i
                depth += 1
    return out


def brute_classes(pages, least):
    found = {}
    for page, html in pages:
        nodes = brute_tree(html)
        for i, depth, _, _, name in nodes:
            inside = [(i, 0)]
            below = {i}
            for j, d, parent, _, _ in nodes:
                if parent in below:
                    below.add(j)
                    inside.append((j, d - depth))
            labels = {j: (label, k) for j, _, _, label, k in nodes}
            if name:
                found.setdefault(tuple((d, *labels[j]) for j, d in sorted(inside)), []).append((page, i))
    return sorted(
        (whole[0][2], len(whole), len({p for p, _ in at}), len(at), *min(at)) for whole, at in found.items() if len({p for p, _ in at}) >= least)


def test_equal_subtrees(spark):
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<b class='x'>", "</b>", "<br>", "<img src=a />", "one", "two  words\n", " ", "<!-- note <p> -->", "<DIV>", "</div>", "<", "</>", "<!doctype html>", "é"]
    pages = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(40)] + [(90, None), (91, ""), (92, "<p>a<b>c</b></p>"), (93, "x<p>a<b>c</b></p>"), (94, "<p>a <b>c</b></p><!-- c --><p> a<b> c </b></p>")]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(3)
    got = sorted(tuple(r) for r in trees.equal_subtrees(df, "page_id", "html", 2).collect())
    assert got == brute_classes(pages, 2)
    assert ("p", 4, 3, 4, 92, 0) in got  # blanks and comments make no difference, structure does
    assert trees.equal_subtrees(df.limit(0), "page_id", "html").collect() == []


def test_nodes_of_very_many_children_and_levels(spark):
    wide, deep = "<ul>" + "<li>x</li>" * 3000 + "</ul>", "<i>" * 40 + "x" + "</i>" * 40
    df = spark.createDataFrame([(1, wide), (2, wide), (3, deep), (4, deep), (5, deep)], "page_id long, html string")
    got = {(r["tag"], r["size"]): (r["pages"], r["occurrences"]) for r in trees.equal_subtrees(df, "page_id", "html", 2).collect()}
    assert got[("ul", 6001)] == (2, 2)
    assert got[("li", 2)] == (2, 6000)
    assert got[("i", 41)] == (3, 3)
    assert len(got) == 42


def test_order_of_children_counts(spark):
    df = spark.createDataFrame([(1, "<p><a></a><b></b></p>"), (2, "<p><b></b><a></a></p>"), (3, "<p><a><b></b></a></p>")], "page_id long, html string")
    assert {r["tag"] for r in trees.equal_subtrees(df, "page_id", "html", 2).collect()} == {"a", "b"}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_contained(spark):
    rng = random.Random(4)
    points = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(-500, 500)) for i in range(400)] + [(1, 900, None)]
    spans = [(rng.choice([1, 1, 2, None]), i, a, a + rng.choice([0, 1, 2, 3, 7, 64, 65, 300, -5])) for i in range(150) for a in [rng.randrange(-500, 500)]] + [(1, 800, None, 5), (1, 801, 5, None), (1, 802, -(1 << 40), 1 << 40)]
    p = spark.createDataFrame(points, "k int, id int, at long")
    s = spark.createDataFrame(spans, "k int, span int, a long, b long")
    want = sorted((k, i, at, j, a, b) for k, i, at in points for q, j, a, b in spans if k is not None and k == q and None not in (at, a, b) and a < at < b)
    for hot in (100_000, 10):
        got = intervals.contained(p, s, ["k"], "at", "a", "b", hot_rows=hot)
        assert sorted(tuple(r[c] for c in ("k", "id", "at", "span", "a", "b")) for r in got.collect()) == want
        assert "NestedLoop" not in plan_of(got)
        assert "Cartesian" not in plan_of(got)
    assert intervals.contained(p, s.limit(0), ["k"], "at", "a", "b").count() == 0
    assert intervals.contained(p.limit(0), s, ["k"], "at", "a", "b").count() == 0


def test_one_key_of_many_rows_is_many_groups(spark):
    """All points of one key, many in one bin: no task meets more than its share."""
    p = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") % 20_000).alias("at"))
    s = spark.range(2_000).select(F.lit(1).alias("k"), F.col("id").alias("span"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 8).alias("b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = intervals.contained(p, s.hint("shuffle_hash"), ["k"], "at", "a", "b").select(F.spark_partition_id().alias("task"))
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 2 * 7 * 2_000
    assert len(sizes) == 4
    assert max(sizes) < 0.5 * sum(sizes)


def test_next_match(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2]), i, rng.randrange(300), rng.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, id int, at long, hit boolean")
    want = {i: min((a for q, _, a, h in rows if q == k and h and a > at), default=None) for k, i, at, _ in rows}
    for width in (1, 10, 1000):
        assert {r["id"]: r["next_at"] for r in intervals.next_match(df, ["k"], "at", F.col("hit"), width).collect()} == want


def test_points_of_every_width_are_not_broadcast(spark, tmp_path):
    """Small files, so Spark would take the points for small, though each stands there once a width."""
    spark.range(2_000).selectExpr("id % 5 AS k", "id", "id AS at").write.parquet(f"{tmp_path}/points")
    spark.range(500).selectExpr("id % 5 AS k", "id AS span", "id * 4 AS a", "id * 4 + 2 + (1L << (id % 20)) AS b").write.parquet(f"{tmp_path}/spans")
    got = intervals.contained(spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/spans"), ["k"], "at", "a", "b")
    assert got.count() > 500
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_intervals_of_nearly_all_longs(spark):
    points = [(1, -(1 << 61)), (1, -1), (1, 0), (1, 1 << 61), (1, (1 << 62) - 1)]
    spans = [(1, -(1 << 61) - 1, 1 << 61), (1, -(1 << 62), (1 << 62) - 1), (1, 0, (1 << 62))]
    p, s = spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(spans, "k int, a long, b long")
    got = intervals.contained(p, s, ["k"], "at", "a", "b")
    assert sorted((r["at"], r["a"], r["b"]) for r in got.collect()) == sorted((at, a, b) for _, at in points for _, a, b in spans if a < at < b)


def test_orders_by_width_are_not_broadcast(spark):
    got = queries.orders_in_ship_windows(spark, "/root/testdata/sf0.001")
    assert got.count() > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [o_custkey" in plan
    assert "BroadcastHashJoin [o_custkey" not in plan
