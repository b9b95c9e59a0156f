"""Fact operators on small tables: ties, empty tables, folds and fixpoints against plain models."""

import random

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import edits, graph, metrics, relations, similarity
from factloom.plans import report, rules
from factloom.sources import files
from factloom.streaming.watch import watch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def model_accept(found):
    kept, low = 0, 2**31
    for start, length in sorted(found, reverse=True):
        if start + length <= low:
            kept, low = kept + 1, start
    return kept


def test_edits_touching_and_overlapping(spark):
    df = spark.createDataFrame([("f", "hello world")], "file string, content string")
    change = spark.createDataFrame([("f", 0, 5, "HELLO"), ("f", 5, 1, "_"), ("f", 3, 4, "xx"), ("f", 6, 5, "")], "file string, start int, length int, new_text string")
    got = edits.fix(df, change).first()
    assert (got["content"], got["applied"], got["rejected"]) == ("HELLO_", 3, 1)
    assert edits.fix(df, change.limit(0)).first()["content"] == "hello world"
    rng = random.Random(1)
    cases = [[(rng.randrange(30), rng.randrange(6)) for _ in range(rng.randrange(12))] for _ in range(60)]
    table = spark.createDataFrame([(i, [(a, b, "") for a, b in c]) for i, c in enumerate(cases)], f"i int, e {edits.EDIT}")
    assert dict(rows(table.select("i", F.size(edits.accepted(F.col("e")))))) == {i: model_accept(c) for i, c in enumerate(cases)}


def test_components_of_cycles(spark):
    pairs = [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (8, 8), (7, 9)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert rows(graph.components_of_cycles(edges)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (8, 8)]
    assert rows(graph.components_of_cycles(edges.limit(0))) == []


def test_reachable_path_and_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["hops"], tuple(r["path"])) for r in graph.reachable(edges, roots).collect()} == {("a", 0, ("a",)), ("b", 1, ("a", "b")), ("c", 1, ("a", "c")), ("d", 2, ("a", "c", "d"))}
    stops = spark.createDataFrame([("c",)], "node string")
    assert {r["node"] for r in graph.reachable(edges, roots, stops).collect()} == {"a", "b"}


def test_severity_order(spark):
    table = spark.createDataFrame([("a", None), ("b", "warning"), ("c", None), ("d", None), ("e", None)], "rule string, meta_severity string")
    overrides = spark.createDataFrame([(0, "a", "off", None), (1, "b", "error", None), (2, "e", "warning", ["x/"])], "ord int, rule string, severity string, files array<string>")
    groups = spark.createDataFrame([(0, "g", "error", ["c", "d"]), (1, "h", "off", ["d"]), (2, "g", "warning", [])], "ord int, id string, severity string, rules array<string>")
    # d is in two groups: the one that was given last counts, and g was given again after h
    assert rows(rules.severities(table, overrides, groups)) == [("b", "error"), ("c", "warning"), ("d", "warning"), ("e", "error")]


def test_file_override_is_a_part_of_the_path(spark):
    found = spark.createDataFrame([("r", "src/x/a.ts"), ("r", "src/y.ts"), ("q", "src/x/a.ts")], "rule string, file string")
    overrides = spark.createDataFrame([(0, "r", "off", ["x/"]), (1, "q", "warning", ["x/"])], "ord int, rule string, severity string, files array<string>")
    assert rows(rules.without_disabled(found, overrides)) == [("q", "src/x/a.ts"), ("r", "src/y.ts")]
    by_index = rules.without_disabled(found, overrides, most_broadcast=0)
    assert rows(by_index) == [("q", "src/x/a.ts"), ("r", "src/y.ts")]
    assert "NestedLoop" not in by_index._jdf.queryExecution().toString()


def test_many_file_overrides_of_rules_and_parts(spark):
    found = spark.createDataFrame([("r", "p", "src/x/a.ts"), ("r", "q", "src/x/a.ts"), ("r", None, "src/x/a.ts"), ("s", "p", "src/y.ts"), ("r", "p", None)], "rule string, sub_check string, file string")
    overrides = spark.createDataFrame([(0, "r:p", "off", ["x/", "zz"]), (1, "s", "off", ["y.ts"]), (2, "r", "off", None)], "ord int, rule string, severity string, files array<string>")
    want = {("r", "q", "src/x/a.ts"), ("r", None, "src/x/a.ts"), ("r", "p", None)}
    for most in (1_000, 0):
        assert {tuple(r) for r in rules.without_disabled(found, overrides, most_broadcast=most).collect()} == want


def test_scores_without_files(spark):
    found = spark.createDataFrame([], "rule string, severity string, file string")
    table = spark.createDataFrame([("r", "quality", 2)], "rule string, category string, sub_checks int")
    assert rows(report.category_scores(found, table, 0)) == [("quality", 0, 100.0)]
    assert report.clean_score(found, 3).first()["pct"] == 100.0


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.sample(range(40), 12) for _ in range(6)]
    sets = [(i, sorted({str(x) for x in rng.choice(base)} ^ {str(rng.randrange(40)) for _ in range(rng.randrange(3))})) for i in range(60)] + [(60, []), (61, ["1"])]
    first = {}
    for k, s in sets:
        first.setdefault(tuple(s), k)
    want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.8}
    got = similarity.similar_sets(spark.createDataFrame(sets, "k long, s array<string>"), "k", "s", 0.8)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert similarity.similar_sets(spark.createDataFrame([], "k long, s array<string>"), "k", "s", 0.8).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a < b & 'c' \"d\"",), ("",)], "t string")
    assert [r[0] for r in df.select(tx.html_escape(F.col("t"))).collect()] == ["a &lt; b &amp; &#39;c&#39; &quot;d&quot;", ""]
    assert [r[0] for r in df.select(tx.text_hash(F.col("t"))).collect()][1] == "0"
    assert df.limit(1).select(tx.normalised_tokens(F.lit("let x = 1 + true + 'a' + null"))).first()[0] == ["$ID", "$ID", "$NUM", "$BOOL", "$STR", "$NULL"]
    assert df.limit(1).select(tx.word_bigrams(F.lit("A b a B c"))).first()[0] == ["a b", "b a", "b c"]
    assert df.limit(1).select(tx.word_bigrams(F.lit("one")), tx.member_jaccard(F.array(), F.array()), tx.set_jaccard(F.array(), F.array())).first()[:] == ([], 0.0, 1.0)


def test_ignore_patterns(spark):
    paths = ["a.ts", "dist/a.ts", "x/dist/b.ts", "keep.gen.ts", "lib/keep.gen.ts", "src/deep/z.ts", "src/z.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0] for r in df.where(files.ignored(F.col("p"), ["dist/", "*.gen.ts", "!keep.gen.ts", "# note", "src/**/z.ts"])).collect()}
    assert got == {"dist/a.ts", "x/dist/b.ts", "src/deep/z.ts", "src/z.ts"}


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("'use client'\nlet x = 1\n")
    (tmp_path / "src/b.d.ts").write_text("declare const y: number")
    (tmp_path / "src/c.md").write_text("text")
    (tmp_path / "src/d.ts").write_text("x" * 2000)
    got = rows(files.scan(spark, str(tmp_path), ["ts"], most_bytes=1000).select("file", "is_decl", F.coalesce("directive", F.lit(""))))
    assert got == [("src/a.ts", False, "use client"), ("src/b.d.ts", True, "")]


def test_siblings(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "stop"), ("u", 4, "b"), ("u", 5, "b"), ("v", 1, "stop")], "p string, i int, k string")
    assert rows(relations.repeated_next(df, ["p"], ["i"], F.col("k")).select("i")) == [(1,), (4,)]
    assert rows(relations.first_after(df, ["p"], ["i"], F.col("k") == "stop").select("p", "i")) == [("u", 4)]
    assert rows(relations.runs(df, ["p"], ["i"], F.col("k") != "stop").select("p", "start", "length")) == [("u", 1, 2), ("u", 4, 2)]
    assert rows(relations.later_duplicates(df, ["p", "k"], ["i"]).select("i")) == [(2,), (5,)]


def test_complexity_and_tags(spark):
    nodes = spark.createDataFrame([("f", "if", 0, 1, 9), ("f", "for", 1, 2, 5), ("f", "and", 2, 3, 3), ("f", "arrow", 0, 4, 4), ("g", "call", 0, 1, 1)], "owner string, kind string, depth int, line int, end_line int")
    assert rows(metrics.complexity(nodes, "owner", ["if", "for"], ["and"], ["arrow"])) == [("f", 4, 3, 2, 1, 2, 9), ("g", 1, 0, 0, 0, 0, 1)]
    tagged = metrics.tags(spark.createDataFrame([("the end",), ("other",), (None,)], "t string"), "t", {"word": "the", "tail": "end$"})
    assert rows(metrics.coverage(tagged)) == [("tail", 1, 100.0), ("word", 1, 100.0)]


def test_watch(spark, tmp_path):
    source = spark.createDataFrame([("a", "x\ny"), ("b", "x")], "file string, content string")
    source.write.parquet(f"{tmp_path}/in")
    q = watch(spark, f"{tmp_path}/in", "file string, content string", lambda b: b.where(rules.lines_over(F.col("content"), 1)).select("file"), f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True)
    assert q.awaitTermination(60)
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("file")) == [("a",)]


def test_entry_registers_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ignore_classes_escapes_and_folders(spark):
    df = spark.createDataFrame([(p,) for p in ["a1.ts", "ab.ts", "a/keep.ts", "out/keep.ts", "out/sub/keep.ts", "!x", "#y", "b c", "lib/out/keep.ts", "x^.ts", "deep/a2.ts"]], "p string")
    got = {r[0] for r in df.where(files.ignored(F.col("p"), ["a[0-9].ts", "out/", "!keep.ts", "\\!x", "\\#y", "b?c   ", "x[^a-z].ts"])).collect()}
    assert got == {"a1.ts", "deep/a2.ts", "out/keep.ts", "out/sub/keep.ts", "lib/out/keep.ts", "!x", "#y", "b c", "x^.ts"}
    assert {r[0] for r in df.where(files.ignored(F.col("p"), ["[!a]*.ts"])).collect()} == {"a/keep.ts", "out/keep.ts", "out/sub/keep.ts", "lib/out/keep.ts", "x^.ts"}


def test_spilled_report(spark, tmp_path):
    found = spark.range(10).selectExpr("'r' AS rule", "'error' AS severity", "string(id) AS file", "1 AS line", "1 AS column", "'<m>' AS message")
    assert report.spilled(found, f"{tmp_path}/a", 11).count() == 10 and not (tmp_path / "a").exists()
    assert report.spilled(found, f"{tmp_path}/b", 10) is None and spark.read.text(f"{tmp_path}/b").count() == 10
    assert "&lt;m&gt;" in report.as_html(found).first()[0]


def test_edits_keep_what_is_between(spark):
    df = spark.createDataFrame([("f", "héllo wörld and more")], "file string, content string")
    rows_ = [("f", 0, 5, "bye"), ("f", 6, 5, ""), ("f", 16, 4, "less"), ("f", 20, 0, "!")]
    out = edits.fix(df, spark.createDataFrame(rows_, "file string, start int, length int, new_text string")).first()
    assert (out["content"], out["applied"], out["rejected"]) == ("bye  and less!", 4, 0)
    none = edits.fix(df, spark.createDataFrame([], "file string, start int, length int, new_text string")).first()
    assert none["content"] == "héllo wörld and more"
