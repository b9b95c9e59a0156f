"""Rule packs through SQL, ranks without one task a key, and properties as VARIANT."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import dynamic
from factloom.operators import relations
from factloom.plans import packs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


RULE = '''"""{about}"""
CATEGORY = "{category}"
def check(text):
    at = text.find("{word}")
    while at >= 0:
        yield at, "{message}"
        at = text.find("{word}", at + 1)
'''


@pytest.fixture
def folders(tmp_path):
    for folder, name, word, message in (("one", "a-rule", "a", "first"), ("one", "b-rule", "b", "b found"), ("two", "a-rule", "aa", "second"), ("two", "_helper", "", "")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.py").write_text(RULE.format(about=f"{name} of {folder}", category="quality", word=word, message=message))
    return tmp_path / "one", tmp_path / "two"


def test_a_later_folder_overrides_by_name(folders, tmp_path):
    both = packs.pack(*folders)
    assert {k: r.description for k, r in both.items()} == {"a-rule": "a-rule of two", "b-rule": "b-rule of one"}
    (tmp_path / "two" / "odd.py").write_text("CATEGORY = 'nothing'\ndef check(text): return []")
    with pytest.raises(ValueError, match=r"odd\.py: nothing is no category"):
        packs.pack(*folders)
    (tmp_path / "two" / "odd.py").write_text("CATEGORY = 'quality'")
    with pytest.raises(ValueError, match=r"odd\.py defines no check"):
        packs.pack(*folders)
    assert packs.pack(tmp_path / "none") == {}


def test_findings_in_sql(spark, folders):
    texts = spark.createDataFrame([(1, "xaab\nb"), (2, None), (3, ""), (4, "\n\n aaa")], "id int, text string")
    found = packs.checked(spark, packs.pack(*folders), texts, "text")
    assert found.columns == ["id", "rule", "line", "column", "message"]
    assert rows(found) == [(1, "a-rule", 1, 2, "second"), (1, "b-rule", 1, 4, "b found"), (1, "b-rule", 2, 1, "b found"), (4, "a-rule", 3, 2, "second"), (4, "a-rule", 3, 3, "second")]
    texts.createOrReplaceTempView("texts")
    one = spark.sql("SELECT id, f.* FROM texts, LATERAL findings(text, 'b-rule') f")
    assert one.columns == ["id", "line", "column", "message"]
    assert rows(one) == [(1, 1, 4, "b found"), (1, 2, 1, "b found")]
    with pytest.raises(Exception, match="no such rule: c-rule"):
        spark.sql("SELECT f.* FROM texts, LATERAL findings(text, 'c-rule') f")
    with pytest.raises(Exception, match="looks at texts, not at int"):
        spark.sql("SELECT f.* FROM texts, LATERAL findings(id) f")


def test_a_table_function_by_partition(spark):
    spark.udtf.register("counts", F.udtf(packs.grouped_counts(2)))
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "k string, v int").createOrReplaceTempView("keyed")
    got = spark.sql("SELECT * FROM counts(TABLE(keyed) PARTITION BY k)")
    assert got.columns == ["k", "n"]
    assert rows(got) == sorted([("a", 2), (None, 2)], key=repr)


def test_ranked(spark):
    rng = random.Random(3)
    given = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(given, "k string, i int, x double").repartition(5)
    want, seen = {}, {}
    for k, i, _ in sorted(given, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = relations.ranked(df, ["k"], ["i"])
        assert {r["i"]: r["rank"] for r in got.collect()} == want
        assert got.columns == ["k", "i", "x", "rank"]
        assert relations.ranked(df.limit(0), ["k"], ["i"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_properties(spark):
    texts = [(1, '{"k": 5, "s": "7", "deep": {"a": [1, 2]}}'), (2, '{"k": "x"}'), (3, "no json"), (4, None), (5, "[1, 2]"), (6, '{"k": null}'), (7, '{"k": 5000000000}')]
    df = spark.createDataFrame(texts, "id int, props string").select("id", dynamic.properties(F.col("props")).alias("v"))
    got = df.select("id", *[dynamic.typed(F.col("v"), p, t).alias(n) for n, p, t in (("k", "$.k", "int"), ("s", "$.s", "int"), ("a", "$.deep.a[1]", "int"))], F.col("v").isNull().alias("bad"))
    none = (None, None, None, False)
    assert rows(got) == [(1, 5, 7, 2, False), (2, *none), (3, None, None, None, True), (4, None, None, None, True), (5, *none), (6, *none), (7, *none)]
    assert rows(dynamic.shape(df.where("id <= 2"), "v")) == [("OBJECT<deep: OBJECT<a: ARRAY<BIGINT>>, k: VARIANT, s: STRING>",)]
    pairs = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"b": [1], "c": null}'), (None, '{"q": 1}'), ("[1]", "bad")], "d string, g string")
    merged = pairs.select(F.to_json(dynamic.merged_options(dynamic.properties(F.col("d")), dynamic.properties(F.col("g")))))
    assert rows(merged) == sorted([('{"a":1,"b":[1],"c":null}',), ('{"q":1}',), ("{}",)], key=repr)
