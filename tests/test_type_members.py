"""What types have by their members: all of a union's, any of an intersection's."""

from factloom.operators import flow_rules as fr
from factloom.operators.code_rules import CODE_RULES
from factloom.sources.facts import SCHEMAS

STR, BARE, OWN, ANY = (1, fr.STRING, []), (2, fr.OBJECT, []), (3, fr.OBJECT, []), (4, fr.ANY, [])
TYPES = [
    STR, BARE, OWN, ANY, (10, fr.UNION, [1, 3]), (11, fr.UNION, [1, 2]), (12, fr.INTERSECTION, [2, 3]), (13, fr.INTERSECTION, [2, 1]), (14, fr.UNION, [10, 12]),
    (15, fr.UNION, [10, 11]), (16, fr.UNION, [16, 1]), (17, fr.INTERSECTION, [17, 1]), (18, fr.UNION, [13, 1]), (19, fr.INTERSECTION, [11, 2])]


def types(spark):
    return spark.createDataFrame([(i, flags, "", members, [], False, i == 3) for i, flags, members in TYPES], SCHEMAS["types"])


def test_by_members(spark):
    own = fr.has("flags", fr.PLAIN_TEXT) | (fr.F.col("type_id") == 3)
    assert {r["type_id"] for r in fr.by_members(types(spark), own).collect()} == {1, 3, 4, 10, 12, 13, 14, 17, 18}


def facts(spark, kind, field, parent_kind):
    """One node of each type, alone under a parent; its line is its type's number."""
    nodes, typed = [("a.ts", 0, None, "CallExpression", "statement", 0, 0, 0, 0, 0, 1, "cache", []), ("a.ts", 1, 0, "ArrowFunction", "argument", 0, 1, 0, 0, 0, 1, "", [{"id": 0, "kind": "CallExpression"}])], []
    for n, (i, _, _) in enumerate(TYPES):
        if parent_kind:
            nodes.append(("a.ts", 100 + i, 0, parent_kind, "statement", n, 1, 0, 0, i, 1, "x.toString", []))
        nodes.append(("a.ts", 200 + i, 100 + i if parent_kind else 1, kind, field, 0 if parent_kind else n, 2, 0, 0, i, 1, "x", []))
        typed.append(("a.ts", 200 + i, i))
    calls = [("a.ts", 0, None, None, "cache", ["cache"])]
    return {
        "nodes": spark.createDataFrame(nodes, SCHEMAS["nodes"]), "types": types(spark), "node_types": spark.createDataFrame(typed, SCHEMAS["node_types"]),
        "calls": spark.createDataFrame(calls, SCHEMAS["calls"])}


def lines(spark, rule, *shape):
    return {r["line"] for r in CODE_RULES.only([rule]).diagnostics(facts(spark, *shape)).collect()}


def test_no_base_to_string(spark):
    assert lines(spark, "no-base-to-string", "Identifier", "expression", "PropertyAccessExpression") >= {2, 11}
    assert not lines(spark, "no-base-to-string", "Identifier", "expression", "PropertyAccessExpression") & {1, 3, 4, 10, 12, 13}


def test_cache_primitive_args(spark):
    assert lines(spark, "cache-primitive-args", "Parameter", "parameter", None) == {2, 3, 10, 11, 12, 14, 15, 16, 19}
