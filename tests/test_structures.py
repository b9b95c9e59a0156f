"""Rules that compare code by structure, over nodes of a few lines."""

import pytest

from factloom.operators.code_rules import CODE_RULES
from factloom.operators.syntax_rules import structures
from factloom.sources.facts import SCHEMAS


class Nodes:
    """Builds the nodes relation: each node is (kind, text, field, children)."""

    def __init__(self, spark):
        self.spark, self.rows = spark, []

    def add(self, node, line=1, parent=None, above=(), ord=0):
        kind, text, field, children = node
        me = len(self.rows)
        self.rows.append(("a.ts", me, parent, kind, field, ord, len(above), 0, 0, line, 1, text, [{"id": i, "kind": k} for i, k in above]))
        roles = [c[2] for c in children]
        for n, child in enumerate(children):  # ord is the place among those of the role
            self.add(child, line, me, (*above, (me, kind)), roles[:n].count(roles[n]))
        return me

    def table(self):
        return self.spark.createDataFrame(self.rows, SCHEMAS["nodes"])


def call(text, *arguments, field="statement"):
    return ("CallExpression", text, field, [("Identifier", "f", "expression", []), *[(k, t, "argument", []) for k, t in arguments]])


def branch(field, text, *statements):
    return ("Block", text, field, list(statements))


@pytest.mark.parametrize(("first", "second", "same"), [
    (("{ f(1) }", [call("f(1)", ("NumericLiteral", "1"))]), ("{ f( 1 ) // a note\n}", [call("f( 1 )", ("NumericLiteral", "1"))]), True),
    (("{ f('a  b') }", [call("f('a  b')", ("StringLiteral", "a  b"))]), ("{ f('a b') }", [call("f('a b')", ("StringLiteral", "a b"))]), False),
    (("{ f(1, 2) }", [call("f(1, 2)", ("NumericLiteral", "1"), ("NumericLiteral", "2"))]), ("{ f(2, 1) }", [call("f(2, 1)", ("NumericLiteral", "2"), ("NumericLiteral", "1"))]), False),
    (("{ f(1) }", [call("f(1)", ("NumericLiteral", "1"))]), ("{ f(1) }", [call("f(1)", ("StringLiteral", "1"))]), False),
    (("f()", []), (" f() \n", []), True),
    (("{}", [call("f()")]), ("{}", [call("f()"), call("f()")]), False),
])
def test_branches(spark, first, second, same):
    nodes = Nodes(spark)
    nodes.add(("IfStatement", "if", "statement", [branch("branch", first[0], *first[1]), branch("else", second[0], *second[1])]))
    found = CODE_RULES.only(["no-all-duplicated-branches"]).diagnostics({"nodes": nodes.table()}).collect()
    assert len(found) == same


def test_operands(spark):
    nodes = Nodes(spark)
    dot = lambda field, text, *names: ("PropertyAccessExpression", text, field, [("Identifier", n, f"part{i}", []) for i, n in enumerate(names)])
    both = lambda left, right: ("BinaryExpression", "", "statement", [left, ("MinusToken", "-", "operator", []), right])
    nodes.add(both(dot("left", "a.b", "a", "b"), dot("right", "a /* x */ .b", "a", "b")), 1)
    nodes.add(both(dot("left", "a.b", "a", "b"), dot("right", "a.b", "a", "c")), 2)
    nodes.add(both(("StringLiteral", "x  y", "left", []), ("StringLiteral", "x y", "right", [])), 3)
    nodes.add(both(("Identifier", "x", "left", []), ("Identifier", "x", "right", [])), 4)
    found = CODE_RULES.only(["no-identical-binary-operands"]).diagnostics({"nodes": nodes.table()}).collect()
    assert sorted(r["line"] for r in found) == [1, 4]


def test_structures_of_nested_roots(spark):
    """A root inside another, and a deep one: each has the structure of its own subtree."""
    nodes = Nodes(spark)
    deep = ("Identifier", "x", "expression", [])
    for _ in range(12):
        deep = ("ParenthesizedExpression", "", "expression", [deep])
    a, b = nodes.add(deep), nodes.add(deep)
    table = nodes.table()
    roots = spark.createDataFrame([("a.ts", a), ("a.ts", b), ("a.ts", a + 1), ("a.ts", b + 1), ("a.ts", a + 2)], "file string, node_id long")
    of = {r["node_id"]: r["structure"] for r in structures(table, roots).collect()}
    assert of[a] == of[b] != of[a + 1] == of[b + 1] != of[a + 2]
    assert structures(table, roots.limit(0)).count() == 0
