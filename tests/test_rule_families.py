"""Rules over syntax, types, calls and flows: each has a file of its own with lines to find and lines to leave."""

import pytest

from factloom.operators import edits, fixes
from factloom.operators.code_rules import CODE_RULES
from factloom.rule_queries import SCHEMAS, relations


FINDS = {
    "banned-syntax": [1, 2, 3, 4, 6, 7], "complexity": [3, 5, 6], "readability": [1, 3, 4, 5],
    "no-identical-binary-operands": [1], "no-collection-size-mischeck": [1, 2, 4], "jsx-no-useless-fragment": [1], "no-all-duplicated-branches": [1], "error-handling": [1, 4], "no-empty-function": [1], "no-multiline-comments": [1],
    "naming-convention": [1, 3], "correctness": [1, 2, 3, 4, 5, 7, 8, 11, 22, 30, 31, 33], "logic": [1, 3, 5, 10, 12], "no-deprecated-api": [1, 2, 3], "no-useless-code": [1, 2, 3, 5], "no-implicit-coercion": [1, 3, 4, 5, 7, 8], "safety": [1, 2, 3, 5, 6, 11, 13, 15, 17],
    "security": [1, 2, 3, 5, 8], "simplification": [1, 3, 4, 5, 7, 10, 11, 13, 17, 21], "syntax": [1, 3, 4, 5, 6, 7, 10, 13], "typescript": [1, 2, 4, 6, 7, 20, 22, 26, 27, 29, 32, 33], "react": [1, 3, 6, 11, 17], "rules-of-hooks": [1, 3, 4, 5, 6], "no-re-export": [1, 4, 5, 7], "no-duplicated-constants": [1], "no-local-constants": [1, 3, 7],
    "await-non-thenable": [1], "no-floating-promises": [1], "restrict-plus-operands": [1, 3, 4], "restrict-template-expr": [1], "no-base-to-string": [1, 3], "prefer-nullish-coalescing": [1], "unnecessary-type-assertion": [1],
    "prefer-satisfies-over-as": [1], "exhaustive-switch": [1], "any-propagation": [1], "cache-primitive-args": [2], "deprecated-usage": [1], "no-weak-crypto": [1], "no-implied-eval": [1], "no-client-data-fetch": [1, 3],
    "no-dynamic-sql": [1], "no-db-antipatterns": [1, 2], "missing-returning": [1], "cache-caller-count": [1], "effect-cleanup": [3], "input-validation": [1], "state-hooks-cluster": [2, 11, 15, 21], "performance": [1, 3, 5, 8, 11],
    "no-child-process": [1], "no-non-literal-fs-path": [1], "no-non-literal-regexp": [1], "no-non-literal-require": [1], "no-ssrf": [1], "no-unthrown-error": [1],
    "prefer-modern-api": [1, 2, 3, 4, 6], "prefer-optional-chain": [1, 3], "promise-all-opportunity": [3], "exhaustive-deps": [1], "narrow-param-type": [1, 4], "no-async-client-component": [1, 5], "no-misused-promises": [1, 4], "no-underscore-prefix": [1, 3, 5, 6],
    "no-redundant-zod-parse": [1], "unbranded-type-consistency": [1, 5, 7], "prefer-literal-union": [1, 4, 10], "zustand-patterns": [1, 2, 5, 9], "prop-drilling": [1], "no-db-origin-client-boundary": [1], "type-precision": [1, 2, 4, 10, 12, 14, 20, 23, 24, 27],
}

@pytest.fixture(scope="module")
def facts(spark):
    return {k: v.cache() for k, v in relations(spark, tuple(SCHEMAS)).items() if k != "refs"}


@pytest.mark.parametrize("rule", sorted(FINDS))
def test_family(facts, rule):
    out = CODE_RULES.only([rule]).diagnostics(facts).where(f"file = '{rule}.tsx'").collect()
    assert sorted({r["line"] for r in out}) == FINDS[rule]


def test_page_parameters(facts):
    out = CODE_RULES.only(["no-page-params-unsafe-parse"]).diagnostics(facts).collect()
    assert {(r["file"], r["line"]) for r in out} == {("app/page.tsx", 1)}


def test_clones(facts):
    of = lambda rule: sorted((r["file"], r["line"]) for r in CODE_RULES.only([rule]).diagnostics(facts).collect())
    assert of("syntactic-clone") == sorted([("a.ts", 1), ("b.ts", 2), ("c.ts", 3), ("d.ts", 4), ("i.ts", 8), ("app/z.ts", 12), ("app/y/r/t.ts", 13), ("r3.ts", 16), ("r4.ts", 17)])
    assert of("semantic-clone") == [("a.ts", 1), ("c.ts", 3), ("d.ts", 4)]


def test_every_rule_has_a_case():
    from tests.test_code_rules import WANT

    assert set(CODE_RULES.rules) == set(FINDS) | set(WANT) | {"syntactic-clone", "semantic-clone", "no-page-params-unsafe-parse"}


def test_only_rules_with_relations(facts):
    few = {k: facts[k] for k in ("blocks",)}
    assert {r["rule"] for r in CODE_RULES.diagnostics(few).collect()} == {"syntactic-clone", "semantic-clone"}
    with pytest.raises(ValueError):
        CODE_RULES.diagnostics({})


@pytest.mark.parametrize("rule", ["logic", "restrict-plus-operands", "no-child-process", "syntactic-clone", "rules-of-hooks", "exhaustive-switch"])
def test_empty_relations(facts, rule):
    assert CODE_RULES.only([rule]).diagnostics({k: v.limit(0) for k, v in facts.items()}).count() == 0


def test_fixes_correct_their_findings(spark):
    """Facts of a text, written by hand: what is proposed, applied, gives the corrected text."""
    text = "debugger; a == b; parseInt(x); +y; throw 'no'; void 0;"
    at = lambda part: (text.index(part), text.index(part) + len(part))
    nodes, kids = [], [0]

    def node(kind, part, parent=None, role="child", ord_=0, shown=None):
        kids[0] += 1
        start, end = at(part)
        nodes.append(("f.ts", kids[0], parent, kind, role, ord_, 0, start, end, 1, start, part if shown is None else shown, []))
        return kids[0]

    node("DebuggerStatement", "debugger;")
    both = node("BinaryExpression", "a == b")
    node("Identifier", "a ", both, "left"), node("EqualsEqualsToken", "==", both, "operator"), node("Identifier", "b;", both, "right")
    call = node("CallExpression", "parseInt(x)")
    node("Identifier", "parseInt", call, "expression"), node("Identifier", "x", call, "argument")
    plus = node("PrefixUnaryExpression", "+y")
    node("PlusToken", "+", plus, "operator"), node("Identifier", "y", plus, "expression")
    node("StringLiteral", "'no'", node("ThrowStatement", "throw 'no';"), "expression")
    node("NumericLiteral", "0", node("VoidExpression", "void 0"), "expression")
    facts = {k: relations(spark, (k,))[k].limit(0) for k in SCHEMAS if k not in ("refs", "nodes")} | {"nodes": spark.createDataFrame(nodes, SCHEMAS["nodes"])}
    rules = CODE_RULES.only(["no-debug-code", "no-implicit-coercion", "safety", "typescript", "banned-syntax"])
    table = spark.createDataFrame([("f.ts", text)], "file string, content string")
    out = edits.fix(table, fixes.proposed(rules, facts)).first()
    assert out["content"] == " a === b; parseInt(x, 10); Number(y); throw new Error('no'); undefined;" and out["rejected"] == 0
    assert fixes.proposed(CODE_RULES.only(["self-import"]), facts).count() == 0


def test_each_fix_names_a_rule():
    assert {f.rule for f in fixes.FIXES} <= set(CODE_RULES.rules)


def test_rules_without_their_relations_are_named():
    assert CODE_RULES.unable(["blocks"])["no-debug-code"] == ["nodes"] and "syntactic-clone" not in CODE_RULES.unable(["blocks"])
