"""Code rules on tiny fact tables."""

import pytest

from factloom.operators.code_rules import CODE_RULES
from factloom.rule_queries import SCHEMAS, relations
from factloom.sources.facts import empty

FILES = ("src/a.tsx", "b.ts", "c.ts", "act.ts", "lone.ts", "e.ts", "m.ts", "o.ts", "app/p/q.ts", "schema/a.tsx", "schema/b.tsx")


@pytest.fixture(scope="module")
def facts(spark):
    return {k: v.cache() for k, v in relations(spark, tuple(SCHEMAS)).items()}


WANT = {
    "no-debug-code": {("src/a.tsx", 2)}, "banned-syntax": {("src/a.tsx", 10)}, "no-magic-numbers": {("src/a.tsx", 8)}, "no-underscore-prefix": {("src/a.tsx", 3)}, "no-local-constants": set(),
    "max-file-lines": {("src/a.tsx", 1)}, "no-unescaped-entities": {("src/a.tsx", 13)}, "readability": {("src/a.tsx", 12)}, "complexity": {("src/a.tsx", 3)},
    "self-import": {("e.ts", 3)}, "duplicate-import": {("src/a.tsx", 9)}, "no-import-cycle": {("b.ts", 1), ("c.ts", 4), ("e.ts", 3)}, "unused-export": {("b.ts", 1), ("schema/a.tsx", 1)}, "no-duplicate-schema-export": {("schema/a.tsx", 3), ("schema/b.tsx", 6)},
    "route-boundary": {("app/p/q.ts", 2)}, "no-client-server-only-import": {("src/a.tsx", 1)}, "unnecessary-use-server": {("lone.ts", 1)},
}


@pytest.mark.parametrize("rule", sorted(WANT))
def test_rule(facts, rule):
    assert {(r["file"], r["line"]) for r in CODE_RULES.only([rule]).diagnostics(facts).collect() if r["file"] in FILES} == WANT[rule]


def test_no_facts(spark, facts):
    none = {k: v.limit(0) for k, v in facts.items()}
    assert CODE_RULES.only(WANT).diagnostics(none).count() == 0
    assert empty(spark, "nodes").columns == facts["nodes"].columns


def test_unknown_rule():
    with pytest.raises(KeyError):
        CODE_RULES.only(["nothing"])
