"""Edits that correct findings, as data: which node of a finding is replaced, deleted or added to, and by what text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Facts, Registry
from .syntax_rules import with_children

EDITS = "file string, rule string, line int, start int, length int, new_text string"


@dataclass(frozen=True)
class Fix:
    """For findings of a rule with a message ("": any). ``role`` names the child that is touched ("": the node itself); the
    text may hold the texts of children, as {role}. ``only``: (role, kind) of a child that the node must have."""

    rule: str
    message: str
    how: str  # replace, after, delete
    role: str = ""
    text: str = ""
    only: tuple[str, str] | None = None

    @property
    def roles(self) -> set[str]:
        return {r for r in (self.role, *re.findall(r"\{(\w+)\}", self.text), *(self.only or ())[:1]) if r}


FIXES = (
    Fix("await-non-thenable", "", "replace", "", "{expression}"), Fix("banned-syntax", "void operator", "replace", "", "undefined", ("expression", "NumericLiteral")),
    Fix("correctness", "assigned to itself", "delete"), Fix("correctness", "never reached", "delete"), Fix("missing-returning", "", "after", "", ".returning()"), Fix("no-debug-code", "", "delete"),
    Fix("no-implicit-coercion", "loose equality", "replace", "operator", "===", ("operator", "EqualsEqualsToken")), Fix("no-implicit-coercion", "loose equality", "replace", "operator", "!==", ("operator", "ExclamationEqualsToken")),
    Fix("no-implicit-coercion", "number by +", "replace", "", "Number({expression})"), Fix("no-useless-code", "literals joined", "replace", "", '"{left}{right}"'), Fix("no-useless-code", "name said twice", "replace", "", "{name}"),
    Fix("prefer-nullish-coalescing", "", "replace", "operator", "??"), Fix("prefer-satisfies-over-as", "", "replace", "", "{expression} satisfies {type}", ("type", "TypeReference")), Fix("readability", "use as const", "replace", "type", "const"),
    Fix("restrict-template-expr", "", "replace", "expression", "String({expression})"), Fix("safety", "parseInt without a radix", "after", "argument", ", 10"), Fix("simplification", "continue at the end", "delete"),
    Fix("simplification", "empty return at the end", "delete"), Fix("simplification", "constructor that adds nothing", "delete"), Fix("typescript", "a string thrown", "replace", "expression", "new Error({expression})"),
    Fix("unnecessary-type-assertion", "", "replace", "", "{expression}"),
)


def _filled(template: str) -> Column:
    parts = [F.col(f"{p[1:-1]}.text") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts) if parts else F.lit("")


def proposed(rules: Registry, facts: Facts, fixes: Sequence[Fix] = FIXES, options: dict | None = None) -> DataFrame:
    """(file, rule, line, start, length, new_text) for the findings that have a fix: rows for ``edits.fix``. Findings meet their
    nodes by file and number."""
    missing = set(rules.unable(facts))
    wanted = [f for f in fixes if f.rule in rules.rules and f.rule not in missing]
    if not wanted:
        return facts["nodes"].sparkSession.createDataFrame([], EDITS)
    found = {r: rules.rules[r].located(facts, (options or {}).get(r, {})) for r in {f.rule for f in wanted}}
    ends = facts["nodes"].select("file", F.col("node_id").alias("target"), F.col("start").alias("from"), F.col("end").alias("to"))
    out = []
    for f in wanted:
        hits = found[f.rule].where("node_id IS NOT NULL") if not f.message else found[f.rule].where((F.col("message") == f.message) & F.col("node_id").isNotNull())
        rows = with_children(facts["nodes"], *sorted(f.roles)) if f.roles else facts["nodes"]
        rows = rows.join(hits.select("file", "node_id").distinct(), ["file", "node_id"])
        if f.only:
            rows = rows.where(F.col(f"{f.only[0]}.kind") == f.only[1])
        rows = rows.withColumns({"target": F.col(f"{f.role}.id") if f.role else F.col("node_id"), "new_text": _filled(f.text)}).join(ends, ["file", "target"])
        start, length = (F.col("to"), F.lit(0)) if f.how == "after" else (F.col("from"), F.col("to") - F.col("from"))
        out.append(rows.where("new_text IS NOT NULL").select("file", F.lit(f.rule).alias("rule"), "line", start.alias("start"), length.cast("int").alias("length"), "new_text"))
    return reduce(DataFrame.unionByName, out)
