"""Extractors over code facts: exported functions, tags of what they call, what they consume, declarations, and gaps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_hash
from ..plans.rules import Facts
from . import relations
from .syntax_rules import kind, with_children

# Fixed values of the extractors.
TABLE_METHODS = ("from", "insert", "update", "delete")
UNSAFE_PATTERN = r"[+*]{2,}|(\+\+|\*\*)|(\([^)]*\+\)[*+])"
SEVERITIES = ("critical", "high", "medium", "low")
#: Replacements before a body is hashed, in this order.
NORMALISED = ((r"[a-zA-Z_$][a-zA-Z0-9_$]*", r"\$"), (r'"[^"]*"', r"\$S"), (r"'[^']*'", r"\$S"), (r"`[^`]*`", r"\$T"), (r"\b\d+\.?\d*\b", r"\$N"), (r"\s+", " "))


def exported_functions(facts: Facts) -> DataFrame:
    """(file, name, line, function_id): exported function declarations, and exported names whose value is a function."""
    rows = with_children(facts["nodes"], "initializer").withColumn("name", F.col("text"))
    declared = rows.where(kind("FunctionDeclaration")).withColumn("function_id", F.col("node_id"))
    valued = rows.where(kind("VariableDeclaration") & F.col("initializer.kind").isin("ArrowFunction", "FunctionExpression")).withColumn("function_id", F.col("initializer.id"))
    both = declared.select("file", "name", "line", "function_id").unionByName(valued.select("file", "name", "line", "function_id"))
    return relations.covered(both, facts["exports"], ["file", "name"])


def calls_inside(facts: Facts, functions: DataFrame) -> DataFrame:
    """Calls anywhere within a function: (file, function_id, node_id, name, chain, target_symbol). Ancestors are exploded and
    met by equality, never by ranges of places."""
    placed = facts["calls"].join(facts["nodes"].select("file", "node_id", F.explode("ancestors").alias("a")), ["file", "node_id"]).withColumn("function_id", F.col("a.id"))
    return relations.covered(placed, functions, ["file", "function_id"]).select("file", "function_id", "node_id", "name", "chain", "target_symbol")


def safe_pattern(tag: str) -> bool:
    """Whether a tag is a pattern that can be run: no nested repeats, and valid."""
    if re.search(UNSAFE_PATTERN, tag):
        return False
    try:
        re.compile(tag)
    except re.error:
        return False
    return True


def _matching(pattern: str):
    return lambda name: name.rlike(pattern)


def matched_tags(names: Column, tags: Sequence[str]) -> Column:
    """Tags that one of the names fulfils: as a pattern if it begins ^ or ends $ (unsafe and invalid ones never match), else by equality."""
    hits = []
    for tag in tags:
        if not (tag.startswith("^") or tag.endswith("$")):
            hits.append(F.when(F.array_contains(names, tag), F.lit(tag)))
        elif safe_pattern(tag):
            hits.append(F.when(F.exists(names, _matching(tag)), F.lit(tag)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def function_tags(facts: Facts, tags: Sequence[str], directive: str) -> DataFrame:
    """(file, name, tags, calls_exports) of exported functions of files with the directive; calls_exports are the file's
    other exported functions that it calls by name."""
    files = facts["files"].where(F.col("directive") == directive).select("file")
    functions = relations.covered(exported_functions(facts), files, ["file"])
    called = calls_inside(facts, functions).groupBy("file", "function_id").agg(F.collect_set("name").alias("names"))
    own = functions.groupBy("file").agg(F.collect_set("name").alias("exported"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    rows = functions.join(called, ["file", "function_id"], "left").join(own, "file")
    return rows.select("file", "name", matched_tags(names, tags).alias("tags"), F.array_sort(F.filter(F.array_intersect(names, "exported"), lambda n: n != F.col("name"))).alias("calls_exports"))


def normalised_body(text: Column) -> Column:
    for pattern, by in NORMALISED:
        text = F.regexp_replace(text, pattern, by)
    return text


def consumption(facts: Facts, least_statements: int = 3) -> DataFrame:
    """(file, name, line, statements, targets, tables, body_hash) of exported functions of some length: the symbols that
    they call (file::name, not of packages), the tables that they name, and a hash of the body with names and values left out."""
    functions = exported_functions(facts)
    bodies = facts["nodes"].where(F.col("field") == "statement").groupBy("file", F.col("parent_id").alias("function_id")).agg(
        F.count("*").alias("statements"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), " ").alias("body"))  # as long as the function
    functions = functions.join(bodies.where(F.col("statements") >= least_statements), ["file", "function_id"])
    inner = calls_inside(facts, functions)
    local = facts["symbols"].where(~F.col("decl_file").contains("node_modules")).select(F.col("symbol_id").alias("target_symbol"), F.concat_ws("::", "decl_file", "name").alias("target"))
    targets = inner.join(local, "target_symbol").groupBy("file", "function_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    writes = inner.where(F.col("name").isin(*TABLE_METHODS) & (F.size("chain") > 1)).select("file", "function_id", F.col("node_id").alias("parent_id"))
    named = facts["nodes"].where(F.col("field") == "argument").join(facts["node_symbols"], ["file", "node_id"]).join(facts["symbols"].select("symbol_id", F.col("name").alias("table")), "symbol_id")
    tables = writes.join(named.select("file", "parent_id", "table"), ["file", "parent_id"]).groupBy("file", "function_id").agg(F.array_sort(F.collect_set("table")).alias("tables"))
    none = F.array().cast("array<string>")
    return functions.join(targets, ["file", "function_id"], "left").join(tables, ["file", "function_id"], "left").select(
        "file", "name", "line", "statements", F.coalesce("targets", none).alias("targets"), F.coalesce("tables", none).alias("tables"), text_hash(normalised_body(F.col("body"))).alias("body_hash"))


def declarations(facts: Facts) -> DataFrame:
    """(file, kind, name, line, exported, members): enums with their constant members, interfaces and type aliases with their
    own members, exported constants of literals. Members are name: value or type; those without any are left out."""
    nodes = facts["nodes"]
    exports = facts["exports"].select("file", F.col("name").alias("text"), F.lit(True).alias("exported")).distinct()
    kinds = {"EnumDeclaration": "enum", "InterfaceDeclaration": "interface", "TypeAliasDeclaration": "type-alias"}
    heads = nodes.where(kind(*kinds)).join(exports, ["file", "text"], "left")
    shown = F.coalesce(F.when(F.col("value.text") != "", F.col("value.text")), F.lit("unknown"))
    members = with_children(nodes.where((F.col("field") != "member") | ~kind("IndexSignature")), "value").where(F.col("field") == "member")
    members = members.where(~kind("EnumMember") | F.col("value").isNotNull())
    listed = members.groupBy("file", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.col("text"), F.lit(": "), shown).alias("m")))).alias("m"))  # as long as the declaration
    names = F.create_map(*[F.lit(x) for k in kinds.items() for x in k])
    typed = heads.join(listed, ["file", "node_id"]).select("file", names[F.col("kind")].alias("kind"), F.col("text").alias("name"), "line", F.coalesce("exported", F.lit(False)).alias("exported"), F.transform("m", lambda x: x["m"]).alias("members"))
    constants = with_children(nodes, "initializer").where(kind("VariableDeclaration") & F.col("initializer.kind").isin("StringLiteral", "NumericLiteral"))
    constants = constants.join(exports, ["file", "text"]).select("file", F.lit("constant").alias("kind"), F.col("text").alias("name"), "line", "exported", F.array(F.concat(F.col("text"), F.lit(": "), F.col("initializer.text"))).alias("members"))
    return typed.unionByName(constants)


def gaps(items: DataFrame, rules: Sequence[tuple[Column, Column | str, str, str]], label: Column, path: Column) -> DataFrame:
    """(action, file, issue, severity, fix_hint, rank) of items for each (condition, issue, severity, hint) that they meet, by
    rank of severity: one pass, an item for each condition."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    met = F.array_compact(F.array(*[
        F.when(condition, F.struct(lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(hint).alias("fix_hint"), F.lit(SEVERITIES.index(severity)).alias("rank"))) for condition, issue, severity, hint in rules]))
    return items.select(label.alias("action"), F.substring_index(path, "/", -1).alias("file"), F.explode(met).alias("m")).select("action", "file", "m.*")
