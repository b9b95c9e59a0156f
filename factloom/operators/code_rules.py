"""Code rules over fact relations (``factloom.sources.facts``): syntax nodes, imports, exports and their uses.

Every rule is one query; ``CODE_RULES.diagnostics(facts, options)`` unites those whose relations are there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Facts, Registry, lines_over
from . import graph, metrics, relations

CODE_RULES = Registry()

# Fixed values of the rules.
LOOPS = ("ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoStatement")
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunction", "MethodDeclaration", "Constructor")
TERMINATORS = ("ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement")
HOISTED = ("FunctionDeclaration", "InterfaceDeclaration", "TypeAliasDeclaration")
BRANCHES = (*LOOPS, "IfStatement", "ConditionalExpression", "CaseClause", "CatchClause")
LOGICAL = ("AmpersandAmpersandToken", "BarBarToken")
NUMBER_PARENTS = ("EnumMember", "LiteralType", "ElementAccessExpression", "VariableDeclaration", "PropertyAssignment", "ReturnStatement")
WRAPPERS = ("AsExpression", "SatisfiesExpression", "ParenthesizedExpression")
LITERALS = ("StringLiteral", "NoSubstitutionTemplateLiteral", "NumericLiteral", "PrefixUnaryExpression")
TRIVIAL_NUMBERS = (0, 1, -1)
DECLARATIONS = ("VariableDeclaration", "FunctionDeclaration", "Parameter", "BindingElement", "MethodDeclaration", "PropertyDeclaration")
PROPERTIES = ("PropertyAssignment", "ShorthandPropertyAssignment")
COMPLEXITY = {"cyclomatic": 15, "lines": 150, "max_nesting": 4, "statements": 25, "parameters": 4, "callbacks": 3}


def found(rows: DataFrame, message: str | Column) -> DataFrame:
    """Findings with the number of their node, null if the rows name none."""
    node = F.col("node_id") if "node_id" in rows.columns else F.lit(None).cast("long").alias("node_id")
    return rows.select("file", "line", F.col("col").alias("column"), (F.lit(message) if isinstance(message, str) else message).alias("message"), node)


def with_parent(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's kind: an equality join on file and node, never a range."""
    parents = nodes.select("file", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    return nodes.join(parents, ["file", "parent_id"], "left")


def inside(ancestors: str, kinds: Sequence[str], until: Sequence[str]) -> Column:
    """Whether an ancestor of one of the kinds comes before the nearest boundary; ancestors go from the root down."""
    nearest = F.reverse(F.transform(ancestors, lambda a: a["kind"]))
    hit = F.aggregate(nearest, F.lit(0), lambda s, k: F.when(s != 0, s).when(k.isin(*until), F.lit(2)).when(k.isin(*kinds), F.lit(1)).otherwise(s))
    return hit == 1


def _by_file(rows: DataFrame, message: str | Column) -> DataFrame:
    return found(rows.withColumns({"line": F.lit(1), "col": F.lit(1)}), message)


@CODE_RULES.rule("no-debug-code", "quality", "Debugger statements", needs=("nodes",))
def no_debug_code(facts: Facts, options: dict) -> DataFrame:
    return found(facts["nodes"].where("kind = 'DebuggerStatement'"), "debugger statement")


@CODE_RULES.rule("banned-syntax", "quality", "Void, labels, bare blocks, broken and octal strings, deletion of names, globals assigned", sub_checks=7, needs=("nodes", "node_symbols", "symbols"))
def banned_syntax(facts: Facts, options: dict) -> DataFrame:
    nodes = with_parent(facts["nodes"])
    text = F.when(F.col("kind") == "StringLiteral", F.col("text"))
    what = F.array_compact(F.array(
        F.when(F.col("kind") == "VoidExpression", "void operator"), F.when(F.col("kind") == "LabeledStatement", "label"),
        F.when((F.col("kind") == "Block") & (F.col("parent_kind") == "Block"), "block in a block"), F.when(text.rlike(r"\\\r?\n"), "line broken in a string"), F.when(text.rlike(r"\\[1-7]"), "octal escape"),
        F.when((F.col("kind") == "Identifier") & (F.col("parent_kind") == "DeleteExpression"), "deletion of a name")))
    said = found(nodes.withColumn("what", F.explode(what)), F.col("what"))
    libs = facts["symbols"].where("origin = 'lib'").select("symbol_id", "name")
    written = nodes.where("kind = 'Identifier' AND field = 'left'").join(facts["node_symbols"], ["file", "node_id"]).join(libs, "symbol_id").select("file", F.col("parent_id").alias("node_id"), "name")
    assigned = facts["nodes"].where("kind = 'EqualsToken' AND field = 'operator'").select("file", F.col("parent_id").alias("node_id"))
    hit = relations.covered(facts["nodes"].where("kind = 'BinaryExpression'"), assigned, ["file", "node_id"]).join(written, ["file", "node_id"])
    return said.unionByName(found(hit, F.concat(F.lit("global assigned: "), F.col("name"))))


@CODE_RULES.rule("no-magic-numbers", "quality", "Numbers without a name", needs=("nodes",))
def no_magic_numbers(facts: Facts, options: dict) -> DataFrame:
    nodes = with_parent(facts["nodes"].where((F.col("kind") == "NumericLiteral") | F.col("kind").isin(*NUMBER_PARENTS)))
    hit = nodes.where((F.col("kind") == "NumericLiteral") & ~F.col("text").try_cast("double").isin([float(x) for x in options.get("ignored", (0, 1, 2))]) & F.col("parent_kind").isNull())
    return found(hit, F.concat(F.lit("number "), F.col("text")))


@CODE_RULES.rule("no-underscore-prefix", "quality", "Declared names that begin with an underscore", needs=("nodes", "contexts", "types"))
def no_underscore_prefix(facts: Facts, options: dict) -> DataFrame:
    """Properties of a literal are left if the type that is expected there has them."""
    named = facts["nodes"].where(F.col("text").rlike("^_.+"))
    types = facts["types"]
    props = types.select("type_id", F.explode("props").alias("p")).select("type_id", F.col("p.name").alias("text"))
    inner = types.select("type_id", F.explode("members").alias("member")).join(props.withColumnRenamed("type_id", "member"), "member").select("type_id", "text")
    expected = facts["contexts"].join(props.union(inner), "type_id").select("file", F.col("node_id").alias("parent_id"), "text")
    free = relations.uncovered(named.where(F.col("kind").isin(*PROPERTIES)), expected, ["file", "parent_id", "text"])
    return found(named.where(F.col("kind").isin(*DECLARATIONS)).unionByName(free), F.concat(F.lit("name "), F.col("text")))


@CODE_RULES.rule("no-local-constants", "architecture", "Upper-case constants outside the constants folder", needs=("nodes",))
def no_local_constants(facts: Facts, options: dict) -> DataFrame:
    """Literals, be they wrapped in assertions or brackets; trivial numbers and empty texts stay where they are."""
    nodes = facts["nodes"].where(~F.col("file").contains("/constants/"))
    outer = F.try_element_at(F.filter("ancestors", lambda a: ~a["kind"].isin(*WRAPPERS)), F.lit(-1))
    number = F.when(F.col("kind").isin("NumericLiteral", "PrefixUnaryExpression"), F.col("text").try_cast("double"))
    trivial = number.isin([float(x) for x in options.get("trivialNumbers", TRIVIAL_NUMBERS)])
    literal = F.col("kind").isin(*LITERALS) & ((F.col("kind") != "PrefixUnaryExpression") | F.col("text").rlike(r"^-[0-9.]+$"))
    values = nodes.where(literal & ~F.coalesce(trivial, F.lit(False)) & (F.col("text") != "")).select("file", outer["id"].alias("node_id"))
    named = nodes.where((F.col("kind") == "VariableDeclaration") & F.col("text").rlike("^[A-Z][A-Z0-9_]*$"))
    return found(relations.covered(named, values, ["file", "node_id"]), F.concat(F.lit("constant "), F.col("text")))


@CODE_RULES.rule("max-file-lines", "quality", "Files with too many lines", needs=("files",))
def max_file_lines(facts: Facts, options: dict) -> DataFrame:
    return _by_file(facts["files"].where(lines_over(F.col("content"), options.get("maxLines", 300))), "too many lines")


@CODE_RULES.rule("no-unescaped-entities", "quality", "Raw marks in markup text", needs=("nodes",))
def no_unescaped_entities(facts: Facts, options: dict) -> DataFrame:
    mark = F.regexp_extract("text", """[>"'}]""", 0)
    return found(facts["nodes"].where((F.col("kind") == "JsxText") & F.col("file").endswith(".tsx") & (mark != "")), F.concat(F.lit("escape "), mark))


@CODE_RULES.rule("readability", "quality", "Nested ternaries, switches and templates, literals asserted, aliases of this", sub_checks=5, needs=("nodes",))
def readability(facts: Facts, options: dict) -> DataFrame:
    nested = lambda kind: (F.col("kind") == kind) & F.exists("ancestors", lambda a: a["kind"] == kind)
    child = lambda role, name: facts["nodes"].where((F.col("field") == role) & (F.col("ord") == 0)).select("file", F.col("parent_id").alias("node_id"), F.struct("kind", "text").alias(name))
    rows = with_parent(facts["nodes"]).join(child("initializer", "value"), ["file", "node_id"], "left").join(child("expression", "inner"), ["file", "node_id"], "left").join(child("type", "asserted"), ["file", "node_id"], "left")
    same = (F.col("inner.kind") == "StringLiteral") & (F.col("asserted.kind") == "LiteralType") & (F.col("inner.text") == F.col("asserted.text"))
    what = (
        F.when((F.col("kind") == "ConditionalExpression") & (F.col("parent_kind") == "ConditionalExpression"), "nested ternary").when(nested("SwitchStatement"), "nested switch").when(nested("TemplateExpression"), "nested template")
        .when((F.col("kind") == "AsExpression") & same, "use as const").when((F.col("kind") == "VariableDeclaration") & (F.col("value.kind") == "ThisKeyword"), "alias of this"))
    return found(rows.withColumn("what", what).where("what IS NOT NULL"), F.col("what"))


def unreachable_code(facts: Facts) -> DataFrame:
    statements = facts["nodes"].where((F.col("field") == "statement") & ~F.col("kind").isin(*HOISTED))
    return found(relations.first_after(statements, ["file", "parent_id"], ["ord"], F.col("kind").isin(*TERMINATORS)), "never reached")


@CODE_RULES.rule("complexity", "quality", "Functions over a threshold", sub_checks=6, needs=("nodes",))
def complexity(facts: Facts, options: dict) -> DataFrame:
    nodes, limits = facts["nodes"], COMPLEXITY | options
    functions = F.filter("ancestors", lambda a: a["kind"].isin(*FUNCTIONS))
    owner = F.struct("file", F.try_element_at(functions, F.lit(-1))["id"].alias("node_id"))
    level = F.size(F.filter("ancestors", lambda a: a["kind"].isin(*BRANCHES)))
    owned = nodes.withColumns({"owner": owner, "end_line": F.col("line"), "level": level}).where("owner.node_id IS NOT NULL")
    per = metrics.complexity(owned, "owner", BRANCHES, LOGICAL, FUNCTIONS, depth="level")
    over = [relations.thresholds(per, "owner", {m: (F.col(m), limits[m]) for m in ("cyclomatic", "lines", "max_nesting")}).select("owner.file", "owner.node_id", "metric")]
    parts = nodes.groupBy("file", F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("field") == "statement").alias("statements"), F.count_if(F.col("field") == "parameter").alias("parameters"))
    heads = relations.covered(parts, nodes.where(F.col("kind").isin(*FUNCTIONS)), ["file", "node_id"])
    for m in ("statements", "parameters"):
        over.append(heads.where(F.col(m) > limits[m]).select("file", "node_id", F.lit(m).alias("metric")))
    # a callback is a function that a call holds; its depth in a function around it counts those between
    back = lambda a, parent: a.isin("ArrowFunction", "FunctionExpression") & (parent == "CallExpression")
    chain = F.transform("ancestors", lambda a, i: F.struct(a["id"].alias("id"), a["kind"].alias("kind"), back(a["kind"], F.try_element_at("ancestors", i)["kind"]).alias("back")))
    calls = with_parent(nodes).where(back(F.col("kind"), F.col("parent_kind"))).withColumn("chain", chain)
    inner = calls.select("file", F.explode(F.transform("chain", lambda a, i: F.struct(a["id"].alias("id"), (1 + F.size(F.filter(F.slice("chain", i + 2, F.size("chain")), lambda b: F.coalesce(b["back"], F.lit(False))))).alias("depth")))).alias("a"))
    deep = inner.groupBy("file", F.col("a.id").alias("node_id")).agg(F.max("a.depth").alias("depth")).where(F.col("depth") > limits["callbacks"])
    over.append(relations.covered(deep, nodes.where(F.col("kind").isin(*FUNCTIONS)), ["file", "node_id"]).select("file", "node_id", F.lit("callbacks").alias("metric")))
    return found(reduce(DataFrame.unionByName, over).join(nodes, ["file", "node_id"]), F.col("metric"))


@CODE_RULES.rule("self-import", "architecture", "Files that import themselves", needs=("import_edges",))
def self_import(facts: Facts, options: dict) -> DataFrame:
    return found(facts["import_edges"].where("src = dst").select(F.col("src").alias("file"), "line", F.lit(1).alias("col")), "imports itself")


@CODE_RULES.rule("duplicate-import", "architecture", "A module imported twice in a file", needs=("import_edges",))
def duplicate_import(facts: Facts, options: dict) -> DataFrame:
    """Imports of types and of values can't be one: a module with both in a file is left."""
    static = facts["import_edges"].where("NOT is_dynamic")
    mixed = static.groupBy("src", "dst").agg(F.bool_or("type_only").alias("some"), F.bool_and("type_only").alias("all")).where("some AND NOT all")
    hit = relations.later_duplicates(relations.uncovered(static, mixed, ["src", "dst"]), ["src", "dst"], ["line"])
    return found(hit.select(F.col("src").alias("file"), "line", F.lit(1).alias("col"), "specifier"), F.concat(F.lit("again "), F.col("specifier")))


@CODE_RULES.rule("no-import-cycle", "architecture", "Value imports that close a cycle", needs=("import_edges",))
def no_import_cycle(facts: Facts, options: dict) -> DataFrame:
    values = facts["import_edges"].where("NOT type_only AND NOT external")
    parts = graph.components_of_cycles(values)
    side = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"{k}_part"))
    hit = values.join(side("src"), "src").join(side("dst"), "dst").where("src_part = dst_part")
    return found(hit.select(F.col("src").alias("file"), "line", F.lit(1).alias("col"), "specifier"), F.concat(F.lit("cycle through "), F.col("specifier")))


@CODE_RULES.rule("unused-export", "quality", "Exports that no other file uses", needs=("exports", "refs"))
def unused_export(facts: Facts, options: dict) -> DataFrame:
    used = facts["refs"].select(F.col("def_file").alias("file"), "name").distinct()
    return _by_file(relations.uncovered(facts["exports"], used, ["file", "name"]), F.concat(F.lit("unused "), F.col("name")))


@CODE_RULES.rule("no-duplicate-schema-export", "quality", "A schema exported under one name in several places", needs=("nodes", "exports", "node_types", "types"))
def no_duplicate_schema_export(facts: Facts, options: dict) -> DataFrame:
    """A schema is what has parse and safeParse, whatever its name."""
    schemas = facts["types"].where(F.exists("props", lambda p: p["name"] == "parse") & F.exists("props", lambda p: p["name"] == "safeParse")).select("type_id")
    rows = facts["nodes"].where("kind = 'VariableDeclaration'").withColumn("name", F.col("text"))
    for part in options.get("ignorePaths", ()):
        rows = rows.where(~F.col("file").contains(part))
    rows = relations.covered(rows.join(facts["node_types"], ["file", "node_id"]), schemas, ["type_id"])
    rows = relations.covered(rows, facts["exports"], ["file", "name"])
    names = relations.duplicates(rows, ["name"], "file").select("name")
    return found(relations.covered(rows, names, ["name"]), F.concat(F.lit("also elsewhere: "), F.col("name")))


@CODE_RULES.rule("route-boundary", "architecture", "Imports from one route into another", needs=("import_edges",))
def route_boundary(facts: Facts, options: dict) -> DataFrame:
    folder = options.get("appDir", "app/")
    of = lambda path: F.when(F.col(path).startswith(folder), F.split_part(F.substring(F.col(path), F.lit(len(folder) + 1), F.length(path)), F.lit("/"), F.lit(1)))
    hit = facts["import_edges"].withColumns({"a": of("src"), "b": of("dst")}).where("a <> b")
    hit = hit.where(~F.col("b").isin(*options.get("allowedTargets", ())) & ~F.concat_ws(">", "a", "b").isin(*options.get("allowedPairs", ())))
    return found(hit.select(F.col("src").alias("file"), "line", F.lit(1).alias("col"), "a", "b"), F.concat_ws(" -> ", "a", "b"))


@CODE_RULES.rule("no-client-server-only-import", "architecture", "Client files from which server-only modules are reached", needs=("files", "import_edges"))
def no_client_server_only_import(facts: Facts, options: dict) -> DataFrame:
    files, values = facts["files"], facts["import_edges"].where("NOT type_only")
    clients = files.where("directive = 'use client'").select(F.col("file").alias("node"))
    stops = files.where("directive = 'use server'").select(F.col("file").alias("node"))
    hit = graph.reachable(values, clients, stops).where(F.col("node").isin(*options.get("serverOnly", ("server-only",))))
    return _by_file(hit.select(F.col("root").alias("file"), "path"), F.array_join("path", " -> "))


@CODE_RULES.rule("unnecessary-use-server", "security", "Server actions that no client file imports", needs=("files", "import_edges"))
def unnecessary_use_server(facts: Facts, options: dict) -> DataFrame:
    files = facts["files"]
    clients = files.where("directive = 'use client'").select(F.col("file").alias("node"))
    used = graph.reach(facts["import_edges"].where("NOT type_only"), clients).select(F.col("node").alias("file"))
    return _by_file(relations.uncovered(files.where("directive = 'use server'"), used, ["file"]), "no client imports it")
