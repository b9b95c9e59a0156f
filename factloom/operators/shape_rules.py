"""Code rules on the shapes of types, parameters, hooks and modern forms of expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import Facts
from . import graph, relations
from .code_rules import CODE_RULES, FUNCTIONS, found, inside, with_parent
from .flow_rules import (
    ANY, BOOLEAN_LITERAL, BOOLEANS, FLOWS, NULL, NUMBER_LITERAL, NUMBERS, OBJECT, STRING, STRING_LITERAL, STRINGS, TYPED, UNDEFINED, UNKNOWN, _assignable, at, first_argument, has, operand_type, origins, tainted_arguments, typed_nodes, with_type
)
from .syntax_rules import EQUALITY, PURE, each, kind, operator, with_children

INTERSECTION = 2097152  # type flag
# Fixed values of the rules.
HOOKS_WITH_DEPS = ("useEffect", "useCallback", "useMemo")
STABLE_SETTER_HOOKS = ("useState", "useReducer", "useTransition", "useActionState")
STABLE_VALUE_HOOKS = ("useRef", "useId")
STABLE_LITERALS = ("NumericLiteral", "StringLiteral", "TrueKeyword", "FalseKeyword", "NullKeyword")
MUTATING = ("push", "pop", "shift", "unshift", "splice", "sort", "reverse", "fill", "copyWithin")
ROW_TYPES = r"InferSelectModel|\$inferSelect"


def owner_of(ancestors: str = "ancestors"):
    """The id of the nearest function around a node."""
    return F.try_element_at(F.filter(ancestors, lambda a: a["kind"].isin(*FUNCTIONS)), F.lit(-1))["id"]


def symbols_at(facts: Facts, nodes: DataFrame) -> DataFrame:
    return nodes.join(facts["node_symbols"], ["file", "node_id"])


@CODE_RULES.rule("prefer-modern-api", "quality", "Old forms that have a newer one", sub_checks=7, needs=("nodes",))
def prefer_modern_api(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "left", "operator", "right", "expression", "argument")
    searched = kind("BinaryExpression") & F.col("left.text").rlike(r"\.indexOf\(.*\)$")
    call, right = kind("CallExpression"), F.col("right.text")
    return each(rows, {
        "use includes": searched & (right == "-1"),
        "use startsWith": searched & (right == "0") & F.col("operator.kind").isin(*EQUALITY),
        "property deleted": kind("DeleteExpression"),
        "use spread": call & (F.col("expression.text") == "Object.assign") & (F.col("argument.kind") == "ObjectLiteralExpression"),
        "use flatMap": call & F.col("expression.text").rlike(r"\.map\(.*\)\.flat$"),
        "use at": kind("ElementAccessExpression") & F.col("text").rlike(r"^([\w.]+)\[\1\.length\s*-\s*\d+\]$"),
        "use Object.hasOwn": call & F.col("expression.text").endswith("hasOwnProperty.call"),
    })


@CODE_RULES.rule("prefer-optional-chain", "quality", "Guards that an optional chain can say", needs=("nodes",))
def prefer_optional_chain(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "left", "operator", "right")
    guarded = F.regexp_replace("left.text", r"\s*!==?\s*(null|undefined)$", "")
    return each(rows, {"use ?.": operator("AmpersandAmpersandToken") & F.col("left.kind").isin(*PURE, "BinaryExpression") & F.col("right.text").startswith(F.concat(guarded, F.lit(".")))})


@CODE_RULES.rule("promise-all-opportunity", "performance", "Awaits in a row that don't need each other", needs=("nodes", "node_symbols"))
def promise_all_opportunity(facts: Facts, options: dict) -> DataFrame:
    """The second of two adjacent awaiting statements that uses nothing the first declares; those in a try are left."""
    nodes = facts["nodes"]
    w = Window.partitionBy("file", "parent_id").orderBy("ord")
    own = nodes.select("file", F.explode("ancestors").alias("a"), F.col("kind").alias("inner_kind"), F.col("node_id").alias("inner")).select("file", F.col("a.id").alias("node_id"), "inner_kind", "inner")
    awaits = own.where("inner_kind = 'AwaitExpression'").select("file", "node_id").distinct().withColumn("awaits", F.lit(True))
    statements = nodes.where(F.col("field") == "statement").join(awaits, ["file", "node_id"], "left").withColumns({"before": F.lag("node_id").over(w), "before_awaits": F.lag("awaits").over(w)})
    pairs = statements.where(F.col("awaits") & F.col("before_awaits") & ~inside("ancestors", ("TryStatement", "CatchClause"), FUNCTIONS))
    inner_symbols = own.where(F.col("inner_kind").isin("VariableDeclaration", "Identifier")).join(facts["node_symbols"].withColumnRenamed("node_id", "inner"), ["file", "inner"])
    declared = inner_symbols.where("inner_kind = 'VariableDeclaration'").select("file", F.col("node_id").alias("before"), "symbol_id")
    used = inner_symbols.where("inner_kind = 'Identifier'").select("file", "node_id", "symbol_id")
    linked = pairs.select("file", "node_id", "before").join(declared, ["file", "before"]).join(used, ["file", "node_id", "symbol_id"]).select("file", "node_id")
    return found(relations.uncovered(pairs, linked, ["file", "node_id"]), "await both at once")


def stable_symbols(facts: Facts, options: dict) -> DataFrame:
    """(file, symbol_id) of what never changes between renders: second elements that setter hooks give, values of value
    hooks, and constants of literals."""
    nodes = facts["nodes"]
    hooks = origins(facts).where("origin = 'pkg:react'").select("file", F.col("node_id").alias("call"), F.col("name").alias("hook"))
    values = with_children(with_parent(nodes), "initializer").where(kind("VariableDeclaration"))
    made = values.withColumn("call", F.col("initializer.id")).join(hooks, ["file", "call"])
    setters = made.where(F.col("hook").isin(*options.get("stableSetterHooks", STABLE_SETTER_HOOKS))).select("file", F.col("node_id").alias("declared"))
    second = nodes.where(kind("BindingElement") & (F.col("field") == "element") & (F.col("ord") == 1)).withColumn("declared", F.try_element_at("ancestors", F.lit(-2))["id"])
    listed = nodes.where(kind("VariableDeclarationList") & F.col("text").startswith("const ")).select("file", F.col("node_id").alias("parent_id"))
    stable = [
        relations.covered(second, setters, ["file", "declared"]), made.where(F.col("hook").isin(*options.get("stableValueHooks", STABLE_VALUE_HOOKS))),
        relations.covered(values.where(F.col("initializer.kind").isin(*STABLE_LITERALS)), listed, ["file", "parent_id"]),
    ]
    ids = stable[0].select("file", "node_id").union(stable[1].select("file", "node_id")).union(stable[2].select("file", "node_id"))
    return ids.join(facts["node_symbols"], ["file", "node_id"]).select("file", "symbol_id").distinct()


@CODE_RULES.rule("exhaustive-deps", "quality", "Hooks that use more than they list", needs=("nodes", "calls", "node_symbols", "symbols"))
def exhaustive_deps(facts: Facts, options: dict) -> DataFrame:
    """Symbols that the component declares and the callback uses, less those in the list and those that never change."""
    nodes, hooks = facts["nodes"], origins(facts).where(F.col("name").isin(*options.get("hooksWithDeps", HOOKS_WITH_DEPS)) & (F.col("origin") == "pkg:react"))
    lists = nodes.where((F.col("field") == "argument") & (F.col("ord") == 1) & kind("ArrayLiteralExpression")).select("file", F.col("parent_id").alias("node_id"), F.col("node_id").alias("list"))
    hooks = first_argument(facts, hooks).join(lists, ["file", "node_id"]).select("file", "node_id", "line", "col", "caller_id", "argument", "list")
    names = symbols_at(facts, nodes.where(kind("Identifier"))).select("file", F.explode("ancestors").alias("a"), F.col("text").alias("used"), "symbol_id").select("file", F.col("a.id").alias("around"), "used", "symbol_id")
    declared = symbols_at(facts, nodes.where(kind("VariableDeclaration", "Parameter", "BindingElement"))).select("file", owner_of().alias("caller_id"), "symbol_id").distinct()
    used = relations.uncovered(hooks.join(names.withColumnRenamed("around", "argument"), ["file", "argument"]), stable_symbols(facts, options), ["file", "symbol_id"])
    own = relations.covered(used, declared, ["file", "caller_id", "symbol_id"])
    missing = own.join(names.select("file", F.col("around").alias("list"), "symbol_id"), ["file", "list", "symbol_id"], "left_anti")
    listed = missing.groupBy("file", "node_id", "line", "col").agg(F.array_join(F.array_sort(F.collect_set("used")), ", ").alias("names"))
    return found(listed, F.concat(F.lit("missing "), F.col("names")))


@CODE_RULES.rule("narrow-param-type", "quality", "Parameters of which little is used", sub_checks=2, needs=(*TYPED, "node_symbols"), sub_ids={"few of a partial type": "partial-type-param", "few of a wide type": "usage-ratio"})
def narrow_param_type(facts: Facts, options: dict) -> DataFrame:
    nodes, types = facts["nodes"], facts["types"]
    uses = symbols_at(facts, with_parent(nodes).where(kind("Identifier") & (F.coalesce("field", F.lit("")) != "name")))
    reads = with_children(nodes, "expression").where(kind("PropertyAccessExpression")).select("file", F.col("expression.id").alias("node_id"), F.substring_index("text", ".", -1).alias("prop"))
    passed = uses.join(reads.select("file", "node_id"), ["file", "node_id"], "left_anti").select("file", "symbol_id")
    counted = uses.join(reads, ["file", "node_id"]).groupBy("file", "symbol_id").agg(F.count_distinct("prop").alias("used"))
    parameters = relations.uncovered(symbols_at(facts, nodes.where(kind("Parameter"))).join(counted, ["file", "symbol_id"]), passed, ["file", "symbol_id"])
    wide = types.where(F.size("props") >= options.get("minProperties", 10)).select("type_id", F.size("props").alias("total"))
    few = parameters.join(facts["node_types"], ["file", "node_id"]).join(wide, "type_id").where(F.col("used") < options.get("usageThreshold", 0.25) * F.col("total"))
    # Partial<T>: a reference with T as its argument
    partial = nodes.where(kind("TypeReference") & (F.col("field") == "type") & (F.col("text") == "Partial")).select("file", F.col("node_id").alias("partial"), F.col("parent_id").alias("node_id"))
    inner = nodes.where(F.col("field") == "typeArgument").select("file", F.col("parent_id").alias("partial"), F.col("node_id").alias("argument")).join(facts["node_types"].withColumnRenamed("node_id", "argument"), ["file", "argument"])
    inner = inner.join(types.select("type_id", F.size("props").alias("total")), "type_id").select("file", "partial", "total")
    some = parameters.join(partial.join(inner, ["file", "partial"]), ["file", "node_id"]).where((F.col("used") <= options.get("partialPickMaxFields", 5)) & (F.col("used") < F.col("total")))
    whole = relations.uncovered(few, some, ["file", "node_id"])  # a finding of the one kind leaves out the other
    return found(whole, "few of a wide type").unionByName(found(some, "few of a partial type"))


def element_types(types: DataFrame) -> DataFrame:
    """(type_id) of rendered elements, by their properties type, props and key, and of what holds such a type as a member
    (unions, and promises, which list what they give)."""
    own = types.where(F.size(F.array_intersect(F.transform("props", lambda p: p["name"]), F.array(F.lit("type"), F.lit("props"), F.lit("key")))) == 3).select("type_id")
    held = types.select("type_id", F.explode("members").alias("member"))
    one = relations.covered(held, own.withColumnRenamed("type_id", "member"), ["member"]).select("type_id")
    two = relations.covered(held, one.withColumnRenamed("type_id", "member"), ["member"]).select("type_id")
    return own.union(one).union(two).distinct()


@CODE_RULES.rule("no-async-client-component", "quality", "Client components that are async", needs=("nodes", "files", "exports", "node_types", "types"))
def no_async_client_component(facts: Facts, options: dict) -> DataFrame:
    """Exported async functions that return elements, declared or as a value."""
    nodes = facts["nodes"]
    client = facts["files"].where("directive = 'use client'").select("file")
    asynchronous = nodes.where(kind("AsyncKeyword") & (F.col("field") == "modifier")).select("file", F.col("parent_id").alias("function"))
    functions = relations.covered(relations.covered(asynchronous.join(facts["node_types"].withColumnRenamed("node_id", "function"), ["file", "function"]), element_types(facts["types"]), ["type_id"]), client, ["file"]).select("file", "function")
    rows = with_children(nodes, "initializer").where(F.col("file").endswith(".tsx"))
    declared = rows.where(kind("FunctionDeclaration")).withColumn("function", F.col("node_id")).unionByName(
        rows.where(kind("VariableDeclaration") & F.col("initializer.kind").isin("ArrowFunction", "FunctionExpression")).withColumn("function", F.col("initializer.id")))
    exported = relations.covered(declared, facts["exports"].select("file", F.col("name").alias("text")), ["file", "text"])
    return found(relations.covered(exported, functions, ["file", "function"]), "async component")


@CODE_RULES.rule("no-misused-promises", "quality", "Async functions where nobody waits", needs=("nodes", "calls", "symbols", "contexts", "types"))
def no_misused_promises(facts: Facts, options: dict) -> DataFrame:
    """First arguments whose place expects a function without a result, and those of effects."""
    asynchronous = facts["nodes"].where(kind("AsyncKeyword") & (F.col("field") == "modifier")).select("file", F.col("parent_id").alias("argument"))
    calls = first_argument(facts, origins(facts)).where(F.col("argument_kind").isin("ArrowFunction", "FunctionExpression"))
    calls = relations.covered(calls, asynchronous, ["file", "argument"])
    void = relations.covered(facts["contexts"], facts["types"].where(F.col("shape").rlike(r"=>\s*void$")), ["type_id"]).select("file", F.col("node_id").alias("argument"))
    effects = calls.where((F.col("name") == "useEffect") & F.col("origin").startswith("pkg:"))
    others = relations.uncovered(relations.covered(calls, void, ["file", "argument"]), effects.select("file", "node_id"), ["file", "node_id"])
    return found(effects.unionByName(others), F.concat(F.lit("not awaited by "), F.col("name")))


@CODE_RULES.rule("no-page-params-unsafe-parse", "security", "Address parameters of pages parsed without a catch", needs=FLOWS)
def no_page_params_unsafe_parse(facts: Facts, options: dict) -> DataFrame:
    calls = facts["calls"].where((F.col("name") == "parse") & F.col("file").rlike(options.get("pages", r"page\.tsx$")))
    return found(tainted_arguments(facts | {"nodes": facts["nodes"].where(~kind("Parameter") | F.col("text").rlike(r"\b(params|searchParams)\b"))}, calls), "use safeParse")


@CODE_RULES.rule("no-redundant-zod-parse", "quality", "Values parsed that have the type already", needs=(*TYPED, "files", "calls", "assignable"))
def no_redundant_zod_parse(facts: Facts, options: dict) -> DataFrame:
    server, typed = facts["files"].where("directive = 'use server'").select("file"), typed_nodes(facts)
    calls = facts["calls"].where(F.col("name").isin("parse", "safeParse") & ~F.array_contains("chain", "catch") & (F.col("chain")[0] != "JSON"))
    rows = first_argument(facts, relations.uncovered(calls, server, ["file"]))
    rows = with_type(with_type(rows, typed, F.col("argument"), "given"), typed, F.col("node_id"), "made").where(~has("given.flags", ANY | UNKNOWN))
    pairs = rows.withColumns({"a": F.col("given.type_id"), "b": F.col("made.type_id")}).where("a IS NOT NULL AND b IS NOT NULL")
    return found(_assignable(facts, pairs).where("forth"), "it has this type")


CONTAINER_KEY_METHODS = ("set", "get", "has", "add", "delete")
KEYED = r"^(Map|Set)<string[,>]"


@CODE_RULES.rule("unbranded-type-consistency", "quality", "Ids that are plain strings, and branded keys of containers of plain ones", sub_checks=3, needs=(*TYPED, "calls"),
                 sub_ids={"branded key of a container": "container-key", "branded key of a record": "record-key"})
def unbranded_type_consistency(facts: Facts, options: dict) -> DataFrame:
    """A branded string is an intersection of a string and an object."""
    nodes, types, typed = facts["nodes"], facts["types"], typed_nodes(facts)
    named = nodes.where(kind("Parameter", "PropertySignature", "VariableDeclaration") & F.col("text").rlike("[a-z]Id$") & ~F.col("text").isin(*options.get("externalIdNames", ())))
    ids = found(with_type(named, typed, F.col("node_id"), "own").where(F.col("own.flags") == STRING), F.concat(F.lit("plain string "), F.col("text")))
    parts = types.where(F.col("flags").bitwiseAND(F.lit(INTERSECTION)) != 0).select("type_id", F.explode("members").alias("member")).join(types.select(F.col("type_id").alias("member"), F.col("flags").alias("part")), "member")
    branded = parts.groupBy("type_id").agg(F.bool_or(has("part", STRING)).alias("s"), F.bool_or(has("part", OBJECT)).alias("o")).where("s AND o").select("type_id")
    keys = relations.covered(facts["node_types"], branded, ["type_id"]).select("file", "node_id")
    shaped = lambda pattern: relations.covered(facts["node_types"], types.where(F.col("shape").rlike(pattern)), ["type_id"]).select("file", "node_id")
    calls = first_argument(facts, facts["calls"].where(F.col("name").isin(*CONTAINER_KEY_METHODS) & (F.size("chain") > 1)))
    held = relations.covered(nodes.where(F.col("field") == "receiver"), shaped(KEYED), ["file", "node_id"]).select("file", F.col("parent_id").alias("node_id"))
    containers = relations.covered(relations.covered(calls, keys.withColumnRenamed("node_id", "argument"), ["file", "argument"]), held, ["file", "node_id"])
    rows = with_children(nodes, "expression", "argument").where(kind("ElementAccessExpression")).withColumns({"of": F.col("expression.id"), "key": F.col("argument.id")})
    records = relations.covered(relations.covered(rows, keys.withColumnRenamed("node_id", "key"), ["file", "key"]), shaped(r"\[\w+: string\]|^Record<string,").withColumnRenamed("node_id", "of"), ["file", "of"])
    return ids.unionByName(found(containers, "branded key of a container")).unionByName(found(records, "branded key of a record"))


@CODE_RULES.rule("prefer-literal-union", "quality", "Plain strings compared with literals", needs=(*TYPED, "node_symbols", "symbols", "contexts"))
def prefer_literal_union(facts: Facts, options: dict) -> DataFrame:
    """Left are names from elsewhere, and guards in whose branch the value goes where literals are expected: as an
    argument, or as the result of a function that returns such."""
    nodes, types = facts["nodes"], facts["types"]
    rows = with_children(nodes, "left", "operator", "right").where(operator("EqualsEqualsEqualsToken", "ExclamationEqualsEqualsToken") & ((F.col("left.kind") == "StringLiteral") != (F.col("right.kind") == "StringLiteral")))
    on_left = F.col("left.kind") == "StringLiteral"
    rows = rows.withColumns({"literal": F.when(on_left, F.col("left")).otherwise(F.col("right")), "operand": F.when(on_left, F.col("right")).otherwise(F.col("left"))})
    plain = types.where((F.col("flags") == STRING) & (F.size("members") == 0)).select("type_id")
    strings = relations.covered(facts["node_types"], plain, ["type_id"]).select("file", F.col("node_id").alias("operand_id"))
    rows = relations.covered(rows.where(~F.col("literal.text").isin("", "''", '""')).withColumn("operand_id", F.col("operand.id")), strings, ["file", "operand_id"])
    foreign = relations.covered(facts["node_symbols"], facts["symbols"].where((F.col("origin") == "lib") | F.col("origin").startswith("pkg:")), ["symbol_id"]).select("file", F.col("node_id").alias("operand_id"))
    rows = relations.uncovered(rows, foreign, ["file", "operand_id"])
    # identifiers that go where literals are expected, with the branches around them
    own = types.where(F.col("flags").bitwiseAND(F.lit(STRING_LITERAL)) != 0).select("type_id")
    inner = relations.covered(types.select("type_id", F.explode("members").alias("member")), own.withColumnRenamed("type_id", "member"), ["member"]).select("type_id")
    narrow = own.union(inner).distinct()
    given = relations.covered(nodes.where(kind("Identifier") & (F.col("field") == "argument")), relations.covered(facts["contexts"], narrow, ["type_id"]), ["file", "node_id"])
    returning = relations.covered(facts["node_types"], narrow, ["type_id"]).select("file", F.col("node_id").alias("owner"))
    returned = relations.covered(with_parent(nodes).where(kind("Identifier") & (F.col("field") == "expression") & (F.col("parent_kind") == "ReturnStatement")).withColumn("owner", owner_of()), returning, ["file", "owner"])
    fed = given.select("file", "node_id", "ancestors").unionByName(returned.select("file", "node_id", "ancestors")).join(facts["node_symbols"], ["file", "node_id"]).select("file", "symbol_id", F.explode("ancestors").alias("a")).select("file", "symbol_id", F.col("a.id").alias("branch"))
    branches = nodes.where(F.col("field") == "then").select("file", F.col("parent_id").alias("guard"), F.col("node_id").alias("branch"))
    nearest = F.try_element_at(F.filter("ancestors", lambda a: a["kind"].isin("IfStatement", *FUNCTIONS)), F.lit(-1))
    guarded = rows.where((F.col("operand.kind") == "Identifier") & (nearest["kind"] == "IfStatement")).withColumn("guard", nearest["id"]).join(facts["node_symbols"].select("file", F.col("node_id").alias("operand_id"), "symbol_id"), ["file", "operand_id"])
    narrowed = relations.covered(guarded.join(branches, ["file", "guard"]), fed, ["file", "symbol_id", "branch"]).select("file", "node_id")
    return found(relations.uncovered(rows, narrowed, ["file", "node_id"]), "make it a union of literals")


@CODE_RULES.rule("zustand-patterns", "quality", "Store selectors that render too often, and effects that read a store once", sub_checks=3, needs=("nodes",), sub_ids={"fields without shallow": "multi-field-selector-without-shallow"})
def zustand_patterns(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "expression", "argument").where(kind("CallExpression"))
    selector = F.col("argument.text")
    fields = F.size(F.split(F.regexp_extract(selector, r"=>\s*\(\{([^}]*)\}", 1), ","))
    # an effect that runs once reads a store; calls of its actions are no reads
    store = r"^use\w*Store$"
    lists = facts["nodes"].where((F.col("field") == "argument") & (F.col("ord") == 1) & kind("ArrayLiteralExpression")).select("file", F.col("parent_id").alias("node_id"), F.col("node_id").alias("list"))
    filled = facts["nodes"].select("file", F.col("parent_id").alias("list")).distinct()
    effects = relations.uncovered(rows.where((F.col("expression.text") == "useEffect") & F.col("argument.kind").isin("ArrowFunction", "FunctionExpression")).join(lists, ["file", "node_id"]), filled, ["file", "list"])
    up = lambda k: F.try_element_at("ancestors", F.lit(-k))["kind"]
    action = F.coalesce((up(1) == "CallExpression") & (up(2) == "PropertyAccessExpression") & (up(3) == "CallExpression"), F.lit(False))
    states = facts["nodes"].where(kind("PropertyAccessExpression") & F.col("text").rlike(r"^use\w*Store\.getState$") & ~action)
    reads = states.select("file", "ancestors").unionByName(rows.where(F.col("expression.text").rlike(store)).select("file", "ancestors")).select("file", F.explode("ancestors").alias("a")).select("file", F.col("a.id").alias("callback"))
    once = relations.covered(effects.withColumn("callback", F.col("argument.id")), reads, ["file", "callback"])
    return found(once, "store read once").unionByName(each(rows, {
        "shallow for one field": (F.col("expression.text") == "useShallow") & selector.rlike(r"^\(?\w+\)?\s*=>\s*\w+\.\w+$"),
        "fields without shallow": F.col("expression.text").rlike(r"^use\w*Store$") & (F.col("argument.kind") == "ArrowFunction") & (fields >= options.get("multiFieldMin", 2)),
    }))


@CODE_RULES.rule("prop-drilling", "quality", "Components that pass on what they don't use", needs=("nodes", "node_symbols", "node_types", "types"))
def prop_drilling(facts: Facts, options: dict) -> DataFrame:
    nodes = facts["nodes"]
    parameters = symbols_at(facts, nodes.where(kind("Parameter", "BindingElement"))).withColumn("owner", owner_of()).join(facts["node_types"], ["file", "node_id"], "left")
    callable_ = facts["types"].select("type_id", F.col("shape").contains("=>").alias("callable"))
    uses = symbols_at(facts, with_parent(nodes).where(kind("Identifier"))).groupBy("file", "symbol_id").agg(F.bool_and(F.coalesce(F.col("parent_kind") == "JsxExpression", F.lit(False))).alias("only_passed"))
    passed = parameters.join(uses.where("only_passed"), ["file", "symbol_id"]).join(callable_, "type_id", "left")
    many = passed.groupBy("file", F.col("owner").alias("node_id")).agg(F.count("*").alias("n"), F.count_if("callable").alias("callables"))
    hit = many.where((F.col("n") >= options.get("minForwarded", 4)) & (F.col("callables") >= options.get("minCallbacks", 2)))
    return found(at(facts, hit), F.concat(F.col("n").cast("string"), F.lit(" passed on")))


@CODE_RULES.rule("no-db-origin-client-boundary", "architecture", "Database rows in the types of client components", needs=("nodes", "files", "types", "node_types"))
def no_db_origin_client_boundary(facts: Facts, options: dict) -> DataFrame:
    types = facts["types"]
    inner = types.select(F.col("type_id").alias("src"), F.explode(F.concat(F.coalesce("members", F.array().cast("array<bigint>")), F.coalesce(F.transform("props", lambda p: p["type_id"]), F.array().cast("array<bigint>")))).alias("dst"))
    rows = types.where(F.col("shape").rlike(options.get("rowTypes", ROW_TYPES))).select(F.col("type_id").alias("node"))
    holders = graph.reach(graph.turned(inner), rows).select(F.col("node").alias("type_id"))
    client = facts["files"].where("directive = 'use client'").select("file")
    first = relations.covered(facts["nodes"].where(kind("Parameter") & (F.col("ord") == 0)), client, ["file"]).join(facts["node_types"], ["file", "node_id"])
    return found(relations.covered(first, holders, ["type_id"]), "holds a database row")


def _annotations(facts: Facts) -> DataFrame:
    """Annotated object literals: of Partial or Record, whose keys are known, or of a type that satisfies can check."""
    nodes = facts["nodes"]
    rows = with_children(nodes, "type", "initializer").where(kind("VariableDeclaration") & (F.col("type.kind") == "TypeReference") & (F.col("initializer.kind") == "ObjectLiteralExpression"))
    keys = nodes.where(F.col("field") == "property").groupBy("file", F.col("parent_id").alias("literal")).agg(F.count("*").alias("keys"))
    rows = rows.withColumns({"literal": F.col("initializer.id"), "annotation": F.col("type.id"), "name": F.col("type.text")}).join(keys, ["file", "literal"]).select("file", "parent_id", "literal", "annotation", "name", "keys")
    own = facts["node_types"].join(facts["types"].select("type_id", "flags", F.size("props").alias("total")), "type_id")
    arguments = nodes.where((F.col("field") == "typeArgument") & (F.col("ord") == 0)).join(own, ["file", "node_id"]).select("file", F.col("parent_id").alias("annotation"), "flags", "total")
    counts = nodes.where(F.col("field") == "typeArgument").groupBy("file", F.col("parent_id").alias("annotation")).agg(F.count("*").alias("arguments"))
    known = rows.join(arguments, ["file", "annotation"]).join(counts, ["file", "annotation"])
    partial = known.where("name = 'Partial' AND arguments = 1 AND keys < total")
    record = known.where((F.col("name") == "Record") & (F.col("arguments") == 2) & has("flags", STRING) & (F.col("keys") >= 2))
    constant = nodes.where(kind("VariableDeclarationList") & F.col("text").startswith("const ")).select("file", F.col("node_id").alias("parent_id"))
    typed = lambda name: facts["node_types"].select("file", F.col("node_id").alias(name), F.col("type_id").alias("a" if name == "literal" else "b"))
    other = relations.covered(rows.where((F.col("keys") >= 2) & ~F.col("name").isin("Partial", "Record")), constant, ["file", "parent_id"]).join(typed("literal"), ["file", "literal"]).join(typed("annotation"), ["file", "annotation"])
    fit = _assignable(facts, other).where("forth")
    at_type = lambda df: nodes.join(df.select("file", F.col("annotation").alias("node_id")), ["file", "node_id"])
    return found(at_type(partial), "pick the keys").unionByName(found(at_type(record), "name the keys")).unionByName(found(at_type(fit), "use satisfies"))


def _known_checks(facts: Facts) -> DataFrame:
    """Checks whose result the types tell: of a type, of null, and of a property where the union has a mark of its own."""
    nodes, types = facts["nodes"], facts["types"]
    strict = ("EqualsEqualsEqualsToken", "ExclamationEqualsEqualsToken")
    rows = with_children(nodes, "left", "operator", "right").withColumn("side", F.col("left.id"))
    operands = nodes.where(kind("Identifier") & (F.col("field") == "expression")).select("file", F.col("parent_id").alias("side"), F.col("node_id").alias("operand"))
    own = facts["node_types"].join(types.where(F.size("members") == 0).select("type_id", "flags"), "type_id").select("file", F.col("node_id").alias("operand"), "flags")
    asked = rows.where(operator(*strict) & (F.col("left.kind") == "TypeOfExpression") & (F.col("right.kind") == "StringLiteral")).join(operands, ["file", "side"]).join(own, ["file", "operand"])
    told = F.when(F.col("right.text") == "string", has("flags", STRINGS)).when(F.col("right.text") == "number", has("flags", NUMBERS)).when(F.col("right.text") == "boolean", has("flags", BOOLEANS)).otherwise(F.lit(False))
    checked = rows.where(operator(*EQUALITY) & F.col("right.kind").isin("NullKeyword", "UndefinedKeyword") & (F.col("left.kind") == "Identifier"))
    never = with_type(checked, typed_nodes(facts), F.col("side"), "own").where(F.col("own").isNotNull() & ~has("own.flags", ANY | UNKNOWN | NULL | UNDEFINED))
    # a property of a literal type in every member of a union
    parts = types.where(F.size("members") > 1).select("type_id", F.size("members").alias("n"), F.explode("members").alias("member"))
    props = types.select(F.col("type_id").alias("member"), F.explode("props").alias("p")).select("member", F.col("p.name").alias("prop"), F.col("p.type_id").alias("of"))
    literal = types.where(F.col("flags").bitwiseAND(F.lit(STRING_LITERAL | NUMBER_LITERAL | BOOLEAN_LITERAL)) != 0).select(F.col("type_id").alias("of"))
    marked = parts.join(relations.covered(props, literal, ["of"]), "member").groupBy("type_id", "n", "prop").agg(F.count_distinct("member").alias("has")).where("has = n").select("type_id").distinct()
    marked = relations.covered(facts["node_types"], marked, ["type_id"]).select("file", F.col("node_id").alias("object"))
    inside_ = relations.covered(rows.where(operator("InKeyword") & (F.col("left.kind") == "StringLiteral")).withColumn("object", F.col("right.id")), marked, ["file", "object"])
    return found(asked.where(told), "type known").unionByName(found(never, "never null")).unionByName(found(inside_, "use the union's mark"))


@CODE_RULES.rule("type-precision", "quality", "Types and checks that can be said more precisely", sub_checks=9, needs=("nodes", "node_symbols", "node_types", "types", "assignable"), sub_ids={"never null": "redundant-nullcheck"})
def type_precision(facts: Facts, options: dict) -> DataFrame:
    nodes = facts["nodes"]
    rows = with_children(with_parent(nodes), "type", "literal")
    simple = each(rows, {"name the union": kind("UnionType") & (F.col("n_literal") >= 2) & (F.col("parent_kind") == "Parameter")})
    members = nodes.where(F.col("field") == "member").groupBy("file", F.col("parent_id").alias("node_id")).agg(F.bool_or(kind("IndexSignature")).alias("open"), F.bool_or(kind("PropertySignature")).alias("named")).where("open AND named")
    mixed = found(relations.covered(nodes.where(kind("InterfaceDeclaration", "TypeLiteral")), members, ["file", "node_id"]), "index signature beside names")
    changed = symbols_at(facts, nodes.where(kind("Identifier"))).select("file", F.col("parent_id").alias("node_id"), "symbol_id").join(
        nodes.where(kind("PropertyAccessExpression") & F.substring_index("text", ".", -1).isin(*options.get("mutatingArrayMethods", MUTATING))).select("file", "node_id"), ["file", "node_id"]).select("file", "symbol_id")
    arrays = symbols_at(facts, with_children(nodes, "type").where(kind("Parameter") & (F.col("type.kind") == "ArrayType")))
    return _annotations(facts).unionByName(_known_checks(facts)).unionByName(simple).unionByName(mixed).unionByName(found(relations.uncovered(arrays, changed, ["file", "symbol_id"]), "make the array readonly"))
