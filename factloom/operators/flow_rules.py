"""Code rules that ask for types, symbols, calls and flows of values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Facts
from ..sources.scratch import written
from . import derive, graph, relations, similarity
from .code_rules import CODE_RULES, FUNCTIONS, LOOPS, found, inside, with_parent
from .syntax_rules import boolean_context, kind, operator, with_children

# Type flags, as the public compiler interface has them.
ANY, UNKNOWN, STRING, NUMBER, BOOLEAN, BIGINT = 1, 2, 4, 8, 16, 64
STRING_LITERAL, NUMBER_LITERAL, BOOLEAN_LITERAL, BIGINT_LITERAL = 128, 256, 512, 2048
UNDEFINED, NULL, OBJECT, UNION, INTERSECTION = 32768, 65536, 524288, 1048576, 2097152
ENUM_LITERAL, TEMPLATE_LITERAL = 1024, 134217728
STRINGS, NUMBERS, BOOLEANS, BIGINTS = STRING | STRING_LITERAL, NUMBER | NUMBER_LITERAL, BOOLEAN | BOOLEAN_LITERAL, BIGINT | BIGINT_LITERAL
#: Types that have a text of their own, and those whose equal values are the same.
PLAIN_TEXT = STRINGS | NUMBERS | BOOLEANS | BIGINTS | UNDEFINED | NULL | ANY | UNKNOWN | ENUM_LITERAL | TEMPLATE_LITERAL
SAME_BY_VALUE = STRINGS | NUMBERS | BOOLEANS | UNDEFINED | NULL
PRIMITIVES = STRINGS | NUMBERS | BOOLEANS | BIGINTS | UNDEFINED | NULL

# Fixed values of the rules.
WEAK_ALGORITHMS, HASH_METHODS = ("md5", "md4", "sha1", "rc4", "des", "des-ede", "des-ede3"), ("createHash", "createHmac")
SHELL_METHODS = ("exec", "execSync")
FS_PATH_METHODS = (
    "readFile", "readFileSync", "writeFile", "writeFileSync", "appendFile", "appendFileSync", "readdir", "readdirSync", "unlink", "unlinkSync", "stat", "statSync",
    "lstat", "lstatSync", "access", "accessSync", "open", "openSync", "createReadStream", "createWriteStream", "rm", "rmSync", "rmdir", "rmdirSync", "mkdir",
    "mkdirSync", "copyFile", "copyFileSync", "realpath", "realpathSync", "readlink", "readlinkSync", "truncate", "truncateSync",
)
EVAL_FUNCTIONS = ("eval", "setTimeout", "setInterval", "execScript", "Function")
CLEANUP = {"addEventListener": "removeEventListener", "setInterval": "clearInterval", "setTimeout": "clearTimeout", "observe": "disconnect", "on": "off"}
SYNC_IO = (
    "readFileSync", "writeFileSync", "appendFileSync", "mkdirSync", "rmdirSync", "unlinkSync", "renameSync", "copyFileSync", "statSync", "existsSync", "accessSync", "readdirSync",
)
GROWING = ("push", "unshift", "splice")
ARRAY_SHAPE = r"\[\]$|^(readonly )?(Array|ReadonlyArray)<|^\["
DB_METHODS = ("select", "insert", "update", "delete")


def has(flags: str | Column, bits: int) -> Column:
    """Whether a type has one of the bits; an unknown type has none."""
    return F.coalesce((F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(F.lit(bits)) != 0, F.lit(False))


def typed_nodes(facts: Facts) -> DataFrame:
    """(file, node_id, type_id, flags, is_thenable, own_to_string): flags of a union or intersection are those of its members too."""
    types = facts["types"]
    part = types.select(F.col("type_id").alias("member"), F.col("flags").alias("part"), F.col("is_thenable").alias("part_thenable"))
    parts = types.select("type_id", F.explode("members").alias("member")).join(part, "member").groupBy("type_id").agg(F.bit_or("part").alias("parts"), F.bool_or("part_thenable").alias("some"))
    whole = types.join(parts, "type_id", "left").select(
        "type_id", F.col("flags").bitwiseOR(F.coalesce("parts", F.lit(0).cast("long"))).alias("flags"), (F.coalesce("is_thenable", F.lit(False)) | F.coalesce("some", F.lit(False))).alias("is_thenable"), "own_to_string")
    return facts["node_types"].join(whole, "type_id")


def by_members(types: DataFrame, own: Column) -> DataFrame:
    """(type_id) of the types for which ``own`` holds; of unions if it holds in this way for all members, and of
    intersections if for any, members of members too. A type that could only have it from itself has it not."""
    nodes = types.select(F.col("type_id").alias("node"), has("flags", UNION).alias("every"))
    premises = types.where(has("flags", UNION | INTERSECTION)).select(F.col("type_id").alias("node"), F.explode("members").alias("needs"))
    return derive.derived(nodes, premises, types.where(own).select(F.col("type_id").alias("node"))).select(F.col("node").alias("type_id"))


def with_type(rows: DataFrame, typed: DataFrame, node: Column, name: str) -> DataFrame:
    """Rows with the type of a node in the same file, as a struct; null if it has none."""
    side = typed.select(F.col("file").alias("__f"), F.col("node_id").alias("__n"), F.struct("type_id", "flags", "is_thenable", "own_to_string").alias(name))
    return rows.join(side, (rows["file"] == F.col("__f")) & (node == F.col("__n")), "left").drop("__f", "__n")


def operand_type(facts: Facts, roles: Sequence[str], of: Column) -> DataFrame:
    """Nodes that fulfil ``of`` with their children of the roles and those children's types (role_type)."""
    rows, typed = with_children(facts["nodes"], *roles, "operator").where(of), typed_nodes(facts)
    for role in roles:
        rows = with_type(rows, typed, F.col(f"{role}.id"), f"{role}_type")
    return rows


def origins(facts: Facts) -> DataFrame:
    """Calls with the origin of what they call: lib, pkg:name, local; null if unknown."""
    return facts["calls"].join(facts["symbols"].select(F.col("symbol_id").alias("target_symbol"), "origin"), "target_symbol", "left")


def first_argument(facts: Facts, calls: DataFrame) -> DataFrame:
    """Calls with their place and their first argument."""
    arguments = facts["nodes"].where("field = 'argument' AND ord = 0").select("file", F.col("parent_id").alias("node_id"), F.col("node_id").alias("argument"), F.col("kind").alias("argument_kind"), F.col("text").alias("argument_text"))
    return at(facts, calls).join(arguments, ["file", "node_id"])


def at(facts: Facts, rows: DataFrame) -> DataFrame:
    return rows.join(facts["nodes"].select("file", "node_id", "line", "col", "ancestors", "parent_id"), ["file", "node_id"])


# --- types ------------------------------------------------------------------------------------------

TYPED = ("nodes", "node_types", "types")


@CODE_RULES.rule("await-non-thenable", "quality", "Values awaited that are no promises", needs=TYPED)
def await_non_thenable(facts: Facts, options: dict) -> DataFrame:
    rows = operand_type(facts, ["expression"], kind("AwaitExpression"))
    return found(rows.where(~F.col("expression_type.is_thenable") & ~has("expression_type.flags", ANY | UNKNOWN)), "nothing to await")


@CODE_RULES.rule("no-floating-promises", "quality", "Promises that nobody waits for", needs=(*TYPED, "calls"))
def no_floating_promises(facts: Facts, options: dict) -> DataFrame:
    rows = operand_type(facts, ["expression"], kind("ExpressionStatement")).where(F.col("expression_type.is_thenable") & ~F.col("expression.kind").isin("AwaitExpression", "VoidExpression", "BinaryExpression"))
    caught = facts["calls"].where(F.array_contains("chain", "catch")).select("file", F.col("node_id").alias("call"))
    return found(relations.uncovered(rows.withColumn("call", F.col("expression.id")), caught, ["file", "call"]), "await it or catch its errors")


@CODE_RULES.rule("restrict-plus-operands", "quality", "Operands of + that don't go together", needs=TYPED)
def restrict_plus_operands(facts: Facts, options: dict) -> DataFrame:
    rows = operand_type(facts, ["left", "right"], operator("PlusToken"))
    a, b = "left_type.flags", "right_type.flags"
    text_and_number = (has(a, STRINGS) & has(b, NUMBERS)) | (has(a, NUMBERS) & has(b, STRINGS))
    big = F.col("left_type").isNotNull() & F.col("right_type").isNotNull() & (has(a, BIGINTS) != has(b, BIGINTS))
    return found(rows.where(text_and_number | big), "operands of two types")


@CODE_RULES.rule("restrict-template-expr", "quality", "Template values without a plain text form", needs=TYPED)
def restrict_template_expr(facts: Facts, options: dict) -> DataFrame:
    rows = operand_type(facts, ["expression"], kind("TemplateSpan"))
    return found(rows.where(F.col("expression_type").isNotNull() & ~has("expression_type.flags", PRIMITIVES & ~(UNDEFINED | NULL) | ANY)), "no plain text form")


@CODE_RULES.rule("no-base-to-string", "quality", "Texts of objects that don't define one", needs=TYPED)
def no_base_to_string(facts: Facts, options: dict) -> DataFrame:
    rows = operand_type(facts, ["left", "right", "expression"], operator("PlusToken") | (kind("PropertyAccessExpression") & F.col("text").endswith(".toString")))
    texts = by_members(facts["types"], has("flags", PLAIN_TEXT) | F.coalesce("own_to_string", F.lit(False)))
    texts = written(texts.select(F.col("type_id").alias("__t"), F.lit(True).alias("__text")), "types-with-text")
    for role in ("left", "right", "expression"):
        rows = rows.join(texts, F.col(f"{role}_type.type_id") == F.col("__t"), "left").withColumn(f"{role}_text", F.col("__text")).drop("__t", "__text")
    bare = lambda role: F.col(f"{role}_text").isNull() & has(f"{role}_type.flags", OBJECT)
    hit = rows.where(bare("left") | bare("right") | (bare("expression") & (F.col("kind") != "BinaryExpression")))
    return found(hit.drop("left_text", "right_text", "expression_text"), "no text of its own")


@CODE_RULES.rule("prefer-nullish-coalescing", "quality", "Defaults by || where ?? is meant", needs=TYPED)
def prefer_nullish_coalescing(facts: Facts, options: dict) -> DataFrame:
    rows = relations.uncovered(operand_type(facts, ["left"], operator("BarBarToken")), boolean_context(facts["nodes"]), ["file", "node_id"])
    return found(rows.where(has("left_type.flags", NULL | UNDEFINED) & ~has("left_type.flags", BOOLEANS)), "use ??")


def _assignable(facts: Facts, rows: DataFrame) -> DataFrame:
    """Rows with forth and back: whether type a is assignable to b, and b to a; each type is to itself."""
    pairs = facts["assignable"].distinct()
    forth = pairs.select(F.col("src_type").alias("a"), F.col("dst_type").alias("b"), F.lit(True).alias("forth"))
    back = pairs.select(F.col("dst_type").alias("a"), F.col("src_type").alias("b"), F.lit(True).alias("back"))
    same = F.col("a") == F.col("b")
    joined = rows.join(forth, ["a", "b"], "left").join(back, ["a", "b"], "left")
    return joined.withColumns({"forth": F.coalesce("forth", same), "back": F.coalesce("back", same)})


def _assertions(facts: Facts) -> DataFrame:
    rows = with_type(operand_type(facts, ["expression", "type"], kind("AsExpression")), typed_nodes(facts), F.col("node_id"), "own")
    plain = rows.where(~has("own.flags", ANY | UNKNOWN) & ~has("expression_type.flags", ANY | UNKNOWN) & (F.coalesce("type.text", F.lit("")) != "const"))
    return _assignable(facts, plain.withColumns({"a": F.col("expression_type.type_id"), "b": F.col("own.type_id")}).where("a IS NOT NULL AND b IS NOT NULL"))


@CODE_RULES.rule("unnecessary-type-assertion", "quality", "Assertions of the type that is there", needs=(*TYPED, "assignable"))
def unnecessary_type_assertion(facts: Facts, options: dict) -> DataFrame:
    return found(_assertions(facts).where("forth AND back"), "it has this type")


@CODE_RULES.rule("prefer-satisfies-over-as", "quality", "Literals asserted to be another type", needs=(*TYPED, "assignable"))
def prefer_satisfies_over_as(facts: Facts, options: dict) -> DataFrame:
    literal = F.col("expression.kind").isin("ObjectLiteralExpression", "ArrayLiteralExpression")
    return found(_assertions(facts).where(literal & ~(F.col("forth") & F.col("back"))), "use satisfies")


@CODE_RULES.rule("exhaustive-switch", "quality", "Members of a union without a case", needs=(*TYPED, "assignable"))
def exhaustive_switch(facts: Facts, options: dict) -> DataFrame:
    nodes = facts["nodes"]
    default = nodes.where(kind("DefaultClause")).select("file", F.col("parent_id").alias("node_id"))
    switches = relations.uncovered(operand_type(facts, ["expression"], kind("SwitchStatement")), default, ["file", "node_id"])
    unions = facts["types"].where(F.size("members") > 1).select("type_id", F.explode("members").alias("member"))
    wanted = switches.withColumn("type_id", F.col("expression_type.type_id")).join(unions, "type_id")
    cases = operand_type(facts, ["expression"], kind("CaseClause")).select("file", F.col("parent_id").alias("node_id"), F.col("expression_type.type_id").alias("src_type"))
    met = cases.select("file", "node_id", F.col("src_type").alias("member")).union(cases.join(facts["assignable"], "src_type").select("file", "node_id", "dst_type"))
    return found(relations.uncovered(wanted, met, ["file", "node_id", "member"]).dropDuplicates(["file", "node_id"]), "cases are missing")


@CODE_RULES.rule("any-propagation", "quality", "Values of type any passed on", needs=(*TYPED, "calls"))
def any_propagation(facts: Facts, options: dict) -> DataFrame:
    rows = operand_type(facts, ["initializer", "expression"], kind("VariableDeclaration", "ReturnStatement", "PropertyAccessExpression", "CallExpression"))
    hit = rows.where(has("initializer_type.flags", ANY) | has("expression_type.flags", ANY)).withColumn("from", F.coalesce("initializer.id", "expression.id"))
    exempt = facts["calls"].where(F.array_join("chain", ".").isin("JSON.parse", "Reflect.get", "import")).select("file", F.col("node_id").alias("from"))
    return found(relations.uncovered(hit, exempt, ["file", "from"]), "any goes on")


@CODE_RULES.rule("cache-primitive-args", "performance", "Cached functions that take objects", needs=(*TYPED, "calls"))
def cache_primitive_args(facts: Facts, options: dict) -> DataFrame:
    functions = first_argument(facts, facts["calls"].where("name = 'cache'")).select("file", F.col("argument").alias("parent_id"))
    parameters = relations.covered(facts["nodes"].where(kind("Parameter")), functions, ["file", "parent_id"])
    same = by_members(facts["types"], has("flags", SAME_BY_VALUE | ANY)).withColumnRenamed("type_id", "__t")
    typed = with_type(parameters, typed_nodes(facts), F.col("node_id"), "own").where("own IS NOT NULL")
    return found(typed.join(same, F.col("own.type_id") == F.col("__t"), "left_anti"), "an object is never the same again")


# --- symbols and calls ------------------------------------------------------------------------------


@CODE_RULES.rule("deprecated-usage", "quality", "Uses of what is deprecated", needs=("nodes", "node_symbols", "symbols"))
def deprecated_usage(facts: Facts, options: dict) -> DataFrame:
    old = facts["symbols"].where(F.array_contains("tags", "deprecated") & (F.coalesce("origin", F.lit("")) != "lib")).select("symbol_id", "name", "decl_file", "decl_pos")
    uses = facts["nodes"].where(kind("Identifier")).join(facts["node_symbols"], ["file", "node_id"]).join(old, "symbol_id")
    own = (F.col("file") == F.col("decl_file")) & (F.col("start") == F.col("decl_pos"))
    return found(uses.where(~F.coalesce(own, F.lit(False))), F.concat(F.lit("deprecated "), F.col("name")))


@CODE_RULES.rule("no-weak-crypto", "security", "Weak hash algorithms", needs=("nodes", "calls", "symbols"))
def no_weak_crypto(facts: Facts, options: dict) -> DataFrame:
    calls = origins(facts).where(F.col("name").isin(*options.get("hashMethods", HASH_METHODS)) & F.col("origin").isin("pkg:crypto", "pkg:node:crypto"))
    return found(first_argument(facts, calls).where(F.lower("argument_text").isin(*options.get("weakAlgorithms", WEAK_ALGORITHMS)) & (F.col("argument_kind") == "StringLiteral")), F.concat(F.lit("weak "), F.lower("argument_text")))


@CODE_RULES.rule("no-implied-eval", "security", "Code given as text", needs=(*TYPED, "calls", "symbols"))
def no_implied_eval(facts: Facts, options: dict) -> DataFrame:
    calls = origins(facts).where(F.col("name").isin(*options.get("evalFunctions", EVAL_FUNCTIONS)) & (F.col("origin") == "lib"))
    rows = with_type(first_argument(facts, calls), typed_nodes(facts), F.col("argument"), "own")
    return found(rows.where(has("own.flags", STRINGS)), F.concat(F.lit("text as code: "), F.col("name")))


@CODE_RULES.rule("no-client-data-fetch", "quality", "Data fetched by client code", needs=("nodes", "files", "calls", "symbols"))
def no_client_data_fetch(facts: Facts, options: dict) -> DataFrame:
    server = facts["files"].where("directive = 'use server'").select("file")
    calls = origins(facts).where(F.col("file").endswith(".tsx") & ((F.col("origin") == "pkg:axios") | ((F.col("name") == "fetch") & (F.col("origin") == "lib"))))
    rows = first_argument(facts, relations.uncovered(calls, server, ["file"]))
    return found(rows.where((F.col("origin") == "pkg:axios") | F.col("argument_text").startswith("/api")), "fetch it on the server")


@CODE_RULES.rule("no-dynamic-sql", "security", "SQL that is no literal", needs=("nodes", "calls"))
def no_dynamic_sql(facts: Facts, options: dict) -> DataFrame:
    """Allowed are literals, sql templates, and names with such an initial value."""
    fixed = kind("StringLiteral", "NoSubstitutionTemplateLiteral") | (kind("TaggedTemplateExpression") & F.col("text").startswith("sql"))
    calls = first_argument(facts, facts["calls"].where((F.col("name") == "execute") & (F.col("chain")[0] == "db")))
    literal = facts["nodes"].where(fixed).select("file", F.col("node_id").alias("argument"))
    named = facts["nodes"].where(fixed & (F.col("field") == "initializer")).select("file", F.col("parent_id").alias("node_id"))
    names = relations.covered(facts["nodes"].where(kind("VariableDeclaration")), named, ["file", "node_id"]).select("file", F.col("text").alias("argument_text"))
    return found(relations.uncovered(relations.uncovered(calls, literal, ["file", "argument"]), names, ["file", "argument_text"]), "SQL from values")


def _awaited(facts: Facts, methods: Sequence[str]) -> DataFrame:
    calls = facts["calls"].where((F.col("chain")[0] == "db") & F.arrays_overlap("chain", F.array(*[F.lit(m) for m in methods])))
    return with_parent(facts["nodes"]).where(F.col("parent_kind") == "AwaitExpression").join(calls.select("file", "node_id", "name", "chain"), ["file", "node_id"])


@CODE_RULES.rule("no-db-antipatterns", "performance", "Transactions, and database calls in loops", needs=("nodes", "calls"))
def no_db_antipatterns(facts: Facts, options: dict) -> DataFrame:
    looped = _awaited(facts, options.get("drizzleMethods", DB_METHODS)).where(inside("ancestors", LOOPS, FUNCTIONS))
    transactions = at(facts, facts["calls"].where((F.col("name") == "transaction") & (F.col("chain")[0] == "db")))
    return found(looped, "one call for all").unionByName(found(transactions, "transaction"))


@CODE_RULES.rule("missing-returning", "performance", "Results of writes that return nothing", needs=("nodes", "files", "calls"))
def missing_returning(facts: Facts, options: dict) -> DataFrame:
    server = facts["files"].where("directive = 'use server'").select("file")
    assigned = F.try_element_at("ancestors", F.lit(-2))["kind"] == "VariableDeclaration"
    return found(relations.covered(_awaited(facts, ("insert", "update")), server, ["file"]).where(assigned & ~F.array_contains("chain", "returning")), "add returning()")


@CODE_RULES.rule("cache-caller-count", "performance", "Cached functions that are called too rarely", needs=("nodes", "node_symbols", "calls"))
def cache_caller_count(facts: Facts, options: dict) -> DataFrame:
    cached = facts["calls"].where("name = 'cache'").select("file", F.col("node_id").alias("call"))
    values = with_children(facts["nodes"], "initializer").where(kind("VariableDeclaration")).withColumn("call", F.col("initializer.id"))
    declared = relations.covered(values, cached, ["file", "call"]).join(facts["node_symbols"], ["file", "node_id"])
    counted = relations.use_counts(declared, facts["calls"].select(F.col("target_symbol").alias("symbol_id")), "symbol_id")
    return found(counted.where(F.col("uses") < options.get("minCallers", 2)), F.concat(F.lit("calls: "), F.col("uses").cast("string")))


@CODE_RULES.rule("effect-cleanup", "quality", "Effects that leave something running", needs=("nodes", "calls"))
def effect_cleanup(facts: Facts, options: dict) -> DataFrame:
    """Set up in an effect's function; the paired call must stand in a function within it."""
    pairs = options.get("cleanupMap", CLEANUP)
    effects = first_argument(facts, facts["calls"].where("name = 'useEffect'")).select("file", F.col("argument").alias("caller_id"))
    paired = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    setups = at(facts, relations.covered(facts["calls"].where(F.col("name").isin(*pairs) & F.col("file").endswith(".tsx")), effects, ["file", "caller_id"])).withColumn("needed", paired[F.col("name")])
    cleanups = at(facts, facts["calls"].where(F.col("name").isin(*pairs.values())))
    outer = cleanups.select("file", F.col("name").alias("needed"), F.explode(F.filter("ancestors", lambda a: a["kind"].isin(*FUNCTIONS) & (a["id"] != F.col("caller_id")))).alias("f")).select("file", "needed", F.col("f.id").alias("caller_id"))
    return found(relations.uncovered(setups, outer, ["file", "caller_id", "needed"]), F.concat(F.lit("no "), F.col("needed")))


@CODE_RULES.rule("input-validation", "security", "Server actions that take their input as it is", needs=("nodes", "files", "exports", "calls", "node_symbols"))
def input_validation(facts: Facts, options: dict) -> DataFrame:
    """Checked in its own body, or in that of a function it calls."""
    server = facts["files"].where("directive = 'use server'").select("file")
    functions = relations.covered(with_children(facts["nodes"], "parameter").where(kind("FunctionDeclaration") & (F.col("n_parameter") > 0)), server, ["file"])
    actions = relations.covered(functions, facts["exports"].select("file", F.col("name").alias("text")), ["file", "text"])
    own = facts["calls"].where("name = 'safeParse'").select("file", F.col("caller_id").alias("node_id")).distinct()
    checked = own.join(facts["node_symbols"], ["file", "node_id"]).select(F.col("symbol_id").alias("target_symbol")).distinct()
    through = relations.covered(facts["calls"], checked, ["target_symbol"]).select("file", F.col("caller_id").alias("node_id"))
    return found(relations.uncovered(actions, own.union(through), ["file", "node_id"]), "check the input first")


DOM_SHAPE = r"HTML\w*Element|SVG\w*Element|^Element\b|^Node\b"


@CODE_RULES.rule("state-hooks-cluster", "quality", "States that are one: many in a function, flags beside refs, several that may be null, a status beside data", sub_checks=4,
                 needs=("nodes", "calls", "symbols", "node_types", "types", "node_symbols"),
                 sub_ids={"many states": "state-cluster-count", "flag beside a ref": "boolean-with-coupled-ref", "several may be null": "multiple-nullable-state", "status beside data": "status-plus-nullable"})
def state_hooks_cluster(facts: Facts, options: dict) -> DataFrame:
    """The type of a hook's call is that of its state. A flag is beside a ref where one callback sets both."""
    nodes, types = facts["nodes"], facts["types"]
    parts = types.select("type_id", F.explode("members").alias("member")).join(types.select(F.col("type_id").alias("member"), F.col("flags").alias("part")), "member")
    has_part = lambda bits: F.bool_or(F.col("part").bitwiseAND(F.lit(bits)) != 0)
    only = lambda bits: F.bool_and(F.col("part").bitwiseAND(F.lit(bits)) != 0)
    parts = parts.groupBy("type_id").agg(has_part(NULL | UNDEFINED).alias("nullable"), has_part(OBJECT).alias("data"), only(STRING_LITERAL).alias("status"), only(BOOLEAN_LITERAL).alias("flags_only"))
    kinds = facts["node_types"].join(types.select("type_id", "flags", "shape"), "type_id").join(parts, "type_id", "left").drop("type_id")
    declared = origins(facts).where("origin = 'pkg:react'").select("file", "node_id", F.col("caller_id").alias("fn"), "name").join(
        nodes.where(F.col("field") == "initializer").select("file", "node_id", "line", "col", "start", F.col("parent_id").alias("declared")), ["file", "node_id"]).join(kinds, ["file", "node_id"], "left").where("fn IS NOT NULL")
    states = declared.where("name = 'useState'").withColumn("flag", has("flags", BOOLEAN) | F.coalesce("flags_only", F.lit(False)))
    first = lambda rows: rows.groupBy("file", "fn").agg(F.min(F.struct("start", "node_id", "line", "col")).alias("f"), F.count("*").alias("n"))
    at_first = lambda rows: rows.select("file", "f.node_id", "f.line", "f.col")
    many = at_first(first(states).where(F.col("n") >= options.get("stateClusterThreshold", 5)))
    nulls = at_first(first(states.where("nullable")).where("n >= 2"))
    data = states.where("nullable AND data").select("file", "fn").distinct()
    status = relations.covered(states.where("status"), data, ["file", "fn"])
    # callbacks that call a flag's setter and write a ref of the same function
    second = nodes.where(kind("BindingElement") & (F.col("ord") == 1) & (F.col("field") == "element")).withColumn("declared", F.try_element_at("ancestors", F.lit(-2))["id"]).join(facts["node_symbols"], ["file", "node_id"]).select("file", "declared", "symbol_id")
    setters = states.where("flag").select("file", "fn", "declared").join(second, ["file", "declared"]).select("file", "fn", F.col("symbol_id").alias("target_symbol"))
    refs = declared.where((F.col("name") == "useRef") & ~F.coalesce(F.col("shape").rlike(DOM_SHAPE), F.lit(False)))
    refs = refs.select("file", "fn", F.col("declared").alias("node_id")).join(facts["node_symbols"], ["file", "node_id"]).select("file", "fn", "symbol_id")
    callbacks = lambda rows: rows.select("file", "fn", F.explode(F.filter("ancestors", lambda a: a["kind"].isin("ArrowFunction", "FunctionExpression"))).alias("a")).select("file", "fn", F.col("a.id").alias("callback")).where("callback <> fn").distinct()
    set_in = callbacks(at(facts, facts["calls"].join(setters, ["file", "target_symbol"])))
    roots = nodes.where(kind("Identifier") & (F.col("field") == "expression")).join(facts["node_symbols"], ["file", "node_id"]).join(refs, ["file", "symbol_id"]).select("file", F.col("parent_id").alias("left_id"), "fn")
    written = with_children(nodes, "left", "operator").where(operator("EqualsToken") & F.col("left.text").endswith(".current")).withColumn("left_id", F.col("left.id")).join(roots, ["file", "left_id"])
    both = relations.covered(set_in, callbacks(written), ["file", "fn", "callback"]).select("file", "fn").distinct()
    flags = at_first(first(relations.covered(states.where("flag"), both, ["file", "fn"])))
    parts = {"many states": many, "several may be null": nulls, "status beside data": status, "flag beside a ref": flags}
    return reduce(DataFrame.unionByName, [found(df, m) for m, df in parts.items()])


@CODE_RULES.rule("performance", "performance", "Blocking calls, patterns made in loops, long chains, arrays changed or cut where they are read, barrel imports", sub_checks=6,
                 needs=("nodes", "calls", "symbols", "node_types", "types", "import_edges"), sub_ids={"long chain": "long-chain", "import through an index": "no-barrel-import"})
def performance(facts: Facts, options: dict) -> DataFrame:
    nodes, calls = facts["nodes"], at(facts, origins(facts))
    patterns = with_children(nodes, "expression").where(kind("NewExpression") & (F.col("expression.text") == "RegExp") & inside("ancestors", LOOPS, FUNCTIONS))
    blocking = calls.where(F.col("name").isin(*options.get("syncIo", SYNC_IO)) & F.col("origin").startswith("pkg:"))
    chains = calls.where((F.size("chain") - 1 > options.get("maxChainDepth", 6)) & (F.col("origin") == "local"))
    arrays = facts["node_types"].join(facts["types"].where(F.col("shape").rlike(ARRAY_SHAPE)), "type_id").select("file", "node_id")
    # the nearest function around is given to map or filter of an array
    owner = F.try_element_at(F.filter("ancestors", lambda a: a["kind"].isin("ArrowFunction", "FunctionExpression")), F.lit(-1))["id"]
    changed = calls.where(F.col("name").isin(*GROWING) & (F.size("chain") > 1)).withColumn("owner", owner)
    given = nodes.where(kind("ArrowFunction", "FunctionExpression")).select("file", F.col("node_id").alias("owner"), F.col("parent_id").alias("call"))
    over = facts["calls"].where(F.col("name").isin("map", "filter") & (F.size("chain") > 1)).select("file", F.col("node_id").alias("call"))
    receivers = relations.covered(nodes.where("field = 'receiver'"), arrays, ["file", "node_id"]).select("file", F.col("parent_id").alias("call"))
    grown = relations.covered(changed, relations.covered(relations.covered(given, over, ["file", "call"]), receivers, ["file", "call"]), ["file", "owner"])
    cut = with_children(nodes, "expression").where(kind("ElementAccessExpression") & (F.col("field") == "expression")).withColumn("node", F.col("expression.id"))
    cut = relations.covered(cut, arrays.withColumnRenamed("node_id", "node"), ["file", "node"]).select("file", F.col("parent_id").alias("node_id"))
    deleted = relations.covered(nodes.where(kind("DeleteExpression")), cut, ["file", "node_id"])
    barrels = facts["import_edges"].where(F.col("specifier").startswith(".") & F.col("dst").rlike(r"(^|[/\\\\])index\.[tj]sx?$")).select(F.col("src").alias("file"), "line", F.lit(1).alias("col"))
    parts = {
        "make it once, before the loop": patterns, "blocks": blocking, "long chain": chains, "array changed in a callback": grown, "hole in an array": deleted, "import through an index": barrels,
    }
    return reduce(DataFrame.unionByName, [found(df, m) for m, df in parts.items()])


# --- flows ------------------------------------------------------------------------------------------

FLOWS = ("nodes", "calls", "symbols", "def_use")
#: rule: (description, option, names, origins)
TAINTED = {
    "no-child-process": ("Commands from parameters", "shellMethods", SHELL_METHODS, ("pkg:child_process", "pkg:node:child_process")),
    "no-non-literal-fs-path": ("Paths from parameters", "fsPathMethods", FS_PATH_METHODS, ("pkg:fs", "pkg:node:fs", "pkg:fs/promises", "pkg:node:fs/promises")),
    "no-non-literal-regexp": ("Patterns from parameters", "names", ("RegExp",), ("lib",)),
    "no-non-literal-require": ("Modules from parameters", "names", ("require", "import"), ("lib", "pkg:node")),
    "no-ssrf": ("Addresses from parameters of server actions", "names", ("fetch",), ("lib",)),
}


def tainted_arguments(facts: Facts, calls: DataFrame) -> DataFrame:
    """Calls whose first argument is or comes from a parameter: a mark for each node that parameters reach over
    definition-use edges, whatever the number of parameters."""
    key = lambda node: F.concat_ws("#", node, F.col("file"))
    sinks = first_argument(facts, calls).withColumn("node", key(F.col("argument").cast("string")))
    edges = facts["def_use"].select(key(F.col("def_node").cast("string")).alias("src"), key(F.col("use_node").cast("string")).alias("dst"))
    sources = facts["nodes"].where(kind("Parameter")).select(key(F.col("node_id").cast("string")).alias("node"))
    return relations.covered(sinks, graph.reach(edges, sources), ["node"])


def _taint_rule(rule: str, description: str, option: str, names: Sequence[str], allowed: Sequence[str]) -> None:
    server_only = rule == "no-ssrf"

    @CODE_RULES.rule(rule, "security", description, needs=(*FLOWS, "files") if server_only else FLOWS)
    def check(facts: Facts, options: dict) -> DataFrame:
        calls = origins(facts).where(F.col("name").isin(*options.get(option, names)) & F.col("origin").isin(*allowed))
        if server_only:
            calls = relations.covered(calls, facts["files"].where("directive = 'use server'").select("file"), ["file"])
        return found(tainted_arguments(facts, calls), F.concat(F.lit("from a parameter: "), F.col("name")))


for _rule, _about in TAINTED.items():
    _taint_rule(_rule, *_about)


@CODE_RULES.rule("no-unthrown-error", "quality", "Errors made and not thrown", needs=("nodes", "node_symbols", "symbols", "class_bases"))
def no_unthrown_error(facts: Facts, options: dict) -> DataFrame:
    bases = facts["class_bases"].select(F.col("symbol_id").alias("src"), F.col("base_id").alias("dst"))
    errors = graph.reach(graph.turned(bases), facts["symbols"].where("name = 'Error' AND origin = 'lib'").select(F.col("symbol_id").alias("node"))).select(F.col("node").alias("symbol_id"))
    made = with_parent(facts["nodes"]).where(kind("NewExpression") & (F.col("parent_kind") == "ExpressionStatement"))
    return found(relations.covered(made.join(facts["node_symbols"], ["file", "node_id"]), errors, ["symbol_id"]), "throw it")


# --- clones -----------------------------------------------------------------------------------------


def cloned_blocks(blocks: DataFrame, least: float, below: float | None, ratio: float, marks: Column, loose: bool) -> DataFrame:
    """Blocks that have a partner in another file: like by bigrams of their tokens (under ``below``, if given), of a length
    of ``ratio`` or more of the other's, not of another route, and with a mark in common (``loose``: or one without marks).

    Two files are of different routes if both lie two or more folders below their last common one. So one of them, less its
    last folder, is a folder around the other: an equality, as is a common mark. Partners are the first and last file of each
    (class of copies, length, folder, mark): no pairs of blocks are made.
    """
    size = F.size("tokens")
    bigrams = F.array_distinct(F.zip_with(F.slice("tokens", 1, F.greatest(size - 1, F.lit(0))), F.slice("tokens", 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    folders = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    around = lambda k: F.concat_ws("/", F.lit(""), F.slice("folders", F.lit(1), k))
    keyed = blocks.withColumns({"key": F.concat_ws("#", "file", F.col("line").cast("string"), "name"), "bigrams": F.array_sort(bigrams), "n": size, "folders": folders, "marks": F.coalesce(marks, F.array().cast("array<string>"))}).where(F.size("bigrams") > 0)
    keyed = keyed.withColumns({"whole": F.transform(F.sequence(F.lit(0), F.size("folders")), around), "less": F.array(around(F.greatest(F.size("folders") - 1, F.lit(0))))})
    classes = keyed.groupBy("bigrams").agg(F.min("key").alias("class"))
    rows = keyed.join(classes, "bigrams")
    pairs = similarity.similar_sets(classes, "class", "bigrams", least)
    if below is not None:
        pairs = pairs.where(F.col("jaccard") < below)
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    if below is None or below > 1:
        both = both.union(classes.select("class", F.col("class").alias("other")))
    lengths = rows.select("class", "n").distinct()
    units = both.join(lengths, "class").join(lengths.select(F.col("class").alias("other"), F.col("n").alias("other_n")), "other").where(F.least("n", "other_n") >= ratio * F.greatest("n", "other_n"))
    none, any_ = F.array(F.lit("-")), F.array(F.lit("*"))  # a block without marks; any block
    held = F.when(F.size("marks") > 0, F.col("marks")).otherwise(none if loose else F.array().cast("array<string>"))
    sought = F.when(F.size("marks") > 0, F.concat("marks", none) if loose else F.col("marks")).otherwise(any_ if loose else F.array().cast("array<string>"))
    met = []
    for own, other in (("less", "whole"), ("whole", "less")):
        there = rows.select(F.col("class").alias("other"), F.col("n").alias("other_n"), F.explode(other).alias("folder"), "file", F.concat(held, any_).alias("m")).withColumn("mark", F.explode("m"))
        there = there.groupBy("other", "other_n", "folder", "mark").agg(F.min("file").alias("first"), F.max("file").alias("last"))
        here = rows.join(units, ["class", "n"]).select("key", "file", "other", "other_n", F.explode(own).alias("folder"), sought.alias("m")).withColumn("mark", F.explode("m")).drop("m")
        met.append(here.join(there, ["other", "other_n", "folder", "mark"]).where((F.col("first") != F.col("file")) | (F.col("last") != F.col("file"))).select("key"))
    return relations.covered(rows, met[0].union(met[1]).distinct(), ["key"])


@CODE_RULES.rule("syntactic-clone", "architecture", "Blocks that are copies of others", needs=("blocks",))
def syntactic_clone(facts: Facts, options: dict) -> DataFrame:
    """Blocks whose calls have no receiver in common are no copies, unless one has none."""
    blocks = facts["blocks"].where(F.col("stmt_count") >= options.get("minStatements", 10))
    found_ = cloned_blocks(blocks, options.get("minCloneSimilarity", 0.92), None, 0.6, F.col("receivers"), True)
    return found(found_.withColumn("col", F.lit(1)), F.concat(F.lit("copy: "), F.col("name")))


@CODE_RULES.rule("semantic-clone", "architecture", "Blocks that are much like others", needs=("blocks",))
def semantic_clone(facts: Facts, options: dict) -> DataFrame:
    """Functions of one signature that are alike, but no copies."""
    blocks = facts["blocks"].where((F.col("stmt_count") >= options.get("minStatements", 5)) & F.col("signature").isNotNull())
    found_ = cloned_blocks(blocks, options.get("minSemanticSimilarity", 0.80), options.get("minSyntacticThreshold", 0.92), options.get("minLengthRatio", 0.4), F.array("signature"), False)
    return found(found_.withColumn("col", F.lit(1)), F.concat(F.lit("alike: "), F.col("name")))
