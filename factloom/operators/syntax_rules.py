"""Code rules that ask for nodes only: their kind, parent, children and siblings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import Facts
from ..sources.scratch import written
from . import graph, relations, trees
from .code_rules import CODE_RULES, FUNCTIONS, LOOPS, found, inside, unreachable_code, with_parent

# Fixed values of the rules.
RESTRICTED = ("undefined", "NaN", "Infinity", "eval", "arguments")
SAME_OPERANDS = (
    "AmpersandAmpersandToken", "BarBarToken", "QuestionQuestionToken", "MinusToken", "SlashToken", "PercentToken", "LessThanToken",
    "LessThanEqualsToken", "GreaterThanToken", "GreaterThanEqualsToken", "AmpersandToken", "BarToken", "CaretToken",
)
PURE = ("Identifier", "PropertyAccessExpression", "ElementAccessExpression", "ThisKeyword", "StringLiteral", "NumericLiteral")
EQUALITY = ("EqualsEqualsToken", "EqualsEqualsEqualsToken", "ExclamationEqualsToken", "ExclamationEqualsEqualsToken")
COMPARISONS = (*EQUALITY, "LessThanToken", "LessThanEqualsToken", "GreaterThanToken", "GreaterThanEqualsToken")
ALWAYS_BELOW_ZERO = ("GreaterThanToken", "GreaterThanEqualsToken", "ExclamationEqualsToken", "ExclamationEqualsEqualsToken")
EXITS = ("ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement")
DANGEROUS_URL = r"(?i)^\s*(javascript|data|vbscript):"


def with_children(nodes: DataFrame, *roles: str) -> DataFrame:
    """Nodes with the first child of each role (a struct of kind, text, id; null if none) and the number of such children
    (n_role): children are reduced to one row a parent before they meet it."""
    first = lambda r: F.max(F.when((F.col("field") == r) & (F.col("ord") == 0), F.struct("kind", "text", F.col("node_id").alias("id")))).alias(r)
    counts = [F.count_if(F.col("field") == r).alias(f"n_{r}") for r in roles]
    kids = nodes.where(F.col("field").isin(*roles)).groupBy("file", F.col("parent_id").alias("node_id")).agg(*map(first, roles), *counts)
    return nodes.join(kids, ["file", "node_id"], "left").fillna(0, [f"n_{r}" for r in roles])


def each(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A finding for each check that a row meets; an unknown condition is not met."""
    met = F.array_compact(F.array(*[F.when(condition, F.lit(message)) for message, condition in checks.items()]))
    return found(rows.withColumn("what", F.explode(met)), F.col("what"))


def kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def within(*kinds: str) -> Column:
    return inside("ancestors", kinds, FUNCTIONS)


def operator(*tokens: str) -> Column:
    return kind("BinaryExpression") & F.col("operator.kind").isin(*tokens)


def structures(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, node_id, structure) of the (file, node_id) nodes ``roots``: equal if their subtrees are, kind by kind, in roles
    and order, down to the texts of leaves. The source text of a node with parts of its own has no bearing, so blanks and
    comments between parts make no difference, and those in a literal do. Of a leaf that is no literal blanks are folded."""
    below = nodes.select("file", "node_id", F.explode("ancestors").alias("a")).select("file", "node_id", F.col("a.id").alias("root"))
    inside = relations.covered(below, roots.withColumnRenamed("node_id", "root"), ["file", "root"]).select("file", "node_id")
    some = relations.covered(nodes, inside.union(roots.select("file", "node_id")).distinct(), ["file", "node_id"])
    parts = nodes.select("file", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    literal = F.col("kind").rlike("Literal|Template|JsxText")
    text = F.when(F.col("inner").isNull(), F.when(literal, F.col("text")).otherwise(F.trim(F.regexp_replace("text", r"\s+", " "))))
    labelled = some.join(parts, ["file", "node_id"], "left").select(
        "file", F.col("node_id").alias("node"), "depth", F.col("parent_id").alias("parent"), F.xxhash64("field", "ord").alias("place"),
        *[F.xxhash64(F.lit(salt), "kind", text).alias(f"label_{salt}") for salt in (1, 2)])
    hashed = trees.subtree_hashes(labelled, "file")
    return hashed.select("file", F.col("node").alias("node_id"), F.struct("hash_1", "hash_2").alias("structure"))


@CODE_RULES.rule("no-identical-binary-operands", "quality", "The same operand on both sides", needs=("nodes",))
def no_identical_binary_operands(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "left", "operator", "right")
    some = rows.where(operator(*SAME_OPERANDS) & F.col("left.kind").isin(*PURE) & (F.col("left.kind") == F.col("right.kind")))
    side = lambda k: some.select("file", F.col(f"{k}.id").alias("node_id"))
    of = written(structures(facts["nodes"], side("left").union(side("right"))), "structures")
    named = lambda k: of.select("file", F.col("node_id").alias(k), F.col("structure").alias(f"{k}_structure"))
    both = some.withColumns({"l": F.col("left.id"), "r": F.col("right.id")}).join(named("l"), ["file", "l"]).join(named("r"), ["file", "r"])
    return found(both.where("l_structure = r_structure").select(*rows.columns), "both sides are the same")


@CODE_RULES.rule("no-collection-size-mischeck", "quality", "Size checks that sizes of 0 or more settle", needs=("nodes",))
def no_collection_size_mischeck(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "left", "operator", "right")
    size = kind("BinaryExpression") & (F.col("left.kind") == "PropertyAccessExpression") & F.col("left.text").rlike(r"\.(length|size)$")
    n, op = F.col("right.text").try_cast("double"), F.col("operator.kind")
    below = size & (n < 0)
    return each(rows, {
        "always true": (below & op.isin(*ALWAYS_BELOW_ZERO)) | (size & (n == 0) & (op == "GreaterThanEqualsToken")),
        "always false": (below & op.isin(*COMPARISONS) & ~op.isin(*ALWAYS_BELOW_ZERO)) | (size & (n == 0) & (op == "LessThanToken")),
    })


@CODE_RULES.rule("jsx-no-useless-fragment", "quality", "Fragments around one child", needs=("nodes",))
def jsx_no_useless_fragment(facts: Facts, options: dict) -> DataFrame:
    inner = facts["nodes"].where((F.col("field") == "child") & ~(kind("JsxText") & F.col("text").rlike(r"^\s*$")))
    one = inner.groupBy("file", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"), F.bool_or(kind("JsxExpression")).alias("computed")).where("n = 1 AND NOT computed")
    return found(relations.covered(facts["nodes"].where(kind("JsxFragment") & F.col("file").endswith(".tsx")), one, ["file", "node_id"]), "the child needs no fragment")


@CODE_RULES.rule("no-all-duplicated-branches", "quality", "Branches that all do the same", needs=("nodes",))
def no_all_duplicated_branches(facts: Facts, options: dict) -> DataFrame:
    """Branches of a chain hang under its first if, those of a switch under it; only with an else or a default is one always taken."""
    branches = facts["nodes"].where(F.col("field").isin("branch", "else"))
    branches = branches.join(structures(facts["nodes"], branches.select("file", "node_id")), ["file", "node_id"])
    same = branches.groupBy("file", F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("n"), F.count_distinct("structure").alias("bodies"), F.bool_or(F.col("field") == "else").alias("whole"), F.bool_or(F.trim("text") == "").alias("empty"))
    heads = same.where("n >= 2 AND bodies = 1 AND whole AND NOT empty")
    return found(relations.covered(facts["nodes"], heads, ["file", "node_id"]), "all branches are the same")


@CODE_RULES.rule("error-handling", "quality", "Empty catches, and errors thrown without their cause", sub_checks=2, needs=("nodes",))
def error_handling(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "statement", "argument", "expression")
    return each(rows, {
        "empty catch": kind("CatchClause") & (F.col("n_statement") == 0) & ~F.col("text").rlike(r"/\*|//"),
        "no cause": kind("NewExpression") & (F.col("expression.text") == "Error") & (F.col("n_argument") == 1) & (F.element_at(F.concat(F.array(F.lit("")), F.transform("ancestors", lambda a: a["kind"])), -1) == "ThrowStatement") & within("CatchClause"),
    })


@CODE_RULES.rule("no-empty-function", "quality", "Functions without a body", needs=("nodes",))
def no_empty_function(facts: Facts, options: dict) -> DataFrame:
    rows = with_parent(with_children(facts["nodes"], "statement", "parameter"))
    exempt = kind("Constructor") | F.col("parent_kind").isin("CallExpression", "PropertyAssignment", "PropertyDeclaration")
    arrow = kind("ArrowFunction") & (F.col("parent_kind") == "VariableDeclaration") & (F.col("n_parameter") == 0)
    empty = kind(*FUNCTIONS) & (F.col("n_statement") == 0) & F.col("text").rlike(r"\{\s*\}\s*$")
    return each(rows, {"empty function": empty & ~F.coalesce(exempt | arrow, F.lit(False))})


@CODE_RULES.rule("no-multiline-comments", "quality", "Block comments before a node", needs=("nodes",))
def no_multiline_comments(facts: Facts, options: dict) -> DataFrame:
    return each(facts["nodes"], {"block comment": kind("Comment") & F.col("text").rlike(r"(?s)^/\*\*.*\*/$")})


@CODE_RULES.rule("naming-convention", "quality", "Restricted names, and labels named like a variable", sub_checks=2, needs=("nodes",))
def naming_convention(facts: Facts, options: dict) -> DataFrame:
    nodes = facts["nodes"]
    restricted = found(nodes.where(kind("VariableDeclaration", "Parameter", "FunctionDeclaration") & F.col("text").isin(*RESTRICTED)), F.concat(F.lit("restricted name "), F.col("text")))
    variables = nodes.where(kind("VariableDeclaration", "Parameter")).select("file", "text")
    labels = relations.covered(nodes.where(kind("LabeledStatement")), variables, ["file", "text"])
    return restricted.unionByName(found(labels, F.concat(F.lit("label "), F.col("text"))))


def _written_wrongly(facts: Facts) -> DataFrame:
    """Parameters that are written to, and functions in loops that use a variable declared by let outside of them."""
    nodes, symbols = facts["nodes"], facts["node_symbols"]
    parameters = nodes.where(kind("Parameter")).join(symbols, ["file", "node_id"]).select("file", "symbol_id")
    steps = nodes.where(kind("PlusPlusToken", "MinusMinusToken") & (F.col("field") == "operator")).select("file", "parent_id")
    written = written_symbols(facts)
    by_step = relations.covered(written.where(F.col("field") == "expression"), steps, ["file", "parent_id"])
    names = relations.covered(written.where(F.col("field") == "left").unionByName(by_step), parameters, ["file", "symbol_id"]).select("file", F.col("parent_id").alias("node_id"), F.col("text").alias("name")).distinct()
    again = found(nodes.join(names, ["file", "node_id"]), F.concat(F.lit("parameter set: "), F.col("name")))
    lists = nodes.where(kind("VariableDeclarationList") & F.col("text").startswith("let ")).select("file", F.col("node_id").alias("parent_id"))
    loose = relations.covered(nodes.where(kind("VariableDeclaration")), lists, ["file", "parent_id"]).join(symbols, ["file", "node_id"]).select("file", "symbol_id", F.transform("ancestors", lambda a: a["id"]).alias("declared_in"))
    functions = nodes.where(kind("ArrowFunction", "FunctionExpression") & inside("ancestors", LOOPS, FUNCTIONS))
    uses = with_parent(nodes).where(kind("Identifier") & (F.coalesce("parent_kind", F.lit("")) != "PropertyAccessExpression")).join(symbols, ["file", "node_id"])
    within_function = uses.select("file", "symbol_id", F.explode("ancestors").alias("a")).select("file", "symbol_id", F.col("a.id").alias("around"))
    captures = within_function.join(loose, ["file", "symbol_id"]).where(~F.array_contains("declared_in", F.col("around"))).select("file", F.col("around").alias("node_id"))
    return again.unionByName(found(relations.covered(functions, captures, ["file", "node_id"]), "function of a loop uses a variable that changes"))


@CODE_RULES.rule("correctness", "quality", "Assignments, comparisons and exits that can't be meant", sub_checks=11, needs=("nodes", "node_symbols"))
def correctness(facts: Facts, options: dict) -> DataFrame:
    rows = with_parent(with_children(facts["nodes"], "left", "operator", "right", "statement", "expression"))
    same = F.col("left.text") == F.col("right.text")
    in_finally = within("FinallyBlock")
    return unreachable_code(facts).unionByName(_written_wrongly(facts)).unionByName(each(rows, {
        "assigned to itself": operator("EqualsToken") & same & F.col("left.kind").isin(*PURE),
        "compared with itself": operator(*EQUALITY) & same & F.col("left.kind").isin(*PURE),
        "loop of one round": kind(*LOOPS) & F.col("statement.kind").isin("ReturnStatement", "ThrowStatement", "BreakStatement"),
        "catch that only throws again": kind("CatchClause") & (F.col("n_statement") == 1) & (F.col("statement.kind") == "ThrowStatement") & (F.col("statement.text") == F.concat(F.lit("throw "), F.regexp_extract("text", r"^catch\s*\(\s*(\w+)", 1))),
        "hole in an array": kind("OmittedExpression") & (F.col("parent_kind") == "ArrayLiteralExpression"),
        "exit in finally": kind("ReturnStatement", "ThrowStatement") & in_finally,
        "await in finally": kind("AwaitExpression") & in_finally,
        "value returned by a setter": kind("ReturnStatement") & F.col("expression").isNotNull() & inside("ancestors", ("SetAccessor",), FUNCTIONS),
    }))


@CODE_RULES.rule("logic", "quality", "Conditions, writes and values without effect", sub_checks=5, needs=("nodes", "node_symbols", "node_types", "types"))
def logic(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "condition", "left", "operator", "right", "else")
    inner = rows.where(kind("IfStatement")).select("file", F.col("node_id").alias("next_id"), F.col("condition.text").alias("next_text"))
    chain = rows.where(kind("IfStatement") & (F.col("else.kind") == "IfStatement")).join(inner.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & (F.col("else.id") == F.col("next_id")))
    again = found(chain.where(F.col("condition.text") == F.col("next_text")), "the next condition is the same")
    fixed = each(rows, {"the condition never changes": kind("IfStatement", "ConditionalExpression") & F.col("condition.kind").isin("TrueKeyword", "FalseKeyword")})
    # statements of a block, each with the element it writes
    writes = rows.where(operator("EqualsToken") & (F.col("left.kind") == "ElementAccessExpression") & (F.col("field") == "expression")).select("file", F.col("parent_id").alias("node_id"), F.col("left.text").alias("element"))
    statements = facts["nodes"].where(F.col("field") == "statement").join(writes, ["file", "node_id"], "left")
    dead = relations.repeated_next(statements, ["file", "parent_id"], ["ord"], F.col("element"))
    numbers = facts["node_types"].join(facts["types"].where(F.col("flags").bitwiseAND(F.lit(8 | 256)) != 0), "type_id").select("file", F.col("node_id").alias("side"))
    shown = with_parent(rows).where(operator("AmpersandAmpersandToken") & (F.col("field") == "expression") & (F.col("parent_kind") == "JsxExpression")).withColumn("side", F.col("left.id"))
    leaks = found(relations.covered(shown, numbers, ["file", "side"]), "0 is shown")
    return again.unionByName(fixed).unionByName(found(dead, "written again at once")).unionByName(leaks).unionByName(found(dead_initial_values(facts), "first value never used"))


@CODE_RULES.rule("no-deprecated-api", "quality", "Old ways to prototypes and callers", sub_checks=3, needs=("nodes",))
def no_deprecated_api(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "left", "operator")
    return each(rows, {
        "__proto__": kind("PropertyAccessExpression") & F.col("text").rlike(r"\.__proto__$"),
        "arguments.caller or callee": kind("PropertyAccessExpression") & F.col("text").rlike(r"^arguments\.(caller|callee)$"),
        "prototype replaced": operator("EqualsToken") & F.col("left.text").rlike(r"\.prototype$"),
    })


@CODE_RULES.rule("no-useless-code", "quality", "Code that can be said shorter", sub_checks=4, needs=("nodes",))
def no_useless_code(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "name", "expression", "initializer", "left", "operator", "right", "argument")
    receiver = F.regexp_extract("expression.text", r"^(\w+)\.\w+\.(call|apply)$", 1)
    return each(rows, {
        "literal as a computed key": kind("ComputedPropertyName") & F.col("expression.kind").isin("StringLiteral", "NumericLiteral"),
        "literals joined": operator("PlusToken") & (F.col("left.kind") == "StringLiteral") & (F.col("right.kind") == "StringLiteral"),
        "called by its receiver": kind("CallExpression") & (F.col("argument.kind") == "Identifier") & (F.col("argument.text") == receiver),
        "name said twice": kind("PropertyAssignment") & (F.col("initializer.kind") == "Identifier") & (F.col("name.text") == F.col("initializer.text")),
    })


def boolean_context(nodes: DataFrame) -> DataFrame:
    """(file, node_id) of nodes that stand in a condition: conditions themselves, and down from them through ||, &&, ! and
    brackets. A mark a node, by a walk over these edges."""
    rows = with_children(with_parent(nodes), "operator")
    key = lambda node: F.concat_ws("#", F.col(node).cast("string"), "file")
    roots = rows.where((F.col("field") == "condition") | ((F.col("field") == "expression") & F.col("parent_kind").isin("WhileStatement", "DoStatement"))).select(key("node_id").alias("node"))
    through = rows.where(operator("BarBarToken", "AmpersandAmpersandToken") | kind("ParenthesizedExpression") | (kind("PrefixUnaryExpression") & (F.col("text").startswith("!") | F.coalesce(F.col("operator.kind") == "ExclamationToken", F.lit(False)))))
    inner = nodes.where(F.col("field").isin("left", "right", "expression")).join(through.select("file", F.col("node_id").alias("parent_id")), ["file", "parent_id"])
    marked = graph.reach(inner.select(key("parent_id").alias("src"), key("node_id").alias("dst")), roots)
    return marked.select(F.substring_index("node", "#", 1).cast("long").alias("node_id"), F.expr("substring(node, instr(node, '#') + 1)").alias("file"))


@CODE_RULES.rule("no-implicit-coercion", "quality", "Values turned into other types unsaid", sub_checks=4, needs=("nodes",), sub_ids={"number by +": "plus-coercion", "string by +": "string-concat", "boolean by !!": "double-negation"})
def no_implicit_coercion(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(with_parent(facts["nodes"]), "left", "operator", "right", "expression")
    nullish = lambda side: F.coalesce(F.col(f"{side}.kind") == "NullKeyword", F.lit(False)) | F.coalesce(F.col(f"{side}.text") == "undefined", F.lit(False))
    blank = lambda side: (F.col(f"{side}.kind") == "StringLiteral") & F.col(f"{side}.text").isin("", "''", '""')
    return each(rows, {
        "loose equality": operator("EqualsEqualsToken", "ExclamationEqualsToken") & ~nullish("left") & ~nullish("right"),
        "number by +": kind("PrefixUnaryExpression") & (F.col("operator.kind") == "PlusToken") & (F.col("expression.kind") != "NumericLiteral"),
        "string by +": operator("PlusToken") & (F.coalesce(blank("left"), F.lit(False)) | F.coalesce(blank("right"), F.lit(False))),
    }).unionByName(found(relations.covered(rows.where(kind("PrefixUnaryExpression") & F.col("text").startswith("!!")), boolean_context(facts["nodes"]), ["file", "node_id"]), "boolean by !!"))


ARRAY_CALLBACKS = ("map", "filter", "find", "findIndex", "every", "some", "reduce", "flatMap")
ASSIGNMENTS = (
    "EqualsToken", "PlusEqualsToken", "MinusEqualsToken", "AsteriskEqualsToken", "SlashEqualsToken", "PercentEqualsToken", "AmpersandEqualsToken", "BarEqualsToken", "CaretEqualsToken",
    "BarBarEqualsToken", "AmpersandAmpersandEqualsToken", "QuestionQuestionEqualsToken",
)


def written_symbols(facts: Facts, tokens: tuple[str, ...] | None = ASSIGNMENTS) -> DataFrame:
    """Identifiers that are written to, with their symbols and ancestors: left of an assignment (of any binary operator, if
    ``tokens`` is None) or operand of a unary operator."""
    rows = with_children(facts["nodes"], "operator")
    left = rows.where(kind("BinaryExpression") & (F.lit(True) if tokens is None else F.col("operator.kind").isin(*tokens))).select("file", F.col("node_id").alias("parent_id"), F.lit("left").alias("field"))
    operand = rows.where(kind("PrefixUnaryExpression", "PostfixUnaryExpression")).select("file", F.col("node_id").alias("parent_id"), F.lit("expression").alias("field"))
    named = facts["nodes"].where(kind("Identifier")).join(facts["node_symbols"], ["file", "node_id"])
    return named.join(left.union(operand), ["file", "parent_id", "field"], "left_semi")


def _loops_and_callbacks(facts: Facts, options: dict) -> DataFrame:
    nodes, symbols = facts["nodes"], facts["node_symbols"]
    rows = with_children(with_parent(nodes), "expression", "argument", "left", "operator", "right", "modifier", "statement")
    # values returned by the function that a promise is made with
    made = rows.where(kind("NewExpression") & (F.col("expression.text") == "Promise") & F.col("argument.kind").isin("ArrowFunction", "FunctionExpression")).select("file", F.col("argument.id").alias("parent_id"))
    returned = relations.covered(rows.where(kind("ReturnStatement") & (F.col("field") == "statement") & F.col("expression").isNotNull()), made, ["file", "parent_id"])
    # a variable from elsewhere takes what is awaited: others may have written it meanwhile
    late = rows.where(operator("EqualsToken") & (F.col("left.kind") == "Identifier") & (F.col("right.kind") == "AwaitExpression")).withColumn("named", F.col("left.id"))
    late = late.join(symbols.select("file", F.col("node_id").alias("named"), "symbol_id"), ["file", "named"])
    declared = nodes.where(kind("VariableDeclaration", "Parameter")).join(symbols, ["file", "node_id"]).select("file", "symbol_id", F.col("parent_id").alias("declared_in"))
    late = late.join(declared, ["file", "symbol_id"]).where(~F.exists("ancestors", lambda a: a["id"] == F.col("declared_in")))
    # loops on a name that nothing within writes
    loops = rows.where(kind("WhileStatement", "DoStatement") & (F.col("expression.kind") == "Identifier")).withColumn("named", F.col("expression.id")).join(symbols.select("file", F.col("node_id").alias("named"), "symbol_id"), ["file", "named"])
    writes = written_symbols(facts, None).select("file", "symbol_id", F.explode("ancestors").alias("a")).select("file", "symbol_id", F.col("a.id").alias("node_id"))
    still = relations.uncovered(loops, writes, ["file", "symbol_id", "node_id"])
    # functions given to array methods that return nothing
    method = F.substring_index("expression.text", ".", -1)
    given = rows.where(kind("CallExpression") & (F.col("expression.kind") == "PropertyAccessExpression") & method.isin(*options.get("arrayCallbackMethods", ARRAY_CALLBACKS))).select("file", F.col("argument.id").alias("node_id"))
    owner = F.try_element_at(F.filter("ancestors", lambda a: a["kind"].isin(*FUNCTIONS)), F.lit(-1))["id"]
    returns = nodes.where(kind("ReturnStatement")).select("file", owner.alias("node_id"))
    empty = relations.covered(rows.where(kind("ArrowFunction", "FunctionExpression") & (F.col("n_statement") > 0) & (F.coalesce(F.col("modifier.kind"), F.lit("")) != "AsyncKeyword")), given, ["file", "node_id"])
    parts = {"value returned by an executor": returned, "outer variable takes what is awaited": late, "loop condition never changes": still, "callback returns nothing": relations.uncovered(empty, returns, ["file", "node_id"])}
    return reduce(DataFrame.unionByName, [found(df, m) for m, df in parts.items()])


def adjacent(facts: Facts) -> DataFrame:
    """Statements with the one before each (prev_id, prev_kind), and what a statement that declares one variable declares
    (declared: id, symbol_id, kind and text of the value, line, col), for the statement itself and for the one before."""
    w = Window.partitionBy("file", "parent_id").orderBy("ord")
    values = with_children(facts["nodes"], "initializer").where(kind("VariableDeclaration")).join(facts["node_symbols"], ["file", "node_id"], "left")
    one = values.groupBy("file", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("declares"), F.first(F.struct(F.col("node_id").alias("id"), "symbol_id", "initializer", "line", "col")).alias("declared")).where("declares = 1").drop("declares")
    rows = facts["nodes"].where(F.col("field") == "statement").join(one, ["file", "node_id"], "left")
    before = F.lag(F.struct("node_id", "kind", "line", "col", "declared")).over(w)
    return rows.withColumn("before", before)


def _after_declaration(facts: Facts, after: str) -> DataFrame:
    """Statements of a kind that follow a statement that declares one variable with a value; expr is their expression's node."""
    rows = adjacent(facts).where((F.col("kind") == after) & (F.col("before.kind") == "VariableStatement") & F.col("before.declared.initializer").isNotNull())
    inner = facts["nodes"].where((F.col("field") == "expression") & (F.col("ord") == 0)).select("file", F.col("parent_id").alias("node_id"), F.struct(F.col("node_id").alias("id"), "kind").alias("expr"))
    return rows.join(inner, ["file", "node_id"])


def _named(facts: Facts, rows: DataFrame, node: Column) -> DataFrame:
    """Rows in which a node is an identifier of the variable declared before."""
    names = facts["nodes"].where(kind("Identifier")).join(facts["node_symbols"], ["file", "node_id"]).select(F.col("file").alias("f"), F.col("node_id").alias("i"), F.col("symbol_id").alias("s"))
    return rows.join(names, (F.col("file") == F.col("f")) & (node == F.col("i")) & (F.col("before.declared.symbol_id") == F.col("s"))).drop("f", "i", "s")


def dead_initial_values(facts: Facts) -> DataFrame:
    """Statements whose variable the next one sets again, without use of it."""
    rows = _after_declaration(facts, "ExpressionStatement").withColumn("assigned", F.col("expr.id"))
    assigns = with_children(facts["nodes"], "left", "operator", "right").where(operator("EqualsToken")).select("file", F.col("node_id").alias("assigned"), F.col("left.id").alias("left_id"), F.col("right.id").alias("right_id"))
    rows = _named(facts, rows.join(assigns, ["file", "assigned"]), F.col("left_id")).withColumn("symbol_id", F.col("before.declared.symbol_id"))
    uses = facts["nodes"].where(kind("Identifier")).join(facts["node_symbols"], ["file", "node_id"])
    inside_right = uses.select("file", "symbol_id", F.explode(F.concat(F.transform("ancestors", lambda a: a["id"]), F.array("node_id"))).alias("right_id"))
    return relations.uncovered(rows, inside_right, ["file", "symbol_id", "right_id"]).select("file", F.col("before.node_id").alias("node_id"), "before.line", "before.col")


def short_bodies(facts: Facts) -> DataFrame:
    """Bodies that can be shorter: constructors that add nothing, true and false returned one by one, variables returned at
    once, objects filled at once."""
    nodes = facts["nodes"]
    rows = with_children(nodes, "parameter", "statement", "expression")
    calls = with_children(nodes, "expression").where(kind("CallExpression") & (F.col("expression.kind") == "SuperKeyword")).select("file", F.col("parent_id").alias("first_id"))
    bare = rows.where(kind("Constructor") & (F.col("n_parameter") == 0)).withColumn("first_id", F.col("statement.id"))
    useless = bare.where("n_statement = 0").unionByName(relations.covered(bare.where((F.col("n_statement") == 1) & (F.col("statement.kind") == "ExpressionStatement")), calls, ["file", "first_id"]))
    truth = rows.where(kind("ReturnStatement")).select("file", F.col("node_id").alias("at"), F.col("expression.kind").alias("value"))
    ifs = with_children(nodes, "then", "else").where(kind("IfStatement") & F.col("else").isNull()).select("file", F.col("node_id").alias("if_id"), F.col("then.id").alias("block"), F.col("then.kind").alias("block_kind"))
    inner = nodes.where((F.col("field") == "statement") & (F.col("ord") == 0)).select("file", F.col("parent_id").alias("block"), F.col("node_id").alias("first_in"))
    yes = ifs.join(inner, ["file", "block"], "left").withColumn("at", F.when(F.col("block_kind") == "Block", F.col("first_in")).otherwise(F.col("block"))).join(truth.where("value = 'TrueKeyword'"), ["file", "at"]).select("file", "if_id")
    no = adjacent(facts).where((F.col("before.kind") == "IfStatement") & (F.col("kind") == "ReturnStatement")).withColumn("at", F.col("node_id")).join(truth.where("value = 'FalseKeyword'"), ["file", "at"]).withColumn("if_id", F.col("before.node_id"))
    booleans = relations.covered(no, yes, ["file", "if_id"]).select("file", F.col("before.node_id").alias("node_id"), "before.line", "before.col")
    returned = _named(facts, _after_declaration(facts, "ReturnStatement"), F.col("expr.id")).select("file", F.col("before.node_id").alias("node_id"), "before.line", "before.col")
    fields = with_children(nodes, "left").where(kind("BinaryExpression") & (F.col("left.kind") == "PropertyAccessExpression")).select("file", F.col("node_id").alias("expr_id"), F.col("left.id").alias("access"))
    roots = nodes.where((F.col("field") == "expression") & (F.col("ord") == 0)).select("file", F.col("parent_id").alias("access"), F.col("node_id").alias("root"))
    empty = _after_declaration(facts, "ExpressionStatement").where((F.col("before.declared.initializer.kind") == "ObjectLiteralExpression") & (F.col("before.declared.initializer.text") == "{}")).withColumn("expr_id", F.col("expr.id"))
    filled = _named(facts, empty.join(fields, ["file", "expr_id"]).join(roots, ["file", "access"]), F.col("root")).select("file", F.col("before.declared.id").alias("node_id"), "before.declared.line", "before.declared.col")
    parts = {"constructor that adds nothing": useless, "true and false returned one by one": booleans, "variable returned at once": returned, "object filled at once": filled}
    return reduce(DataFrame.unionByName, [found(df, m) for m, df in parts.items()])


def never_reassigned(facts: Facts) -> DataFrame:
    """Variables declared by let, with a value, that nothing writes again."""
    lists = facts["nodes"].where(kind("VariableDeclarationList") & F.col("text").startswith("let ")).select("file", F.col("node_id").alias("parent_id"))
    values = with_children(facts["nodes"], "initializer").where(kind("VariableDeclaration") & F.col("initializer").isNotNull()).join(facts["node_symbols"], ["file", "node_id"])
    return relations.uncovered(relations.covered(values, lists, ["file", "parent_id"]), written_symbols(facts), ["file", "symbol_id"])


@CODE_RULES.rule("safety", "quality", "Calls and functions with a common slip", sub_checks=9, needs=("nodes", "node_symbols"))
def safety(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(with_parent(facts["nodes"]), "expression", "argument", "left", "operator", "right", "modifier")
    call = lambda name: kind("CallExpression") & (F.col("expression.text") == name)
    optional = lambda side: F.coalesce(F.col(f"{side}.text").contains("?."), F.lit(False))
    return _loops_and_callbacks(facts, options).unionByName(each(rows, {
        "value returned by a constructor": kind("ReturnStatement") & F.col("expression").isNotNull() & inside("ancestors", ("Constructor",), ("FunctionDeclaration", "FunctionExpression", "ArrowFunction", "MethodDeclaration")),
        "optional chain in arithmetic": operator("PlusToken", "MinusToken", "AsteriskToken", "SlashToken", "PercentToken") & (optional("left") | optional("right")),
        "parseInt without a radix": call("parseInt") & (F.col("n_argument") == 1),
        "rejected with no error": call("reject") & F.col("argument.kind").isin("StringLiteral", "NumericLiteral", "TemplateExpression", "ObjectLiteralExpression"),
        "async executor": kind("ArrowFunction", "FunctionExpression") & (F.col("parent_kind") == "NewExpression") & (F.col("modifier.kind") == "AsyncKeyword"),
    }))


@CODE_RULES.rule("security", "security", "Markup, addresses and keys from values", sub_checks=4, needs=("nodes", "node_types", "types"))
def security(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "expression", "initializer")
    nodes, types = facts["nodes"], facts["types"]
    # keys of objects that have no index signature, which may be any text
    accesses = with_children(nodes, "expression", "argument").where(kind("ElementAccessExpression") & (F.col("field") == "left"))
    accesses = accesses.where(~F.col("argument.kind").isin("StringLiteral", "NumericLiteral", "NoSubstitutionTemplateLiteral", "PropertyAccessExpression")).withColumns({"object": F.col("expression.id"), "key": F.col("argument.id")})
    indexed = relations.covered(facts["node_types"], types.where(F.col("shape").rlike(COLLECTIONS) | F.col("shape").rlike(INDEXED)), ["type_id"]).select("file", F.col("node_id").alias("object"))
    parts = types.select("type_id", F.explode("members").alias("member")).join(types.select(F.col("type_id").alias("member"), (F.col("flags").bitwiseAND(F.lit(128 | 256)) != 0).alias("literal")), "member").groupBy("type_id").agg(F.bool_and("literal").alias("all")).where("all").select("type_id")
    fixed = types.where(F.col("flags").bitwiseAND(F.lit(128 | 256)) != 0).select("type_id").union(parts)
    fixed = relations.covered(facts["node_types"], fixed, ["type_id"]).select("file", F.col("node_id").alias("key"))
    names = relations.covered(accesses.where(F.col("argument.kind") == "Identifier"), fixed, ["file", "key"]).select("file", "node_id")
    loose = relations.uncovered(relations.uncovered(accesses, indexed, ["file", "object"]), names, ["file", "node_id"]).select("file", F.col("parent_id").alias("node_id"))
    assigned = with_children(nodes, "operator").where(operator(*ASSIGNMENTS))
    return found(relations.covered(assigned, loose, ["file", "node_id"]), "key from a value").unionByName(each(rows, {
        "markup from a value": kind("JsxAttribute") & F.col("text").startswith("dangerouslySetInnerHTML") & (F.coalesce(F.col("initializer.kind"), F.lit("")) != "StringLiteral"),
        "address that runs code": kind("JsxAttribute") & F.col("text").rlike(r"^(href|src|action|formAction)\b") & F.col("initializer.text").rlike(DANGEROUS_URL),
        "document.write": kind("CallExpression") & F.col("expression.text").rlike(r"^document\.write(ln)?$"),
    }))


@CODE_RULES.rule("simplification", "quality", "Statements that can go", sub_checks=8, needs=("nodes", "node_symbols"))
def simplification(facts: Facts, options: dict) -> DataFrame:
    nodes = facts["nodes"]
    last = F.lead("node_id").over(Window.partitionBy("file", "parent_id", "field").orderBy("ord")).isNull()
    placed = with_parent(nodes).withColumn("last", last)
    blocks = nodes.where(F.col("field") == "statement").groupBy("file", F.col("parent_id").alias("then_id")).agg(F.count("*").alias("held"), F.max_by("kind", "ord").alias("then_last"))
    rows = with_children(placed, "then", "expression", "initializer", "incrementor", "else").withColumn("then_id", F.col("then.id")).join(blocks, ["file", "then_id"], "left")
    return short_bodies(facts).unionByName(each(rows, {
        "else after an exit": kind("IfStatement") & F.col("then_last").isin(*EXITS) & F.col("else").isNotNull(),
        "continue at the end": kind("ContinueStatement") & F.col("last") & (F.col("field") == "statement") & F.col("parent_kind").isin(*LOOPS),
        "empty return at the end": kind("ReturnStatement") & F.col("last") & (F.col("field") == "statement") & F.col("expression").isNull() & F.col("parent_kind").isin(*FUNCTIONS),
        "one if in another": kind("IfStatement") & (F.col("held") == 1) & (F.col("then_last") == "IfStatement") & F.col("else").isNull(),
        "for as a while": kind("ForStatement") & F.col("initializer").isNull() & F.col("incrementor").isNull(),
    }))


@CODE_RULES.rule("syntax", "quality", "Old syntax", sub_checks=8, needs=("nodes", "node_symbols", "node_types", "types"))
def syntax(facts: Facts, options: dict) -> DataFrame:
    rows = with_children(facts["nodes"], "expression", "argument")
    second = facts["nodes"].where((F.col("field") == "argument") & (F.col("ord") == 1) & kind("NumericLiteral") & F.col("text").isin("2", "8", "16")).select("file", F.col("parent_id").alias("node_id"))
    numbers = relations.covered(rows.where(kind("CallExpression") & (F.col("expression.text") == "parseInt") & (F.col("n_argument") == 2)), second, ["file", "node_id"])
    plain = facts["node_types"].join(facts["types"].where((F.col("flags").bitwiseAND(F.lit(4 | 128)) != 0)), "type_id").select("file", F.col("node_id").alias("side"))
    sides = with_parent(with_children(facts["nodes"], "left", "operator", "right")).where(operator("PlusToken") & ~((F.col("left.kind") == "StringLiteral") & (F.col("right.kind") == "StringLiteral")))
    sides = sides.where(~F.coalesce(F.col("parent_kind").isin("TemplateExpression", "NoSubstitutionTemplateLiteral"), F.lit(False)))
    joined = relations.covered(sides.withColumn("side", F.explode(F.array("left.id", "right.id"))), plain, ["file", "side"]).dropDuplicates(["file", "node_id"])
    call = lambda name: kind("CallExpression", "NewExpression") & (F.col("expression.text") == name)
    more = found(never_reassigned(facts), "use const").unionByName(found(joined, "use a template")).unionByName(found(numbers, "use a number literal"))
    return more.unionByName(each(rows, {
        "var": kind("VariableDeclarationList") & F.col("text").startswith("var "),
        "arguments": kind("Identifier") & (F.col("text") == "arguments"),
        "Math.pow": call("Math.pow"),
        "apply without this": kind("CallExpression") & F.col("expression.text").endswith(".apply") & (F.col("argument.kind") == "NullKeyword"),
        "RegExp of a literal": call("RegExp") & (F.col("argument.kind") == "StringLiteral"),
    }))


COLLECTIONS = r"\[\]$|^\[|^(readonly )?(Array|ReadonlyArray|Map|Set|WeakMap|WeakSet|ReadonlyMap|ReadonlySet)<"
INDEXED = r"\[\w+: (string|number)\]|^Record<"
SCOPES = ("FunctionDeclaration", "ArrowFunction", "FunctionExpression", "MethodDeclaration", "SourceFile")


def _typed_slips(facts: Facts) -> DataFrame:
    """What needs types: annotations that say nothing new, properties of what may be null, functions that return any unsaid, and
    indexes into what has none; and variables that hide others."""
    nodes = facts["nodes"]
    typed = facts["node_types"].join(facts["types"], "type_id")
    side = lambda role: typed.select("file", F.col("node_id").alias(f"{role}_id"), F.struct("type_id", "flags", "members", "shape", "props").alias(f"{role}_type"))
    rows = with_children(with_parent(nodes), "type", "initializer", "expression", "argument")
    of = lambda df, role: df.withColumn(f"{role}_id", F.col(f"{role}.id")).join(side(role), ["file", f"{role}_id"])
    said = of(of(rows.where(kind("VariableDeclaration")), "type"), "initializer")
    said = said.where((F.col("type_type.type_id") == F.col("initializer_type.type_id")) & (F.col("type_type.flags").bitwiseAND(F.lit(4 | 8 | 16)) != 0))
    nothing = facts["types"].where(F.col("flags").bitwiseAND(F.lit(32768 | 65536)) != 0).select("type_id")
    unions = facts["types"].select("type_id", F.explode("members").alias("member"))
    nullable = nothing.union(relations.covered(unions, nothing.withColumnRenamed("type_id", "member"), ["member"]).select("type_id")).distinct()
    chained = nodes.where(F.col("text").contains("?.") & kind("PropertyAccessExpression", "ElementAccessExpression", "CallExpression")).select("file", F.col("node_id").alias("around"))
    opened = of(rows.where(kind("PropertyAccessExpression") & ~F.col("text").contains("?.") & ~F.coalesce(F.col("parent_kind").isin("IfStatement", "ConditionalExpression"), F.lit(False))), "expression")
    opened = relations.covered(opened.where(F.col("expression_type.flags").bitwiseAND(F.lit(3)) == 0).withColumn("type_id", F.col("expression_type.type_id")), nullable, ["type_id"])
    guarded = relations.covered(opened.withColumn("around", F.explode(F.transform("ancestors", lambda a: a["id"]))), chained, ["file", "around"]).select("file", "node_id")
    opened = relations.uncovered(opened, guarded, ["file", "node_id"])
    returns = typed.where(F.col("flags").bitwiseAND(F.lit(1)) != 0).select("file", "node_id")
    unsaid = relations.covered(rows.where(kind("FunctionDeclaration", "MethodDeclaration") & (F.col("text") != "") & F.col("type").isNull()), returns, ["file", "node_id"])
    literals = F.lit(128 | 256)
    keys = typed.join(unions.join(facts["types"].select(F.col("type_id").alias("member"), (F.col("flags").bitwiseAND(literals) != 0).alias("literal")), "member").groupBy("type_id").agg(F.bool_and("literal").alias("all_literal")), "type_id", "left")
    keys = keys.select("file", F.col("node_id").alias("argument_id"), ((F.col("flags").bitwiseAND(literals) != 0) | F.coalesce("all_literal", F.lit(False))).alias("fixed"))
    indexed = of(rows.where(kind("ElementAccessExpression") & ~F.col("argument.kind").isin("StringLiteral", "NumericLiteral")), "expression").withColumn("argument_id", F.col("argument.id")).join(keys, ["file", "argument_id"], "left")
    t = "expression_type"
    indexed = indexed.where((F.col(f"{t}.flags").bitwiseAND(F.lit(3)) == 0) & ~F.col(f"{t}.shape").rlike(COLLECTIONS) & ~F.col(f"{t}.shape").rlike(r"\[\w+: (string|number)\]") & (F.size(f"{t}.members") == 0))
    indexed = indexed.where(~((F.size(f"{t}.props") > 0) & F.coalesce("fixed", F.lit(False))))
    # scopes around a variable, the nearest last; one of that name in a scope further out is hidden
    scopes = F.transform(F.filter("ancestors", lambda a: a["kind"].isin(*SCOPES)), lambda a: a["id"])
    names = nodes.where(kind("VariableDeclaration", "Parameter") & (F.col("text") != "")).select("file", "node_id", "line", "col", "kind", "text", scopes.alias("scopes"))
    inner = names.where(kind("VariableDeclaration")).withColumn("scope", F.explode(F.slice("scopes", F.lit(1), F.greatest(F.size("scopes") - 1, F.lit(0)))))
    outer = names.select("file", "text", F.try_element_at("scopes", F.lit(-1)).alias("scope"))
    hidden = relations.covered(inner, outer, ["file", "text", "scope"]).dropDuplicates(["file", "node_id"])
    parts = {"type said without need": said, "may be null here": opened, "returns any unsaid": unsaid, "no index signature": indexed, "hides an outer variable": hidden}
    return reduce(DataFrame.unionByName, [found(df, m) for m, df in parts.items()])


@CODE_RULES.rule("typescript", "quality", "Types that switch checks off or are missing", sub_checks=11, needs=("nodes", "node_types", "types"),
                 sub_ids={"non-null assertion": "no-non-null-assertion", "explicit any": "no-explicit-any", "type said without need": "no-inferrable-types", "may be null here": "null-check", "no index signature": "unsafe-index"})
def typescript(facts: Facts, options: dict) -> DataFrame:
    rows = with_parent(with_children(facts["nodes"], "expression", "member", "heritage", "type"))
    return _typed_slips(facts).unionByName(each(rows, {
        "catch of any": kind("VariableDeclaration") & (F.col("parent_kind") == "CatchClause") & (F.col("type.kind") == "AnyKeyword"),
        "a string thrown": kind("ThrowStatement") & F.col("expression.kind").isin("StringLiteral", "TemplateExpression"),
        "double assertion": kind("AsExpression") & (F.col("expression.kind") == "AsExpression"),
        "empty interface": kind("InterfaceDeclaration") & (F.col("n_member") == 0) & (F.col("n_heritage") == 0),
        "non-null assertion": kind("NonNullExpression"),
        "explicit any": kind("AnyKeyword") & (F.coalesce(F.col("parent_kind"), F.lit("")) != "CatchClause"),
    }))


STATE_HOOKS = ("useState", "useReducer", "useTransition", "useActionState")
SAFE_VALUES = ("NewExpression", "TrueKeyword", "FalseKeyword", "NullKeyword")


def _states_set_in_effects(facts: Facts, options: dict) -> DataFrame:
    """Calls of a state's setter in an effect's own body, unless the effect runs once, or what is set is a constant or comes
    from what the effect depends on."""
    nodes, calls, named = facts["nodes"], facts["calls"], facts["node_symbols"]
    hooks = relations.covered(calls, facts["symbols"].where("origin = 'pkg:react'").select(F.col("symbol_id").alias("target_symbol")), ["target_symbol"])
    argument = lambda k, name: nodes.where((F.col("field") == "argument") & (F.col("ord") == k)).select("file", F.col("parent_id").alias("node_id"), F.col("node_id").alias(name), F.col("kind").alias(f"{name}_kind"))
    held = nodes.select("file", F.col("parent_id").alias("list")).where("list IS NOT NULL").distinct().withColumn("filled", F.lit(True))
    effects = hooks.where((F.col("name") == "useEffect") & F.col("file").endswith(".tsx")).select("file", "node_id").join(argument(0, "callback"), ["file", "node_id"]).join(argument(1, "list"), ["file", "node_id"], "left").join(held, ["file", "list"], "left")
    once = (F.col("list_kind") == "ArrayLiteralExpression") & F.col("filled").isNull()
    effects = effects.where(F.col("callback_kind").isin("ArrowFunction", "FunctionExpression") & ~F.coalesce(once, F.lit(False))).select("file", "callback", "list")
    states = hooks.where(F.col("name").isin(*options.get("stateHooks", STATE_HOOKS))).select("file", "node_id").join(nodes.where("field = 'initializer'").select("file", "node_id", F.col("parent_id").alias("declared")), ["file", "node_id"])
    second = nodes.where(kind("BindingElement") & (F.col("ord") == 1)).withColumn("declared", F.try_element_at("ancestors", F.lit(-2))["id"]).join(named, ["file", "node_id"])
    setters = relations.covered(second, states, ["file", "declared"]).select("file", F.col("symbol_id").alias("target_symbol"))
    sets = relations.covered(calls, setters, ["file", "target_symbol"]).select("file", "node_id", F.col("caller_id").alias("callback")).join(effects, ["file", "callback"]).join(argument(0, "given"), ["file", "node_id"], "left")
    sets = sets.join(held.withColumnRenamed("list", "given"), ["file", "given"], "left")
    empty = (F.col("given_kind") == "ArrayLiteralExpression") & F.col("filled").isNull()
    sets = sets.where(~F.coalesce(F.col("given_kind").isin(*SAFE_VALUES) | empty, F.lit(False)))
    names = nodes.where(kind("Identifier")).join(named, ["file", "node_id"])
    chains = nodes.where(kind("PropertyAccessExpression")).select("file", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("list"))
    wanted = names.select("file", F.col("parent_id").alias("list"), "symbol_id").unionByName(names.where("field = 'expression'").join(chains, ["file", "parent_id"]).select("file", "list", "symbol_id"))
    uses = names.select("file", "symbol_id", F.explode(F.concat(F.transform("ancestors", lambda a: a["id"]), F.array("node_id"))).alias("given"))
    guarded = sets.select("file", "node_id", "list", "given").join(uses, ["file", "given"]).join(wanted, ["file", "list", "symbol_id"], "left_semi").select("file", "node_id")
    return nodes.join(relations.uncovered(sets, guarded, ["file", "node_id"]).select("file", "node_id"), ["file", "node_id"])


@CODE_RULES.rule("react", "quality", "Components with a common slip", sub_checks=4, needs=("nodes", "calls", "symbols", "node_symbols"), sub_ids={"component in a component": "nested-component"})
def react(facts: Facts, options: dict) -> DataFrame:
    nodes = facts["nodes"].where(F.col("file").endswith(".tsx"))
    rows = with_children(nodes, "expression", "argument", "modifier")
    typed = nodes.where(kind("JsxAttribute") & F.col("text").rlike(r"^type\b")).select("file", F.col("parent_id").alias("node_id"))
    buttons = relations.uncovered(nodes.where(kind("JsxOpeningElement", "JsxSelfClosingElement") & F.col("text").rlike(r"^<?button\b")), typed, ["file", "node_id"])
    asynchronous = nodes.where(F.col("kind") == "AsyncKeyword").select("file", F.col("parent_id").alias("id"))
    effects = rows.where(kind("CallExpression") & (F.col("expression.text") == "useEffect")).withColumn("id", F.col("argument.id"))
    component = kind("FunctionDeclaration") & F.col("text").rlike("^[A-Z]")
    names = nodes.where(component).select("file", F.col("node_id").alias("outer"))
    held = nodes.where(component).withColumn("outer", F.explode(F.transform("ancestors", lambda a: a["id"])))
    nested = relations.covered(held, names, ["file", "outer"]).dropDuplicates(["file", "node_id"])
    return found(buttons, "button without a type").unionByName(found(relations.covered(effects, asynchronous, ["file", "id"]), "async effect")).unionByName(found(nested, "component in a component")).unionByName(found(_states_set_in_effects(facts, options), "state set in an effect"))


@CODE_RULES.rule("rules-of-hooks", "quality", "Hooks that are not called each time", needs=("nodes",))
def rules_of_hooks(facts: Facts, options: dict) -> DataFrame:
    """The first reason that holds: at module level, in a callback, in a loop, under a condition, after an early return."""
    rows = with_children(facts["nodes"], "expression")
    hooks = rows.where(kind("CallExpression") & F.col("expression.text").rlike(r"^(React\.)?use[A-Z]\w*$"))
    kinds = F.transform("ancestors", lambda a: a["kind"])
    owner = F.try_element_at(F.filter("ancestors", lambda a: a["kind"].isin(*FUNCTIONS)), F.lit(-1))
    owner_at = F.array_position(F.transform("ancestors", lambda a: a["id"]), owner["id"])
    callback = F.try_element_at(kinds, F.greatest(owner_at.cast("int") - 1, F.lit(1))) == "CallExpression"
    returns = facts["nodes"].where(kind("ReturnStatement") & inside("ancestors", ("IfStatement",), FUNCTIONS)).withColumn("owner", owner["id"]).groupBy("file", "owner").agg(F.min("start").alias("returned"))
    placed = hooks.withColumns({"owner": owner["id"], "callback": callback}).join(returns, ["file", "owner"], "left")
    reason = (
        F.when(F.col("owner").isNull(), "at module level").when(F.col("callback"), "in a callback").when(within(*LOOPS), "in a loop")
        .when(within("IfStatement", "ConditionalExpression", "SwitchStatement"), "under a condition").when(F.col("returned") < F.col("start"), "after a return"))
    return found(placed.withColumn("reason", reason).where("reason IS NOT NULL"), F.concat(F.lit("hook "), F.col("reason")))


@CODE_RULES.rule("no-re-export", "quality", "Exports of what another file defines", needs=("nodes", "node_symbols", "symbols"))
def no_re_export(facts: Facts, options: dict) -> DataFrame:
    """``export … from``, a finding for each name or one for all; and names that were imported before."""
    exports = with_children(facts["nodes"], "module", "specifier").where(kind("ExportDeclaration"))
    names = facts["nodes"].where((F.col("field") == "specifier") & kind("ExportSpecifier"))
    sources = exports.select("file", F.col("node_id").alias("parent_id"), F.col("module").isNotNull().alias("from_module"))
    named = names.join(sources, ["file", "parent_id"])
    foreign = named.where("NOT from_module").join(facts["node_symbols"], ["file", "node_id"]).join(facts["symbols"].select("symbol_id", "decl_file"), "symbol_id").where("decl_file <> file")
    whole = found(exports.where(F.col("module").isNotNull() & (F.col("n_specifier") == 0)), "export from another module")
    return whole.unionByName(found(named.where("from_module"), F.concat(F.lit("export from another module: "), F.col("text")))).unionByName(found(foreign, F.concat(F.lit("imported and exported: "), F.col("text"))))


@CODE_RULES.rule("no-duplicated-constants", "architecture", "Local constants that the constants folder has", needs=("nodes",))
def no_duplicated_constants(facts: Facts, options: dict) -> DataFrame:
    folder = options.get("constantsDir", "/constants/")
    constants = with_children(facts["nodes"], "initializer").where(kind("VariableDeclaration") & F.col("initializer.kind").isin("StringLiteral", "NumericLiteral"))
    constants = constants.withColumns({"value": F.col("initializer.text"), "value_kind": F.col("initializer.kind"), "shared": F.col("file").contains(folder)})
    known = constants.where("shared").select("text", "value", "value_kind", F.col("file").alias("known_file"))
    hit = relations.first_match(constants.where("NOT shared"), known, ["text", "value", "value_kind"], "known_file")
    return found(hit, F.concat(F.lit("same as in "), F.col("match")))
