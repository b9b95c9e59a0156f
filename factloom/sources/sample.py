"""A small sample of code facts: for each rule a file with lines to find and lines to leave, as trees of nodes."""

from __future__ import annotations

from dataclasses import dataclass, field

STR, NUM, BIG, OBJ, ANY, PROMISE, NULLABLE, UNION, MEMBER_A, MEMBER_B, BARE, WIDE, FUNC, ROW, HOLDER, SCHEMA, LIST, BRAND, KEYS, RECORD, FLAG = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22
REACT = 15  # symbol of the framework's hooks
TYPES = [
    (STR, 4, "string", [], [], False, True), (NUM, 8, "number", [], [], False, True), (BIG, 64, "bigint", [], [], False, True), (OBJ, 524288, "{}", [], [], False, True), (ANY, 1, "any", [], [], False, True),
    (PROMISE, 524288, "Promise", [], [], True, True), (NULLABLE, 1048576, "string | null", [STR, 12], [], False, True), (12, 65536, "null", [], [], False, True),
    (UNION, 1048576, "'a' | 'b'", [MEMBER_A, MEMBER_B], [], False, True), (MEMBER_A, 128, "'a'", [], [], False, True), (MEMBER_B, 128, "'b'", [], [], False, True), (BARE, 524288, "Bare", [], [], False, False),
    (WIDE, 524288, "Wide", [], [(f"p{k}", STR) for k in range(12)], False, True), (FUNC, 524288, "() => void", [], [], False, True), (ROW, 524288, "InferSelectModel<T>", [], [], False, True), (HOLDER, 524288, "{ row }", [], [("row", ROW)], False, True), (SCHEMA, 524288, "Schema", [], [("parse", FUNC), ("safeParse", FUNC)], False, True), (LIST, 524288, "string[]", [], [], False, True), (BRAND, 2097152, "UserId", [STR, OBJ], [], False, True), (KEYS, 524288, "Map<string, number>", [], [], False, True), (RECORD, 524288, "{ [k: string]: number }", [], [], False, True), (FLAG, 16, "boolean", [], [], False, True), (23, 1048576, "Bare | null", [BARE, 12], [], False, True), (24, 524288, "A", [], [("kind", MEMBER_A)], False, True), (25, 524288, "B", [], [("kind", MEMBER_B), ("b", STR)], False, True), (26, 1048576, "A | B", [24, 25], [], False, True), (27, 524288, "Element", [], [("type", STR), ("props", OBJ), ("key", STR)], False, True), (28, 524288, "Promise<Element>", [27], [], True, True), (29, 524288, "Row", [], [("_id", STR)], False, True), (30, 1048576, "Row | null", [29, 12], [], False, True),
]


@dataclass
class N:
    kind: str
    text: str = ""
    role: str = "child"
    line: int = 0
    type: int | None = None
    expects: int | None = None
    symbol: int | None = None
    name: str | None = None  # to be referred to
    kids: list = field(default_factory=list)
    call: dict | None = None

    def __call__(self, *kids):
        self.kids = list(kids)
        return self


def binary(op, a, b, line, **more):
    a, b = [x if isinstance(x, N) else N("Identifier", x) for x in (a, b)]
    a.role, b.role = "left", "right"
    return N("BinaryExpression", line=line, **more)(a, N(op, role="operator"), b)


def call(line, name, *arguments, target=None, chain=None, role="child", to=None, **more):
    for k, a in enumerate(arguments):
        a.role = "receiver" if name == "map" and k == 1 else "argument"
    return N("CallExpression", role=role, line=line, name=to, call={"name": name, "chain": chain or [name], "target": target}, **more)(N("Identifier", ".".join(chain or [name]), "expression"), *arguments)


def fn(text="", *kids, kind="FunctionDeclaration", **more):
    return N(kind, text, **more)(*kids)


def state(value, value_symbol, setter, setter_symbol, line=0, type=None):
    pattern = N("ArrayBindingPattern", role="name")(N("BindingElement", value, "element", symbol=value_symbol), N("BindingElement", setter, "element", symbol=setter_symbol))
    return N("VariableDeclaration")(pattern, call(line, "useState", target=REACT, role="initializer", type=type))


STATEMENT = lambda k, line, *kids, **m: N(k, role="statement", line=line, **m)(*kids)
def declares(line, name, value, symbol, role="statement"):
    value.role = "initializer"
    return N("VariableStatement", role=role, line=line)(N("VariableDeclaration", name, line=line, symbol=symbol)(value))


def assigns(line, left, right, role="statement"):
    return N("ExpressionStatement", role=role, line=line)(binary("EqualsToken", left, right, line, role="expression"))


I = lambda name, symbol, role="child": N("Identifier", name, role, symbol=symbol)  # noqa: E731, E741
TREES = {
    "banned-syntax": [N("VoidExpression", line=1), N("LabeledStatement", "again", line=2), N("StringLiteral", "a\\\nb", line=3), N("StringLiteral", "\\101", line=4), N("StringLiteral", "plain", line=5), N("DeleteExpression", line=6)(N("Identifier", "x", line=6)), binary("EqualsToken", I("window", 11), "x", 7), binary("EqualsToken", I("own", 2), "x", 8)],
    "complexity": [fn("few", *[STATEMENT("ExpressionStatement", 2) for _ in range(25)], *[N("Parameter", f"p{k}", "parameter") for k in range(4)], line=1), fn("long", *[STATEMENT("ExpressionStatement", 4) for _ in range(26)], line=3), fn("wide", *[N("Parameter", f"p{k}", "parameter") for k in range(5)], line=5),
                   fn("deep", call(7, "a", fn("", call(7, "b", fn("", call(7, "c", fn("", call(7, "d", fn("", kind="ArrowFunction", line=8)), kind="ArrowFunction", line=7)), kind="ArrowFunction", line=7)), kind="ArrowFunction", line=7)), line=6)],
    "readability": [N("AsExpression", line=1)(N("StringLiteral", "a", "expression"), N("LiteralType", "a", "type")), N("AsExpression", line=2)(N("StringLiteral", "a", "expression"), N("LiteralType", "b", "type")), N("VariableDeclaration", "self", line=3)(N("ThisKeyword", "this", "initializer")), N("SwitchStatement")(N("SwitchStatement", line=4)), N("TemplateExpression")(N("TemplateExpression", line=5))],
    "no-identical-binary-operands": [binary("MinusToken", "a", "a", 1), binary("MinusToken", "a", "b", 2), binary("PlusToken", "a", "a", 3)],
    "no-collection-size-mischeck": [binary(op, N("PropertyAccessExpression", "x.length"), N("NumericLiteral", n), i) for i, (op, n) in enumerate([("GreaterThanEqualsToken", "0"), ("LessThanToken", "0"), ("GreaterThanToken", "0"), ("EqualsEqualsToken", "-1"), ("LessThanToken", "4")], 1)],
    "jsx-no-useless-fragment": [N("JsxFragment", line=1)(N("JsxText", "  "), N("JsxElement")), N("JsxFragment", line=2)(N("JsxElement"), N("JsxElement")), N("JsxFragment", line=3)(N("JsxExpression"))],
    "no-all-duplicated-branches": [N("IfStatement", line=1)(N("Block", "f()", "branch"), N("Block", "f()", "else")), N("IfStatement", line=2)(N("Block", "f()", "branch"), N("Block", "g()", "else")), N("IfStatement", line=3)(N("Block", "f()", "branch"), N("Block", "f()", "branch"))],
    "error-handling": [N("CatchClause", "catch {}", line=1), N("CatchClause", "catch { // fine }", line=2), N("CatchClause", "catch", line=3)(STATEMENT("ThrowStatement", 4, N("NewExpression", line=4)(N("Identifier", "Error", "expression"), N("Identifier", "m", "argument"))), STATEMENT("ThrowStatement", 5, N("NewExpression", line=5)(N("Identifier", "Error", "expression"), N("Identifier", "m", "argument"), N("Identifier", "o", "argument"))))],
    "no-empty-function": [fn("function f() {}", line=1), fn("function f() { g() }", STATEMENT("ExpressionStatement", 2), line=2), call(3, "f", fn("() => {}", kind="ArrowFunction", line=3)), N("VariableDeclaration", "v", line=4)(fn("() => {}", kind="ArrowFunction", line=4))],
    "no-multiline-comments": [N("Comment", "/** a\n b */", line=1), N("Comment", "// a", line=2)],
    "naming-convention": [N("VariableDeclaration", "NaN", line=1), N("VariableDeclaration", "loop", line=2), N("LabeledStatement", "loop", line=3), N("LabeledStatement", "other", line=4)],
    "correctness": [binary("EqualsToken", "a", "a", 1), binary("EqualsEqualsEqualsToken", "a", "a", 2), N("WhileStatement", line=3)(STATEMENT("ReturnStatement", 3)), N("Block", line=20)(STATEMENT("BreakStatement", 20), STATEMENT("FunctionDeclaration", 21), STATEMENT("ExpressionStatement", 22), STATEMENT("ExpressionStatement", 23)), N("CatchClause", "catch (e) { throw e }", line=4)(N("ThrowStatement", "throw e", "statement", 4)), N("ArrayLiteralExpression", line=5)(N("OmittedExpression", line=5)),
                    N("FinallyBlock", line=6)(N("ReturnStatement", line=7), N("AwaitExpression", line=8), fn("", N("ReturnStatement", line=9))), N("SetAccessor", line=10)(N("ReturnStatement", line=11)(N("Identifier", "x", "expression"))), binary("EqualsToken", "a", "b", 12), fn("f", N("Parameter", "a", "parameter", symbol=140), binary("PlusEqualsToken", I("a", 140), "b", 30), N("PostfixUnaryExpression", "a++", line=31)(N("PlusPlusToken", role="operator"), I("a", 140, "expression")), N("PrefixUnaryExpression", "!a", line=32)(N("ExclamationToken", role="operator"), I("a", 140, "expression"))),
                    N("VariableDeclarationList", "let k = 0")(N("VariableDeclaration", "k", symbol=141)), N("VariableDeclarationList", "const c = 0")(N("VariableDeclaration", "c", symbol=142)),
                    N("ForStatement")(fn("", I("k", 141), kind="ArrowFunction", line=33), fn("", I("c", 142), kind="ArrowFunction", line=34), fn("", N("VariableDeclarationList", "let own")(N("VariableDeclaration", "own", symbol=143)), I("own", 143), kind="ArrowFunction", line=35))],
    "logic": [N("IfStatement", line=1)(N("Identifier", "a", "condition"), N("IfStatement", role="else", line=2)(N("Identifier", "a", "condition"))), N("IfStatement", line=3)(N("TrueKeyword", "true", "condition")), N("Block", line=4)(*[STATEMENT("ExpressionStatement", 4 + k, binary("EqualsToken", N("ElementAccessExpression", e), N("NumericLiteral", "1"), 4 + k, role="expression")) for k, e in enumerate(["x[0]", "x[0]", "x[1]"], 1)]), N("JsxExpression", line=10)(binary("AmpersandAmpersandToken", N("Identifier", "n", type=NUM), N("JsxElement"), 10, role="expression")), N("JsxExpression", line=11)(binary("AmpersandAmpersandToken", N("Identifier", "s", type=STR), N("JsxElement"), 11, role="expression")),
              N("Block")(declares(12, "v", N("NumericLiteral", "1"), 100), assigns(13, I("v", 100), N("NumericLiteral", "2")), declares(14, "w", N("NumericLiteral", "1"), 101), assigns(15, I("w", 101), N("CallExpression", "f(w)")(I("w", 101))), declares(16, "u", N("NumericLiteral", "1"), 102), assigns(17, I("z", 103), N("NumericLiteral", "2")))],
    "no-deprecated-api": [N("PropertyAccessExpression", "x.__proto__", line=1), N("PropertyAccessExpression", "arguments.callee", line=2), binary("EqualsToken", N("PropertyAccessExpression", "A.prototype"), "b", 3), N("PropertyAccessExpression", "x.proto", line=4)],
    "no-useless-code": [N("ComputedPropertyName", line=1)(N("StringLiteral", "a", "expression")), binary("PlusToken", N("StringLiteral", "a"), N("StringLiteral", "b"), 2), N("PropertyAssignment", line=3)(N("Identifier", "a", "name"), N("Identifier", "a", "initializer")), N("PropertyAssignment", line=4)(N("Identifier", "a", "name"), N("Identifier", "b", "initializer")), call(5, "call", N("Identifier", "o"), N("Identifier", "x"), chain=["o", "f", "call"]), call(6, "apply", N("Identifier", "p"), chain=["o", "f", "apply"])],
    "no-implicit-coercion": [binary("EqualsEqualsToken", "a", "b", 1), binary("EqualsEqualsToken", "a", N("NullKeyword", "null"), 2), N("PrefixUnaryExpression", "+a", line=3)(N("PlusToken", role="operator"), N("Identifier", "a", "expression")), binary("PlusToken", N("StringLiteral", ""), "b", 4), N("PrefixUnaryExpression", "!!a", "condition", 5), N("PrefixUnaryExpression", "!!a", line=6), N("IfStatement")(binary("AmpersandAmpersandToken", N("PrefixUnaryExpression", "!!a", line=7), N("ParenthesizedExpression", "(!!b)")(N("PrefixUnaryExpression", "!!b", "expression", 8)), 7, role="condition")), N("IfStatement")(binary("PlusToken", N("PrefixUnaryExpression", "!!a", line=9), "b", 9, role="condition"))],
    "safety": [fn("", N("ReturnStatement", line=1)(N("Identifier", "x", "expression")), kind="Constructor"), binary("MinusToken", N("PropertyAccessExpression", "a?.b"), "c", 2), call(3, "parseInt", N("Identifier", "x")), call(4, "parseInt", N("Identifier", "x"), N("NumericLiteral", "10")), call(5, "reject", N("StringLiteral", "no")), N("NewExpression", line=6)(fn("", N("AsyncKeyword", role="modifier"), kind="ArrowFunction", line=6)), N("NewExpression", line=10)(N("Identifier", "Promise", "expression"), fn("", STATEMENT("ReturnStatement", 11, N("Identifier", "x", "expression")), STATEMENT("ReturnStatement", 12), kind="ArrowFunction", role="argument")),
               N("VariableDeclarationList", "let outer")(N("VariableDeclaration", "outer", symbol=130)), fn("f", STATEMENT("ExpressionStatement", 13, binary("EqualsToken", I("outer", 130), N("AwaitExpression"), 13, role="expression"))), N("Block")(N("VariableDeclaration", "near", symbol=131), binary("EqualsToken", I("near", 131), N("AwaitExpression"), 14)),
               N("WhileStatement", line=15)(I("go", 132, "expression"), N("Block", role="statement")), N("WhileStatement", line=16)(I("go", 133, "expression"), N("Block", role="statement")(binary("EqualsToken", I("go", 133), "x", 16))),
               N("CallExpression", line=17)(N("PropertyAccessExpression", "xs.map", "expression"), fn("", STATEMENT("ExpressionStatement", 17, fn("", STATEMENT("ReturnStatement", 17), kind="ArrowFunction")), kind="ArrowFunction", role="argument", line=17)),
               N("CallExpression", line=18)(N("PropertyAccessExpression", "xs.map", "expression"), fn("", STATEMENT("IfStatement", 18, STATEMENT("ReturnStatement", 18)), kind="ArrowFunction", role="argument", line=18)), N("CallExpression", line=19)(N("PropertyAccessExpression", "xs.forEach", "expression"), fn("", STATEMENT("ExpressionStatement", 19), kind="ArrowFunction", role="argument", line=19))],
    "security": [N("JsxAttribute", "dangerouslySetInnerHTML", line=1), N("JsxAttribute", "href", line=2)(N("StringLiteral", " JavaScript:x", "initializer")), call(3, "write", chain=["document", "write"]), N("JsxAttribute", "href", line=4)(N("StringLiteral", "/a", "initializer")), binary("EqualsToken", N("ElementAccessExpression", "o[k]")(N("Identifier", "o", "expression", type=BARE), N("Identifier", "k", "argument", type=STR)), "v", 5), binary("EqualsToken", N("ElementAccessExpression", "o[k]")(N("Identifier", "o", "expression", type=RECORD), N("Identifier", "k", "argument", type=STR)), "v", 6),
                 binary("PlusEqualsToken", N("ElementAccessExpression", "o[k]")(N("Identifier", "o", "expression", type=BARE), N("Identifier", "k", "argument", type=UNION)), "v", 7), binary("EqualsToken", N("ElementAccessExpression", "o[f()]")(N("Identifier", "o", "expression", type=BARE), N("CallExpression", "f()", "argument")), "v", 8),
                 binary("EqualsToken", N("ElementAccessExpression", "o[a.b]")(N("Identifier", "o", "expression", type=BARE), N("PropertyAccessExpression", "a.b", "argument")), "v", 9)],
    "simplification": [N("IfStatement", line=1)(N("Block", "", "then")(STATEMENT("ReturnStatement", 1, N("Identifier", "x", "expression"))), N("Block", "", "else")), N("WhileStatement", line=2)(STATEMENT("ExpressionStatement", 2), STATEMENT("ContinueStatement", 3)), fn("f", STATEMENT("ReturnStatement", 4)), N("IfStatement", line=5)(N("Block", "", "then")(STATEMENT("IfStatement", 6))), N("ForStatement", line=7), N("ForStatement", line=8)(N("Identifier", "i", "initializer")), fn("", kind="Constructor", line=10), fn("", STATEMENT("ExpressionStatement", 11, N("CallExpression", role="expression", line=11)(N("SuperKeyword", role="expression"))), kind="Constructor", line=11), fn("", N("Parameter", "p", "parameter"), kind="Constructor", line=12),
                       N("Block")(N("IfStatement", role="statement", line=13)(N("Block", "", "then")(STATEMENT("ReturnStatement", 13, N("TrueKeyword", "true", "expression")))), STATEMENT("ReturnStatement", 14, N("FalseKeyword", "false", "expression"))),
                       N("Block")(N("IfStatement", role="statement", line=15)(STATEMENT("ReturnStatement", 15, N("TrueKeyword", "true", "expression"))), STATEMENT("ReturnStatement", 16, N("FalseKeyword", "false", "expression"))),
                       N("Block")(declares(17, "x", N("CallExpression", "f()"), 110), STATEMENT("ReturnStatement", 18, I("x", 110, "expression"))), N("Block")(declares(19, "x", N("CallExpression", "f()"), 111), STATEMENT("ReturnStatement", 20, I("y", 112, "expression"))),
                       N("Block")(declares(21, "o", N("ObjectLiteralExpression", "{}"), 113), STATEMENT("ExpressionStatement", 22, binary("EqualsToken", N("PropertyAccessExpression", "o.a")(I("o", 113, "expression")), "b", 22, role="expression")))],
    "syntax": [N("VariableDeclarationList", "var a", line=1), N("VariableDeclarationList", "let a", line=2), N("Identifier", "arguments", line=3), call(4, "pow", chain=["Math", "pow"]), call(5, "apply", N("NullKeyword", "null"), chain=["f", "apply"]), N("NewExpression", line=6)(N("Identifier", "RegExp", "expression"), N("StringLiteral", "a", "argument")), N("VariableDeclarationList", "let a = 1, b = 2")(N("VariableDeclaration", "a", line=7, symbol=120)(N("NumericLiteral", "1", "initializer")), N("VariableDeclaration", "b", line=8, symbol=121)(N("NumericLiteral", "2", "initializer"))), N("PostfixUnaryExpression", "b++", line=9)(I("b", 121, "expression")),
               binary("PlusToken", N("Identifier", "s", type=STR), N("Identifier", "n", type=NUM), 10), binary("PlusToken", N("StringLiteral", "a", type=STR), N("StringLiteral", "b", type=STR), 11), binary("PlusToken", N("Identifier", "n", type=NUM), N("Identifier", "n", type=NUM), 12),
               call(13, "parseInt", N("StringLiteral", "11"), N("NumericLiteral", "2"), target=11), call(14, "parseInt", N("StringLiteral", "11"), N("NumericLiteral", "10"), target=11)],
    "typescript": [N("ThrowStatement", line=1)(N("StringLiteral", "x", "expression")), N("AsExpression", line=2)(N("AsExpression", role="expression", line=3)), N("InterfaceDeclaration", line=4), N("InterfaceDeclaration", line=5)(N("PropertySignature", role="member")), N("NonNullExpression", line=6), N("AnyKeyword", line=7), N("VariableDeclaration", "n", line=20)(N("NumberKeyword", "number", "type", type=NUM), N("NumericLiteral", "1", "initializer", type=NUM)), N("VariableDeclaration", "m", line=21)(N("NumberKeyword", "number", "type", type=NUM), N("StringLiteral", "1", "initializer", type=STR)),
                   N("PropertyAccessExpression", "x.y", line=22)(N("Identifier", "x", "expression", type=NULLABLE)), N("PropertyAccessExpression", "x?.y", line=23)(N("Identifier", "x", "expression", type=NULLABLE)), N("IfStatement")(N("PropertyAccessExpression", "x.y", line=24)(N("Identifier", "x", "expression", type=NULLABLE))),
                   N("CallExpression", "f?.(x.y)")(N("PropertyAccessExpression", "x.y", line=25)(N("Identifier", "x", "expression", type=NULLABLE))), fn("loose", line=26, type=ANY), fn("told", N("AnyKeyword", "any", "type", line=27), line=27, type=ANY), fn("strict", line=28, type=STR),
                   N("ElementAccessExpression", "o[k]", line=29)(N("Identifier", "o", "expression", type=BARE), N("Identifier", "k", "argument", type=STR)), N("ElementAccessExpression", "xs[k]", line=30)(N("Identifier", "xs", "expression", type=LIST), N("Identifier", "k", "argument", type=NUM)),
                   N("ElementAccessExpression", "w[k]", line=31)(N("Identifier", "w", "expression", type=WIDE), N("Identifier", "k", "argument", type=UNION)), N("ElementAccessExpression", "w[k]", line=32)(N("Identifier", "w", "expression", type=WIDE), N("Identifier", "k", "argument", type=STR)),
                   fn("outer", N("Parameter", "shade", "parameter"), fn("inner", N("VariableDeclaration", "shade", line=33), N("VariableDeclaration", "fresh", line=34)), fn("sister", N("VariableDeclaration", "fresh", line=35)))],
    "react": [N("JsxSelfClosingElement", "<button />", line=1), N("JsxSelfClosingElement", "<button />", line=2)(N("JsxAttribute", "type")), call(3, "useEffect", fn("", N("AsyncKeyword"), kind="ArrowFunction")), call(4, "useEffect", fn("", kind="ArrowFunction")), fn("Outer", fn("Inner", line=6), fn("inner", line=7), line=5), fn("Own", state("v", 180, "setV", 181), N("VariableDeclaration", "p", symbol=182),
               call(10, "useEffect", fn("", call(11, "setV", I("q", 183), target=181), call(12, "setV", N("NullKeyword", "null"), target=181), call(13, "setV", N("ArrayLiteralExpression"), target=181), fn("", call(14, "setV", I("q", 183), target=181), kind="ArrowFunction"), kind="ArrowFunction"), target=REACT),
               call(15, "useEffect", fn("", call(16, "setV", N("CallExpression")(I("p", 182)), target=181), call(17, "setV", N("ArrayLiteralExpression")(I("q", 183)), target=181), kind="ArrowFunction"), N("ArrayLiteralExpression")(I("p", 182)), target=REACT),
               call(18, "useEffect", fn("", call(19, "setV", I("q", 183), target=181), kind="ArrowFunction"), N("ArrayLiteralExpression"), target=REACT), line=9)],
    "rules-of-hooks": [call(1, "useState"), fn("C", call(2, "useState"), N("ForStatement")(call(3, "useMemo")), N("IfStatement")(call(4, "useMemo")), call(5, "map", fn("", call(5, "useId"), kind="ArrowFunction")), N("IfStatement")(N("ReturnStatement")), call(6, "useRef"))],
    "no-re-export": [N("ExportDeclaration", line=1)(N("StringLiteral", "./a", "module")), N("ExportDeclaration", line=2), N("ExportDeclaration", line=3)(N("StringLiteral", "./a", "module"), N("ExportSpecifier", "a", "specifier", 4), N("ExportSpecifier", "b", "specifier", 5)), N("ExportDeclaration", line=6)(N("ExportSpecifier", "old", "specifier", 7, symbol=1), N("ExportSpecifier", "own", "specifier", 8, symbol=150))],
    "no-duplicated-constants": [N("VariableDeclaration", "LIMIT", line=1)(N("NumericLiteral", "5", "initializer")), N("VariableDeclaration", "LIMIT", line=2)(N("NumericLiteral", "6", "initializer"))],
    "no-local-constants": [N("VariableDeclaration", "MAX_SIZE", line=1)(N("NumericLiteral", "5", "initializer")), N("VariableDeclaration", "ONE", line=2)(N("NumericLiteral", "1.0", "initializer")), N("VariableDeclaration", "NAME", line=3)(N("AsExpression", "'a' as const", "initializer")(N("StringLiteral", "a", "expression"))),
                           N("VariableDeclaration", "EMPTY", line=4)(N("StringLiteral", "", "initializer")), N("VariableDeclaration", "TABLE", line=5)(N("ObjectLiteralExpression", "{}", "initializer")), N("VariableDeclaration", "below", line=6)(N("NumericLiteral", "7", "initializer")),
                           N("VariableDeclaration", "BELOW", line=7)(N("PrefixUnaryExpression", "-7", "initializer")(N("NumericLiteral", "7", "expression"))), N("VariableDeclaration", "LEAST", line=8)(N("PrefixUnaryExpression", "-1", "initializer"))],
    "schema/a": [N("VariableDeclaration", "user", line=3, type=SCHEMA), N("VariableDeclaration", "nameSchema", line=4, type=STR), N("VariableDeclaration", "hidden", line=5, type=SCHEMA)],
    "schema/b": [N("VariableDeclaration", "user", line=6, type=SCHEMA), N("VariableDeclaration", "nameSchema", line=7, type=STR), N("VariableDeclaration", "hidden", line=8, type=SCHEMA), N("VariableDeclaration", "alone", line=9, type=SCHEMA)],
    "/constants/shared": [N("VariableDeclaration", "LIMIT", line=1)(N("NumericLiteral", "5", "initializer"))],
    "await-non-thenable": [N("AwaitExpression", line=k)(N("Identifier", "x", "expression", type=t)) for k, t in enumerate([STR, PROMISE, ANY], 1)],
    "no-floating-promises": [N("ExpressionStatement", line=1)(call(1, "f", role="expression", type=PROMISE)), N("ExpressionStatement", line=2)(call(2, "catch", role="expression", type=PROMISE, chain=["f", "catch"])), N("ExpressionStatement", line=3)(call(3, "f", role="expression", type=STR))],
    "restrict-plus-operands": [binary("PlusToken", N("Identifier", "a", type=a), N("Identifier", "b", type=b), k) for k, (a, b) in enumerate([(STR, NUM), (NUM, NUM), (BIG, NUM), (NUM, STR)], 1)],
    "restrict-template-expr": [N("TemplateSpan", line=k)(N("Identifier", "a", "expression", type=t)) for k, t in enumerate([OBJ, STR, ANY, NULLABLE], 1)],
    "no-base-to-string": [N("PropertyAccessExpression", "x.toString", line=k)(N("Identifier", "x", "expression", type=t)) for k, t in enumerate([BARE, OBJ], 1)] + [binary("PlusToken", N("Identifier", "a", type=STR), N("Identifier", "b", type=BARE), 3)],
    "prefer-nullish-coalescing": [binary("BarBarToken", N("Identifier", "a", type=NULLABLE), "b", 1), binary("BarBarToken", N("Identifier", "a", type=NULLABLE), "b", 2, role="condition"), binary("BarBarToken", N("Identifier", "a", type=STR), "b", 3), N("WhileStatement")(N("PrefixUnaryExpression", "!(a || b)", "expression")(N("ParenthesizedExpression", "(a || b)", "expression")(binary("BarBarToken", N("Identifier", "a", type=NULLABLE), "b", 4, role="expression"))))],
    "unnecessary-type-assertion": [N("AsExpression", line=k, type=t)(N("Identifier", "a", "expression", type=STR)) for k, t in enumerate([STR, NUM, ANY], 1)],
    "prefer-satisfies-over-as": [N("AsExpression", line=1, type=BARE)(N("ObjectLiteralExpression", "{}", "expression", type=OBJ)), N("AsExpression", line=2, type=OBJ)(N("ObjectLiteralExpression", "{}", "expression", type=OBJ))],
    "exhaustive-switch": [N("SwitchStatement", line=k)(N("Identifier", "x", "expression", type=UNION), *[N("CaseClause")(N("StringLiteral", "", "expression", type=t)) for t in cases], *([N("DefaultClause")] if default else [])) for k, (cases, default) in enumerate([([MEMBER_A], False), ([MEMBER_A, MEMBER_B], False), ([MEMBER_A], True)], 1)],
    "any-propagation": [N("VariableDeclaration", "a", line=1)(N("Identifier", "x", "initializer", type=ANY)), N("VariableDeclaration", "b", line=2)(call(2, "parse", role="initializer", type=ANY, chain=["JSON", "parse"])), N("ReturnStatement", line=3)(N("Identifier", "x", "expression", type=STR))],
    "cache-primitive-args": [call(1, "cache", fn("", N("Parameter", "a", line=1, type=STR), N("Parameter", "b", line=2, type=OBJ), kind="ArrowFunction"))],
    "deprecated-usage": [N("Identifier", "old", line=1, symbol=1), N("Identifier", "fine", line=2, symbol=2)],
    "no-weak-crypto": [call(1, "createHash", N("StringLiteral", "MD5"), target=10), call(2, "createHash", N("StringLiteral", "sha256"), target=10), call(3, "createHash", N("StringLiteral", "md5"), target=2)],
    "no-implied-eval": [call(1, "setTimeout", N("StringLiteral", "x()", type=STR), target=11), call(2, "setTimeout", N("Identifier", "f", type=OBJ), target=11), call(3, "setTimeout", N("StringLiteral", "x", type=STR), target=2)],
    "no-client-data-fetch": [call(1, "fetch", N("StringLiteral", "/api/a"), target=11), call(2, "fetch", N("StringLiteral", "https://a"), target=11), call(3, "get", N("StringLiteral", "x"), target=12)],
    "no-dynamic-sql": [call(1, "execute", N("Identifier", "x"), chain=["db", "execute"]), call(2, "execute", N("StringLiteral", "SELECT"), chain=["db", "execute"]), N("VariableDeclaration", "q", line=3)(N("TaggedTemplateExpression", "sql`x`", "initializer")), call(4, "execute", N("Identifier", "q"), chain=["db", "execute"])],
    "no-db-antipatterns": [call(1, "transaction", chain=["db", "transaction"]), N("ForStatement")(N("AwaitExpression")(call(2, "from", chain=["db", "select", "from"]))), N("AwaitExpression")(call(3, "from", chain=["db", "select", "from"]))],
    "missing-returning": [N("VariableDeclaration", "a")(N("AwaitExpression")(call(1, "values", chain=["db", "insert", "values"]))), N("VariableDeclaration", "b")(N("AwaitExpression")(call(2, "returning", chain=["db", "insert", "returning"]))), N("AwaitExpression")(call(3, "values", chain=["db", "insert", "values"]))],
    "cache-caller-count": [N("VariableDeclaration", "a", line=1, symbol=20)(call(1, "cache", role="initializer")), N("VariableDeclaration", "b", line=2, symbol=21)(call(2, "cache", role="initializer")), call(3, "a", target=20), call(4, "b", target=21), call(5, "b", target=21)],
    "effect-cleanup": [call(1, "useEffect", fn("", call(2, "setInterval"), call(3, "addEventListener"), fn("", call(4, "clearInterval"), kind="ArrowFunction"), kind="ArrowFunction")), call(5, "setInterval")],
    "input-validation": [fn("bad", N("Parameter", "a", "parameter"), line=1), fn("own", N("Parameter", "a", "parameter"), call(2, "safeParse"), line=2), fn("through", N("Parameter", "a", "parameter"), call(3, "helper", target=30), line=3), fn("helper", call(4, "safeParse"), line=4, symbol=30), fn("hidden", N("Parameter", "a", "parameter"), line=5)],
    "state-hooks-cluster": [fn("C", *[state("a", None, "setA", None, 2 + k) for k in range(5)], line=1), fn("D", *[state("a", None, "setA", None, 8) for _ in range(4)], line=7), fn("E", state("a", None, "setA", None, 11, NULLABLE), state("b", None, "setB", None, 12, NULLABLE), line=10),
                            fn("F", state("s", None, "setS", None, 15, UNION), state("d", None, "setD", None, 16, 23), line=14), fn("G", state("s", None, "setS", None, 18, UNION), state("d", None, "setD", None, 19, STR), line=17),
                            fn("H", state("on", 170, "setOn", 171, 21, FLAG), N("VariableDeclaration", "id", symbol=172)(call(22, "useRef", target=REACT, role="initializer", type=NUM)), fn("", call(23, "setOn", target=171), binary("EqualsToken", N("PropertyAccessExpression", "id.current")(I("id", 172, "expression")), "x", 24), kind="ArrowFunction"), line=20),
                            fn("K", state("on", 173, "setOn", 174, 26, FLAG), N("VariableDeclaration", "id", symbol=175)(call(27, "useRef", target=REACT, role="initializer", type=NUM)), fn("", call(28, "setOn", target=174), kind="ArrowFunction"), fn("", binary("EqualsToken", N("PropertyAccessExpression", "id.current")(I("id", 175, "expression")), "x", 29), kind="ArrowFunction"), line=25)],
    "performance": [N("WhileStatement")(N("NewExpression", line=5)(N("Identifier", "RegExp", "expression")), N("RegularExpressionLiteral", line=6)), call(1, "readFileSync", target=13), call(2, "readFileSync", target=2), call(3, "h", chain=list("abcdefgh"), target=2), call(4, "h", chain=list("abc"), target=2),
                    call(7, "map", fn("", call(8, "push", chain=["ys", "push"]), kind="ArrowFunction"), N("Identifier", "xs", type=LIST), chain=["xs", "map"]), call(9, "map", fn("", call(10, "push", chain=["ys", "push"]), kind="ArrowFunction"), N("Identifier", "q", type=OBJ), chain=["q", "map"]),
                    N("DeleteExpression", line=11)(N("ElementAccessExpression", "xs[0]", "expression")(N("Identifier", "xs", "expression", type=LIST))), N("DeleteExpression", line=12)(N("ElementAccessExpression", "o[0]", "expression")(N("Identifier", "o", "expression", type=OBJ)))],
    **{rule: [fn("f", N("Parameter", "p", name="p"), N("Identifier", "v", name="v"), call(1, name, N("Identifier", "v", name="used"), target=target), call(2, name, N("StringLiteral", "x"), target=target), call(3, name, N("Identifier", "p", name="other"), target=2))]
       for rule, name, target in [("no-child-process", "exec", 14), ("no-non-literal-fs-path", "readFile", 13), ("no-non-literal-regexp", "RegExp", 11), ("no-non-literal-require", "require", 11), ("no-ssrf", "fetch", 11)]},
    "prefer-modern-api": [binary("GreaterThanToken", N("CallExpression", "a.indexOf(b)"), "-1", 1), binary("EqualsEqualsEqualsToken", N("CallExpression", "a.indexOf(b)"), "0", 2), N("DeleteExpression", line=3), call(4, "assign", N("ObjectLiteralExpression", "{}"), chain=["Object", "assign"]), call(5, "assign", N("Identifier", "x"), chain=["Object", "assign"]), N("ElementAccessExpression", "a.b[a.b.length - 1]", line=6), N("ElementAccessExpression", "a[b.length - 1]", line=7)],
    "prefer-optional-chain": [binary("AmpersandAmpersandToken", "a", N("PropertyAccessExpression", "a.b"), 1), binary("AmpersandAmpersandToken", "a", N("PropertyAccessExpression", "ab.c"), 2), binary("AmpersandAmpersandToken", N("BinaryExpression", "a != null"), N("PropertyAccessExpression", "a.b"), 3)],
    "promise-all-opportunity": [N("Block")(STATEMENT("VariableStatement", 1, N("VariableDeclaration", "a", symbol=50)(N("AwaitExpression"))), STATEMENT("VariableStatement", 2, N("VariableDeclaration", "b", symbol=51)(N("AwaitExpression")(N("Identifier", "a", symbol=50)))), STATEMENT("ExpressionStatement", 3, N("AwaitExpression")), STATEMENT("ExpressionStatement", 4)),
                                N("TryStatement")(N("Block")(STATEMENT("ExpressionStatement", 5, N("AwaitExpression")), STATEMENT("ExpressionStatement", 6, N("AwaitExpression"))))],
    "exhaustive-deps": [fn("C", N("Parameter", "p", symbol=60), N("VariableDeclaration", "q", symbol=61), state("r", 64, "setR", 62), N("VariableDeclaration", "ref", symbol=65)(call(0, "useRef", target=REACT, role="initializer")),
                           N("VariableDeclarationList", "const k = 5")(N("VariableDeclaration", "k", symbol=66)(N("NumericLiteral", "5", "initializer"))),
                           call(1, "useEffect", fn("", *[N("Identifier", x, symbol=y) for x, y in [("p", 60), ("q", 61), ("setR", 62), ("r", 64), ("ref", 65), ("k", 66), ("g", 63)]], kind="ArrowFunction"), N("ArrayLiteralExpression")(N("Identifier", "p", symbol=60)), target=REACT),
                           call(2, "useMemo", fn("", N("Identifier", "p", symbol=60), kind="ArrowFunction"), N("ArrayLiteralExpression")(N("Identifier", "p", symbol=60)), target=REACT), call(3, "useEffect", fn("", N("Identifier", "q", symbol=61), kind="ArrowFunction"), target=REACT),
                           call(4, "useLayoutEffect", fn("", N("Identifier", "q", symbol=61), kind="ArrowFunction"), N("ArrayLiteralExpression"), target=REACT), call(5, "useEffect", fn("", N("Identifier", "q", symbol=61), kind="ArrowFunction"), N("ArrayLiteralExpression"), target=2))],
    "narrow-param-type": [fn("f", N("Parameter", "a", line=1, symbol=70, type=WIDE), N("PropertyAccessExpression", "a.p1")(N("Identifier", "a", "expression", symbol=70))), fn("g", N("Parameter", "b", line=2, symbol=71, type=WIDE), N("PropertyAccessExpression", "b.p1")(N("Identifier", "b", "expression", symbol=71)), call(2, "h", N("Identifier", "b", symbol=71))), fn("h", N("Parameter", "c", line=3, symbol=72, type=OBJ)), fn("i", N("Parameter", "d", line=4, symbol=160)(N("TypeReference", "Partial", "type")(N("TypeReference", "Wide", "typeArgument", type=WIDE))), N("PropertyAccessExpression", "d.p1")(I("d", 160, "expression"))), fn("j", N("Parameter", "e", line=5, symbol=161, type=WIDE)(N("TypeReference", "Partial", "type")(N("TypeReference", "Wide", "typeArgument", type=WIDE))), *[N("PropertyAccessExpression", f"e.p{k}")(I("e", 161, "expression")) for k in range(6)])],
    "no-async-client-component": [fn("Page", N("AsyncKeyword", role="modifier"), line=1, type=28), fn("Plain", line=2, type=27), fn("Hidden", N("AsyncKeyword", role="modifier"), line=3, type=28), fn("loads", N("AsyncKeyword", role="modifier"), line=4, type=PROMISE),
                                  N("VariableDeclaration", "Card", line=5)(fn("", N("AsyncKeyword", role="modifier"), kind="ArrowFunction", role="initializer", type=28))],
    "no-misused-promises": [call(1, "forEach", fn("", N("AsyncKeyword", role="modifier"), kind="ArrowFunction", expects=FUNC)), call(2, "forEach", fn("", kind="ArrowFunction", expects=FUNC)), call(3, "map", fn("", N("AsyncKeyword", role="modifier"), kind="ArrowFunction", expects=PROMISE)),
                            call(4, "useEffect", fn("", N("AsyncKeyword", role="modifier"), kind="ArrowFunction"), target=REACT), call(5, "useEffect", fn("", N("AsyncKeyword", role="modifier"), kind="ArrowFunction"), target=2)],
    "no-underscore-prefix": [N("VariableDeclaration", "_a", line=1), N("VariableDeclaration", "_", line=2), N("BindingElement", "_b", line=3), N("ObjectLiteralExpression", expects=29)(N("PropertyAssignment", "_id", "property", 4), N("PropertyAssignment", "_other", "property", 5)), N("ObjectLiteralExpression")(N("PropertyAssignment", "_id", "property", 6)),
                             N("ObjectLiteralExpression", expects=30)(N("ShorthandPropertyAssignment", "_id", "property", 7))],
    "no-redundant-zod-parse": [call(1, "parse", N("Identifier", "a", type=STR), chain=["Schema", "parse"], type=STR), call(2, "parse", N("Identifier", "a", type=ANY), chain=["Schema", "parse"], type=STR), call(3, "parse", N("Identifier", "a", type=STR), chain=["Schema", "catch", "parse"], type=STR), call(4, "parse", N("Identifier", "a", type=STR), chain=["Schema", "parse"], type=NUM)],
    "unbranded-type-consistency": [N("Parameter", "userId", line=1, type=STR), N("Parameter", "user", line=2, type=STR), N("Parameter", "userId", line=3, type=NUM), call(4, "set", N("Identifier", "k", type=BRAND), chain=["m", "set"]), N("CallExpression", line=5, call={"name": "get", "chain": ["m", "get"], "target": None})(N("Identifier", "m", "receiver", type=KEYS), N("Identifier", "k", "argument", type=BRAND)),
                                   N("CallExpression", line=6, call={"name": "get", "chain": ["m", "get"], "target": None})(N("Identifier", "m", "receiver", type=KEYS), N("Identifier", "k", "argument", type=STR)), N("ElementAccessExpression", "r[k]", line=7)(N("Identifier", "r", "expression", type=RECORD), N("Identifier", "k", "argument", type=BRAND)), N("ElementAccessExpression", "r[k]", line=8)(N("Identifier", "r", "expression", type=BARE), N("Identifier", "k", "argument", type=BRAND))],
    "prefer-literal-union": [binary("EqualsEqualsEqualsToken", N("Identifier", "a", type=STR), N("StringLiteral", "x"), 1), binary("EqualsEqualsEqualsToken", N("Identifier", "a", type=UNION), N("StringLiteral", "x"), 2), binary("EqualsEqualsEqualsToken", N("Identifier", "a", type=STR), N("StringLiteral", ""), 3), binary("EqualsEqualsEqualsToken", N("StringLiteral", "x"), N("Identifier", "a", type=STR), 4), binary("EqualsEqualsEqualsToken", N("Identifier", "a", type=STR, symbol=11), N("StringLiteral", "x"), 5),
                             fn("f", N("IfStatement")(binary("EqualsEqualsEqualsToken", N("Identifier", "b", type=STR, symbol=190), N("StringLiteral", "x"), 6, role="condition"), N("Block", "", "then")(call(7, "g", N("Identifier", "b", symbol=190, expects=UNION))))),
                             fn("f", N("IfStatement")(binary("EqualsEqualsEqualsToken", N("Identifier", "b", type=STR, symbol=191), N("StringLiteral", "x"), 8, role="condition"), N("Block", "", "then")(STATEMENT("ReturnStatement", 9, N("Identifier", "b", "expression", symbol=191)))), type=UNION),
                             fn("f", N("IfStatement")(binary("EqualsEqualsEqualsToken", N("Identifier", "b", type=STR, symbol=192), N("StringLiteral", "x"), 10, role="condition"), N("Block", "", "then")(call(11, "g", N("Identifier", "b", symbol=192, expects=STR)))))],
    "zustand-patterns": [call(1, "useShallow", N("ArrowFunction", "(s) => s.a")), call(2, "useAppStore", N("ArrowFunction", "(s) => ({ a: s.a, b: s.b })")), call(3, "useAppStore", N("ArrowFunction", "(s) => s.a")), call(5, "useEffect", fn("", N("PropertyAccessExpression", "useAppStore.getState"), kind="ArrowFunction"), N("ArrayLiteralExpression")), call(6, "useEffect", fn("", N("CallExpression")(N("PropertyAccessExpression", "useAppStore.getState().reset")(N("CallExpression")(N("PropertyAccessExpression", "useAppStore.getState")))), kind="ArrowFunction"), N("ArrayLiteralExpression")),
                         call(7, "useEffect", fn("", call(8, "useAppStore"), kind="ArrowFunction"), N("ArrayLiteralExpression")(N("Identifier", "dep"))), call(9, "useEffect", fn("", call(10, "useAppStore"), kind="ArrowFunction"), N("ArrayLiteralExpression"))],
    "prop-drilling": [fn("A", *[N("Parameter", f"p{k}", symbol=80 + k, type=FUNC if k < 2 else STR) for k in range(4)], *[N("JsxExpression")(N("Identifier", f"p{k}", symbol=80 + k)) for k in range(4)], line=1),
                      fn("B", *[N("Parameter", f"p{k}", symbol=90 + k, type=FUNC) for k in range(4)], *[N("JsxExpression")(N("Identifier", f"p{k}", symbol=90 + k)) for k in range(4)], N("CallExpression")(N("Identifier", "p0", symbol=90)), line=2)],
    "no-db-origin-client-boundary": [fn("A", N("Parameter", "a", "parameter", 1, type=HOLDER)), fn("B", N("Parameter", "a", "parameter", 2, type=OBJ)), fn("C", N("Parameter", "a", "parameter", 3, type=OBJ), N("Parameter", "b", "parameter", 4, type=ROW))],
    "type-precision": [fn("f", N("Parameter", "a")(N("UnionType", line=1)(N("LiteralType", role="literal"), N("LiteralType", role="literal")))), N("InterfaceDeclaration", line=2)(N("IndexSignature", role="member"), N("PropertySignature", role="member")), N("InterfaceDeclaration", line=3)(N("PropertySignature", role="member")),
                       N("Parameter", "xs", line=4, symbol=95)(N("ArrayType", role="type")), N("Parameter", "ys", line=5, symbol=96)(N("ArrayType", role="type")), N("PropertyAccessExpression", "ys.push")(N("Identifier", "ys", "expression", symbol=96)), *[N("VariableDeclarationList", "const x")(N("VariableDeclaration", "x", line=line)(N("TypeReference", name, "type", line, type=BARE)(*[N("TypeReference", "T", "typeArgument", type=t) for t in arguments]), N("ObjectLiteralExpression", "{…}", "initializer", type=given)(*[N("PropertyAssignment", f"p{k}", "property") for k in range(keys)])))
                         for line, name, arguments, keys, given in [(10, "Partial", [WIDE], 3, OBJ), (11, "Partial", [SCHEMA], 2, OBJ), (12, "Record", [STR, NUM], 2, OBJ), (13, "Record", [NUM, NUM], 2, OBJ), (14, "Bare", [], 2, BARE), (15, "Bare", [], 1, BARE), (16, "Bare", [], 2, OBJ)]],
                       *[binary("EqualsEqualsEqualsToken", N("TypeOfExpression", "typeof v")(N("Identifier", "v", "expression", type=t)), N("StringLiteral", name), line) for line, t, name in [(20, STR, "string"), (21, NUM, "string"), (22, NULLABLE, "string"), (23, FLAG, "boolean")]],
                       binary("ExclamationEqualsToken", N("Identifier", "v", type=STR), N("NullKeyword", "null"), 24), binary("ExclamationEqualsToken", N("Identifier", "v", type=NULLABLE), N("NullKeyword", "null"), 25), binary("EqualsEqualsEqualsToken", N("Identifier", "v", type=ANY), N("UndefinedKeyword", "undefined"), 26),
                       binary("InKeyword", N("StringLiteral", "a"), N("Identifier", "o", type=26), 27), binary("InKeyword", N("StringLiteral", "a"), N("Identifier", "o", type=23), 28)],
    "extract": [
        fn("load", STATEMENT("VariableStatement", 2, call(2, "from", N("Identifier", "users", symbol=31), chain=["db", "select", "from"], target=32), text='const a = db.from(users, "x", 12.5)'), STATEMENT("ExpressionStatement", 3, call(3, "helper", target=30), text="helper(`t`)"),
           STATEMENT("ReturnStatement", 4, fn("", call(4, "verifySession", target=33), kind="ArrowFunction"), text="return () => verifySession('q')"), line=1),
        N("VariableDeclaration", "save", line=5)(fn("", STATEMENT("ExpressionStatement", 6, call(6, "load", target=30), text="load()"), STATEMENT("ExpressionStatement", 7, call(7, "insert", N("Identifier", "orders", symbol=34), chain=["db", "insert"]), text="db.insert(orders)"), STATEMENT("ReturnStatement", 8, text="return 1"), kind="ArrowFunction", role="initializer")),
        fn("brief", STATEMENT("ExpressionStatement", 10, call(10, "load", target=30)), line=9), fn("own", STATEMENT("ExpressionStatement", 12), STATEMENT("ExpressionStatement", 12), STATEMENT("ExpressionStatement", 12), line=11),
        N("EnumDeclaration", "Level", line=13)(N("EnumMember", "LOW", "member")(N("NumericLiteral", "0", "value")), N("EnumMember", "HIGH", "member")(N("StringLiteral", "high", "value")), N("EnumMember", "computed", "member")),
        N("InterfaceDeclaration", "User", line=14)(N("PropertySignature", "id", "member")(N("TypeReference", "string", "value")), N("IndexSignature", "[k]", "member"), N("PropertySignature", "age", "member")), N("TypeAliasDeclaration", "Mode", line=15)(N("LiteralType", "on", "member")(N("LiteralType", "on", "value"))),
        N("InterfaceDeclaration", "None", line=16), N("VariableDeclaration", "LIMIT", line=17)(N("NumericLiteral", "5", "initializer")), N("VariableDeclaration", "hidden", line=18)(N("NumericLiteral", "6", "initializer")),
    ],
    "app/page": [fn("Page", N("Parameter", "params", name="p"), N("Identifier", "v", name="v"), call(1, "parse", N("Identifier", "v", name="used"), chain=["S", "parse"]), call(2, "safeParse", N("Identifier", "p", name="other"), chain=["S", "safeParse"]))],
    "no-unthrown-error": [N("ExpressionStatement")(N("NewExpression", line=1, symbol=41)), N("ThrowStatement")(N("NewExpression", line=2, symbol=41)), N("ExpressionStatement")(N("NewExpression", line=3, symbol=2))],
}

OWNERS = ("FunctionDeclaration", "ArrowFunction", "Constructor")
SERVER, CLIENT = ("extract", "missing-returning", "input-validation", "no-ssrf"), ("no-async-client-component", "no-db-origin-client-boundary")


def _single_file() -> list[tuple]:
    """Nodes of a file with statements, loops and numbers: (parent, kind, field, ord, line, text) by number from 1."""
    nodes = [
        (None, "SourceFile"), (1, "DebuggerStatement", "child", 0, 2), (1, "FunctionDeclaration", "child", 0, 3, "_f"), (3, "Block", "child", 0, 3), (4, "ForStatement", "statement", 0, 4), (5, "RegularExpressionLiteral", "child", 0, 5),
        (5, "ArrowFunction", "child", 0, 6), (7, "RegularExpressionLiteral", "child", 0, 6), (4, "ReturnStatement", "statement", 1, 7), (4, "ExpressionStatement", "statement", 2, 8), (4, "ExpressionStatement", "statement", 3, 9),
        (10, "NumericLiteral", "child", 0, 8, "42"), (9, "NumericLiteral", "child", 0, 7, "43"), (11, "NumericLiteral", "child", 0, 9, "1.0"), (4, "Block", "child", 0, 10), (15, "ConditionalExpression", "child", 0, 11),
        (16, "ConditionalExpression", "child", 0, 12), (1, "JsxText", "child", 0, 13, "it's"), (1, "VariableDeclaration", "child", 0, 14, "MAX_SIZE"), (17, "IfStatement", "child", 0, 12), (20, "WhileStatement", "child", 0, 12), (21, "IfStatement", "child", 0, 12),
    ]
    out, up = [], {None: []}
    for k, given in enumerate(nodes, 1):
        parent, kind, field_, ord_, line, text = (*given, "child", 0, 1, "")[: len(given)] + ("child", 0, 1, "")[len(given) - 2 :]
        out.append(("src/a.tsx", k, parent, kind, field_, ord_, len(up[parent]), 0, 0, line, 1, text, up[parent]))
        up[k] = [*up[parent], (k, kind)]
    return out


def sample() -> dict[str, list[tuple]]:
    """Rows of each relation of ``facts.SCHEMAS`` (and refs): a file for each rule, and a few that import one another."""
    rows: dict[str, list[tuple]] = {k: [] for k in ("nodes", "node_types", "contexts", "node_symbols", "calls", "def_use", "files")}
    for rule, tops in TREES.items():
        file, names, count = f"{rule}.tsx", {}, 0
        rows["files"].append((file, "tsx", 1, "", False, "use server" if rule in SERVER else "use client" if rule in CLIENT else None))

        def visit(n, parent, up, ord_):
            nonlocal count
            count += 1
            me = count
            rows["nodes"].append((file, me, parent, n.kind, n.role, ord_, len(up), me, me, n.line, 1, n.text, up))
            names.setdefault(n.name, me)
            if n.type:
                rows["node_types"].append((file, me, n.type))
            if n.expects:
                rows["contexts"].append((file, me, n.expects))
            if n.symbol:
                rows["node_symbols"].append((file, me, n.symbol))
            if n.call:
                owner = [i for i, k in up if k in OWNERS]
                rows["calls"].append((file, me, owner[-1] if owner else None, n.call["target"], n.call["name"], n.call["chain"]))
            seen = {}
            for kid in n.kids:
                visit(kid, me, [*up, (me, n.kind)], seen.get(kid.role, 0))
                seen[kid.role] = seen.get(kid.role, 0) + 1

        visit(N("SourceFile")(*tops), None, [], 0)
        if "used" in names:  # p flows to v, v to the argument
            rows["def_use"] += [(file, names["v"], names["p"], "assign"), (file, names["used"], names["v"], "use"), (file, names["other"], names["p"], "use")]
    rows["nodes"] += _single_file()
    rows["files"] += [("src/a.tsx", "tsx", 9, "x\n" * 400, False, "use client"), ("b.ts", "ts", 1, "", False, None), ("act.ts", "ts", 1, "", False, "use server"), ("lone.ts", "ts", 1, "", False, "use server")]
    edge = lambda a, b, line=1, types=False, dynamic=False: (a, b, f"./{b}", line, types, dynamic, False)
    imports = [
        edge("src/a.tsx", "b.ts"), edge("b.ts", "server-only"), edge("b.ts", "c.ts"), edge("c.ts", "b.ts", 4), edge("c.ts", "d.ts"), edge("d.ts", "c.ts", types=True), edge("e.ts", "e.ts", 3), edge("src/a.tsx", "act.ts"), edge("act.ts", "x.ts"),
        edge("src/a.tsx", "b.ts", 9), edge("app/p/q.ts", "app/r/s.ts", 2), edge("app/p/q.ts", "app/p/t.ts", 3), edge("m.ts", "n.ts", 1), edge("m.ts", "n.ts", 2), edge("m.ts", "n.ts", 3, types=True), edge("o.ts", "n.ts", 1, dynamic=True), edge("o.ts", "n.ts", 2), edge("m.ts", "lib/index.ts", 4), edge("m.ts", "lib/indexes.ts", 5),
    ]
    exports = [("b.ts", "used", "s1"), ("b.ts", "idle", "s2"), *[(f"schema/{f}.tsx", n, "s3") for f in "ab" for n in ("user", "nameSchema")], ("schema/b.tsx", "alone", "s4"), ("schema/a.tsx", "hidden", "s5")]
    exports += [("input-validation.tsx", x, "s") for x in ("bad", "own", "through", "helper")] + [("no-async-client-component.tsx", x, "s") for x in ("Page", "Plain", "loads", "Card")]
    exports += [("extract.tsx", x, "s") for x in ("load", "save", "brief", "Level", "User", "LIMIT")]
    refs = [("b.ts", "used", "src/a.tsx"), *[(f, n, "x") for f, n, _ in exports if f not in ("b.ts", "schema/a.tsx")]]
    origin = {10: "pkg:crypto", 11: "lib", 12: "pkg:axios", 13: "pkg:fs", 14: "pkg:child_process", REACT: "pkg:react", 2: "local", 20: "local", 21: "local", **{i: "local" for i in (30, 31, 34, 41)}, 32: "pkg:orm", 33: "local"}
    own_symbols = [(150, "own", 0, "no-re-export.tsx", 1, "local", [])]
    symbols = [*own_symbols, (1, "old", 0, "x.ts", 9, "local", ["deprecated"]), (40, "Error", 0, "lib.d.ts", 0, "lib", []), *[(i, f"s{i}", 0, "node_modules/orm/index.ts" if o == "pkg:orm" else "x.ts", i, o, []) for i, o in origin.items()]]
    tokens = [f"t{k}" for k in range(60)]
    near, alike = [*tokens[:57], "x", *tokens[58:]], [*tokens[:55], "y", "z", "w", "v", "u"]
    one = "(string)=>void"
    body = lambda c: [f"{c}{k}" for k in range(31)]
    blocks = [
        ("a.ts", "f", 1, 12, tokens, [], one), ("b.ts", "f", 2, 12, tokens, [], None), ("c.ts", "near", 3, 12, near, ["Db"], one), ("d.ts", "alike", 4, 12, alike, [], one), ("e.ts", "twice", 5, 12, ["q", "r", "s"], [], None),
        ("e.ts", "twice", 9, 12, ["q", "r", "s"], [], None), ("g.ts", "short", 6, 1, tokens, [], None), ("h.ts", "none", 7, 12, [], [], None), ("i.ts", "other", 8, 12, alike, [], "(number)=>void"),
        # routes, receivers and lengths
        ("app/x/p/q.ts", "far", 10, 12, body("k"), [], None), ("app/y/r/s.ts", "far", 11, 12, body("k"), [], None), ("app/z.ts", "root", 12, 12, body("m"), [], None), ("app/y/r/t.ts", "deep", 13, 12, body("m"), [], None),
        ("r1.ts", "made", 14, 12, body("o"), ["Db"], None), ("r2.ts", "made", 15, 12, body("o"), ["Fs"], None), ("r3.ts", "shared", 16, 12, body("v"), ["Db", "Fs"], None), ("r4.ts", "shared", 17, 12, body("v"), ["Fs"], None),
        ("l1.ts", "loop", 18, 12, ["w1", "w2"] * 5, [], None), ("l2.ts", "loop", 19, 12, ["w1", "w2"] * 20, [], None),
    ]
    return rows | {"symbols": symbols, "types": TYPES, "assignable": [(STR, STR)], "class_bases": [(41, 40)], "blocks": blocks, "exports": exports, "refs": refs, "import_edges": imports}
