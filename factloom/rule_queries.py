"""A query for each code rule over the sample of code facts, each with its DuckDB SQL.

The SQL says what a rule finds in its own way: ancestors, owners and flows are recursive queries over parents and edges.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .operators import code_rules, extractors, flow_rules, shape_rules, syntax_rules
from .operators.code_rules import CODE_RULES, FUNCTIONS, LOOPS
from .plans import rules
from .sources import facts as fact_schemas
from .sources import sample

SCHEMAS = fact_schemas.SCHEMAS | {"refs": "def_file string, name string, use_file string"}


@lru_cache(maxsize=1)
def _rows() -> dict[str, list[tuple]]:
    return sample.sample()


def relations(spark: SparkSession, names: tuple[str, ...]) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        schema = StructType.fromDDL(SCHEMAS[name])
        rows = [_plain(schema, r) for r in _rows()[name]]
        out[name] = spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)
    return out


def _plain(schema: StructType, row: tuple) -> dict:
    out = {}
    for f, value in zip(schema.fields, row, strict=True):
        inner = getattr(getattr(f.dataType, "elementType", None), "names", None)
        out[f.name] = [dict(zip(inner, v, strict=True)) for v in value] if inner else value
    return out


# --- SQL --------------------------------------------------------------------------------------------


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, tuple):
        return f"{{'name': {_literal(value[0])}, 'id': {_literal(value[1])}}}"
    return "[" + ", ".join(map(_literal, value)) + "]"


#: Columns that SQL takes; what hangs on a node's ancestors is asked of ``up``.
COLUMNS = {
    "nodes": {"file": "VARCHAR", "node_id": "BIGINT", "parent_id": "BIGINT", "kind": "VARCHAR", "field": "VARCHAR", "ord": "INTEGER", "start": "INTEGER", "line": "INTEGER", "col": "INTEGER", "text": "VARCHAR"},
    "files": {"file": "VARCHAR", "content": "VARCHAR", "directive": "VARCHAR"},
    "symbols": {"symbol_id": "BIGINT", "name": "VARCHAR", "decl_file": "VARCHAR", "decl_pos": "INTEGER", "origin": "VARCHAR", "tags": "VARCHAR[]"},
    "types": {"type_id": "BIGINT", "flags": "BIGINT", "shape": "VARCHAR", "members": "BIGINT[]", "props": "STRUCT(name VARCHAR, id BIGINT)[]", "is_thenable": "BOOLEAN", "own_to_string": "BOOLEAN"},
    "assignable": {"src_type": "BIGINT", "dst_type": "BIGINT"},
    "exports": {"file": "VARCHAR", "name": "VARCHAR"},
    "refs": {"def_file": "VARCHAR", "name": "VARCHAR", "use_file": "VARCHAR"},
    "import_edges": {"src": "VARCHAR", "dst": "VARCHAR", "specifier": "VARCHAR", "line": "INTEGER", "type_only": "BOOLEAN", "is_dynamic": "BOOLEAN", "external": "BOOLEAN"},
    "node_types": {"file": "VARCHAR", "node_id": "BIGINT", "type_id": "BIGINT"},
    "contexts": {"file": "VARCHAR", "node_id": "BIGINT", "type_id": "BIGINT"},
    "node_symbols": {"file": "VARCHAR", "node_id": "BIGINT", "symbol_id": "BIGINT"},
    "class_bases": {"symbol_id": "BIGINT", "base_id": "BIGINT"},
    "blocks": {"file": "VARCHAR", "name": "VARCHAR", "line": "INTEGER", "stmt_count": "INTEGER", "tokens": "VARCHAR[]", "receivers": "VARCHAR[]", "signature": "VARCHAR"},
    "calls": {"file": "VARCHAR", "node_id": "BIGINT", "caller_id": "BIGINT", "target_symbol": "BIGINT", "name": "VARCHAR", "chain": "VARCHAR[]"},
    "def_use": {"file": "VARCHAR", "use_node": "BIGINT", "def_node": "BIGINT"},
}


@lru_cache(maxsize=None)
def _values(name: str) -> str:
    names = [x.split(" ")[0] for x in SCHEMAS[name].split(", ")]
    at = [names.index(c) for c in COLUMNS[name]]
    rows = ", ".join("(" + ", ".join(_literal(r[i]) for i in at) + ")" for r in _rows()[name])
    cast = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in COLUMNS[name].items())
    listed = ", ".join(f'"{c}"' for c in COLUMNS[name])
    return f"{name} AS MATERIALIZED (SELECT {cast} FROM (VALUES {rows}) v({listed}))"


def _in(values) -> str:
    return "(" + ", ".join(_literal(v) for v in values) + ")"


#: Derived relations: (relations needed, SQL).
DERIVED = {
    # statements that declare one variable with a value, and the statement after each
    "declared_before": ("nodes node_symbols", """declared_before AS (
  SELECT s.*, d.node_id AS decl_id, d.line AS decl_line, d.col AS decl_col, y.symbol_id, v.kind AS value_kind, v.text AS value FROM (
    SELECT file, node_id, kind, line, col, lead(node_id) OVER w AS next_id, lead(kind) OVER w AS next_kind FROM nodes WHERE field = 'statement' WINDOW w AS (PARTITION BY file, parent_id ORDER BY ord)) s
  JOIN nodes d ON d.file = s.file AND d.parent_id = s.node_id AND d.kind = 'VariableDeclaration' JOIN node_symbols y ON y.file = d.file AND y.node_id = d.node_id JOIN nodes v ON v.file = d.file AND v.parent_id = d.node_id AND v.field = 'initializer'
  WHERE s.kind = 'VariableStatement' AND (SELECT count(*) FROM nodes o WHERE o.file = s.file AND o.parent_id = s.node_id AND o.kind = 'VariableDeclaration') = 1)"""),
    # identifiers that are written to; by: the binary operator, null for unary ones
    "writes": ("nodes node_symbols", """writes AS (
  SELECT i.file, i.node_id, y.symbol_id, o.kind AS by FROM nodes i JOIN node_symbols y ON y.file = i.file AND y.node_id = i.node_id JOIN nodes p ON p.file = i.file AND p.node_id = i.parent_id
  LEFT JOIN nodes o ON o.file = p.file AND o.parent_id = p.node_id AND o.field = 'operator' AND p.kind = 'BinaryExpression'
  WHERE i.kind = 'Identifier' AND ((p.kind = 'BinaryExpression' AND i.field = 'left') OR (p.kind IN ('PrefixUnaryExpression', 'PostfixUnaryExpression') AND i.field = 'expression')))"""),
    # all ancestors, the parent at distance 1
    "up": ("nodes", """up AS (
  SELECT c.file, c.node_id, p.node_id AS anc, p.kind, 1 AS dist FROM nodes c JOIN nodes p ON c.file = p.file AND c.parent_id = p.node_id
  UNION ALL
  SELECT u.file, u.node_id, p.node_id, p.kind, u.dist + 1 FROM up u JOIN nodes c ON u.file = c.file AND u.anc = c.node_id JOIN nodes p ON c.file = p.file AND c.parent_id = p.node_id)"""),
    # what stands in a condition, also behind ||, &&, ! and brackets
    "conditional": ("nodes", """conditional AS (
  SELECT n.file, n.node_id FROM nodes n LEFT JOIN nodes p ON p.file = n.file AND p.node_id = n.parent_id WHERE n.field = 'condition' OR (n.field = 'expression' AND p.kind IN ('WhileStatement', 'DoStatement'))
  UNION SELECT n.file, n.node_id FROM conditional c JOIN nodes p ON p.file = c.file AND p.node_id = c.node_id JOIN nodes n ON n.file = p.file AND n.parent_id = p.node_id AND n.field IN ('left', 'right', 'expression') LEFT JOIN nodes o ON o.file = p.file AND o.parent_id = p.node_id AND o.field = 'operator'
  WHERE p.kind = 'ParenthesizedExpression' OR (p.kind = 'BinaryExpression' AND o.kind IN ('BarBarToken', 'AmpersandAmpersandToken')) OR (p.kind = 'PrefixUnaryExpression' AND (starts_with(p.text, '!') OR o.kind = 'ExclamationToken')))"""),
    "scope": ("up", f"scope AS (SELECT file, node_id, arg_min(anc, dist) AS sc FROM up WHERE kind IN {_in(syntax_rules.SCOPES)} GROUP BY ALL)"),
    "owner": ("up", f"owner AS (SELECT file, node_id, arg_min(anc, dist) AS fn, min(dist) AS fn_dist FROM up WHERE kind IN {_in(FUNCTIONS)} GROUP BY ALL)"),
    "typed": ("node_types types", """typed AS (
  SELECT nt.file, nt.node_id, t.type_id, t.flags | coalesce((SELECT bit_or(m.flags) FROM types m WHERE list_contains(t.members, m.type_id)), 0) AS flags,
         coalesce(t.is_thenable, FALSE) OR coalesce((SELECT bool_or(m.is_thenable) FROM types m WHERE list_contains(t.members, m.type_id)), FALSE) AS thenable, t.own_to_string
  FROM node_types nt JOIN types t ON nt.type_id = t.type_id)"""),
    "origin": ("calls symbols", "origin AS (SELECT c.*, s.origin FROM calls c LEFT JOIN symbols s ON s.symbol_id = c.target_symbol)"),
    "fits": ("types assignable", "fits AS (SELECT src_type AS a, dst_type AS b FROM assignable UNION SELECT type_id, type_id FROM types)"),
    # what flows into a node, whatever the number of steps
    "flow": ("def_use", "flow AS (SELECT file, use_node AS node, def_node AS origin_node FROM def_use UNION SELECT f.file, f.node, d.def_node FROM flow f JOIN def_use d ON d.file = f.file AND d.use_node = f.origin_node)"),
}


def _needed(sql: str) -> list[str]:
    words, out = set(re.findall(r"\w+", sql)), []

    def add(name: str) -> None:
        if name in out:
            return
        for other in DERIVED[name][0].split() if name in DERIVED else ():
            add(other)
        out.append(name)

    for name in (*COLUMNS, *DERIVED):
        if name in words:
            add(name)
    return out


def child(role: str, alias: str | None = None) -> str:
    a = alias or f"k_{role}"
    return f" LEFT JOIN nodes {a} ON {a}.file = n.file AND {a}.parent_id = n.node_id AND {a}.field = '{role}' AND {a}.ord = 0"


def children(*roles: str) -> str:
    return "nodes n" + "".join(map(child, roles))


PARENT = " LEFT JOIN nodes p ON p.file = n.file AND p.node_id = n.parent_id"


def type_of(alias: str, name: str) -> str:
    return f" LEFT JOIN typed {name} ON {name}.file = n.file AND {name}.node_id = {alias}.node_id"


def count_of(role: str) -> str:
    return f"(SELECT count(*) FROM nodes c WHERE c.file = n.file AND c.parent_id = n.node_id AND c.field = '{role}')"


def near(kinds, until=FUNCTIONS, alias: str = "n") -> str:
    """An ancestor of one of the kinds comes before the nearest boundary."""
    return f"""(SELECT coalesce(min(dist) FILTER (u.kind IN {_in(kinds)}) < coalesce(min(dist) FILTER (u.kind IN {_in(until)}), 1000000), FALSE) FROM up u WHERE u.file = {alias}.file AND u.node_id = {alias}.node_id)"""


def checks(source: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT n.file, n.line, n.col, {_literal(m)} FROM {source} WHERE {c}" for m, c in conditions.items())


def binary(*tokens: str) -> str:
    return f"n.kind = 'BinaryExpression' AND k_operator.kind IN {_in(tokens)}"


SIDES = children("left", "operator", "right")
C, S = code_rules, syntax_rules
BODIES: dict[str, str] = {
    "no-debug-code": "SELECT file, line, col, 'debugger statement' FROM nodes WHERE kind = 'DebuggerStatement'",
    "banned-syntax": checks(f"nodes n{PARENT}", {
        "void operator": "n.kind = 'VoidExpression'", "label": "n.kind = 'LabeledStatement'", "block in a block": "n.kind = 'Block' AND p.kind = 'Block'",
        "line broken in a string": "n.kind = 'StringLiteral' AND (contains(n.text, '\\' || chr(10)) OR contains(n.text, '\\' || chr(13) || chr(10)))", "octal escape": "n.kind = 'StringLiteral' AND regexp_matches(n.text, '\\\\[1-7]')",
        "deletion of a name": "n.kind = 'Identifier' AND p.kind = 'DeleteExpression'"}) + f""" UNION ALL SELECT n.file, n.line, n.col, 'global assigned: ' || s.name FROM {SIDES} JOIN node_symbols y ON y.file = n.file AND y.node_id = k_left.node_id JOIN symbols s ON s.symbol_id = y.symbol_id
  WHERE {binary('EqualsToken')} AND k_left.kind = 'Identifier' AND s.origin = 'lib'""",
    "no-magic-numbers": f"SELECT n.file, n.line, n.col, 'number ' || n.text FROM nodes n{PARENT} WHERE n.kind = 'NumericLiteral' AND TRY_CAST(n.text AS DOUBLE) NOT IN (0, 1, 2) AND coalesce(p.kind, '') NOT IN {_in((*C.NUMBER_PARENTS, 'NumericLiteral'))}",
    "no-underscore-prefix": f"""SELECT file, line, col, 'name ' || text FROM nodes WHERE kind IN {_in(C.DECLARATIONS)} AND regexp_matches(text, '^_.+')
  UNION ALL SELECT n.file, n.line, n.col, 'name ' || n.text FROM nodes n WHERE n.kind IN {_in(C.PROPERTIES)} AND regexp_matches(n.text, '^_.+') AND NOT EXISTS (SELECT 1 FROM contexts x JOIN types t ON t.type_id = x.type_id JOIN types m ON m.type_id = t.type_id OR list_contains(t.members, m.type_id)
    WHERE x.file = n.file AND x.node_id = n.parent_id AND len(list_filter(m.props, lambda q: q.name = n.text)) > 0)""",
    "no-local-constants": f"""SELECT n.file, n.line, n.col, 'constant ' || n.text FROM nodes n WHERE n.kind = 'VariableDeclaration' AND regexp_matches(n.text, '^[A-Z][A-Z0-9_]*$') AND NOT contains(n.file, '/constants/')
  AND EXISTS (SELECT 1 FROM nodes l WHERE l.file = n.file AND l.kind IN {_in(C.LITERALS)} AND l.text <> '' AND (l.kind <> 'PrefixUnaryExpression' OR regexp_matches(l.text, '^-[0-9.]+$'))
    AND NOT (l.kind IN ('NumericLiteral', 'PrefixUnaryExpression') AND coalesce(TRY_CAST(l.text AS DOUBLE) IN (0, 1, -1), FALSE))
    AND n.node_id = (SELECT arg_min(u.anc, u.dist) FROM up u WHERE u.file = l.file AND u.node_id = l.node_id AND u.kind NOT IN {_in(C.WRAPPERS)}))""",
    "max-file-lines": "SELECT file, 1, 1, 'too many lines' FROM files WHERE len(string_split(content, chr(10))) > 300",
    "no-unescaped-entities": """SELECT file, line, col, 'escape ' || regexp_extract(text, '[>"''}]') FROM nodes WHERE kind = 'JsxText' AND suffix(file, '.tsx') AND regexp_extract(text, '[>"''}]') <> ''""",
    "readability": f"""SELECT * FROM (SELECT n.file, n.line, n.col, CASE WHEN n.kind = 'ConditionalExpression' AND p.kind = 'ConditionalExpression' THEN 'nested ternary'
  WHEN n.kind IN ('SwitchStatement', 'TemplateExpression') AND EXISTS (SELECT 1 FROM up u WHERE u.file = n.file AND u.node_id = n.node_id AND u.kind = n.kind)
  THEN CASE n.kind WHEN 'SwitchStatement' THEN 'nested switch' ELSE 'nested template' END
  WHEN n.kind = 'AsExpression' AND k_expression.kind = 'StringLiteral' AND k_type.kind = 'LiteralType' AND k_type.text = k_expression.text THEN 'use as const'
  WHEN n.kind = 'VariableDeclaration' AND k_initializer.kind = 'ThisKeyword' THEN 'alias of this' END AS what FROM {children('initializer', 'expression', 'type')}{PARENT}) WHERE what IS NOT NULL""",
    "complexity": f"""WITH b AS (SELECT n.file, n.node_id FROM nodes n{PARENT} WHERE n.kind IN ('ArrowFunction', 'FunctionExpression') AND p.kind = 'CallExpression')
  SELECT n.file, n.line, n.col, m.metric FROM nodes n JOIN (
  SELECT file, fn, unnest(['cyclomatic', 'lines', 'max_nesting']) AS metric, unnest([cyclomatic, lines, nesting]) AS value, unnest([15, 150, 4]) AS most FROM (
    SELECT c.file, o.fn, 1 + count(*) FILTER (c.kind IN {_in((*C.BRANCHES, *C.LOGICAL))}) AS cyclomatic, max(c.line) - min(c.line) + 1 AS lines,
           coalesce(max(1 + (SELECT count(*) FROM up u WHERE u.file = c.file AND u.node_id = c.node_id AND u.kind IN {_in(C.BRANCHES)})) FILTER (c.kind IN {_in(C.BRANCHES)}), 0) AS nesting
    FROM nodes c JOIN owner o ON c.file = o.file AND c.node_id = o.node_id GROUP BY c.file, o.fn)) m ON n.file = m.file AND n.node_id = m.fn WHERE m.value > m.most
  UNION ALL SELECT n.file, n.line, n.col, 'statements' FROM nodes n WHERE n.kind IN {_in(FUNCTIONS)} AND {count_of('statement')} > 25
  UNION ALL SELECT n.file, n.line, n.col, 'parameters' FROM nodes n WHERE n.kind IN {_in(FUNCTIONS)} AND {count_of('parameter')} > 4
  UNION ALL SELECT n.file, n.line, n.col, 'callbacks' FROM nodes n WHERE n.kind IN {_in(FUNCTIONS)} AND 3 < (SELECT max(1 + (SELECT count(*) FROM up v JOIN b o ON o.file = v.file AND o.node_id = v.anc WHERE v.file = u.file AND v.node_id = u.node_id AND v.dist < u.dist))
    FROM up u JOIN b ON b.file = u.file AND b.node_id = u.node_id WHERE u.file = n.file AND u.anc = n.node_id)""",
    "self-import": "SELECT src, line, 1, 'imports itself' FROM import_edges WHERE src = dst",
    "duplicate-import": """SELECT src, line, 1, 'again ' || specifier FROM (SELECT *, row_number() OVER w AS k FROM import_edges i WHERE NOT is_dynamic
  AND NOT EXISTS (SELECT 1 FROM import_edges o WHERE o.src = i.src AND o.dst = i.dst AND NOT o.is_dynamic AND o.type_only <> i.type_only) WINDOW w AS (PARTITION BY src, dst ORDER BY line)) WHERE k > 1""",
    "no-import-cycle": """WITH RECURSIVE e AS (SELECT * FROM import_edges WHERE NOT type_only AND NOT external), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
  SELECT src, line, 1, 'cycle through ' || specifier FROM e WHERE src = dst OR EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src)""",
    "unused-export": "SELECT file, 1, 1, 'unused ' || name FROM exports x WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.def_file = x.file AND r.name = x.name)",
    "no-duplicate-schema-export": """WITH d AS (SELECT n.file, n.line, n.col, n.text FROM nodes n JOIN node_types y ON y.file = n.file AND y.node_id = n.node_id JOIN types t ON t.type_id = y.type_id
    WHERE n.kind = 'VariableDeclaration' AND len(list_filter(t.props, lambda q: q.name IN ('parse', 'safeParse'))) = 2 AND EXISTS (SELECT 1 FROM exports x WHERE x.file = n.file AND x.name = n.text))
  SELECT file, line, col, 'also elsewhere: ' || text FROM d WHERE text IN (SELECT text FROM d GROUP BY text HAVING count(*) > 1)""",
    "route-boundary": """SELECT src, line, 1, a || ' -> ' || b FROM (SELECT src, line, CASE WHEN starts_with(src, 'app/') THEN split_part(src, '/', 2) END AS a, CASE WHEN starts_with(dst, 'app/') THEN split_part(dst, '/', 2) END AS b FROM import_edges) WHERE a <> b""",
    "no-client-server-only-import": """WITH RECURSIVE w AS (SELECT file AS root, file AS node, [file] AS path FROM files WHERE directive = 'use client' UNION ALL
    SELECT w.root, i.dst, list_append(w.path, i.dst) FROM w JOIN import_edges i ON i.src = w.node AND NOT i.type_only
    WHERE NOT list_contains(w.path, i.dst) AND i.dst NOT IN (SELECT file FROM files WHERE directive = 'use server'))
  SELECT root, 1, 1, array_to_string(path, ' -> ') FROM (SELECT root, path, row_number() OVER (PARTITION BY root, node ORDER BY len(path), path) AS k FROM w WHERE node = 'server-only') WHERE k = 1""",
    "unnecessary-use-server": """WITH RECURSIVE w AS (SELECT file AS node FROM files WHERE directive = 'use client' UNION SELECT i.dst FROM w JOIN import_edges i ON i.src = w.node AND NOT i.type_only)
  SELECT file, 1, 1, 'no client imports it' FROM files WHERE directive = 'use server' AND file NOT IN (SELECT node FROM w)""",
    # nodes, their children and siblings
    "no-identical-binary-operands": f"SELECT n.file, n.line, n.col, 'both sides are the same' FROM {SIDES} WHERE {binary(*S.SAME_OPERANDS)} AND k_left.kind IN {_in(S.PURE)} AND k_left.kind = k_right.kind AND k_left.text = k_right.text",
    "no-collection-size-mischeck": f"""SELECT file, line, col, what FROM (SELECT n.file, n.line, n.col, CASE WHEN v < 0 THEN CASE WHEN op IN {_in(S.ALWAYS_BELOW_ZERO)} THEN 'always true' WHEN op IN {_in(S.COMPARISONS)} THEN 'always false' END
    WHEN v = 0 AND op = 'GreaterThanEqualsToken' THEN 'always true' WHEN v = 0 AND op = 'LessThanToken' THEN 'always false' END AS what
  FROM (SELECT n.*, k_operator.kind AS op, TRY_CAST(k_right.text AS DOUBLE) AS v FROM {SIDES} WHERE n.kind = 'BinaryExpression' AND k_left.kind = 'PropertyAccessExpression' AND regexp_matches(k_left.text, '\\.(length|size)$')) n) WHERE what IS NOT NULL""",
    "jsx-no-useless-fragment": """SELECT n.file, n.line, n.col, 'the child needs no fragment' FROM nodes n WHERE n.kind = 'JsxFragment' AND suffix(n.file, '.tsx')
  AND (SELECT count(*) = 1 AND NOT bool_or(c.kind = 'JsxExpression') FROM nodes c WHERE c.file = n.file AND c.parent_id = n.node_id AND c.field = 'child' AND NOT (c.kind = 'JsxText' AND trim(c.text, ' ' || chr(9) || chr(10)) = ''))""",
    "no-all-duplicated-branches": """SELECT n.file, n.line, n.col, 'all branches are the same' FROM nodes n JOIN (SELECT file, parent_id FROM nodes WHERE field IN ('branch', 'else') GROUP BY ALL
  HAVING count(*) > 1 AND count(DISTINCT regexp_replace(text, '\\s+', ' ', 'g')) = 1 AND count(*) FILTER (field = 'else') > 0 AND count(*) FILTER (trim(text) = '') = 0) b ON b.file = n.file AND b.parent_id = n.node_id""",
    "error-handling": f"""SELECT n.file, n.line, n.col, 'empty catch' FROM nodes n WHERE n.kind = 'CatchClause' AND {count_of('statement')} = 0 AND NOT regexp_matches(n.text, '/\\*|//')
  UNION ALL SELECT n.file, n.line, n.col, 'no cause' FROM {children('expression')}{PARENT} WHERE n.kind = 'NewExpression' AND k_expression.text = 'Error' AND {count_of('argument')} = 1 AND p.kind = 'ThrowStatement' AND {near(['CatchClause'])}""",
    "no-empty-function": f"""SELECT n.file, n.line, n.col, 'empty function' FROM nodes n{PARENT} WHERE n.kind IN {_in(FUNCTIONS)} AND n.kind <> 'Constructor' AND {count_of('statement')} = 0 AND regexp_matches(n.text, '\\{{\\s*\\}}\\s*$')
  AND coalesce(p.kind, '') NOT IN ('CallExpression', 'PropertyAssignment', 'PropertyDeclaration') AND NOT (n.kind = 'ArrowFunction' AND coalesce(p.kind, '') = 'VariableDeclaration' AND {count_of('parameter')} = 0)""",
    "no-multiline-comments": "SELECT file, line, col, 'block comment' FROM nodes WHERE kind = 'Comment' AND starts_with(text, '/**') AND suffix(text, '*/') AND length(text) > 4",
    "naming-convention": f"""SELECT file, line, col, 'restricted name ' || text FROM nodes WHERE kind IN ('VariableDeclaration', 'Parameter', 'FunctionDeclaration') AND text IN {_in(S.RESTRICTED)}
  UNION ALL SELECT n.file, n.line, n.col, 'label ' || n.text FROM nodes n WHERE n.kind = 'LabeledStatement' AND EXISTS (SELECT 1 FROM nodes v WHERE v.file = n.file AND v.text = n.text AND v.kind IN ('VariableDeclaration', 'Parameter'))""",
    "correctness": f"""SELECT n.file, n.line, n.col, 'never reached' FROM nodes n WHERE n.field = 'statement' AND n.kind NOT IN {_in(C.HOISTED)} AND n.ord = (SELECT min(s.ord) FROM nodes s WHERE s.file = n.file AND s.parent_id = n.parent_id AND s.field = 'statement'
    AND s.kind NOT IN {_in(C.HOISTED)} AND s.ord > (SELECT min(t.ord) FROM nodes t WHERE t.file = n.file AND t.parent_id = n.parent_id AND t.field = 'statement' AND t.kind IN {_in(C.TERMINATORS)})) UNION ALL """ + checks(children("left", "operator", "right", "statement", "expression") + PARENT, {
        "assigned to itself": f"{binary('EqualsToken')} AND k_left.text = k_right.text AND k_left.kind IN {_in(S.PURE)}",
        "compared with itself": f"{binary(*S.EQUALITY)} AND k_left.text = k_right.text AND k_left.kind IN {_in(S.PURE)}",
        "loop of one round": f"n.kind IN {_in(LOOPS)} AND k_statement.kind IN ('ReturnStatement', 'ThrowStatement', 'BreakStatement')",
        "catch that only throws again": f"n.kind = 'CatchClause' AND {count_of('statement')} = 1 AND k_statement.kind = 'ThrowStatement' AND k_statement.text = 'throw ' || regexp_extract(n.text, '^catch\\s*\\(\\s*(\\w+)', 1)",
        "hole in an array": "n.kind = 'OmittedExpression' AND p.kind = 'ArrayLiteralExpression'",
        "exit in finally": f"n.kind IN ('ReturnStatement', 'ThrowStatement') AND {near(['FinallyBlock'])}",
        "await in finally": f"n.kind = 'AwaitExpression' AND {near(['FinallyBlock'])}",
        "value returned by a setter": f"n.kind = 'ReturnStatement' AND k_expression.kind IS NOT NULL AND {near(['SetAccessor'])}",
    }) + f"""
  UNION ALL SELECT DISTINCT p.file, p.line, p.col, 'parameter set: ' || i.text FROM writes w JOIN nodes i ON i.file = w.file AND i.node_id = w.node_id JOIN nodes p ON p.file = i.file AND p.node_id = i.parent_id
    WHERE (w.by IN {_in(S.ASSIGNMENTS)} OR (w.by IS NULL AND EXISTS (SELECT 1 FROM nodes o WHERE o.file = p.file AND o.parent_id = p.node_id AND o.field = 'operator' AND o.kind IN ('PlusPlusToken', 'MinusMinusToken'))))
    AND EXISTS (SELECT 1 FROM node_symbols y JOIN nodes q ON q.file = y.file AND q.node_id = y.node_id AND q.kind = 'Parameter' WHERE y.file = w.file AND y.symbol_id = w.symbol_id)
  UNION ALL SELECT n.file, n.line, n.col, 'function of a loop uses a variable that changes' FROM nodes n WHERE n.kind IN ('ArrowFunction', 'FunctionExpression') AND {near(LOOPS)} AND EXISTS (
    SELECT 1 FROM up u JOIN nodes i ON i.file = u.file AND i.node_id = u.node_id AND i.kind = 'Identifier' JOIN nodes ip ON ip.file = i.file AND ip.node_id = i.parent_id AND ip.kind <> 'PropertyAccessExpression' JOIN node_symbols y ON y.file = i.file AND y.node_id = i.node_id
    JOIN node_symbols z ON z.file = y.file AND z.symbol_id = y.symbol_id JOIN nodes d ON d.file = z.file AND d.node_id = z.node_id AND d.kind = 'VariableDeclaration' JOIN nodes l ON l.file = d.file AND l.node_id = d.parent_id AND l.kind = 'VariableDeclarationList' AND starts_with(l.text, 'let ')
    WHERE u.file = n.file AND u.anc = n.node_id AND NOT EXISTS (SELECT 1 FROM up v WHERE v.file = d.file AND v.node_id = d.node_id AND v.anc = n.node_id))""",
    "logic": f"""SELECT n.file, n.line, n.col, 'the next condition is the same' FROM {children('condition', 'else')} JOIN nodes c ON c.file = n.file AND c.parent_id = k_else.node_id AND c.field = 'condition' AND c.ord = 0
    WHERE n.kind = 'IfStatement' AND k_else.kind = 'IfStatement' AND c.text = k_condition.text
  UNION ALL SELECT n.file, n.line, n.col, 'the condition never changes' FROM {children('condition')} WHERE n.kind IN ('IfStatement', 'ConditionalExpression') AND k_condition.kind IN ('TrueKeyword', 'FalseKeyword')
  UNION ALL SELECT file, line, col, 'written again at once' FROM (SELECT s.*, lead(element) OVER (PARTITION BY s.file, s.parent_id ORDER BY s.ord) AS after FROM (
    SELECT s.file, s.parent_id, s.ord, s.line, s.col, w.element FROM nodes s LEFT JOIN (SELECT n.file, n.parent_id, k_left.text AS element FROM {SIDES} WHERE {binary('EqualsToken')} AND k_left.kind = 'ElementAccessExpression' AND n.field = 'expression') w
      ON w.file = s.file AND w.parent_id = s.node_id WHERE s.field = 'statement') s) WHERE element = after
  UNION ALL SELECT n.file, n.line, n.col, '0 is shown' FROM {SIDES}{PARENT} JOIN node_types nt ON nt.file = n.file AND nt.node_id = k_left.node_id JOIN types t ON t.type_id = nt.type_id WHERE {binary('AmpersandAmpersandToken')} AND n.field = 'expression' AND p.kind = 'JsxExpression' AND t.flags & 264 <> 0
  UNION ALL SELECT d.file, d.line, d.col, 'first value never used' FROM declared_before d JOIN nodes e ON e.file = d.file AND e.parent_id = d.next_id AND e.field = 'expression' AND e.kind = 'BinaryExpression' JOIN nodes o ON o.file = e.file AND o.parent_id = e.node_id AND o.field = 'operator' AND o.kind = 'EqualsToken'
    JOIN nodes l ON l.file = e.file AND l.parent_id = e.node_id AND l.field = 'left' AND l.kind = 'Identifier' JOIN node_symbols y ON y.file = l.file AND y.node_id = l.node_id AND y.symbol_id = d.symbol_id JOIN nodes r ON r.file = e.file AND r.parent_id = e.node_id AND r.field = 'right'
    WHERE d.next_kind = 'ExpressionStatement' AND NOT EXISTS (SELECT 1 FROM node_symbols z JOIN nodes i ON i.file = z.file AND i.node_id = z.node_id AND i.kind = 'Identifier' WHERE z.file = d.file AND z.symbol_id = d.symbol_id
      AND (i.node_id = r.node_id OR EXISTS (SELECT 1 FROM up u WHERE u.file = i.file AND u.node_id = i.node_id AND u.anc = r.node_id)))""",
    "no-deprecated-api": checks(children("left", "operator"), {
        "__proto__": "n.kind = 'PropertyAccessExpression' AND suffix(n.text, '.__proto__')", "arguments.caller or callee": "n.kind = 'PropertyAccessExpression' AND n.text IN ('arguments.caller', 'arguments.callee')",
        "prototype replaced": f"{binary('EqualsToken')} AND suffix(k_left.text, '.prototype')"}),
    "no-useless-code": checks(children("name", "expression", "initializer", "left", "operator", "right", "argument"), {
        "called by its receiver": "n.kind = 'CallExpression' AND k_argument.kind = 'Identifier' AND regexp_matches(k_expression.text, '^\\w+\\.\\w+\\.(call|apply)$') AND split_part(k_expression.text, '.', 1) = k_argument.text",
        "literal as a computed key": "n.kind = 'ComputedPropertyName' AND k_expression.kind IN ('StringLiteral', 'NumericLiteral')", "literals joined": f"{binary('PlusToken')} AND k_left.kind = 'StringLiteral' AND k_right.kind = 'StringLiteral'",
        "name said twice": "n.kind = 'PropertyAssignment' AND k_initializer.kind = 'Identifier' AND k_name.text = k_initializer.text"}),
    "no-implicit-coercion": checks(children("left", "operator", "right", "expression"), {
        "loose equality": f"{binary('EqualsEqualsToken', 'ExclamationEqualsToken')} AND coalesce(k_left.kind, '') <> 'NullKeyword' AND coalesce(k_right.kind, '') <> 'NullKeyword' AND coalesce(k_left.text, '') <> 'undefined' AND coalesce(k_right.text, '') <> 'undefined'",
        "number by +": "n.kind = 'PrefixUnaryExpression' AND k_operator.kind = 'PlusToken' AND k_expression.kind <> 'NumericLiteral'",
        "string by +": f"""{binary('PlusToken')} AND ((k_left.kind = 'StringLiteral' AND k_left.text IN ('', '''''', '""')) OR (k_right.kind = 'StringLiteral' AND k_right.text IN ('', '''''', '""')))""",
        "boolean by !!": "n.kind = 'PrefixUnaryExpression' AND starts_with(n.text, '!!') AND (n.file, n.node_id) IN (SELECT (file, node_id) FROM conditional)"}),
    "safety": checks(children("expression", "argument", "left", "operator", "right", "modifier") + PARENT, {
        "value returned by a constructor": f"n.kind = 'ReturnStatement' AND k_expression.kind IS NOT NULL AND {near(['Constructor'], ('FunctionDeclaration', 'FunctionExpression', 'ArrowFunction', 'MethodDeclaration'))}",
        "optional chain in arithmetic": f"{binary('PlusToken', 'MinusToken', 'AsteriskToken', 'SlashToken', 'PercentToken')} AND (contains(coalesce(k_left.text, ''), '?.') OR contains(coalesce(k_right.text, ''), '?.'))",
        "parseInt without a radix": f"n.kind = 'CallExpression' AND k_expression.text = 'parseInt' AND {count_of('argument')} = 1",
        "rejected with no error": "n.kind = 'CallExpression' AND k_expression.text = 'reject' AND k_argument.kind IN ('StringLiteral', 'NumericLiteral', 'TemplateExpression', 'ObjectLiteralExpression')",
        "async executor": "n.kind IN ('ArrowFunction', 'FunctionExpression') AND p.kind = 'NewExpression' AND k_modifier.kind = 'AsyncKeyword'"}) + f"""
  UNION ALL SELECT n.file, n.line, n.col, 'value returned by an executor' FROM {children('expression')}{PARENT} JOIN nodes q ON q.file = p.file AND q.node_id = p.parent_id AND q.kind = 'NewExpression' JOIN nodes e ON e.file = q.file AND e.parent_id = q.node_id AND e.field = 'expression' AND e.text = 'Promise'
    WHERE n.kind = 'ReturnStatement' AND n.field = 'statement' AND k_expression.kind IS NOT NULL AND p.kind IN ('ArrowFunction', 'FunctionExpression') AND p.field = 'argument' AND p.ord = 0
  UNION ALL SELECT n.file, n.line, n.col, 'outer variable takes what is awaited' FROM {SIDES} JOIN node_symbols y ON y.file = n.file AND y.node_id = k_left.node_id JOIN node_symbols z ON z.file = y.file AND z.symbol_id = y.symbol_id JOIN nodes d ON d.file = z.file AND d.node_id = z.node_id AND d.kind IN ('VariableDeclaration', 'Parameter')
    WHERE {binary('EqualsToken')} AND k_left.kind = 'Identifier' AND k_right.kind = 'AwaitExpression' AND NOT EXISTS (SELECT 1 FROM up u WHERE u.file = n.file AND u.node_id = n.node_id AND u.anc = d.parent_id)
  UNION ALL SELECT n.file, n.line, n.col, 'loop condition never changes' FROM {children('expression')} JOIN node_symbols y ON y.file = n.file AND y.node_id = k_expression.node_id WHERE n.kind IN ('WhileStatement', 'DoStatement') AND k_expression.kind = 'Identifier'
    AND NOT EXISTS (SELECT 1 FROM writes w JOIN up u ON u.file = w.file AND u.node_id = w.node_id WHERE w.file = n.file AND w.symbol_id = y.symbol_id AND u.anc = n.node_id)
  UNION ALL SELECT n.file, n.line, n.col, 'callback returns nothing' FROM {children('modifier')}{PARENT} JOIN nodes e ON e.file = p.file AND e.parent_id = p.node_id AND e.field = 'expression' AND e.kind = 'PropertyAccessExpression' WHERE n.kind IN ('ArrowFunction', 'FunctionExpression') AND n.field = 'argument' AND n.ord = 0
    AND p.kind = 'CallExpression' AND split_part(e.text, '.', -1) IN {_in(S.ARRAY_CALLBACKS)} AND {count_of('statement')} > 0 AND coalesce(k_modifier.kind, '') <> 'AsyncKeyword' AND NOT EXISTS (SELECT 1 FROM nodes r JOIN owner o ON o.file = r.file AND o.node_id = r.node_id WHERE r.file = n.file AND r.kind = 'ReturnStatement' AND o.fn = n.node_id)""",
    "security": checks(children("expression", "initializer"), {
        "markup from a value": "n.kind = 'JsxAttribute' AND starts_with(n.text, 'dangerouslySetInnerHTML') AND coalesce(k_initializer.kind, '') <> 'StringLiteral'",
        "address that runs code": "n.kind = 'JsxAttribute' AND regexp_matches(n.text, '^(href|src|action|formAction)\\b') AND regexp_matches(k_initializer.text, '(?i)^\\s*(javascript|data|vbscript):')",
        "document.write": "n.kind = 'CallExpression' AND k_expression.text IN ('document.write', 'document.writeln')"}) + f"""
  UNION ALL SELECT n.file, n.line, n.col, 'key from a value' FROM {SIDES} JOIN nodes a ON a.file = n.file AND a.parent_id = k_left.node_id AND a.field = 'argument' AND a.ord = 0 JOIN nodes o ON o.file = n.file AND o.parent_id = k_left.node_id AND o.field = 'expression' AND o.ord = 0
    WHERE {binary(*S.ASSIGNMENTS)} AND k_left.kind = 'ElementAccessExpression' AND a.kind NOT IN ('StringLiteral', 'NumericLiteral', 'NoSubstitutionTemplateLiteral', 'PropertyAccessExpression')
    AND NOT EXISTS (SELECT 1 FROM node_types nt JOIN types t ON t.type_id = nt.type_id WHERE nt.file = o.file AND nt.node_id = o.node_id AND (suffix(t.shape, '[]') OR starts_with(t.shape, '[') OR starts_with(t.shape, 'Record<') OR regexp_matches(t.shape, '^(readonly )?(Array|ReadonlyArray|Map|Set|WeakMap|WeakSet|ReadonlyMap|ReadonlySet)<|\\[\\w+: (string|number)\\]')))
    AND NOT (a.kind = 'Identifier' AND EXISTS (SELECT 1 FROM node_types nt JOIN types t ON t.type_id = nt.type_id WHERE nt.file = a.file AND nt.node_id = a.node_id AND (t.flags & 384 <> 0 OR (len(t.members) > 0 AND NOT EXISTS (SELECT 1 FROM types m WHERE list_contains(t.members, m.type_id) AND m.flags & 384 = 0)))))""",
    "simplification": f"""WITH b AS (SELECT file, parent_id, count(*) AS held, arg_max(kind, ord) AS last_kind, max(ord) AS last_ord FROM nodes WHERE field = 'statement' GROUP BY ALL)
  SELECT file, line, col, unnest(list_filter([CASE WHEN kind = 'IfStatement' AND then_last IN {_in(S.EXITS)} AND other IS NOT NULL THEN 'else after an exit' END,
    CASE WHEN kind = 'ContinueStatement' AND field = 'statement' AND ord = last_ord AND parent_kind IN {_in(LOOPS)} THEN 'continue at the end' END,
    CASE WHEN kind = 'ReturnStatement' AND field = 'statement' AND ord = last_ord AND value IS NULL AND parent_kind IN {_in(FUNCTIONS)} THEN 'empty return at the end' END,
    CASE WHEN kind = 'IfStatement' AND held = 1 AND then_last = 'IfStatement' AND other IS NULL THEN 'one if in another' END,
    CASE WHEN kind = 'ForStatement' AND init IS NULL AND incr IS NULL THEN 'for as a while' END], lambda m: m IS NOT NULL))
  FROM (SELECT n.*, p.kind AS parent_kind, k_else.kind AS other, k_expression.kind AS value, k_initializer.kind AS init, k_incrementor.kind AS incr, t.held, t.last_kind AS then_last, own.last_ord
    FROM {children('then', 'expression', 'initializer', 'incrementor', 'else')}{PARENT} LEFT JOIN b t ON t.file = n.file AND t.parent_id = k_then.node_id LEFT JOIN b own ON own.file = n.file AND own.parent_id = n.parent_id)
  UNION ALL SELECT n.file, n.line, n.col, 'constructor that adds nothing' FROM {children('statement')} WHERE n.kind = 'Constructor' AND {count_of('parameter')} = 0 AND ({count_of('statement')} = 0 OR ({count_of('statement')} = 1 AND k_statement.kind = 'ExpressionStatement'
    AND EXISTS (SELECT 1 FROM nodes c JOIN nodes s ON s.file = c.file AND s.parent_id = c.node_id AND s.field = 'expression' AND s.kind = 'SuperKeyword' WHERE c.file = n.file AND c.parent_id = k_statement.node_id AND c.kind = 'CallExpression')))
  UNION ALL SELECT n.file, n.line, n.col, 'true and false returned one by one' FROM {children('then', 'else')} JOIN nodes r ON r.file = n.file AND r.kind = 'ReturnStatement' AND (r.node_id = k_then.node_id OR (k_then.kind = 'Block' AND r.parent_id = k_then.node_id AND r.field = 'statement' AND r.ord = 0))
    JOIN nodes t ON t.file = r.file AND t.parent_id = r.node_id AND t.field = 'expression' AND t.kind = 'TrueKeyword' JOIN nodes q ON q.file = n.file AND q.parent_id = n.parent_id AND q.field = 'statement' AND q.ord = n.ord + 1 AND q.kind = 'ReturnStatement'
    JOIN nodes f ON f.file = q.file AND f.parent_id = q.node_id AND f.field = 'expression' AND f.kind = 'FalseKeyword' WHERE n.kind = 'IfStatement' AND n.field = 'statement' AND k_else.kind IS NULL
  UNION ALL SELECT d.file, d.line, d.col, 'variable returned at once' FROM declared_before d JOIN nodes i ON i.file = d.file AND i.parent_id = d.next_id AND i.field = 'expression' AND i.kind = 'Identifier' JOIN node_symbols y ON y.file = i.file AND y.node_id = i.node_id AND y.symbol_id = d.symbol_id WHERE d.next_kind = 'ReturnStatement'
  UNION ALL SELECT d.file, d.decl_line, d.decl_col, 'object filled at once' FROM declared_before d JOIN nodes e ON e.file = d.file AND e.parent_id = d.next_id AND e.field = 'expression' AND e.kind = 'BinaryExpression' JOIN nodes a ON a.file = e.file AND a.parent_id = e.node_id AND a.field = 'left' AND a.kind = 'PropertyAccessExpression'
    JOIN nodes i ON i.file = a.file AND i.parent_id = a.node_id AND i.field = 'expression' AND i.kind = 'Identifier' JOIN node_symbols y ON y.file = i.file AND y.node_id = i.node_id AND y.symbol_id = d.symbol_id WHERE d.next_kind = 'ExpressionStatement' AND d.value_kind = 'ObjectLiteralExpression' AND d.value = '{{}}'""",
    "syntax": checks(children("expression", "argument"), {
        "var": "n.kind = 'VariableDeclarationList' AND starts_with(n.text, 'var ')", "arguments": "n.kind = 'Identifier' AND n.text = 'arguments'", "Math.pow": "n.kind IN ('CallExpression', 'NewExpression') AND k_expression.text = 'Math.pow'",
        "apply without this": "n.kind = 'CallExpression' AND suffix(k_expression.text, '.apply') AND k_argument.kind = 'NullKeyword'", "RegExp of a literal": "n.kind IN ('CallExpression', 'NewExpression') AND k_expression.text = 'RegExp' AND k_argument.kind = 'StringLiteral'"}) + f"""
  UNION ALL SELECT n.file, n.line, n.col, 'use const' FROM {children('initializer')}{PARENT} JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id WHERE n.kind = 'VariableDeclaration' AND k_initializer.kind IS NOT NULL AND p.kind = 'VariableDeclarationList' AND starts_with(p.text, 'let ')
    AND NOT EXISTS (SELECT 1 FROM writes w WHERE w.file = n.file AND w.symbol_id = y.symbol_id AND (w.by IS NULL OR w.by IN {_in(S.ASSIGNMENTS)}))
  UNION ALL SELECT n.file, n.line, n.col, 'use a template' FROM {SIDES}{PARENT} WHERE {binary('PlusToken')} AND NOT (k_left.kind = 'StringLiteral' AND k_right.kind = 'StringLiteral') AND coalesce(p.kind, '') NOT IN ('TemplateExpression', 'NoSubstitutionTemplateLiteral')
    AND EXISTS (SELECT 1 FROM node_types nt JOIN types t ON t.type_id = nt.type_id WHERE nt.file = n.file AND nt.node_id IN (k_left.node_id, k_right.node_id) AND t.flags & 132 <> 0)
  UNION ALL SELECT n.file, n.line, n.col, 'use a number literal' FROM {children('expression')} WHERE n.kind = 'CallExpression' AND k_expression.text = 'parseInt' AND {count_of('argument')} = 2
    AND EXISTS (SELECT 1 FROM nodes a WHERE a.file = n.file AND a.parent_id = n.node_id AND a.field = 'argument' AND a.ord = 1 AND a.kind = 'NumericLiteral' AND a.text IN ('2', '8', '16'))""",
    "typescript": checks(children("expression", "type") + PARENT, {
        "catch of any": "n.kind = 'VariableDeclaration' AND p.kind = 'CatchClause' AND k_type.kind = 'AnyKeyword'", "a string thrown": "n.kind = 'ThrowStatement' AND k_expression.kind IN ('StringLiteral', 'TemplateExpression')",
        "double assertion": "n.kind = 'AsExpression' AND k_expression.kind = 'AsExpression'", "empty interface": f"n.kind = 'InterfaceDeclaration' AND {count_of('member')} = 0 AND {count_of('heritage')} = 0",
        "non-null assertion": "n.kind = 'NonNullExpression'", "explicit any": "n.kind = 'AnyKeyword' AND coalesce(p.kind, '') <> 'CatchClause'"}) + f"""
  UNION ALL SELECT n.file, n.line, n.col, 'type said without need' FROM {children('type', 'initializer')} JOIN node_types a ON a.file = n.file AND a.node_id = k_type.node_id JOIN node_types b ON b.file = n.file AND b.node_id = k_initializer.node_id AND b.type_id = a.type_id JOIN types t ON t.type_id = a.type_id
    WHERE n.kind = 'VariableDeclaration' AND t.flags & 28 <> 0
  UNION ALL SELECT n.file, n.line, n.col, 'may be null here' FROM {children('expression')}{PARENT} JOIN typed x ON x.file = n.file AND x.node_id = k_expression.node_id JOIN types t ON t.type_id = x.type_id WHERE n.kind = 'PropertyAccessExpression' AND NOT contains(n.text, '?.')
    AND coalesce(p.kind, '') NOT IN ('IfStatement', 'ConditionalExpression') AND x.flags & 98304 <> 0 AND t.flags & 3 = 0
    AND NOT EXISTS (SELECT 1 FROM up u JOIN nodes c ON c.file = u.file AND c.node_id = u.anc WHERE u.file = n.file AND u.node_id = n.node_id AND contains(c.text, '?.') AND c.kind IN ('PropertyAccessExpression', 'ElementAccessExpression', 'CallExpression'))
  UNION ALL SELECT n.file, n.line, n.col, 'returns any unsaid' FROM {children('type')} JOIN node_types nt ON nt.file = n.file AND nt.node_id = n.node_id JOIN types t ON t.type_id = nt.type_id WHERE n.kind IN ('FunctionDeclaration', 'MethodDeclaration') AND n.text <> '' AND k_type.kind IS NULL AND t.flags & 1 <> 0
  UNION ALL SELECT n.file, n.line, n.col, 'no index signature' FROM {children('expression', 'argument')} JOIN node_types nt ON nt.file = n.file AND nt.node_id = k_expression.node_id JOIN types t ON t.type_id = nt.type_id WHERE n.kind = 'ElementAccessExpression' AND k_argument.kind NOT IN ('StringLiteral', 'NumericLiteral')
    AND t.flags & 3 = 0 AND len(t.members) = 0 AND NOT (suffix(t.shape, '[]') OR starts_with(t.shape, '[') OR regexp_matches(t.shape, '^(readonly )?(Array|ReadonlyArray|Map|Set|WeakMap|WeakSet|ReadonlyMap|ReadonlySet)<')) AND NOT regexp_matches(t.shape, '\\[\\w+: (string|number)\\]')
    AND NOT (len(t.props) > 0 AND EXISTS (SELECT 1 FROM node_types kt JOIN types k ON k.type_id = kt.type_id WHERE kt.file = n.file AND kt.node_id = k_argument.node_id AND (k.flags & 384 <> 0 OR (len(k.members) > 0 AND NOT EXISTS (SELECT 1 FROM types m WHERE list_contains(k.members, m.type_id) AND m.flags & 384 = 0)))))
  UNION ALL SELECT n.file, n.line, n.col, 'hides an outer variable' FROM nodes n JOIN scope s ON s.file = n.file AND s.node_id = n.node_id WHERE n.kind = 'VariableDeclaration' AND n.text <> '' AND EXISTS (SELECT 1 FROM nodes o JOIN scope os ON os.file = o.file AND os.node_id = o.node_id JOIN up u ON u.file = n.file AND u.node_id = s.sc AND u.anc = os.sc
    WHERE o.file = n.file AND o.text = n.text AND o.kind IN ('VariableDeclaration', 'Parameter'))""",
    "react": f"""SELECT n.file, n.line, n.col, 'button without a type' FROM nodes n WHERE suffix(n.file, '.tsx') AND n.kind IN ('JsxOpeningElement', 'JsxSelfClosingElement') AND regexp_matches(n.text, '^<?button\\b')
    AND NOT EXISTS (SELECT 1 FROM nodes a WHERE a.file = n.file AND a.parent_id = n.node_id AND a.kind = 'JsxAttribute' AND regexp_matches(a.text, '^type\\b'))
  UNION ALL SELECT n.file, n.line, n.col, 'async effect' FROM {children('expression', 'argument')} WHERE suffix(n.file, '.tsx') AND n.kind = 'CallExpression' AND k_expression.text = 'useEffect' AND EXISTS (SELECT 1 FROM nodes a WHERE a.file = n.file AND a.parent_id = k_argument.node_id AND a.kind = 'AsyncKeyword')
  UNION ALL SELECT n.file, n.line, n.col, 'component in a component' FROM nodes n WHERE suffix(n.file, '.tsx') AND n.kind = 'FunctionDeclaration' AND regexp_matches(n.text, '^[A-Z]') AND EXISTS (
    SELECT 1 FROM up u JOIN nodes o ON o.file = u.file AND o.node_id = u.anc WHERE u.file = n.file AND u.node_id = n.node_id AND o.kind = 'FunctionDeclaration' AND regexp_matches(o.text, '^[A-Z]'))
  UNION ALL SELECT n.file, n.line, n.col, 'state set in an effect' FROM origin e JOIN nodes cb ON cb.file = e.file AND cb.parent_id = e.node_id AND cb.field = 'argument' AND cb.ord = 0 AND cb.kind IN ('ArrowFunction', 'FunctionExpression')
    LEFT JOIN nodes l ON l.file = e.file AND l.parent_id = e.node_id AND l.field = 'argument' AND l.ord = 1 JOIN calls c ON c.file = e.file AND c.caller_id = cb.node_id JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id
    LEFT JOIN nodes g ON g.file = c.file AND g.parent_id = c.node_id AND g.field = 'argument' AND g.ord = 0
    WHERE e.origin = 'pkg:react' AND e.name = 'useEffect' AND suffix(e.file, '.tsx') AND NOT (coalesce(l.kind, '') = 'ArrayLiteralExpression' AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.file = l.file AND x.parent_id = l.node_id))
    AND EXISTS (SELECT 1 FROM origin s JOIN nodes si ON si.file = s.file AND si.node_id = s.node_id AND si.field = 'initializer' JOIN nodes pt ON pt.file = si.file AND pt.parent_id = si.parent_id AND pt.kind = 'ArrayBindingPattern' JOIN nodes b ON b.file = pt.file AND b.parent_id = pt.node_id AND b.kind = 'BindingElement' AND b.ord = 1
      JOIN node_symbols y ON y.file = b.file AND y.node_id = b.node_id WHERE s.origin = 'pkg:react' AND s.name IN {_in(S.STATE_HOOKS)} AND s.file = c.file AND y.symbol_id = c.target_symbol)
    AND coalesce(g.kind, '') NOT IN ('NewExpression', 'TrueKeyword', 'FalseKeyword', 'NullKeyword') AND NOT (coalesce(g.kind, '') = 'ArrayLiteralExpression' AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.file = g.file AND x.parent_id = g.node_id))
    AND NOT EXISTS (SELECT 1 FROM nodes i JOIN node_symbols y ON y.file = i.file AND y.node_id = i.node_id JOIN node_symbols z ON z.file = y.file AND z.symbol_id = y.symbol_id JOIN nodes d ON d.file = z.file AND d.node_id = z.node_id AND d.kind = 'Identifier' LEFT JOIN nodes dp ON dp.file = d.file AND dp.node_id = d.parent_id
      WHERE i.file = g.file AND i.kind = 'Identifier' AND (i.node_id = g.node_id OR EXISTS (SELECT 1 FROM up u WHERE u.file = i.file AND u.node_id = i.node_id AND u.anc = g.node_id))
      AND (d.parent_id = l.node_id OR (dp.kind = 'PropertyAccessExpression' AND d.field = 'expression' AND dp.parent_id = l.node_id)))""",
    "rules-of-hooks": f"""WITH h AS (SELECT n.*, o.fn, (SELECT u.kind = 'CallExpression' FROM up u WHERE u.file = n.file AND u.node_id = n.node_id AND u.dist = o.fn_dist + 1) AS callback,
      {near(LOOPS)} AS looped, {near(['IfStatement', 'ConditionalExpression', 'SwitchStatement'])} AS guarded
    FROM {children('expression')} LEFT JOIN owner o ON o.file = n.file AND o.node_id = n.node_id WHERE n.kind = 'CallExpression' AND regexp_matches(k_expression.text, '^(React\\.)?use[A-Z]\\w*$')),
  r AS (SELECT n.file, o.fn, min(n.start) AS returned FROM nodes n JOIN owner o ON o.file = n.file AND o.node_id = n.node_id WHERE n.kind = 'ReturnStatement' AND {near(['IfStatement'])} GROUP BY ALL)
  SELECT file, line, col, 'hook ' || what FROM (SELECT h.file, h.line, h.col, CASE WHEN h.fn IS NULL THEN 'at module level' WHEN callback THEN 'in a callback' WHEN looped THEN 'in a loop' WHEN guarded THEN 'under a condition'
    WHEN r.returned < h.start THEN 'after a return' END AS what FROM h LEFT JOIN r ON r.file = h.file AND r.fn = h.fn) WHERE what IS NOT NULL""",
    "no-re-export": f"""SELECT n.file, n.line, n.col, 'export from another module' FROM {children('module')} WHERE n.kind = 'ExportDeclaration' AND k_module.kind IS NOT NULL AND {count_of('specifier')} = 0
  UNION ALL SELECT n.file, n.line, n.col, CASE WHEN m.kind IS NULL THEN 'imported and exported: ' ELSE 'export from another module: ' END || n.text FROM nodes n JOIN nodes p ON p.file = n.file AND p.node_id = n.parent_id AND p.kind = 'ExportDeclaration'
    LEFT JOIN nodes m ON m.file = p.file AND m.parent_id = p.node_id AND m.field = 'module' LEFT JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id LEFT JOIN symbols s ON s.symbol_id = y.symbol_id
    WHERE n.kind = 'ExportSpecifier' AND n.field = 'specifier' AND (m.kind IS NOT NULL OR s.decl_file <> n.file)""",
    "no-duplicated-constants": f"""WITH c AS (SELECT n.file, n.line, n.col, n.text, k_initializer.text AS value, k_initializer.kind AS value_kind, contains(n.file, '/constants/') AS shared FROM {children('initializer')}
    WHERE n.kind = 'VariableDeclaration' AND k_initializer.kind IN ('StringLiteral', 'NumericLiteral'))
  SELECT c.file, c.line, c.col, 'same as in ' || min(s.file) FROM c JOIN c s ON s.shared AND s.text = c.text AND s.value = c.value AND s.value_kind = c.value_kind WHERE NOT c.shared GROUP BY c.file, c.line, c.col""",
}

# --- types, symbols, calls --------------------------------------------------------------------------

T, H = flow_rules, shape_rules
TYPED_SIDES = SIDES + type_of("k_left", "a") + type_of("k_right", "b")
EXPRESSION = children("expression") + type_of("k_expression", "x")
ARGUMENT = "origin c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id JOIN nodes g ON g.file = c.file AND g.parent_id = c.node_id AND g.field = 'argument' AND g.ord = 0"
ASSERTED = f"{children('expression', 'type')}{type_of('k_expression', 'x')}{type_of('n', 'y')} WHERE n.kind = 'AsExpression' AND coalesce(y.flags & 3, 0) = 0 AND coalesce(x.flags & 3, 0) = 0 AND coalesce(k_type.text, '') <> 'const' AND x.type_id IS NOT NULL AND y.type_id IS NOT NULL"
BOTH_WAYS = "((x.type_id, y.type_id) IN (SELECT (a, b) FROM fits) AND (y.type_id, x.type_id) IN (SELECT (a, b) FROM fits))"
SERVER = "(SELECT file FROM files WHERE directive = 'use server')"
AWAITED = "calls c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id JOIN nodes p ON p.file = n.file AND p.node_id = n.parent_id AND p.kind = 'AwaitExpression'"


def tainted(names, allowed, more: str = "", parameter: str = "TRUE") -> str:
    """Calls whose first argument is, or comes from, a parameter."""
    return f"""SELECT n.file, n.line, n.col, 'from a parameter: ' || c.name FROM {ARGUMENT} WHERE c.name IN {_in(names)} AND c.origin IN {_in(allowed)}{more} AND EXISTS (
  SELECT 1 FROM nodes q WHERE q.file = g.file AND q.kind = 'Parameter' AND {parameter} AND (q.node_id = g.node_id OR q.node_id IN (SELECT f.origin_node FROM flow f WHERE f.file = g.file AND f.node = g.node_id)))"""


BODIES |= {
    "await-non-thenable": f"SELECT n.file, n.line, n.col, 'nothing to await' FROM {EXPRESSION} WHERE n.kind = 'AwaitExpression' AND NOT x.thenable AND coalesce(x.flags & 3, 0) = 0",
    "no-floating-promises": f"""SELECT n.file, n.line, n.col, 'await it or catch its errors' FROM {EXPRESSION} WHERE n.kind = 'ExpressionStatement' AND x.thenable AND k_expression.kind NOT IN ('AwaitExpression', 'VoidExpression', 'BinaryExpression')
  AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.file = n.file AND c.node_id = k_expression.node_id AND list_contains(c.chain, 'catch'))""",
    "restrict-plus-operands": f"""SELECT n.file, n.line, n.col, 'operands of two types' FROM {TYPED_SIDES} WHERE {binary('PlusToken')} AND ((a.flags & {T.STRINGS} <> 0 AND b.flags & {T.NUMBERS} <> 0) OR (a.flags & {T.NUMBERS} <> 0 AND b.flags & {T.STRINGS} <> 0)
  OR (a.type_id IS NOT NULL AND b.type_id IS NOT NULL AND (a.flags & {T.BIGINTS} <> 0) <> (b.flags & {T.BIGINTS} <> 0)))""",
    "restrict-template-expr": f"SELECT n.file, n.line, n.col, 'no plain text form' FROM {EXPRESSION} WHERE n.kind = 'TemplateSpan' AND x.type_id IS NOT NULL AND x.flags & {T.STRINGS | T.NUMBERS | T.BOOLEANS | T.BIGINTS | T.ANY} = 0",
    "no-base-to-string": f"""SELECT n.file, n.line, n.col, 'no text of its own' FROM {TYPED_SIDES}{child('expression')}{type_of('k_expression', 'x')} WHERE (({binary('PlusToken')}) OR (n.kind = 'PropertyAccessExpression' AND suffix(n.text, '.toString')))
  AND (coalesce(NOT a.own_to_string AND a.flags & {T.OBJECT} <> 0, FALSE) OR coalesce(NOT b.own_to_string AND b.flags & {T.OBJECT} <> 0, FALSE) OR (n.kind <> 'BinaryExpression' AND coalesce(NOT x.own_to_string AND x.flags & {T.OBJECT} <> 0, FALSE)))""",
    "prefer-nullish-coalescing": f"SELECT n.file, n.line, n.col, 'use ??' FROM {TYPED_SIDES} WHERE {binary('BarBarToken')} AND (n.file, n.node_id) NOT IN (SELECT (file, node_id) FROM conditional) AND a.flags & {T.NULL | T.UNDEFINED} <> 0 AND a.flags & {T.BOOLEANS} = 0",
    "unnecessary-type-assertion": f"SELECT n.file, n.line, n.col, 'it has this type' FROM {ASSERTED} AND {BOTH_WAYS}",
    "prefer-satisfies-over-as": f"SELECT n.file, n.line, n.col, 'use satisfies' FROM {ASSERTED} AND k_expression.kind IN ('ObjectLiteralExpression', 'ArrayLiteralExpression') AND NOT {BOTH_WAYS}",
    "exhaustive-switch": f"""SELECT n.file, n.line, n.col, 'cases are missing' FROM {EXPRESSION} JOIN types t ON t.type_id = x.type_id WHERE n.kind = 'SwitchStatement' AND len(t.members) > 1
  AND NOT EXISTS (SELECT 1 FROM nodes d WHERE d.file = n.file AND d.parent_id = n.node_id AND d.kind = 'DefaultClause')
  AND EXISTS (SELECT 1 FROM (SELECT unnest(t.members) AS m) WHERE m NOT IN (SELECT fits.b FROM nodes q JOIN nodes e ON e.file = q.file AND e.parent_id = q.node_id AND e.field = 'expression' JOIN typed y ON y.file = e.file AND y.node_id = e.node_id JOIN fits ON fits.a = y.type_id
    WHERE q.file = n.file AND q.parent_id = n.node_id AND q.kind = 'CaseClause'))""",
    "any-propagation": f"""SELECT n.file, n.line, n.col, 'any goes on' FROM {children('initializer', 'expression')}{type_of('k_initializer', 'i')}{type_of('k_expression', 'x')} WHERE n.kind IN ('VariableDeclaration', 'ReturnStatement', 'PropertyAccessExpression', 'CallExpression')
  AND (coalesce(i.flags & 1, 0) <> 0 OR coalesce(x.flags & 1, 0) <> 0) AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.file = n.file AND c.node_id = coalesce(k_initializer.node_id, k_expression.node_id) AND array_to_string(c.chain, '.') IN ('JSON.parse', 'Reflect.get', 'import'))""",
    "cache-primitive-args": f"""SELECT n.file, n.line, n.col, 'an object is never the same again' FROM nodes n JOIN typed t ON t.file = n.file AND t.node_id = n.node_id WHERE n.kind = 'Parameter' AND t.flags & {T.OBJECT} <> 0 AND t.flags & {T.PRIMITIVES} = 0
  AND n.parent_id IN (SELECT g.node_id FROM calls c JOIN nodes g ON g.file = c.file AND g.parent_id = c.node_id AND g.field = 'argument' AND g.ord = 0 WHERE c.file = n.file AND c.name = 'cache')""",
    "deprecated-usage": """SELECT n.file, n.line, n.col, 'deprecated ' || s.name FROM nodes n JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id JOIN symbols s ON s.symbol_id = y.symbol_id
  WHERE n.kind = 'Identifier' AND list_contains(s.tags, 'deprecated') AND coalesce(s.origin, '') <> 'lib' AND NOT coalesce(n.file = s.decl_file AND n.start = s.decl_pos, FALSE)""",
    "no-weak-crypto": f"SELECT n.file, n.line, n.col, 'weak ' || lower(g.text) FROM {ARGUMENT} WHERE c.name IN {_in(T.HASH_METHODS)} AND c.origin IN ('pkg:crypto', 'pkg:node:crypto') AND g.kind = 'StringLiteral' AND lower(g.text) IN {_in(T.WEAK_ALGORITHMS)}",
    "no-implied-eval": f"SELECT n.file, n.line, n.col, 'text as code: ' || c.name FROM {ARGUMENT}{type_of('g', 'x')} WHERE c.name IN {_in(T.EVAL_FUNCTIONS)} AND c.origin = 'lib' AND x.flags & {T.STRINGS} <> 0",
    "no-client-data-fetch": f"SELECT n.file, n.line, n.col, 'fetch it on the server' FROM {ARGUMENT} WHERE suffix(c.file, '.tsx') AND c.file NOT IN {SERVER} AND (c.origin = 'pkg:axios' OR (c.name = 'fetch' AND c.origin = 'lib' AND starts_with(g.text, '/api')))",
    "no-dynamic-sql": f"""WITH f AS (SELECT * FROM nodes WHERE kind IN ('StringLiteral', 'NoSubstitutionTemplateLiteral') OR (kind = 'TaggedTemplateExpression' AND starts_with(text, 'sql')))
  SELECT n.file, n.line, n.col, 'SQL from values' FROM {ARGUMENT} WHERE c.name = 'execute' AND c.chain[1] = 'db' AND NOT EXISTS (SELECT 1 FROM f WHERE f.file = g.file AND f.node_id = g.node_id)
  AND NOT EXISTS (SELECT 1 FROM f JOIN nodes v ON v.file = f.file AND v.node_id = f.parent_id WHERE f.file = g.file AND f.field = 'initializer' AND v.kind = 'VariableDeclaration' AND v.text = g.text)""",
    "no-db-antipatterns": f"""SELECT n.file, n.line, n.col, 'one call for all' FROM {AWAITED} WHERE c.chain[1] = 'db' AND list_has_any(c.chain, {_literal(list(T.DB_METHODS))}) AND {near(LOOPS)}
  UNION ALL SELECT n.file, n.line, n.col, 'transaction' FROM calls c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id WHERE c.name = 'transaction' AND c.chain[1] = 'db'""",
    "missing-returning": f"""SELECT n.file, n.line, n.col, 'add returning()' FROM {AWAITED} JOIN nodes q ON q.file = p.file AND q.node_id = p.parent_id AND q.kind = 'VariableDeclaration'
  WHERE c.chain[1] = 'db' AND list_has_any(c.chain, ['insert', 'update']) AND n.file IN {SERVER} AND NOT list_contains(c.chain, 'returning')""",
    "cache-caller-count": f"""SELECT n.file, n.line, n.col, 'calls: ' || (SELECT count(*) FROM calls u WHERE u.target_symbol = y.symbol_id) FROM {children('initializer')} JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id
  WHERE n.kind = 'VariableDeclaration' AND EXISTS (SELECT 1 FROM calls c WHERE c.file = n.file AND c.node_id = k_initializer.node_id AND c.name = 'cache') AND (SELECT count(*) FROM calls u WHERE u.target_symbol = y.symbol_id) < 2""",
    "effect-cleanup": f"""WITH pair AS (SELECT * FROM (VALUES {', '.join(f"({_literal(a)}, {_literal(b)})" for a, b in T.CLEANUP.items())}) v(made, ended)),
  e AS (SELECT c.file, g.node_id AS fn FROM calls c JOIN nodes g ON g.file = c.file AND g.parent_id = c.node_id AND g.field = 'argument' AND g.ord = 0 WHERE c.name = 'useEffect')
  SELECT n.file, n.line, n.col, 'no ' || pair.ended FROM calls c JOIN pair ON pair.made = c.name JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id WHERE suffix(c.file, '.tsx') AND (c.file, c.caller_id) IN (SELECT (file, fn) FROM e)
  AND NOT EXISTS (SELECT 1 FROM calls x JOIN up u ON u.file = x.file AND u.node_id = x.node_id WHERE x.file = c.file AND x.name = pair.ended AND u.anc = c.caller_id AND coalesce(x.caller_id, -1) <> c.caller_id)""",
    "input-validation": f"""WITH own AS (SELECT DISTINCT file, caller_id AS fn FROM calls WHERE name = 'safeParse')
  SELECT n.file, n.line, n.col, 'check the input first' FROM nodes n WHERE n.kind = 'FunctionDeclaration' AND {count_of('parameter')} > 0 AND n.file IN {SERVER} AND EXISTS (SELECT 1 FROM exports x WHERE x.file = n.file AND x.name = n.text)
  AND NOT EXISTS (SELECT 1 FROM own WHERE own.file = n.file AND own.fn = n.node_id)
  AND NOT EXISTS (SELECT 1 FROM calls c JOIN node_symbols y ON y.symbol_id = c.target_symbol JOIN own ON own.file = y.file AND own.fn = y.node_id WHERE c.file = n.file AND c.caller_id = n.node_id)""",
    "state-hooks-cluster": f"""WITH k AS (SELECT t.type_id, t.flags, t.shape, (SELECT bool_or(m.flags & 98304 <> 0) FROM types m WHERE list_contains(t.members, m.type_id)) AS nullable, (SELECT bool_or(m.flags & 524288 <> 0) FROM types m WHERE list_contains(t.members, m.type_id)) AS data,
      (SELECT bool_and(m.flags & 128 <> 0) FROM types m WHERE list_contains(t.members, m.type_id)) AS status, (SELECT bool_and(m.flags & 512 <> 0) FROM types m WHERE list_contains(t.members, m.type_id)) AS flags_only FROM types t),
  h AS (SELECT c.file, c.node_id, c.caller_id AS fn, c.name, n.line, n.col, n.start, n.parent_id AS declared, k.nullable, k.data, k.status, k.shape, coalesce(k.flags & 16 <> 0, FALSE) OR coalesce(k.flags_only, FALSE) AS flag
    FROM origin c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id AND n.field = 'initializer' LEFT JOIN node_types nt ON nt.file = c.file AND nt.node_id = c.node_id LEFT JOIN k ON k.type_id = nt.type_id WHERE c.origin = 'pkg:react' AND c.caller_id IS NOT NULL),
  s AS (SELECT * FROM h WHERE name = 'useState'),
  setter AS (SELECT s.file, s.fn, y.symbol_id FROM s JOIN nodes p ON p.file = s.file AND p.parent_id = s.declared AND p.kind = 'ArrayBindingPattern' JOIN nodes e ON e.file = p.file AND e.parent_id = p.node_id AND e.kind = 'BindingElement' AND e.ord = 1 JOIN node_symbols y ON y.file = e.file AND y.node_id = e.node_id WHERE s.flag),
  ref AS (SELECT h.file, h.fn, y.symbol_id FROM h JOIN node_symbols y ON y.file = h.file AND y.node_id = h.declared WHERE h.name = 'useRef' AND NOT coalesce(regexp_matches(h.shape, 'HTML\\w*Element|SVG\\w*Element|^Element\\b|^Node\\b'), FALSE)),
  both_set AS (SELECT DISTINCT t.file, t.fn FROM setter t JOIN calls c ON c.file = t.file AND c.target_symbol = t.symbol_id JOIN up u ON u.file = c.file AND u.node_id = c.node_id AND u.kind IN ('ArrowFunction', 'FunctionExpression') AND u.anc <> t.fn
    JOIN ref r ON r.file = t.file AND r.fn = t.fn JOIN node_symbols y ON y.file = r.file AND y.symbol_id = r.symbol_id JOIN nodes i ON i.file = y.file AND i.node_id = y.node_id AND i.field = 'expression' JOIN nodes l ON l.file = i.file AND l.node_id = i.parent_id AND l.field = 'left' AND suffix(l.text, '.current')
    JOIN nodes o ON o.file = l.file AND o.parent_id = l.parent_id AND o.field = 'operator' AND o.kind = 'EqualsToken' JOIN up v ON v.file = l.file AND v.node_id = l.parent_id AND v.anc = u.anc)
  SELECT file, arg_min(line, start), arg_min(col, start), 'many states' FROM s GROUP BY file, fn HAVING count(*) >= 5
  UNION ALL SELECT file, arg_min(line, start), arg_min(col, start), 'several may be null' FROM s WHERE nullable GROUP BY file, fn HAVING count(*) >= 2
  UNION ALL SELECT file, line, col, 'status beside data' FROM s WHERE status AND EXISTS (SELECT 1 FROM s d WHERE d.file = s.file AND d.fn = s.fn AND d.nullable AND d.data)
  UNION ALL SELECT s.file, arg_min(line, start), arg_min(col, start), 'flag beside a ref' FROM s JOIN both_set b ON b.file = s.file AND b.fn = s.fn WHERE s.flag GROUP BY s.file, s.fn""",
    "performance": f"""WITH arrays AS (SELECT nt.file, nt.node_id FROM node_types nt JOIN types t ON t.type_id = nt.type_id WHERE suffix(t.shape, '[]') OR starts_with(t.shape, '[') OR regexp_matches(t.shape, '^(readonly )?(Array|ReadonlyArray)<')),
  inner_fn AS (SELECT file, node_id, arg_min(anc, dist) AS fn FROM up WHERE kind IN ('ArrowFunction', 'FunctionExpression') GROUP BY ALL)
  SELECT n.file, n.line, n.col, 'make it once, before the loop' FROM {children('expression')} WHERE n.kind = 'NewExpression' AND k_expression.text = 'RegExp' AND {near(LOOPS)}
  UNION ALL SELECT n.file, n.line, n.col, 'blocks' FROM origin c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id WHERE c.name IN {_in(T.SYNC_IO)} AND starts_with(c.origin, 'pkg:')
  UNION ALL SELECT n.file, n.line, n.col, 'long chain' FROM origin c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id WHERE len(c.chain) > 7 AND c.origin = 'local'
  UNION ALL SELECT n.file, n.line, n.col, 'array changed in a callback' FROM calls c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id JOIN inner_fn f ON f.file = n.file AND f.node_id = n.node_id JOIN nodes g ON g.file = f.file AND g.node_id = f.fn
    JOIN calls o ON o.file = g.file AND o.node_id = g.parent_id AND o.name IN ('map', 'filter') AND len(o.chain) > 1 WHERE c.name IN ('push', 'unshift', 'splice') AND len(c.chain) > 1
    AND EXISTS (SELECT 1 FROM nodes r JOIN arrays a ON a.file = r.file AND a.node_id = r.node_id WHERE r.file = o.file AND r.parent_id = o.node_id AND r.field = 'receiver')
  UNION ALL SELECT n.file, n.line, n.col, 'hole in an array' FROM nodes n JOIN nodes e ON e.file = n.file AND e.parent_id = n.node_id AND e.kind = 'ElementAccessExpression' AND e.field = 'expression' JOIN nodes x ON x.file = e.file AND x.parent_id = e.node_id AND x.field = 'expression'
    JOIN arrays a ON a.file = x.file AND a.node_id = x.node_id WHERE n.kind = 'DeleteExpression'
  UNION ALL SELECT src, line, 1, 'import through an index' FROM import_edges WHERE starts_with(specifier, '.') AND regexp_matches(dst, '(^|/)index\\.[tj]sx?$')""",
    **{rule: tainted(names, allowed, f" AND c.file IN {SERVER}" if rule == "no-ssrf" else "") for rule, (_, _, names, allowed) in T.TAINTED.items()},
    "no-unthrown-error": f"""WITH RECURSIVE e AS (SELECT symbol_id FROM symbols WHERE name = 'Error' AND origin = 'lib' UNION SELECT b.symbol_id FROM class_bases b JOIN e ON e.symbol_id = b.base_id)
  SELECT n.file, n.line, n.col, 'throw it' FROM nodes n{PARENT} JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id WHERE n.kind = 'NewExpression' AND p.kind = 'ExpressionStatement' AND y.symbol_id IN (SELECT symbol_id FROM e)""",
    # shapes
    "prefer-modern-api": checks(children("left", "operator", "right", "expression", "argument"), {
        "use includes": "n.kind = 'BinaryExpression' AND regexp_matches(k_left.text, '\\.indexOf\\(.*\\)$') AND k_right.text = '-1'",
        "use startsWith": f"n.kind = 'BinaryExpression' AND regexp_matches(k_left.text, '\\.indexOf\\(.*\\)$') AND k_right.text = '0' AND k_operator.kind IN {_in(S.EQUALITY)}",
        "property deleted": "n.kind = 'DeleteExpression'", "use spread": "n.kind = 'CallExpression' AND k_expression.text = 'Object.assign' AND k_argument.kind = 'ObjectLiteralExpression'",
        "use flatMap": "n.kind = 'CallExpression' AND regexp_matches(k_expression.text, '\\.map\\(.*\\)\\.flat$')",
        "use at": "n.kind = 'ElementAccessExpression' AND regexp_matches(n.text, '^[\\w.]+\\[[\\w.]+\\.length\\s*-\\s*\\d+\\]$') AND starts_with(n.text[length(split_part(n.text, '[', 1)) + 2:], split_part(n.text, '[', 1) || '.length')",
        "use Object.hasOwn": "n.kind = 'CallExpression' AND suffix(k_expression.text, 'hasOwnProperty.call')"}),
    "prefer-optional-chain": f"SELECT n.file, n.line, n.col, 'use ?.' FROM {SIDES} WHERE {binary('AmpersandAmpersandToken')} AND k_left.kind IN {_in((*S.PURE, 'BinaryExpression'))} AND starts_with(k_right.text, regexp_replace(k_left.text, '\\s*!==?\\s*(null|undefined)$', '') || '.')",
    "promise-all-opportunity": f"""WITH s AS (SELECT n.*, lag(n.node_id) OVER w AS before, EXISTS (SELECT 1 FROM up u JOIN nodes a ON a.file = u.file AND a.node_id = u.node_id WHERE u.file = n.file AND u.anc = n.node_id AND a.kind = 'AwaitExpression') AS awaits
      FROM nodes n WHERE n.field = 'statement' WINDOW w AS (PARTITION BY n.file, n.parent_id ORDER BY n.ord)),
  v AS (SELECT u.file, u.anc, a.kind, y.symbol_id FROM up u JOIN nodes a ON a.file = u.file AND a.node_id = u.node_id JOIN node_symbols y ON y.file = a.file AND y.node_id = a.node_id)
  SELECT n.file, n.line, n.col, 'await both at once' FROM s n JOIN s b ON b.file = n.file AND b.node_id = n.before WHERE n.awaits AND b.awaits AND NOT {near(['TryStatement', 'CatchClause'])}
  AND NOT EXISTS (SELECT 1 FROM v d JOIN v q ON q.file = d.file AND q.symbol_id = d.symbol_id WHERE d.file = n.file AND d.anc = n.before AND d.kind = 'VariableDeclaration' AND q.anc = n.node_id AND q.kind = 'Identifier')""",
    "exhaustive-deps": f"""WITH hook AS (SELECT c.file, c.node_id, c.caller_id, g.node_id AS fn, l.node_id AS listed, n.line, n.col FROM {ARGUMENT} JOIN nodes l ON l.file = c.file AND l.parent_id = c.node_id AND l.field = 'argument' AND l.ord = 1 AND l.kind = 'ArrayLiteralExpression'
      WHERE c.origin = 'pkg:react' AND c.name IN {_in(H.HOOKS_WITH_DEPS)}),
  seen AS (SELECT u.file, u.anc, i.text, y.symbol_id FROM up u JOIN nodes i ON i.file = u.file AND i.node_id = u.node_id AND i.kind = 'Identifier' JOIN node_symbols y ON y.file = i.file AND y.node_id = i.node_id),
  made AS (SELECT n.file, n.node_id, c.name FROM {children('initializer')} JOIN origin c ON c.file = n.file AND c.node_id = k_initializer.node_id AND c.origin = 'pkg:react' WHERE n.kind = 'VariableDeclaration'),
  stable AS (SELECT b.file, b.node_id FROM nodes b JOIN nodes p ON p.file = b.file AND p.node_id = b.parent_id JOIN made ON made.file = b.file AND made.node_id = p.parent_id WHERE b.kind = 'BindingElement' AND b.field = 'element' AND b.ord = 1 AND made.name IN {_in(H.STABLE_SETTER_HOOKS)}
    UNION ALL SELECT file, node_id FROM made WHERE name IN {_in(H.STABLE_VALUE_HOOKS)}
    UNION ALL SELECT n.file, n.node_id FROM {children('initializer')}{PARENT} WHERE n.kind = 'VariableDeclaration' AND k_initializer.kind IN {_in(H.STABLE_LITERALS)} AND p.kind = 'VariableDeclarationList' AND starts_with(p.text, 'const ')),
  fixed AS (SELECT s.file, y.symbol_id FROM stable s JOIN node_symbols y ON y.file = s.file AND y.node_id = s.node_id),
  declared AS (SELECT n.file, o.fn, y.symbol_id FROM nodes n JOIN owner o ON o.file = n.file AND o.node_id = n.node_id JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id WHERE n.kind IN ('VariableDeclaration', 'Parameter', 'BindingElement'))
  SELECT h.file, h.line, h.col, 'missing ' || string_agg(DISTINCT s.text, ', ' ORDER BY s.text) FROM hook h JOIN seen s ON s.file = h.file AND s.anc = h.fn
  WHERE (h.file, h.caller_id, s.symbol_id) IN (SELECT (file, fn, symbol_id) FROM declared) AND (h.file, s.symbol_id) NOT IN (SELECT (file, symbol_id) FROM fixed) AND (h.file, h.listed, s.symbol_id) NOT IN (SELECT (file, anc, symbol_id) FROM seen)
  GROUP BY h.file, h.node_id, h.line, h.col""",
    "narrow-param-type": """WITH i AS (SELECT n.file, y.symbol_id, CASE WHEN p.kind = 'PropertyAccessExpression' AND n.field = 'expression' AND n.ord = 0 THEN split_part(p.text, '.', -1) END AS prop FROM nodes n JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id
    LEFT JOIN nodes p ON p.file = n.file AND p.node_id = n.parent_id WHERE n.kind = 'Identifier' AND coalesce(n.field, '') <> 'name'),
  q AS (SELECT n.file, n.node_id, n.line, n.col, k.used FROM nodes n JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id JOIN (SELECT file, symbol_id, count(DISTINCT prop) AS used FROM i GROUP BY ALL HAVING count(*) = count(prop)) k ON k.file = y.file AND k.symbol_id = y.symbol_id WHERE n.kind = 'Parameter'),
  fewer AS (SELECT q.* FROM q JOIN nodes r ON r.file = q.file AND r.parent_id = q.node_id AND r.field = 'type' AND r.kind = 'TypeReference' AND r.text = 'Partial' JOIN nodes a ON a.file = r.file AND a.parent_id = r.node_id AND a.field = 'typeArgument' JOIN node_types nt ON nt.file = a.file AND nt.node_id = a.node_id
    JOIN types t ON t.type_id = nt.type_id WHERE q.used <= 5 AND q.used < len(t.props))
  SELECT file, line, col, 'few of a partial type' FROM fewer UNION ALL SELECT q.file, q.line, q.col, 'few of a wide type' FROM q JOIN node_types nt ON nt.file = q.file AND nt.node_id = q.node_id JOIN types t ON t.type_id = nt.type_id WHERE len(t.props) >= 10 AND q.used < 0.25 * len(t.props)
    AND NOT EXISTS (SELECT 1 FROM fewer f WHERE f.file = q.file AND f.node_id = q.node_id)""",
    "no-async-client-component": """WITH RECURSIVE e AS (SELECT type_id, 0 AS k FROM types WHERE len(list_filter(props, lambda q: q.name IN ('type', 'props', 'key'))) = 3 UNION SELECT t.type_id, e.k + 1 FROM e JOIN types t ON list_contains(t.members, e.type_id) WHERE e.k < 2),
  d AS (SELECT n.*, n.node_id AS fn FROM nodes n WHERE n.kind = 'FunctionDeclaration' UNION ALL SELECT n.*, i.node_id FROM nodes n JOIN nodes i ON i.file = n.file AND i.parent_id = n.node_id AND i.field = 'initializer' AND i.kind IN ('ArrowFunction', 'FunctionExpression') WHERE n.kind = 'VariableDeclaration')
  SELECT d.file, d.line, d.col, 'async component' FROM d WHERE suffix(d.file, '.tsx') AND d.file IN (SELECT file FROM files WHERE directive = 'use client') AND EXISTS (SELECT 1 FROM exports x WHERE x.file = d.file AND x.name = d.text)
  AND EXISTS (SELECT 1 FROM nodes a WHERE a.file = d.file AND a.parent_id = d.fn AND a.kind = 'AsyncKeyword' AND a.field = 'modifier') AND EXISTS (SELECT 1 FROM node_types nt JOIN e ON e.type_id = nt.type_id WHERE nt.file = d.file AND nt.node_id = d.fn)""",
    "no-misused-promises": f"""SELECT n.file, n.line, n.col, 'not awaited by ' || c.name FROM {ARGUMENT} WHERE g.kind IN ('ArrowFunction', 'FunctionExpression') AND EXISTS (SELECT 1 FROM nodes a WHERE a.file = g.file AND a.parent_id = g.node_id AND a.kind = 'AsyncKeyword' AND a.field = 'modifier')
  AND ((c.name = 'useEffect' AND starts_with(c.origin, 'pkg:')) OR EXISTS (SELECT 1 FROM contexts x JOIN types t ON t.type_id = x.type_id WHERE x.file = g.file AND x.node_id = g.node_id AND regexp_matches(t.shape, '=>\\s*void$')))""",
    "no-page-params-unsafe-parse": f"""SELECT n.file, n.line, n.col, 'use safeParse' FROM {ARGUMENT} WHERE c.name = 'parse' AND regexp_matches(c.file, 'page\\.tsx$') AND EXISTS (SELECT 1 FROM nodes q WHERE q.file = g.file AND q.kind = 'Parameter' AND regexp_matches(q.text, '\\b(params|searchParams)\\b')
    AND (q.node_id = g.node_id OR q.node_id IN (SELECT f.origin_node FROM flow f WHERE f.file = g.file AND f.node = g.node_id)))""",
    "no-redundant-zod-parse": f"""SELECT n.file, n.line, n.col, 'it has this type' FROM {ARGUMENT}{type_of('g', 'x')}{type_of('n', 'y')} WHERE c.name IN ('parse', 'safeParse') AND NOT list_contains(c.chain, 'catch') AND c.chain[1] <> 'JSON' AND c.file NOT IN {SERVER}
  AND coalesce(x.flags & 3, 0) = 0 AND (x.type_id, y.type_id) IN (SELECT (a, b) FROM fits)""",
    "unbranded-type-consistency": f"""WITH b AS (SELECT nt.file, nt.node_id FROM node_types nt JOIN types t ON t.type_id = nt.type_id WHERE t.flags & 2097152 <> 0 AND EXISTS (SELECT 1 FROM types m WHERE list_contains(t.members, m.type_id) AND m.flags & 4 <> 0)
    AND EXISTS (SELECT 1 FROM types m WHERE list_contains(t.members, m.type_id) AND m.flags & 524288 <> 0))
  SELECT n.file, n.line, n.col, 'plain string ' || n.text FROM nodes n JOIN typed t ON t.file = n.file AND t.node_id = n.node_id WHERE n.kind IN ('Parameter', 'PropertySignature', 'VariableDeclaration') AND regexp_matches(n.text, '[a-z]Id$') AND t.flags = {T.STRING}
  UNION ALL SELECT n.file, n.line, n.col, 'branded key of a container' FROM calls c JOIN nodes n ON n.file = c.file AND n.node_id = c.node_id JOIN nodes g ON g.file = n.file AND g.parent_id = n.node_id AND g.field = 'argument' AND g.ord = 0 JOIN b ON b.file = g.file AND b.node_id = g.node_id
    WHERE c.name IN {_in(H.CONTAINER_KEY_METHODS)} AND len(c.chain) > 1 AND EXISTS (SELECT 1 FROM nodes r JOIN node_types nt ON nt.file = r.file AND nt.node_id = r.node_id JOIN types t ON t.type_id = nt.type_id WHERE r.file = n.file AND r.parent_id = n.node_id AND r.field = 'receiver' AND regexp_matches(t.shape, '^(Map|Set)<string[,>]'))
  UNION ALL SELECT n.file, n.line, n.col, 'branded key of a record' FROM {children('expression', 'argument')} JOIN b ON b.file = n.file AND b.node_id = k_argument.node_id JOIN node_types nt ON nt.file = n.file AND nt.node_id = k_expression.node_id JOIN types t ON t.type_id = nt.type_id
    WHERE n.kind = 'ElementAccessExpression' AND (regexp_matches(t.shape, '\\[\\w+: string\\]') OR starts_with(t.shape, 'Record<string,'))""",
    "prefer-literal-union": f"""WITH narrow AS (SELECT t.type_id FROM types t WHERE t.flags & 128 <> 0 OR EXISTS (SELECT 1 FROM types m WHERE list_contains(t.members, m.type_id) AND m.flags & 128 <> 0)),
  q AS (SELECT n.file, n.node_id, n.line, n.col, CASE WHEN k_left.kind = 'StringLiteral' THEN k_right.node_id ELSE k_left.node_id END AS operand, CASE WHEN k_left.kind = 'StringLiteral' THEN k_left.text ELSE k_right.text END AS literal
    FROM {SIDES} WHERE {binary('EqualsEqualsEqualsToken', 'ExclamationEqualsEqualsToken')} AND (k_left.kind = 'StringLiteral') <> (k_right.kind = 'StringLiteral')),
  fed AS (SELECT i.file, i.node_id, y.symbol_id FROM nodes i JOIN node_symbols y ON y.file = i.file AND y.node_id = i.node_id LEFT JOIN nodes p ON p.file = i.file AND p.node_id = i.parent_id LEFT JOIN owner o ON o.file = i.file AND o.node_id = i.node_id WHERE i.kind = 'Identifier'
    AND ((i.field = 'argument' AND EXISTS (SELECT 1 FROM contexts x WHERE x.file = i.file AND x.node_id = i.node_id AND x.type_id IN (SELECT type_id FROM narrow)))
      OR (i.field = 'expression' AND p.kind = 'ReturnStatement' AND EXISTS (SELECT 1 FROM node_types r WHERE r.file = i.file AND r.node_id = o.fn AND r.type_id IN (SELECT type_id FROM narrow))))),
  guard AS (SELECT u.file, u.node_id, arg_min(u.anc, u.dist) AS g, arg_min(u.kind, u.dist) AS kind FROM up u WHERE u.kind = 'IfStatement' OR u.kind IN {_in(FUNCTIONS)} GROUP BY ALL)
  SELECT q.file, q.line, q.col, 'make it a union of literals' FROM q JOIN nodes o ON o.file = q.file AND o.node_id = q.operand WHERE q.literal NOT IN ('', '''''', '""')
  AND EXISTS (SELECT 1 FROM node_types nt JOIN types t ON t.type_id = nt.type_id WHERE nt.file = q.file AND nt.node_id = q.operand AND t.flags = {T.STRING} AND len(t.members) = 0)
  AND NOT EXISTS (SELECT 1 FROM node_symbols y JOIN symbols s ON s.symbol_id = y.symbol_id WHERE y.file = q.file AND y.node_id = q.operand AND (s.origin = 'lib' OR starts_with(s.origin, 'pkg:')))
  AND NOT EXISTS (SELECT 1 FROM guard w JOIN nodes t ON t.file = w.file AND t.parent_id = w.g AND t.field = 'then' JOIN node_symbols y ON y.file = q.file AND y.node_id = q.operand JOIN fed f ON f.file = w.file AND f.symbol_id = y.symbol_id JOIN up u ON u.file = f.file AND u.node_id = f.node_id AND u.anc = t.node_id
    WHERE w.file = q.file AND w.node_id = q.node_id AND w.kind = 'IfStatement' AND o.kind = 'Identifier')""",
    "zustand-patterns": checks(children("expression", "argument"), {
        "shallow for one field": "n.kind = 'CallExpression' AND k_expression.text = 'useShallow' AND regexp_matches(k_argument.text, '^\\(?\\w+\\)?\\s*=>\\s*\\w+\\.\\w+$')",
        "fields without shallow": "n.kind = 'CallExpression' AND regexp_matches(k_expression.text, '^use\\w*Store$') AND k_argument.kind = 'ArrowFunction' AND len(string_split(regexp_extract(k_argument.text, '=>\\s*\\(\\{([^}]*)\\}', 1), ',')) >= 2"}) + f"""
  UNION ALL SELECT n.file, n.line, n.col, 'store read once' FROM {children('expression', 'argument')} JOIN nodes l ON l.file = n.file AND l.parent_id = n.node_id AND l.field = 'argument' AND l.ord = 1 AND l.kind = 'ArrayLiteralExpression'
    WHERE n.kind = 'CallExpression' AND k_expression.text = 'useEffect' AND k_argument.kind IN ('ArrowFunction', 'FunctionExpression') AND NOT EXISTS (SELECT 1 FROM nodes e WHERE e.file = l.file AND e.parent_id = l.node_id) AND EXISTS (
      SELECT 1 FROM up u JOIN nodes r ON r.file = u.file AND r.node_id = u.node_id LEFT JOIN nodes x ON x.file = r.file AND x.parent_id = r.node_id AND x.field = 'expression' AND x.ord = 0
        LEFT JOIN nodes a ON a.file = r.file AND a.node_id = r.parent_id LEFT JOIN nodes b ON b.file = a.file AND b.node_id = a.parent_id LEFT JOIN nodes c ON c.file = b.file AND c.node_id = b.parent_id
      WHERE u.file = n.file AND u.anc = k_argument.node_id AND ((r.kind = 'CallExpression' AND regexp_matches(x.text, '^use\\w*Store$'))
        OR (r.kind = 'PropertyAccessExpression' AND regexp_matches(r.text, '^use\\w*Store\\.getState$') AND NOT coalesce(a.kind = 'CallExpression' AND b.kind = 'PropertyAccessExpression' AND c.kind = 'CallExpression', FALSE))))""",
    "prop-drilling": """WITH q AS (SELECT n.file, o.fn, y.symbol_id, nt.type_id FROM nodes n JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id LEFT JOIN owner o ON o.file = n.file AND o.node_id = n.node_id LEFT JOIN node_types nt ON nt.file = n.file AND nt.node_id = n.node_id WHERE n.kind IN ('Parameter', 'BindingElement')),
  i AS (SELECT n.file, y.symbol_id FROM nodes n JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id LEFT JOIN nodes p ON p.file = n.file AND p.node_id = n.parent_id WHERE n.kind = 'Identifier' GROUP BY ALL HAVING bool_and(coalesce(p.kind = 'JsxExpression', FALSE)))
  SELECT n.file, n.line, n.col, k || ' passed on' FROM nodes n JOIN (SELECT q.file, q.fn, count(*) AS k, count(*) FILTER (contains(t.shape, '=>')) AS callables FROM q JOIN i ON i.file = q.file AND i.symbol_id = q.symbol_id LEFT JOIN types t ON t.type_id = q.type_id GROUP BY ALL) d
    ON d.file = n.file AND d.fn = n.node_id WHERE d.k >= 4 AND d.callables >= 2""",
    "no-db-origin-client-boundary": """WITH RECURSIVE inner_type AS (SELECT type_id AS holder, unnest(list_concat(members, list_transform(props, lambda q: q.id))) AS held FROM types),
  h AS (SELECT type_id FROM types WHERE regexp_matches(shape, 'InferSelectModel|\\$inferSelect') UNION SELECT i.holder FROM inner_type i JOIN h ON h.type_id = i.held)
  SELECT n.file, n.line, n.col, 'holds a database row' FROM nodes n JOIN node_types nt ON nt.file = n.file AND nt.node_id = n.node_id WHERE n.kind = 'Parameter' AND n.ord = 0 AND n.file IN (SELECT file FROM files WHERE directive = 'use client') AND nt.type_id IN (SELECT type_id FROM h)""",
    "type-precision": f"""WITH v AS (SELECT n.file, n.parent_id, k_type.node_id AS annotation, k_type.text AS name, k_type.line, k_type.col, k_initializer.node_id AS literal, (SELECT count(*) FROM nodes c WHERE c.file = n.file AND c.parent_id = k_initializer.node_id AND c.field = 'property') AS keys,
      (SELECT count(*) FROM nodes c WHERE c.file = n.file AND c.parent_id = k_type.node_id AND c.field = 'typeArgument') AS arguments FROM {children('type', 'initializer')} WHERE n.kind = 'VariableDeclaration' AND k_type.kind = 'TypeReference' AND k_initializer.kind = 'ObjectLiteralExpression'),
  g AS (SELECT v.*, t.flags, len(t.props) AS total FROM v JOIN nodes a ON a.file = v.file AND a.parent_id = v.annotation AND a.field = 'typeArgument' AND a.ord = 0 JOIN node_types nt ON nt.file = a.file AND nt.node_id = a.node_id JOIN types t ON t.type_id = nt.type_id)
  SELECT file, line, col, 'pick the keys' FROM g WHERE name = 'Partial' AND arguments = 1 AND keys > 0 AND keys < total
  UNION ALL SELECT file, line, col, 'name the keys' FROM g WHERE name = 'Record' AND arguments = 2 AND flags & 4 <> 0 AND keys >= 2
  UNION ALL SELECT v.file, v.line, v.col, 'use satisfies' FROM v JOIN nodes l ON l.file = v.file AND l.node_id = v.parent_id AND l.kind = 'VariableDeclarationList' AND starts_with(l.text, 'const ') JOIN node_types x ON x.file = v.file AND x.node_id = v.literal JOIN node_types y ON y.file = v.file AND y.node_id = v.annotation
    WHERE v.keys >= 2 AND v.name NOT IN ('Partial', 'Record') AND (x.type_id, y.type_id) IN (SELECT (a, b) FROM fits)
  UNION ALL SELECT n.file, n.line, n.col, 'type known' FROM {SIDES} JOIN nodes i ON i.file = n.file AND i.parent_id = k_left.node_id AND i.field = 'expression' AND i.kind = 'Identifier' JOIN node_types nt ON nt.file = i.file AND nt.node_id = i.node_id JOIN types t ON t.type_id = nt.type_id
    WHERE {binary('EqualsEqualsEqualsToken', 'ExclamationEqualsEqualsToken')} AND k_left.kind = 'TypeOfExpression' AND k_right.kind = 'StringLiteral' AND len(t.members) = 0 AND t.flags & CASE k_right.text WHEN 'string' THEN {T.STRINGS} WHEN 'number' THEN {T.NUMBERS} WHEN 'boolean' THEN {T.BOOLEANS} ELSE 0 END <> 0
  UNION ALL SELECT n.file, n.line, n.col, 'never null' FROM {SIDES} JOIN typed x ON x.file = n.file AND x.node_id = k_left.node_id WHERE {binary(*S.EQUALITY)} AND k_right.kind IN ('NullKeyword', 'UndefinedKeyword') AND k_left.kind = 'Identifier' AND x.flags & {T.ANY | T.UNKNOWN | T.NULL | T.UNDEFINED} = 0
  UNION ALL SELECT n.file, n.line, n.col, 'use the union''s mark' FROM {SIDES} JOIN node_types nt ON nt.file = n.file AND nt.node_id = k_right.node_id JOIN types t ON t.type_id = nt.type_id WHERE {binary('InKeyword')} AND k_left.kind = 'StringLiteral' AND len(t.members) > 1
    AND EXISTS (SELECT 1 FROM (SELECT m.type_id AS m, unnest(m.props) AS q FROM types m WHERE list_contains(t.members, m.type_id)) z JOIN types l ON l.type_id = z.q.id AND l.flags & 896 <> 0 GROUP BY z.q.name HAVING count(DISTINCT z.m) = len(t.members))
  UNION ALL SELECT n.file, n.line, n.col, 'name the union' FROM nodes n{PARENT} WHERE n.kind = 'UnionType' AND {count_of('literal')} >= 2 AND p.kind = 'Parameter'
  UNION ALL SELECT n.file, n.line, n.col, 'index signature beside names' FROM nodes n WHERE n.kind IN ('InterfaceDeclaration', 'TypeLiteral') AND (SELECT count(*) FILTER (c.kind = 'IndexSignature') > 0 AND count(*) FILTER (c.kind = 'PropertySignature') > 0 FROM nodes c WHERE c.file = n.file AND c.parent_id = n.node_id AND c.field = 'member')
  UNION ALL SELECT n.file, n.line, n.col, 'make the array readonly' FROM {children('type')} JOIN node_symbols y ON y.file = n.file AND y.node_id = n.node_id WHERE n.kind = 'Parameter' AND k_type.kind = 'ArrayType' AND NOT EXISTS (
    SELECT 1 FROM node_symbols z JOIN nodes i ON i.file = z.file AND i.node_id = z.node_id AND i.kind = 'Identifier' JOIN nodes q ON q.file = i.file AND q.node_id = i.parent_id AND q.kind = 'PropertyAccessExpression'
    WHERE z.file = n.file AND z.symbol_id = y.symbol_id AND split_part(q.text, '.', -1) IN {_in(H.MUTATING)})""",
}


def _clones(least: float, statements: int, below: float | None, ratio: float, marks: str, word: str) -> str:
    """Blocks with a partner in another file: all pairs are compared."""
    bound = f"j >= {least}" + (f" AND j < {below}" if below else "")
    shared = "len(list_filter(range(1, least(len(x.d), len(y.d)) + 1), lambda i: x.d[1:i] = y.d[1:i]))"
    return f"""WITH b AS (SELECT row_number() OVER () AS r, *, len(tokens) AS n, string_split(file, '/')[1:len(string_split(file, '/')) - 1] AS d, list_distinct(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS g
    FROM blocks WHERE stmt_count >= {statements} AND len(tokens) > 1),
  p AS (SELECT x.r, len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) AS j FROM b x JOIN b y ON x.file <> y.file
    WHERE least(x.n, y.n) >= {ratio} * greatest(x.n, y.n) AND NOT (len(x.d) - {shared} >= 2 AND len(y.d) - {shared} >= 2) AND {marks})
  SELECT file, line, 1, '{word}: ' || name FROM b WHERE r IN (SELECT r FROM p WHERE {bound})"""


BODIES |= {
    "syntactic-clone": _clones(0.92, 10, None, 0.6, "(len(x.receivers) = 0 OR len(y.receivers) = 0 OR list_has_any(x.receivers, y.receivers))", "copy"),
    "semantic-clone": _clones(0.80, 5, 0.92, 0.4, "x.signature = y.signature", "alike"),
}


def _name(rule: str) -> str:
    return f"rule_{rule.replace('-', '_')}"


def _query(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return CODE_RULES.only([rule]).diagnostics(relations(spark, CODE_RULES.rules[rule].needs))

    run.__doc__ = f"Findings of {rule} in the sample of code facts."
    return run


def _sql(rule: str) -> str:
    body = BODIES[rule]
    tables = ",\n".join(DERIVED[n][1] if n in DERIVED else _values(n) for n in _needed(body))
    subs = CODE_RULES.rules[rule].sub_ids
    named = " ".join(f"WHEN {'TRUE' if not m else f'message = {_literal(m)}'} THEN {_literal(i)}" for m, i in subs.items())
    sub_check = f"CASE {named} END" if subs else "CAST(NULL AS VARCHAR)"
    return f"""WITH RECURSIVE {tables}
SELECT '{rule}' AS rule, {sub_check} AS sub_check, CAST(file AS VARCHAR) AS file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column", message
FROM ({body}) found(file, line, col, message)"""


QUERIES = {_name(r): _query(r) for r in CODE_RULES.rules}
ORACLES = {_name(r): _sql(r) for r in CODE_RULES.rules if r in BODIES}

# --- extractors, switches, severities ---------------------------------------------------------------

TAGS = ["verifySession", "^load", "helper$", "(a+)+$", "^(", "insert"]
EXPORTED = f"""x AS (SELECT n.file, n.text AS name, n.line, CASE WHEN n.kind = 'FunctionDeclaration' THEN n.node_id ELSE k_initializer.node_id END AS fn FROM {children('initializer')}
  WHERE (n.kind = 'FunctionDeclaration' OR (n.kind = 'VariableDeclaration' AND k_initializer.kind IN ('ArrowFunction', 'FunctionExpression'))) AND EXISTS (SELECT 1 FROM exports e WHERE e.file = n.file AND e.name = n.text)),
inner_call AS (SELECT x.file, x.fn, c.* EXCLUDE (file) FROM x JOIN up u ON u.file = x.file AND u.anc = x.fn JOIN calls c ON c.file = u.file AND c.node_id = u.node_id)"""
#: Groups as a user may set them: opinions are off but one, and a part of react is switched off by an override.
GROUPS = [(0, "opinionated", "off", ["complexity", "performance:long-chain", "typescript:no-explicit-any", "typescript:no-non-null-assertion", "no-implicit-coercion:plus-coercion"]), (1, "strict", "error", ["typescript:no-explicit-any"])]
OVERRIDES = [(0, "react:nested-component", "off", None), (1, "no-implicit-coercion:string-concat", "off", ["coercion"]), (2, "syntax", "off", ["syn"]), (3, "zustand-patterns:multi-field-selector-without-shallow", "warning", None)]
SWITCHED = ("performance", "typescript", "no-implicit-coercion", "react", "syntax", "zustand-patterns", "state-hooks-cluster")


def _extract(sql: str, with_: str = "") -> str:
    body = with_ + " " + sql
    tables = ",\n".join(DERIVED[n][1] if n in DERIVED else _values(n) for n in _needed(body))
    return f"WITH RECURSIVE {tables}{', ' + with_ if with_ else ''}\n{sql}"


def _extracted(name: str, sql: str, with_: str = ""):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = run, _extract(sql, with_)
        return run

    return add


@_extracted("exported_functions", "SELECT file, name, CAST(line AS INTEGER) AS line, fn AS function_id FROM x", EXPORTED)
def exported_functions(spark, sf_dir):
    return extractors.exported_functions(relations(spark, ("nodes", "exports")))


@_extracted("function_tags", f"""SELECT x.file, x.name, array_to_string(list_filter({_literal(TAGS)}, lambda t: CASE t WHEN 'verifySession' THEN coalesce(list_contains(names, t), FALSE) WHEN 'insert' THEN coalesce(list_contains(names, t), FALSE)
  WHEN '^load' THEN coalesce(len(list_filter(names, lambda v: starts_with(v, 'load'))) > 0, FALSE) WHEN 'helper$' THEN coalesce(len(list_filter(names, lambda v: suffix(v, 'helper'))) > 0, FALSE) ELSE FALSE END), ',') AS tags,
  coalesce((SELECT string_agg(DISTINCT o.name, ',' ORDER BY o.name) FROM x o WHERE o.file = x.file AND o.name <> x.name AND list_contains(names, o.name)), '') AS calls_exports
FROM x LEFT JOIN (SELECT file, fn, list(DISTINCT name) AS names FROM inner_call GROUP BY ALL) c ON c.file = x.file AND c.fn = x.fn WHERE x.file IN {SERVER}""", EXPORTED)
def function_tags(spark, sf_dir):
    out = extractors.function_tags(relations(spark, ("nodes", "exports", "calls", "files")), TAGS, "use server")
    return out.withColumns({c: F.array_join(c, ",") for c in ("tags", "calls_exports")})


@_extracted("function_consumption", """SELECT x.file, x.name, CAST(x.line AS INTEGER) AS line, b.statements,
  coalesce((SELECT string_agg(DISTINCT s.decl_file || '::' || s.name, ',' ORDER BY s.decl_file || '::' || s.name) FROM inner_call c JOIN symbols s ON s.symbol_id = c.target_symbol WHERE c.file = x.file AND c.fn = x.fn AND NOT contains(s.decl_file, 'node_modules')), '') AS targets,
  coalesce((SELECT string_agg(DISTINCT s.name, ',' ORDER BY s.name) FROM inner_call c JOIN nodes a ON a.file = c.file AND a.parent_id = c.node_id AND a.field = 'argument' JOIN node_symbols y ON y.file = a.file AND y.node_id = a.node_id JOIN symbols s ON s.symbol_id = y.symbol_id
    WHERE c.file = x.file AND c.fn = x.fn AND c.name IN ('from', 'insert', 'update', 'delete') AND len(c.chain) > 1), '') AS tables,
  CASE WHEN h < 0 THEN '-' ELSE '' END || (SELECT string_agg(substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(abs(h) // CAST(36 ** i AS BIGINT) % 36 AS INTEGER) + 1, 1), '' ORDER BY i DESC) FROM range(7) r(i) WHERE i = 0 OR abs(h) >= CAST(36 ** i AS BIGINT)) AS body_hash
FROM x JOIN (SELECT file, parent_id, count(*) AS statements, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY ord), '[a-zA-Z_$][a-zA-Z0-9_$]*', '$', 'g'), '"[^"]*"', '$S', 'g'), '''[^'']*''', '$S', 'g'), '`[^`]*`', '$T', 'g'), '\\b\\d+\\.?\\d*\\b', '$N', 'g'), '\\s+', ' ', 'g'),
    ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h
  FROM nodes WHERE field = 'statement' GROUP BY ALL HAVING count(*) >= 3) b ON b.file = x.file AND b.parent_id = x.fn""", EXPORTED)
def function_consumption(spark, sf_dir):
    out = extractors.consumption(relations(spark, ("nodes", "exports", "calls", "symbols", "node_symbols")))
    return out.withColumns({c: F.array_join(c, ",") for c in ("targets", "tables")})


@_extracted("type_declarations", f"""SELECT n.file, CASE n.kind WHEN 'EnumDeclaration' THEN 'enum' WHEN 'InterfaceDeclaration' THEN 'interface' ELSE 'type-alias' END AS kind, n.text AS name, CAST(n.line AS INTEGER) AS line, x.name IS NOT NULL AS exported, m.members
FROM nodes n JOIN (SELECT c.file, c.parent_id, string_agg(c.text || ': ' || coalesce(nullif(v.text, ''), 'unknown'), ',' ORDER BY c.ord) AS members FROM nodes c LEFT JOIN nodes v ON v.file = c.file AND v.parent_id = c.node_id AND v.field = 'value'
    WHERE c.field = 'member' AND c.kind <> 'IndexSignature' AND NOT (c.kind = 'EnumMember' AND v.kind IS NULL) GROUP BY ALL) m ON m.file = n.file AND m.parent_id = n.node_id
LEFT JOIN (SELECT DISTINCT file, name FROM exports) x ON x.file = n.file AND x.name = n.text WHERE n.kind IN ('EnumDeclaration', 'InterfaceDeclaration', 'TypeAliasDeclaration')
UNION ALL SELECT n.file, 'constant', n.text, CAST(n.line AS INTEGER), TRUE, n.text || ': ' || k_initializer.text FROM {children('initializer')} JOIN (SELECT DISTINCT file, name FROM exports) x ON x.file = n.file AND x.name = n.text
  WHERE n.kind = 'VariableDeclaration' AND k_initializer.kind IN ('StringLiteral', 'NumericLiteral')""")
def type_declarations(spark, sf_dir):
    return extractors.declarations(relations(spark, ("nodes", "exports"))).withColumn("members", F.array_join("members", ","))


@_extracted("gap_items", """SELECT name AS action, file, issue, severity, fix_hint, CAST(rank AS INTEGER) AS rank FROM x JOIN (SELECT file AS f, fn AS g, list(DISTINCT name) AS names FROM inner_call GROUP BY ALL) c ON c.f = x.file AND c.g = x.fn,
LATERAL (SELECT 'no check of the session' AS issue, 'critical' AS severity, 'call verifySession' AS fix_hint, 0 AS rank WHERE NOT list_contains(names, 'verifySession') UNION ALL SELECT 'writes: ' || name, 'low', 'validate', 3 WHERE list_contains(names, 'insert'))""", EXPORTED)
def gap_items(spark, sf_dir):
    facts = relations(spark, ("nodes", "exports", "calls"))
    functions = extractors.exported_functions(facts)
    called = extractors.calls_inside(facts, functions).groupBy("file", "function_id").agg(F.collect_set("name").alias("names"))
    rules_ = [(~F.array_contains("names", "verifySession"), "no check of the session", "critical", "call verifySession"), (F.array_contains("names", "insert"), F.concat(F.lit("writes: "), "name"), "low", "validate")]
    return extractors.gaps(functions.join(called, ["file", "function_id"]), rules_, F.col("name"), F.col("file"))


def sub_check_switches(spark, sf_dir):
    """Findings of rules with parts, less what groups and overrides switch off."""
    needs = tuple(sorted({n for r in SWITCHED for n in CODE_RULES.rules[r].needs}))
    groups = spark.createDataFrame(GROUPS, "ord int, id string, severity string, rules array<string>")
    overrides = spark.createDataFrame(OVERRIDES, "ord int, rule string, severity string, files array<string>")
    found = CODE_RULES.only(SWITCHED).diagnostics(relations(spark, needs))
    return rules.without_parts(rules.without_disabled(found, overrides), overrides, groups).groupBy("rule", "sub_check").agg(F.count("*").alias("n"))


QUERIES["sub_check_switches"] = sub_check_switches
ORACLES["sub_check_switches"] = "WITH all_found AS (" + " UNION ALL ".join(f"SELECT * FROM ({_sql(r)})" for r in SWITCHED) + """)
SELECT rule, sub_check, count(*) AS n FROM all_found WHERE coalesce(sub_check, '') NOT IN ('long-chain', 'no-explicit-any', 'no-non-null-assertion', 'plus-coercion', 'nested-component')
AND NOT (coalesce(sub_check, '') = 'string-concat' AND contains(file, 'coercion')) AND NOT (rule = 'syntax' AND contains(file, 'syn')) GROUP BY ALL"""
