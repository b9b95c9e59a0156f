"""Schemas of the code-fact relations, and a reader of facts that another tool has written as Parquet.

A node's field is its role in its parent (left, right, operator, expression, condition, initializer, argument, statement,
branch, else, member, name, type), ord its place among those of the role; its text is a name, a literal's value, or the
source. A call's chain holds the names from the root to the called one. Edges of def_use run also from the parts of an
expression to the whole. Types of unions and intersections list their members;
a function's own type in node_types is what it returns. contexts has the type that a node's place expects. A block's
receivers are the types whose methods it calls, its signature (exported functions with parameters only) a text that equal
parameters and results share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "files": "file string, ext string, bytes long, content string, is_decl boolean, directive string",
    "nodes": "file string, node_id long, parent_id long, kind string, field string, ord int, depth int, start int, end int, line int, col int, text string, ancestors array<struct<id:long,kind:string>>",
    "symbols": "symbol_id long, name string, flags long, decl_file string, decl_pos int, origin string, tags array<string>",
    "types": "type_id long, flags long, shape string, members array<long>, props array<struct<name:string,type_id:long>>, is_thenable boolean, own_to_string boolean",
    "assignable": "src_type long, dst_type long",
    "exports": "file string, name string, symbol string",
    "import_edges": "src string, dst string, specifier string, line int, type_only boolean, is_dynamic boolean, external boolean",
    "node_types": "file string, node_id long, type_id long",
    "contexts": "file string, node_id long, type_id long",
    "node_symbols": "file string, node_id long, symbol_id long",
    "class_bases": "symbol_id long, base_id long",
    "blocks": "file string, name string, line int, stmt_count int, tokens array<string>, receivers array<string>, signature string",
    "calls": "file string, node_id long, caller_id long, target_symbol long, name string, chain array<string>",
    "def_use": "file string, use_node long, def_node long, def_kind string",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A relation with its fixed schema; columns are pruned and filters pushed to the files."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
