"""Trees in relations: documents of tags as nodes, and structural equality of subtrees by hashes from the leaves up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch_path, written

#: Elements that never have children.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: A comment or declaration, a tag, or a stretch of text; "<" without ">" is text.
TOKEN = r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<"
BLANKS = r"[\x20\x09-\x0D]+"


def markup_nodes(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, node, depth, parent, place, label_1, label_2, tag) of every element and text of a markup column.

    ``node`` is the number of the token, ``depth`` a running sum (an opening tag adds one for what follows, a closing
    one takes it back), ``parent`` the last element before that is open one level up (null at the top), ``place`` the
    rank among its siblings. Labels are two hashes of kind and content: of an opening tag with its blanks folded, or
    of a text with its blanks folded; comments, declarations and blank texts are no nodes. Closing tags are taken by
    depth, not by name, so that text in disorder still gives one tree. ``tag`` is the element's name in lower case,
    null for text. Texts leave the scan as hashes: no text is shuffled.
    """
    token = F.col("token")
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
    closes = token.startswith("</")
    kind = F.when(~token.startswith("<") | (token == "<"), "text").when(name == "", "none").when(closes, "close").otherwise("open")
    flat = F.btrim(F.regexp_replace(token, BLANKS, " "))
    tokens = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(TOKEN), F.lit(0))).alias("node", "token"))
    tokens = tokens.select(
        key, "node", kind.alias("kind"), F.when(kind == "open", name).alias("tag"), (F.lit(kind == "open") & (name.isin(*VOID) | token.endswith("/>"))).alias("leaf"),
        flat.alias("flat")).where("kind <> 'none' AND NOT (kind = 'text' AND flat = '')")
    step = F.when((F.col("kind") == "open") & ~F.col("leaf"), 1).when(F.col("kind") == "close", -1).otherwise(0)
    labels = [F.xxhash64(F.lit(salt), "kind", "flat").alias(f"label_{salt}") for salt in (1, 2)]
    hashed = tokens.select(key, "node", "kind", "tag", "leaf", step.alias("step"), *labels)
    before = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    deep = hashed.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)).cast("int")).where("kind <> 'close'")
    # an element open at a level is met there by what comes one level down: one ordered pass over both
    level = deep.select("*", F.explode(F.when((F.col("kind") == "open") & ~F.col("leaf"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("as_child"))
    level = level.withColumn("level", F.col("depth") - F.col("as_child"))
    last_open = Window.partitionBy(key, "level").orderBy("node", "as_child").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("as_child") == 0, F.col("node")), ignorenulls=True).over(last_open)
    placed = level.withColumn("parent", parent).where("as_child = 1")
    siblings = Window.partitionBy(key, "parent").orderBy("node")
    return placed.select(key, "node", "depth", "parent", F.row_number().over(siblings).alias("place"), "label_1", "label_2", "tag")


def _folded(child: list[str]) -> list[Column]:
    """Children in order as one hash: each with its place, so that they can be combined in any order and in parts."""
    return [F.bit_xor(F.xxhash64(F.lit(salt), *child, "place")).alias(f"below_{salt}") for salt in (1, 2)]


def subtree_hashes(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node, hash_1, hash_2, size) of every node of trees given as (key, node, depth, parent, place, label_1,
    label_2): subtrees are equal in structure if both hashes are.

    From the deepest level up: a node's hash is of its label and of its children's hashes with their places, which are
    combined before they are shuffled, so a node of very many children is no large group. Each round reads one level,
    laid out by depth, and the hashes of the level below. A node's depth must be its parent's plus one.
    """
    spark = nodes.sparkSession
    place = scratch_path(spark, "tree-levels")
    laid = nodes.select(key, "node", "parent", "place", "label_1", "label_2", "depth")
    laid.write.partitionBy("depth").parquet(place)
    levels = spark.read.schema(laid.schema).parquet(place)
    depths = sorted((r["depth"] for r in levels.select("depth").distinct().collect()), reverse=True)  # as many as rounds
    done = below = None
    for depth in depths:
        here = levels.where(F.col("depth") == depth).drop("depth")
        if below is not None:
            inner = below.where("parent IS NOT NULL").groupBy(key, F.col("parent").alias("node")).agg(*_folded(["hash_1", "hash_2"]), F.sum("size").alias("inside"))
            here = here.join(inner, [key, "node"], "left")
        else:
            here = here.withColumns({"below_1": F.lit(None).cast("long"), "below_2": F.lit(None).cast("long"), "inside": F.lit(None).cast("long")})
        hashes = {f"hash_{salt}": F.xxhash64(F.lit(salt), "label_1", "label_2", "below_1", "below_2", F.coalesce("inside", F.lit(0))) for salt in (1, 2)}
        below = written(here.select(key, "node", "parent", "place", (F.coalesce("inside", F.lit(0)) + 1).alias("size"), *[v.alias(k) for k, v in hashes.items()]), "tree-hashes")
        done = below if done is None else done.unionByName(below)
    remove(spark, place)
    if done is None:
        return nodes.select(key, "node", F.lit(0).cast("long").alias("hash_1"), F.lit(0).cast("long").alias("hash_2"), F.lit(0).cast("long").alias("size"))
    return done.select(key, "node", "hash_1", "hash_2", "size")


def equal_subtrees(pages: DataFrame, key: str, markup: str, least: int = 3) -> DataFrame:
    """(tag, size, pages, occurrences, first_page, first_node): elements whose whole subtree, down to the texts, stands in
    ``least`` documents or more; one row for each class of equal subtrees."""
    nodes = written(markup_nodes(pages, key, markup), "tree-nodes")
    hashed = subtree_hashes(nodes, key).join(nodes.select(key, "node", "tag"), [key, "node"]).where("tag IS NOT NULL")
    by_page = hashed.groupBy("hash_1", "hash_2", key).agg(F.first("tag").alias("tag"), F.first("size").alias("size"), F.count("*").alias("n"), F.min("node").alias("first"))
    classes = by_page.groupBy("hash_1", "hash_2").agg(
        F.first("tag").alias("tag"), F.first("size").alias("size"), F.count("*").alias("pages"), F.sum("n").alias("occurrences"), F.min(F.struct(key, "first")).alias("at"))
    return classes.where(F.col("pages") >= least).select("tag", "size", "pages", "occurrences", F.col(f"at.{key}").alias("first_page"), F.col("at.first").alias("first_node"))
