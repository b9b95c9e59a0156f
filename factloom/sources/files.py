"""File scans as DataFrames: full, changed since a snapshot, by extension and ignore patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "file string, ext string, bytes long, content string, is_decl boolean, directive string"
MOST_BYTES = 500_000


def ignore_regex(pattern: str) -> str:
    """A gitignore pattern, without its negation, as a regular expression over one entry: a file's path, or a folder's path with
    a slash at its end. A backslash takes the next character as it is; [abc], [a-c] and [!abc] are classes."""
    rooted = "/" in pattern.rstrip("/")
    body, out, i = pattern.removeprefix("/").rstrip("/"), "", 0
    while i < len(body):
        close = body.find("]", i + 2) if body[i] == "[" else -1
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif close > 0:
            inner = body[i + 1 : close]
            negated = inner[0] in "!^"
            out, i = f"{out}[{'^/' if negated else ''}{re.sub(r'([\\\\^&[])', r'\\\\\\1', inner[negated:])}]", close + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if rooted else '(?:.*/)?'}{out}{'/' if pattern.endswith('/') else '/?'}$"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path is ignored. Of each entry on the way to it, folder by folder, the last pattern that matches decides, ``!``
    takes back; what lies in an ignored folder can't be taken back."""

    def decided(entry: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            p = re.sub(r"(?<!\\)[ \t]+$", "", p)
            if p and not p.startswith("#"):
                out = F.when(entry.rlike(ignore_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(out)
        return out

    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, F.exists(folders, decided)).otherwise(F.lit(False)) | decided(path)


def extension(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def scan(spark: SparkSession, folder: str, extensions: Sequence[str], patterns: Sequence[str] = (), most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """All files of a folder tree with one of the extensions that are not ignored and not too long. Contents are read
    only of those: size, name and path are known before."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_replace("path", f"^.*?{re.escape(folder.removeprefix('file:').rstrip('/'))}/", "")
    rows = found.withColumn("file", name).where(extension(F.col("file")).isin(*extensions) & ~ignored(F.col("file"), patterns))
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    text = F.decode("content", "UTF-8")
    directive = F.regexp_extract(text, r"""^\s*["'](use [a-z]+)["']""", 1)
    return rows.select("file", extension(F.col("file")).alias("ext"), F.col("length").alias("bytes"), text.alias("content"), F.col("file").endswith(".d.ts").alias("is_decl"), F.when(directive != "", directive).alias("directive"))


def changed(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed or modified between two snapshots, by a hash of the content."""
    h = lambda df, name: df.select(key, F.sha2(F.col(content).cast("string").cast("binary"), 256).alias(name))
    joined = h(before, "old").join(h(after, "new"), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return joined.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified").alias("change"))


def together(*scans: DataFrame) -> DataFrame:
    """Paths of several scans, each once."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.distinct()


def branch(changes: DataFrame, current: DataFrame, key: str = "file") -> DataFrame:
    """Paths that a branch changed and that are still there."""
    return changes.select(key).distinct().join(current.select(key), key, "left_semi")


def listed(files: DataFrame, paths: DataFrame, folders: Sequence[str] = (), extensions: Sequence[str] = (), patterns: Sequence[str] = (), key: str = "file") -> DataFrame:
    """Files by name, and all files in some folders that have one of the extensions and are not ignored, each once."""
    named = files.join(paths.select(key).distinct(), key, "left_semi")
    if not folders:
        return named
    inside = F.lit(False)
    for folder in folders:
        inside |= F.col(key).startswith(folder.rstrip("/") + "/")
    return named.unionByName(files.where(inside & extension(F.col(key)).isin(*extensions) & ~ignored(F.col(key), patterns))).dropDuplicates([key])
