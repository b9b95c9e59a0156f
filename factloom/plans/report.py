"""Report aggregates over the diagnostics relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape, percent
from ..sources.scratch import written


def by_rule(found: DataFrame) -> DataFrame:
    """Findings of each rule, and whether they are all warnings."""
    return found.groupBy("rule").agg(F.count("*").alias("n"), (~F.bool_or(F.col("severity") == "error")).alias("warning_only"))


def by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.array_sort(F.collect_set("rule")).alias("rules"))


def totals(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Errors, warnings, checks of the rules and, if findings carry edits (``fix``), how many can be fixed."""
    counted = found.agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), *([F.count_if(F.size("fix") > 0).alias("fixable")] if "fix" in found.columns else []))
    checks = rules.agg(F.coalesce(F.sum(F.coalesce("sub_checks", F.lit(1))), F.lit(0)).alias("sub_checks"))
    return counted.join(F.broadcast(checks))  # one row beside one row


def evaluated(found: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(findings, counts): the findings, evaluated once and written for all reports, and findings, errors and warnings as
    they were counted while they were written."""
    seen, of = Observation(), lambda level: F.count_if(F.col("severity") == level)
    counted = found.observe(seen, F.count(F.lit(1)).alias("findings"), of("error").alias("errors"), of("warning").alias("warnings"))
    return written(counted, "findings"), seen.get


def all_counts(found: DataFrame) -> DataFrame:
    """(level, key, n, errors, warnings) by rule, by file, by category and of all together, in one pass."""
    levels = ["rule", "file", "category"]
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == v).alias(f"{v}s") for v in ("error", "warning")]]
    level = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in levels], F.lit("all"))
    every = found.groupingSets([[c] for c in levels] + [[]], *levels).agg(*counts, level.alias("level"))
    key = F.coalesce(*[F.when(F.col("level") == c, F.col(c)) for c in levels])
    return every.select("level", key.alias("key"), "n", "errors", "warnings")


def _with_files(rows: DataFrame, files: int | DataFrame) -> DataFrame:
    """With the number of files: given, or the rows of a table, counted with the query."""
    if isinstance(files, int):
        return rows.withColumn("files", F.lit(files))
    return rows.join(F.broadcast(files.agg(F.count(F.lit(1)).alias("files"))))  # one row


def category_scores(found: DataFrame, rules: DataFrame, files: int | DataFrame) -> DataFrame:
    """Of each category of the rules, the share of files without an error in it."""
    bad = found.where("severity = 'error'").join(F.broadcast(rules.select("rule", "category")), "rule").groupBy("category").agg(F.count_distinct("file").alias("bad"))
    clean = F.col("files") - F.coalesce("bad", F.lit(0))
    known = _with_files(rules.select("category").distinct().join(bad, "category", "left"), files)
    return known.select("category", clean.alias("clean"), percent(clean, F.col("files")).alias("pct"))


def clean_score(found: DataFrame, files: int | DataFrame) -> DataFrame:
    bad = _with_files(found.where("severity = 'error'").agg(F.count_distinct("file").alias("bad")), files)
    return bad.select((F.col("files") - F.col("bad")).alias("clean"), percent(F.col("files") - F.col("bad"), F.col("files")).alias("pct"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sum and percentage of the whole, to one decimal; the whole is summed over the groups."""
    totals = rows.groupBy(key).agg(F.sum(value).alias("total"))
    whole = F.broadcast(totals.agg(F.sum("total").alias("whole")))  # one row
    return totals.join(whole).withColumn("pct", F.round(100.0 * F.col("total") / F.col("whole"), 1)).drop("whole")


def bars(rows: DataFrame, value: str, width: int = 66) -> DataFrame:
    longest = F.broadcast(rows.agg(F.max(value).alias("longest")))  # one row
    return rows.join(longest).withColumn("bar", F.round(F.col(value) / F.col("longest") * width).cast("long")).drop("longest")


def issue_groups(rows: DataFrame, issue: str, mark: str = "—") -> DataFrame:
    """Rows by the text before the mark, and a row for all of them together."""
    key = F.trim(F.split_part(F.col(issue), F.lit(mark), F.lit(1)))
    return rows.withColumn("issue_key", key).rollup("issue_key").agg(F.count("*").alias("n"), F.grouping("issue_key").cast("int").alias("is_all"))


def histogram(rows: DataFrame, key: str, buckets: list[str]) -> DataFrame:
    """Counts in fixed buckets, zeros included."""
    fixed = rows.sparkSession.createDataFrame(list(enumerate(buckets)), f"ord int, {key} string")
    return fixed.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def route(path: Column, parts: int = 3) -> Column:
    """The last directories of a path, at most ``parts``."""
    folders = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda p: p != "")
    return F.array_join(F.when(F.size(folders) > parts, F.slice(folders, -parts, parts)).otherwise(folders), "/")


def as_lines(found: DataFrame) -> DataFrame:
    """One line a finding, for ``write.text``."""
    return found.select(F.format_string("%s:%d:%d %s %s %s", "file", "line", "column", "severity", "rule", "message").alias("value"))


def as_json(found: DataFrame) -> DataFrame:
    """One object a finding, for ``write.text``."""
    return found.select(F.to_json(F.struct("rule", "severity", "file", "line", "column", "message")).alias("value"))


def json_head(found: DataFrame, rules: DataFrame, files: int | DataFrame) -> DataFrame:
    """One object with the counts of a report: files, rules, checks, errors, warnings."""
    counts = _with_files(totals(found, rules).join(F.broadcast(rules.agg(F.count("*").alias("n")))), files)
    return counts.select(F.to_json(F.struct("files", F.col("n").alias("rules"), F.col("sub_checks").alias("checks"), "errors", "warnings")).alias("value"))


def as_html(found: DataFrame) -> DataFrame:
    """Rows of a table, one a finding, texts escaped."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.col(c).cast("string")), F.lit("</td>")) for c in ("severity", "rule", "file", "line", "column", "message")]
    return found.select(F.concat(F.lit('<tr class="'), html_escape(F.col("severity")), F.lit('">'), *cells, F.lit("</tr>")).alias("value"))


def spilled(found: DataFrame, folder: str, most: int = 300) -> DataFrame | None:
    """The findings as JSON lines if there are fewer than ``most``; else they are written to the folder, task by task, and
    nothing is returned. Only ``most`` rows are looked at to decide."""
    if most > 0 and found.limit(most).count() >= most:
        as_json(found).write.text(folder)
        return None
    return as_json(found)
