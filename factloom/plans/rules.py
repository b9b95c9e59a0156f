"""Rules as data: a registry of DataFrame-valued checks, severities as joins, one diagnostics relation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

CATEGORIES = ("quality", "security", "architecture", "performance")
DIAGNOSTIC = "rule string, sub_check string, file string, line int, column int, message string"
Facts = dict[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    description: str
    check: Callable[[Facts, dict], DataFrame]
    sub_checks: int = 1
    severity: str | None = None
    needs: tuple[str, ...] = ()
    #: Ids of parts that can be switched by themselves, by the message of their findings ("": all of the rule's).
    sub_ids: Mapping[str, str] = field(default_factory=dict)

    def located(self, facts: Facts, options: dict) -> DataFrame:
        """Findings with the number of their node (node_id), null where the check names none."""
        found = self.check(facts, options)
        return found if "node_id" in found.columns else found.withColumn("node_id", F.lit(None).cast("long"))

    def run(self, facts: Facts, options: dict) -> DataFrame:
        found = self.check(facts, options).withColumn("rule", F.lit(self.id))
        named = F.lit(None).cast("string")
        for message, part in reversed(self.sub_ids.items()):
            named = F.when(F.col("message") == message, part).otherwise(named) if message else F.lit(part)
        return found.withColumn("sub_check", named).select("rule", "sub_check", "file", "line", "column", "message")


class Registry:
    """Rules by id; a later rule of the same id replaces the earlier one. Extractors register alike."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self.rules = {r.id: r for r in rules}

    def rule(self, id: str, category: str, description: str, sub_checks: int = 1, severity: str | None = None, needs: tuple[str, ...] = (), sub_ids: Mapping[str, str] | None = None):
        if category not in CATEGORIES:
            raise ValueError(f"{category} is no category")

        def add(check):
            self.rules[id] = Rule(id, category, description, check, sub_checks, severity, needs, sub_ids or {})
            return check

        return add

    def only(self, ids: Iterable[str]) -> Registry:
        unknown = set(ids) - set(self.rules)
        if unknown:
            raise KeyError(f"unknown rules: {sorted(unknown)}")
        return Registry(r for r in self.rules.values() if r.id in set(ids))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, r.id, r.category, r.description, r.sub_checks, r.severity) for i, r in enumerate(self.rules.values())], "rule_ord int, rule string, category string, description string, sub_checks int, meta_severity string")

    def diagnostics(self, facts: Facts, options: dict | None = None) -> DataFrame:
        """All findings of the rules whose relations are there (``unable`` names the others). Rules are never multiplied by
        files: each is a query of its own."""
        able = [r for r in self.rules.values() if set(r.needs) <= set(facts)]
        if not able:
            raise ValueError(f"no rule can work on {sorted(facts)}")
        return reduce(DataFrame.unionByName, [r.run(facts, (options or {}).get(r.id, {})) for r in able])

    def unable(self, facts: Iterable[str]) -> dict[str, list[str]]:
        """Rules that ``diagnostics`` leaves out of these facts, with the relations they lack."""
        missing = {r.id: sorted(set(r.needs) - set(facts)) for r in self.rules.values()}
        return {i: m for i, m in missing.items() if m}


def merged_groups(groups: DataFrame) -> DataFrame:
    """(id, severity, rules) of (ord, id, severity, rules): a later group of the same id gives its severity, and its members
    if it has any."""
    w = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord")))
    named = groups.withColumn("rules", F.when(F.size("rules") > 0, F.col("rules")))
    return named.select("id", "ord", F.last("severity", True).over(w).alias("severity"), F.last("rules", True).over(w).alias("rules"), last.alias("k")).where("k = 1").drop("k")


def severities(rules: DataFrame, overrides: DataFrame, groups: DataFrame, default: str = "error") -> DataFrame:
    """(rule, severity) of active rules: override, then the rule's own, then the last group that has it, then the default;
    ``off`` rules go. Overrides that name files don't count here: they only switch off, file by file."""
    own = overrides.where(F.col("files").isNull()).groupBy("rule").agg(F.max(F.struct("ord", "severity")).getField("severity").alias("by_override"))
    member = merged_groups(groups).select("ord", "severity", F.explode("rules").alias("rule"))
    grouped = member.groupBy("rule").agg(F.max(F.struct("ord", "severity")).getField("severity").alias("by_group"))
    joined = rules.join(own, "rule", "left").join(grouped, "rule", "left")
    return joined.withColumn("severity", F.coalesce("by_override", "meta_severity", "by_group", F.lit(default))).where("severity <> 'off'").select("rule", "severity")


def without_disabled(found: DataFrame, overrides: DataFrame, most_broadcast: int = 1_000) -> DataFrame:
    """Findings but those that an override with files switches off: the file's path contains one of its texts. An id is
    a rule's, or rule:part for a part of it.

    Up to ``most_broadcast`` texts, which are counted, are compared with each finding. More are looked for once in each
    path, by a substring join, and findings meet what was found by equality."""
    off = overrides.where((F.col("severity") == "off") & F.col("files").isNotNull()).select(F.col("rule").alias("off_rule"), F.explode("files").alias("part"))
    ids = [F.col("rule")] + ([F.concat_ws(":", "rule", "sub_check")] if "sub_check" in found.columns else [])
    if off.limit(most_broadcast + 1).count() <= most_broadcast:
        same = reduce(Column.__or__, [i == F.col("off_rule") for i in ids])
        return found.join(F.broadcast(off), same & F.col("file").contains(F.col("part")), "left_anti")
    from ..operators.substrings import containing  # the operators import this module

    met = containing(found.select("file").distinct(), "file", "file", off, "part").withColumnsRenamed({"file": "off_file", "pattern": "part"})
    switched = written(met.join(off, "part").select("off_file", "off_rule").distinct(), "disabled")
    return reduce(lambda left, i: left.join(switched, (F.col("file") == F.col("off_file")) & (i == F.col("off_rule")), "left_anti"), ids, found)


def disabled_parts(overrides: DataFrame, groups: DataFrame) -> DataFrame:
    """(id) of rule:part ids that are off everywhere: by a group that is off, or by an override that names no files."""
    by_group = merged_groups(groups).where("severity = 'off'").select(F.explode("rules").alias("id"))
    by_override = overrides.where((F.col("severity") == "off") & (F.col("files").isNull() | (F.size("files") == 0))).select(F.col("rule").alias("id"))
    return by_group.union(by_override).where(F.col("id").contains(":")).distinct()


def without_parts(found: DataFrame, overrides: DataFrame, groups: DataFrame) -> DataFrame:
    """Findings but those of parts that are off everywhere. An override can't switch on what a group has off."""
    off = F.broadcast(disabled_parts(overrides, groups))  # as many as the configuration names
    return found.join(off, F.concat_ws(":", "rule", "sub_check") == F.col("id"), "left_anti")


def lines_over(text: Column, most: int) -> Column:
    return F.size(F.split(text, "\n", -1)) > most
