"""Rule packs: folders of rule files, and a table function that applies them from SQL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .rules import CATEGORIES


@dataclass(frozen=True)
class TextRule:
    """A rule that looks at one text: ``check(text)`` in its file gives (offset, message) pairs."""

    id: str
    category: str
    severity: str | None
    description: str
    source: str


def _loaded(source: str, name: str) -> dict:
    space: dict = {"__name__": name}
    exec(compile(source, name, "exec"), space)  # noqa: S102  rule files are code, loaded as any module is
    return space


def pack(*folders: str | Path) -> dict[str, TextRule]:
    """Rules by id of all ``*.py`` files of the folders. A file's name is its rule's id; of one id, the last folder's
    counts. Files that begin with ``_`` are not rules. A file sets CATEGORY, may set SEVERITY, and defines ``check``;
    its docstring describes the rule. A file that doesn't is an error that names it."""
    found = {}
    for folder in folders:
        for file in sorted(Path(folder).glob("*.py")):
            if file.name.startswith("_"):
                continue
            source = file.read_text()
            space = _loaded(source, str(file))
            if not callable(space.get("check")):
                raise ValueError(f"{file} defines no check")
            if space.get("CATEGORY") not in CATEGORIES:
                raise ValueError(f"{file}: {space.get('CATEGORY')} is no category")
            found[file.stem] = TextRule(file.stem, space["CATEGORY"], space.get("SEVERITY"), (space.get("__doc__") or "").strip(), source)
    return found


def table_function(rules: dict[str, TextRule]) -> type:
    """The class of a table function over the rules, for ``spark.udtf.register``: ``findings(text)`` gives (rule, line,
    column, message) of all rules, ``findings(text, 'id')`` of one and without its name; an unknown id fails while the
    query is planned. Rules travel as their sources and are loaded once a task."""
    sources = {r.id: r.source for r in rules.values()}

    class Findings:
        @staticmethod
        def analyze(text: AnalyzeArgument, rule: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError(f"findings looks at texts, not at {text.dataType.simpleString()}")
            if rule is not None and not (rule.isConstantExpression and rule.value in sources):
                raise ValueError(f"no such rule: {rule.value if rule.isConstantExpression else 'not a constant'}; there are {', '.join(sorted(sources))}")
            fields = [StructField("line", IntegerType()), StructField("column", IntegerType()), StructField("message", StringType())]
            return AnalyzeResult(schema=StructType(fields if rule is not None else [StructField("rule", StringType()), *fields]))

        def __init__(self):
            self.checks = {}

        def eval(self, text: str | None, rule: str | None = None) -> Iterator[tuple]:
            for name in [rule] if rule is not None else sorted(sources):
                if name not in self.checks:
                    self.checks[name] = _loaded(sources[name], name)["check"]
                for offset, message in self.checks[name](text) if text else ():
                    line, begin = text.count("\n", 0, offset) + 1, text.rfind("\n", 0, offset) + 1
                    yield (*(() if rule is not None else (name,)), line, offset - begin + 1, message)

    return Findings


def grouped_counts(least: int = 1) -> type:
    """The class of a table function over a whole relation: ``counts(TABLE(t) PARTITION BY k)`` gives each group's key and
    number of rows if it is ``least`` or more. Its schema follows the key's; a group streams through and is never held."""

    class Counts:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(rows.dataType, StructType):
                raise ValueError("counts looks at a table")
            first = rows.dataType.fields[0]
            return AnalyzeResult(schema=StructType([StructField(first.name, first.dataType), StructField("n", LongType())]))

        def __init__(self):
            self.key, self.n = None, 0

        def eval(self, row) -> None:
            self.key, self.n = row[0], self.n + 1

        def terminate(self) -> Iterator[tuple]:
            if self.n >= least:
                yield self.key, self.n

    return Counts


def register(spark: SparkSession, rules: dict[str, TextRule], name: str = "findings") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(table_function(rules)))


def checked(spark: SparkSession, rules: dict[str, TextRule], rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a row for each finding in their text, without the text."""
    register(spark, rules)
    kept = ", ".join(f"r.`{c}`" for c in rows.columns if c != text)
    return spark.sql(f"SELECT {kept}, f.* FROM {{rows}} r, LATERAL findings(r.`{text}`) f", rows=rows)
