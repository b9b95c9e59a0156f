"""Results kept by content: a manifest of hashes says what is still right, and only what changed is computed again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import children, remove, written


@dataclass(frozen=True)
class Update:
    """Of a run: its generation, keys taken over, keys computed, keys gone, and the rows that the computation read."""

    generation: int
    kept: int
    computed: int
    gone: int
    rows_read: int


class ResultStore:
    """Results of a computation that looks at one key at a time, in a folder that driver and executors share.

    ``parts/part=<id>`` holds the results that a run has computed. ``manifest/generation=<n>`` holds (key, hash_1, hash_2,
    part) of every key of a run, those without results too: the part in which its results are. A generation counts once
    Spark's committer has marked it as complete, which it does last: a run that breaks off before leaves the state as it
    was, and its part unread; a reader sees one generation or the next. Two runs at once can't both write the same one.
    Null keys take no part. Rows of one key count together: its hash is that of all of them in any order.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, key_type: str, results: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.manifest_schema = f"`{key}` {key_type}, hash_1 string, hash_2 string, part string"
        self.part_schema = f"`{key}` {key_type}, {results}, part string"

    def generation(self) -> int:
        """The last complete generation; 0 before the first."""
        found = [int(p.rpartition("=")[2]) for p in children(self.spark, f"{self.folder}/manifest") if "generation=" in p and f"{p}/_SUCCESS" in children(self.spark, p)]
        return max(found, default=0)

    def manifest(self, generation: int | None = None) -> DataFrame:
        n = self.generation() if generation is None else generation
        return self.spark.read.schema(self.manifest_schema).parquet(f"{self.folder}/manifest/generation={n}") if n else self.spark.createDataFrame([], self.manifest_schema)

    def results(self) -> DataFrame:
        """All results of the last generation, with the part they come from."""
        now = self.manifest()
        parts = [r["part"] for r in now.select("part").distinct().collect()]  # one a run since the last ``compact``
        if not parts:
            return self.spark.createDataFrame([], self.part_schema)
        held = self.spark.read.schema(self.part_schema).parquet(f"{self.folder}/parts").where(F.col("part").isin(parts))
        return held.join(now.select(self.key, "part"), [self.key, "part"], "left_semi").select(*[f.split()[0].strip("`") for f in self.part_schema.split(", ")])

    def update(self, rows: DataFrame, content: list[str], compute: Callable[[DataFrame], DataFrame]) -> Update:
        """Brings the results up to ``rows``: ``compute`` gets the rows of keys that are new or whose ``content`` changed,
        and returns their results by key."""
        before = self.generation()
        known = self.manifest(before)
        hashes = [F.sum(F.xxhash64(F.lit(salt), *content).cast("decimal(38,0)")).cast("string").alias(f"hash_{salt}") for salt in (1, 2)]
        now = written(rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*hashes), "content-hashes")
        same = [self.key, "hash_1", "hash_2"]
        changed = written(now.join(known, same, "left_anti"), "content-changed")
        part, seen = uuid.uuid4().hex, Observation()
        some = rows.join(changed.select(self.key), self.key, "left_semi").observe(seen, F.count(F.lit(1)).alias("rows"))
        found = compute(some)
        found.write.parquet(f"{self.folder}/parts/part={part}")
        rows_read = seen.get["rows"]
        kept = known.join(now, same, "left_semi")
        self._commit(before + 1, kept.unionByName(changed.withColumn("part", F.lit(part))))
        computed, all_now, all_before = changed.count(), now.count(), known.count()
        gone = known.join(now, self.key, "left_anti").count() if all_before else 0
        return Update(before + 1, all_now - computed, computed, gone, rows_read)

    def _commit(self, generation: int, manifest: DataFrame) -> None:
        place = f"{self.folder}/manifest/generation={generation}"
        if place in children(self.spark, f"{self.folder}/manifest") and generation != self.generation():
            remove(self.spark, place)  # of a run that broke off while it wrote
        manifest.select(*[f.split()[0].strip("`") for f in self.manifest_schema.split(", ")]).write.parquet(place)

    def compact(self) -> None:
        """Rewrites the results as one part, so that a store of many runs is read as one table."""
        part, n = uuid.uuid4().hex, self.generation()
        self.results().drop("part").write.parquet(f"{self.folder}/parts/part={part}")
        self._commit(n + 1, self.manifest(n).withColumn("part", F.lit(part)))

    def vacuum(self) -> None:
        """Deletes what the last generation doesn't need. No run or reader of an earlier one may be at work."""
        n = self.generation()
        parts = {r["part"] for r in self.manifest(n).select("part").distinct().collect()}
        for p in children(self.spark, f"{self.folder}/parts"):
            if p.rpartition("=")[2] not in parts:
                remove(self.spark, p)
        for p in children(self.spark, f"{self.folder}/manifest"):
            if "generation=" in p and int(p.rpartition("=")[2]) < n:
                remove(self.spark, p)
