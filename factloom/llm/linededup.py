"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ready, remove, scratch_path, settings, written

BLANK = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
#: Scans of sorted buckets tell that they are sorted.
ORDERED = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}


def line_hash(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key (stripped, A-Z as a-z), or None if the key has under ``least`` code points."""
    key = line.strip(BLANK)
    if len(key) < least or len(key) - (len(key) if key.isascii() else 0) and len(key.translate(None, CONTINUATION)) < least:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc) for each distinct key of each row of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            found: list[bytes] = []
            for i in range(batch.num_rows):
                if raw := (batch.column(1)[i].as_py() or "").encode():
                    keys = {h for line in raw.split(b"\n") if (h := line_hash(line, least))}
                    found += keys
                    owners += [i] * len(keys)
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pc.take(batch.column(0), pa.array(owners, pa.int64()))], names=["h1", "h2", "doc"])

    return docs.mapInArrow(lean(run), "h1 long, h2 long, doc long")


class LineRuns:
    """Counts of line keys as sorted runs (h1, h2, n, newest) on levels, as a log-structured merge tree.

    A run is a table of ``buckets`` files by key, each sorted: runs have equal buckets, so they are merged and joined
    bucket by bucket, without an exchange and in the order in which they lie. Each batch adds one run to level 0. A level
    with ``fanout`` runs is compacted into one run of the next level: a key has at most one row a run and levels grow
    with the logarithm of the number of batches. n is the number of documents, newest the largest document id. A key is
    settled for a batch once earlier runs have it in ``min_docs`` documents and with a newer document than any of
    the batch: the batch is merge-anti-joined against the runs' settled keys and adds only what is left.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, min_docs: int = 3, buckets: int = 8):
        self.spark, self.fanout, self.min_docs, self.buckets = spark, fanout, min_docs, buckets
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame, level: int) -> None:
        path, name = scratch_path(self.spark, f"line-run-{level}"), f"line_run_{uuid.uuid4().hex}"
        with settings(self.spark, **ORDERED):
            keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._sum(full), level + 1)
            for name in full:
                self.drop(name)

    def drop(self, name: str) -> None:
        place = self.spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, place)

    def close(self) -> None:
        """Drops all runs; what was read from them must be written before."""
        for name in [n for level in self.levels for n in level]:
            self.drop(name)
        self.levels = []

    def _sum(self, names: list[str]) -> DataFrame:
        # bucket k of all runs is one partition of the union. The filter (n is 1 at least) makes the scans' columns rows: a
        # union of columnar scans would put the buckets behind one another, but pass for partitioned by key (Spark 4.1).
        runs = reduce(DataFrame.unionAll, [self.spark.table(n).where("n > 0") for n in names])
        return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))

    def counts(self) -> DataFrame | None:
        """(h1, h2, n, newest) of all keys so far; n of a settled key may stay at the count that settled it."""
        names = [n for level in self.levels for n in level]
        return self._sum(names) if names else None

    def batch(self, keys: DataFrame) -> DataFrame:
        """What a batch's (h1, h2, doc) rows, one for each key and document, add. Counts are summed before they are dealt
        to the buckets: a key of a third of all documents is a row a task."""
        batch = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("newest")).repartition(self.buckets, "h1", "h2")
        if (known := self.counts()) is not None:
            settled = known.where(F.col("n") >= self.min_docs).select("h1", "h2", F.col("newest").alias("settled"))
            batch = batch.join(settled.hint("merge"), (batch.h1 == settled.h1) & (batch.h2 == settled.h2) & (F.coalesce(batch.newest <= settled.settled, F.col("newest").isNull())), "left_anti")
        return batch

    def add(self, keys: DataFrame) -> None:
        self._write(self.batch(keys), 0)


def batches_of(keys: DataFrame, n: int) -> list[DataFrame]:
    """(.., doc) rows in ``n`` ranges of the id, largest ids first; a null id is in the last."""
    cuts = keys.agg(F.percentile_approx("doc", [k / n for k in range(n - 1, 0, -1)], 1000)).first()[0] or []
    cuts = list(dict.fromkeys(cuts))
    if not cuts:
        return [keys]
    between = [keys.where((F.col("doc") > low) & (F.col("doc") <= high)) for high, low in zip(cuts, cuts[1:], strict=False)]
    return [keys.where(F.col("doc") > cuts[0]), *between, keys.where(F.col("doc").isNull() | (F.col("doc") <= cuts[-1]))]


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, salts: int = 16,
    bucket_keys: int = 1_000_000, runs: LineRuns | None = None,
) -> DataFrame:
    """``docs`` with the text's kept lines in place of the text, and n_lines and n_dropped added.

    A line's key is the line stripped of ASCII blanks, A-Z in lower case. Keys of ``least_chars`` code points
    or more in ``min_docs`` documents or more lose all lines but those of the largest id that holds them.
    Documents come in ``batches`` ranges of ids of about equal numbers of keys, newest first, through ``runs`` (given: runs
    of earlier batches; else with a bucket for each ``bucket_keys`` keys, and one a core at least).
    Each row counts as a document, also when ids repeat; rows that share the largest id all keep the line. A
    null id is smaller than all others; if only such rows hold a key, they keep it. Null or empty text is one
    empty line and stays null or empty. Columns named n_lines and n_dropped are replaced; all others stay.
    """
    spark = docs.sparkSession
    ready(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    keys = written(line_keys(source, least_chars), "line-keys")  # texts are read twice: here and at the end
    own = runs is None
    runs = runs or LineRuns(spark, fanout, min_docs, max(spark.sparkContext.defaultParallelism, -(-keys.count() // bucket_keys)))
    for batch in batches_of(keys, batches):
        runs.add(batch)
    common = written(runs.counts().where(F.col("n") >= min_docs).select("h1", "h2", "newest"), "line-common")
    if own:  # nothing stays in the catalog
        runs.close()
    hot = common.select("h1", "h2", "newest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # a key may be in a third of all documents: its rows are dealt to `salts` tasks
    met = keys.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    lost = met.join(hot, ["h1", "h2", "salt"]).where(~F.col("newest").eqNullSafe(F.col("doc")))
    lost = lost.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("__lost"))

    kept = docs.drop("n_lines", "n_dropped")
    key = F.col("__docs." + f"`{id_col}`").cast("long")
    wide = kept.alias("__docs").join(lost.alias("__runs"), key.eqNullSafe(F.col("__runs.doc")), "left").select("__docs.*", "__runs.__lost")
    at, last = kept.columns.index(text_col), len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone = [], [], []
            for i in range(batch.num_rows):
                text, keys = batch.column(at)[i].as_py(), batch.column(last)[i].as_py()
                n.append(text.count("\n") + 1 if text else 1)
                gone.append(0)
                if text and keys:
                    drop = {np.array([k["h1"], k["h2"]], dtype="<i8").tobytes() for k in keys}
                    lines = text.encode().split(b"\n")
                    left = [x for x in lines if line_hash(x, least_chars) not in drop]
                    gone[-1] = len(lines) - len(left)
                    text = b"\n".join(left).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:last])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*batch.schema.names[:last], "n_lines", "n_dropped"])

    schema = ", ".join([*(f"`{f.name}` {'string' if k == at else f.dataType.simpleString()}" for k, f in enumerate(kept.schema)), "n_lines long, n_dropped long"])
    return wide.mapInArrow(lean(run), schema)
