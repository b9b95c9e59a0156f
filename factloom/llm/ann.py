"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, written

FOUND = "query_id long, vec_id long, score double"
BLOCK = "cell long, ids array<long>, vectors binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


@dataclass
class CrossPolytope:
    """``tables`` hash functions, each of ``depth`` pseudo-rotations (three rounds of random signs and Hadamard);
    the code is the nearest signed axis of each rotation."""

    dim: int
    tables: int
    depth: int
    seed: int = 1

    def __post_init__(self):
        self.width = 1 << max(1, (self.dim - 1).bit_length())
        self.signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], size=(self.tables, self.depth, 3, self.width))

    def rotated(self, x: np.ndarray, table: int, level: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for s in self.signs[table, level]:
            y = hadamard(y * s)
        return y

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for level in range(self.depth):
            y = self.rotated(x, table, level)
            axis = np.abs(y).argmax(axis=1)
            out = out * 2 * self.width + 2 * axis + (y[np.arange(len(y)), axis] > 0)
        return out

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` cells nearest to each vector, nearest first."""
        scores, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for level in range(self.depth):
            y = self.rotated(x, table, level)
            both = np.stack([-y, y], axis=2).reshape(len(x), -1)  # code 2 * axis + (positive)
            best = np.argsort(-both, axis=1, kind="stable")[:, :most]
            s = (scores[:, :, None] + np.take_along_axis(both, best, axis=1)[:, None, :]).reshape(len(x), -1)
            c = (codes[:, :, None] * 2 * self.width + best[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(-s, axis=1, kind="stable")[:, :most]
            scores, codes = np.take_along_axis(s, keep, axis=1), np.take_along_axis(c, keep, axis=1)
        return codes

    @property
    def size(self) -> int:
        return (2 * self.width) ** self.depth


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the vectors as they are."""
    out = np.empty((len(queries), len(vectors)))
    for i, q in enumerate(queries.astype(np.float64)):
        d = vectors.astype(np.float64) - q
        out[i] = np.sqrt((d * d).sum(axis=1))
    return out


def repeats(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by id, where each id begins in it)."""
    by = np.argsort(ids, kind="stable")
    return by, np.flatnonzero(np.concatenate([[True], np.diff(ids[by]) != 0]))


class Best:
    """The k nearest distinct ids of each query so far, smaller ids first on ties."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray, met: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``met``: the ``repeats`` of the ids, if known."""
        by, starts = met or repeats(ids)
        if len(starts) < len(ids):  # else copies of few ids fill the k places
            ids, scores = ids[by][starts], np.minimum.reduceat(scores[by], starts)
        near = ids != query
        ids, scores = ids[near], scores[near]
        if len(ids) > self.k:
            few = scores <= np.partition(scores, self.k - 1)[self.k - 1]
            ids, scores = ids[few], scores[few]
        if query in self.kept:
            ids, scores = np.concatenate([self.kept[query][0], ids]), np.concatenate([self.kept[query][1], scores])
        by = np.lexsort((ids, scores))
        _, first = np.unique(ids[by], return_index=True)
        by = by[np.sort(first)][: self.k]
        self.kept[query] = ids[by], scores[by]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(i) for i, _ in self.kept.values()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(self.kept), dtype=np.int64), sizes)), pa.array(np.concatenate([i for i, _ in self.kept.values()] + [np.zeros(0, np.int64)])), pa.array(np.concatenate([s for _, s in self.kept.values()] + [np.zeros(0)]))],
            names=["query_id", "vec_id", "score"])
        self.kept = {}
        return out


def exact(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k nearest of a few given queries among (id, v) rows, by a scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            x, own = _matrix(batch.column(1), queries.shape[1]), batch.column(0).to_numpy()
            met = repeats(own)
            for q, scores in zip(ids, _nearest(queries, x), strict=True):
                best.add(int(q), own, scores, met)
        yield best.batch()

    return _ranked(vectors.mapInArrow(run, FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(rows: DataFrame, queries: DataFrame, dim: int, count: int, k: int, tables: int, recall: float, sample: int, cell_rows: int) -> tuple[CrossPolytope, int]:
    """(hash, probes a table): the fewest probes by which ``sample`` queries meet their true neighbours.

    Depth grows with the logarithm of the number of rows, so that a cell has ``cell_rows`` at most on the average. The sample's exact
    neighbours come from one scan; ``sample`` * (k + 1) vectors come to the driver. Where an id is met twice,
    the query's and the neighbour's vectors at their smaller distance count.
    """
    some = queries.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(some):
        return CrossPolytope(dim, tables, 1), 1
    x = np.array(some["v"].tolist(), dtype=np.float64)
    found = exact(rows, some["id"].to_numpy(), x, k).select("query_id", F.col("vec_id").alias("id"))
    asking = rows.sparkSession.createDataFrame([(int(q), i, v.tolist()) for i, (q, v) in enumerate(zip(some["id"], x, strict=True))], "query_id long, at int, q array<double>")
    apart = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    pairs = rows.join(F.broadcast(found.join(asking, "query_id")), "id")
    true = pairs.groupBy("query_id", "id").agg(F.min_by(F.struct("at", "v"), apart).alias("m")).select("m.at", "m.v").toPandas()  # sample * k rows
    owner, near = true["at"].to_numpy(), np.array(true["v"].tolist(), dtype=np.float64).reshape(-1, dim)
    depth = max(1, math.ceil(math.log(max(1, count / cell_rows)) / math.log(2 * dim)))
    while True:
        hashed = CrossPolytope(dim, tables, depth)
        most = 2 * hashed.width if depth == 1 else 1024
        rank = np.full(len(near), most)
        for t in range(tables):
            hit = hashed.probes(x, t, most)[owner] == hashed.cells(near, t)[:, None]
            rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
        need = math.ceil(recall * len(near))
        if not need or np.sort(rank)[need - 1] < most:
            return hashed, most if count <= k + 1 or not need else int(np.sort(rank)[need - 1]) + 1
        depth -= 1  # at depth 1 every cell can be probed


def nearest(
    rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = 12, recall: float = 0.96, sample: int = 100, cell_rows: int = 4_096, together: int = 1_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that fulfils ``queries``, its k nearest found among all others.

    Every row is indexed, in ``tables`` tables; a query probes the cells nearest to it, as many as a bounded
    sample of queries needs to meet ``recall`` of its true neighbours. Cells travel as blocks of rows, so a cell
    of a third of all rows is many blocks that Spark can deal out, and distances are taken block by block:
    only the nearest leave a task. Candidates are reranked by exact Euclidean distance of the original vectors.
    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
    part, nor do null ids. Rows with a query's id are never its neighbours; an id met twice counts once, at its
    smaller distance. Ties go to smaller ids. Empty tables give an empty result. Queries whose cells hold fewer than
    ``k`` others (or than there are) are answered by scans of all rows, ``together`` queries a scan.
    """
    spark = rows.sparkSession
    ready(spark)
    good = rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    shape = good.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = shape["dim"], shape["n"]
    good = good.where(F.size(vector_col) == dim)
    source = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = good.where(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    hashed, probes = fitted(source, asked, dim, count, k, tables, recall, sample, cell_rows)
    dtype = np.float64 if dict(source.dtypes)["v"] == "array<double>" else np.float32

    def blocks(ids: np.ndarray, x: np.ndarray, owner: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        """A row for each cell, with the ids and vectors of those in it."""
        by = np.argsort(cells, kind="stable")
        owner, cells = owner[by], cells[by]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        last = np.append(first[1:], len(cells))
        return pa.RecordBatch.from_arrays(
            [pa.array(cells[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(cells)).astype(np.int32)), pa.array(ids[owner])), pa.array([x[owner[a:b]].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())],
            names=["cell", "ids", "vectors"])

    def dealt(cells_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, ids = _matrix(batch.column(1), dim).astype(dtype), batch.column(0).to_numpy()
                    for t in range(hashed.tables):
                        owner, cells = cells_of(x.astype(np.float64), t)
                        yield blocks(ids, x, owner, cells * hashed.tables + t)
        return run

    index = source.mapInArrow(dealt(lambda x, t: (np.arange(len(x)), hashed.cells(x, t))), BLOCK)
    probed = asked.mapInArrow(dealt(lambda x, t: (np.repeat(np.arange(len(x)), probes), hashed.probes(x, t, probes).ravel())), BLOCK)
    met = index.join(written(probed, "ann-probes").select("cell", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "cell")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in batch.select(["ids", "vectors", "query_ids", "queries"]).to_pylist():
                vectors, asking = (np.frombuffer(row[c], dtype=dtype).reshape(-1, dim) for c in ("vectors", "queries"))
                ids = np.array(row["ids"], dtype=np.int64)
                met = repeats(ids)
                for q, scores in zip(row["query_ids"], _nearest(asking, vectors), strict=True):
                    best.add(q, ids, scores, met)
            if len(best.kept) > 20_000:
                yield best.batch()
        yield best.batch()

    found = written(_ranked(met.mapInArrow(rerank, FOUND), k), "ann-found")
    most = source.select("id").distinct().limit(k + 1).count() - 1  # others that each query has, k at most
    short = asked.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < most).select("id", "v")
    short = written(short, "ann-short")
    blocks = math.ceil(short.count() / together)
    if not blocks:
        return found
    found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    for b in range(blocks):
        some = short.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()  # about `together` vectors
        if len(some):
            found = found.unionByName(written(exact(source, some["id"].to_numpy(), np.array(some["v"].tolist(), dtype=np.float64), k), "ann-scanned"))
    return found
