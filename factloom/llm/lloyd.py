"""Centroid clustering by delta Lloyd: k-means in integers, whose rounds compare and move only what has changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, ready, remove, scratch_path, written

#: Of a block: the number of each vector's centroid (int32) and the squared distance to it (int64). Of a task and a
#: centroid: how many vectors came or went, and their signed sum.
STATE = "block long, clusters binary, distances binary, cluster int, n long, sums array<long>"
#: Sums of squares of larger components might not fit a double exactly, or a long at all.
EXACT, LARGEST = 1 << 22, 1 << 27


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double."""
    y = np.floor(scale * x.astype(np.float64))
    if y.size and np.abs(y).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} in magnitude: squared distances don't fit a long")
    return y.astype(np.int32)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, both whole numbers, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:  # every partial sum is below 2**53
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), dtype=np.int64)
    for i, c in enumerate(centroids):
        d = x.astype(np.int64) - c
        out[:, i] = (d * d).sum(axis=1)
    return out


def assigned(x: np.ndarray, centroids: np.ndarray, moved: np.ndarray, owner: np.ndarray | None, far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance), ties to smaller numbers.

    ``moved`` tells which centroids have changed since ``owner`` and ``far``, the centroids and distances so far. A
    vector whose own centroid stands where it was can only go to one that moved; the others are compared with all.
    """
    if owner is None or moved.all():
        d = squared(x, centroids)
    else:
        d = np.full((len(x), len(centroids)), np.iinfo(np.int64).max)
        d[:, moved] = squared(x, centroids[moved])
        loose = moved[owner]
        d[np.ix_(loose, ~moved)] = squared(x[loose], centroids[~moved])
        held = np.flatnonzero(~loose)
        d[held, owner[held]] = far[held]
    now = d.argmin(axis=1)
    return now.astype(np.int32), d[np.arange(len(x)), now]


def _packed(vectors: DataFrame, dim: int, scale: int, block_rows: int) -> DataFrame:
    """(block, ids, vectors): blocks of at most ``block_rows`` vectors as whole numbers, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                x = quantised(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "vectors"])
                block += 1

    return written(vectors.mapInArrow(run, f"block long, ids array<{dict(vectors.dtypes)['id']}>, vectors binary"), "lloyd-blocks")


def _round(met: DataFrame, centroids: np.ndarray, moved: np.ndarray, first: bool) -> DataFrame:
    """STATE after comparing the blocks of ``met`` with the centroids."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        schema = pa.schema([("block", pa.int64()), ("clusters", pa.binary()), ("distances", pa.binary()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors"], dtype=np.int32).reshape(-1, dim)
                owner, far = (None, None) if first else (np.frombuffer(row["clusters"], dtype=np.int32), np.frombuffer(row["distances"], dtype=np.int64))
                now, d = assigned(x, centroids, moved, owner, far)
                went = np.full(len(x), True) if first else now != owner
                for to, sign in ((now, 1), (owner, -1)):
                    for c in [] if to is None else np.unique(to[went]):
                        of = went & (to == c)
                        sums[c] += sign * x[of].sum(axis=0, dtype=np.int64)
                        counts[c] += sign * of.sum()
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "clusters": now.tobytes(), "distances": d.tobytes()}], schema)
        told = [{"cluster": int(c), "n": int(counts[c]), "sums": sums[c].tolist()} for c in range(k) if counts[c] or sums[c].any()]
        yield pa.RecordBatch.from_pylist(told, schema)

    return met.mapInArrow(run, STATE)


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    dim: int = 64, scale: int = 1024, seed: int = 3, block_rows: int = 2_048, task_blocks: int = 256,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector kept; other columns are left out.

    Vectors become whole numbers, floor(scale * x), so that sums have no order. Those null, of another length than
    ``dim`` or with null or non-finite components take no part. Centroids start as the k vectors whose
    ``<seed>:<id>`` has the smallest SHA-256; rows of equal ids come by their components, null ids last. Repeated rows
    count each. With fewer than k vectors there are so many centroids; an empty table gives an empty result. Centroids
    that lose all vectors stay where they are. Components beyond 2**27 / scale raise an error.

    Vectors are packed once, in blocks dealt out by number, ``task_blocks`` to a task (fewer, where that makes fewer tasks
    than a shuffle has), and kept with Spark's cache, which rebuilds lost parts from the written table. A round meets them with the assignments and distances of the round before, a written table of
    12 bytes a vector, compares only with centroids that moved (all, for vectors of those), and writes the new ones with
    a row of signed integer sums for each task and centroid that gained or lost. What reaches the driver are the k
    totals. Rounds end early once no centroid moves.
    """
    spark = rows.sparkSession
    ready(spark)
    source = rows.where(finite(F.col(vector_col)) & (F.size(vector_col) == dim)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last()
    start = source.orderBy(by_hash, "v").limit(k).toPandas()
    kind = dict(source.dtypes)["id"]
    if not len(start):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = quantised(np.array(start["v"].tolist(), dtype=np.float64), scale).astype(np.int64)
    k = len(centroids)
    blocks = _packed(source, dim, scale, block_rows)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // task_blocks))
    vectors = blocks.select("block", "vectors").repartition(tasks, "block").persist()
    sums, counts, moved = np.zeros_like(centroids), np.zeros(k, dtype=np.int64), np.full(k, True)
    state, place = None, None
    for step in range(rounds + 1):
        met = vectors if state is None else vectors.join(state.where("block IS NOT NULL").select("block", "clusters", "distances").hint("shuffle_hash"), "block")
        last, place = place, scratch_path(spark, "lloyd-state")
        state = written(_round(met, centroids, moved, state is None), "lloyd-state", place)
        if last:
            remove(spark, last)
        if step == rounds:
            break
        sent = state.where("cluster IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("at", "x"))
        for r in sent.groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():  # k * dim rows
            sums[r["cluster"], r["at"]] += r["x"]
            counts[r["cluster"]] += r["n"] if r["at"] == 0 else 0
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        moved, centroids = (new != centroids).any(axis=1), new
        if not moved.any():
            break
    vectors.unpersist()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                now, d = (np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in ((1, np.int32), (2, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(now), pa.array(d)], names=["id", "cluster", "distance"])

    found = blocks.select("block", "ids").join(state.select("block", "clusters", "distances"), "block").select("ids", "clusters", "distances")
    found = found.mapInArrow(unpack, f"id {kind}, cluster int, distance long")
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows
    told = spark.createDataFrame(
        [(c, v, sum(inertia.values()), [int(x) for x in centroids[c]]) for c, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
