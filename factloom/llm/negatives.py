"""Hard-negative mining: a Voronoi-partitioned kNN join on norm-augmented vectors, with bounds that say who meets whom."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finite, ready, written

#: A row of a block or of an anchor's group, and these packed. ``place`` numbers an anchor's positives.
ROWS = "row long, id long, label long, cell int, far double, v binary"
PACKED = "pack long, cell int, near double, far double, label_from long, label_to long, rows array<long>, ids array<long>, labels array<long>, vectors binary"
FOUND = "row long, place int, id long, score long"
#: Above any score, and about how many scores are held at a time.
ANY, CELLS = 1 << 60, 1 << 19


@dataclass
class Pivots:
    """Pivots of a Voronoi partition in the space with one more dimension, where all rows have the norm of the longest.

    A row x becomes (x, sqrt(top - |x|^2)) and an anchor a becomes (a, 0): their squared distance is
    |a|^2 + top - 2ax, so that the highest inner products are the nearest rows.
    """

    points: np.ndarray
    top: float

    def __post_init__(self):
        p = self.points.astype(np.float64)
        self.lifted = np.column_stack([p, np.sqrt(np.maximum(0, self.top - (p * p).sum(axis=1)))])
        self.slack = 1e-6 * (np.sqrt(self.top) + 1)  # far more than roundings make

    def rows_to(self, x: np.ndarray) -> np.ndarray:
        y = np.column_stack([x, np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)))])
        return np.sqrt(np.maximum(0, 2 * self.top - 2 * (y @ self.lifted.T)))

    def anchors_to(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + self.top - 2 * (x @ self.lifted[:, :-1].T)))

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of anchors to a row of that inner product."""
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1) + self.top - 2 * score))


def _vectors(column, dim: int, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def best(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each key, smaller ids first on ties; keys may have two columns."""
    key = keys if keys.ndim == 2 else keys[:, None]
    by = np.lexsort((ids, -scores, *key.T[::-1]))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (key[by][1:] != key[by][:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return by[rank < k]


class Group:
    """Anchors that search together, and the ``k`` highest of each anchor and place so far. What ranks after these can't
    count any more: ``floor`` has the least score that can, ``floor_id`` the largest id at that score."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, least: np.ndarray, most: np.ndarray, k: int):
        self.rows, self.ids, self.labels, self.vectors, self.k = rows, ids, labels, vectors, k
        self.most, self.floor = most, np.where(least > most, np.inf, least)
        self.floor_id = np.full(least.shape, np.iinfo(np.int64).max)
        self.keys, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, x: np.ndarray, ids: np.ndarray, who: np.ndarray, labels: np.ndarray | None) -> None:
        """Scores of anchors ``who`` with rows in the order of their ids: of other labels, or, without ``labels``, of other ids."""
        own, places, at, step = self.vectors[who], self.floor.shape[1], 0, 256  # the first rows raise the floor for the rest
        while at < len(x):
            end = min(len(x), at + step)
            scores = own @ x[at:end].T  # whole numbers, exact in the vectors' type
            low = (self.floor[who] + 0.5 * (self.floor_id[who] < ids[at])).min(axis=1).astype(scores.dtype)
            flat = np.flatnonzero(scores >= low[:, None])
            if len(flat):
                line, column = who[flat // (end - at)], at + flat % (end - at)
                fits = self.labels[line] != labels[column] if labels is not None else self.ids[line] != ids[column]
                line, column, score = line[fits], column[fits], scores.ravel()[flat[fits]].astype(np.float64)
                some = []
                for place in range(places):
                    floor = self.floor[line, place]
                    here = np.flatnonzero((score <= self.most[line, place]) & ((score > floor) | (score == floor) & (ids[column] <= self.floor_id[line, place])))
                    some.append((line[here] * places + place, ids[column[here]], score[here]))
                self._add(*(np.concatenate(c) for c in zip(*some, strict=True)))
            at, step = end, min(4 * step, max(256, CELLS // len(who)))

    def _add(self, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(keys):
            return
        keys, ids, scores = np.append(self.keys, keys), np.append(self.found, ids), np.append(self.scores, scores)
        some = best(keys, scores, ids, self.k)
        self.keys, self.found, self.scores = keys[some], ids[some], scores[some]
        counts = np.bincount(self.keys, minlength=self.floor.size)
        full = np.flatnonzero(counts == self.k)
        last = np.cumsum(counts)[full] - 1
        self.floor.ravel()[full], self.floor_id.ravel()[full] = self.scores[last], self.found[last]

    def batch(self) -> pa.RecordBatch:
        line, place = np.divmod(self.keys, self.floor.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(self.rows[line]), pa.array(place.astype(np.int32)), pa.array(self.found), pa.array(self.scores.astype(np.int64))], names=["row", "place", "id", "score"])


class Part:
    """The rows of some blocks in one task, by label (if asked for) and id."""

    def __init__(self, packs: list[tuple], dim: int, kind: str, exact: type, by_label: bool):
        self.blocks = np.array([b for b, *_ in packs])
        ids, labels = (np.concatenate([p[c] for p in packs]) for c in (1, 2))
        of = np.repeat(np.arange(len(packs)), [len(p[1]) for p in packs])
        by = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
        x = np.frombuffer(b"".join(p[3] for p in packs), dtype=kind).reshape(-1, dim)
        self.x, self.ids, self.labels, self.of, self.by_label = x[by].astype(exact), ids[by], labels[by], of[by], by_label

    def search(self, group: Group, met: np.ndarray) -> None:
        x, ids, labels = self.x, self.ids, self.labels
        if len(met) < len(self.blocks):
            some = np.flatnonzero(np.isin(self.blocks, met)[self.of])
            x, ids, labels = x[some], ids[some], labels[some]
        if not self.by_label:
            group.meet(x, ids, np.arange(len(group.rows)), labels)
            return
        for label in np.unique(group.labels):
            a, b = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
            group.meet(x[a:b], ids[a:b], np.flatnonzero(group.labels == label), None)


def _rows(source: DataFrame, dim: int, scale: int) -> DataFrame:
    """(row, id, label, anchor, v, norm): vectors as whole numbers, with a number for each row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(scale * batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))
            norm = (x * x).sum(axis=1)
            if norm.max() > 1 << 53 or np.abs(x).max() >= 1 << 31:
                raise ValueError("inner products of vectors so long have no exact double")
            v = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(x))), *batch.columns[:3], v, pa.array(norm.astype(np.int64))], names=["row", "id", "label", "anchor", "v", "norm"])
            row += len(x)

    return written(source.mapInArrow(run, "row long, id long, label long, anchor boolean, v binary, norm long"), "mining-rows")


def _firsts(rows: DataFrame, k: int) -> DataFrame:
    """Rows that any anchor can find: of equal vectors with the same label, whose scores are equal, those of the ``k``
    smallest ids. Tasks drop the others before vectors meet."""
    place = F.dense_rank().over(Window.partitionBy("v", "label").orderBy("id"))
    return rows.select("row", "id", "label", "v", place.alias("place")).where(F.col("place") <= k)


def _placed(rows: DataFrame, pivots: Pivots, dim: int, anchors: bool) -> DataFrame:
    """ROWS with the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(3), dim).astype(np.float64)
                d = pivots.anchors_to(x) if anchors else pivots.rows_to(x)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), batch.column(3)], names=["row", "id", "label", "cell", "far", "v"])

    return rows.select("row", "id", "label", "v").mapInArrow(run, ROWS)


def _packed(placed: DataFrame, most: int, kind: str, tag: str) -> DataFrame:
    """Packs of at most ``most`` rows of a cell, alike in label and distance. A cell, label or repeated vector of many
    rows is dealt out by the row's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 33
        for batch in batches:
            cells = batch.column(3).to_numpy()
            starts = np.flatnonzero(np.diff(cells, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(cells)), strict=True):
                for at in range(a, b, most):
                    part = batch.slice(at, min(most, b - at))
                    labels, far = part.column(2).to_numpy(), part.column(4).to_numpy()
                    v = np.frombuffer(b"".join(part.column(5).to_pylist()), dtype="<i4").astype(kind)
                    listed = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pack]), pa.array(cells[at : at + 1]), pa.array([far.min()]), pa.array([far.max()]), pa.array([labels.min()]), pa.array([labels.max()]), *listed, pa.array([v.tobytes()], pa.binary())],
                        names=["pack", "cell", "near", "far", "label_from", "label_to", "rows", "ids", "labels", "vectors"])
                    pack += 1

    keys = ("cell", "label", "far", "row")
    return written(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, PACKED), tag)


class Mining:
    """What the passes share: blocks of rows, dealt to tasks in parts, groups of anchors, pivots."""

    def __init__(self, blocks: DataFrame, pivots: Pivots, dim: int, kind: str, part_rows: int):
        self.pivots, self.dim, self.kind = pivots, dim, kind
        counts = blocks.groupBy(F.shiftright("pack", 33).alias("task")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).orderBy("task").collect()  # one row for each task that packed
        before, total = list(accumulate((r["n"] for r in counts), initial=0)), sum(r["rows"] for r in counts)
        self.parts = max(-(-total // part_rows), min(32, -(-total // 16_384)))
        place = F.create_map(*[F.lit(x) for r, n in zip(counts, before[:-1], strict=True) for x in (r["task"], n)])[F.shiftright("pack", 33)] + F.col("pack").bitwiseAND(F.lit((1 << 33) - 1))
        self.blocks = blocks.withColumn("part", F.floor(place * self.parts / max(1, before[-1])).cast("int"))
        self.stats = self.blocks.select(F.col("pack").alias("block"), "part", "cell", "near", "far", "label_from", "label_to")

    def met(self, pairs: DataFrame, groups: DataFrame, limits: list[str], k: int, same: bool) -> DataFrame:
        """FOUND by the exact join of each pair of a group and a block. ``limits``: columns of ``groups`` with arrays
        of the least and most score for each anchor, by place; none: any score.

        A block is dealt to its part's task once; a group comes once to each part that has blocks for it, and meets these
        there together. Only what each task finds highest leaves it."""
        dim, kind = self.dim, self.kind
        exact = np.float32 if self.pivots.top < 1 << 23 else np.float64  # no sum of products exceeds the longest norm
        held = ("rows", "ids", "labels", "vectors")
        none = F.lit(None).cast("array<long>")
        ends = [x.alias(n) for x, n in zip([F.col(c) for c in limits] or [none, none], ("least", "most"), strict=True)]
        asked = pairs.groupBy("group", "part").agg(F.collect_list("block").alias("met")).join(
            groups.select("group", *held, *ends), "group")
        blocks = self.blocks.select(F.col("pack").alias("group"), "part", none.alias("met"), none.alias("rows"), *held[1:], none.alias("least"), none.alias("most"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packs: list[tuple] = []
            part = None
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda name: batch.column(name)[i]  # noqa: B023, E731
                    if not get("met").is_valid:  # blocks come first
                        packs.append((get("group").as_py(), *(np.array(get(c).values) for c in ("ids", "labels")), get("vectors").as_py()))
                        continue
                    part = part or Part(packs, dim, kind, exact, same)
                    rows, ids, labels = (get(c).values.to_numpy() for c in ("rows", "ids", "labels"))
                    vectors = np.frombuffer(get("vectors").as_py(), dtype=kind).reshape(-1, dim).astype(exact)
                    within = [get(c).values.to_numpy().reshape(-1, len(rows)).T.astype(np.float64) for c in ("least", "most")] if limits else [np.full((len(rows), 1), x) for x in (-np.inf, np.inf)]
                    group = Group(rows, ids, labels, vectors, *within, k)
                    part.search(group, get("met").values.to_numpy())
                    yield group.batch()

        dealt = blocks.unionByName(asked).repartitionById(self.parts, "part").sortWithinPartitions(F.col("met").isNotNull())
        return dealt.drop("part").mapInArrow(run, FOUND)

    def bounds(self, anchors: DataFrame) -> DataFrame:
        """(group, cell, near, far) of (group, v, least, most) rows: which distances to a cell's pivot rows can have whose
        score with some anchor of the group lies between its least and most (null: any), by the triangle bounds."""
        pivots, dim = self.pivots, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                of, x = batch.column(0).to_numpy(), _vectors(batch.column(1), dim).astype(np.float64)
                least, most = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (2, 3))
                d = pivots.anchors_to(x)
                outer = np.where(np.isnan(least), np.inf, pivots.reach(x, np.nan_to_num(least)))[:, None]
                inner = np.where(np.isnan(most), 0, pivots.reach(x, np.nan_to_num(most)))[:, None]
                low, high = np.maximum(d - outer, inner - d) - pivots.slack, d + outer + pivots.slack
                by = np.argsort(of, kind="stable")
                starts = np.flatnonzero(np.diff(of[by], prepend=-1))
                low, high = np.minimum.reduceat(low[by], starts), np.maximum.reduceat(high[by], starts)
                cells = np.tile(np.arange(d.shape[1], dtype=np.int32), len(starts))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of[by][starts], d.shape[1])), pa.array(cells), pa.array(low.ravel()), pa.array(high.ravel())], names=["group", "cell", "low", "high"])

        each = anchors.select("group", "v", "least", "most").mapInArrow(run, "group long, cell int, low double, high double")
        return each.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def at_home(self, groups: DataFrame, by_label: bool) -> DataFrame:
        """Pairs of a group with the blocks of its own cell."""
        g = groups.select("group", "cell", F.col("label_from").alias("g_from"), F.col("label_to").alias("g_to"))
        near = g.join(self.stats, "cell")
        return (near.where("label_from <= g_to AND g_from <= label_to") if by_label else near).select("group", "block", "part")

    def elsewhere(self, groups: DataFrame, bounds: DataFrame, by_label: bool) -> DataFrame:
        """Pairs of a group with the blocks of other cells that might serve it."""
        g = groups.select("group", F.col("cell").alias("home"), F.col("label_from").alias("g_from"), F.col("label_to").alias("g_to"))
        near = bounds.join(g, "group").where("cell <> home").join(self.stats, "cell").where("far >= low AND near <= high")
        return (near.where("label_from <= g_to AND g_from <= label_to") if by_label else near).select("group", "block", "part")


def _cut(found: DataFrame, k: int) -> DataFrame:
    """FOUND with the k highest of each anchor and place, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _limited(groups: DataFrame, ranges: DataFrame, places: int) -> DataFrame:
    """``groups`` with arrays ``least`` and ``most``, by place, then by anchor, from (row, place, least, most): places from
    0, without gaps. Where an anchor has none, no score is in it."""
    by_place = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "least", "most"))).alias("by_place"))
    limited = groups.select("group", F.posexplode("rows").alias("pos", "row")).join(by_place, "row", "left")
    at = lambda part, none: F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(places - 1)), lambda p: F.transform("all", lambda a: F.coalesce(F.get(a["by_place"], p)[part], F.lit(none).cast("long")))))
    lists = limited.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("pos", "by_place"))).alias("all"))
    return groups.join(lists.select("group", at("least", 1).alias("least"), at("most", 0).alias("most")), "group")


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    block_rows: int = 2_048, group_rows: int = 512, pivot_rows: int = 4_096, most_pivots: int = 1_024, part_rows: int = 262_144,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that fulfils ``anchors``
    and each of its nearest ``positives`` rows of the same label, the nearest ``negatives`` rows of other labels whose
    score is ``lowest`` to ``highest`` per cent of the positive's.

    A score is the inner product of floor(scale * x); higher ones come first, then smaller ids. Rows with a null id,
    label (whole numbers) or vector, with null or non-finite components, or of another length than most take no part.
    Repeated rows count each; a row of the anchor's id is never its positive. An anchor without positives, or with none
    above or at zero, has no negatives. Empty tables give an empty result. Other columns are left out.

    Of copies with one label, only those of the smallest ids can be found, one more than ``positives`` at most (the anchor's
    own may be one); others are searched for, but not in. Rows go to the nearest of at most ``most_pivots`` pivots (by a hash of ids; they bear on the work, not on results) in
    the norm-augmented space, and into blocks of near-equal label and distance; anchors into groups of one cell. Groups
    meet the blocks of their cell first: what these give bounds how far a row can be that still counts, and by the
    triangle bounds the group meets only blocks that may hold such rows. The second search knows also how near rows may
    not be. Each pair of a group and a block is joined exactly, in a task that holds the blocks of about ``part_rows`` rows
    (fewer in small tables, for more tasks) and to which groups are replicated; only the best leave a task.
    """
    spark = rows.sparkSession
    ready(spark)
    good = rows.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    shape = good.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if shape is None or not shape["dim"]:
        return empty
    dim = shape["dim"]
    source = good.where(F.size(vector_col) == dim).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    numbered = _rows(source, dim, scale)
    count, top = numbered.agg(F.count("*"), F.max("norm")).first()
    kind = "<i2" if top < 1 << 30 else "<i4"
    m = min(most_pivots, max(1, count // pivot_rows))
    some = numbered.orderBy(F.xxhash64("id", "v"), "row").limit(m).select("v").collect()
    pivots = Pivots(np.array([np.frombuffer(r["v"], dtype="<i4") for r in some], dtype=np.int64), float(top))
    firsts = _firsts(numbered, max(positives + 1, negatives))
    mining = Mining(_packed(_placed(firsts, pivots, dim, False), block_rows, kind, "mining-blocks"), pivots, dim, kind, part_rows)
    asked = numbered.where("anchor")
    groups = _packed(_placed(asked, pivots, dim, True), group_rows, kind, "mining-groups").withColumnRenamed("pack", "group")
    owner = groups.select("group", F.explode("rows").alias("row"))
    member = written(asked.select("row", "id", "v").join(owner, "row"), "mining-members")

    limits = ["least", "most"]
    # positives: the scores of the cell's own bound the rest
    first = written(_cut(mining.met(mining.at_home(groups, True), groups, [], positives, True), positives), "mining-first")
    least = first.where(F.col("rank") == positives).select("row", F.col("score").alias("least"))
    bound = mining.bounds(member.join(least, "row", "left").withColumn("most", F.lit(None).cast("long")))
    beyond = member.join(least, "row", "left").select("row", F.lit(0).alias("place"), F.coalesce("least", F.lit(-ANY)).alias("least"), F.lit(ANY).alias("most"))
    more = mining.met(mining.elsewhere(groups, bound, True), _limited(groups, beyond, 1), limits, positives, True)
    chosen = _cut(first.drop("rank").unionByName(more), positives).where("score >= 0")
    chosen = chosen.select("row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = written(chosen.join(member.select("row", F.col("id").alias("anchor_id")), "row"), "mining-positives")

    # negatives: groups again, with the least and most score for each anchor and place
    low, high = F.expr(f"-((-{lowest} * positive_score) div 100)"), F.expr(f"({highest} * positive_score) div 100")
    ranges = chosen.select("row", (F.col("place") - 1).alias("place"), low.alias("least"), high.alias("most"))
    ready_groups = written(_limited(groups, ranges, positives), "mining-asking")
    first = written(_cut(mining.met(mining.at_home(ready_groups, False), ready_groups, limits, negatives, False), negatives), "mining-home")
    third = first.where(F.col("rank") == negatives).select("row", "place", F.col("score").alias("third"))
    ranges = ranges.join(third, ["row", "place"], "left").withColumn("least", F.coalesce("third", "least"))
    bound = mining.bounds(member.join(ranges.groupBy("row").agg(F.min("least").alias("least"), F.max("most").alias("most")), "row"))
    beyond = written(_limited(groups, ranges, positives), "mining-asking")
    more = mining.met(mining.elsewhere(beyond, bound, False), beyond, limits, negatives, False)
    found = _cut(first.drop("rank").unionByName(more), negatives)
    found = found.select("row", (F.col("place") + 1).alias("place"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(found, ["row", "place"]).select(*empty.columns)
