"""N-gram Jaccard self-join with vertical partitioning.

1. A pass over the texts gives each document's set of word n-grams as a size, a 128-bit digest and a parity
   sketch. Equal sets form a class; only its smallest id, the representative, goes on.
2. The global n-gram order puts the n-grams that many documents share last, the others by hash. Two sets at the
   threshold share an n-gram in their prefixes in any order; the order only decides how long the lists get.
3. Representatives meet their lists' leaders first, a number of pairs that grows with the lists. What these
   links join needs no more comparing; then all other pairs within the lists are compared that size, position
   and sketch leave possible. All three bounds are exact: no pair at the threshold fails them.
4. Pairs are counted by vertical partitions: the n-gram order is cut into fragments, each fragment gives partial
   overlaps, and their sum decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ready, remove, scratch_path, written
from .components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Odd multipliers of the hash functions.
MIX1, MIX2, JOIN = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93))
SKETCH = 8  # longs, 64 bits each
TOP = np.uint64(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX1
    h = (h ^ (h >> np.uint64(33))) * MIX2
    return h ^ (h >> np.uint64(33))


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word begins, its 64-bit hash) of bytes: the sum of a random number for each byte at each place of a
    word, so that no arrangement of letters cancels."""
    letter = np.flatnonzero(~BLANK[flat])
    if not len(letter):
        return letter, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(letter) > 1]))
    starts = letter[first]
    place = letter - np.repeat(starts, np.diff(np.append(first, len(letter))))
    value = _mixed(flat[letter].astype(np.uint64) + ((place + 1).astype(np.uint64) << np.uint64(8)))
    return starts, _mixed(np.add.reduceat(value, first))


def ngrams(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text the 63-bit hashes of its word n-grams, with repeats; a text of fewer words has one for all of them."""
    raw = [t.encode() for t in texts]
    flat = np.frombuffer(b"\n".join([*raw, b""]).translate(LOWER), dtype=np.uint8)
    if not len(flat):
        return []
    with np.errstate(over="ignore"):
        starts, word = word_hashes(flat)
        long = np.zeros(0, np.uint64)
        if len(word) >= n:
            long = word[: len(word) - n + 1].copy()
            for k in range(1, n):
                long = long * JOIN + word[k : len(word) - n + 1 + k]
            long = _mixed(long + np.uint64(n)) >> np.uint64(1)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw]))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n:
                out.append(long[a : b - n + 1])
            elif b > a:
                h = word[a : a + 1].copy()
                for k in range(a + 1, b):
                    h = h * JOIN + word[k]
                out.append(_mixed(h + np.uint64(b - a)) >> np.uint64(1))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    s = np.sort(keys)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def digest(keys: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(keys.tobytes(), digest_size=16).digest(), dtype="<i8").tolist())


def sketch(keys: np.ndarray) -> list[int]:
    """Parities of the set's members by hash: two sketches differ in at most as many bits as the sets in members."""
    odd = np.bincount((keys >> np.uint64(50)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _texts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``most`` characters of column 1; null as ""."""
    first, part, held = 0, [], 0
    for i in range(batch.num_rows):
        part.append(batch.column(1)[i].as_py() or "")
        held += len(part[-1])
        if held >= most:
            yield first, part
            first, part, held = i + 1, [], 0
    if part:
        yield first, part


SETS = "doc long, n long, c1 long, c2 long, " + ", ".join(f"s{k} long" for k in range(SKETCH)) + ", gram long, times long"
SLICE = 400_000


def _sets(docs: DataFrame, n: int, chunk: int = 2_000_000, common: int = 8) -> DataFrame:
    """A row for each document, and rows (gram, times) for n-grams in ``common`` or more different sets among those
    of ``chunk`` n-grams together. An n-gram in a share of all documents is found in at least one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SETS.split(", ")]
        here: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def frequent() -> pa.RecordBatch:
            flat = np.concatenate([*here.values(), np.zeros(0, np.uint64)])
            here.clear()
            flat.sort()  # in place: the sets are the most that a task holds
            starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(flat)))
            keys, times = flat[starts[times >= common]], times[times >= common]
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([none] * (4 + SKETCH) + [pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], names=names)

        for batch in batches:
            for first, texts in _texts(batch, SLICE):
                rows = []
                for found in ngrams(texts, n):
                    keys = distinct(found)
                    c = digest(keys)
                    rows.append((len(keys), *c, *sketch(keys)))
                    if len(keys) and c not in here:
                        here[c] = keys
                        held += len(keys)
                columns = np.array(rows, dtype=np.int64).T
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *map(pa.array, columns), none, none], names=names)
                if held >= chunk:
                    yield frequent()
                    held = 0
        if here:
            yield frequent()

    return docs.mapInArrow(lean(run), SETS)


class Order:
    """The global order: n-grams that are not frequent by hash, then the frequent ones, rarest first."""

    def __init__(self, grams: np.ndarray, times: np.ndarray):
        rank = np.empty(len(grams), dtype=np.uint64)
        rank[np.lexsort((grams, times))] = np.arange(len(grams), dtype=np.uint64)
        by = np.argsort(grams)
        self.grams, self.rank = grams[by], rank[by]

    def placed(self, keys: np.ndarray) -> np.ndarray:
        """Distinct n-grams as keys that sort in this order."""
        if len(self.grams) and len(keys):
            at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
            hit = self.grams[at] == keys
            if hit.any():
                keys = keys.copy()
                keys[hit] = TOP | self.rank[at[hit]]
                keys.sort()
        return keys

    def fragments(self, keys: np.ndarray, cuts: int) -> np.ndarray:
        """Which range of the order each key is in: ``cuts`` of the hash, then ``cuts`` of the frequent ones' ranks."""
        rank = (keys & ~TOP) * np.uint64(cuts) // np.uint64(max(1, len(self.grams))) + np.uint64(cuts)
        return np.where(keys >= TOP, rank, (keys >> np.uint64(32)) * np.uint64(cuts) >> np.uint64(31))


def _order(frequent: DataFrame, most: int) -> Order:
    """Of (gram, times). At most ``most`` n-grams (16 bytes each) come to the driver; which ones has no bearing on results."""
    top = frequent.groupBy("gram").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "gram").limit(most).toPandas()
    return Order(top["gram"].to_numpy().astype(np.uint64), top["times"].to_numpy())


def _prefixes(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """(gram, c1, pos, n): each set's first n - ceil(percent * n) + 1 n-grams in the order; c1 is half of its digest.
    Copies within a batch of texts are one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch, SLICE):
                parts, sizes, names = [np.zeros(0, np.uint64)], [], {}
                for found in ngrams(texts, n):
                    keys = distinct(found)
                    c1 = digest(keys)[0]
                    if not len(keys) or names.get(c1) == len(keys):
                        continue
                    names[c1] = len(keys)
                    sizes.append((c1, len(keys)))
                    parts.append(order.value.placed(keys)[: len(keys) + (-len(keys) * percent // 100) + 1])
                lengths = np.array([len(p) for p in parts[1:]], dtype=np.int64)
                flat = np.concatenate(parts)
                begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
                own = np.repeat(np.array(sizes, dtype=np.int64).reshape(-1, 2), lengths, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.view(np.int64)), pa.array(own[:, 0]), pa.array((np.arange(len(flat)) - begin).astype(np.int32)), pa.array(own[:, 1].astype(np.int32))],
                    names=["gram", "c1", "pos", "n"],
                )

    return docs.mapInArrow(lean(run), "gram long, c1 long, pos int, n int")


def _possible(percent: int, x: str, y: str, sketches: bool = True) -> Column:
    """Exact bounds: sizes; n-grams left after the first one in common; members in which the sketches differ."""
    c = lambda t, k: F.col(f"{t}.{k}")
    both = c(x, "n") + c(y, "n")
    out = (100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n"))) & (
        (100 + percent) * F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= percent * both)
    if sketches:
        apart = sum((F.bit_count(c(x, f"s{k}").bitwiseXOR(c(y, f"s{k}"))) for k in range(1, SKETCH)), F.bit_count(c(x, "s0").bitwiseXOR(c(y, "s0"))))
        out &= (100 + percent) * apart <= (100 - percent) * both
    return out


def _fragments(docs: DataFrame, wanted: DataFrame, order, n: int, cuts: int, first: int, broadcast_rows: int) -> DataFrame:
    """(node, fragment, n, inside, grams) of the classes in ``wanted`` (node, rep, c1): their n-grams in the ``first``
    fragments of the order, ``inside`` in number. Each has a row for fragment 0, be it empty."""
    ids = _few(wanted.select(F.col("rep").alias("doc")).distinct(), broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _texts(batch, SLICE):
                rows = []
                for i, found in enumerate(ngrams(texts, n)):
                    keys = distinct(found)
                    c1, keys = digest(keys)[0], order.value.placed(keys)
                    part = order.value.fragments(keys, cuts)
                    inside = int((part < first).sum())
                    for f in np.union1d(part[part < first], [0]):
                        rows.append({"rep": batch.column(0)[at + i].as_py(), "c1": c1, "fragment": int(f), "n": len(keys), "inside": inside, "grams": keys[part == f].view(np.int64)})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("rep", pa.int64()), ("c1", pa.int64()), ("fragment", pa.int32()), ("n", pa.int64()), ("inside", pa.int64()), ("grams", pa.list_(pa.int64()))]))

    made = docs.join(ids, "doc", "left_semi").select("doc", "text").mapInArrow(lean(run), "rep long, c1 long, fragment int, n long, inside long, grams array<long>")
    # a repeated id may bring other texts, or the same one again
    return made.join(_few(wanted, broadcast_rows), ["rep", "c1"]).groupBy("node", "fragment").agg(*[F.first(c).alias(c) for c in ("n", "inside", "grams")])


def _few(ids: DataFrame, most: int) -> DataFrame:
    """For a join: broadcast if counted to be at most ``most`` rows of a number, else shuffled."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _overlapping(pairs: DataFrame, fragments: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """Of the (a, b) pairs, those that can reach the threshold: overlaps within each fragment, summed by pair, and at
    most all of what is outside the fragments. If they are the whole order, just those at the threshold. Few pairs go to
    the fragments, which lie by (node, fragment) already; only the first side moves to the second."""
    side = lambda t: fragments.select(F.col("node").alias(t), F.col("n").alias(f"{t}_n"), (F.col("n") - F.col("inside")).alias(f"{t}_out"), "fragment", F.col("grams").alias(f"{t}_grams"))
    partial = side("a").join(_few(pairs, broadcast_rows), "a").join(side("b"), ["b", "fragment"])
    partial = partial.select("a", "b", "a_n", "b_n", "a_out", "b_out", F.size(F.array_intersect("a_grams", "b_grams")).alias("common"))
    total = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), *[F.first(c).alias(c) for c in ("a_n", "b_n", "a_out", "b_out")])
    return total.where((100 + percent) * (F.col("common") + F.least("a_out", "b_out")) >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, leaders: int = 4, cuts: int = 8,
    long_list: int = 16, most_frequent: int = 500_000, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every row.

    Two documents link when their sets of word ``n``-grams (A-Z as a-z, words between ASCII blanks) overlap in
    ``percent`` of their union or more. class_id is the smallest id with the same set, component_id the smallest
    id reachable by links, itself included. A text of fewer than ``n`` words has one n-gram, all its words; one
    without words, null or empty, has none, links with nothing and is its own component. Rows with a null id link
    with nothing either, their class and component are null. Rows that share an id are documents of their own, with the
    same id. Other columns are left out.

    A class of copies costs one representative, and a group of near copies as many pairs as it has members, plus
    those pairs that the first links leave apart and the exact bounds leave possible.
    """
    spark = docs.sparkSession
    ready(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sets_path = scratch_path(spark, "jaccard-sets")
    sets = written(_sets(source, n), "jaccard-sets", sets_path)
    order = spark.sparkContext.broadcast(_order(sets.where("gram IS NOT NULL"), most_frequent))
    rows = sets.where("c1 IS NOT NULL").drop("gram", "times")
    sketches = [f"s{k}" for k in range(SKETCH)]
    # copies are counted up before the shuffle: a class of a third of all rows is a row a task
    classes = rows.where("n > 0 AND doc IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc").alias("rep"), F.first("n").cast("int").alias("n"), *[F.first(s).alias(s) for s in sketches])
    # a class is known by a number: an id may have several texts
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    known = rows.select("doc", F.col("n").alias("n_shingles"), "c1", "c2")
    named = known.join(classes.select("c1", "c2", "node", "rep"), ["c1", "c2"], "left")
    alone = F.col("doc").isNull() | (F.col("n_shingles") == 0)
    named = written(named.select("doc", "n_shingles", F.when(~alone, F.col("node")).alias("node"), F.when(alone, F.col("doc")).otherwise(F.col("rep")).alias("rep")), "jaccard-named")

    by_gram = Window.partitionBy("gram")

    def listed(prefixes: DataFrame, tag: str) -> tuple[DataFrame, str]:
        """(gram, doc, n, pos, times) of n-grams in two or more sets, and where it is. One shuffle, by n-gram, for both
        counts and the merge of copies, which are a row a batch of texts."""
        many = lambda rows: rows.withColumn("times", F.count("*").over(by_gram)).where("times > 1")
        met = many(prefixes).groupBy("gram", "c1", "n").agg(F.min("pos").alias("pos"))  # most n-grams are in one place and go first
        path = scratch_path(spark, tag)
        return written(many(met).join(classes.select("c1", "n", F.col("node").alias("doc")), ["c1", "n"]).select("gram", "doc", "n", "pos", "times"), tag, path), path

    lists, first_path = listed(_prefixes(source.where("doc IS NOT NULL"), order, n, percent), "jaccard-lists")
    # Two sets that share n-grams of long lists only in their prefixes are both in such a list. So the sets in them
    # take prefixes in another order, with these n-grams last, and the long lists go.
    frequent = sets.where("gram IS NOT NULL").select("gram", "times").union(lists.where((F.col("times") >= long_list) & (F.col("gram") >= 0)).groupBy("gram").agg(F.max("times").alias("times")))
    again = spark.sparkContext.broadcast(_order(frequent, most_frequent))
    crowded = lists.where(F.col("times") >= long_list).select(F.col("doc").alias("node")).distinct().join(classes.select("node", "rep"), "node").select(F.col("rep").alias("doc")).distinct()
    moved = source.join(_few(crowded, broadcast_rows), "doc", "left_semi").select("doc", "text")
    moved = _prefixes(moved, again, n, percent).withColumn("gram", F.xxhash64("gram", F.lit("again")))
    longer, moved_path = listed(moved, "jaccard-moved")
    lists = written(lists.where(F.col("times") < long_list).unionByName(longer), "jaccard-lists-again")
    for path in (sets_path, first_path, moved_path):  # read for the last time
        remove(spark, path)

    # the leader of a list: whose n-grams the most others have, for its size
    score = lists.groupBy("doc").agg((F.sum("times") / F.first("n")).alias("score"))
    led = lists.join(score, "doc").withColumn("leader", F.max(F.struct("score", (-F.col("doc")).alias("doc"), "n", "pos")).over(by_gram))
    first = led.alias("x").select("x.*", F.struct((-F.col("leader.doc")).alias("doc"), "leader.n", "leader.pos").alias("y")).where("x.doc <> y.doc").where(_possible(percent, "x", "y", sketches=False))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("times"), "other"))
    first = first.groupBy("doc", F.col("y.doc").alias("other")).agg(F.count("*").alias("times")).withColumn("rank", rank).where(F.col("rank") <= leaders)
    marks = classes.select(F.col("node").alias("doc"), "n", *sketches)

    def overlapping(pairs: DataFrame, first: int, tag: str) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "rep", "c1"), "node")
        return written(_overlapping(pairs, _fragments(source, wanted, again, n, cuts, first, broadcast_rows), percent, broadcast_rows), f"jaccard-{tag}")

    def by_id(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b")).distinct()

    near = first.select("doc", "other").join(marks.alias("x"), "doc").join(marks.select(*[F.col(c).alias("other" if c == "doc" else c) for c in marks.columns]).alias("y"), "other").where(_possible_by_sketch(percent))
    near = written(by_id(near), "jaccard-near")
    links = overlapping(near, 2 * cuts, "links")
    parts = connected_components(links.toDF("u", "v"))

    # lists whose members are all in one component are done; in the others, pairs across components are left
    joined = lists.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component", "times")
    left = joined.withColumn("low", F.min("part").over(by_gram)).withColumn("high", F.max("part").over(by_gram)).where("low <> high").drop("low", "high")
    left = written(left.join(marks.drop("n"), "doc"), "jaccard-left")
    pairs = left.alias("x").join(left.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.doc") > F.col("y.doc")) & (F.col("x.part") != F.col("y.part")) & _possible(percent, "x", "y"))
    rest = written(by_id(pairs.select(F.col("x.doc").alias("doc"), F.col("y.doc").alias("other"))), "jaccard-pairs")  # else Spark joins before it drops repeats
    rest = written(rest.join(near, ["a", "b"], "left_anti"), "jaccard-rest")
    # few of these are links: a quarter of the fragments shows that of most
    rest = overlapping(rest, cuts // 4, "rest-possible")
    links = links.union(overlapping(rest, 2 * cuts, "rest-links")).toDF("u", "v")
    parts = connected_components(links)
    least = parts.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    parts = parts.join(least, "component").select("node", F.col("least").alias("component"))
    return named.join(parts, "node", "left").select(F.col("doc").alias(id_col), "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))


def _possible_by_sketch(percent: int) -> Column:
    c = lambda t, k: F.col(f"{t}.{k}")
    apart = sum((F.bit_count(c("x", f"s{k}").bitwiseXOR(c("y", f"s{k}"))) for k in range(1, SKETCH)), F.bit_count(c("x", "s0").bitwiseXOR(c("y", "s0"))))
    return (100 + percent) * apart <= (100 - percent) * (c("x", "n") + c("y", "n"))
