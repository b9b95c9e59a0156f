"""SimHash near-dedup: fingerprints of word shingles, linked within a few bits by a forest of vantage-point trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written
from .components import connected_components

#: The halves of a fingerprint. Two within 3 bits differ in at most 1 bit of one of them, so a tree for each half finds
#: all pairs: in its tree a pair is within HALF_BITS of the half and MOST_BITS of the whole.
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
WHOLE, MOST_BITS, HALF_BITS = np.uint64(0xFFFFFFFFFFFFFFFF), 3, 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(raw: bytes, size: int = 3, segment: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``size`` words, or of all words if they are fewer; a segment of the text at a time."""
    at, words, met = 0, [], 0
    while at < len(raw):
        cut = SPACE.search(raw, at + segment) if at + segment < len(raw) else None
        end = cut.end() if cut else len(raw)
        words += raw[at:end].lower().split()  # both know ASCII only
        at = end
        runs = zip(*[words[i:] for i in range(size)], strict=False)
        found = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs), dtype=np.uint64)
        if len(found):
            met += len(found)
            yield found
            words = words[len(found):]
    if words and not met:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    """Bits that are set in over half of the hashes; 0 without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(raw or b"", size):
        n += len(h)
        for part in np.array_split(h, len(h) // 65_536 + 1):
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def apart(x: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ point) & mask).astype(np.int16)


@dataclass
class Node:
    """A vantage point and the distance, by the bits of a mask, up to which fingerprints go left. A pair of the tree
    differs by ``slack`` bits of the mask at most, so by the triangle inequality one whose distance is within ``slack``
    of the bound may have its partner on the other side."""

    point: np.uint64
    mask: np.uint64
    bound: int
    slack: int
    left: Node | int | None = None
    right: Node | int | None = None

    def sides(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lives left, may have partners left, may have partners right)."""
        d = apart(x, self.point, self.mask)
        return d <= self.bound, d - self.slack <= self.bound, d + self.slack > self.bound


def best_split(x: np.ndarray, half: np.uint64, rng: np.random.Generator, tries: int = 6) -> tuple[Node, float] | None:
    """The split of x for which the fewest pairs stay together, and their share; None if no split leaves fewer."""
    best = None
    for point in x[rng.permutation(len(x))[:tries]]:
        for mask, slack in ((half, HALF_BITS), (WHOLE, MOST_BITS)):
            at = np.cumsum(np.bincount(apart(x, point, mask), minlength=65))  # how many are within 0, 1, ... bits
            lives = at[:64]
            left = at[np.minimum(np.arange(64) + slack, 64)]
            right = len(x) - np.concatenate([np.zeros(slack, dtype=at.dtype), at])[:64]
            pairs = np.where((lives > 0) & (lives < len(x)), lives * left + (len(x) - lives) * right, len(x) ** 2)
            bound = int(pairs.argmin())
            share = pairs[bound] / len(x) ** 2
            if share < 0.95 and (best is None or share < best[1]):
                best = Node(point, mask, bound, slack), share
    return best


def tree(sample: np.ndarray, half: np.uint64, leaf: int, rng: np.random.Generator, count: Iterator[int]) -> Node | int:
    """A tree over a sample, with numbered leaves of at most ``leaf`` of it."""
    split = best_split(sample, half, rng) if len(sample) > leaf else None
    if split is None:
        return next(count)
    node, (lives, _, _) = split[0], split[0].sides(sample)
    node.left, node.right = tree(sample[lives], half, leaf, rng, count), tree(sample[~lives], half, leaf, rng, count)
    return node


def routed(node: Node | int, x: np.ndarray, at: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, places in x, whether each lives there) of every leaf that has fingerprints or may have their partners."""
    if not len(at):
        return
    if isinstance(node, int):
        yield node, at, home
        return
    lives, left, right = node.sides(x[at])
    yield from routed(node.left, x, at[left], home[left] & lives[left])
    yield from routed(node.right, x, at[right], home[right] & ~lives[right])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest reachable) for the linked pairs: as many as there are fingerprints, not pairs."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def linked(home: np.ndarray, near: np.ndarray, half: np.uint64, rng: np.random.Generator, together: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``stars`` of the pairs of a fingerprint in ``home`` and one in ``near`` within MOST_BITS, by a local tree down to
    leaves of ``together`` pairs."""
    if not len(home) or not len(near):
        return
    split = best_split(home[rng.permutation(len(home))[:1024]], half, rng, 3) if len(home) * len(near) > together else None
    if split:
        node = split[0]
        lives, _, _ = node.sides(home)
        _, left, right = node.sides(near)
        yield from linked(home[lives], near[left], half, rng, together)
        yield from linked(home[~lives], near[right], half, rng, together)
        return
    step = max(1, together // len(near))
    for i in range(0, len(home), step):
        a, b = np.nonzero(np.bitwise_count(home[i : i + step, None] ^ near) <= MOST_BITS)
        a, b = home[i + a], near[b]
        if (a != b).any():
            yield stars(a[a != b], b[a != b])


def links(fingerprints: DataFrame, shard_rows: int = 16_000, leaf_sample: int = 64, most_sample: int = 1_000_000) -> DataFrame:
    """(u, v): links between distinct fingerprints (column ``fp``, a written table) that connect all within MOST_BITS.

    Two trees over a sample, ``leaf_sample`` fingerprints for each shard of ``shard_rows`` and ``most_sample`` at most,
    deal the fingerprints into shards; each lives in one shard of a tree and visits those that its bounds touch. A
    shard's pairs are found by a tree of its own. The sample bears on the sizes of shards only.
    """
    spark = fingerprints.sparkSession
    n = fingerprints.count()
    want = min(most_sample, leaf_sample * (n // shard_rows))
    shares = fingerprints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / max(n, 1))))
    sample = np.sort(shares.toPandas()["fp"].to_numpy(dtype=np.int64)).view(np.uint64) if want else np.zeros(0, dtype=np.uint64)
    rng = np.random.default_rng(7)
    trees = [tree(sample, half, leaf_sample, rng, iter(range(1 << 31))) for half in HALVES]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(parts).view(np.uint64)
            for t, root in enumerate(trees):
                for leaf, at, home in routed(root, x, np.arange(len(x)), np.full(len(x), True)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t << 32 | leaf)), pa.array(x[at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

        parts, held = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy())
            held += batch.num_rows
            if held > 200_000:
                yield from sent(parts)
                parts, held = [], 0
        if parts:
            yield from sent(parts)

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def meet(shard: pa.Table) -> pa.Table:
        half = HALVES[shard.column("shard")[0].as_py() >> 32]
        x, home = shard.column("fp").to_numpy().view(np.uint64), shard.column("home").to_numpy()
        found = list(linked(x[home], x, half, np.random.default_rng(7)))
        if not found:
            return schema.empty_table()
        u, v = (np.concatenate(c).view(np.int64) for c in zip(*found, strict=True))
        return pa.Table.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    return fingerprints.select("fp").mapInArrow(deal, "shard long, fp long, home boolean").groupBy("shard").applyInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, shard_rows: int = 16_000, leaf_sample: int = 64) -> DataFrame:
    """(id, fp, component_id) of every row: the fingerprint as a signed long and the smallest id that links reach.

    A-Z count as a-z; words are what ASCII white space parts; shingles are runs of ``size`` words, repeats included, or
    all words if there are fewer. Texts without words, null ones too, have fingerprint 0, which links like any other.
    Fingerprints link at 3 bits or fewer. Copies, a third of all rows too, are one fingerprint from the first count on.
    A null id is a row like any other but never a component's id, unless it has no other. Repeated rows each come back;
    an empty table gives an empty result; other columns are left out.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    each = written(source.mapInArrow(run, f"id {kind}, fp long"), "simhash-rows")
    distinct = written(each.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    found = connected_components(links(distinct, shard_rows, leaf_sample))
    first = found.join(distinct, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("least").alias("first"))
    of = distinct.join(found.join(first, "component").select(F.col("node").alias("fp"), "first"), "fp", "left")
    # written, so that a fingerprint of a third of all rows is met in a join of two exchanges, which Spark can split
    of = written(of.select("fp", F.coalesce("first", "least").alias("component_id")), "simhash-classes")
    return each.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
