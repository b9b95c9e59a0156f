"""Which texts contain which patterns: an index of the patterns' rarest q-grams, then verification in place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, q: int) -> np.ndarray:
    """A number for each run of ``q`` code points. Equal runs have equal ones; what only has an equal number is told apart
    when the pattern is compared."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - q + 1
    out = np.full(max(n, 0), q, dtype=np.uint64)
    for k in range(q if n > 0 else 0):
        out = (out + codes[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Patterns by one gram each: for each size of gram, sorted numbers, and beside them the pattern and the gram's offset."""

    def __init__(self, patterns: list[str], q: int, frequent: dict[int, int]):
        self.by_size: dict[int, tuple[np.ndarray, list[tuple[str, int]]]] = {}
        parts: dict[int, list[tuple[int, str, int]]] = {}
        for p in patterns:
            size = min(q, len(p))
            best = min((frequent.get(int(h), 0), int(h), at) for at, h in enumerate(gram_hashes(p, size)))
            parts.setdefault(size, []).append((best[1], p, best[2]))
        for size, some in parts.items():
            some.sort()
            self.by_size[size] = np.array([h for h, _, _ in some], dtype=np.uint64), [(p, at) for _, p, at in some]

    def found(self, text: str) -> set[str]:
        out: set[str] = set()
        for size, (known, entries) in self.by_size.items():
            own = gram_hashes(text, size)
            first = np.searchsorted(known, own)
            places = np.flatnonzero(known[np.minimum(first, len(known) - 1)] == own)
            places = places[np.argsort(first[places], kind="stable")]  # gram by gram, in the order of the text
            for met in np.split(places, np.flatnonzero(np.diff(first[places])) + 1) if len(places) else []:
                k, h = int(first[met[0]]), own[met[0]]
                while k < len(known) and known[k] == h:  # patterns that share their rarest gram
                    pattern, offset = entries[k]
                    if any(i >= offset and text.startswith(pattern, i - offset) for i in met.tolist()):
                        out.add(pattern)
                    k += 1
        return out


def _frequencies(some: DataFrame, patterns: list[str], q: int) -> dict[int, int]:
    """How many of some texts hold each gram of the patterns."""
    sizes = {min(q, len(p)) for p in patterns}
    wanted = np.unique(np.concatenate([gram_hashes(p, min(q, len(p))) for p in patterns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for size in sizes:
                    own = np.unique(gram_hashes(text, size))
                    at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    n[at[wanted[at] == own]] += 1
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["at", "n"])

    counted = some.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    return {int(wanted[r["at"]]): r["n"] for r in counted}


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, q: int = 4, sample: int = 20_000, block_chars: int = 4_000_000) -> DataFrame:
    """(key, pattern) of each row whose text contains a pattern, once.

    Each pattern is looked up by the one of its q-grams (all of it, if shorter) that the fewest of some ``sample`` texts
    hold; which one has no bearing on results. A text's grams are looked up where it is read, and only where one is met
    is the pattern compared: texts are neither shuffled nor compared with all patterns, and a gram that is everywhere
    is no one's group. The index of ``block_chars`` characters of patterns is sent to the tasks at a time; if there are
    more, which is summed first, patterns are dealt into blocks and texts scanned once for each. Null texts and patterns
    match nothing; the empty pattern is in every text.
    """
    wanted = written(patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct(), "patterns")
    source = texts.select(F.col(key), F.col(text).alias("text")).where("text IS NOT NULL")
    out = source.select(key, F.lit("").alias("pattern")).distinct()
    if wanted.where("pattern = ''").isEmpty():
        out = out.limit(0)
    size = wanted.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    blocks = -(-size // block_chars)
    share = min(1.0, sample / max(source.count(), 1)) if blocks else 0
    some = source.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * share))
    kind = dict(source.dtypes)[key]
    for b in range(blocks):
        own = [r["pattern"] for r in wanted.where((F.col("pattern") != "") & (F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b)).collect()]
        if own:
            index = texts.sparkSession.sparkContext.broadcast(Index(own, q, _frequencies(some, own, q)))
            out = out.unionByName(source.mapInArrow(_lookup(index), f"`{key}` {kind}, pattern string").distinct())
    return out


def _lookup(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                met = index.value.found(text)
                at += [i] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[batch.schema.names[0], "pattern"])

    return run
