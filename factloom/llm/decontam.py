"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, texts scanned once."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ready, scratch_path

WORD = re.compile(rb"[^ ]+")
#: Digits, letters and all bytes of non-ASCII characters stay (A-Z as a-z); the rest separates words.
#: One byte stays one byte, so positions hold in the original.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def windows(item: list[bytes], n: int) -> list[list[bytes]]:
    return [item[k : k + n] for k in range(max(1, len(item) - n + 1))] if item else []


def _padded(ws: list[bytes]) -> str:
    return (b" " + b" ".join(ws) + b" ").decode("latin-1")


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str, str], ...], n: int):
    """(automaton, owners): the automaton's values are (window number, words in it), owners[k] the items of window k.

    A task keeps the last one, so with one block each worker builds it once."""
    import ahocorasick

    at: dict[str, int] = {}
    owners: list[list[int]] = []
    found = ahocorasick.Automaton()
    for i, (_, text) in enumerate(items):
        for w in windows(words(text), n):
            key = _padded(w)
            if key not in at:
                at[key] = len(owners)
                owners.append([])
                found.add_word(key, (at[key], len(w)))
            if owners[at[key]][-1:] != [i]:
                owners[at[key]].append(i)
    found.make_automaton()
    return found, owners


def scan(text: str | None, automaton, owners) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words in the text, runs of hit words as (first, last + 1), items met)."""
    ws = words(text)
    runs: list[tuple[int, int]] = []
    items: set[int] = set()
    if not ws or not owners:
        return len(ws), runs, items
    ends = None
    for end, (k, size) in automaton.iter(_padded(ws)):
        if ends is None:
            ends, total = [], 0
            for w in ws:
                total += len(w) + 1
                ends.append(total)  # place of the space after the word
        last = bisect_left(ends, end) + 1
        items.update(owners[k])
        first = last - size
        # matches come by end, not by start: a long one may reach back over several runs
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append((first, last))
    return len(ws), runs, items


def _char_spans(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Sorted runs of words as code points of the text; each byte is decoded once."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    byte = char = 0
    out = []
    for a, b in runs:
        place = []
        for to in (at[a][0], at[b - 1][1]):
            byte, char = to, char + len(raw[byte:to].decode())
            place.append(char)
        out.append({"start": place[0], "end": place[1]})
    return out


def _blocks(items: list[tuple[str, str]], most_chars: int) -> list[tuple[tuple[str, str], ...]]:
    """Items in groups whose texts have at most ``most_chars`` characters together, one item at least."""
    out: list[list[tuple[str, str]]] = [[]]
    held = 0
    for item in items:
        if out[-1] and held + len(item[1]) > most_chars:
            out.append([])
            held = 0
        out[-1].append(item)
        held += len(item[1])
    return [tuple(x) for x in out]


class StoredBlocks:
    """Blocks of items as Parquet files in the shared folder, read one at a time by whoever goes through them."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count = folder, count

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[tuple[tuple[str, str], ...]]:
        files, path = fs.FileSystem.from_uri(self.folder)
        for b in range(self.count):
            found = [f.path for f in files.get_file_info(fs.FileSelector(f"{path}/block={b}", allow_not_found=True)) if f.path.endswith(".parquet")]
            rows = [r for f in sorted(found) for r in pq.read_table(f, filesystem=files, partitioning=None).to_pylist()]
            yield tuple(sorted((r["i"], r["t"]) for r in rows))


def _stored(wanted: DataFrame, size: int, most_chars: int) -> StoredBlocks:
    """Different items in blocks of about ``most_chars`` characters by a hash, written by Spark."""
    count = -(-size // most_chars)
    place = scratch_path(wanted.sparkSession, "benchmark-blocks")
    dealt = wanted.distinct().withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(count)))
    dealt.repartition("block").write.partitionBy("block").parquet(place)
    return StoredBlocks(place, count)


def scan_all(texts: list[str | None], blocks: list[tuple[tuple[str, str], ...]] | StoredBlocks, n: int) -> list[dict]:
    """n_words, n_hit, items and hit_spans of each text. Blocks are the outer loop: one automaton is held at a time and
    scans all texts."""
    total, runs, met = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for block in blocks:
        if len(blocks) > 1:
            _automaton.cache_clear()  # else two are held while one is built
        automaton, owners = _automaton(block, n)
        for i, text in enumerate(texts):
            total[i], some, found = scan(text, automaton, owners)
            runs[i] += some
            met[i] |= {block[k][0] for k in found}
    if len(blocks) > 1:
        runs = [_merged(r) for r in runs]
    return [
        {"n_words": t, "n_hit": sum(b - a for a, b in r), "items": sorted(m), "hit_spans": _char_spans(text, r) if r else []}
        for text, t, r, m in zip(texts, total, runs, met, strict=True)
    ]


def find_items(
    docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_chars: int = 500_000, most_item_chars: int = 64_000_000, held_bytes: int = 32 << 20,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted strings) and hit_spans (code points, end exclusive) added.

    The items' size is summed first. Up to ``most_item_chars`` they come to the driver and are sent to the executors; beyond,
    Spark writes them to the shared folder in blocks, and workers read these one at a time. Up to ``block_chars`` characters they are one automaton
    (some 200 MB), built once a worker; texts are scanned batch by batch. Beyond, a worker holds one block's automaton at a time
    and ``held_bytes`` of texts, which all blocks scan in turn: a block is built once for so many bytes.
    Columns of the same names as the added ones are replaced. Null or empty texts have no words. Null or empty items
    have no window; a null item id counts as "".
    """
    spark = docs.sparkSession
    ready(spark)
    wanted = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    size = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = _blocks(sorted(tuple(x) for x in wanted.collect()), block_chars) if size <= most_item_chars else _stored(wanted, size, block_chars)
    blocks = spark.sparkContext.broadcast(parts)
    most = held_bytes if len(parts) > 1 else 0

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = scan_all([x.as_py() for batch in held for x in batch.column(text_at)], blocks.value, n)
        done = 0
        for batch in held:
            extra = pa.RecordBatch.from_pylist(rows[done : done + batch.num_rows], schema=ADDED)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra.columns], names=[*batch.schema.names, *ADDED.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from told(held)
                held, size = [], 0
        if held:
            yield from told(held)

    kept = docs.drop(*ADDED.names)
    text_at = kept.columns.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_words long, n_hit long, items array<string>, hit_spans array<struct<start:long,end:long>>"])
    return kept.mapInArrow(lean(run), schema)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


ADDED = pa.schema([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("hit_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
