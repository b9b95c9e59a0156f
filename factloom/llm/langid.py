"""Language ID: one Bloom filter of n-grams whose cells are language bitmasks (bit-sliced)."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relations import ranked
from .common import lean, ready, scratch_path, written

#: ASCII letters (A-Z as a-z) and all bytes of non-ASCII characters stay; the rest is a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
N = 4
#: Odd multipliers of the hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts as uint32, where each text's begin): windows of 4 bytes over words, a space between words."""
    folded = [b" " + b" ".join(t.encode().translate(FOLD).split()) + b" " if t else b"" for t in texts]
    counts = np.array([max(0, len(f) - N + 1) for f in folded], dtype=np.int64)
    flat = np.frombuffer(b"".join(folded) + b"\0" * N, dtype=np.uint8)
    codes = np.zeros(len(flat) - N + 1, dtype=np.uint32)
    for k in range(N):
        codes |= flat[k : k + len(codes)].astype(np.uint32) << np.uint32(8 * k)
    lengths = np.array([len(f) for f in folded], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    keep = np.ones(len(codes), dtype=bool)
    for k in range(1, N):  # windows that reach into the next text
        over = begins + lengths - k
        keep[over[(lengths >= k)]] = False
    keep[int(lengths.sum()) :] = False
    return codes[keep], np.concatenate([[0], np.cumsum(counts)])


def cells(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for m in MULTIPLIERS:
        h = codes.astype(np.uint64) * np.uint64(m)
        h ^= h >> np.uint64(29)
        h *= np.uint64(MULTIPLIERS[0])
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class LanguageFilter:
    """``planes[w][cell]`` holds the bits of languages 64*w and up; ``rates`` the false-positive rate of each language."""

    languages: list[str]
    planes: np.ndarray
    rates: np.ndarray

    @property
    def bits(self) -> int:
        return int(self.planes.shape[1]).bit_length() - 1

    @classmethod
    def build(cls, languages: list[str], profiles: dict[str, np.ndarray], bits: int) -> LanguageFilter:
        planes = np.zeros(((len(languages) + 63) // 64 or 1, 1 << bits), dtype=np.uint64)
        for i, language in enumerate(languages):
            for cell in cells(profiles.get(language, np.zeros(0, np.uint32)), bits):
                np.bitwise_or.at(planes[i // 64], cell, np.uint64(1 << (i % 64)))
        full = [((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        return cls(languages, planes, np.array(full) ** len(MULTIPLIERS))

    def counts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text and language, how many of the text's n-grams the language's filter holds."""
        out = np.zeros((len(starts) - 1, len(self.languages)), dtype=np.int64)
        if not len(codes):
            return out
        at = list(cells(codes, self.bits))
        some = np.flatnonzero(starts[1:] > starts[:-1])
        for w, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for cell in at[1:]:
                mask &= plane[cell]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.uint8)
                out[some, i] = np.add.reduceat(bit, starts[:-1][some], dtype=np.int64)
        return out

    def fair(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``counts`` without what false positives are expected to add."""
        n = np.diff(starts)[:, None]
        return np.clip((self.counts(codes, starts) - self.rates * n) / (1 - self.rates), 0, None)


class StoredFilters:
    """Filters of groups of languages, in the order of their names, as files in the shared folder: read one at a time."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count = folder, count

    def write(self, number: int, model: LanguageFilter) -> None:
        files, path = fs.FileSystem.from_uri(self.folder)
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{number}") as out:
            out.write(pickle.dumps(model))

    def __iter__(self) -> Iterator[LanguageFilter]:
        files, path = fs.FileSystem.from_uri(self.folder)
        for number in range(self.count):
            with files.open_input_stream(f"{path}/{number}") as held:
                yield pickle.loads(held.read())


def predict(filters: Iterable[LanguageFilter], texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text: the first by name of those with the most n-grams, and their share."""
    codes, starts = grams(texts)
    most, names = np.full(len(texts), -1.0), ["und"] * len(texts)
    for f in filters:
        if f.languages:
            fair = f.fair(codes, starts)
            best = fair.argmax(axis=1)
            own = fair[np.arange(len(texts)), best]
            for i in np.flatnonzero(own > most):
                names[i] = f.languages[best[i]]
            most = np.maximum(most, own)
    names = [x if has_letter(t) else "und" for x, t in zip(names, texts, strict=True)]
    score = np.clip(most / np.maximum(np.diff(starts), 1), 0, 1)
    return names, np.where([x == "und" for x in names], 0.0, score)


def slices(column: pa.Array, most: int) -> Iterator[list[str]]:
    """The texts of a column in lists of about ``most`` characters; null as ""."""
    part, held = [], 0
    for x in column:
        part.append(x.as_py() or "")
        held += len(part[-1])
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def sampled(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int | None, most_languages: int) -> tuple[list[str] | DataFrame, DataFrame]:
    """(languages by name, (lang, text) of about ``docs_per_language`` rows of each language, by a hash of the id; of all
    rows, if that is None). More than ``most_languages`` languages stay a table (lang)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"),
        ((F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))).alias("u"),
    )
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.limit(most_languages + 1).collect()}
    if not sizes:
        return [], rows.select("lang", "text")
    if len(sizes) > most_languages:
        counted = written(counted, "languages")
        if docs_per_language is None:
            return counted.select("lang"), rows.select("lang", "text")
        some = rows.join(counted, "lang").where(F.col("u") <= F.lit(float(docs_per_language)) / F.col("n"))
        return counted.select("lang"), some.select("lang", "text")
    if docs_per_language is None:
        return sorted(sizes), rows.select("lang", "text")
    share = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, min(1.0, docs_per_language / sizes[k]))])
    return sorted(sizes), rows.where(F.col("u") <= share[F.col("lang")]).select("lang", "text")


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_language: int | None = 4_000, profile: int = 6_000, bits: int = 19, most_languages: int = 1_024,
) -> LanguageFilter | StoredFilters:
    """Fit on a bounded sample: about ``docs_per_language`` rows of each language, by a hash of the id; None: on all rows.

    Their n-grams are counted on Spark; the ``profile`` most frequent ones of each language come to
    the driver, at most ``most_languages * profile`` numbers. Ties in counts go to the smaller n-gram. More languages
    are fitted in groups of so many by name, one after the other, each a filter in the shared folder.
    """
    ready(labelled.sparkSession)
    languages, sample = sampled(labelled, id_col, text_col, lang_col, docs_per_language, most_languages)
    if isinstance(languages, list) and not languages:
        return LanguageFilter.build([], {}, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}  # this task's languages
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def told(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            langs = pa.array(list(names), pa.string()).take(pa.array((keys >> np.uint64(32)).astype(np.int32)))
            return pa.RecordBatch.from_arrays([langs, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], dtype=np.uint64) << np.uint64(32)
            done = 0
            for texts in slices(batch.column(1), 250_000):
                codes, starts = grams(texts)
                parts.append(np.unique(np.repeat(langs[done : done + len(texts)], np.diff(starts)) | codes, return_counts=True))
                done, held = done + len(texts), held + len(parts[-1][0])
                if held > 500_000:
                    parts = [summed()]
                    held = len(parts[0][0])
                if held > 250_000:  # few of them repeat
                    yield told(*summed())
                    parts, held = [], 0
        if parts:
            yield told(*summed())

    counted = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("r", rank).where(F.col("r") <= profile).select("lang", "gram")

    def built(names: list[str], some: DataFrame) -> LanguageFilter:
        return LanguageFilter.build(names, {k: g["gram"].to_numpy().astype(np.uint32) for k, g in some.toPandas().groupby("lang")}, bits)

    if isinstance(languages, list):
        return built(languages, top)
    by_name = ranked(languages.withColumn("all", F.lit(0)), ["all"], ["lang"])
    grouped = written(by_name.select("lang", ((F.col("rank") - 1) / most_languages).cast("int").alias("part")), "language-groups")
    held = written(top.join(grouped, "lang"), "language-profiles")
    model = StoredFilters(scratch_path(labelled.sparkSession, "language-filters"), -(-grouped.count() // most_languages))
    for part in range(model.count):
        names = sorted(r["lang"] for r in grouped.where(F.col("part") == part).select("lang").collect())  # most_languages at most
        model.write(part, built(names, held.where(F.col("part") == part).select("lang", "gram")))
    return model


def most_likely(text_col: str = "text", width: float = 2.0):
    """The score that a text may have but for chance: its n-grams are about as many as its characters, so chance moves the
    share found by some 1 / sqrt(characters)."""
    return F.col("score") + width / F.sqrt(F.greatest(F.length(text_col), F.lit(1)))


def low_scores(
    labelled: DataFrame, model: LanguageFilter | StoredFilters, quantile: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_language: int | None = 4_000, most_languages: int = 1_024, bins: int = 1 << 16,
) -> dict[str, float]:
    """By language, the exact ``quantile`` of ``most_likely`` scores of ``train``'s rows: those that are told to be in
    their own language: one number a language. A language without such rows is left out. Between two scores it lies as
    SQL's percentile does.

    Equal scores are counted first; sums by bins of 1 / ``bins`` tell in which one or two bins the quantile is, and only
    these are put in order."""
    _, sample = sampled(labelled, id_col, text_col, lang_col, docs_per_language, most_languages)
    told = identify(sample, model).where("lang = lang_pred").select("lang", most_likely().alias("x"))
    counted = written(told.groupBy("lang", "x").agg(F.count("*").alias("n")), "language-scores").withColumn("bin", F.floor(F.col("x") * bins))
    own = Window.partitionBy("lang")
    sums = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(own.orderBy("bin")))
    sums = sums.withColumn("at", F.lit(quantile) * (F.sum("n").over(own) - 1)).withColumn("before", F.col("upto") - F.col("n"))
    near = sums.where((F.col("before") <= F.ceil("at")) & (F.col("upto") > F.floor("at"))).select("lang", "bin", "before", "at")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("lang", "bin").orderBy("x"))
    first = lambda place: F.min(F.when(F.col("reached") > place, F.col("x")))
    ends = counted.join(near, ["lang", "bin"]).withColumn("reached", upto).groupBy("lang", "at").agg(first(F.floor("at")).alias("low"), first(F.ceil("at")).alias("high"))
    return {r["lang"]: r["low"] + (r["at"] % 1) * (r["high"] - r["low"]) for r in ends.collect()}


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id counts as ""."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: LanguageFilter | StoredFilters, text_col: str = "text", slice_chars: int = 250_000) -> DataFrame:
    """``docs`` with lang_pred and score (share of the text's n-grams that the language holds) added.

    Every whole text is read. lang_pred is one of the model's languages, the first by name on a tie, or
    ``und`` if the text is null or has no letter, or the model knows no language; then score is 0.
    Columns of the added names are replaced.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = [np.zeros(0)]
            for texts in slices(batch.column(at), slice_chars):
                some, score = predict([sent.value] if isinstance(sent.value, LanguageFilter) else sent.value, texts)
                names += some
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double"]))
