"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Places where a byte-level pattern ends a run whatever stands around it, and splits what follows alike from there on:
#: between anything and the ASCII blank after it, after a letter before a digit, mark or symbol, and after a digit before a
#: mark or symbol. Blanks are what both this module's and the vocabulary's classes take as such.
SAFE = regex.compile(r"\S(?=[\x20\t\n\r])|\p{L}(?=[0-9\p{P}\p{S}])|[0-9](?=[\p{P}\p{S}])")


def pieces(text: str, most: int) -> list[str]:
    """``text``, which holds no special string, in parts of about ``most`` characters, cut at safe boundaries only. A
    stretch without one (blanks, letters, digits or marks alone) stays whole: the vocabulary takes it as one run."""
    out, at = [], 0
    while len(text) - at > most:
        cut = None
        for reach in (2_000, most):
            low = max(at, at + most - reach)
            for m in SAFE.finditer(text, low, at + most):
                cut = m.end()
            if cut:
                break
        if cut is None:
            m = SAFE.search(text, max(at, at + most - 1))
            if m is None:
                break
            cut = m.end()
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def _special_strings(settings: dict):
    """A pattern of the strings that the tokenizer takes out of texts before it splits them; None if its texts can't be
    cut: its pattern is not the byte-level one, texts are normalised first, or such a string acts on its neighbours."""
    own, added = settings["pre_tokenizer"] or {}, settings["added_tokens"]
    if own.get("type") != "ByteLevel" or not own.get("use_regex", True) or own.get("add_prefix_space") or settings["normalizer"]:
        return None
    if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip")):
        return None
    longest_first = sorted((x["content"] for x in added), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")


def parts(text: str, most: int, special) -> tuple[list[str], int]:
    """(pieces to encode, special strings between them) of a text."""
    if special is None or len(text) <= most:
        return [text], 0
    found, n, at = [], 0, 0
    for m in special.finditer(text):
        found += pieces(text[at : m.start()], most)
        n, at = n + 1, m.end()
    return [x for x in found + pieces(text[at:], most) if x], n


@lru_cache(maxsize=4)
def _lengths_of(name: str):
    """(function from texts to token counts, pattern of its special strings or None if texts must stay whole), for a
    vocabulary file by name or path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if os.path.isabs(name):
        path = name
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)], None
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], _special_strings(json.loads(tokenizer.to_str()))


def count_tokens(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text",
    limit: int = 512, piece_chars: int = 50_000, batch_bytes: int = 500_000,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; other columns are left out.

    Texts are encoded whole: long ones in pieces cut where the tokenizer cuts anyway, and batches close
    at ``batch_bytes`` bytes of UTF-8, not at a row count, so that one batch needs the same memory
    whatever the texts. Special strings are taken out of long texts first, as the library does, and count one each, so no
    cut falls into one. Only plain byte-level vocabularies are cut; others take texts whole, and so does a stretch of
    letters, digits, marks or blanks alone, which the vocabulary takes as one run anyway.
    Null and empty texts count 0 bytes and 0 tokens; a null id stays null; repeated rows each count.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, special = _lengths_of(tokenizer)
        for batch in batches:
            column = batch.column(1)
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            part: list[str] = []
            owner: list[int] = []
            held = 0
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if not text:
                    continue
                cut, counts[i] = parts(text, piece_chars, special)
                for piece in cut:
                    part.append(piece)
                    owner.append(i)
                    held += len(piece.encode())
                    if held >= batch_bytes:
                        np.add.at(counts, owner, lengths(part))
                        part, owner, held = [], [], 0
            if part:
                np.add.at(counts, owner, lengths(part))
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
