"""A corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``. A null id is one document like
any other, but takes no part in near duplicates; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, jaccard, langid, linededup, mixing
from factloom.llm.common import remove, scratch, scratch_path, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents are in none of the learned languages if they score, with a margin that shrinks with their length
#: (``langid.most_likely``), under SHARE of what all but the lowest LOW of all training rows of the predicted language
#: reach. The rest of SHARE is for numbers, keys and rare words.
LOW, SHARE = 0.01, 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or in no known language go. Profiles and scores are counted
    over every training row (those that op9's fold doesn't hold out), without a sample."""
    labelled = docs.where(~langid.held_out())
    model = langid.train(labelled, docs_per_language=None)
    told = langid.identify(docs, model)
    low = langid.low_scores(labelled, model, LOW, docs_per_language=None)
    share = F.create_map(*[F.lit(x) for k in sorted(low) for x in (k, SHARE * low[k])])[F.col("lang_pred")] if low else F.lit(None)
    return told.where((F.col("lang_pred") != "und") & (langid.most_likely() >= F.coalesce(share, F.lit(0.0)))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the newest only; documents of which no word is left go."""
    kept = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the row with the smallest id: rows count one by one, also those that share
    an id. Rows with a null id or without words stay."""
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    known = rows.where("doc_id IS NOT NULL")
    groups = jaccard.similar_documents(known, id_col="row").select("row", "component_id")
    # rows of one id come in the order of their hashes, so that reruns agree
    placed = known.select("row", F.struct("doc_id", F.xxhash64(*COLUMNS).alias("hash"), "row").alias("place")).join(groups, "row")
    firsts = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    kept = firsts.select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").unionByName(rows.where("doc_id IS NULL")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.find_items(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document's text and columns with its number of copies; documents of none go."""
    return mixing.mix(docs, keep=("text", "lang", "n_chars")).where("copies > 0")


STAGES = [
    ("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination), ("mixing sources", mixing_stage),
]

#: Language ID learns n-gram profiles, which SQL can't express; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        place = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):  # what a stage writes besides its result goes with its end
            docs = written(stage(spark, docs, sf_dir), name, place)
        if last:
            remove(spark, last)
        last = place
    return docs
