"""A corpus from raw documents: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, langid, linededup, neardup, packing
from gridloom.llm.common import crc_remainder, cut, read, remove, scratch, shared_dir

#: Documents whose best language is less likely than this are rejected, as are those without letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model is sure of; lang, the label, stays as it is."""
    held = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    model = langid.fit(docs.where(~held))
    said = langid.predict(docs, model, keep=tuple(docs.columns), names=("_stage_lang", "_stage_score"))
    return said.where((F.col("_stage_lang") != langid.UNDETERMINED) & (F.col("_stage_score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines; documents of which nothing is left go."""
    n = "_stage_dropped"
    found = linededup.dedup_lines(docs, counts=("_stage_lines", n)).where((F.col(n) == 0) | (F.trim("text") != ""))
    return found.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """With _stage_id, the doc_id; rows without one, each its own, a number beyond all ids. Rows that share an id are one document."""
    stated = docs.where(F.col("doc_id").isNotNull()).withColumn("_stage_id", F.col("doc_id").cast("long"))
    without = docs.where(F.col("doc_id").isNull())
    if without.isEmpty():
        return stated
    without = cut(without.withColumn("_stage_n", F.monotonically_increasing_id()))
    part = F.shiftright("_stage_n", 33)
    first, n = [], 0
    for p, c in sorted(tuple(r) for r in without.groupBy(part).count().collect()):  # as many rows as tasks wrote
        first += [F.lit(p), F.lit(n)]
        n += c
    low, high = stated.agg(F.min("_stage_id"), F.max("_stage_id")).first()
    spot = F.create_map(*first)[part] + F.col("_stage_n").bitwiseAND(F.lit((1 << 33) - 1))
    beyond = F.lit(-1 if high is None else high) + 1 + spot if (high or 0) + n < 2**63 - 1 else F.lit(low) - 1 - spot
    return stated.unionByName(without.withColumn("_stage_id", beyond.cast("long")).drop("_stage_n"))


def without(docs: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of numbered docs whose number is not among ``gone``."""
    gone = gone.select(F.col("doc_id").alias("_stage_gone")).distinct()
    return docs.join(gone, docs["_stage_id"] == gone["_stage_gone"], "left_anti").select(*columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group (five-word shingles, similarity 0.8). Rows that share an id
    are one document: they stay or go together."""
    rows = numbered(docs)
    found = neardup.near_duplicates(rows, neardup.Params(shingle=5, percent=80), id_col="_stage_id")
    return without(rows, found.where(~F.col("kept")), docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; rows that share an id stay or go together."""
    rows = numbered(docs)
    return without(rows, decontam.contaminated(rows, read(spark, sf_dir, "benchmark"), id_col="_stage_id"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.public_params())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near), ("benchmark", benchmark), ("packing", pack)]

#: Sketches, tokenizers and fitted models can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents. Each one's files, and what it wrote on the way, go when the next has
    been written; the last one's stay, as the result reads them."""
    docs, before = read(spark, sf_dir, "documents"), None
    top = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        here = f"{top}/{i}-{name}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            remove(before)
        before = here
    return docs
