"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read back as the next stage's docs.  A stage's own
intermediate tables, and the rows of the stage before it, are deleted once it is
written.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from treeflow.llm.common import delete, scope, shared_dir, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject."""
    small_batches(spark)
    return quality.keep(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_first(docs)


def whole_characters(text: str | None, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the byte spans; a character goes only with all its bytes (one text; the stage is held against it)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lead = np.append((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, True)
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        while not lead[s]:
            s += 1
        while not lead[e]:
            e -= 1
        if e > s:
            out.append(raw[at:s])
            at = e
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated passages; every document stays.

    Texts are cut where the spans are found: a second Python function in the plan would
    have each core keep a second Python worker, with its memory, for all later stages."""
    found = suffix_dedup.remove_repeats(docs, whole=True)
    out = found.withColumn("__text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept").cast("string")))
    return out.select(*(F.col("__text").alias(c) if c == "text" else F.char_length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and decoded bytes."""
    return bpe.digests(bpe.encode_decode(docs, "text", ["doc_id"]))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]
#: SQL expresses neither compression bands nor order MinHash; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/treeflow/pipeline-{k}-{uuid.uuid4().hex}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
