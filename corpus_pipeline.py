"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. quality classifier: documents that it rejects go;
2. line dedup: lines similar to an earlier line are taken out of the texts;
3. MinHash near-dedup: one document of each near-duplicate component stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. BPE encoding and decoding: the ids of each text left, and what they decode to.

All stages but the last return the columns of ``documents``. A null text counts as empty; it is
scored like any other and passes the later stages unchanged. The first stage is a
trained model, so SQL can't express the rows of ``run``; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmark.llm import bpe, decontamination, linededup, neardup, quality
from postmark.llm.tables import read, release, shared_dir, store

STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", linededup.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontamination.stage),
    ("bpe_codec", bpe.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; what a stage returns is written to the shared folder before the next reads it."""
    folder = shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, folder, name)
            release(spark)
    return docs
