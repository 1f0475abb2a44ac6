"""The corpus pipeline: raw documents to sampled piece sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm.common import table, written
from attestry.llm.convnet import keep_good
from attestry.llm.decontaminate import drop_leaks
from attestry.llm.linededup import drop_repeated_lines
from attestry.llm.nearcopies import drop_near_copies
from attestry.llm.pieces import encode_stage

#: (name, function of (spark, docs, sf_dir)): each works on all its predecessor kept, and all
#: but the last return the columns of documents.
STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece_encoding", encode_stage),
]

#: The classifier, the embedding's random walks and the sampled segmentations are beyond SQL;
#: tests/llm/test_llm_pipeline.py compares run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
