"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from attestry.llm.common import table
from attestry.llm.convnet import op8_quality
from attestry.llm.crosspolytope import op11_neighbours
from attestry.llm.decontaminate import op3_decontaminate
from attestry.llm.interleave import op5_interleave
from attestry.llm.licences import ORACLE as LICENCES_SQL
from attestry.llm.licences import op6_licences
from attestry.llm.linededup import op2_lines
from attestry.llm.periodic import op13_runs
from attestry.llm.pieces import op9_pieces
from attestry.llm.pitmanyor import op1_language_model
from attestry.llm.ranked import ORACLE as RANKED_SQL
from attestry.llm.ranked import op12_ranked
from attestry.llm.simhash import op7_simhash
from attestry.llm.suffixes import op10_repeats
from attestry.llm.topk import ORACLE as TOPK_SQL
from attestry.llm.topk import op4_topk


def over(name: str, operator: Callable[[DataFrame], DataFrame]):
    """A query that applies an operator to one whole table."""
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": over("documents", op1_language_model),
    "op2_lines": over("documents", op2_lines),
    "op3_decontaminate": op3_decontaminate,
    "op4_topk": over("embeddings", op4_topk),
    "op5_interleave": over("documents", op5_interleave),
    "op6_licences": op6_licences,
    "op7_simhash": over("documents", op7_simhash),
    "op8_quality": op8_quality,
    "op9_pieces": over("documents", op9_pieces),
    "op10_repeats": over("documents", op10_repeats),
    "op11_neighbours": over("embeddings", op11_neighbours),
    "op12_ranked": op12_ranked,
    "op13_runs": over("documents", op13_runs),
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op4_topk": TOPK_SQL,
    "op6_licences": LICENCES_SQL,
    "op11_neighbours": over("embeddings", op11_neighbours),
    "op12_ranked": RANKED_SQL,
}
