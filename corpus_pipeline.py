"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the
shared folder as Parquet and read back as the next stage's docs. All but the last return
the columns of documents:

- language_id: documents without a language, or that no language explains, go
- line_dedup: repeated lines go, and documents of which nothing else was left
- near_dedup: of each group of near-duplicates the document of the smallest doc_id stays
- decontaminate: documents with a twentieth of their words in benchmark passages go
- pack: what is left is tokenised and packed into sequences of 4096 ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinloom.llm.common import materialize, table
from clinloom.llm.decontam import decontamination_stage
from clinloom.llm.langid import language_stage
from clinloom.llm.line_dedup import line_stage
from clinloom.llm.minhash import near_duplicate_stage
from clinloom.llm.packing import packing_stage

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("pack", packing_stage),
]

#: SQL expresses neither the network of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
