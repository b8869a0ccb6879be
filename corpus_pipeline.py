"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; ``run``
writes each stage's result as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from spindrift.llm.common import materialize, table
from spindrift.llm.jaccard import keep_one_of_each_group
from spindrift.llm.line_dedup import delete_repeated_lines
from spindrift.llm.mixing import sample_to_targets
from spindrift.llm.packing import pack_documents
from spindrift.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("mixing", sample_to_targets),
    ("packing", pack_documents),
]

#: Classifier scores and token ids can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: pieces of sequences (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
