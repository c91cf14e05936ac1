"""The training-data pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

All stages but the last return the columns that they were given. An empty table stays empty through all of them.
"""

from __future__ import annotations

import uuid

from pagetrail.llm.common import labels, shared_dir
from pagetrail.llm.exact_dedup import drop_exact_duplicates
from pagetrail.llm.mixing import mixed_documents
from pagetrail.llm.near_dedup import drop_near_duplicates
from pagetrail.llm.sentencepiece_fst import encode_documents
from pagetrail.llm.toxicity import drop_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that score 0.5 or more go. Null and empty texts are scored as empty; repeated rows stay or go together."""
    return drop_toxic(docs, labels(spark, sf_dir))


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the document with the largest id stays, and one of rows that repeat both. Null texts count as empty ones."""
    return drop_exact_duplicates(docs)


def near_dedup(spark, docs, sf_dir):
    """Of texts linked by five-word runs at 0.8 the document with the smallest id stays. Null and empty texts, and null ids, stay."""
    return drop_near_duplicates(docs)


def mixing(spark, docs, sf_dir):
    """A row for every time that the mix takes a document; the last one of a source may give its first words only. A null source is a
    source; documents without words are kept once."""
    return mixed_documents(docs)


def sentencepiece(spark, docs, sf_dir):
    """Token ids of every row of the mix: ``doc_id, token_ids, n_tokens``. Null and empty texts have none."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Boosted trees and token ids are beyond SQL: tests/llm compares the rows with a brute-force version of the stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn; intermediate tables go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
