"""From raw documents to packed training sequences.

Each stage calls one operator of ``periodlens.llm`` on all rows that the stage
before it kept; its rows are written as Parquet and reread before the next
stage.  All stages but the last return the columns of ``documents``.

Nulls: a document without text has no language and goes in the first stage; a
null ``doc_id`` is carried through (the near-duplicate stage keeps such a row
if no other row of its group has an id).  Empty tables give empty results.
Repeated rows are near-duplicates of each other, so one of them stays.  Extra
columns are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from periodlens.llm import decontam, langid, packing, pii, simhash
from periodlens.llm.common import Stages, read
from periodlens.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the fused evidence identifies."""
    return langid.accepted_rows(docs, "text", "lang", host_col="source", min_posterior=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near-duplicates."""
    return simhash.one_per_group(docs, "doc_id", "text", shingle_words=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, exact or edited."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"), min_score=0.5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs, "text", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    packed = packing.pack(docs, tokenizer_path(), length=1024, end_id=2, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Language model, tagger and tokenizer cannot be written in SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass every stage."""
    written = Stages(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        after = written.put(stage(spark, docs, sf_dir))
        if i:
            written.drop(docs)
        docs = after
    return docs
