"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir); docs are the rows that the stage before kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, pii, simhash
from tessera.llm.common import crc_mod, free, table
from tessera.session import checkpoint_dir, remove


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; texts that are null or have no letter go, as do all if no row has a lang.

    Learned from rows with a lang that are not held out by the digest of the id; rows without an id are
    told like others. Repeated rows and ties are each judged by their own text.
    """
    model = langid.fit(docs.filter(crc_mod() != 0), langid.default_vocabulary())
    others = tuple(c for c in docs.columns if c.lower() not in ("doc_id", "text"))
    out = free("lang_pred", docs.columns), free("score", docs.columns)
    told = langid.predict(docs, model, keep=others, with_text=True, out=out)
    return told.filter(F.col(out[0]) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id, of equal ids that with the least digest of its text.

    A null id counts as the least. Null and empty texts are one group. Of repeated rows one stays; rows of
    one id, or of none, with different texts are different documents.
    """
    return simhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains no benchmark item of five words or more.

    Rows are judged by their text, with or without an id, so all copies of a leak go; null and empty texts stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked in their texts: equal texts alike. Null texts stay null, empty ones empty."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of each row that is left; a null text counts as empty, a null id stays null."""
    return bpe.encode_frame(docs, bpe.default_vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: SQL has no language model, XXH64 or byte-pair merges: tests hold each stage against its own check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next, then dropped.

    The last stage's table stays, as the result reads it. An empty table gives an empty result.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
