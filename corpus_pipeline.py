"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, folder), where ``folder`` holds the other tables, and
returns a DataFrame. All but the last return the columns of ``documents``. ``run`` writes every stage as Parquet to
the shared folder and reads it back, so that a lost executor costs at most a part of one stage.

1. quality: documents that the discriminant rejects (score below 0.7) go;
2. near_duplicates: one document of each group stays, the one with the smallest doc_id;
3. decontamination: documents with a twentieth or more of their words in benchmark windows go;
4. personal_data: validated values get pseudonyms, every document stays;
5. packing: the remaining documents as pieces placed in sequences of at most 2048 tokens.

Empty documents are judged by the quality model like any other; null texts count as empty. An empty table
passes through all stages and gives no rows. Extra columns of ``documents`` are handed on up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import bagminhash, decontaminate, packing, pseudonyms
from seriesloom.llm import quality as discriminant
from seriesloom.llm.common import table
from seriesloom.llm.queries import PSEUDONYM_KEY
from seriesloom.llm.shipping import ship
from seriesloom.session import store


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    return discriminant.accepted(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    return bagminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    return decontaminate.uncontaminated(docs, table(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, "byte_bpe_50k.json", end_id=0)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

# Learnt scores, signatures, keyed pseudonyms and token ids are not SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, folder), name)
    return docs
