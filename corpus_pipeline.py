"""A training-data pipeline over documents: low quality out, copies out, personal data masked, the rest packed.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the
last return the columns of `documents`; the last returns the pieces of the packed sequences. No SQL can say
the learned stages, so the pipeline is tested against a plain version of itself (tests/llm).

In every stage a null text counts as empty and stays null, a null id is no reason to drop a row, texts are read
whole, extra columns pass through whatever their names, and an empty table gives an empty result. What happens to
repeated rows and ties is said with each stage.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, near_dup, packing, pii, quality
from corpusloom.llm.tables import clear, materialise, read_table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; repeated rows score alike, so all or none of them stay."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))  # names can't clash
    scored = quality.classify(rows, read_table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id; of rows that repeat it, any one."""
    return exact_dedup.drop_exact(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar word 5-grams, the one with the least id.

    Rows that share an id go only if each of them is linked to a lesser one; rows without an id and texts without
    words stay.
    """
    return near_dup.drop_near(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the masked text, null for a null one."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences; repeated rows each get a place, empty texts one token."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage's rows are written, its own tables and the rows before them are deleted."""
    docs, begun = read_table(spark, sf_dir, "documents"), len(written)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, since=begun, keep=1)
    return docs
