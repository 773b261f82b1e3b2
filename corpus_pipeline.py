"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the
shared folder and gives what is read back to the next stage. All but the last return the columns of
`documents`.
"""
from pyspark.sql import DataFrame, SparkSession

from mooring.llm import language, packing, pii, quality_rules, simhash
from mooring.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others go."""
    return language.keep(docs, language.learn(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules; others go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Near are texts whose fingerprints over three-word shingles differ in three bits or fewer, or that
    a chain of such texts joins. Null and empty texts have one fingerprint and are one group; of rows
    equal in id and text one stays; no rows give no rows.
    """
    return simhash.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars counted anew."""
    return pii.redact(docs, pii.learn(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence, token ids and source columns."""
    return packing.pack_documents(docs, ("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Language, near-duplicates, personal data and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
