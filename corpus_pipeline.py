"""A training-data pipeline: toxic documents out, near-duplicates out, personal data replaced,
sources mixed to their target weights, and the rest packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results, stage by stage. A null text is judged by the toxicity stage as a text without words is;
null and empty texts are one group of near-duplicates, of which one row stays; personal data are
replaced in whole texts and nulls stay null; a document without words has size 0 and still
gets its source's copies; packing gives it the end token alone. Rows with a null doc_id take part
throughout. Repeated rows are near-duplicates, so one stays; mixing may repeat a document again. Very
long texts are processed whole and only cut into pieces by packing. Extra columns are carried up to
packing whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import mixing, packing, pii, simhash, toxicity
from tidewell.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that reach their language's toxicity threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id. Groups link documents
    whose five-word shingles have a Jaccard similarity of 0.8 or more. They are found by the trie over op3's
    fingerprints, within 3 bits, and, as such copies differ in 4 to 12 bits of them or more, by MinHash
    bands besides; all candidates are compared exactly."""
    return simhash.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for personal data; n_chars is that of the new text."""
    return pii.pseudonymize(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, the fingerprints and the vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
