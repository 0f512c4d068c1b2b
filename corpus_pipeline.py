"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage works on all that the one before it kept, and reads it from a Parquet table in the shared
folder, which goes once the next one is written.  All but the last return the columns of their input:

1. language: drops texts without letters and those that no learned language explains.
2. near_duplicates: keeps the document with the smallest id of each group that five-word shingles of
   similarity 0.8 link.
3. decontamination: drops documents that hold a passage of the benchmark.
4. personal_data: replaces personal data by masks and counts ``n_chars`` anew.
5. packing: the pieces of all remaining documents in sequences.

Nulls, empty and very long texts, repeated rows and empty tables are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuboid.llm import common, decontam, jaccard, langid, packing, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_words=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: No stage but the joins of the second can be said in SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last one's."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
