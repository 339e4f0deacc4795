"""A corpus made ready for training: quality, near duplicates, benchmark leaks, personal data, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. run() applies them.

Every stage takes nulls in any column, empty and very long texts, repeated rows, other columns and an empty table; what
becomes of them is said at each stage. Rows without a doc_id pass all stages that join by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import decontaminate, jaccard, packing, pii, quality
from trajecta.llm.common import collected, delete, new_table
from trajecta.llm.queries import pii_key, tokenizer
from trajecta.session import table

#: Near duplicates: words of a shingle, and the least similarity as a share of two whole numbers.
NEAR_WORDS, NEAR_NUMERATOR, NEAR_DENOMINATOR = 5, 80, 100


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labelled ones among them.

    Rows are judged one by one, a null text as an empty one; without labels all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that repeat a doc_id stay or go together; null and blank texts are near to nothing and stay.
    """
    return jaccard.keep_one(docs, NEAR_WORDS, NEAR_NUMERATOR, NEAR_DENOMINATOR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; rows of one doc_id go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format, under the session's key; n_chars follows the new text.
    Every row stays; a null text stays null, and so does its n_chars."""
    return pii.protect(docs, pii_key(spark)).selectExpr(*("char_length(text) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns)).to(docs.schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the curve, with the ids. A null or empty text has its end alone; rows that repeat a doc_id
    are each packed."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", pseudonymous),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage keeps for itself, and what it read, are deleted when its result is written; the last
    stage's result reads the table before it, which stays until the driver ends."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_table(spark)
        with collected(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read is not None:
            delete(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifier nor the packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None
