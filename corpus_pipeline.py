"""A corpus cleaned and tokenised in five stages, each of them one of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs.  All but the last return the columns of ``documents``, with decisions applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.decontaminate import decontaminate
from framelake.llm.graph import cut, fresh
from framelake.llm.language_id import UNDETERMINED, identify, learn
from framelake.llm.linear import fold_number
from framelake.llm.minhash_dedup import keep_first, near_duplicates
from framelake.llm.sentencepiece_fst import encode_documents
from framelake.llm.suffix_dedup import suffix_dedup

ORACLE_SQL = None  # stages learn a model, sign and encode; tests/llm/test_pipeline.py holds each against a brute-force version


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: texts without a letter, and texts whose two nearest codewords are about as near."""
    model = learn(docs.where(fold_number(4) != 2))
    # columns of any name pass, those that the operator adds included
    names = {c: c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)}
    judged = identify(docs.withColumnsRenamed(names), model)
    good = judged.where((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return good.select(*[F.col(a).alias(c) for c, a in names.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays."""
    return keep_first(docs, near_duplicates(docs, threshold=0.8)).select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what an earlier document has (50 bytes or more); documents of which nothing is left go.

    Where a cut falls inside a character, the character's remaining bytes go too.
    """
    null = fresh(docs, "null")
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = suffix_dedup(docs.withColumn(null, F.col("text").isNull()), width=50, carry=(*carry, null), whole_characters=True)
    text = F.col("kept").cast("string")
    done = done.where((F.col("n_removed") == 0) | (F.trim(text) != ""))
    made = {"doc_id": F.col("doc_id"), "text": F.when(~F.col(f"in_{null}"), text)} | {c: F.col(f"`in_{c}`") for c in carry}
    if "n_chars" in carry:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(text)).otherwise(F.col("in_n_chars"))
    return done.select(*[made[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as the model's pieces."""
    return encode_documents(docs.select("doc_id", "lang", "source", "n_chars", "text"), memory=150_000).select("doc_id", "lang", "source", "n_chars", "ids", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
