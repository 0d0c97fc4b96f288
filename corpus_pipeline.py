"""From raw documents to packed training sequences.

Quality classifier, line dedup, near-duplicate removal, mixing of sources, packing. Each stage works on all that the stage
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.classifier import keep_good
from veilspark.llm.common import bound_batches, own_columns, read, written
from veilspark.llm.line_dedup import remove_spread_lines
from veilspark.llm.mixing import repeat_by_mix
from veilspark.llm.near_dedup import keep_one
from veilspark.llm.packing import pack_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns.

    Null and empty texts have a score like any other; repeated rows stay or go together; without labels of both kinds the
    score is the mean of the labels (0.5 without any, so nothing is kept); an empty table gives no rows."""
    bound_batches(spark)
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that spread over many sources; documents of which nothing but such lines was left go.

    Null, empty and blank texts stay as they are; a null source is a source of its own; of equal lines the one of the
    smallest doc_id stays (null last), and rows that repeat it keep it too; n_chars follows the text where lines went; an
    empty table gives no rows."""
    out = remove_spread_lines(docs).where("_n_removed = 0 OR _n_removed < _n_lines")
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, size).otherwise(F.col("n_chars")))
    return out.select(*own_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8.

    The smallest doc_id of a group stays, with all rows that repeat it; documents without an id, text or words stay; an
    empty table gives no rows."""
    bound_batches(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Texts without words (null, empty) have size 0 and are taken as often as every document of their source is; a null
    source is one source, the last; repeated rows share a decision; an empty table gives no rows."""
    return repeat_by_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids.

    Null and empty texts are the end id alone; rows that repeat (the mix makes some) are packed as often as they occur; a
    null doc_id stays null; an empty table gives no rows."""
    import public_tokenizers

    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier, MinHash and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
