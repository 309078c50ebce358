"""The corpus pipeline: stages that each call one operator of seriesloom.llm.

Language ID, line dedup, near-duplicate removal, benchmark decontamination, packing. Each
stage gets what the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import document_key, materialize, read_table
from seriesloom.llm.decontaminate import remove_contamination
from seriesloom.llm.langid import keep_identified, train_text_model
from seriesloom.llm.linededup import remaining, repeated_lines
from seriesloom.llm.nearcopies import near_duplicates
from seriesloom.llm.packing import pack_documents
from seriesloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go.

    Null, empty and very short texts say nothing and go; long texts are read whole; null
    languages and sources are no evidence. Repeated rows get the same verdict, ties go to
    the first language. Extra columns stay, whatever their names.
    """
    return keep_identified(docs, train_text_model(docs.select("text", "lang")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones hold; those left without text go.

    Null texts have no lines and stay; of equal lines the one of the least doc_id (null
    first) and place stays; repeated rows are one document and lose the same lines. Texts
    are cut up whole. Extra columns stay, whatever their names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # any names, also clashing ones
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    rows = docs.toDF(*names)
    texts = rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    gone = repeated_lines(texts).toDF("x_doc", "x_gone")
    out = rows.withColumn("x_doc", document_key(F.col(at["doc_id"]), F.col(at["text"]))).join(gone, "x_doc", "left").withColumn(at["text"], remaining(F.col(at["text"]), F.col("x_gone")))
    out = out.where(F.col("x_gone").isNull() | (F.trim(at["text"]) != ""))
    return _recounted(out, at).select(*names).toDF(*docs.columns)


def _recounted(rows: DataFrame, at: dict[str, str]) -> DataFrame:
    """With n_chars (where there is one) of the new text."""
    return rows.withColumn(at["n_chars"], F.char_length(at["text"]).cast("long")) if "n_chars" in at else rows


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates.

    Repeated rows leave one. Texts without words are no copies of each other and stay; rows
    without a doc_id go if they are near copies of one that has it. Extra columns stay,
    whatever their names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    rows = docs.toDF(*names)
    texts = rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    kept = near_duplicates(texts).where("kept").select(F.col("text_key").alias("x_key"))
    keyed = rows.withColumn("x_key", document_key(F.col(at["doc_id"]), F.col(at["text"])))
    return keyed.join(kept, "x_key", "left_semi").dropDuplicates(["x_key"]).select(*names).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of benchmark items; mostly contaminated ones go.

    Null and empty texts have no words and stay; every row is judged by itself, repeated
    ones alike; texts are read whole. Extra columns stay, whatever their names.
    """
    out = remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _recounted(out, {c: c for c in docs.columns}).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    Null and empty texts are one end token; long ones are cut into whole windows and a
    rest; repeated rows and ties are packed as any other row; extra columns are left out.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # language ID and packing can't be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
