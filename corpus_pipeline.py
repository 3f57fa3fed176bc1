"""Corpus pipeline: STAGES applied one after another to documents, each written as Parquet and read again.

toxicity (documents that it rejects go), line dedup, n-gram Jaccard join (one document of each group stays), suffix-array dedup, best-fit
packing. All but the last return the columns of documents. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from tributary.llm.common import materialize
from tributary.llm.queries import documents, tokenizer


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, n_chars counted anew where there is one."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by two thirds of the labels, predicts as toxic go. Null and empty texts score 0 and stay, as do null ids; repeated rows go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.flagged(docs, labels).where("predicted = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document all of whose text went goes with it. Null texts stay; a null id comes last; rows equal in id and text lose the same lines."""
    out = line_dedup.deduplicate_lines(docs, short=True)
    return _like(docs, out.where("n_removed = 0 OR length(trim(text)) > 0"))


def _number(mark):
    """64 bits of a mark, as the n-gram join takes ids."""
    return F.conv(F.substring(mark, 1, 16), 16, -10).cast("long")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays: that with the smallest id, null last, and of equal ids with the least SHA-256 of id and text.

    Rows equal in id and text are one document, of which one row stays (compared by their values); rows without n-grams all stay. A row is told by the SHA-256 of its id and text; should the 64 bits of two
    different rows be equal that the join goes by, neither goes. Columns stay whatever they are called.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.sha2(F.concat(F.col("doc_id").isNull().cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text").isNull().cast("string"), F.lit(":"), text), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark.alias("mark"), "doc_id", "text")
    found = ngram_join.ngram_components(rows.select(_number(F.col("mark")).alias("number"), "text"), id_col="number").where("n_shingles > 0")
    at = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")
    marks = rows.groupBy("mark").agg(F.first(at).alias("at"), F.count("*").alias("times")).withColumn("number", _number(F.col("mark")))
    groups = found.groupBy("number").agg(F.min("component_id").alias("component"))
    told = materialize(marks.join(groups, "number"), "marks")
    alone = told.groupBy("number").agg(F.count("*").alias("n")).where("n = 1").select("number")
    told = told.join(alone, "number")
    kept = told.groupBy("component").agg(F.min("at").alias("at")).select(F.col("at.mark").alias("mark"))
    gone = told.select("mark").join(kept, "mark", "left_anti")
    again = told.where("times > 1").select("mark")
    left = rows.join(gone, "mark", "left_anti")
    # of equal rows one is left; only such rows are grouped
    one = left.join(again, "mark", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "mark", "left_anti").unionByName(one).select("row.*")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document has too, in a string of 50 or more, go; a character that lost a byte goes whole, and nothing else. A null text is empty, a null id is larger than all, rows with equal ids take nothing from each other."""
    kept = suffix_dedup.remove_repeats(docs, whole_characters=True).withColumn("text", F.col("kept").cast("string"))
    return _like(docs, kept.where("n_removed = 0 OR length(trim(text)) > 0"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids in as few sequences as the packing finds. A null text is a document of its end id alone; null ids and repeated rows are packed like others."""
    pieces = packing.cut_pieces(docs, tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL expresses learned scores or the packing; tests/llm holds every stage against a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
