"""Training-data pipeline over ``documents``: five stages, each a whole-table operator whose
decisions take effect before the next one reads.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of its
input; the last one adds the token ids.  Documents without an id pass every stage that judges
texts and are never near copies of others; null and empty texts go where each operator's
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.decontamination import decontaminate
from rollframe.llm.jaccard_join import jaccard_classes
from rollframe.llm.line_dedup import line_dedup
from rollframe.llm.quality_classifier import quality_classifier
from rollframe.llm.sentencepiece import piece_encode
from rollframe.llm.work import read_table, written

#: Near copies: five-word shingles, similarity of 80 in 100 or more.
SHINGLE_WORDS, SIMILAR, OF = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    scored = quality_classifier(docs, read_table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` follows."""
    cleaned = line_dedup(docs, "source", "text")
    n = F.when(F.col("n_dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by links of any length, the document with the smallest id;
    of repeated rows one."""
    found = jaccard_classes(docs, words=SHINGLE_WORDS, num=SIMILAR, den=OF)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    once = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return once.unionByName(kept.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    marked = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.where("n_hit = 0").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    return piece_encode(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", benchmark), ("piece encoding", pieces)]

#: The classifier and the piece encoder have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
