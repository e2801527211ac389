"""A training corpus from raw documents: quality, line dedup, near-duplicate removal, mixing, tokenisation.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents, extra ones included, whatever their names.

Every stage gives an empty result for an empty table and takes texts of any length whole.  What it does with nulls, ties and
rows that repeat is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import digests
from tidemark.llm.line_dedup import kept_text
from tidemark.llm.mixing import mixed
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.quality import classify
from tidemark.llm.shared import stored, table

#: Near duplicates among documents: shingles of five words, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names under others, and the columns that bring the old names back."""
    away = {c: f"_own_{c}" for c in names if c in docs.columns}
    return docs.withColumnsRenamed(away), [F.col(away.get(c, c)).alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are.

    A null text is scored as an empty one; rows that repeat, or share a doc_id, are judged each by its own text; without two
    labels to learn from nothing reaches the threshold, and nothing is kept.
    """
    docs, back = _aside(docs, "score", "held_out", "predicted")
    return classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a smaller doc_id holds; ``n_chars`` is counted anew.

    A null text becomes an empty one; rows without doc_id stay as they are; rows that share a doc_id count as one document,
    so lines they have in common stay in each; a document may be left with an empty text, and stays.
    """
    docs, back = _aside(docs, "n_lines", "n_dropped")
    return kept_text(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of near copies.

    Texts without words link with nothing and stay; rows without doc_id are in no component and stay; of rows with one
    doc_id and one text a single one stays, and rows with one doc_id and several texts are one document, of which each
    text stays.
    """
    heads = jaccard_components(docs, SHINGLE, PERCENT).where("component_id = doc_id").select(F.col("doc_id").alias("id")).distinct()
    known = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    one = F.row_number().over(Window.partitionBy("id", "mark").orderBy("mark"))
    known = known.join(heads, "id", "left_semi").select("row", one.alias("place")).where("place = 1").select("row.*")
    return known.unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most.

    Null sources are a source of their own; documents without words are taken or not by their place like others; rows that
    repeat are documents of their own, each with its own number of copies.
    """
    return mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix; a null or empty text has no tokens, rows that repeat come each."""
    return digests(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Classifier, similarity join and tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
