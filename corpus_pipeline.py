"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlint_spark.llm import langid, quality
from adlint_spark.llm.common import cut_lineage, held_in, table
from adlint_spark.llm.mixing import mixed
from adlint_spark.llm.neardup import near_duplicates
from adlint_spark.llm.pieces import encode, load_vocabulary
from adlint_spark.llm.queries import MIX_MOST, MIX_WEIGHTS, TOKENIZERS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text stays if label 1 is at least this likely.
LEAST_QUALITY = 0.3
#: A text goes if no letter or no language can be told.
LEAST_LANGUAGE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1; it learns from labels outside its held-out fold.

    Null and empty texts are scored as texts without features; rows that repeat stay or go together; no rows give no rows.
    """
    labels = table(spark, sf_dir, "labels").filter(held_in(F.col("doc_id"), 5, 0))
    model = quality.train(docs, labels, "quality")
    return quality.with_score(docs.select(COLUMNS), model, "__score").filter(F.col("__score") >= LEAST_QUALITY).select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the classifier learns from text and lang outside its held-out fold.

    Null and empty texts, and those without a letter, go; rows that repeat stay or go together; no rows give no rows.
    """
    model = langid.train(docs.filter(held_in(F.col("doc_id"), 3, 1)))
    return langid.with_language(docs.select(COLUMNS), model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the least doc_id (null last); texts without words all stay.

    Decided by row: numbers stand as ids, so rows that repeat a doc_id or have none are compared like others. ``docs``
    must have the same rows in the same places whenever it is read, as tables and checkpoints do.
    """
    rows = docs.select(COLUMNS).withColumn("__row", F.monotonically_increasing_id())
    near = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).filter(~F.col("kept"))
    later = cut_lineage(near.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__set")))
    members = later.union(later.select("__set", "__set").distinct()).join(rows.select("__row", "doc_id"), "__row")
    least = members.groupBy("__set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__least"))
    gone = members.join(least, "__set").filter("__row <> __least").select("__row")
    return rows.join(gone, "__row", "left_anti").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and are sampled like others; rows that repeat count one by one; a null source is one of its own; no rows give no rows.
    """
    rows = mixed(docs.select(COLUMNS), MIX_WEIGHTS, MIX_MOST)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    return rows.filter("__copies > 0").select(*COLUMNS, copies.alias("__nth")).drop("__nth")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each text, and whether decoding them gives the text back. Null and empty texts have no ids; rows that repeat are encoded alike; no rows give no rows."""
    rows = encode(docs.select("doc_id", "source", "text"), load_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"), checked="round_trip")
    return rows.select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: Learnt models decide in these stages, which SQL can't express; tests hold each stage's rows against plain Python, the models' predictions given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is cut off at a checkpoint before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
