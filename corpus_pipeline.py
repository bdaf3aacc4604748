"""Corpus preparation: five stages over documents, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Texts that a stage changes get a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm.bagminhash import near_duplicates
from evalquarry.llm.common import materialise, table
from evalquarry.llm.decontam import leaks
from evalquarry.llm.langid import UNKNOWN, identify
from evalquarry.llm.line_dedup import dedup_lines
from evalquarry.llm.sp_bpe import encode_documents

#: A text is rejected if no language is likelier than this; the score of a guess among four is 0.25.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language the network can't tell, go."""
    return identify(docs).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters that three documents hold stay in the last of them alone.

    A document of which nothing but white space is left goes, unless it was so before.
    """
    done = dedup_lines(docs)
    empty = (F.col("n_dropped") > 0) & ~F.col("kept").rlike(r"\S")
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))}
    return done.where(~empty).select([changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-duplicate texts stays: that with the least doc_id.

    Null texts are nobody's copy and all stay; empty texts are copies of each other, as are rows that
    repeat an id and a text. A null id counts as larger than any other.
    """
    _, roots = near_duplicates(docs)
    # Who stays is settled by ids and digests; the texts are read once, for the last join.
    thin = docs.select("doc_id", F.unhex(F.md5("text")).alias("node")).where("node IS NOT NULL")
    rooted = thin.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.col("node").alias("at"))).alias("first")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_")
    first = materialise(rooted.groupBy("root").agg(least).select(F.col("first.at").alias("node_"), name("first.doc_id")), "first")
    whole = docs.select("*", F.unhex(F.md5("text")).alias("node_"), name("doc_id"))
    held = whole.where("node_ IS NOT NULL").join(first, ["node_", "id_"], "left_semi")
    # Rows that repeat the id and the text that stay are still copies of each other; they lie together after the join.
    kept = held.dropDuplicates(["node_", "id_"])
    return whole.where("node_ IS NULL").select(docs.columns).union(kept.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or re-parameterised, go.

    Null and empty texts hold none and stay; rows that repeat an id and a text go together.
    """
    packed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = leaks(packed, table(spark, sf_dir, "benchmark"), keep=["doc_id", "th"])
    gone = found.select(F.col("doc.doc_id").alias("g"), F.col("doc.th").alias("h")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["g"]) & (F.xxhash64(docs["text"]) == gone["h"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text and the digest of the text that they decode to; null and empty texts have no ids."""
    done = encode_documents(docs)
    return done.select("doc.*", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Language identification and encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
