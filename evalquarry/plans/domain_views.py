"""Domain tables made of the star-schema tables, in Spark and, as text, in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gen(spark: SparkSession, sf: str) -> DataFrame:
    """Generations: lines as responses of orders as problems."""
    lines, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    numbered = lines.select("l_orderkey", number.cast("long").alias("response_id"), "l_quantity", "l_returnflag", "l_linestatus")
    j = numbered.join(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), numbered["l_orderkey"] == orders["o_orderkey"])
    return j.select(
        F.col("l_orderkey").alias("id"), "response_id", F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("alias"),
        F.when(F.col("l_linestatus") == "F", "stop").otherwise("length").alias("finish"), F.col("l_quantity").cast("int").cast("string").alias("answer"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("correctness"),
    )


GEN = f"""gen AS (
  SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS BIGINT) AS response_id,
    o_orderstatus AS source, o_orderpriority AS alias, CASE l_linestatus WHEN 'F' THEN 'stop' ELSE 'length' END AS finish,
    CAST(CAST(l_quantity AS INT) AS VARCHAR) AS answer, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS correctness
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Direct, one-draft and mitigated generations."""
    g = gen(spark, sf)
    return tuple(g.where(F.col("response_id") % 3 == k) for k in range(3))


PARTS = GEN + ", " + ", ".join(f"{n} AS (SELECT * FROM gen WHERE response_id % 3 = {k})" for k, n in enumerate(("direct", "onef", "mit")))


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """Run stats: events as stat rows of users as runs."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"))
    return e.select(
        F.col("event_id").alias("row_ord"), F.col("user_id").alias("run"), F.concat(F.element_at(F.array(F.lit("exact_match_"), F.lit("num_"), F.lit("air_"), F.lit("other:")), (F.col("k") % 4 + 1).cast("int")), F.col("event_type")).alias("metric"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("p"), (F.col("k") % 3).cast("string"))).alias("perturbation"), F.when(F.col("event_id") % 2 == 0, "test").otherwise("valid").alias("split"),
        (F.col("k") % 5).alias("count"), F.round("value", 2).alias("mean"), (F.col("event_id") % 10).alias("instance_id"), (F.col("event_id") % 3).alias("trial"),
    )


STATS = """stats AS (
  SELECT event_id AS row_ord, user_id AS run, (['exact_match_', 'num_', 'air_', 'other:'])[CAST(k % 4 + 1 AS INT)] || event_type AS metric,
    CASE WHEN k % 3 <> 0 THEN 'p' || CAST(k % 3 AS VARCHAR) END AS perturbation, CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'valid' END AS split,
    k % 5 AS count, round(value, 2) AS mean, event_id % 10 AS instance_id, event_id % 3 AS trial
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with tags: whole documents and their labels."""
    d, q = read(spark, sf, "documents").select("doc_id", "text", "lang", "source"), read(spark, sf, "labels")
    j = d.join(q, "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "incorrect").otherwise("unsure")
    body = F.concat(
        F.when(F.col("doc_id") % 4 == 0, "<think>so </think>").when(F.col("doc_id") % 4 == 1, "<think>so ").otherwise(""), F.coalesce("text", F.lit("")), F.lit(" \\boxed{"), (F.col("doc_id") % 7).cast("string"), F.lit("} \\boxed{ \\frac{"), (F.col("doc_id") % 5).cast("string"), F.lit("}{2}} "),
        F.lit("<overall_verdict> "), verdict, F.lit(" </overall_verdict><overall_verdict_1>"), verdict, F.lit("</overall_verdict_1><overall_verdict_2>"), F.when(F.col("toxic") == 0, "incorrect").otherwise("correct"), F.lit("</overall_verdict_2> [ANSWER]assert f("), (F.col("doc_id") % 9).cast("string"), F.lit(") == "), (F.col("doc_id") % 11).cast("string"), F.lit(" [/ANSWER]"),
    )
    return j.select("doc_id", "lang", "source", "quality", "toxic", body.alias("response"))


TEXTS = r"""texts AS (
  SELECT d.doc_id, lang, source, quality, toxic,
    concat(CASE d.doc_id % 4 WHEN 0 THEN '<think>so </think>' WHEN 1 THEN '<think>so ' ELSE '' END, text, ' \boxed{', CAST(d.doc_id % 7 AS VARCHAR), '} \boxed{ \frac{', CAST(d.doc_id % 5 AS VARCHAR), '}{2}} <overall_verdict> ',
      v, ' </overall_verdict><overall_verdict_1>', v, '</overall_verdict_1><overall_verdict_2>', CASE WHEN toxic = 0 THEN 'incorrect' ELSE 'correct' END, '</overall_verdict_2> [ANSWER]assert f(', CAST(d.doc_id % 9 AS VARCHAR), ') == ', CAST(d.doc_id % 11 AS VARCHAR), ' [/ANSWER]') AS response
  FROM documents d LEFT JOIN (SELECT * FROM labels) q ON d.doc_id = q.doc_id,
    LATERAL (SELECT CASE quality WHEN 1 THEN 'correct' WHEN 0 THEN 'incorrect' ELSE 'unsure' END AS v) t)"""
