"""Two-pass external shuffle into equal shards, in DataFrame operations only.

Pass one scatters every record to one of a number of buckets by a seeded hash of its record
number, so no key, text or source can make a bucket large. Pass two gathers one memory-sized
bucket at a time, puts it in record order and permutes it with Spark's ``shuffle`` (a
Fisher-Yates shuffle of a seeded Mersenne twister), then writes it. Bucket counts give each
bucket its offset in the global order, which is cut into shards whose row counts differ by one
at most (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalquarry.llm.common import table, text_of, work_path

SHARDS = 24
SEED = 20_011
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 50_000
#: Buckets whose counts are summed together.
BLOCK_BUCKETS = 4096
#: Offsets of so many buckets (20 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 500_000


def shuffle_buckets(records: DataFrame, path: str, *, size: Column, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Write ``records`` to ``path`` in random order; returns (bucket int, pos int, rec struct).

    ``size`` is the expression of a record's bytes; it only sets the number of buckets. A record
    number is the input's partition and position, so a scan that is run again gives the same
    buckets. Null columns, repeated rows and an empty table need no care: each row is a record.
    """
    spark = records.sparkSession
    n, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-int(total) // bucket_bytes), -(-n // bucket_rows))
    numbered = records.select(F.struct(*[records[c] for c in records.columns]).alias("rec")).withColumn("rid", F.monotonically_increasing_id())
    scattered = numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list(F.struct("rid", "rec")).alias("items"))
    ordered = gathered.sortWithinPartitions("bucket").select("bucket", F.array_sort("items", lambda a, b: F.when(a["rid"] < b["rid"], -1).when(a["rid"] > b["rid"], 1).otherwise(0)).alias("items"))
    mixed = ordered.select("bucket", F.shuffle("items", seed).alias("items"))
    out = mixed.select("bucket", F.posexplode("items").alias("pos", "item")).select("bucket", "pos", F.col("item.rec").alias("rec"))
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def assign_shards(shuffled: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard int, slot long, rec): the global order of ``shuffle_buckets`` cut into equal runs.

    Running sums are taken within blocks of BLOCK_BUCKETS buckets and over the blocks, so one task
    sees a row per block only. With fewer rows than shards the last shards are empty. Nulls need no
    rule: a record is placed by its bucket and position, whatever it holds.
    """
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("block", F.floor(F.col("bucket") / BLOCK_BUCKETS))
    so_far = lambda w: F.sum("c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")
    blocks = counts.groupBy("block").agg(F.sum("c").alias("c"))
    blocks = blocks.select("block", so_far(W.orderBy("block")).alias("before"), F.sum("c").over(W.partitionBy()).alias("n"))
    within = counts.select("bucket", "block", so_far(W.partitionBy("block").orderBy("bucket")).alias("inside"))
    offsets = within.join(blocks, "block").select("bucket", (F.col("before") + F.col("inside")).alias("offset"), "n")
    at, q, r = F.expr("offset + pos"), F.expr(f"n div {shards}"), F.expr(f"n % {shards}")
    small = counts.count() <= BROADCAST_BUCKETS
    placed = shuffled.join(F.broadcast(offsets) if small else offsets, "bucket").select("rec", at.alias("at"), q.alias("q"), r.alias("r"))
    long_run = "at < r * (q + 1)"
    return placed.select(
        F.expr(f"CAST(IF({long_run}, at div (q + 1), r + (at - r * (q + 1)) div greatest(q, 1)) AS INT)").alias("shard"),
        F.expr(f"CAST(IF({long_run}, at % (q + 1), (at - r * (q + 1)) % greatest(q, 1)) AS BIGINT)").alias("slot"),
        "rec",
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder ``shard=N`` per shard, rows in slot order."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23; null texts count as empty, repeated rows each get a slot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length(text_of()).cast("long") + F.lit(8)
    assigned = assign_shards(shuffle_buckets(docs, work_path(spark, "shuffle"), size=size))
    text = text_of(F.col("rec.text"))
    return assigned.select(
        F.col("rec.doc_id").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
