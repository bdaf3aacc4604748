"""Run folders made of a table of stats, for demonstrations and round trips."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.sources.records import hadoop_list
from evalquarry.sources.sinks import write_each


def stamp(settings: dict) -> str:
    """SRC37: the digest of what the demo data depends on."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run_documents(stats: DataFrame) -> dict[str, DataFrame]:
    """The four documents of each run as (run, doc) with JSON text.

    ``stats`` has run, metric, split, perturbation, count, mean, instance_id, trial and row_ord. A
    run's documents are gathered per run: a run is one unit of evaluation and bounded by it.
    """
    name = F.struct(F.col("metric").alias("name"), "split", F.when(F.col("perturbation").isNotNull(), F.struct(F.col("perturbation").alias("name"))).alias("perturbation"))
    run = F.concat(F.lit("bench:user="), F.col("run").cast("string")).alias("run")
    text = lambda c: F.to_json(c).alias("doc")
    one = F.struct(name.alias("name"), "count", "mean")
    spec = stats.select("run").distinct().select(run, text(F.struct(F.concat(F.lit("bench:user="), F.col("run").cast("string")).alias("name"), F.struct(F.concat(F.lit("class"), (F.col("run") % 3).cast("string")).alias("class_name")).alias("scenario_spec"), F.struct(F.concat(F.lit("org/m"), (F.col("run") % 5).cast("string")).alias("model")).alias("adapter_spec"))))
    listed = stats.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("row_ord", one.alias("s")))).alias("x")).select(run, text(F.transform("x", lambda x: x["s"])))
    per = stats.groupBy("run", "instance_id", "trial").agg(F.array_sort(F.collect_list(F.struct("row_ord", one.alias("s")))).alias("x"))
    per = per.select("run", F.struct(F.col("instance_id").cast("string").alias("instance_id"), F.col("trial").alias("train_trial_index"), F.transform("x", lambda x: x["s"]).alias("stats")).alias("i"))
    per = per.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("i.instance_id", "i.train_trial_index", "i.stats"))).alias("x")).select(run, text(F.col("x")))
    state = F.struct(F.struct(F.col("instance_id").cast("string").alias("id"), "split", F.struct(F.concat(F.lit("question "), F.col("instance_id").cast("string")).alias("text")).alias("input"), F.when(F.col("perturbation").isNotNull(), F.struct(F.col("perturbation").alias("name"))).alias("perturbation")).alias("instance"), F.col("trial").alias("train_trial_index"), F.struct(F.concat(F.lit("prompt "), F.col("row_ord").cast("string")).alias("prompt")).alias("request"))
    states = stats.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("row_ord", state.alias("s")))).alias("x")).select(run, text(F.struct(F.transform("x", lambda x: x["s"]).alias("request_states"))))
    return {"run_spec": spec, "stats": listed, "per_instance_stats": per, "scenario_state": states}


def build(stats: DataFrame, root: str, settings: dict | None = None, suite: str = "v1") -> str:
    """SRC37: write the run folders below ``root``/benchmark_output/runs/``suite`` unless a stamp of equal settings is there; the root.

    Documents are written by tasks through Hadoop's commit, one folder per run, and moved into
    place by the driver, which handles names only.
    """
    spark = stats.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    key = stamp({"suite": suite} | (settings or {}))
    mark = f"{root}/.stamp-{key}"
    if hadoop_list(spark, mark):
        return root
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    base = f"{root}/benchmark_output/runs/{suite}"
    fs.mkdirs(path(base))
    for name, docs in run_documents(stats).items():
        write_each(docs.select(F.col("run").alias("key"), F.col("doc").alias("value")), base, f"{name}.json")
    fs.create(path(mark)).close()
    return root
