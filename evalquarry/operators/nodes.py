"""Experiment nodes as one-row metric tables, and the runner that materialises a pipeline of nodes.

A node is a function of DataFrames and returns one row; the runner keys each result by a digest of
the node's parameters and inputs, skips what is finished, and runs independent points side by side.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.operators import outcomes, recursion
from evalquarry.sources import sinks


def inference_eval(gen: DataFrame) -> DataFrame:
    """CTL6 smoke: pass@1 of a run as the micro mean of its responses, and its size."""
    right = F.coalesce("correctness", F.lit(False)).cast("double")
    return gen.agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n_responses"), F.count_distinct("id").alias("n_questions"))


def drag(direct: DataFrame, conditioned: DataFrame) -> DataFrame:
    """CTL6 drag, JOI6: direct accuracy on the problems that were kept, conditioned accuracy, and their difference.

    Nulls and ``aggregate_failed`` if no problem was kept.
    """
    clean = outcomes.cohort_accuracy(direct, conditioned)
    two = conditioned.agg(F.avg(F.coalesce("correctness", F.lit(False)).cast("double")).alias("acc_2f"), F.count_distinct("id").alias("n_kept_problems"))
    rate = F.when(F.col("n") > 0, F.col("correct") / F.col("n"))
    both = clean.select(rate.alias("acc_clean")).join(two)
    return both.select("acc_clean", "acc_2f", (F.col("acc_clean") - F.col("acc_2f")).alias("drag"), "n_kept_problems", (F.col("n_kept_problems") == 0).alias("aggregate_failed"))


def conditioning(direct: DataFrame, conditioned: DataFrame, keep: Column) -> DataFrame:
    """CTL6 conditioning, drag-1f and posthoc: direct less conditioned accuracy of the verdict-filtered problems."""
    cells = outcomes.conditioning_cells(conditioned, direct, keep)
    pick = lambda name, value: F.max(F.when(F.col("cell") == name, F.col(value)))
    row = cells.agg(pick("direct_filtered", "accuracy").alias("acc_direct"), pick("filtered", "accuracy").alias("acc_conditioned"), pick("filtered", "problems").alias("n_filtered"))
    return row.select("acc_direct", "acc_conditioned", (F.col("acc_direct") - F.col("acc_conditioned")).alias("delta_acc"), "n_filtered", (F.col("n_filtered") == 0).alias("aggregate_failed"))


def mitigation(counts: DataFrame) -> DataFrame:
    """CTL6 mitigation: the rates of one row of bucket counts."""
    r = outcomes.derived_rates(counts)
    return r.select(F.col("recovery").alias("recovery_rate"), F.col("iatrogenic").alias("iatrogenic_rate"), "net_vs_f1", "net_vs_direct", "drag_failed_den", F.col("n").alias("n_observations"), (F.col("n") == 0).alias("aggregate_failed"))


def distance(init: DataFrame, anchored: DataFrame) -> DataFrame:
    """CTL6 distance: macro means of the problems of either side (id, distance), their difference, and how many have both."""
    one = lambda df, n: df.groupBy("id").agg(F.avg("distance").alias(n))
    both = one(init, "init").join(one(anchored, "anchored"), "id", "full")
    return both.agg(F.avg("init").alias("mean_ted_direct"), F.avg("anchored").alias("mean_ted_2f"), F.count_if(F.col("init").isNotNull() & F.col("anchored").isNotNull()).alias("n_problems_with_both")).withColumn("ted_drag", F.col("mean_ted_direct") - F.col("mean_ted_2f"))


def recursive(traces: DataFrame) -> DataFrame:
    """CTL6 recursive, for both variants: the summary of the rounds."""
    return recursion.trace_summary(traces)


#: CTL6: the nodes by name.
NODES: dict[str, Callable[..., DataFrame]] = {"inference_eval": inference_eval, "drag": drag, "drag_1f": conditioning, "conditioning": conditioning, "posthoc": conditioning, "mitigation": mitigation, "distance": distance, "recursive_filter1": recursive, "recursive_naive": recursive}


@dataclass
class Node:
    """A step of a pipeline: ``run(spark, params, inputs)`` gives its table; inputs are the tables of ``after``."""

    run: Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]
    params: dict = field(default_factory=dict)
    after: list[str] = field(default_factory=list)


def key_of(name: str, nodes: dict[str, Node]) -> str:
    """The digest of a node's name, its parameters and those of all before it."""
    n = nodes[name]
    text = json.dumps([name, n.params, [key_of(a, nodes) for a in n.after]], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def dispatch(spark: SparkSession, nodes: dict[str, Node] | Callable, root: str, *, params: dict | None = None, skip_existing: bool = True, jobs: int = 4) -> dict[str, str]:
    """CTL5, STM11, STM15: run nodes in dependency order, those that are ready side by side; the path of each result.

    A function in place of nodes is a pipeline of one node. A finished result (its marker is there)
    of equal parameters is kept; a broken one is written again. The launcher holds at most ``jobs``
    Spark jobs open, which share the executors.
    """
    if callable(nodes):
        nodes = {nodes.__name__: Node(nodes, params or {})}
    paths = {name: f"{root}/{name}_id_{key_of(name, nodes)}" for name in nodes}

    def one(name: str) -> None:
        if not (skip_existing and sinks.complete(spark, paths[name])):
            sinks.write_dataset(nodes[name].run(spark, nodes[name].params, {a: spark.read.parquet(paths[a]) for a in nodes[name].after}), paths[name])

    order = TopologicalSorter({k: n.after for k, n in nodes.items()})
    order.prepare()
    with ThreadPoolExecutor(jobs) as pool:
        while order.is_active():
            ready = order.get_ready()
            list(pool.map(one, ready))
            order.done(*ready)
    return paths


def grid(spark: SparkSession, node: Node, matrix: dict[str, list], root: str, *, jobs: int = 4) -> DataFrame:
    """CTL7, STM11: one node over every point of a matrix; a table of the points with their results."""
    from itertools import product

    points = [dict(zip(matrix, v)) for v in product(*matrix.values())]
    if not points:
        raise ValueError("the matrix has no point")
    nodes = {f"point{i}": Node(node.run, node.params | p, []) for i, p in enumerate(points)}
    paths = dispatch(spark, nodes, root, jobs=jobs)
    out = None
    for name, p in zip(nodes, points):
        row = spark.read.parquet(paths[name]).select(*[F.lit(v).alias(k) for k, v in p.items()], "*")
        out = row if out is None else out.unionByName(row)
    return out


def suite_summary(results: DataFrame, card: str, value: str, claim: Column) -> DataFrame:
    """CTL7: one line per card: points, their mean value, and how many hold the claim."""
    return results.groupBy(card).agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(value), 6).alias("mean"), F.count_if(claim).alias("verified")).orderBy(card)
