"""Weighted flow graphs of rows through stages."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(rows: DataFrame, path: Column, weight: Column | None = None) -> DataFrame:
    """AGG43: summed weight between neighbours of each row's path; null stops are left out."""
    p = F.filter(path, lambda x: x.isNotNull())
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))).alias("src"), F.slice(p, 2, F.greatest(F.size(p), F.lit(1))).alias("dst"))
    e = rows.where(F.size(p) > 1).withColumn("w_", weight if weight is not None else F.lit(1)).select("w_", F.explode(pairs).alias("e_"))
    return e.groupBy(F.col("e_.src").alias("src"), F.col("e_.dst").alias("dst")).agg(F.sum("w_").alias("value"))


def stage_path(*stages: tuple[str, Column]) -> Column:
    """UDF5: labels ``stage: value``; a null value ends the path there."""
    return F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in stages])


def node_flow(e: DataFrame) -> DataFrame:
    """AGG43: what enters and leaves each node."""
    both = e.select(F.col("dst").alias("node"), F.col("value").alias("inflow"), F.lit(0).alias("outflow")).union(e.select("src", F.lit(0), "value"))
    return both.groupBy("node").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))


def listing(e: DataFrame, most: int, by: str = "value") -> DataFrame:
    """SRT11."""
    order = [F.desc("value"), "src", "dst"] if by == "value" else ["src", "dst"]
    return e.orderBy(*order).limit(most)


def node_order(e: list[tuple[str, str]]) -> list[str]:
    """SRT12: sources before targets; the order of appearance if there is a cycle."""
    graph: dict[str, set] = {}
    for a, b in e:
        graph.setdefault(a, set())
        graph.setdefault(b, set()).add(a)
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError:
        return list(graph)
