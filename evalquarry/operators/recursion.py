"""Traces of repeated runs, the bounded makeup loop and the round loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalquarry.operators.joins import uncovered


def per_step(traces: DataFrame) -> DataFrame:
    """AGG24: mean, population deviation and number of runs of each step; rows are (run_id, step, pass_at_1)."""
    return traces.groupBy("step").agg(F.round(F.avg("pass_at_1"), 6).alias("mean"), F.round(F.stddev_pop("pass_at_1"), 6).alias("std"), F.count("pass_at_1").alias("n_runs"))


def trace_summary(traces: DataFrame) -> DataFrame:
    """AGG24: the deepest step from 1 that all runs reached, its mean and the change from step 0."""
    n = traces.agg(F.count_distinct("run_id").alias("total"))
    s = traces.groupBy("step").agg(F.avg("pass_at_1").alias("mean"), F.count("pass_at_1").alias("runs")).crossJoin(F.broadcast(n))
    shared = F.when((F.col("runs") == F.col("total")) & (F.col("step") >= 1), F.col("step"))
    a = s.agg(F.max("total").alias("n_runs_completed"), F.coalesce(F.max(shared), F.lit(0)).alias("max_step_reached"), F.max(F.when(F.col("step") == 0, F.col("mean"))).alias("a0"), F.max_by("mean", shared).alias("am"))
    return a.select(F.coalesce("n_runs_completed", F.lit(0)).alias("n_runs_completed"), "max_step_reached", F.round("a0", 6).alias("acc_round_0"), F.round("am", 6).alias("acc_round_max"), F.round(F.col("am") - F.col("a0"), 6).alias("delta"), F.col("a0").isNull().alias("aggregate_failed"))


def pass_at_1(document: Column, alias: str = "overall") -> Column:
    """AGG25: from overall_stats, else the top level, else the overall source."""
    paths = ("$.overall_stats.pass_at_1", "$.pass_at_1", f"$.pass_at_k_by_source.{alias}.pass_at_k[0]")
    return F.coalesce(*[F.get_json_object(document, p).try_cast("double") for p in paths])


def makeup_seed(base: int, step: int, attempt: int) -> int:
    """STM9."""
    return base + step * 100_003 + (attempt + 1) * 1_009


def makeup(expected: DataFrame, rows: DataFrame, generate: Callable[[DataFrame, int], DataFrame], usable: Column, keep: Callable[[DataFrame, str], DataFrame], *, step: int = 0, attempts: int = 3, base_seed: int = 42) -> DataFrame:
    """STM9: generate again for problems without a usable row, at most so many times.

    ``generate(missing, seed)`` gives new rows; ``keep(df, name)`` writes and reads back, which cuts
    lineage after each attempt.
    """
    for attempt in range(attempts):
        missing = keep(uncovered(expected, rows, usable), f"missing-{step}-{attempt}")
        if missing.isEmpty():
            break
        rows = keep(rows.unionByName(generate(expected.join(missing, "id", "left_semi"), makeup_seed(base_seed, step, attempt)), allowMissingColumns=True), f"rows-{step}-{attempt}")
    return rows


def rounds(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame, str], DataFrame], steps: int = 16) -> DataFrame:
    """STM8: every round reads the one before; all rounds together with a ``round`` column."""
    current, every = start, start.withColumn("round", F.lit(0))
    for r in range(1, steps + 1):
        current = keep(step(current, r), f"round-{r}")
        if current.isEmpty():
            break
        every = every.unionByName(current.withColumn("round", F.lit(r)), allowMissingColumns=True)
    return every


def context_pipeline(drafts: DataFrame, variant: str, strategy: Callable, revise: Callable, solve: Callable) -> DataFrame:
    """STM10: cm_filter1 cleans drafts by a strategy before solving; cm_revise1 revises them first."""
    if variant == "cm_filter1":
        return solve(drafts.join(strategy(drafts).select("id", "strategy"), "id").where(F.coalesce(F.length("strategy"), F.lit(0)) > 0))
    if variant == "cm_revise1":
        return solve(revise(drafts))
    raise ValueError(f"unknown variant: {variant}")


def device_pools(ids: list[str], size: int) -> list[list[str]]:
    """ARR2: whole chunks of the given size; all ids if none is whole."""
    size = max(1, size)
    whole = [ids[i : i + size] for i in range(0, len(ids) - size + 1, size)]
    return whole or [list(ids)]


def device_pools_column(ids: Column, size: int) -> Column:
    n = F.size(ids)
    return F.when(n < size, F.array(ids)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(size)), lambda i: F.slice(ids, i + 1, size)))
