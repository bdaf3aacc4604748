"""Cards: symbols in dependency order, sweeps, claims as boolean SQL and their reduction.

Card text is never executed: symbols and claims are SQL expressions over the sweep's columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.operators.joins import sweep


@dataclass
class Symbol:
    """A value, a list of sweep values, or an SQL expression of other symbols; ``type`` is a DDL type."""

    value: object = None
    sweep: list | None = None
    sql: str | None = None
    type: str | None = None
    depends_on: list[str] = field(default_factory=list)


@dataclass
class Card:
    title: str
    claim: str
    symbols: dict[str, Symbol]

    def replaced(self, overrides: dict[str, object]) -> Card:
        """CTL3: symbols with other values; lists replace sweeps, unknown names raise."""
        if unknown := set(overrides) - set(self.symbols):
            raise KeyError(f"unknown symbols: {sorted(unknown)}")
        new = {k: (Symbol(sweep=list(v), type=self.symbols[k].type) if isinstance(v, list) else Symbol(value=v, type=self.symbols[k].type)) for k, v in overrides.items()}
        return Card(self.title, self.claim, self.symbols | new)


def dependency_order(symbols: dict[str, Symbol]) -> list[str]:
    """CTL1: symbols after what they depend on; a cycle or an unknown name raises."""
    for k, s in symbols.items():
        if unknown := set(s.depends_on) - set(symbols):
            raise KeyError(f"{k} depends on unknown {sorted(unknown)}")
    try:
        return list(TopologicalSorter({k: s.depends_on for k, s in symbols.items()}).static_order())
    except CycleError as e:
        raise ValueError(f"symbols depend on each other: {e.args[1]}") from None


def resolve(card: Card, spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """CTL1, JOI20, CTL4: one row per sweep point with all symbols as columns."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    df = sweep({k: s.sweep for k, s in card.symbols.items() if s.sweep is not None}, spark)
    for k in dependency_order(card.symbols):
        s = card.symbols[k]
        if s.sweep is None:
            df = df.withColumn(k, F.expr(s.sql) if s.sql is not None else F.lit(s.value))
        if s.type:
            have = df.schema[k].dataType
            want = spark.createDataFrame([], f"x {s.type}").schema["x"].dataType
            if have != want and s.sql is None and s.value is not None and have.typeName() not in ("integer", "void") and want.typeName() != have.typeName():
                raise TypeError(f"{k} is {have.simpleString()}, not {s.type}")
            df = df.withColumn(k, F.col(k).cast(want))
    return df


def evaluated(points: DataFrame, claim: str, guard: str | None = None) -> DataFrame:
    """CTL2: status of each point: INCONCLUSIVE where the claim is null, fails to evaluate, or a guard holds."""
    try:
        cond = F.expr(claim).cast("boolean")
        points.select(cond).schema
    except Exception:
        return points.withColumn("status", F.lit("INCONCLUSIVE"))
    status = F.when(cond.isNull(), "INCONCLUSIVE").when(cond, "VERIFIED").otherwise("FALSIFIED")
    return points.withColumn("status", F.when(F.expr(guard), "INCONCLUSIVE").otherwise(status) if guard else status)


def reduce_verdicts(verdicts: DataFrame, how: str = "all", threshold: float | None = None) -> DataFrame:
    """AGG44, AGG45: one status with the counts and the percentage of each outcome."""
    if how == "fraction" and threshold is None:
        raise ValueError("the reduction fraction needs a threshold")
    c = verdicts.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("VERIFIED", "FALSIFIED", "INCONCLUSIVE")], F.count(F.lit(1)).alias("n"))
    v, f, i = (F.col(x) > 0 for x in ("verified", "falsified", "inconclusive"))
    rules = {
        "all": F.when(f, "FALSIFIED").when(i, "INCONCLUSIVE").otherwise("VERIFIED"),
        "any": F.when(v, "VERIFIED").when(i, "INCONCLUSIVE").otherwise("FALSIFIED"),
        "fraction": F.when(F.col("verified") / F.col("n") >= F.lit(threshold), "VERIFIED").otherwise("FALSIFIED"),
    }
    status = F.when(F.col("n") == 0, "INCONCLUSIVE").otherwise(rules[how])
    return c.select("*", status.alias("status"), F.round(F.try_divide(100 * F.col("verified"), F.col("n")), 6).alias("percent_verified"))


def remaining(points: DataFrame, done: DataFrame, key: str = "point") -> DataFrame:
    """AGG45: percentage of sweep points that are still to do."""
    j = points.select(key).join(done.select(key, F.lit(1).alias("d")).distinct(), key, "left")
    return j.agg(F.round(100 * F.count_if(F.col("d").isNull()) / F.count(F.lit(1)), 6).alias("percent_remaining"))


def evaluate(card: Card, spark: SparkSession, how: str = "all", threshold: float | None = None, overrides: dict | None = None, tables: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The verdict of every sweep point and the card's reduced status."""
    points = resolve(card.replaced(overrides or {}), spark, tables)
    verdicts = evaluated(points, card.claim)
    return verdicts, reduce_verdicts(verdicts, how, threshold)


def render(prototype: dict, models: list[str], tests: list[str], datasets: list[str], spark: SparkSession) -> DataFrame:
    """SNK13: a card document as JSON for each combination, patched with its three names."""
    points = sweep({"model": models, "test": tests, "dataset": datasets}, spark)
    base = [F.lit(str(v)).alias(k) for k, v in prototype.items() if k not in ("model", "test", "dataset")]
    return points.select("model", "test", "dataset", F.to_json(F.struct(*base, "model", "test", "dataset")).alias("card"))


def task_matrix(params: dict[str, dict]) -> dict[str, list]:
    """FLT20: ``node.param`` names with lists of values from ``node_params`` dictionaries."""
    return {f"{node.removesuffix('_params')}.{k}": v if isinstance(v, list) else [v] for node, d in params.items() if node.endswith("_params") for k, v in d.items()}


def sequestered(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """CTL8: a test split without its outcomes."""
    return {k: v for k, v in tables.items() if k not in ("stats", "per_instance_stats")}
