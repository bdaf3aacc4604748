"""Predictors of run statistics: sampled train and test splits, prediction tables and examples.

A predictor sees the tables of the train runs and those of one test run without its outcomes, and
returns a table of predictions; this is compared with the outcomes by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalquarry.functions.verify import sum_squared
from evalquarry.operators.cards import sequestered
from evalquarry.operators.joins import null_safe
from evalquarry.operators.runs import linear_fit
from evalquarry.operators.tables import dcol

RUN = "run_spec.name"
INSTANCE = "scenario_state.request_states.instance.id"
STAT_INSTANCE = "per_instance_stats.instance_id"
#: Columns of a run prediction and their defaults, in order.
RUN_COLUMNS = {
    RUN: "string", "stats.name.split": "string", "stats.name.name": "string", "stats.count": "bigint", "stats.sum": "double", "stats.sum_squared": "double", "stats.min": "double",
    "stats.max": "double", "stats.mean": "double", "stats.variance": "double", "stats.stddev": "double", "stats.name.perturbation.name": "string", "stats.name.perturbation.computed_on": "string",
}
DEFAULTS = {"stats.count": 1, "stats.variance": 0.0, "stats.stddev": 0.0}
INSTANCE_COLUMNS = {RUN: "string", "per_instance_stats.instance_id": "string", "per_instance_stats.train_trial_index": "bigint", "per_instance_stats.stats.name.name": "string", "per_instance_stats.stats.mean": "double", "per_instance_stats.perturbation.name": "string"}


def drawn(names: DataFrame, name: str, n: int, seed: int) -> list[str]:
    """SMP4: the n names first by a seeded digest; raises if there are fewer. n is a parameter and small."""
    c = dcol(name)
    found = [r[0] for r in names.select(c.alias("x")).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "x")), "x").limit(n).collect()]
    if len(found) < n:
        raise ValueError(f"{n} names asked for, {len(found)} there")
    return found


@dataclass
class Predictor:
    """UDF2: override ``predict``; ``keep`` and ``keep_row`` choose runs (FIL9)."""

    num_example_runs: int = 3
    num_eval_samples: int = 20
    seed: int = 1
    #: Boolean columns over the run table: of the run document, and of the flat row. Both apply.
    keep: Column | None = None
    keep_row: Column | None = None

    def predict(self, train: dict[str, DataFrame], test: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError

    def selected(self, run_specs: DataFrame) -> DataFrame:
        """FIL9: the runs that both hooks keep."""
        for hook in (self.keep, self.keep_row):
            run_specs = run_specs.where(hook) if hook is not None else run_specs
        return run_specs

    def splits(self, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """SMP4: train tables of sampled runs, and tables of another run with sampled instances.

        ``tables`` has run_specs, and optionally scenario_state, stats and per_instance_stats.
        """
        specs = self.selected(tables["run_specs"])
        *train, test = drawn(specs, RUN, self.num_example_runs + 1, self.seed)
        of = lambda names: {k: (specs if k == "run_specs" else t).where(dcol(RUN).isin(names)) for k, t in tables.items()}
        seen = of([test])
        if "scenario_state" in seen:
            if seen["scenario_state"].limit(self.num_eval_samples).count() < self.num_eval_samples:
                raise ValueError("the test run has fewer request states than are to be sampled")
            ids = seen["scenario_state"].select(dcol(INSTANCE).alias("i")).distinct().orderBy(F.md5(F.concat(F.lit(f"{self.seed}:"), "i")), "i").limit(self.num_eval_samples)
            for name, column in (("scenario_state", INSTANCE), ("per_instance_stats", STAT_INSTANCE)):
                if name in seen:
                    seen[name] = seen[name].join(ids, dcol(column) == ids["i"], "left_semi")
        return of(train), seen

    def evaluate(self, tables: dict[str, DataFrame]) -> DataFrame:
        train, test = self.splits(tables)
        return compared(run_predictions(self.predict(train, sequestered(test))), test["stats"])


def _filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    there = [dcol(c).cast(t).alias(c) if c in df.columns else F.lit(DEFAULTS.get(c)).cast(t).alias(c) for c, t in columns.items()]
    return df.select(*there, *[dcol(c) for c in df.columns if c not in columns])


def run_predictions(df: DataFrame) -> DataFrame:
    """UDF3: predictions with all columns of run stats; what is not given has its default, sum_squared is sum²."""
    out = _filled(df, RUN_COLUMNS)
    given = dcol("stats.sum_squared")
    return out.withColumn("stats.sum_squared", sum_squared(given, dcol("stats.sum")))


def instance_predictions(df: DataFrame) -> DataFrame:
    """UDF3: the same for single instances."""
    return _filled(df, INSTANCE_COLUMNS)


def compared(predicted: DataFrame, stats: DataFrame) -> DataFrame:
    """JOI12: predicted and actual means by run, split, metric and every perturbation column of both; null meets null."""
    keys = [RUN, "stats.name.split", "stats.name.name", *[c for c in predicted.columns if c.startswith("stats.name.perturbation.") and c in stats.columns]]
    left = predicted.select(*[dcol(k) for k in keys], dcol("stats.mean").alias("predicted_mean"))
    right = stats.select(*[dcol(k) for k in keys], dcol("stats.mean").alias("actual_mean"))
    short = {k: k.replace("run_spec.name", "run_spec").replace("stats.name.perturbation.", "perturbation_").replace("stats.name.", "") for k in keys}
    return null_safe(left, right, [(k, k) for k in keys]).select(*[dcol(k).alias({"name": "stat_name"}.get(short[k], short[k])) for k in keys], "predicted_mean", "actual_mean")


def compared_instances(predicted: DataFrame, stats: DataFrame) -> DataFrame:
    """JOI13: the same for single instances."""
    keys = [c for c in INSTANCE_COLUMNS if c != "per_instance_stats.stats.mean" and c in stats.columns]
    left = predicted.select(*[dcol(k) for k in keys], dcol("per_instance_stats.stats.mean").alias("predicted_mean"))
    right = stats.select(*[dcol(k) for k in keys], dcol("per_instance_stats.stats.mean").alias("actual_mean"))
    return null_safe(left, right, [(k, k) for k in keys])


def percent_of(*parts: Column, seed: int) -> Column:
    """0, 0.01 ... 1 by a digest of the parts: a draw that is the same on every cluster."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 12), 16, 10).cast("long"), F.lit(101)) / 100


class RandomRun(Predictor):
    """UDF4: a random exact-match mean for the test run."""

    def predict(self, train: dict[str, DataFrame], test: dict[str, DataFrame]) -> DataFrame:
        return test["run_specs"].select(dcol(RUN), F.lit("valid").alias("stats.name.split"), F.lit("exact_match").alias("stats.name.name"), percent_of(dcol(RUN), seed=self.seed).alias("stats.mean"))


class RandomInstance(Predictor):
    """UDF4: a random exact-match value for each sampled instance and trial of the test run."""

    def predict(self, train: dict[str, DataFrame], test: dict[str, DataFrame]) -> DataFrame:
        keys = {RUN: RUN, INSTANCE: "per_instance_stats.instance_id", "scenario_state.request_states.train_trial_index": "per_instance_stats.train_trial_index"}
        rows = test["scenario_state"].select(*[dcol(a).alias(b) for a, b in keys.items()]).distinct()
        value = percent_of(*[dcol(b).cast("string") for b in keys.values()], seed=self.seed)
        return rows.select("*", F.lit("exact_match").alias("per_instance_stats.stats.name.name"), value.alias("per_instance_stats.stats.mean"))

    def evaluate(self, tables: dict[str, DataFrame]) -> DataFrame:
        train, test = self.splits(tables)
        return compared_instances(instance_predictions(self.predict(train, sequestered(test))), test["per_instance_stats"])


def specs_with_perturbed(run_specs: DataFrame, stats: DataFrame) -> DataFrame:
    """JOI15: perturbed stats with the columns of their run."""
    perturbed = stats.where(dcol("stats.name.perturbation.name").isNotNull())
    rest = [dcol(c) for c in perturbed.columns if c != RUN]
    return run_specs.join(perturbed.select(dcol(RUN).alias("r_"), *rest), dcol(RUN) == F.col("r_")).drop("r_")


class PerturbationRegression(Predictor):
    """UDF4, AGG52: a line of mean over a perturbation's strength in the train runs, read at the strength asked for."""

    strength: str = "stats.name.perturbation.prob"
    at: float = 0.5

    def predict(self, train: dict[str, DataFrame], test: dict[str, DataFrame]) -> DataFrame:
        rows = specs_with_perturbed(train["run_specs"].select(dcol(RUN)), train["stats"]).select(dcol("stats.name.name").alias("metric"), dcol("stats.name.split").alias("split"), dcol("stats.name.perturbation.name").alias("pert"), dcol(self.strength).alias("x"), dcol("stats.mean").alias("y"))
        fit = linear_fit(rows, ["metric", "split", "pert"], "x", "y")
        name = F.col("metric").alias("stats.name.name"), F.col("split").alias("stats.name.split"), F.col("pert").alias("stats.name.perturbation.name")
        (run,) = test["run_specs"].select(dcol(RUN)).first()
        return fit.select(F.lit(run).alias(RUN), *name, (F.col("intercept") + F.col("slope") * self.at).alias("stats.mean"))
