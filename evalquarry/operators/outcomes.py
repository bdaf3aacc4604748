"""Accuracy cells, outcome buckets, derived rates and contingency of conditioned generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalquarry.functions.verify import safe_ratio

# Bucket names by (direct, one draft, mitigated).
BUCKETS = {
    "unaffected": (True, True, True),
    "iatrogenic_harm": (True, True, False),
    "recoverable_drag": (True, False, True),
    "persistent_drag": (True, False, False),
    "drag_helps_kept": (False, True, True),
    "drag_helps_lost": (False, True, False),
    "new_gain": (False, False, True),
    "robust_failure": (False, False, False),
}
# Regimes by (direct, one draft).
REGIMES = {"drag_failed": (True, False), "drag_kept": (True, True), "both_failed": (False, False), "drag_helps": (False, True)}


def accuracy(gen: DataFrame) -> DataFrame:
    """AGG10: per problem, null as wrong."""
    return gen.groupBy("id").agg(F.avg(F.coalesce("correctness", F.lit(False)).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"))


def conditioning_cells(conditioned: DataFrame, direct: DataFrame, keep: Column) -> DataFrame:
    """AGG11, FIL7, JOI3: raw and verdict-filtered accuracies, and the direct ones of the same problems.

    Both tables are read once and meet in one aggregate per problem.
    """
    right = F.coalesce("correctness", F.lit(False)).cast("double")
    both = conditioned.select("id", right.alias("r"), F.lit("c").alias("side"), F.coalesce(keep, F.lit(False)).alias("kept"))
    both = both.union(direct.select("id", right, F.lit("d"), F.lit(False)))
    side, kept = F.col("side"), F.col("kept")
    of = {"raw": side == "c", "filtered": kept, "direct": side == "d"}
    per = both.groupBy("id").agg(*[F.avg(F.when(c, F.col("r"))).alias(n) for n, c in of.items()])
    cells = {"raw": F.col("raw"), "filtered": F.col("filtered"), "direct_raw": F.when(F.col("raw").isNotNull(), F.col("direct")), "direct_filtered": F.when(F.col("filtered").isNotNull(), F.col("direct"))}
    row = per.agg(*[F.struct(F.lit(n).alias("cell"), F.avg(c).alias("accuracy"), F.count(c).alias("problems")).alias(n) for n, c in cells.items()])
    return row.select(F.inline(F.array(*cells)))


def pass_rates(gen: DataFrame, keys: list[str]) -> DataFrame:
    """AGG12: mean of parsed correctness; keys without any go."""
    return gen.groupBy(*keys).agg(F.avg(F.col("correctness").cast("double")).alias("rate"), F.count("correctness").alias("n")).where("rate IS NOT NULL")


def last_rates(rates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AGG13: the last of repeated keys."""
    return rates.groupBy(*keys).agg(F.max_by("rate", order).alias("rate"))


def bucket(direct: Column, one: Column, mitigated: Column, threshold: float = 0.5) -> Column:
    """AGG14."""
    at = [(c >= threshold) for c in (direct, one, mitigated)]
    out = None
    for name, key in BUCKETS.items():
        hit = (at[0] == key[0]) & (at[1] == key[1]) & (at[2] == key[2])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def observations(direct: DataFrame, one: DataFrame, mitigated: DataFrame) -> DataFrame:
    """JOI4: direct by id, the two others by id and draft key, driven by the mitigated rows."""
    name = lambda df, n: df.withColumnRenamed("rate", n)
    return name(mitigated, "mitigated").join(name(one, "one"), ["id", "draft"]).join(name(direct, "direct"), "id")


def joint_observations(gen: DataFrame, direct: Column, one: Column, mitigated: Column) -> DataFrame:
    """JOI4 where all three sides are rows of one table with a ``draft`` key: one aggregate and no join.

    The conditions choose the rows of a side; a row can be of several. If the table comes dealt by
    problem, nothing is moved again.
    """
    rate = lambda c: F.avg(F.when(c, F.col("correctness").cast("double")))
    right = F.when(direct, F.col("correctness").cast("double"))
    each = gen.groupBy("id", "draft").agg(rate(one).alias("one"), rate(mitigated).alias("mitigated"), F.sum(right).alias("s_"), F.count(right).alias("n_"))
    w = W.partitionBy("id")
    both = each.withColumn("direct", F.sum("s_").over(w) / F.nullif(F.sum("n_").over(w), F.lit(0))).drop("s_", "n_")
    return both.where("direct IS NOT NULL AND one IS NOT NULL AND mitigated IS NOT NULL").select("id", "draft", "mitigated", "one", "direct")


def bucket_counts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG14: all eight counts as columns, zero where none."""
    g = rows.groupBy(*(keys or []))
    return g.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def derived_rates(counts: DataFrame) -> DataFrame:
    """AGG15: accuracies, recovery, harm, preservation, gains and nets; null for an empty denominator."""
    c = {b: F.col(b) for b in BUCKETS}
    total = lambda *names: sum((c[n] for n in names[1:]), c[names[0]])
    n = total(*BUCKETS)
    failed, kept = total("recoverable_drag", "persistent_drag"), total("unaffected", "iatrogenic_harm")
    both = total("new_gain", "robust_failure")
    before = total("unaffected", "iatrogenic_harm", "drag_helps_kept", "drag_helps_lost")
    direct, one, mit = (safe_ratio(x, n) for x in (failed + kept, before, total("unaffected", "recoverable_drag", "drag_helps_kept", "new_gain")))
    r = {
        "n": n, "direct_acc": direct, "f1_acc": one, "mit_acc": mit, "recovery": safe_ratio(c["recoverable_drag"], failed), "iatrogenic": safe_ratio(c["iatrogenic_harm"], kept),
        "preservation": safe_ratio(total("unaffected", "drag_helps_kept"), before), "new_gain_rate": safe_ratio(c["new_gain"], both), "net_vs_f1": mit - one, "net_vs_direct": mit - direct,
        "drag_failed_den": failed, "drag_kept_den": kept, "both_failed_den": both,
    }
    rest = [x for x in counts.columns if x not in BUCKETS]
    return counts.select(*rest, *[(F.round(v, 6) if k.startswith(("direct", "f1", "mit", "rec", "iat", "pre", "new", "net")) else v.cast("long")).alias(k) for k, v in r.items()])


def roll_up(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """AGG17: bucket counts over several sets of keys in one pass (grouping sets)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def contingency(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AGG16, JOI5: per regime the four cells of two mitigations (a, b) and their accuracies."""
    regime = None
    for name, key in REGIMES.items():
        hit = ((F.col("direct") >= threshold) == key[0]) & ((F.col("one") >= threshold) == key[1])
        regime = F.when(hit, name) if regime is None else regime.when(hit, name)
    a, b = F.col("a") >= threshold, F.col("b") >= threshold
    cells = {"tt": a & b, "tf": a & ~b, "ft": ~a & b, "ff": ~a & ~b}
    return rows.groupBy(regime.alias("regime")).agg(*[F.count_if(v).alias(k) for k, v in cells.items()])


def phi(cells: DataFrame) -> DataFrame:
    """AGG16, AGG58: agreement and the phi coefficient of the summed cells; null where undefined."""
    s = cells.agg(*[F.sum(c).cast("double").alias(c) for c in ("tt", "tf", "ft", "ff")])
    d = F.expr("(tt + tf) * (ft + ff) * (tt + ft) * (tf + ff)")
    n = F.expr("tt + tf + ft + ff")
    return s.select(n.cast("long").alias("n"), F.round(F.expr("(tt + ff)") / n, 6).alias("agreement"), F.round(F.when(d > 0, F.expr("tt * ff - tf * ft") / F.sqrt(d)), 6).alias("phi"))


def matrix(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """AGG18, AGG59: a pivot with null for missing cells; the columns are given, so no pass finds them.

    A cell has one row; of several the largest value is taken.
    """
    return rows.groupBy(row).pivot(column, columns).agg(F.max(value))


def cohort_accuracy(gen: DataFrame, cohort: DataFrame) -> DataFrame:
    """JOI6: micro accuracy over the generations of the cohort's problems, null as wrong."""
    kept = gen.join(cohort.select("id").distinct(), "id", "left_semi")
    return kept.agg(F.count_if("correctness").alias("correct"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("problems"))


def mean_sem(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AGG21: mean and standard error; zero for a single value."""
    return rows.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.when(F.count(value) > 1, F.stddev_samp(value) / F.sqrt(F.count(value))).otherwise(0.0), 6).alias("sem"), F.count(value).alias("n"))


def ci95(rows: DataFrame, p: str, n: str) -> DataFrame:
    """AGG22, AGG23: half-width for the unweighted mean of proportions, over rows that are valid (FIL18)."""
    ok = rows.where((F.col(p) >= 0) & (F.col(n) > 0))
    return ok.agg(F.round(F.avg(p), 6).alias("mean"), F.round(1.96 * F.sqrt(F.sum(F.col(p) * (1 - F.col(p)) / F.col(n))) / F.count(F.lit(1)), 6).alias("ci95"), F.count(F.lit(1)).alias("k"))
