"""Run tables: stat indexes, inventories, agreement of two runs, selection and joins of instance stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalquarry.functions import text as X

# Agreement thresholds and their labels.
AGREEMENT = ((0.995, "high"), (0.95, "medium"))


def stat_index(stats: DataFrame, keys: list[str], order: str, drop_zero: bool = False, need_mean: bool = False) -> DataFrame:
    """AGG54, FIL16: the last row of each key with its class and family."""
    rows = stats
    if drop_zero:
        rows = rows.where(F.col("count") != 0)
    if need_mean:
        rows = rows.where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    rest = [c for c in stats.columns if c not in (*keys, order)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s_")).select(*keys, "s_.*")
    return last.withColumn("class", X.metric_class(F.col("metric"))).withColumn("family", X.metric_family(F.col("metric")))


def inventory(index: DataFrame) -> DataFrame:
    """AGG31: histograms by class and by family, and the total, in one pass."""
    return index.groupingSets([[F.col("class")], [F.col("family")], []], "class", "family").agg(F.count(F.lit(1)).alias("n"))


def family_support(index: DataFrame, supported: Column) -> DataFrame:
    """AGG32: per class and support the families by falling count, with a signature of the content."""
    c = index.withColumn("supported", supported).groupBy("class", "supported", "family").agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "family"))), lambda s: F.concat(s["family"], F.lit("="), (-s["m"]).cast("string")))
    return c.groupBy("class", "supported").agg(F.sum("n").alias("total"), F.array_join(listed, ",").alias("families")).withColumn("signature", F.substring(F.sha2("families", 256), 1, 12))


def run_summary(stats: DataFrame, instances: DataFrame) -> DataFrame:
    """AGG33, AGG49: base instances, variants, most variants of a base and the counts of stats, in one row."""
    v = instances.groupBy("instance_id").agg(F.count_distinct("perturbation").alias("p"), F.max(F.col("perturbation").isNull().cast("int")).alias("plain"))
    a = v.agg(F.count(F.lit(1)).alias("bases"), F.sum(F.col("p") + F.col("plain")).alias("variants"), F.max(F.col("p") + F.col("plain")).alias("max_variants"))
    b = stats.agg(F.count(F.lit(1)).alias("stats"), F.count_if(F.col("count") != 0).alias("nonzero"), F.count("mean").alias("with_mean"))
    return a.crossJoin(b)


def close(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """AGG34: within the larger of both tolerances; exact where both are zero; null is no value."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def value_agreement(a: DataFrame, b: DataFrame, keys: list[str], absolute: float = 0.0, relative: float = 0.0, by: str | None = "class") -> DataFrame:
    """AGG34, AGG35, JOI10, JOI11: comparable and mismatched stats and their ratio, overall and by a column.

    Keys meet null-safely; the ratio is null where nothing can be compared.
    """
    r = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("mean").alias("mean_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    j = a.join(r, on).where("mean IS NOT NULL AND mean_b IS NOT NULL").withColumn("bad", ~close(F.col("mean"), F.col("mean_b"), absolute, relative))
    j = j.withColumn("group", F.explode(F.array(F.lit("overall"), F.col(by)))) if by else j.withColumn("group", F.lit("overall"))
    return j.groupBy("group").agg(F.count(F.lit(1)).alias("comparable"), F.count_if("bad").alias("mismatched")).withColumn("ratio", F.round(1 - F.col("mismatched") / F.col("comparable"), 6))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], n: int, group: list[str] | None = None) -> DataFrame:
    """SRT4, SRT5, SNK17: the n largest differences, of all or of each group."""
    j = a.join(b.select(*keys, F.col("mean").alias("mean_b")), keys).withColumn("delta", F.abs(F.col("mean") - F.col("mean_b"))).where("delta > 0")
    if group:
        return j.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("delta"), *keys))).where(F.col("rank") <= n)
    return j.orderBy(F.desc("delta"), *keys).limit(n)


def merge_means(stats: DataFrame, keys: list[str]) -> DataFrame:
    """AGG37: count-weighted mean over sub-splits; null where all counts are zero."""
    return stats.groupBy(*keys).agg(F.sum("count").alias("count"), F.round(F.try_divide(F.sum(F.col("mean") * F.col("count")), F.sum(F.when(F.col("mean").isNotNull(), F.col("count")))), 6).alias("mean"))


def matches(metric: str, split: str | None = None, perturbation: str | None = None) -> Column:
    """FIL10, FIL14: a metric-name matcher; ``*`` is a wild card, None no condition (no perturbation: null)."""
    star = lambda c, p: F.col(c).like(p.replace("%", r"\%").replace("_", r"\_").replace("*", "%")) if "*" in p else F.col(c) == p
    out = star("metric", metric)
    if split is not None:
        out = out & star("split", split)
    return out & (F.col("perturbation").isNull() if perturbation is None else star("perturbation", perturbation))


def unique_stat(stats: DataFrame, keys: list[str], matcher: Column, fallback: Column | None = None) -> DataFrame:
    """AGG38, AGG39: per run the merged stat and its case: ok, count_zero, ambiguous or no_match."""
    tagged = stats.withColumn("level", F.when(matcher, 1).when(fallback, 2) if fallback is not None else F.when(matcher, 1))
    runs = stats.select(*keys).distinct()
    best = tagged.where("level IS NOT NULL").groupBy(*keys).agg(F.min("level").alias("best"))
    used = tagged.join(best, keys).where("level = best")
    g = used.groupBy(*keys).agg(F.count_distinct("metric").alias("names"), F.sum("count").alias("count"), F.try_divide(F.sum(F.col("mean") * F.col("count")), F.sum("count")).alias("mean"))
    case = F.when(F.col("names").isNull(), "no_match").when(F.col("names") > 1, "ambiguous").when(F.col("count") == 0, "count_zero").otherwise("ok")
    return runs.join(g, keys, "left").withColumn("case", case).select(*keys, "case", F.when(F.col("case") == "ok", F.round("mean", 6)).alias("mean"))


def ratio_label(c: Column) -> Column:
    """AGG41."""
    out = F.when(c.isNull(), "unknown").when(c == 1, "exact")
    for limit, name in AGREEMENT:
        out = out.when(c >= limit, name)
    return out.otherwise("low")


def deployments_by(rows: DataFrame, group: str) -> DataFrame:
    """AGG29: number, whether any is deprecated and the sorted classes; a null group stays."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("deprecated", F.lit(False))).alias("any_deprecated"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """AGG30."""
    return rows.agg(F.count(column).alias("count"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"))


def joined_instance_stats(stats: DataFrame, states: DataFrame, order: str) -> DataFrame:
    """JOI8, JOI9: stats with the prompt of their request state.

    States are joined null-safely on instance, trial and perturbation, the first of duplicates; an
    unperturbed stat without one takes the only state of its instance and trial; else null.
    """
    key = ["instance_id", "trial", "perturbation"]
    first = states.groupBy(*key).agg(F.min_by("prompt", order).alias("prompt"))
    only = first.groupBy("instance_id", "trial").agg(F.count(F.lit(1)).alias("c"), F.first("prompt").alias("lone")).where("c = 1").drop("c")
    s, f = stats.alias("s"), first.alias("f")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}"))
    j = s.join(f, on, "left").select("s.*", "f.prompt")
    o = only.withColumnsRenamed({"instance_id": "oi", "trial": "ot"})
    back = j.join(o, j["instance_id"].eqNullSafe(o["oi"]) & j["trial"].eqNullSafe(o["ot"]) & j["perturbation"].isNull() & j["prompt"].isNull(), "left")
    how = F.when(F.col("prompt").isNotNull(), "exact").when(F.col("lone").isNotNull(), "fallback").otherwise("unmatched")
    return back.select(*stats.columns, F.coalesce("prompt", "lone").alias("prompt"), how.alias("matched"))


def requested_match(requested: dict[str, str], name: Column) -> Column:
    """FIL13, SRT7: struct(ok, exact, extra): the requested tokens are all in a run's name; extra tokens count against it."""
    have = X.run_tokens(name)
    ok = F.lit(True)
    for k, v in requested.items():
        if k != "benchmark":
            ok = ok & have[k].eqNullSafe(F.lit(v.replace("/", "_") if k == "model" else v))
    if "benchmark" in requested:
        ok = ok & (X.run_benchmark(name) == requested["benchmark"])
    extra = F.size(have) - len([k for k in requested if k != "benchmark"])
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), (extra == 0).alias("exact"), extra.alias("extra"))


def best_run(runs: DataFrame, requested: dict[str, str], name: str = "name") -> DataFrame:
    """SRT7: the matching run with the fewest extra tokens, then by name."""
    m = runs.withColumn("m_", requested_match(requested, F.col(name))).where("m_.ok")
    return m.orderBy("m_.extra", name).limit(1).drop("m_")


def linear_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """AGG52."""
    return rows.groupBy(*keys).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.regr_count(y, x).alias("n"))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """AGG36: one row: whether specs agree by digest, and key coverage by name and by name and count."""
    from evalquarry.operators.joins import coverage

    digest = lambda d: d.select(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in [*keys, "count", "mean"]]).alias("x")).agg(F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("h"))
    named = lambda d, p: d.select([F.col(c).alias(p + c) for c in d.columns])
    same = digest(a).crossJoin(digest(b).withColumnRenamed("h", "g")).select(F.col("h").eqNullSafe(F.col("g")).alias("identical"))
    return same.crossJoin(named(coverage(a, b, keys), "key_")).crossJoin(named(coverage(a, b, [*keys, "count"]), "count_"))
