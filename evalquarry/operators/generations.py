"""Packed and flat generation records: flattening, filters, pools and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalquarry.functions import text as X


def explode_generations(packed: DataFrame, task: str, max_length: int = 16384) -> DataFrame:
    """FLT1, ARR1: a row per generation with its final text and thinking status; empty lists give none."""
    g = f"{task}_generations"
    rows = packed.withColumn("g_", F.explode(g))
    names = [f.name for f in packed.schema[g].dataType.elementType.fields]
    split = X.thinking_split(F.col("g_.generated_response"), F.col(f"{task}_prompt"), max_length)
    return rows.select(*[c for c in packed.columns if c != g], *[F.col(f"g_.{n}").alias(f"{g}_{n}") for n in names], split["final"].alias(f"{task}_final"), split["status"].alias(f"{task}_thinking_status"))


def first_generation(packed: DataFrame, task: str, final: str, max_length: int = 16384) -> DataFrame:
    """FLT2: the first generation's final text beside the record."""
    g = F.element_at(f"{task}_generations", 1)
    split = X.thinking_split(g["generated_response"], F.col(f"{task}_prompt"), max_length)
    return packed.where(F.size(f"{task}_generations") > 0).withColumn(final, split["final"]).withColumn(f"{final}_thinking_status", split["status"])


def pack(gen: DataFrame, keys: list[str], into: str = "gens", order: str = "response_id") -> DataFrame:
    """D2 from D3: generations of each key as one array in order."""
    rest = [c for c in gen.columns if c not in keys]
    ordered = [order, *[c for c in rest if c != order]]
    return gen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias(into))


def expand_list_format(packed: DataFrame, gens: str) -> DataFrame:
    """FLT7: the five fields of each generation as columns."""
    return packed.select("*", F.inline(gens)).drop(gens)


def unpivot_drafts(wide: DataFrame, keys: list[str], drafts: int = 2) -> DataFrame:
    """FLT8: one draft per row; columns traj1, traj1_x and so on become traj1, traj1_x of each draft."""
    names = [c[len("traj1") :] for c in wide.columns if c.startswith("traj1")]
    structs = [F.struct(F.lit(k).alias("draft_no"), *[F.col(f"traj{k}{n}").alias(f"traj1{n}") for n in names]) for k in range(1, drafts + 1)]
    return wide.select(*keys, F.inline(F.array(*structs)))


def trajectory_id(id: Column, alias: Column, response_id: Column, round_: Column | None = None) -> Column:
    """FLT14."""
    return F.concat_ws("-", id.cast("string"), alias, response_id.cast("string"), *([F.concat(F.lit("round"), round_.cast("string"))] if round_ is not None else []))


def truncate(c: Column, n: int = 32_768) -> Column:
    """FLT15."""
    return F.substring(c, 1, n)


def usable(alias: str) -> Column:
    """FIL1."""
    return (F.col("alias") == alias) & (F.col("finish") == "stop") & (F.col("thinking_status") == "parsable_thinking")


def model_filter(gen: DataFrame, models: list[str] | None) -> DataFrame:
    """FIL2: all models if none are named."""
    return gen.where(F.col("alias").isin(models)) if models else gen


def split_filter(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """FIL3: rows whose id is in the split."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def pool_flags(gen: DataFrame, complete: bool = False, parsable: bool = False) -> DataFrame:
    """FIL4, AGG55: is_true per row; a null correctness is in the incorrect pool."""
    keep = F.lit(True)
    if complete:
        keep = keep & (F.col("finish") == "stop")
    if parsable:
        keep = keep & (F.col("thinking_status") == "parsable_thinking")
    return gen.where(keep).withColumn("is_true", F.coalesce("correctness", F.lit(False)))


def pools(gen: DataFrame) -> DataFrame:
    """AGG55: sorted response numbers of both pools of each problem."""
    flags = pool_flags(gen)
    return flags.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("is_true") == v, F.col("response_id")))).alias(n) for v, n in ((True, "correct"), (False, "incorrect"))])


def having_pools(gen: DataFrame, min_true: int, min_false: int, num_true: int = 0, num_false: int = 0) -> DataFrame:
    """FIL5: problems with enough of both pools; asks for no more than is certain."""
    if num_true > min_true or num_false > min_false:
        raise ValueError("a draft may not ask for more than each kept problem has")
    c = pool_flags(gen).groupBy("id").agg(F.count_if("is_true").alias("n_true"), F.count_if(~F.col("is_true")).alias("n_false"))
    return c.where((F.col("n_true") >= min_true) & (F.col("n_false") >= min_false))


def combinations(n: Column, k: int) -> Column:
    """AGG47: n over k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / F.lit(i + 1)
    return F.when(n < k, F.lit(0)).otherwise(F.round(out)).cast("long")


def seeded_rank(seed: int, keys: list[str], order: str, within: list[str]) -> Column:
    """SMP1 to SMP5: place of a row among its group by a hash of seed, key and order number."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(order).cast("string")))
    return F.row_number().over(W.partitionBy(*within).orderBy(h, order))


def draft_sample(gen: DataFrame, num_true: int, num_false: int, min_true: int, min_false: int, seed: int = 42) -> DataFrame:
    """SMP1, AGG57: per kept problem so many of each pool, then one order over both (draft_no)."""
    kept = having_pools(gen, min_true, min_false, num_true, num_false)
    flags = pool_flags(gen).join(kept.select("id"), "id", "left_semi")
    ranked = flags.withColumn("r_", seeded_rank(seed, ["id"], "response_id", ["id", "is_true"]))
    chosen = ranked.where(F.col("r_") <= F.when(F.col("is_true"), num_true).otherwise(num_false)).drop("r_")
    return chosen.withColumn("draft_no", seeded_rank(seed + 1, ["id"], "response_id", ["id"]))


def draft_rows(drafts: DataFrame, columns: list[str], n: int) -> DataFrame:
    """FLT19: one wide row per problem with traj1 to trajN and their columns."""
    cells = [F.max(F.when(F.col("draft_no") == k, F.col(c))).alias(f"traj{k}_{c}") for k in range(1, n + 1) for c in columns]
    return drafts.groupBy("id").agg(*cells)


def sample_both_pools(gen: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """SMP2: n of all generations per problem; problems with fewer raise."""
    ranked = gen.withColumn("draft_no", seeded_rank(seed, ["id"], "response_id", ["id"])).withColumn("c_", F.count(F.lit(1)).over(W.partitionBy("id")))
    checked = ranked.withColumn("ok_", F.assert_true(F.col("c_") >= n, F.lit("a problem has too few generations")))
    return checked.where((F.col("draft_no") <= n) & F.col("ok_").isNull()).drop("c_", "ok_")


def pick_one(gen: DataFrame, seed: int = 42) -> DataFrame:
    """SMP3: one generation per problem, without a sort of the group."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("response_id").cast("string")))
    rest = [c for c in gen.columns if c != "id"]
    return gen.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(h, F.col("response_id"))).alias("s_")).select("id", "s_.*")


def sample_groups(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """SMP4: the rows of n keys by hash; too few keys raise."""
    keys = rows.select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
    if (found := keys.count()) < n:
        raise ValueError(f"{n} of {key} asked for, {found} there")
    return rows.join(keys, key, "left_semi")


def build_record(rows: DataFrame, task: str, prompt: Column, gens: Column, requested: int, path: str, template_key: str, alias: str) -> DataFrame:
    """FLT22: a packed record with its seven metadata fields."""
    meta = F.struct(F.size(gens).cast("long").alias("num_responses"), F.lit(requested).cast("long").alias("n_samples_requested"), F.lit(requested).cast("long").alias("n_samples_variant_default"), F.lit(path).alias("template_path"), F.lit(template_key).alias("template_key"), F.lit(alias).alias("model_config_alias"), X.prompt_hash(prompt).alias("prompt_hash"))
    return rows.withColumn(f"{task}_prompt", prompt).withColumn(f"{task}_generations", gens).withColumn(f"{task}_generations_metadata", meta)


def postprocess(rows: DataFrame, max_length: int = 16384, round_: int | None = None) -> DataFrame:
    """FLT23: final text, thinking status and unique id; missing columns raise."""
    if missing := {"id", "response", "alias", "response_id"} - set(rows.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    split = X.thinking_split(F.col("response"), F.col("prompt") if "prompt" in rows.columns else None, max_length, channels=round_ is None)
    out = rows.withColumn("final", split["final"]).withColumn("thinking_status", split["status"])
    if round_ == 0:
        return out
    return out.withColumn("response_unique_id", trajectory_id(F.col("id"), F.col("alias"), F.col("response_id"), F.lit(round_) if round_ is not None else None))


def combine(gen: DataFrame, num_true: int = 0, num_false: int = 2, min_true: int = 2, min_false: int = 2, seed: int = 42, models: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """AGG57 as one call; an empty outcome raises with a plain message."""
    rows = model_filter(gen, models)
    rows = split_filter(rows, ids) if ids is not None else rows
    out = draft_sample(rows, num_true, num_false, min_true, min_false, seed)
    if out.isEmpty():
        raise ValueError("no problem has enough correct and incorrect generations")
    return out
