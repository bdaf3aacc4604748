"""Joins and key sets: checked lookups, null-safe joins, coverage, duplicates and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup(left: DataFrame, right: DataFrame, key: str, column: str, into: str) -> DataFrame:
    """JOI1, JOI2: one value per left row; a key that repeats on the right or lacks there fails the action that reads it.

    One join: the right side is counted by key first, and each joined row checks its count.
    """
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), F.first(column).alias(into))
    joined = left.join(one, key, "left")
    wrong = F.when(F.col("n_").isNull(), F.raise_error(F.concat(F.lit("key missing: "), F.col(key).cast("string")))).when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("key repeats: "), F.col(key).cast("string"))))
    return joined.withColumn("n_", F.coalesce(wrong.cast("int"), F.lit(1))).where("n_ = 1").drop("n_")


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """JOI12 to JOI14: equi-join in which null meets null; the right's other columns get a suffix where they clash."""
    r = right.select([F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(right.columns)])
    at = {c: f"r_{i}" for i, c in enumerate(right.columns)}
    on = reduce(Column.__and__, [left[f"`{a}`"].eqNullSafe(r[at[b]]) for a, b in pairs])
    rest = [c for c in right.columns if c not in [b for _, b in pairs]]
    named = [F.col(at[c]).alias(c + suffix if c in left.columns else c) for c in rest]
    return left.join(r, on, how).select(*[left[f"`{c}`"] for c in left.columns], *named)


def attach_all(anchors: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """JOI7: every response of a problem beside each of its anchors."""
    return anchors.join(responses, key)


def mapped(rows: DataFrame, mapping: dict[str, str], column: str, into: str) -> DataFrame:
    """JOI16: a small dictionary as an expression."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
    return rows.withColumn(into, m[F.col(column)] if mapping else F.lit(None).cast("string"))


def pending(rows: DataFrame, done: DataFrame, hash_: str = "hash") -> DataFrame:
    """JOI17: rows whose content hash is not done yet."""
    return rows.join(done.select(hash_).distinct(), hash_, "left_anti")


def uncovered(expected: DataFrame, rows: DataFrame, usable: Column, key: str = "id") -> DataFrame:
    """JOI18: expected keys without a usable row."""
    return expected.select(key).distinct().join(rows.where(usable).select(key), key, "left_anti")


def sweep(values: dict[str, list], spark) -> DataFrame:
    """JOI20: one row per combination of the (given) values of all symbols, numbered in the order of the lists."""
    df = spark.range(1).select(F.lit(0).alias("point"))
    for name, xs in values.items():
        df = df.select(*df.columns, F.posexplode(F.array(*[F.lit(x) for x in xs])).alias("at_", name))
        df = df.withColumn("point", F.col("point") * len(xs) + F.col("at_")).drop("at_")
    return df.select(*values, "point")


def variants(joined: DataFrame, instance: object, *, perturbed: bool | None = None) -> DataFrame:
    """FIL19: the keys of an instance's variants: (instance_id, trial, perturbation), with or without perturbed ones."""
    rows = joined.where(F.col("instance_id") == instance)
    if perturbed is not None:
        rows = rows.where(F.col("perturbation").isNotNull() if perturbed else F.col("perturbation").isNull())
    return rows.select("instance_id", "trial", "perturbation").distinct()


def rows_for(joined: DataFrame, **key: object) -> DataFrame:
    """FIL19: the rows whose columns have these values; None asks for null. One value is a prefix lookup, all are a point."""
    return joined.where(reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()], F.lit(True)))


def stats_for(joined: DataFrame, metric: str | None = None, **key: object) -> DataFrame:
    """FIL19: metric and mean of those rows."""
    rows = rows_for(joined, **key)
    return (rows.where(F.col("metric") == metric) if metric else rows).select("metric", "split", "perturbation", "mean")


#: The fields of the older form of a row's key, in order.
LEGACY_KEY = ("run", "instance_id", "trial", "perturbation", "split", "metric", "row_ord")


def row_at(joined: DataFrame, key: dict[str, object] | tuple) -> DataFrame:
    """FIL19: the row of an exact key, as a dictionary or in the older form of seven values."""
    return rows_for(joined, **(key if isinstance(key, dict) else dict(zip(LEGACY_KEY, key, strict=True))))


def requests(historic: DataFrame, reproduced: DataFrame, key: str) -> DataFrame:
    """JOI21: historic rows with the status of their reproduction."""
    has = reproduced.select(key, F.lit(True).alias("has_")).distinct()
    return historic.join(has, key, "left").withColumn("status", F.when(F.col("has_"), "reproduced").otherwise("missing")).drop("has_")


def zipped(rows: DataFrame, a: str, b: str) -> DataFrame:
    """JOI22, SRC30: two arrays of one row, element by element; different lengths raise."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("arrays differ in length"))
    return rows.withColumn("ok_", same).where("ok_ IS NULL").drop("ok_").select("*", F.inline(F.arrays_zip(F.col(a).alias("left"), F.col(b).alias("right")))).drop(a, b)


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """SET1: missing columns become null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)


def coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET2: sizes of two key sets, of what they share and of what only one has."""
    both = a.select(*keys).distinct().withColumn("a_", F.lit(1)).unionByName(b.select(*keys).distinct().withColumn("a_", F.lit(2)))
    g = both.groupBy(*keys).agg(F.sum("a_").alias("m"))
    return g.agg(F.count_if(F.col("m") != 2).alias("n_a"), F.count_if(F.col("m") != 1).alias("n_b"), F.count_if(F.col("m") == 3).alias("both"), F.count(F.lit(1)).alias("either"), F.count_if(F.col("m") == 1).alias("only_a"), F.count_if(F.col("m") == 2).alias("only_b"))


def document_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET3: (path, status, a, b) of two path-value tables: only_a, only_b or differs."""
    j = a.select("path", F.col("value").alias("a"), F.lit(1).alias("ia")).join(b.select("path", F.col("value").alias("b"), F.lit(1).alias("ib")), "path", "full")
    status = F.when(F.col("ib").isNull(), "only_a").when(F.col("ia").isNull(), "only_b").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return j.withColumn("status", status).where("status IS NOT NULL").select("path", "status", "a", "b")


def leaf_paths(document) -> list[tuple[str, str]]:
    """SET3, JSN1: (dotted path, JSON value) of the leaves of a nested object."""
    import json

    out: list[tuple[str, str]] = []

    def walk(x, at):
        if isinstance(x, dict) and x:
            for k in x:
                walk(x[k], [*at, str(k)])
        elif isinstance(x, list) and x:
            for k, v in enumerate(x):
                walk(v, [*at, str(k)])
        else:
            out.append((".".join(at), json.dumps(x)))

    walk(document, [])
    return out


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SET4, SET5, WIN2: the first row of each key; an aggregate, so a frequent key needs no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("s_")).select(*keys, "s_.*")


def merge_ids(rows: DataFrame, key: str, array: str, order: str) -> DataFrame:
    """SET6: arrays of repeated keys joined in order, other columns of the first row."""
    rest = [c for c in rows.columns if c not in (key, array, order)]
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, array))), lambda s: s[array])
    return rows.groupBy(key).agg(F.flatten(parts).alias(array), *[F.min_by(c, order).alias(c) for c in rest])


def hash_completeness(rows: DataFrame, hash_: str, gens: str, expected: int) -> DataFrame:
    """SET7 to SET9: distinct hashes, rows that carry one, and whether all expected are there with generations."""
    return rows.agg(F.count_distinct(hash_).alias("distinct_hashes"), F.count_if(F.coalesce(hash_, F.lit("")) != "").alias("with_hash"), (F.count_distinct(hash_) >= expected).alias("enough"), F.bool_and(F.size(gens) > 0).alias("all_filled"))


def varied_values(rows: DataFrame, columns: list[str] | None = None, least: int = 2, most: int | None = None, default: str | None = None) -> DataFrame:
    """SET10, AGG40, FIL15: (column, value, n) of the columns with so many different values, in one pass.

    Values are compared as text, arrays as JSON, NaN as one value; ``default`` stands for null.
    """
    cols = columns or rows.columns
    shown = lambda c: F.to_json(c) if isinstance(rows.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{c}`").cast("string")
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(shown(c), F.lit(default).cast("string")).alias("value")) for c in cols])))
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    d = n.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where((F.col("d") >= least) & (F.lit(most is None) | (F.col("d") <= (most or 0))))
    return n.join(F.broadcast(d.select("column")), "column")
