"""Dotted flat tables, column tools, sorts and top rows."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalquarry.session import written


def dcol(name: str) -> Column:
    """A column whose name has dots."""
    return F.col(f"`{name}`")


def flatten(df: DataFrame, prefix: str = "") -> DataFrame:
    """JSN1, FLT4, FLT6: nested structs as columns with dotted names; arrays and maps stay."""
    out: list[Column] = []

    def walk(kind: T.StructType, at: Column | None, name: str) -> None:
        for f in kind.fields:
            c = F.col(f"`{f.name}`") if at is None else at[f.name]
            full = f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, c, full + ".")
            else:
                out.append(c.alias(full))

    walk(df.schema, None, prefix)
    return df.select(out)


def flatten_exploded(df: DataFrame, array: str, prefix: str, keep: list[str]) -> DataFrame:
    """FLT3, FLT5: one row per element, its fields under ``prefix``.``array``, other fields beside it."""
    one = df.withColumn(array, F.explode(array))
    rest = [c for c in one.columns if c not in keep]
    flat = flatten(one.select(*rest), prefix + ".") if not keep else flatten(one.select(F.struct(*rest).alias(prefix), *keep))
    return flat.select(*[dcol(c) for c in keep], *[dcol(c) for c in flat.columns if c not in keep])


def insert_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """FLT9."""
    return df.select([dcol(c).alias(f"{prefix}.{c}") for c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, drop: bool = False) -> DataFrame:
    """FLT9: the columns under a prefix, with or without it."""
    return df.select([dcol(c).alias(c[len(prefix) + 1 :] if drop else c) for c in df.columns if c.startswith(prefix + ".")])


def suffix_columns(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([dcol(c) for c in df.columns if c == suffix or c.endswith("." + suffix)])


def safe_drop(df: DataFrame, labels: list[str]) -> DataFrame:
    """FLT10: without the columns of these names; names that are not there are ignored."""
    return df.select([dcol(c) for c in df.columns if c not in labels])


def reorder(df: DataFrame, head: list[str] = (), tail: list[str] = (), missing: str = "error", fill=None) -> DataFrame:
    """FLT11: given columns first and last; absent ones raise, go, or are filled."""
    absent = [c for c in (*head, *tail) if c not in df.columns]
    if absent and missing == "error":
        raise KeyError(f"columns missing: {absent}")
    if absent and missing == "fill":
        for c in absent:
            df = df.withColumn(c, F.lit(fill))
    has = lambda cs: [c for c in cs if c in df.columns]
    middle = [c for c in df.columns if c not in (*head, *tail)]
    return df.select([dcol(c) for c in (*has(head), *middle, *has(tail))])


def match_columns(df: DataFrame, pattern: str, kind: str = "glob") -> list[str]:
    """FLT12: names that a glob or regular expression fits as a whole (``search``: in part)."""
    test = {"glob": lambda c: fnmatch.fnmatchcase(c, pattern), "regex": lambda c: re.fullmatch(pattern, c), "search": lambda c: re.search(pattern, c)}[kind]
    return [c for c in df.columns if test(c)]


def shortest_suffixes(names: list[str], least: int = 1) -> dict[str, str]:
    """FLT13: for each dotted name its shortest tail of at least so many parts that no other name has."""
    parts = {n: n.split(".") for n in names}
    tails: dict[tuple, int] = {}
    for p in parts.values():
        for k in range(1, len(p) + 1):
            t = tuple(p[-k:])
            tails[t] = tails.get(t, 0) + 1
    return {n: ".".join(next((p[-k:] for k in range(min(least, len(p)), len(p) + 1) if tails[tuple(p[-k:])] == 1), p)) for n, p in parts.items()}


def shorten_columns(df: DataFrame, least: int = 1) -> DataFrame:
    short = shortest_suffixes(df.columns, least)
    return df.select([dcol(c).alias(short[c]) for c in df.columns])


def compact(df: DataFrame, names: dict[str, str], digits: int = 3) -> DataFrame:
    """FLT16: renamed columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select([(F.round(dcol(c), digits) if kinds[c] == "double" else dcol(c)).alias(names[c]) for c in names])


def numbered(df: DataFrame, order: list[str], into: str = "predict_id") -> DataFrame:
    """FLT18: numbers from 0 in a given order, without one task for all rows.

    Rows are range-sorted; each partition's offset is the count of the partitions before it.
    """
    key = [dcol(c) for c in order]
    # Written once: rows and offsets have to see the same partitions.
    placed = written(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("m_", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("p_", F.shiftright("m_", 33)).withColumn("i_", F.col("m_").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("p_").agg(F.count(F.lit(1)).alias("c_"))
    offsets = counts.select("p_", (F.sum("c_").over(W.orderBy("p_")) - F.col("c_")).alias("o_"))
    return placed.join(F.broadcast(offsets), "p_").withColumn(into, F.col("o_") + F.col("i_")).drop("m_", "p_", "i_", "o_", "c_")


def path_metadata(path: Column) -> Column:
    """FLT17: struct of what an experiment path names: range, n, seed and model size."""
    num = lambda p: F.regexp_extract(path, p, 1).try_cast("double")
    return F.struct(num(r"sr([0-9.]+)-").alias("low"), num(r"sr[0-9.]+-([0-9.]+)").alias("high"), num(r"_n(\d+)").cast("int").alias("n"), num(r"seed(\d+)").cast("int").alias("seed"), F.regexp_extract(path, r"(\d+(?:\.\d+)?[bB])(?:[^a-zA-Z]|$)", 1).alias("size"))


def query(df: DataFrame, where: str | None = None, by: list[str] = (), limit: int | None = None) -> DataFrame:
    """FIL11, SRT2, SRT3: a filter in SQL, a sort with nulls last, a number of rows."""
    out = df.where(where) if where else df
    out = out.orderBy(*[dcol(c).asc_nulls_last() for c in by]) if by else out
    return out.limit(limit) if limit is not None else out


def extrema(df: DataFrame, columns: list[str], objective: list[str] | str = "minimize", k: int = 1) -> DataFrame:
    """SRT1: the k best rows by several keys with their own directions."""
    goals = [objective] * len(columns) if isinstance(objective, str) else objective
    return df.orderBy(*[dcol(c).asc_nulls_last() if g.startswith("min") else dcol(c).desc_nulls_last() for c, g in zip(columns, goals)]).limit(k)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """SRT5, SRT10: the first n of each group (Spark drops others before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)


def ranked_groups(df: DataFrame, rank: Column, delta: Column, groups: list[str], core: Column, most: int, quota: int) -> DataFrame:
    """SRT6: groups by class rank and largest delta, so many in all and so many that are not core."""
    g = df.groupBy(*groups).agg(F.min(rank).alias("class_rank"), F.max(delta).alias("max_delta"), F.max(core).alias("is_core"))
    order = [F.col("class_rank"), F.col("max_delta").desc(), *[F.col(c) for c in groups]]
    within = g.withColumn("r_", F.row_number().over(W.partitionBy("is_core").orderBy(*order))).where(F.col("is_core") | (F.col("r_") <= quota))
    return within.orderBy(*order).limit(most).drop("r_")


def version_key(version: Column) -> Column:
    """SRT8: the numbers of a version as an array, which orders by number."""
    return F.transform(F.filter(F.split(version, "[^0-9]+"), lambda x: x != ""), lambda x: x.cast("int"))


def latest_version(df: DataFrame, column: str = "version") -> DataFrame:
    return df.agg(F.max_by(column, version_key(dcol(column))).alias(column))


def random_table(spark: SparkSession, n: int, columns: int, seed: int = 0) -> DataFrame:
    """SRC34."""
    return spark.range(n).select("id", *[F.rand(seed + k).alias(f"c{k}") for k in range(columns)])


def ensure_long(spark: SparkSession, data) -> DataFrame:
    """SRC29: a DataFrame from pandas, a list of dicts, or itself."""
    return data if isinstance(data, DataFrame) else spark.createDataFrame(data)
