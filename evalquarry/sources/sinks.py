"""Sinks: records, analysis documents, metric rows, verdicts, reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.sources.records import hadoop_list


def write_records(packed: DataFrame, path: str, flatten: str | None = None) -> None:
    """SNK1: JSON lines; ``flatten`` names an array whose elements become rows with prefixed fields."""
    out = packed
    if flatten:
        fields = [f.name for f in packed.schema[flatten].dataType.elementType.fields]
        one = packed.withColumn("g_", F.explode_outer(flatten))
        out = one.select(*[c for c in packed.columns if c != flatten], *[F.col(f"g_.{n}").alias(f"{flatten}_{n}") for n in fields])
    out.write.mode("overwrite").json(path)


def write_document(row: DataFrame, path: str) -> None:
    """SNK2, SNK8: one JSON document of one row."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_named(lines: DataFrame, folder: str, names: list[str]) -> str:
    """SNK1: lines of text (``value``) in files of given names below a folder; tasks write them, the driver only renames."""
    path, fs = _store(lines, folder)
    part = f"{folder}/.part-{names[0]}"
    lines.repartition(len(names), F.xxhash64("value")).write.mode("overwrite").text(part)
    for p, name in zip([p for p, _, _ in hadoop_list(lines.sparkSession, f"{part}/part-*")], names):
        fs.mkdirs(path(f"{folder}/{name}").getParent())
        fs.rename(path(p), path(f"{folder}/{name}"))
    fs.delete(path(part), True)
    return folder


def write_each(rows: DataFrame, folder: str, name: str) -> str:
    """SNK8: one document ``folder``/key/``name`` per row of (key, value); keys are names of runs, cards or models."""
    path, fs = _store(rows, folder)
    part = f"{folder}/.part-{name}"
    rows.select(F.hex(F.col("key").cast("string")).alias("key"), "value").repartition("key").write.mode("overwrite").partitionBy("key").text(part)
    for p, _, _ in hadoop_list(rows.sparkSession, f"{part}/key=*"):
        key = bytes.fromhex(p.rsplit("key=", 1)[1]).decode()
        fs.mkdirs(path(f"{folder}/{key}"))
        for f, _, _ in hadoop_list(rows.sparkSession, f"{p}/part-*"):
            fs.rename(path(f), path(f"{folder}/{key}/{name}"))
    fs.delete(path(part), True)
    return folder


def _store(df: DataFrame, folder: str):
    """Hadoop's path class and the file system of a folder."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def error_document(questions: DataFrame, finish: DataFrame, unparsable: DataFrame, samples: int = 10) -> DataFrame:
    """SNK2: totals, the finish table and the first unparsable samples as one row."""
    f = finish.agg(F.array_sort(F.collect_list(F.struct("finish", "n", "correct", "incorrect", "unparsable"))).alias("finish_reason_correctness"))
    u = unparsable.orderBy("id", "response_id").limit(samples).agg(F.array_sort(F.collect_list(F.struct("id", "response_id", F.substring("text", 1, 200).alias("text")))).alias("unparsable_samples"))
    return questions.crossJoin(f).crossJoin(u)


def write_dataset(df: DataFrame, path: str) -> None:
    """SNK3, SNK4: Parquet; Spark commits all files or none and ends with a marker."""
    df.write.mode("overwrite").parquet(path)


def complete(spark, path: str) -> bool:
    """STM7: whether a dataset's marker is there."""
    return bool(hadoop_list(spark, f"{path}/_SUCCESS"))


def metric_row(df: DataFrame, sentinel: float = -1.0) -> DataFrame:
    """SNK7: the row as ``result`` struct with a sentinel for null numbers, which stay null before the sink."""
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(sentinel).cast(t)).alias(c) if t in ("double", "float", "bigint", "int") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.struct(*filled).alias("result"))


def write_solve_artifacts(gen: DataFrame, summary: DataFrame, analysis: DataFrame, path: str) -> None:
    """SNK6: evaluated records, the summary per problem and the analysis."""
    write_dataset(gen, f"{path}/evaluated")
    write_dataset(summary, f"{path}/summary")
    write_document(analysis, f"{path}/error_analysis")


def write_groups(df: DataFrame, key: str, path: str) -> None:
    """SNK15, SNK16, SNK8: JSON files in a folder per value of a column."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).json(path)


def table_text(df: DataFrame, kind: str = "md", rows: int = 100) -> str:
    """SNK9, SNK11: the first rows as md, csv, json, jsonl or latex."""
    import json

    data = [r.asDict() for r in df.limit(rows).collect()]
    cols = df.columns
    cell = lambda v: "—" if v is None else str(v)
    if kind == "json":
        return json.dumps(data, default=str, ensure_ascii=False)
    if kind == "jsonl":
        return "\n".join(json.dumps(r, default=str, ensure_ascii=False) for r in data)
    if kind == "csv":
        return "\n".join([",".join(cols), *(",".join("" if r[c] is None else str(r[c]) for c in cols) for r in data)])
    if kind == "latex":
        body = " \\\\\n".join(" & ".join(cell(r[c]).replace("_", "\\_") for c in cols) for r in data)
        return "\\begin{tabular}{" + "l" * len(cols) + "}\n" + " & ".join(c.replace("_", "\\_") for c in cols) + " \\\\\n\\hline\n" + body + " \\\\\n\\end{tabular}"
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in data)])


def report(title: str, sections: dict[str, DataFrame], rows: int = 100) -> str:
    """SNK10, SNK17: a Markdown report of small result tables."""
    return "\n\n".join([f"# {title}", *(f"## {k}\n\n{table_text(v, 'md', rows)}" for k, v in sections.items())])


def preview(df: DataFrame, column: str, n: int = 1, edge: int = 400) -> list[str]:
    """SNK18: the beginning and end of the first texts."""
    return [t if len(t) <= 2 * edge else f"{t[:edge]}\n...\n{t[-edge:]}" for t in (r[0] or "" for r in df.select(column).limit(n).collect())]


def manifest(df: DataFrame, status: str) -> DataFrame:
    """SNK14: what a materialised run consists of: file and bytes, with its status."""
    return df.withColumn("status", F.lit(status))
