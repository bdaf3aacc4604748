"""Sources of generation records: JSONL in several tolerances, result adapters and catalogs of paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry import schemas

CORRUPT = "_corrupt_record"


def hadoop_list(spark: SparkSession, pattern: str) -> list[tuple[str, int, bool]]:
    """(path, bytes, is folder) of a glob on any Hadoop store, sorted."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted((s.getPath().toString(), s.getLen(), s.isDirectory()) for s in found)


def children(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(path, is folder) of what lies in a folder, sorted; unlike a glob it takes names with colons."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(path)) if fs.exists(path) else []


def dataset_files(spark: SparkSession, folder: str) -> list[str]:
    """SRC1: the parts of a folder, else completions, else dataset."""
    for pattern in ("dataset-*of*.jsonl", "completions.jsonl", "dataset.jsonl"):
        if found := [p for p, _, d in hadoop_list(spark, f"{folder}/{pattern}") if not d]:
            return found
    raise FileNotFoundError(f"no records in {folder}")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, mode: str = "silent") -> DataFrame:
    """SRC1, SRC3, SRC4: ``silent`` drops malformed lines, ``strict`` raises, ``flag`` keeps them in a column."""
    reader = spark.read.schema(schema + (f", {CORRUPT} string" if mode == "flag" else ""))
    kind = {"silent": "DROPMALFORMED", "strict": "FAILFAST", "flag": "PERMISSIVE"}[mode]
    return reader.option("mode", kind).option("columnNameOfCorruptRecord", CORRUPT).json(paths)


def rejected(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Malformed lines per file, to warn about."""
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    raw = spark.read.text(paths).where(F.length(F.trim("value")) > 0).select(F.input_file_name().alias("file"), parsed.alias("r"))
    return raw.groupBy("file").agg(F.count(F.col(f"r.{CORRUPT}")).alias("rejected"), F.count(F.lit(1)).alias("lines"))


def completeness(spark: SparkSession, folder: str) -> tuple[bool, list[int]]:
    """SRC2: whether all of N parts are there and none is empty; the numbers that lack."""
    found, total = {}, 0
    for path, size, _ in hadoop_list(spark, f"{folder}/dataset-*of*.jsonl"):
        if m := re.search(r"dataset-(\d+)-?of-?(\d+)\.jsonl$", path):
            found[int(m[1])], total = size, max(total, int(m[2]))
    first = 0 if 0 in found else 1
    lacking = [i for i in range(first, first + total) if not found.get(i)]
    return bool(total) and not lacking, lacking


def read_globbed(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """SRC6: the union of a glob with the file of each row."""
    return spark.read.schema(schema).json([p for p, _, _ in hadoop_list(spark, pattern)]).withColumn("file", F.input_file_name())


def arrow_batches(raw: bytes):
    """The record batches of an Arrow file or stream held in memory."""
    import pyarrow as pa

    reader = pa.ipc.open_file(raw) if raw[:6] == b"ARROW1" else None
    if reader is None:
        yield from pa.ipc.open_stream(raw)
    else:
        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))


def read_arrow_folder(spark: SparkSession, folder: str) -> DataFrame:
    """SRC5: an Arrow dataset folder of any Hadoop store; each file is read by a task, the first for its schema too."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = [p for p, _, d in hadoop_list(spark, f"{folder}/*.arrow") if not d]
    if not files:
        raise FileNotFoundError(f"no .arrow files in {folder}")
    content = spark.read.format("binaryFile")

    def schema_of(batches):
        for b in batches:
            for raw in b.column("content"):
                data = raw.as_py()
                found = (pa.ipc.open_file(data) if data[:6] == b"ARROW1" else pa.ipc.open_stream(data)).schema
                yield pa.RecordBatch.from_pydict({"s": [found.remove_metadata().serialize().to_pybytes()]})

    (first,) = content.load(files[0]).select("content").mapInArrow(schema_of, "s binary").first()
    kind = pa.ipc.read_schema(pa.py_buffer(bytes(first)))

    def rows_of(batches):
        for b in batches:
            for raw in b.column("content"):
                for part in arrow_batches(raw.as_py()):
                    yield pa.RecordBatch.from_arrays([part.column(n).cast(kind.field(n).type) for n in kind.names], schema=kind)

    return content.load(files).select("content").mapInArrow(rows_of, from_arrow_schema(kind))


def _nested(answers: DataFrame, problems: DataFrame, task: str) -> DataFrame:
    """JOI19: generations nested by problem; answers to unknown problems go (see ``unknown``)."""
    g = answers.groupBy("problem_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("response_id", "generated_response", "finish_reason"))), lambda s: s).alias(f"{task}_generations"))
    return problems.join(g, "problem_no")


def batch_api_a(raw: DataFrame, problems: DataFrame, task: str = "response") -> DataFrame:
    """SRC7: ``custom_id`` is bench_problem-generation, the text under choices."""
    body = raw.select(
        F.regexp_extract("custom_id", r"_(\d+)-\d+$", 1).cast("long").alias("problem_no"), F.regexp_extract("custom_id", r"-(\d+)$", 1).cast("long").alias("response_id"),
        F.get_json_object("response", "$.body.choices[0].message.content").alias("generated_response"), F.get_json_object("response", "$.body.choices[0].finish_reason").alias("finish_reason"),
    )
    return _nested(body, problems, task)


def batch_api_b(raw: DataFrame, problems: DataFrame, task: str = "response") -> DataFrame:
    """SRC8: ``key`` is bench_problem-generation, the text under candidates."""
    body = raw.select(
        F.regexp_extract("key", r"_(\d+)-\d+$", 1).cast("long").alias("problem_no"), F.regexp_extract("key", r"-(\d+)$", 1).cast("long").alias("response_id"),
        F.get_json_object("response", "$.candidates[0].content.parts[0].text").alias("generated_response"), F.lower(F.get_json_object("response", "$.candidates[0].finishReason")).alias("finish_reason"),
    )
    return _nested(body, problems, task)


ADAPTERS = {"a": batch_api_a, "b": batch_api_b}


def read_api_results(kind: str, raw: DataFrame, problems: DataFrame, task: str = "response") -> DataFrame:
    """SRC9."""
    if kind not in ADAPTERS:
        raise ValueError(f"unknown format {kind}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[kind](raw, problems, task)


def split_ids(spark: SparkSession, split: str, root: str) -> DataFrame:
    """SRC10: ids of ``a+b`` selectors over sft, rl and val; each is a JSON list of ids."""
    parts = split.split("+")
    if bad := set(parts) - {"sft", "rl", "val"}:
        raise ValueError(f"unknown splits: {sorted(bad)}")
    text = spark.read.option("wholetext", True).text([f"{root}/{p}.json" for p in parts])
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("id"))


def file_folder() -> Column:
    """The name of the folder of a row's file, as it was written."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def results(spark: SparkSession, root: str) -> DataFrame:
    """SRC26: every results.json below a root, its fields beside the name of its folder."""
    raw = spark.read.schema(schemas.RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").json(root)
    return raw.withColumn("key", file_folder()).select("key", "result.*")


def verdicts(spark: SparkSession, root: str) -> DataFrame:
    """SRC27."""
    raw = spark.read.schema(schemas.VERDICT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "verdict.json").json(root)
    return raw.withColumn("exec_hash", file_folder())


def latest(spark: SparkSession, folder: str, pattern: str, exclude: str | None = None) -> str | None:
    """SRC28: the last matching path by name."""
    found = [p for p, _, _ in hadoop_list(spark, f"{folder}/{pattern}") if not (exclude and p.endswith(exclude))]
    return max(found, default=None)


def setting(name: str, default: str, spark: SparkSession | None = None) -> str:
    """SRC33: a root or mode from the session, else the environment, else a default."""
    import os

    key = f"spark.evalquarry.{name}"
    return (spark.conf.get(key, None) if spark else None) or os.environ.get(f"EVALQUARRY_{name.upper()}", default)


def model_table(spark: SparkSession, document: dict[str, dict]) -> DataFrame:
    """SRC23, SRC25: (alias, params map) of a registry, by alias."""
    rows = [(k, {a: str(b) for a, b in v.items()}) for k, v in sorted(document.items())]
    return spark.createDataFrame(rows, "alias string, params map<string,string>")


def instances(spark: SparkSession, path: str) -> DataFrame:
    """SRC24, SRC36: instances of a scenario from one JSON list, also to put in place of a spec's own."""
    return spark.read.schema("id string, input string, references array<string>, split string").option("multiLine", True).json(path)
