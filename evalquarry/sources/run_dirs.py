"""Directories of benchmark runs: discovery and typed readers of their five documents."""

from __future__ import annotations

import fnmatch
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry import schemas
from evalquarry.operators.tables import flatten, flatten_exploded
from evalquarry.sources.records import children, file_folder, hadoop_list

REQUIRED = ("run_spec.json", "scenario_state.json", "stats.json")
DOCUMENTS = {"run_spec": schemas.RUN_SPEC, "stats": f"name {schemas.STAT_NAME}, " + schemas.STAT_NUMBERS, "per_instance_stats": schemas.PER_INSTANCE, "scenario_state": schemas.SCENARIO_STATE}


def runs_root(spark: SparkSession, path: str) -> str:
    """SRC12: the folder of suites, given it or one of the two above."""
    for tail in ("benchmark_output/runs", "runs", ""):
        full = f"{path.rstrip('/')}/{tail}".rstrip("/")
        if hadoop_list(spark, full) and (tail or path.rstrip("/").endswith("runs")):
            return full
    raise FileNotFoundError(f"no runs below {path}")


def suites(spark: SparkSession, root: str, pattern: str = "*") -> list[str]:
    """SRC13: suite names, without ``latest``."""
    return [n for p, _, d in hadoop_list(spark, f"{root}/*") if d and (n := p.rsplit("/", 1)[1]) != "latest" and fnmatch.fnmatchcase(n, pattern)]


def run_paths(spark: SparkSession, root: str, suite: str = "*", pattern: str = "*", complete: bool = True) -> list[str]:
    """SRC14, SRC15, SRC35: run folders, whose names hold a colon; complete ones have all required documents."""
    found = []
    for name in suites(spark, root, suite):
        for p, is_folder in children(spark, f"{root}/{name}"):
            if is_folder and ":" in (n := p.rsplit("/", 1)[1]) and fnmatch.fnmatchcase(n, pattern):
                if not complete or set(REQUIRED) <= {c.rsplit("/", 1)[1] for c, _ in children(spark, p)}:
                    found.append(p)
    return found


def run_spec_names(spark: SparkSession, root: str, suite: str) -> list[str]:
    return sorted({p.rsplit("/", 1)[1] for p in run_paths(spark, root, suite)})


def read_document(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """SRC16 to SRC18: one document kind of many runs in one typed read, with the run's name."""
    raw = spark.read.schema(DOCUMENTS[name]).option("multiLine", True).json([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) + f"/{name}.json" for p in paths])
    return raw.withColumn("run_spec.name", file_folder())


def stats_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC19, FLT6: flattened run stats."""
    d = read_document(spark, paths, "stats")
    return flatten(d.select(F.struct(*[c for c in d.columns if c != "run_spec.name"]).alias("stats"), "`run_spec.name`"))


def run_spec_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FLT4."""
    d = read_document(spark, paths, "run_spec")
    return flatten(d.select(F.struct(*[c for c in d.columns if c != "run_spec.name"]).alias("run_spec")))


def per_instance_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FLT3."""
    d = read_document(spark, paths, "per_instance_stats").withColumnRenamed("run_spec.name", "run")
    flat = flatten_exploded(d, "stats", "per_instance_stats", ["run"])
    return flat.withColumnRenamed("run", "run_spec.name")


def scenario_state_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FLT5."""
    d = read_document(spark, paths, "scenario_state").withColumnRenamed("run_spec.name", "run")
    flat = flatten_exploded(d, "request_states", "scenario_state", ["run"])
    return flat.withColumnRenamed("run", "run_spec.name")


def output_folders(spark: SparkSession, roots: list[str], depth: int = 4) -> list[str]:
    """SRC22: ``benchmark_output`` folders below roots; nothing below a found one is looked at."""
    found, todo = [], list(roots)
    for _ in range(depth + 1):
        below = []
        for r in todo:
            if r.rstrip("/").endswith("benchmark_output"):
                found.append(r)
            else:
                below += [p for p, _, d in hadoop_list(spark, f"{r}/*") if d]
        todo = below
    return sorted(found)


def remote_versions(spark: SparkSession, store: str, benchmark: str, blocked: tuple[str, ...] = ()) -> list[str]:
    """SRC20: versions of a benchmark in a store that Hadoop reads, by number."""
    if benchmark in blocked:
        return []
    names = [p.rsplit("/", 1)[1] for p, _, d in hadoop_list(spark, f"{store}/{benchmark}/benchmark_output/runs/*") if d]
    return sorted(names, key=lambda v: [int(x) for x in re.findall(r"\d+", v)])


def missing_runs(spark: SparkSession, remote: list[str], local: list[str]) -> list[str]:
    """SRC21: runs of the store that are not present; a Hadoop store is read in place, without a download."""
    have = {p.rsplit("/", 1)[1] for p in local}
    return [p for p in remote if p.rsplit("/", 1)[1] not in have]


def download(spark: SparkSession, remote: list[str], target: str) -> list[str]:
    """SRC21: copy runs that a folder lacks into it, between any two Hadoop stores; the runs that were copied.

    A run is copied under another name and then renamed, so a broken copy never counts as present.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    here = path(target).getFileSystem(conf)
    here.mkdirs(path(target))
    copied = missing_runs(spark, remote, [p for p, d in children(spark, target) if d])
    for run in copied:
        name = run.rsplit("/", 1)[1]
        part = path(f"{target}/.part-{hashlib.md5(name.encode()).hexdigest()}")
        here.delete(part, True)
        source = path(run)
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, here, part, False, conf)
        here.rename(part, path(f"{target}/{name}"))
    return copied


def filter_runs(paths: list[str], patterns: list[str]) -> list[str]:
    """FIL12: globs, or regular expressions after ``regex:``."""
    fits = lambda n, p: bool(re.search(p[6:], n)) if p.startswith("regex:") else fnmatch.fnmatchcase(n, p)
    return [x for x in paths if any(fits(x.rsplit("/", 1)[1], p) for p in patterns)]


def run_table(spark: SparkSession, paths: list[str], repaired: dict[str, str] | None = None) -> DataFrame:
    """SRC31: spec name, folder, model (with repaired tokens) and scenario class, by folder."""
    d = read_document(spark, paths, "run_spec").withColumn("dir", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    model = F.col("adapter_spec.model")
    for a, b in (repaired or {}).items():
        model = F.replace(model, F.lit(a), F.lit(b))
    return d.select("name", "dir", model.alias("model"), F.col("scenario_spec.class_name").alias("scenario")).orderBy("dir")


def one_of(runs=None, suites_=None):
    """SRC32: exactly one of two inputs."""
    if (runs is None) == (suites_ is None):
        raise ValueError("give either runs or suites")
    return runs if runs is not None else suites_
