"""The engine's verbs: whole jobs from files to files, as functions and on the command line.

``python -m evalquarry VERB --name value ...``; a verb's options are its keyword arguments. Records
are JSON lines of problems with a list of generations (``list``), one generation a line (``flat``), or
results of a batch interface (``a``, ``b``). Models are functions (prompt, seed) -> text, named as
``module:function``. Each verb returns what it has written.
"""

from __future__ import annotations

import importlib
import inspect
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.functions import text as X
from evalquarry.functions import verify as V
from evalquarry.operators import cards, curves, distances, generations, joins, outcomes, recursion, runs, tables
from evalquarry.sources import records, run_dirs, sinks
from evalquarry.streaming import resume

FLAT = "id string, problem string, answer string, source string, alias string, response_id long, response string, finish string, code string, mode string, numbers array<bigint>"
LIST = "id string, problem string, answer string, source string, alias string, code string, mode string, numbers array<bigint>, generations array<struct<response_id:bigint,generated_response:string,finish_reason:string>>"
GEN = "id string, source string, alias string, response_id long, response string, answer string, finish string, correctness boolean, thinking_status string, final string"

VERBS: dict[str, Callable] = {}


def verb(f: Callable) -> Callable:
    VERBS[f.__name__.replace("_", "-")] = f
    return f


def named(function: str) -> Callable:
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def load(spark: SparkSession, dataset_dir: str, data_format: str = "list", single_partition: str | None = None, problem_data_path: str | None = None) -> DataFrame:
    """Responses one to a row, from any of the formats (ARR1, SRC1, SRC9)."""
    files = [f"{dataset_dir}/{single_partition}"] if single_partition else records.dataset_files(spark, dataset_dir)
    if data_format == "flat":
        return records.read_jsonl(spark, files, FLAT)
    if data_format == "list":
        packed = records.read_jsonl(spark, files, LIST)
    elif data_format in records.ADAPTERS:
        problems = records.read_jsonl(spark, [f"{problem_data_path}/dataset.jsonl"], LIST).drop("generations").withColumn("problem_no", F.col("id").cast("long"))
        raw = records.read_jsonl(spark, files, "custom_id string, key string, response string")
        packed = records.read_api_results(data_format, raw, problems).withColumnRenamed("response_generations", "generations")
    else:
        raise ValueError(f"unknown format {data_format}")
    rest = [c for c in packed.columns if c not in ("generations", "problem_no")]
    return packed.select(*rest, F.inline_outer("generations")).withColumnsRenamed({"generated_response": "response", "finish_reason": "finish"})


def evaluated(rows: DataFrame, extract: Column, right: Callable[[Column], Column]) -> DataFrame:
    """Responses with the extracted answer and whether it is right; null where nothing was extracted (MTH1, STM4)."""
    out = rows.withColumn("extracted_answer", extract)
    return out.withColumn("correctness", F.when(F.col("extracted_answer").isNotNull(), right(F.col("extracted_answer"))))


def finish_evaluation(rows: DataFrame, output: str, flatten: bool = False) -> dict[str, str]:
    """Evaluated records, the summary, the analysis and the curves, below ``output`` (SNK6, AGG4, AGG6)."""
    spark = rows.sparkSession
    sinks.write_dataset(rows, f"{output}/evaluated")
    back = spark.read.parquet(f"{output}/evaluated")
    plain = back.select("id", F.coalesce("source", F.lit("unknown")).alias("source"), "response_id", F.col("extracted_answer").alias("answer"), "correctness", F.coalesce("finish", F.lit("unknown")).alias("finish"))
    sinks.write_dataset(curves.solve_summary(plain), f"{output}/summary")
    sinks.write_document(sinks.error_document(curves.question_statistics(plain), curves.finish_statistics(plain), back.where("correctness IS NULL").select("id", "response_id", F.col("response").alias("text"))), f"{output}/error_analysis")
    packed = generations.pack(plain.select("id", "source", "response_id", "answer", "correctness"), ["id", "source"])
    curves.curves_by_source(packed).coalesce(1).write.mode("overwrite").json(f"{output}/curves")
    done = {x: f"{output}/{x}" for x in ("evaluated", "summary", "error_analysis", "curves")}
    if flatten:
        back.write.mode("overwrite").json(f"{output}/flat")
        done["flat"] = f"{output}/flat"
    return done


@verb
def eval_math(spark: SparkSession, *, dataset_dir: str, output: str, single_partition: str | None = None, flatten: bool = False, answer_column: str = "answer", response_column: str = "response", data_format: str = "list", problem_data_path: str | None = None) -> dict[str, str]:
    """Boxed answers against the given ones."""
    rows = load(spark, dataset_dir, data_format, single_partition, problem_data_path)
    return finish_evaluation(evaluated(rows, X.boxed_answer(F.col(response_column)), lambda a: V.equivalent_udf(a, F.col(answer_column))), output, flatten)


@verb
def eval_game_of_24(spark: SparkSession, *, dataset_dir: str, output: str, flatten: bool = False, response_column: str = "response", data_format: str = "list") -> dict[str, str]:
    """Boxed arithmetic that makes 24 of the given numbers."""
    rows = load(spark, dataset_dir, data_format)
    return finish_evaluation(evaluated(rows, X.boxed_answer(F.col(response_column)), lambda a: V.correct_24_udf(a, F.col("numbers"))), output, flatten)


@verb
def eval_crux(spark: SparkSession, *, dataset_dir: str, output: str, flatten: bool = False, response_column: str = "response", allow_code: bool = False) -> dict[str, str]:
    """Guessed inputs or outputs of programs, which run only with ``allow_code``."""
    rows = load(spark, dataset_dir)
    r = F.col(response_column)
    guess = F.when(F.col("mode") == "input", X.code_answer(r, "input")).otherwise(X.code_answer(r, "output"))
    return finish_evaluation(evaluated(rows, guess, lambda a: V.execution_verifier(F.col("code"), a, F.col("answer"), allow_code)), output, flatten)


@verb
def data_initial_sampling_postprocess(spark: SparkSession, *, input_dir: str, output: str, input_file_template: str = "*.jsonl", max_response_length: int = 16384) -> str:
    """Responses of several files with final text, thinking status and unique id (SRC6, STR2, FLT23)."""
    rows = records.read_globbed(spark, f"{input_dir}/{input_file_template}", FLAT)
    sinks.write_records(generations.postprocess(rows, max_response_length), output)
    return output


@verb
def data_stage1_postprocess_iterative(spark: SparkSession, *, input_dir: str, output: str, round_num: int, max_response_length: int = 16384) -> str:
    """The same for a round of an iterated run."""
    rows = records.read_globbed(spark, f"{input_dir}/*.jsonl", FLAT)
    sinks.write_records(generations.postprocess(rows, max_response_length, round_num), output)
    return output


@verb
def data_aggregate(spark: SparkSession, *, input_path: str, output: str, num_true: int = 0, num_false: int = 2, min_num_true_sampling: int = 2, min_num_false_sampling: int = 2, seed: int = 42, models: str | None = None, parsable_only: bool = False, complete_only: bool = False, data_split: str | None = None, split_root: str | None = None) -> str:
    """Drafts of problems with enough right and wrong responses, a row per problem (AGG57); ``data_split`` restricts the ids (aggregate-crux)."""
    gen = spark.read.schema(GEN).json(input_path)
    gen = gen.where("thinking_status = 'parsable_thinking'") if parsable_only else gen
    gen = gen.where("finish = 'stop'") if complete_only else gen
    ids = records.split_ids(spark, data_split, split_root) if data_split else None
    drawn = generations.combine(gen, num_true, num_false, min_num_true_sampling, min_num_false_sampling, seed, models.split(",") if models else None, ids)
    sinks.write_records(generations.draft_rows(drawn, ["answer", "correctness", "response_id"], num_true + num_false), output)
    return output


VERBS["data-aggregate-crux"] = data_aggregate


@verb
def data_aggregate_iterative(spark: SparkSession, *, input_path: str, output: str, num: int = 2, round_num: int = 1, seed: int = 42) -> str:
    """So many responses of each problem, right or wrong, as the drafts of a round (SMP2)."""
    drawn = generations.sample_both_pools(spark.read.schema(GEN).json(input_path), num, seed + round_num)
    sinks.write_records(generations.draft_rows(drawn, ["answer", "correctness", "response_id"], num).withColumn("round", F.lit(round_num)), output)
    return output


@verb
def data_minimal_aggregate_flatten(spark: SparkSession, *, input_path: str, output: str, drafts: int = 2) -> str:
    """One draft to a row (FLT8)."""
    sinks.write_records(generations.unpivot_drafts(spark.read.json(input_path), ["id"], drafts), output)
    return output


def prompts(spark: SparkSession, data_path: str, template: str, max_questions: int | None) -> DataFrame:
    rows = resume.with_hash(records.read_jsonl(spark, records.dataset_files(spark, data_path), FLAT).select("id", "problem", "answer", "source"), template)
    return rows.orderBy("id").limit(max_questions) if max_questions else rows


@verb
def inference_run(spark: SparkSession, *, model: str, data_path: str, output: str, template: str = "{arg_problem}", n: int = 1, seed: int = 0, max_questions: int | None = None) -> str:
    """Responses to prompts that have none yet, added to the output (STM2, STM6, JOI17)."""
    asked = prompts(spark, data_path, template, max_questions)
    if sinks.complete(spark, output):
        asked = joins.pending(asked, spark.read.parquet(output))
    resume.generated(asked, named(model), n, seed).write.mode("append").parquet(output)
    return output


@verb
def inference_dry_run(spark: SparkSession, *, data_path: str, template: str = "{arg_problem}", max_questions: int | None = None) -> list[str]:
    """The first prompt, cut in the middle (SNK18)."""
    return sinks.preview(prompts(spark, data_path, template, max_questions).orderBy("id"), "prompt")


@verb
def inference_list_models(spark: SparkSession, *, registry: str) -> list[str]:
    """The names of a registry of models (SRC25)."""
    text = spark.read.option("wholetext", True).text(registry).first()[0]
    return [r.alias for r in records.model_table(spark, json.loads(text)).collect()]


@verb
def mitigation_run(spark: SparkSession, *, model: str, drafts: str, output: str, variant: str = "cm_filter1", n: int = 8, seed: int = 0) -> str:
    """Drafts cleaned or revised by a model, then solved n times (STM10)."""
    ask = named(model)
    rows = spark.read.json(drafts).select("id", F.col("traj1").alias("draft"))
    write = lambda d, head, into, k: resume.generated(d.withColumn("prompt", F.concat(F.lit(head), "draft")), ask, k, seed).withColumn(into, F.get("gens", F.lit(0))["generated_response"])
    strategy = lambda d: write(d, "Extract a strategy from: ", "strategy", 1)
    revise = lambda d: write(d, "Revise: ", "context", 1).select("id", "context")
    solve = lambda d: resume.generated(d.withColumn("prompt", F.concat(F.lit("Solve with: "), "context" if "context" in d.columns else "strategy")).select("id", "prompt"), ask, n, seed)
    sinks.write_dataset(recursion.context_pipeline(rows, variant, strategy, revise, solve), output)
    return output


@verb
def recursive_run(spark: SparkSession, *, model: str, init: str, output: str, variant: str = "naive", max_recursive_steps: int = 16, n_samples_solve: int = 8, run_id: str = "run", seed: int = 42) -> str:
    """Rounds that each solve from the drafts of the one before (STM8); all rounds under one run id."""
    if variant not in ("rf1", "naive"):
        raise ValueError(f"unknown variant: {variant}")
    from evalquarry.session import written

    ask, lead = named(model), "Strategy of: " if variant == "rf1" else "Improve: "

    def step(drafts: DataFrame, r: int) -> DataFrame:
        made = resume.generated(drafts.withColumn("prompt", F.concat(F.lit(lead), "draft")).select("id", "prompt"), ask, n_samples_solve, recursion.makeup_seed(seed, r, 0))
        return made.select("id", F.get("gens", F.lit(0))["generated_response"].alias("draft")).where("draft IS NOT NULL")

    start = spark.read.schema("id string, draft string").json(init)
    sinks.write_dataset(recursion.rounds(start, step, written, max_recursive_steps).withColumn("run_id", F.lit(run_id)), output)
    return output


SETTINGS = {"1f": X.verdict_1f, "2f": X.verdict_2f, "framing": X.verdict_1f}


@verb
def analysis_error_conditioning_run(spark: SparkSession, *, cond_jsonl: str, direct_jsonl: str, out: str, setting: str = "2f") -> str:
    """Accuracy cells of conditioned and direct responses (AGG11)."""
    direct, cond = (spark.read.schema(GEN).json(p) for p in (direct_jsonl, cond_jsonl))
    sinks.write_document(outcomes.conditioning_cells(cond, direct, SETTINGS[setting](F.col("response"))).groupBy(F.lit(setting).alias("setting")).pivot("cell", ["raw", "filtered", "direct_raw", "direct_filtered"]).agg(F.max("accuracy")), out)
    return out


@verb
def analysis_error_conditioning_visualize(spark: SparkSession, *, summaries: str, rows: str = "dataset", columns: str = "model", value: str = "delta", names: str = "") -> str:
    """The matrix of deltas as a table (AGG18)."""
    return sinks.table_text(outcomes.matrix(spark.read.json(summaries), rows, columns, value, names.split(",")).orderBy(rows))


def _buckets(spark: SparkSession, direct_jsonl: str, onef_jsonl: str, mitigated_jsonl: str, threshold: float) -> DataFrame:
    of = lambda p, keys: outcomes.pass_rates(spark.read.schema(GEN).json(p).withColumn("draft", X.draft_key(F.col("answer"))), keys).drop("n")
    seen = outcomes.observations(of(direct_jsonl, ["id"]), of(onef_jsonl, ["id", "draft"]), of(mitigated_jsonl, ["id", "draft"]))
    return outcomes.bucket_counts(seen.withColumn("bucket", outcomes.bucket(F.col("direct"), F.col("one"), F.col("mitigated"), threshold)))


@verb
def analysis_mitigation_buckets_run(spark: SparkSession, *, direct_jsonl: str, onef_jsonl: str, mitigated_jsonl: str, out: str, threshold: float = 0.5) -> str:
    """Counts of the eight outcomes and the rates made of them (JOI4, AGG14, AGG15)."""
    counts = _buckets(spark, direct_jsonl, onef_jsonl, mitigated_jsonl, threshold)
    sinks.write_document(counts.join(outcomes.derived_rates(counts)), out)
    return out


@verb
def analysis_mitigation_buckets_render(spark: SparkSession, *, summary: str) -> str:
    return sinks.table_text(spark.read.json(summary))


@verb
def analysis_ted_build_cache(spark: SparkSession, *, anchored_jsonl: str, init_jsonl: str, out: str, metric: str = "levenshtein") -> str:
    """Distances of answers to drafts for both sides (AGG56)."""
    anchored = spark.read.schema("id string, drafts array<string>, answer string").json(anchored_jsonl)
    sinks.write_dataset(distances.build_cache(anchored, spark.read.schema(GEN).json(init_jsonl), [metric]), out)
    return out


@verb
def analysis_ted_summarize(spark: SparkSession, *, cache: str, out: str, reduction: str = "min") -> str:
    """Macro means of either side (AGG20)."""
    sinks.write_document(distances.summary(spark.read.parquet(cache), reduction), out)
    return out


@verb
def analysis_ted_render(spark: SparkSession, *, summary: str) -> str:
    return sinks.table_text(spark.read.json(summary))


@verb
def evaluate(spark: SparkSession, *, path: str, output: str, override: str = "{}", how: str = "all", threshold: float | None = None) -> str:
    """A card, a JSON document with title, claim and symbols, over its sweep; the verdict of each point and the reduced one (CTL1 to CTL4, AGG44)."""
    doc = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    card = cards.Card(doc["title"], doc["claim"], {k: cards.Symbol(**s) for k, s in doc["symbols"].items()})
    points, status = cards.evaluate(card, spark, how, threshold, json.loads(override))
    sinks.write_dataset(points, f"{output}/points")
    sinks.write_document(status, f"{output}/verdict")
    return f"{output}/verdict"


@verb
def download(spark: SparkSession, *, store: str, benchmark: str, target: str, version: str | None = None, runs_pattern: str = "*", list_versions: bool = False) -> list[str]:
    """Runs of a version (the last one by number), copied where they are not yet (SRC20, SRC21)."""
    versions = run_dirs.remote_versions(spark, store, benchmark)
    if list_versions:
        return versions
    root = f"{store}/{benchmark}/benchmark_output/runs/{version or versions[-1]}"
    found = [p for p, d in records.children(spark, root) if d and ":" in p.rsplit("/", 1)[1]]
    return run_dirs.download(spark, run_dirs.filter_runs(found, [runs_pattern]), target)


@verb
def models(spark: SparkSession, *, registry: str, query: str | None = None, groupby: str | None = None, sort: str | None = None, columns: str | None = None, max_rows: int = 100, format: str = "md") -> str:
    """The registry of models as a table, filtered, grouped and sorted (SRC23, FIL11, AGG29)."""
    text = spark.read.option("wholetext", True).text(registry).first()[0]
    names = sorted({k for v in json.loads(text).values() for k in v})
    table = records.model_table(spark, json.loads(text)).select("alias", *[F.col("params")[k].alias(k) for k in names])
    table = tables.query(table, query)
    table = table.groupBy(groupby).agg(F.count(F.lit(1)).alias("n")) if groupby else table
    table = table.select(*columns.split(",")) if columns else table
    return sinks.table_text(tables.query(table, None, (sort or table.columns[0]).split(","), max_rows), format, max_rows)


@verb
def materialize_run(spark: SparkSession, *, run_entry: str, precomputed_root: str, target: str, suite: str = "*") -> str | None:
    """The precomputed run that fits an entry best, copied into place; None if none fits (FIL13, SRT7, STM15)."""
    found = run_dirs.run_paths(spark, run_dirs.runs_root(spark, precomputed_root), suite)
    table = spark.createDataFrame([(p.rsplit("/", 1)[1], p) for p in found], "name string, path string")
    wanted = spark.createDataFrame([(run_entry,)], "e string").select(X.run_benchmark(F.col("e")).alias("b"), X.run_tokens(F.col("e")).alias("t")).first()
    best = runs.best_run(table, {"benchmark": wanted.b} | dict(wanted.t)).first()
    if best is None:
        return None
    run_dirs.download(spark, [best.path], target)
    return f"{target}/{best.name}"


def main(argv: list[str]) -> object:
    """Run one verb; its keyword arguments are the options."""
    import argparse

    parser = argparse.ArgumentParser(prog="evalquarry", description=__doc__)
    every = parser.add_subparsers(dest="verb", required=True)
    for name, f in sorted(VERBS.items()):
        sub = every.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for p in list(inspect.signature(f).parameters.values())[1:]:
            kind = {"int": int, "float": float}.get(str(p.annotation).split(" ")[0], str)
            flag = {"action": "store_true"} if p.annotation == "bool" else {"type": kind, "default": p.default, "required": p.default is p.empty}
            sub.add_argument(f"--{p.name}", **flag)
    options = vars(parser.parse_args(argv))
    from evalquarry.session import get_session

    session = SparkSession.getActiveSession() or get_session()
    done = VERBS[options.pop("verb")](session, **options)
    print(done if isinstance(done, str) else json.dumps(done, default=str, ensure_ascii=False))
    return done
