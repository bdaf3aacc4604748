"""Round trips: files made of the tables in the shared folder, read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.operators import curves, generations, tables
from evalquarry.plans.base import query
from evalquarry.plans.domain_views import GEN, STATS, gen, read, stats
from evalquarry.session import work_path
from evalquarry.sources import demo, records, run_dirs, sinks

RECORD = "id long, source string, gens_response_id long, gens_alias string, gens_finish string, gens_answer string, gens_correctness boolean"
FLAT = "id long, response_id long, answer string, correctness boolean"


def as_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def parts_of_gen(spark: SparkSession, sf: str, n: int = 4) -> str:
    """Generations as JSON lines in n numbered parts."""
    g = gen(spark, sf).select("id", "response_id", "answer", "correctness")
    return sinks.write_named(as_lines(g), work_path(spark, "parts"), [f"dataset-{i}of{n}.jsonl" for i in range(1, n + 1)])


@query("WITH " + GEN + " SELECT id, source, response_id, alias, finish, answer, correctness FROM gen")
def records_round_trip(spark, sf):
    """SNK1, SRC6: packed records written flat as JSON lines and read back by a glob."""
    at = work_path(spark, "records")
    sinks.write_records(generations.pack(gen(spark, sf), ["id", "source"]), at, flatten="gens")
    back = records.read_globbed(spark, f"{at}/part-*", RECORD)
    return back.select("id", "source", *[F.col(f"gens_{c}").alias(c) for c in ("response_id", "alias", "finish", "answer", "correctness")])


@query("WITH " + GEN + " SELECT id, response_id, answer, correctness FROM gen")
def partitioned_records(spark, sf):
    """SRC1, SRC4: numbered parts, read strictly."""
    return records.read_jsonl(spark, records.dataset_files(spark, parts_of_gen(spark, sf)), FLAT, "strict")


@query("SELECT * FROM (VALUES ('all', true, ''), ('without 2', false, '2')) t(case_, complete, lacking)")
def partition_completeness(spark, sf):
    """SRC2: a set of parts before and after one of them is gone."""
    at = parts_of_gen(spark, sf)
    seen = [("all", *records.completeness(spark, at))]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/dataset-2of4.jsonl")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    seen.append(("without 2", *records.completeness(spark, at)))
    return spark.createDataFrame([(c, ok, ",".join(map(str, lack))) for c, ok, lack in seen], "case_ string, complete boolean, lacking string")


def torn(spark: SparkSession, sf: str) -> str:
    """Orders as JSON lines; every tenth is cut off in the middle."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("word " * 20).alias("pad"))
    line = F.to_json(F.struct(*o.columns))
    cut = o.select(F.when(F.col("id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 30)).otherwise(line).alias("value"))
    return sinks.write_named(cut, work_path(spark, "torn"), ["completions.jsonl"])


TORN = "id long, status string, pad string"


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0")
def torn_lines_dropped(spark, sf):
    """SRC3: malformed lines are left out silently."""
    return records.read_jsonl(spark, records.dataset_files(spark, torn(spark, sf)), TORN).select("id", "status")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) AS rejected, count(*) AS lines FROM orders")
def torn_lines_counted(spark, sf):
    """SRC3, SRC4: what was malformed, per file."""
    return records.rejected(spark, records.dataset_files(spark, torn(spark, sf)), TORN).select("rejected", "lines")


@query("SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def arrow_folder(spark, sf):
    """SRC5: an Arrow file and an Arrow stream in one folder."""
    import pyarrow as pa

    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey")
    at, whole = work_path(spark, "arrow"), rows.toArrow()
    path = spark._jvm.org.apache.hadoop.fs.Path
    half = whole.num_rows // 2
    for name, part, writer in (("a", whole.slice(0, half), pa.ipc.new_file), ("b", whole.slice(half), pa.ipc.new_stream)):
        sink = pa.BufferOutputStream()
        with writer(sink, whole.schema) as w:
            w.write_table(part)
        target = path(f"{at}/{name}.arrow")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(sink.getvalue().to_pybytes()))
        out.close()
    return records.read_arrow_folder(spark, at)


def api_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Answers of all problems, and the problems but for every fifth."""
    g = gen(spark, sf)
    name = F.concat(F.lit("bench_"), F.col("id").cast("string"), F.lit("-"), F.col("response_id").cast("string"))
    problems = read(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("problem_no"), F.col("o_orderpriority").alias("problem"))
    return g.select(name.alias("name"), "answer", "finish"), problems


_API = "WITH " + GEN + " SELECT id AS problem_no, alias AS problem, response_id, answer AS generated_response, finish AS finish_reason FROM gen WHERE id % 5 <> 0"


@query(_API)
def batch_results_a(spark, sf):
    """SRC7, SRC9, JOI19: answers under choices; those to unknown problems go."""
    raw, problems = api_rows(spark, sf)
    choice = F.struct(F.struct(F.col("answer").alias("content")).alias("message"), F.col("finish").alias("finish_reason"))
    body = F.to_json(F.struct(F.struct(F.array(choice).alias("choices")).alias("body")))
    found = records.read_api_results("a", raw.select(F.col("name").alias("custom_id"), body.alias("response")), problems)
    return found.select("problem_no", "problem", F.inline("response_generations"))


@query(_API)
def batch_results_b(spark, sf):
    """SRC8, SRC9, JOI19: answers under candidates."""
    raw, problems = api_rows(spark, sf)
    candidate = F.struct(F.struct(F.array(F.struct(F.col("answer").alias("text"))).alias("parts")).alias("content"), F.upper("finish").alias("finishReason"))
    body = F.to_json(F.struct(F.array(candidate).alias("candidates")))
    found = records.read_api_results("b", raw.select(F.col("name").alias("key"), body.alias("response")), problems)
    return found.select("problem_no", "problem", F.inline("response_generations"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 <> 2")
def split_ids(spark, sf):
    """SRC10, FIL3: the ids of two of three splits."""
    name = F.element_at(F.array(F.lit("sft"), F.lit("rl"), F.lit("val")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = read(spark, sf, "customer").groupBy(name.alias("key")).agg(F.to_json(F.collect_list(F.col("c_custkey").cast("string"))).alias("value"))
    at = work_path(spark, "splits")
    sinks.write_each(rows, at, "ids.json")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for p, d in records.children(spark, at):
        if d:
            fs.rename(path(f"{p}/ids.json"), path(f"{p}.json"))
    return records.split_ids(spark, "sft+rl", at)


_PRIORITY = "SELECT o_orderpriority AS key, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.0 END), 6) AS acc_clean, count(*) AS n_kept_problems FROM orders GROUP BY 1"


@query(f"SELECT key, acc_clean, CAST(-1 AS DOUBLE) AS acc_2f, CAST(-1 AS DOUBLE) AS drag, n_kept_problems FROM ({_PRIORITY}) t")
def collected_results(spark, sf):
    """SRC26, SNK7, SNK8: a result document per group, with a sentinel for what is null, gathered again."""
    right = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    g = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.round(F.avg(right), 6).alias("acc_clean"), F.lit(None).cast("double").alias("acc_2f"), F.lit(None).cast("double").alias("drag"), F.count(F.lit(1)).alias("n_kept_problems"))
    docs = sinks.metric_row(g).select(F.col("result.key").alias("key"), F.to_json(F.struct("result")).alias("value"))
    return records.results(spark, sinks.write_each(docs, work_path(spark, "results"), "results.json")).select("key", "acc_clean", "acc_2f", "drag", "n_kept_problems")


@query(f"SELECT key AS exec_hash, CASE WHEN acc_clean > 0.5 THEN 'VERIFIED' ELSE 'FALSIFIED' END AS status, CAST(n_kept_problems AS VARCHAR) AS n FROM ({_PRIORITY}) t")
def collected_verdicts(spark, sf):
    """SRC27, SNK8: a verdict document per group, with its symbols."""
    right = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    g = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.round(F.avg(right), 6).alias("acc"), F.count(F.lit(1)).alias("n"))
    verdict = F.struct(F.when(F.col("acc") > 0.5, "VERIFIED").otherwise("FALSIFIED").alias("status"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("symbols"))
    docs = g.select("key", F.to_json(verdict).alias("value"))
    back = records.verdicts(spark, sinks.write_each(docs, work_path(spark, "verdicts"), "verdict.json"))
    return back.select("exec_hash", "status", F.col("symbols")["n"].alias("n"))


@query("SELECT 'dataset-4of4.jsonl' AS last, 'dataset-3of4.jsonl' AS last_without")
def latest_file(spark, sf):
    """SRC28: the last file by name, with and without an ending."""
    at = parts_of_gen(spark, sf)
    names = [records.latest(spark, at, "dataset-*", exclude=x).rsplit("/", 1)[1] for x in (None, "4of4.jsonl")]
    return spark.createDataFrame([tuple(names)], "last string, last_without string")


RUNS = 6


def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """All stats, dealt to a few runs."""
    return stats(spark, sf).withColumn("run", F.col("run") % RUNS)


def run_folders(spark: SparkSession, sf: str) -> list[str]:
    root = demo.build(run_stats(spark, sf), work_path(spark, "demo"), {"runs": RUNS})
    return run_dirs.run_paths(spark, run_dirs.runs_root(spark, root))


_RUNS = STATS.replace("user_id AS run", f"user_id % {RUNS} AS run")
_NAME = "'bench:user=' || run AS run_name"


@query("WITH " + _RUNS + f" SELECT {_NAME}, metric, perturbation, count, mean FROM stats")
def run_stats_table(spark, sf):
    """SRC12 to SRC19, SRC35, SRC37, FLT6, JSN1: run folders built, found, decoded and flattened."""
    d = tables.dcol
    t = run_dirs.stats_table(spark, run_folders(spark, sf))
    return t.select(d("run_spec.name").alias("run_name"), d("stats.name.name").alias("metric"), d("stats.name.perturbation.name").alias("perturbation"), d("stats.count").alias("count"), d("stats.mean").alias("mean"))


@query("WITH " + _RUNS + f" SELECT DISTINCT {_NAME}, 'org/m' || run % 5 AS model, 'class' || run % 3 AS scenario FROM stats")
def run_specs_table(spark, sf):
    """FLT4, SRC17, SRC18."""
    d = tables.dcol
    t = run_dirs.run_spec_table(spark, run_folders(spark, sf))
    return t.select(d("run_spec.name").alias("run_name"), d("run_spec.adapter_spec.model").alias("model"), d("run_spec.scenario_spec.class_name").alias("scenario"))


@query("WITH " + _RUNS + f" SELECT {_NAME}, CAST(instance_id AS VARCHAR) AS instance_id, trial, metric, perturbation, mean FROM stats")
def per_instance_stats_table(spark, sf):
    """FLT3: stats of instances, exploded and flattened."""
    d = tables.dcol
    t = run_dirs.per_instance_table(spark, run_folders(spark, sf))
    p = "per_instance_stats"
    return t.select(d("run_spec.name").alias("run_name"), d(f"{p}.instance_id").alias("instance_id"), d(f"{p}.train_trial_index").alias("trial"), d(f"{p}.stats.name.name").alias("metric"), d(f"{p}.stats.name.perturbation.name").alias("perturbation"), d(f"{p}.stats.mean").alias("mean"))


@query("WITH " + _RUNS + f" SELECT {_NAME}, CAST(instance_id AS VARCHAR) AS instance_id, trial, perturbation, 'prompt ' || row_ord AS prompt FROM stats")
def scenario_states_table(spark, sf):
    """FLT5: request states, exploded and flattened."""
    d = tables.dcol
    t = run_dirs.scenario_state_table(spark, run_folders(spark, sf))
    s = "scenario_state.request_states"
    return t.select(d("run_spec.name").alias("run_name"), d(f"{s}.instance.id").alias("instance_id"), d(f"{s}.train_trial_index").alias("trial"), d(f"{s}.instance.perturbation.name").alias("perturbation"), d(f"{s}.request.prompt").alias("prompt"))


@query("WITH " + _RUNS + f" SELECT DISTINCT {_NAME}, 'ORG/m' || run % 5 AS model, 'class' || run % 3 AS scenario FROM stats WHERE run IN (1, 2)")
def run_inventory(spark, sf):
    """SRC22, SRC31, FIL12: output folders found below a root, runs chosen by two patterns, a name repaired."""
    root = demo.build(run_stats(spark, sf), work_path(spark, "demo"), {"runs": RUNS})
    (found,) = run_dirs.output_folders(spark, [root])
    paths = run_dirs.filter_runs(run_dirs.run_paths(spark, run_dirs.runs_root(spark, found)), ["*user=1", "regex:user=2$"])
    return run_dirs.run_table(spark, paths, {"org/": "ORG/"}).select(F.col("name").alias("run_name"), "model", "scenario")


@query("WITH " + _RUNS + " SELECT DISTINCT 'bench:user=' || run AS run_name, run > 1 AS copied FROM stats")
def downloaded_runs(spark, sf):
    """SRC20, SRC21: runs that a folder lacks are copied into it; two were there."""
    remote = run_folders(spark, sf)
    target = work_path(spark, "local") + "/runs/v1"
    run_dirs.download(spark, remote[:2], target)
    new = {p.rsplit("/", 1)[1] for p in run_dirs.download(spark, remote, target)}
    every = run_dirs.run_paths(spark, target.rsplit("/", 1)[0])
    return spark.createDataFrame([(n, n in new) for n in (p.rsplit("/", 1)[1] for p in every)], "run_name string, copied boolean")


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS input, 'test' AS split, 1 AS n_references FROM benchmark")
def scenario_instances(spark, sf):
    """SRC24, SRC36: a scenario's instances as one JSON list."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("input"), F.array(F.lit("a")).alias("references"), F.lit("test").alias("split"))
    listed = b.agg(F.lit("list").alias("key"), F.to_json(F.collect_list(F.struct(*b.columns))).alias("value"))
    at = sinks.write_each(listed, work_path(spark, "instances"), "instances.json")
    return records.instances(spark, f"{at}/list/instances.json").select("id", "input", "split", F.size("references").alias("n_references"))


@query("WITH " + GEN + """, q AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE correctness) AS t FROM gen GROUP BY id),
f AS (SELECT finish, count(*) AS n FROM gen GROUP BY finish),
u AS (SELECT id, response_id FROM gen WHERE correctness IS NULL ORDER BY id, response_id LIMIT 10)
SELECT (SELECT count(*) FROM q) AS questions, (SELECT CAST(sum(n) AS BIGINT) FROM q) AS responses, (SELECT string_agg(finish || ':' || n, ',' ORDER BY finish) FROM f) AS finishes, (SELECT string_agg(id || '-' || response_id, ',' ORDER BY id, response_id) FROM u) AS samples""")
def error_document(spark, sf):
    """SNK2, AGG6: the analysis as one JSON document, read back."""
    g = gen(spark, sf)
    unparsable = g.where("correctness IS NULL").select("id", "response_id", F.col("answer").alias("text"))
    at = work_path(spark, "analysis")
    sinks.write_document(sinks.error_document(curves.question_statistics(g), curves.finish_statistics(g), unparsable), at)
    back = spark.read.schema("questions long, responses long, finish_reason_correctness array<struct<finish:string,n:long>>, unparsable_samples array<struct<id:long,response_id:long>>").json(at)
    listed = lambda c, a, b, sep: F.array_join(F.transform(c, lambda s: F.concat(s[a].cast("string"), F.lit(sep), s[b].cast("string"))), ",")
    return back.select("questions", "responses", listed("finish_reason_correctness", "finish", "n", ":").alias("finishes"), listed("unparsable_samples", "id", "response_id", "-").alias("samples"))


@query("WITH " + GEN + """ SELECT * FROM (SELECT 'evaluated' AS artifact, count(*) AS n FROM gen UNION ALL SELECT 'summary', count(DISTINCT id) FROM gen UNION ALL SELECT 'error_analysis', 1) t""")
def solve_artifacts(spark, sf):
    """SNK3, SNK4, SNK6, AGG9: three artifacts, of which two have a marker."""
    g = gen(spark, sf)
    at = work_path(spark, "solve")
    sinks.write_solve_artifacts(g, curves.solve_summary(g), curves.question_statistics(g), at)
    if not all(sinks.complete(spark, f"{at}/{x}") for x in ("evaluated", "summary")):
        raise ValueError("an artifact has no marker")
    sizes = [(x, (spark.read.json if x == "error_analysis" else spark.read.parquet)(f"{at}/{x}").count()) for x in ("evaluated", "summary", "error_analysis")]
    return spark.createDataFrame(sizes, "artifact string, n long")


@query("SELECT o_orderpriority AS model, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def grouped_files(spark, sf):
    """SNK15, SNK16: a folder of JSON files per model."""
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("status"))
    at = work_path(spark, "groups")
    sinks.write_groups(o, "model", at)
    return spark.read.schema("status string, model string").json(at).groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


_TABLE = "SELECT r_regionkey AS k, r_name AS r_name FROM region"


@query(f"""WITH t AS ({_TABLE}) SELECT 'csv' AS kind, 'k,r_name' || chr(10) || string_agg(k || ',' || r_name, chr(10) ORDER BY k) AS body FROM t
UNION ALL SELECT 'md', '| k | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || k || ' | ' || r_name || ' |', chr(10) ORDER BY k) FROM t
UNION ALL SELECT 'jsonl', string_agg('{{"k": ' || k || ', "r_name": "' || r_name || '"}}', chr(10) ORDER BY k) FROM t
UNION ALL SELECT 'json', '[' || string_agg('{{"k": ' || k || ', "r_name": "' || r_name || '"}}', ', ' ORDER BY k) || ']' FROM t
UNION ALL SELECT 'latex', '\\begin{{tabular}}{{ll}}' || chr(10) || 'k & r\\_name \\\\' || chr(10) || '\\hline' || chr(10) || string_agg(k || ' & ' || r_name, ' \\\\' || chr(10) ORDER BY k) || ' \\\\' || chr(10) || '\\end{{tabular}}' FROM t""")
def printed_tables(spark, sf):
    """SNK9, SNK11: a small table as text in five forms."""
    t = read(spark, sf, "region").select(F.col("r_regionkey").alias("k"), "r_name").orderBy("k")
    return spark.createDataFrame([(k, sinks.table_text(t, k)) for k in ("csv", "md", "jsonl", "json", "latex")], "kind string, body string")


@query("""SELECT '# Runs' || chr(10) || chr(10) || '## nations' || chr(10) || chr(10) || '| r | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r || ' | ' || n || ' |', chr(10) ORDER BY r) AS report FROM (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1) t""")
def markdown_report(spark, sf):
    """SNK10, SNK17: sections of small tables."""
    t = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.count(F.lit(1)).alias("n")).orderBy("r")
    return spark.createDataFrame([(sinks.report("Runs", {"nations": t}),)], "report string")


@query("SELECT 'dataset-' || i || 'of4.jsonl' AS file, 'reused' AS status FROM (SELECT unnest([1, 2, 3, 4]) AS i) t")
def run_manifest(spark, sf):
    """SNK14: what a materialised run consists of."""
    at = parts_of_gen(spark, sf)
    files = [(p.rsplit("/", 1)[1], n) for p, n, _ in records.hadoop_list(spark, f"{at}/dataset-*")]
    return sinks.manifest(spark.createDataFrame(files, "file string, bytes long").where("bytes > 0"), "reused").select("file", "status")


@query("WITH " + STATS + " SELECT run, metric, mean, row_number() OVER (ORDER BY run, metric, row_ord) - 1 AS predict_id FROM stats")
def numbered_rows(spark, sf):
    """FLT18: numbers from 0 over all rows in order."""
    return tables.numbered(stats(spark, sf).select("run", "metric", "row_ord", "mean"), ["run", "metric", "row_ord"]).select("run", "metric", "mean", "predict_id")
