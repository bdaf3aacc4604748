"""Readers, writers and the incremental stream on files made here."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalquarry.sources import records, run_dirs, sinks
from evalquarry.streaming import resume

SCHEMA = "id string, problem string"


def lines(path, rows, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)


def test_torn_line(spark, tmp_path):
    lines(tmp_path / "completions.jsonl", [{"id": str(i), "problem": "p"} for i in range(3)], '{"id": "3", "pro')
    files = records.dataset_files(spark, str(tmp_path))
    assert records.read_jsonl(spark, files, SCHEMA).count() == 3
    assert records.rejected(spark, files, SCHEMA).first().rejected == 1
    with pytest.raises(Exception):
        records.read_jsonl(spark, files, SCHEMA, "strict").collect()


def test_parts_and_completeness(spark, tmp_path):
    for i in (1, 3):
        lines(tmp_path / f"dataset-{i}of3.jsonl", [{"id": str(i), "problem": "p"}])
    (tmp_path / "dataset-2of3.jsonl").write_text("")
    assert records.completeness(spark, str(tmp_path)) == (False, [2])
    assert len(records.dataset_files(spark, str(tmp_path))) == 3
    with pytest.raises(FileNotFoundError):
        records.dataset_files(spark, str(tmp_path / "none"))
    assert records.latest(spark, str(tmp_path), "dataset-*", exclude="3of3.jsonl").endswith("2of3.jsonl")


def test_api_adapters(spark):
    problems = spark.createDataFrame([(0, "p0"), (1, "p1")], "problem_no long, problem string")
    body = json.dumps({"body": {"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}]}})
    raw = spark.createDataFrame([("aime_0-1", body), ("aime_0-0", body), ("aime_9-0", body)], "custom_id string, response string")
    r = records.read_api_results("a", raw, problems).collect()
    assert len(r) == 1 and [g.response_id for g in r[0].response_generations] == [0, 1]
    body = json.dumps({"candidates": [{"content": {"parts": [{"text": "yo"}]}, "finishReason": "STOP"}]})
    raw = spark.createDataFrame([("aime_1-0", body)], "key string, response string")
    assert records.read_api_results("b", raw, problems).first().response_generations[0].finish_reason == "stop"
    with pytest.raises(ValueError):
        records.read_api_results("c", raw, problems)


def test_split_ids(spark, tmp_path):
    for n, ids in (("sft", ["a"]), ("rl", ["b", "c"])):
        (tmp_path / f"{n}.json").write_text(json.dumps(ids))
    assert {r.id for r in records.split_ids(spark, "sft+rl", str(tmp_path)).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        records.split_ids(spark, "test", str(tmp_path))


def run_folder(root, name):
    d = root / "benchmark_output" / "runs" / "v1" / name
    d.mkdir(parents=True)
    (d / "run_spec.json").write_text(json.dumps({"name": name, "adapter_spec": {"model": "m"}}))
    (d / "stats.json").write_text(json.dumps([{"name": {"name": "exact_match", "split": "test"}, "count": 2, "mean": 0.5}]))
    (d / "scenario_state.json").write_text(json.dumps({"request_states": [{"instance": {"id": "i1", "input": {"text": "q"}}, "train_trial_index": 0, "request": {"prompt": "p"}}]}))
    (d / "per_instance_stats.json").write_text(json.dumps([{"instance_id": "i1", "train_trial_index": 0, "stats": [{"name": {"name": "exact_match"}, "mean": 1.0}]}]))


def test_run_folders(spark, tmp_path):
    run_folder(tmp_path, "b:model=m")
    run_folder(tmp_path, "b:model=n")
    (tmp_path / "benchmark_output" / "runs" / "v1" / "b:broken").mkdir()
    (tmp_path / "benchmark_output" / "runs" / "latest").mkdir()
    root = run_dirs.runs_root(spark, str(tmp_path))
    assert run_dirs.suites(spark, root) == ["v1"]
    paths = run_dirs.run_paths(spark, root)
    assert run_dirs.run_spec_names(spark, root, "v1") == ["b:model=m", "b:model=n"]
    s = run_dirs.stats_table(spark, paths)
    assert {"stats.name.name", "stats.mean", "run_spec.name"} <= set(s.columns) and s.count() == 2
    assert {r["run_spec.name"] for r in s.collect()} == {"b:model=m", "b:model=n"}
    assert run_dirs.per_instance_table(spark, paths).select("`per_instance_stats.stats.name.name`").count() == 2
    assert run_dirs.scenario_state_table(spark, paths).select("`scenario_state.request_states.request.prompt`").first()[0] == "p"
    assert run_dirs.run_spec_table(spark, paths).select("`run_spec.adapter_spec.model`").count() == 2
    assert len(run_dirs.filter_runs(paths, ["regex:model=n$"])) == 1
    assert len(run_dirs.output_folders(spark, [str(tmp_path)])) == 1
    assert run_dirs.run_table(spark, paths, {"m": "M"}).first().model == "M"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "n int, x double")
    assert sinks.metric_row(df).first().result.x == -1.0
    assert "| n | x |" in sinks.table_text(df) and "—" in sinks.table_text(df)
    assert sinks.table_text(df, "csv") == "n,x\n1,"
    assert json.loads(sinks.table_text(df, "json")) == [{"n": 1, "x": None}]
    sinks.write_dataset(df, str(tmp_path / "d"))
    assert sinks.complete(spark, str(tmp_path / "d")) and not sinks.complete(spark, str(tmp_path / "e"))
    packed = spark.createDataFrame([("a", [(0, "é")])], "id string, g array<struct<response_id:int,t:string>>")
    sinks.write_records(packed, str(tmp_path / "r"), flatten="g")
    assert spark.read.json(str(tmp_path / "r")).first().g_t == "é"
    assert sinks.preview(spark.createDataFrame([("x" * 100,)], "t string"), "t", edge=10) == ["x" * 10 + "\n...\n" + "x" * 10]
    assert "## a" in sinks.report("t", {"a": df})


def test_stream_resumes_without_duplicates(spark, tmp_path):
    schema = "id string, answer string, response string"
    out, check, src = (str(tmp_path / x) for x in ("out", "check", "in"))

    def once():
        rows = resume.once(resume.with_hash(resume.record_stream(spark, src, schema), "Q {arg_id}"))
        resume.append(resume.verified(rows), out, check).awaitTermination()
        return {r.id: r.correctness for r in spark.read.parquet(out).collect()}

    lines(tmp_path / "in" / "a.jsonl", [{"id": "1", "answer": "1/2", "response": "\\boxed{0.5}"}, {"id": "2", "answer": "3", "response": "none"}])
    assert once() == {"1": True, "2": None}
    lines(tmp_path / "in" / "b.jsonl", [{"id": "2", "answer": "3", "response": "again"}, {"id": "3", "answer": "3", "response": "\\boxed{4}"}], '{"id": "4"')
    assert once() == {"1": True, "2": None, "3": False}
    assert spark.read.parquet(out).count() == 3


def test_generation_keeps_partial_success(spark):
    def gen(prompt, seed):
        if seed == 2:
            raise RuntimeError
        return f"{prompt} {seed}"

    r = resume.generated(spark.createDataFrame([("p",)], "prompt string"), gen, 3).first()
    assert [g.generated_response for g in r.gens] == ["p 1", "p 3"]


def test_cache_decision():
    m = {"n": 8, "model": "x"}
    assert [resume.cache_action(h, m) for h in (None, m, {"n": 16, "model": "x"}, {"n": 4, "model": "x"}, {"n": 8, "model": "y"})] == ["generate", "reuse", "fallback", "generate", "generate"]


def test_event_windows_of_the_stream_table(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    g = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert g.agg(F.sum("n")).first()[0] == e.count()


def test_stage_reads_what_is_there(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    p = str(tmp_path / "s")
    assert resume.stage(spark, p, build).count() == 3 and resume.stage(spark, p, build).count() == 3 and made == [1]


def test_progress_of_a_stream(spark, tmp_path):
    import time

    lines(tmp_path / "in" / "a.jsonl", [{"id": str(k), "answer": "1", "response": "x"} for k in range(7)])
    seen = resume.Progress()
    spark.streams.addListener(seen)
    try:
        resume.append(resume.record_stream(spark, str(tmp_path / "in"), "id string, answer string, response string"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        for _ in range(100):
            if seen.rows:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert seen.rows == 7 and seen.batches >= 1
