"""The verbs that no query goes through, and the command line."""

from __future__ import annotations

import json

import pytest

from evalquarry import verbs


@pytest.fixture
def lines(tmp_path):
    def write(name, rows):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        return str(path)

    return write


def gens(n=4):
    return [{"id": str(k), "source": "s", "alias": "m", "response_id": j, "answer": str(j), "finish": "stop", "correctness": j % 2 == 0, "response": "x"} for k in range(3) for j in range(n)]


def test_command_line(spark, lines, capsys, tmp_path):
    lines("p/dataset.jsonl", [{"id": "1", "problem": "two"}, {"id": "2", "problem": "three"}])
    assert verbs.main(["inference-dry-run", "--data_path", str(tmp_path / "p"), "--template", "Say {arg_problem}", "--max_questions", "1"]) == ["Say two"]
    assert json.loads(capsys.readouterr().out) == ["Say two"]
    out = verbs.main(["inference-run", "--model", "evalquarry.plans.queries_verbs:echo", "--data_path", str(tmp_path / "p"), "--output", str(tmp_path / "out"), "--n", "2"])
    assert sorted(g.generated_response for r in spark.read.parquet(out).collect() for g in r.gens) == ["three [1]", "three [2]", "two [1]", "two [2]"]
    with pytest.raises(SystemExit):
        verbs.main(["eval-math", "--output", "x"])
    assert {"eval-math", "eval-crux", "eval-game-of-24", "data-aggregate", "data-aggregate-crux", "evaluate", "download", "models", "recursive-run"} <= set(verbs.VERBS)


def test_drafts_of_rounds(spark, lines, tmp_path):
    at = lines("g.jsonl", gens())
    wide = verbs.data_aggregate_iterative(spark, input_path=at, output=str(tmp_path / "wide"), num=2, round_num=3)
    rows = spark.read.json(wide).collect()
    assert len(rows) == 3 and all(r["round"] == 3 and r.traj1_answer != r.traj2_answer for r in rows)
    one = spark.read.json(verbs.data_minimal_aggregate_flatten(spark, input_path=wide, output=str(tmp_path / "one")))
    assert one.count() == 6 and {r.draft_no for r in one.collect()} == {1, 2}
    (tmp_path / "splits").mkdir()
    (tmp_path / "splits" / "rl.json").write_text('["1"]')
    crux = verbs.VERBS["data-aggregate-crux"](spark, input_path=at, output=str(tmp_path / "crux"), min_num_true_sampling=1, data_split="rl", split_root=str(tmp_path / "splits"))
    assert [r.id for r in spark.read.json(crux).collect()] == ["1"]


def test_round_postprocessing(spark, lines, tmp_path):
    lines("in/a.jsonl", [{"id": "1", "alias": "m", "response_id": 0, "response": "<think>a</think>b"}])
    out = verbs.data_stage1_postprocess_iterative(spark, input_dir=str(tmp_path / "in"), output=str(tmp_path / "post"), round_num=2)
    r = spark.read.json(out).first()
    assert (r.final, r.response_unique_id) == ("b", "1-m-0-round2")


def test_rendering_and_catalogs(spark, lines, tmp_path):
    s = lines("s.jsonl", [{"dataset": "a", "model": "x", "delta": 0.5}, {"dataset": "a", "model": "y", "delta": 0.25}])
    assert verbs.analysis_error_conditioning_visualize(spark, summaries=s, names="x,y").splitlines()[2] == "| a | 0.5 | 0.25 |"
    assert "| a |" in verbs.analysis_ted_render(spark, summary=s) and verbs.analysis_mitigation_buckets_render(spark, summary=s).startswith("|")
    (tmp_path / "models.json").write_text(json.dumps({"b": {"size": 1}, "a": {"size": 2}}))
    assert verbs.inference_list_models(spark, registry=str(tmp_path / "models.json")) == ["a", "b"]
    for v in ("v1.2", "v1.10"):
        (tmp_path / "store" / "bench" / "benchmark_output" / "runs" / v / "b:model=m").mkdir(parents=True)
        (tmp_path / "store" / "bench" / "benchmark_output" / "runs" / v / "b:model=m" / "stats.json").write_text(v)
    store = {"store": str(tmp_path / "store"), "benchmark": "bench", "target": str(tmp_path / "got")}
    assert verbs.download(spark, **store, list_versions=True) == ["v1.2", "v1.10"]
    assert len(verbs.download(spark, **store)) == 1 and verbs.download(spark, **store) == []
    assert (tmp_path / "got" / "b:model=m" / "stats.json").read_text() == "v1.10"
    assert verbs.materialize_run(spark, run_entry="z:model=q", precomputed_root=str(tmp_path / "store" / "bench"), target=str(tmp_path / "got")) is None
