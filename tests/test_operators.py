"""Operators on small fixtures: edge cases and errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalquarry.operators import cards, curves, distances, flows, generations, joins, outcomes, recursion, runs, tables


def test_pass_curve_by_hand(spark):
    rows = [("a", "s", [(0, "1", True), (1, "2", False), (2, "2", False), (3, "2", False)]), ("b", "s", [(0, "1", True), (1, "1", None), (2, "2", False), (3, "3", False)])]
    df = spark.createDataFrame(rows, "id string, source string, gens array<struct<response_id:int,answer:string,correctness:boolean>>")
    got = {(r.source, r.k): (round(r.pass_at_k, 6), round(r.maj_at_k, 6)) for r in curves.curves_by_source(df).collect()}
    assert [got["s", k][0] for k in (1, 2, 3, 4)] == [0.25, 0.5, 0.75, 1.0]
    assert got["overall", 4] == got["s", 4]
    same = {(r.source, r.k): round(r.maj_at_k, 6) for r in curves.curves_by_source(df, majority="equivalent").collect()}
    assert all(same[k] == got[k][1] for k in got)


def test_unbiased_pass_at_k(spark):
    f = lambda n, c, k: spark.range(1).select(curves.unbiased_pass_at_k(F.lit(n), F.lit(c), k)).first()[0]
    assert f(4, 0, 2) == 0 and f(4, 3, 2) == 1
    assert abs(f(4, 2, 2) - (1 - 1 / 6)) < 1e-9


def test_recursive_traces(spark):
    make = lambda runs_: spark.createDataFrame([(i, s, v) for i, t in enumerate(runs_) for s, v in t.items()], "run_id int, step int, pass_at_1 double")
    r = recursion.trace_summary(make([{0: 0.5, 1: 0.6, 2: 0.7}, {0: 0.4, 1: 0.5, 2: 0.8}, {0: 0.6, 1: 0.7, 2: 0.6}])).first()
    assert (r.max_step_reached, r.acc_round_0, r.acc_round_max, r.delta) == (2, 0.5, 0.7, 0.2)
    r = recursion.trace_summary(make([{0: 0.5, 1: 0.4}, {0: 0.5, 1: 0.6, 2: 0.9}])).first()
    assert (r.max_step_reached, r.acc_round_max) == (1, 0.5)
    r = recursion.trace_summary(make([])).first()
    assert r.aggregate_failed and r.delta is None


def test_empty_drafts_raise_plainly(spark):
    g = spark.createDataFrame([("a", 0, True)], "id string, response_id int, correctness boolean")
    with pytest.raises(ValueError, match="no problem has enough"):
        generations.combine(g)
    with pytest.raises(ValueError):
        generations.having_pools(g, 0, 1, num_false=2)


def test_explode_generations(spark):
    ddl = "id string, t_prompt string, t_generations array<struct<response_id:bigint,generated_response:string,finish_reason:string,extracted_answer:string,correctness:boolean>>"
    df = spark.createDataFrame([("a", "p", [(0, "<think>x</think>y", "stop", None, None)]), ("b", "p", [])], ddl)
    r = generations.explode_generations(df, "t").collect()
    assert len(r) == 1 and r[0].t_final == "y" and r[0].t_thinking_status == "parsable_thinking" and r[0].t_generations_response_id == 0
    assert generations.first_generation(df, "t", "final").count() == 1


def test_records(spark):
    df = spark.createDataFrame([("a", "q")], "id string, problem string").withColumn("g", F.array(F.struct(F.lit(0).alias("response_id"))))
    r = generations.build_record(df, "t", F.col("problem"), F.col("g"), 1, "p", "k", "m").first()
    assert set(r.t_generations_metadata.asDict()) == {"num_responses", "n_samples_requested", "n_samples_variant_default", "template_path", "template_key", "model_config_alias", "prompt_hash"}
    with pytest.raises(ValueError, match="missing"):
        generations.postprocess(df)


def test_lookup_errors(spark):
    left, twice = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    with pytest.raises(Exception, match="key repeats: 1"):
        joins.lookup(left, twice, "id", "v", "w").collect()
    with pytest.raises(Exception, match="key missing: 2"):
        joins.lookup(left, twice.where("v = 'a'"), "id", "v", "w").collect()
    assert [tuple(r) for r in joins.lookup(left, twice.where("v <> 'b'"), "id", "v", "w").orderBy("id").collect()] == [(1, "a"), (2, "c")]


def test_null_meets_null(spark):
    a, b = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int"), spark.createDataFrame([(None, 3), ("y", 4)], "k string, v int")
    assert [tuple(r) for r in joins.null_safe(a, b, [("k", "k")]).collect()] == [(None, 1, 3)]


def test_varied_values(spark):
    df = spark.createDataFrame([("on", 1.0), ("off", 2.0), ("on", 3.0), ("on", float("nan"))], "a string, b double").withColumn("c", F.lit(1))
    got = {}
    for r in joins.varied_values(df).collect():
        got.setdefault(r.column, {})[r.value] = r.n
    assert got == {"a": {"on": 3, "off": 1}, "b": {"1.0": 1, "2.0": 1, "3.0": 1, "NaN": 1}}


def test_zip_needs_equal_lengths(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    assert [tuple(r) for r in joins.zipped(df, "x", "y").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="length"):
        joins.zipped(spark.createDataFrame([([1], ["a", "b"])], df.schema), "x", "y").collect()


def test_document_paths():
    assert joins.leaf_paths({"a": {"b": 1}, "c": [1, {"d": None}], "e": {}}) == [("a.b", "1"), ("c.0", "1"), ("c.1.d", "null"), ("e", "{}")]


def test_dotted_tables(spark):
    df = spark.createDataFrame([((1, (2, [3])), "r")], "a struct<x:int,y:struct<z:int,w:array<int>>>, `run_spec.name` string")
    flat = tables.flatten(df)
    assert flat.columns == ["a.x", "a.y.z", "a.y.w", "run_spec.name"]
    assert tables.prefix_columns(flat, "a", drop=True).columns == ["x", "y.z", "y.w"]
    assert tables.reorder(flat, ["run_spec.name"], ["nope"], missing="fill", fill=0).columns == ["run_spec.name", "a.x", "a.y.z", "a.y.w", "nope"]
    assert tables.match_columns(flat, "a.*") == ["a.x", "a.y.z", "a.y.w"]
    assert tables.shorten_columns(flat).columns == ["x", "z", "w", "name"]
    assert tables.shortest_suffixes(["a.m.f1", "b.m.f1", "c.g"]) == {"a.m.f1": "a.m.f1", "b.m.f1": "b.m.f1", "c.g": "g"}


def test_numbered_is_gapless(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v"))
    r = tables.numbered(df, ["v"]).collect()
    assert all(x.v == x.predict_id for x in r) and len(r) == 1000


def test_versions(spark):
    df = spark.createDataFrame([("v1.10.0",), ("v1.9.9",), ("v0.99",)], "version string")
    assert tables.latest_version(df).first()[0] == "v1.10.0"


def test_agreement_with_itself(spark):
    a = spark.createDataFrame([("m", None, 1.0, "core"), ("n", "p", 0.0, "x")], "metric string, perturbation string, mean double, class string")
    r = {x.group: x.ratio for x in runs.value_agreement(a, a, ["metric", "perturbation"]).collect()}
    assert r == {"overall": 1.0, "core": 1.0, "x": 1.0}
    b = a.withColumn("mean", F.col("mean") + 1)
    assert {x.group: x.mismatched for x in runs.value_agreement(a, b, ["metric", "perturbation"]).collect()}["overall"] == 2


def test_instance_stats_fall_back(spark):
    stats = spark.createDataFrame([("i1", 0, None, 1), ("i1", 0, "p", 2), ("i2", 0, None, 3)], "instance_id string, trial int, perturbation string, s int")
    states = spark.createDataFrame([("i1", 0, "p", "x", 0), ("i1", 0, "p", "y", 1)], "instance_id string, trial int, perturbation string, prompt string, ord int")
    got = {r.s: (r.prompt, r.matched) for r in runs.joined_instance_stats(stats, states, "ord").collect()}
    assert got == {1: ("x", "fallback"), 2: ("x", "exact"), 3: (None, "unmatched")}


def test_cards(spark):
    c = cards.Card("t", "x > y", {"x": cards.Symbol(sweep=[1, 2, 3]), "y": cards.Symbol(value=2)})
    verdicts, total = cards.evaluate(c, spark)
    assert [r.status for r in verdicts.orderBy("point").collect()] == ["FALSIFIED", "FALSIFIED", "VERIFIED"] and total.first().status == "FALSIFIED"
    assert cards.evaluate(c, spark, "any")[1].first().status == "VERIFIED"
    assert cards.evaluate(c, spark, "fraction", 0.3)[1].first().status == "VERIFIED"
    assert cards.evaluate(c, spark, overrides={"y": 0})[1].first().status == "VERIFIED"
    assert {r.status for r in cards.evaluated(verdicts.drop("status"), "no_such > 1").collect()} == {"INCONCLUSIVE"}
    with pytest.raises(KeyError):
        c.replaced({"z": 1})
    with pytest.raises(ValueError):
        cards.dependency_order({"a": cards.Symbol(sql="b", depends_on=["b"]), "b": cards.Symbol(sql="a", depends_on=["a"])})


def test_no_verdict_is_inconclusive(spark):
    assert cards.reduce_verdicts(spark.createDataFrame([], "status string")).first().status == "INCONCLUSIVE"


def test_flows(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    e = flows.edges(df, flows.stage_path(("s", F.col("x")), ("t", F.col("y"))))
    assert [tuple(r) for r in e.collect()] == [("s: a", "t: b", 1)]
    assert flows.node_order([("a", "b"), ("b", "c")]) == ["a", "b", "c"]
    assert set(flows.node_order([("a", "b"), ("b", "a")])) == {"a", "b"}


def test_buckets_zero_filled(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 1.0)], "d double, o double, m double").withColumn("bucket", outcomes.bucket(F.col("d"), F.col("o"), F.col("m")))
    r = outcomes.bucket_counts(rows).first()
    assert r.recoverable_drag == 1 and sum(r) == 1
    d = outcomes.derived_rates(outcomes.bucket_counts(rows)).first()
    assert d.recovery == 1.0 and d.iatrogenic is None
    assert outcomes.phi(spark.createDataFrame([(1, 0, 0, 0)], "tt int, tf int, ft int, ff int")).first().phi is None


def test_distance_reductions(spark):
    f = lambda how: spark.range(1).select(distances.reduce_distances(F.array(F.lit(1.0), F.lit(4.0), F.lit(2.0), F.lit(9.0)), how)).first()[0]
    assert [f(h) for h in ("min", "mean", "max", "median")] == [1.0, 4.0, 9.0, 3.0]


def test_distance_cache_of_all_metrics(spark):
    anchored = spark.createDataFrame([("a", ["1+2", "3"], "1+3")], "id string, drafts array<string>, answer string")
    init = spark.createDataFrame([("a", "3")], "id string, answer string")
    got = {(r.side, r.metric): r.distances for r in distances.build_cache(anchored, init, ["levenshtein", "tree", "binary"]).collect()}
    assert got["anchored", "levenshtein"] == [1.0, 2.0] and got["anchored", "tree"] == [1.0, 2.0] and got["init", "binary"] == [1.0, 1.0]


def test_makeup_stops(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = spark.createDataFrame([("a", True)], "id string, ok boolean")
    seeds = []

    def generate(missing, seed):
        seeds.append(seed)
        return missing.select("id", F.lit(len(seeds) > 1).alias("ok"))

    out = recursion.makeup(expected, rows, generate, F.col("ok"), lambda df, n: spark.createDataFrame(df.collect(), df.schema), step=2)
    assert seeds == [42 + 2 * 100_003 + 1_009, 42 + 2 * 100_003 + 2 * 1_009]
    assert out.where("ok").select("id").distinct().count() == 2


def test_rounds(spark):
    out = recursion.rounds(spark.range(4), lambda df, r: df.where(F.col("id") >= 2 * r), lambda df, n: df, 5)
    assert {(r.round, r["count"]) for r in out.groupBy("round").count().collect()} == {(0, 4), (1, 2)}


def test_device_pools(spark):
    assert recursion.device_pools(["0", "1", "2"], 2) == [["0", "1"]]
    assert recursion.device_pools(["0"], 2) == [["0"]]
    assert spark.createDataFrame([(["0", "1", "2", "3"],)], "x array<string>").select(recursion.device_pools_column(F.col("x"), 2)).first()[0] == [["0", "1"], ["2", "3"]]
