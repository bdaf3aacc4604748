"""Queries over predictors, experiment nodes, pipelines of nodes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalquarry.functions import text as X
from evalquarry.operators import generations, nodes, outcomes, predictors, recursion
from evalquarry.operators.cards import sequestered
from evalquarry.operators.tables import dcol
from evalquarry.plans.base import query
from evalquarry.plans.domain_views import GEN, PARTS, STATS, gen, parts, read, stats
from evalquarry.plans.queries_files import RUNS, _RUNS, as_lines
from evalquarry.session import work_path, written
from evalquarry.sources import records, sinks
from evalquarry.streaming import resume


def run_tables(spark, sf):
    """All stats as the flat tables of a few runs."""
    s = stats(spark, sf).withColumn("run", F.concat(F.lit("run"), (F.col("run") % RUNS).cast("string")))
    run = F.col("run").alias("run_spec.name")
    pert = [F.col("perturbation").alias("stats.name.perturbation.name"), (F.col("count") / 10).alias("stats.name.perturbation.prob")]
    return {
        "run_specs": s.select(run, F.lit("class").alias("run_spec.scenario")).distinct(),
        "stats": s.select(run, F.col("split").alias("stats.name.split"), F.col("metric").alias("stats.name.name"), *pert, F.col("mean").alias("stats.mean"), "row_ord"),
        "scenario_state": s.select(run, F.col("instance_id").cast("string").alias(predictors.INSTANCE), F.col("trial").alias("scenario_state.request_states.train_trial_index")),
        "per_instance_stats": s.select(run, F.col("instance_id").cast("string").alias(predictors.STAT_INSTANCE), F.col("trial").alias("per_instance_stats.train_trial_index"), F.lit("exact_match").alias("per_instance_stats.stats.name.name"), F.lit(None).cast("string").alias("per_instance_stats.perturbation.name"), F.col("mean").alias("per_instance_stats.stats.mean"), "row_ord"),
    }


_DRAWN = "drawn AS (SELECT run_name, row_number() OVER (ORDER BY md5('1:' || run_name), run_name) AS place FROM (SELECT DISTINCT 'run' || run AS run_name FROM stats) t)"
_PERCENT = "(CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT) % 101) / 100.0"


@query("WITH " + _RUNS + ", " + _DRAWN + " SELECT run_name, CASE WHEN place = 4 THEN 'test' ELSE 'train' END AS side FROM drawn WHERE place <= 4")
def sampled_runs(spark, sf):
    """SMP4, UDF2, FIL9, CTL8: three train runs and one test run, whose outcomes are taken away."""
    p = predictors.Predictor(keep=dcol("run_spec.name").isNotNull(), keep_row=dcol("run_spec.scenario") == "class")
    train, test = p.splits(run_tables(spark, sf))
    if set(sequestered(test)) != {"run_specs", "scenario_state"}:
        raise ValueError("the test split shows its outcomes")
    one = lambda t, side: t["run_specs"].select(dcol("run_spec.name").alias("run_name"), F.lit(side).alias("side"))
    return one(train, "train").union(one(test, "test"))


@query("WITH " + _RUNS + ", " + _DRAWN + f" SELECT run_name AS run_spec, {_PERCENT.format("'1:' || run_name")} AS mean, 1 AS count, 0.25 AS sum_squared FROM drawn WHERE place = 4")
def random_run_prediction(spark, sf):
    """UDF3, UDF4, MTH12: a random value for the test run, with the defaults of a prediction."""
    p = predictors.RandomRun()
    train, test = p.splits(run_tables(spark, sf))
    made = predictors.run_predictions(p.predict(train, sequestered(test)).withColumn("stats.sum", F.lit(0.5)))
    return made.select(dcol("run_spec.name").alias("run_spec"), dcol("stats.mean").alias("mean"), dcol("stats.count").alias("count"), dcol("stats.sum_squared").alias("sum_squared"))


@query("WITH " + _RUNS + ", " + _DRAWN + f""", t AS (SELECT s.*, run_name, CAST(instance_id AS VARCHAR) AS i FROM stats s JOIN drawn ON 'run' || run = run_name AND place = 4),
chosen AS (SELECT i FROM (SELECT DISTINCT i FROM t) u ORDER BY md5('1:' || i), i LIMIT 5)
SELECT i AS instance_id, trial, mean AS actual_mean, {_PERCENT.format("concat_ws(':', '1', run_name, i, trial)")} AS predicted_mean FROM t WHERE i IN (SELECT i FROM chosen)""")
def random_instance_prediction(spark, sf):
    """UDF2, UDF3, UDF4, JOI13: random values for sampled instances beside their outcomes."""
    got = predictors.RandomInstance(num_eval_samples=5).evaluate(run_tables(spark, sf))
    return got.select(dcol(predictors.STAT_INSTANCE).alias("instance_id"), dcol("per_instance_stats.train_trial_index").alias("trial"), "actual_mean", "predicted_mean")


@query("WITH " + _RUNS + ", " + _DRAWN + """, f AS (SELECT metric, split, perturbation, round(regr_slope(mean, count / 10.0), 6) AS slope, round(regr_intercept(mean, count / 10.0), 6) AS intercept FROM stats JOIN drawn ON 'run' || run = run_name AND place < 4 WHERE perturbation IS NOT NULL GROUP BY ALL)
SELECT s.metric AS stat_name, s.split, s.perturbation AS perturbation_name, round(intercept + 0.5 * slope, 7) AS predicted_mean, mean AS actual_mean FROM stats s JOIN drawn ON 'run' || run = run_name AND place = 4 JOIN f ON f.metric = s.metric AND f.split = s.split AND f.perturbation = s.perturbation""")
def perturbation_prediction(spark, sf):
    """UDF4, JOI12, JOI15, AGG52: lines over the strength of perturbations in the train runs, compared with the test run."""
    got = predictors.PerturbationRegression().evaluate(run_tables(spark, sf))
    return got.select("stat_name", "split", "perturbation_name", F.round("predicted_mean", 7).alias("predicted_mean"), "actual_mean")


@query("WITH " + _RUNS + " SELECT 'run' || run AS run_name, metric, perturbation, mean, 'class' AS scenario FROM stats WHERE perturbation IS NOT NULL")
def specs_with_perturbed_stats(spark, sf):
    """JOI15."""
    t = run_tables(spark, sf)
    j = predictors.specs_with_perturbed(t["run_specs"], t["stats"])
    return j.select(dcol("run_spec.name").alias("run_name"), dcol("stats.name.name").alias("metric"), dcol("stats.name.perturbation.name").alias("perturbation"), dcol("stats.mean").alias("mean"), dcol("run_spec.scenario").alias("scenario"))


@query("WITH " + GEN + " SELECT avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n_responses, count(DISTINCT id) AS n_questions FROM gen")
def node_inference_eval(spark, sf):
    """CTL6, CTL5: the smoke node as a pipeline of one node."""

    def smoke(spark, params, inputs):
        return nodes.inference_eval(gen(spark, params["tables"]))

    return spark.read.parquet(nodes.dispatch(spark, smoke, work_path(spark, "nodes"), params={"tables": sf})["smoke"])


_DRAG = "WITH " + PARTS + """, c AS (SELECT count(*) FILTER (WHERE correctness) AS t, count(*) AS n FROM direct WHERE id IN (SELECT id FROM onef)), o AS (SELECT avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS a, count(DISTINCT id) AS k FROM onef)
SELECT round(t / n, 6) AS acc_clean, round(a, 6) AS acc_2f, round(t / n - a, 6) AS drag, k AS n_kept_problems, false AS aggregate_failed FROM c, o"""


@query(_DRAG)
def node_drag(spark, sf):
    """CTL6, CTL5, STM15: three nodes in order, each kept under a digest of its parameters; a second run writes nothing."""
    made = []

    def part(k):
        return lambda spark, params, inputs: (made.append(k), parts(spark, params["tables"])[k])[1]

    steps = {"direct": nodes.Node(part(0), {"tables": sf}), "conditioned": nodes.Node(part(1), {"tables": sf})}
    steps["drag"] = nodes.Node(lambda spark, params, x: nodes.drag(x["direct"], x["conditioned"]), {}, ["direct", "conditioned"])
    root = work_path(spark, "nodes")
    at = nodes.dispatch(spark, steps, root)
    if nodes.dispatch(spark, steps, root) != at or sorted(made) != [0, 1]:
        raise ValueError("a finished node ran again")
    r = spark.read.parquet(at["drag"])
    return r.select(*[F.round(c, 6).alias(c) for c in ("acc_clean", "acc_2f", "drag")], "n_kept_problems", "aggregate_failed")


@query("WITH " + PARTS + """, f AS (SELECT id, avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS a FROM onef WHERE finish = 'stop' GROUP BY id), d AS (SELECT id, avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS a FROM direct GROUP BY id)
SELECT round((SELECT avg(a) FROM d WHERE id IN (SELECT id FROM f)), 6) AS acc_direct, round((SELECT avg(a) FROM f), 6) AS acc_conditioned, round((SELECT avg(a) FROM d WHERE id IN (SELECT id FROM f)) - (SELECT avg(a) FROM f), 6) AS delta_acc, (SELECT count(*) FROM f) AS n_filtered, false AS aggregate_failed""")
def node_conditioning(spark, sf):
    """CTL6: the conditioning node; drag-1f and posthoc read the same cells."""
    direct, one, _ = parts(spark, sf)
    r = nodes.conditioning(direct, one, F.col("finish") == "stop")
    return r.select(*[F.round(c, 6).alias(c) for c in ("acc_direct", "acc_conditioned", "delta_acc")], "n_filtered", "aggregate_failed")


@query("SELECT round(count(*) FILTER (WHERE b = 2) / nullif(count(*) FILTER (WHERE b IN (2, 3)), 0), 6) AS recovery_rate, count(*) FILTER (WHERE b IN (2, 3)) AS drag_failed_den, count(*) AS n_observations FROM (SELECT o_orderkey % 8 AS b FROM orders) t")
def node_mitigation(spark, sf):
    """CTL6: the mitigation node over counts of buckets."""
    rows = read(spark, sf, "orders").select(F.element_at(F.array(*[F.lit(b) for b in outcomes.BUCKETS]), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("bucket"))
    return nodes.mitigation(outcomes.bucket_counts(rows)).select("recovery_rate", "drag_failed_den", "n_observations")


@query("WITH " + PARTS + """, d AS (SELECT id, avg(CAST(answer AS DOUBLE)) AS a FROM direct GROUP BY id), o AS (SELECT id, avg(CAST(answer AS DOUBLE)) AS a FROM onef GROUP BY id)
SELECT round((SELECT avg(a) FROM d), 6) AS mean_ted_direct, round((SELECT avg(a) FROM o), 6) AS mean_ted_2f, (SELECT count(*) FROM d JOIN o USING (id)) AS n_problems_with_both, round((SELECT avg(a) FROM d) - (SELECT avg(a) FROM o), 6) AS ted_drag""")
def node_distance(spark, sf):
    """CTL6: the distance node."""
    direct, one, _ = parts(spark, sf)
    side = lambda df: df.select("id", F.col("answer").cast("double").alias("distance"))
    r = nodes.distance(side(direct), side(one))
    return r.select(*[F.round(c, 6).alias(c) for c in ("mean_ted_direct", "mean_ted_2f", "ted_drag")], "n_problems_with_both")


@query("WITH " + GEN + """, p AS (SELECT unnest(['a', 'b']) AS model, unnest([0, 1]) AS k), q AS (SELECT model, t, avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS accuracy FROM p, (SELECT unnest(['stop', 'length']) AS t) u, gen WHERE finish = t AND response_id % 2 = k GROUP BY model, t)
SELECT model, count(*) AS points, round(avg(accuracy), 6) AS mean, count(*) FILTER (WHERE accuracy >= 0.2) AS verified FROM q GROUP BY model""")
def node_grid(spark, sf):
    """CTL7, STM11: a node over a matrix of parameters, several at a time, and the summary of the suite."""

    def point(spark, params, inputs):
        k = {"a": 0, "b": 1}[params["model"]]
        return nodes.inference_eval(gen(spark, params["tables"]).where((F.col("finish") == params["finish"]) & (F.col("response_id") % 2 == k)))

    r = nodes.grid(spark, nodes.Node(point, {"tables": sf}), {"model": ["a", "b"], "finish": ["stop", "length"]}, work_path(spark, "grid"))
    return nodes.suite_summary(r, "model", "accuracy", F.col("accuracy") >= 0.2)


@query("WITH " + GEN + " SELECT id, response_id, CASE WHEN response_id % 5 = 4 THEN NULL ELSE response_id % 2 = 0 END AS correctness FROM gen")
def stream_to_table(spark, sf):
    """STM1, STM3, STM5, STM6, SNK5: a folder of JSON lines, each written twice, through prompt hashes and a verifier into a table, in two runs."""
    g, a, k = gen(spark, sf), F.col("answer"), F.col("response_id")
    said = F.when(k % 5 == 4, "no answer").otherwise(F.concat(F.lit("so \\boxed{"), a, F.lit("}")))
    rows = g.select(F.col("id"), k.alias("response_id"), F.when(k % 2 == 0, a).otherwise(F.concat(a, F.lit("1"))).alias("answer"), said.alias("response"))
    src, out, check = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    schema = "id long, response_id long, answer string, response string"
    for n in range(2):
        # The second run finds the same records in other files, and the rest.
        sinks.write_named(as_lines(rows if n else rows.where("id % 2 = 0")), src, [f"part{n}-{i}.jsonl" for i in range(3)])
        hashed = resume.once(resume.with_hash(resume.record_stream(spark, src, schema), "Q {arg_id} {arg_response_id}"))
        resume.append(resume.verified(hashed), out, check).awaitTermination()
    return spark.read.parquet(out).select("id", "response_id", "correctness")


@query("SELECT item_id, unnest([0, 1, 2]) AS response_id, 'Q ' || item_id || ' seed ' || (10 + unnest([1, 2, 3])) AS generated_response FROM benchmark WHERE item_id % 4 <> 0 UNION ALL SELECT item_id, unnest([0, 2]), 'Q ' || item_id || ' seed ' || (10 + unnest([1, 3])) FROM benchmark WHERE item_id % 4 = 0")
def generated_responses(spark, sf):
    """STM2, UDF7: three seeds per prompt; a request that fails is left out."""

    def model(prompt: str, seed: int) -> str:
        if seed == 12 and int(prompt.split()[1]) % 4 == 0:
            raise RuntimeError("no answer")
        return f"{prompt} seed {seed}"

    b = read(spark, sf, "benchmark").select("item_id")
    prompts = b.withColumn("prompt", X.render("Q {arg_item_id}", ["item_id"]))
    if resume.ask(spark, "Q 1", model, 10) != "Q 1 seed 11":
        raise ValueError("the model does not answer")
    return resume.generated(prompts, model, 3, 10).select("item_id", F.inline("gens")).select("item_id", "response_id", "generated_response")


@query("WITH " + GEN + " SELECT id, response_id, CASE WHEN response_id % 3 = 0 THEN NULL ELSE true END AS correctness FROM gen")
def verified_pairs(spark, sf):
    """STM4: extraction and verification of texts; null where nothing is extracted."""
    a, k = F.col("answer"), F.col("response_id")
    rows = gen(spark, sf).select("id", "response_id", "answer", F.when(k % 3 == 0, "nothing").otherwise(F.concat(F.lit("\\boxed{\\frac{"), a, F.lit("}{1}}"))).alias("response"))
    return resume.verified(rows).select("id", "response_id", "correctness")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS errors FROM orders")
def inference_counters(spark, sf):
    """AGG48: counts that an action reports as it goes."""
    from pyspark.sql import Observation

    seen = Observation("counters")
    rows = resume.counters(read(spark, sf, "orders").select("o_orderkey"), seen, F.col("o_orderkey") % 7 == 0)
    rows.write.mode("overwrite").parquet(work_path(spark, "counted"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["errors"])], "rows long, errors long")


@query("SELECT * FROM (VALUES ('none', 'generate'), ('equal', 'reuse'), ('more samples', 'fallback'), ('fewer samples', 'generate'), ('other model', 'generate')) t(have, action)")
def cache_decisions(spark, sf):
    """STM12."""
    want = {"n": 8, "model": "x"}
    have = {"none": None, "equal": want, "more samples": {"n": 16, "model": "x"}, "fewer samples": {"n": 4, "model": "x"}, "other model": {"n": 8, "model": "y"}}
    return spark.createDataFrame([(k, resume.cache_action(v, want)) for k, v in have.items()], "have string, action string")


@query("WITH " + GEN + " SELECT source, count(*) AS n, 1 AS builds FROM gen GROUP BY source")
def cached_stage(spark, sf):
    """STM7, STM13, STM14: a stage that is built once and read the second time."""
    built = []
    at = work_path(spark, "stage")

    def build():
        built.append(1)
        return gen(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))

    resume.stage(spark, at, build)
    return resume.stage(spark, at, build).withColumn("builds", F.lit(len(built)))


@query("WITH " + GEN + """, ok AS (SELECT id, max(CASE WHEN finish = 'stop' THEN 1 ELSE 0 END) AS done FROM gen GROUP BY id)
SELECT id, CASE WHEN done = 1 THEN 0 ELSE 1 + id % 2 END AS attempts FROM ok""")
def makeup_attempts(spark, sf):
    """STM9, JOI18: problems without a usable response are asked again, those with an odd number twice."""
    g = gen(spark, sf).select("id", "finish", F.lit(0).alias("attempt"))
    seeds = [recursion.makeup_seed(42, 0, a) for a in range(3)]

    def ask(missing, seed):
        n = seeds.index(seed) + 1
        return missing.select("id", F.when((F.col("id") % 2 == 0) | (F.lit(n) > 1), "stop").otherwise("length").alias("finish"), F.lit(n).alias("attempt"))

    expected = g.select("id").distinct()
    rows = recursion.makeup(expected, g, ask, F.col("finish") == "stop", written)
    return rows.groupBy("id").agg(F.max("attempt").alias("attempts"))


@query("SELECT round, count(*) AS n FROM (SELECT o_orderkey, unnest(range(0, CAST(o_orderkey % 4 AS BIGINT) + 1)) AS round FROM orders) t GROUP BY round")
def round_loop(spark, sf):
    """STM8: rounds that each read the one before, until none is left."""
    start = read(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("left"))
    every = recursion.rounds(start, lambda d, r: d.where("left > 0").select((F.col("left") - 1).alias("left")), written, 6)
    return every.groupBy("round").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + GEN + """, d AS (SELECT * FROM gen WHERE response_id = 0)
SELECT 'cm_filter1' AS variant, id, 'clean ' || answer AS context FROM d WHERE id % 3 <> 0 UNION ALL SELECT 'cm_revise1', id, 'revised ' || answer FROM d""")
def context_variants(spark, sf):
    """STM10: drafts cleaned by a strategy, of which empty ones go, or revised."""
    drafts = gen(spark, sf).where("response_id = 0").select("id", "answer")
    strategy = lambda d: d.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("clean "), "answer")).alias("strategy"))
    revise = lambda d: d.select("id", F.concat(F.lit("revised "), "answer").alias("context"))
    solve = lambda d: d.select("id", F.col("context") if "context" in d.columns else F.col("strategy").alias("context"))
    out = [recursion.context_pipeline(drafts, v, strategy, revise, solve).withColumn("variant", F.lit(v)) for v in ("cm_filter1", "cm_revise1")]
    return out[0].unionByName(out[1])


@query("SELECT 'a' AS name, 'from default' AS value")
def settings(spark, sf):
    """SRC33: a setting from the session, the environment, or a default."""
    return spark.createDataFrame([("a", records.setting("no_such_setting", "from default", spark))], "name string, value string")


@query("WITH " + GEN + " SELECT id, count(*) AS n FROM gen GROUP BY id")
def packed_sizes(spark, sf):
    """ARR1: the responses of a record as one array."""
    return generations.pack(gen(spark, sf), ["id"]).select("id", F.size("gens").alias("n"))
