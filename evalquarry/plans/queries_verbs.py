"""Queries through the verbs: files made of the tables, a verb over them, and what it wrote."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evalquarry import verbs
from evalquarry.plans.base import query
from evalquarry.plans.domain_views import GEN, PARTS, gen, parts, read
from evalquarry.plans.queries_files import as_lines
from evalquarry.plans.queries_generations import _CURVE, _WINDOWS
from evalquarry.session import work_path
from evalquarry.sources import sinks
from evalquarry.sources.records import children


def echo(prompt: str, seed: int) -> str:
    """A model that says what it was asked and with which seed."""
    return f"{prompt} [{seed}]"


ECHO = f"{__name__}:echo"


def lines(df, name: str = "dataset.jsonl", parts_: int = 1) -> str:
    """JSON lines in a folder of their own."""
    return sinks.write_named(as_lines(df), work_path(df.sparkSession, "lines"), [name] if parts_ == 1 else [f"dataset-{i}of{parts_}.jsonl" for i in range(1, parts_ + 1)])


def packed_records(spark, sf):
    """Problems with their responses, right where the flag says so; without a flag nothing is boxed."""
    g = gen(spark, sf)
    said = F.when(F.col("correctness").isNull(), "no idea").otherwise(F.concat(F.lit("so \\boxed{"), F.when(F.col("correctness"), "7").otherwise("8"), F.lit("}")))
    one = F.struct("response_id", said.alias("generated_response"), F.col("finish").alias("finish_reason"))
    return g.groupBy(F.col("id").cast("string").alias("id"), "source").agg(F.array_sort(F.collect_list(one)).alias("generations")).withColumn("answer", F.lit("\\frac{14}{2}"))


def flat(df):
    """Generations as the analysis verbs read them."""
    verdict = F.concat(F.lit("<overall_verdict> "), F.when(F.col("finish") == "stop", "incorrect").otherwise("correct"), F.lit(" </overall_verdict>"))
    return df.select(F.col("id").cast("string").alias("id"), "source", "alias", "response_id", verdict.alias("response"), "answer", "finish", "correctness")


@query("WITH " + _WINDOWS + ", p AS (SELECT id, source, k, i, CAST(coalesce(bool_or(correctness), false) AS DOUBLE) AS v FROM w GROUP BY ALL)" + _CURVE.format(n="pass"))
def verb_eval_math(spark, sf):
    """eval math: the curves that the verb writes (ARR1, AGG4, SNK6)."""
    at = lines(packed_records(spark, sf), parts_=3)
    done = verbs.eval_math(spark, dataset_dir=at, output=work_path(spark, "eval"))
    c = spark.read.schema("source string, k long, pass_at_k double, std_pass_at_k double").json(done["curves"])
    return c.select("source", "k", F.round("pass_at_k", 6).alias("pass_at_k"), F.round("std_pass_at_k", 6).alias("std_pass_at_k"))


@query("WITH " + GEN + " SELECT CAST(id AS VARCHAR) AS id, response_id, CASE WHEN response_id % 3 < 2 THEN response_id % 3 = 0 END AS correctness FROM gen")
def verb_eval_game_of_24(spark, sf):
    """eval game_of_24 over flat records."""
    k = F.col("response_id") % 3
    said = F.when(k == 0, "\\boxed{12 + 6 × 2 = 24}").when(k == 1, "\\boxed{12 + 6 + 2}").otherwise("none")
    g = gen(spark, sf).select(F.col("id").cast("string").alias("id"), "source", "response_id", said.alias("response"), "finish", F.array(*[F.lit(x).cast("long") for x in (12, 6, 2)]).alias("numbers"))
    done = verbs.eval_game_of_24(spark, dataset_dir=lines(g), output=work_path(spark, "eval"), data_format="flat", flatten=True)
    return spark.read.schema("id string, response_id long, correctness boolean").json(done["flat"])


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_regionkey <> 2 AS correctness FROM region")
def verb_eval_crux(spark, sf):
    """eval crux, with consent to run code."""
    k = F.col("r_regionkey")
    said = F.concat(F.lit("[ANSWER]f(2) == "), F.when(k == 2, "5").otherwise("4"), F.lit("[/ANSWER]"))
    r = read(spark, sf, "region").select(k.cast("string").alias("id"), F.col("r_name").alias("source"), F.lit("f(2)").alias("answer"), F.lit("output").alias("mode"), F.lit("def f(x): return x * 2").alias("code"), F.array(F.struct(F.lit(0).cast("long").alias("response_id"), said.alias("generated_response"), F.lit("stop").alias("finish_reason"))).alias("generations"))
    done = verbs.eval_crux(spark, dataset_dir=lines(r), output=work_path(spark, "eval"), allow_code=True)
    return spark.read.parquet(done["evaluated"]).select("id", "correctness")


@query("WITH " + GEN + """, c AS (SELECT id FROM gen GROUP BY id HAVING count(*) FILTER (WHERE NOT coalesce(correctness, false)) >= 2 AND count(*) FILTER (WHERE correctness) >= 1),
r AS (SELECT id, response_id, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', '42', id, response_id)), response_id) AS n FROM gen WHERE NOT coalesce(correctness, false) AND id IN (SELECT id FROM c))
SELECT CAST(id AS VARCHAR) AS id, count(*) AS drafts FROM r WHERE n <= 2 GROUP BY id""")
def verb_data_aggregate(spark, sf):
    """data aggregate: two wrong drafts of problems that have them and a right one (AGG57, FLT19)."""
    out = verbs.data_aggregate(spark, input_path=lines(flat(gen(spark, sf))), output=work_path(spark, "drafts"), min_num_true_sampling=1, min_num_false_sampling=2)
    wide = spark.read.schema("id string, traj1_response_id long, traj2_response_id long").json(out)
    return wide.select("id", (F.col("traj1_response_id").isNotNull().cast("long") + F.col("traj2_response_id").isNotNull().cast("long")).alias("drafts"))


@query("WITH " + GEN + " SELECT CAST(id AS VARCHAR) AS id, response_id, concat_ws('-', id, alias, response_id) AS response_unique_id, 'final ' || answer AS final, 'parsable_thinking' AS thinking_status FROM gen")
def verb_postprocess(spark, sf):
    """data initial-sampling-postprocess (SRC6, STR2, FLT14, FLT23)."""
    g = gen(spark, sf).select(F.col("id").cast("string").alias("id"), "alias", "response_id", F.concat(F.lit("<think>hm</think>final "), "answer").alias("response"))
    out = verbs.data_initial_sampling_postprocess(spark, input_dir=lines(g, parts_=2), output=work_path(spark, "post"))
    return spark.read.schema("id string, response_id long, response_unique_id string, final string, thinking_status string").json(out)


@query("WITH " + PARTS + """, f AS (SELECT id, avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS a FROM onef WHERE finish = 'stop' GROUP BY id), r AS (SELECT id, avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS a FROM onef GROUP BY id), d AS (SELECT id, avg(CASE WHEN correctness THEN 1.0 ELSE 0.0 END) AS a FROM direct GROUP BY id)
SELECT round((SELECT avg(a) FROM r), 6) AS raw, round((SELECT avg(a) FROM f), 6) AS filtered, round((SELECT avg(a) FROM d WHERE id IN (SELECT id FROM r)), 6) AS direct_raw, round((SELECT avg(a) FROM d WHERE id IN (SELECT id FROM f)), 6) AS direct_filtered""")
def verb_error_conditioning(spark, sf):
    """analysis error_conditioning run (AGG11, FIL7)."""
    direct, one, _ = parts(spark, sf)
    out = verbs.analysis_error_conditioning_run(spark, cond_jsonl=lines(flat(one)), direct_jsonl=lines(flat(direct)), out=work_path(spark, "cells"), setting="1f")
    names = ["raw", "filtered", "direct_raw", "direct_filtered"]
    return spark.read.schema(", ".join(f"{n} double" for n in names)).json(out).select(*[F.round(n, 6).alias(n) for n in names])


@query("WITH " + PARTS + """, r AS (SELECT 'd' AS s, id, NULL AS k, avg(CAST(correctness AS INT)) AS v FROM direct GROUP BY id UNION ALL SELECT 'o', id, answer, avg(CAST(correctness AS INT)) FROM onef GROUP BY id, answer UNION ALL SELECT 'm', id, answer, avg(CAST(correctness AS INT)) FROM mit GROUP BY id, answer)
SELECT count(*) AS n, count(*) FILTER (WHERE d.v >= 0.5 AND o.v >= 0.5 AND m.v >= 0.5) AS unaffected, count(*) FILTER (WHERE d.v < 0.5 AND o.v < 0.5 AND m.v < 0.5) AS robust_failure FROM r m JOIN r o ON o.s = 'o' AND o.id = m.id AND o.k = m.k JOIN r d ON d.s = 'd' AND d.id = m.id WHERE m.s = 'm' AND m.v IS NOT NULL AND o.v IS NOT NULL AND d.v IS NOT NULL""")
def verb_mitigation_buckets(spark, sf):
    """analysis mitigation_buckets run (JOI4, AGG12 to AGG15)."""
    direct, one, mit = (lines(flat(p)) for p in parts(spark, sf))
    out = verbs.analysis_mitigation_buckets_run(spark, direct_jsonl=direct, onef_jsonl=one, mitigated_jsonl=mit, out=work_path(spark, "buckets"))
    return spark.read.schema("n long, unaffected long, robust_failure long").json(out)


@query("WITH " + GEN + """, a AS (SELECT id, answer, lag(answer) OVER (PARTITION BY id ORDER BY response_id) AS d FROM gen), anchored AS (SELECT DISTINCT id, d FROM a WHERE d IS NOT NULL),
x AS (SELECT a.id, a.d, avg(levenshtein(a.answer, a.d)) AS v FROM a WHERE a.d IS NOT NULL GROUP BY a.id, a.d), i AS (SELECT n.id, n.d, avg(levenshtein(g.answer, n.d)) AS v FROM anchored n JOIN gen g ON g.id = n.id GROUP BY n.id, n.d),
p AS (SELECT x.id, avg(x.v) AS xv, avg(i.v) AS iv FROM x JOIN i ON x.id = i.id AND x.d = i.d GROUP BY x.id)
SELECT round(avg(xv), 6) AS anchored, round(avg(iv), 6) AS init, count(*) AS both FROM p""")
def verb_ted(spark, sf):
    """analysis ted build_cache and summarize (AGG56, AGG20)."""
    from pyspark.sql import Window as W

    g = gen(spark, sf)
    a = g.select(F.col("id").cast("string").alias("id"), "answer", F.lag("answer").over(W.partitionBy("id").orderBy("response_id")).alias("d")).where("d IS NOT NULL").select("id", F.array("d").alias("drafts"), "answer")
    cache = verbs.analysis_ted_build_cache(spark, anchored_jsonl=lines(a), init_jsonl=lines(flat(g)), out=work_path(spark, "ted"))
    s = spark.read.schema("anchored double, init double, both long").json(verbs.analysis_ted_summarize(spark, cache=cache, out=work_path(spark, "ted")))
    return s


@query("SELECT CAST(item_id AS VARCHAR) AS id, i AS response_id, 'Q ' || item_id || ' [' || (CASE WHEN item_id < 10 THEN 1 ELSE 6 END + i) || ']' AS said FROM benchmark, (SELECT unnest([0, 1]) AS i) t")
def verb_inference_run(spark, sf):
    """inference run, twice: the second run asks only for what the first did not (STM2, STM6, JOI17)."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("item_id").cast("string").alias("problem"))
    out = work_path(spark, "answers")
    verbs.inference_run(spark, model=ECHO, data_path=lines(b.where("item_id < 10")), output=out, template="Q {arg_problem}", n=2, seed=0)
    verbs.inference_run(spark, model=ECHO, data_path=lines(b), output=out, template="Q {arg_problem}", n=2, seed=5)
    return spark.read.parquet(out).select("id", F.inline("gens")).select("id", "response_id", F.col("generated_response").alias("said"))


@query("WITH " + GEN + " SELECT CAST(id AS VARCHAR) AS id, 'Solve with: Revise: ' || answer || ' [1] [1]' AS said FROM gen WHERE response_id = 0")
def verb_mitigation_run(spark, sf):
    """mitigation run: drafts revised, then solved (STM10)."""
    d = gen(spark, sf).where("response_id = 0").select(F.col("id").cast("string").alias("id"), F.col("answer").alias("traj1"))
    out = verbs.mitigation_run(spark, model=ECHO, drafts=lines(d), output=work_path(spark, "mit"), variant="cm_revise1", n=1)
    return spark.read.parquet(out).select("id", F.element_at("gens", 1)["generated_response"].alias("said"))


@query("SELECT round, count(*) AS n, max(c) AS calls FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS round, unnest([0, 1, 2]) AS c FROM orders) t GROUP BY round")
def verb_recursive_run(spark, sf):
    """recursive run: two rounds after the first drafts (STM8)."""
    d = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("draft").alias("draft"))
    out = verbs.recursive_run(spark, model=ECHO, init=lines(d), output=work_path(spark, "rounds"), max_recursive_steps=2, n_samples_solve=1)
    return spark.read.parquet(out).groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.max(F.regexp_count("draft", F.lit("Improve: "))).alias("calls"))


@query("SELECT 'FALSIFIED' AS status, count(*) FILTER (WHERE n_nationkey < 20) AS verified, count(*) AS n FROM nation")
def verb_evaluate(spark, sf):
    """evaluate: a card from a JSON document over a sweep of all nations (CTL1 to CTL4, AGG44, UDF6)."""
    keys = [r[0] for r in read(spark, sf, "nation").select("n_nationkey").collect()]
    card = {"title": "keys", "claim": "twice < 40", "symbols": {"key": {"sweep": keys, "type": "bigint"}, "twice": {"sql": "key * 2", "depends_on": ["key"]}}}
    at = sinks.write_each(spark.createDataFrame([("card", json.dumps(card))], "key string, value string"), work_path(spark, "card"), "card.json")
    out = verbs.evaluate(spark, path=f"{at}/card/card.json", output=work_path(spark, "verdict"))
    return spark.read.schema("status string, verified long, n long").json(out)


@query("""SELECT '| org | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || org || ' | ' || n || ' |', chr(10) ORDER BY org) AS body FROM (SELECT 'r' || n_regionkey AS org, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1) t""")
def verb_models(spark, sf):
    """The registry of models: filtered, grouped, sorted and printed (SRC23, SRC25, FIL11, FIL17, AGG29, SRT2)."""
    rows = {r[0]: {"org": f"r{r[1]}", "size": r[2]} for r in read(spark, sf, "nation").select("n_name", "n_regionkey", "n_nationkey").collect()}
    at = sinks.write_each(spark.createDataFrame([("models", json.dumps(rows))], "key string, value string"), work_path(spark, "models"), "models.json")
    body = verbs.models(spark, registry=f"{at}/models/models.json", query="CAST(size AS INT) > 3", groupby="org", sort="org")
    return spark.createDataFrame([(body,)], "body string")


@query("SELECT 'b:lang=en,model=org_m1' AS best, true AS there")
def verb_materialize_run(spark, sf):
    """The run materialiser: the precomputed run with the fewest other tokens, copied into place (FIL13, SRT7, STM15)."""
    names = ["b:lang=en,model=org_m1", "b:lang=en,model=org_m1,flag", "b:lang=de,model=org_m1", "c:lang=en,model=org_m1"]
    root = work_path(spark, "precomputed")
    docs = spark.createDataFrame([(n, "{}") for n in names], "key string, value string")
    for name in ("run_spec.json", "scenario_state.json", "stats.json"):
        sinks.write_each(docs, f"{root}/benchmark_output/runs/v1", name)
    at = verbs.materialize_run(spark, run_entry="b:model=org/m1,lang=en", precomputed_root=root, target=work_path(spark, "local"))
    there = {p.rsplit("/", 1)[1] for p, _ in children(spark, at)} == {"run_spec.json", "scenario_state.json", "stats.json"}
    return spark.createDataFrame([(at.rsplit("/", 1)[1], there)], "best string, there boolean")
