"""Queries over generations: curves, errors, conditioning, outcomes, sampling and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalquarry.operators import curves, distances, flows, generations, joins, outcomes, recursion
from evalquarry.plans.base import query
from evalquarry.plans.domain_views import GEN, PARTS, gen, parts, read

_WINDOWS = GEN + """, sized AS (SELECT id, source, count(*) AS n FROM gen GROUP BY id, source), starts AS (SELECT id, source, n, unnest(range(n)) AS i FROM sized), spans AS (SELECT *, unnest(range(1, n + 1)) AS k FROM starts), w AS (
  SELECT s.id, s.source, s.k, s.i, g.response_id, g.answer, g.correctness, (g.response_id - s.i + s.n) % s.n AS pos
  FROM spans s JOIN gen g ON g.id = s.id AND (g.response_id - s.i + s.n) % s.n < s.k)"""
_CURVE = """, m AS (SELECT source, k, i, avg(v) AS v FROM (SELECT source, k, i, v FROM p UNION ALL SELECT 'overall', k, i, v FROM p) GROUP BY ALL)
SELECT source, k, round(avg(v), 6) AS {n}_at_k, round(stddev_pop(v), 6) AS std_{n}_at_k FROM m GROUP BY source, k"""


def _packed(spark, sf):
    return generations.pack(gen(spark, sf), ["id", "source"])


@query("WITH " + _WINDOWS + ", p AS (SELECT id, source, k, i, CAST(coalesce(bool_or(correctness), false) AS DOUBLE) AS v FROM w GROUP BY ALL)" + _CURVE.format(n="pass"))
def pass_at_k_by_source(spark, sf):
    """AGG1, AGG2, AGG4, WIN1."""
    c = curves.curves_by_source(_packed(spark, sf), majority=None)
    return c.select("source", "k", F.round("pass_at_k", 6).alias("pass_at_k"), F.round("std_pass_at_k", 6).alias("std_pass_at_k"))


@query("WITH " + _WINDOWS + """, a AS (SELECT id, source, k, i, answer, count(*) AS c, min(pos) AS first, arg_max(coalesce(CAST(correctness AS INT), 0), pos) AS last FROM w GROUP BY ALL),
t AS (SELECT id, source, k, i, count_if(correctness) AS r FROM w GROUP BY ALL),
b AS (SELECT id, source, k, i, last FROM a QUALIFY row_number() OVER (PARTITION BY id, source, k, i ORDER BY c DESC, first) = 1),
p AS (SELECT id, source, k, i, CAST(CASE WHEN r * 2 > k THEN 1 WHEN r = 0 THEN 0 ELSE last END AS DOUBLE) AS v FROM t JOIN b USING (id, source, k, i))""" + _CURVE.format(n="maj"))
def maj_at_k_by_source(spark, sf):
    """AGG3, AGG4, SMP5."""
    c = curves.curves_by_source(_packed(spark, sf))
    return c.select("source", "k", F.round("maj_at_k", 6).alias("maj_at_k"), F.round("std_maj_at_k", 6).alias("std_maj_at_k"))


@query("WITH " + GEN + """, c AS (SELECT id, count(*) AS n, count_if(correctness) AS c FROM gen GROUP BY id)
SELECT k, round(avg(CASE WHEN n - c < k THEN 1.0 ELSE 1 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda j: 1.0 - k / j)), 1.0) END), 6) AS pass_at_k
FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE n >= k GROUP BY k""")
def unbiased_pass_at_k(spark, sf):
    """AGG5."""
    c = gen(spark, sf).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if("correctness").cast("int").alias("c"))
    rows = c.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("n") >= k, curves.unbiased_pass_at_k(F.col("n"), F.col("c"), k)).alias("p")) for k in (1, 2, 3)])))
    return rows.where("p IS NOT NULL").groupBy("k").agg(F.round(F.avg("p"), 6).alias("pass_at_k"))


@query("WITH " + GEN + " SELECT finish, count(*) AS n, count_if(correctness) AS correct, count_if(NOT correctness) AS incorrect, count_if(correctness IS NULL) AS unparsable FROM gen GROUP BY finish")
def error_analysis_by_finish(spark, sf):
    """AGG6."""
    return curves.finish_statistics(gen(spark, sf))


@query("WITH " + GEN + """, q AS (SELECT id, count(*) AS n, count_if(correctness) AS t, count_if(correctness IS NULL) AS u FROM gen GROUP BY id)
SELECT count(*) AS questions, CAST(sum(n) AS BIGINT) AS responses, CAST(sum(t) AS BIGINT) AS correct, CAST(sum(u) AS BIGINT) AS unparsable, count_if(t = 0) AS all_incorrect, count_if(u = n) AS all_unparsable, round(sum(t) / sum(n), 6) AS accuracy FROM q""")
def evaluation_totals(spark, sf):
    """AGG6, AGG7, AGG26."""
    return curves.question_statistics(gen(spark, sf))


@query("WITH " + GEN + """, f AS (SELECT substr(answer, 1, 30) AS pattern, id, response_id FROM gen WHERE correctness = false),
d AS (SELECT pattern, min((id, response_id)) AS first FROM f GROUP BY pattern ORDER BY first LIMIT 5)
SELECT f.pattern, count(*) AS n FROM f JOIN d USING (pattern) WHERE (id, response_id) <= (SELECT max(first) FROM d) OR (SELECT count(*) FROM d) < 5 GROUP BY f.pattern""")
def first_incorrect_patterns(spark, sf):
    """AGG6: first five, not most frequent five."""
    return curves.first_wrong_patterns(gen(spark, sf))


@query("WITH " + GEN + """SELECT id, count(*) AS n, coalesce(bool_or(correctness), false) AS pass_at_n, coalesce(arg_min(correctness, response_id) FILTER (correctness IS NOT NULL), false) AS pass_at_1,
  bool_and(coalesce(correctness = false, false)) AS all_incorrect, count_if(answer IS NULL) AS unparsable FROM gen GROUP BY id""")
def solve_summary(spark, sf):
    """AGG9."""
    return curves.solve_summary(gen(spark, sf))


@query("WITH " + GEN + """, q AS (SELECT source, id, count_if(correctness) AS n_correct FROM gen GROUP BY ALL) SELECT source, n_correct, count(*) AS problems FROM q GROUP BY ALL""")
def correctness_histogram(spark, sf):
    """AGG46."""
    return curves.correctness_histogram(gen(spark, sf))


@query("WITH " + PARTS + """, c AS (SELECT * FROM onef), f AS (SELECT * FROM onef WHERE finish = 'stop' AND answer > '2'),
a AS (SELECT 'raw' AS cell, id, avg(CAST(coalesce(correctness, false) AS INT)) AS acc FROM c GROUP BY id
  UNION ALL SELECT 'filtered', id, avg(CAST(coalesce(correctness, false) AS INT)) FROM f GROUP BY id
  UNION ALL SELECT 'direct_raw', id, avg(CAST(coalesce(correctness, false) AS INT)) FROM direct WHERE id IN (SELECT id FROM c) GROUP BY id
  UNION ALL SELECT 'direct_filtered', id, avg(CAST(coalesce(correctness, false) AS INT)) FROM direct WHERE id IN (SELECT id FROM f) GROUP BY id)
SELECT cell, round(avg(acc), 6) AS accuracy, count(*) AS problems FROM a GROUP BY cell""")
def conditioning_cells(spark, sf):
    """AGG10, AGG11, FIL7, JOI3."""
    direct, one, _ = parts(spark, sf)
    return outcomes.conditioning_cells(one, direct, (F.col("finish") == "stop") & (F.col("answer") > "2")).select("cell", F.round("accuracy", 6).alias("accuracy"), "problems")


_RATES = PARTS + """, d AS (SELECT id, avg(CAST(correctness AS INT)) AS direct FROM direct GROUP BY id HAVING count(correctness) > 0),
o AS (SELECT id, md5(coalesce(answer, '')) AS draft, avg(CAST(correctness AS INT)) AS one FROM onef GROUP BY ALL HAVING count(correctness) > 0),
m AS (SELECT id, md5(coalesce(answer, '')) AS draft, avg(CAST(correctness AS INT)) AS mitigated FROM (SELECT id, answer, correctness FROM mit UNION ALL SELECT id, answer, correctness FROM onef WHERE response_id % 2 = 0) GROUP BY ALL HAVING count(correctness) > 0),
obs AS (SELECT m.id, m.draft, direct, one, mitigated FROM m JOIN o USING (id, draft) JOIN d USING (id))"""
_BUCKET = """, b AS (SELECT *, CASE WHEN direct >= .5 THEN CASE WHEN one >= .5 THEN CASE WHEN mitigated >= .5 THEN 'unaffected' ELSE 'iatrogenic_harm' END WHEN mitigated >= .5 THEN 'recoverable_drag' ELSE 'persistent_drag' END
  WHEN one >= .5 THEN CASE WHEN mitigated >= .5 THEN 'drag_helps_kept' ELSE 'drag_helps_lost' END WHEN mitigated >= .5 THEN 'new_gain' ELSE 'robust_failure' END AS bucket FROM obs)"""


def _observations(spark, sf):
    part = F.col("response_id") % 3
    keyed = gen(spark, sf).withColumn("draft", F.md5(F.coalesce("answer", F.lit(""))))
    return outcomes.joint_observations(keyed, part == 0, part == 1, (part == 2) | ((part == 1) & (F.col("response_id") % 2 == 0)))


@query("WITH " + _RATES + _BUCKET + " SELECT " + ", ".join(f"count_if(bucket = '{b}') AS {b}" for b in outcomes.BUCKETS) + " FROM b")
def outcome_buckets(spark, sf):
    """AGG12, AGG14, JOI4, STR19."""
    rows = _observations(spark, sf).withColumn("bucket", outcomes.bucket(F.col("direct"), F.col("one"), F.col("mitigated")))
    return outcomes.bucket_counts(rows)


@query("WITH " + _RATES + _BUCKET + """, s AS (SELECT id % 3 AS model, count(*) AS n, count_if(direct >= .5) AS dc, count_if(one >= .5) AS oc, count_if(mitigated >= .5) AS mc,
  count_if(bucket = 'recoverable_drag') AS rec, count_if(bucket IN ('recoverable_drag', 'persistent_drag')) AS failed, count_if(bucket = 'iatrogenic_harm') AS ia, count_if(bucket IN ('unaffected', 'iatrogenic_harm')) AS kept,
  count_if(one >= .5 AND mitigated >= .5) AS pk, count_if(bucket = 'new_gain') AS ng, count_if(bucket IN ('new_gain', 'robust_failure')) AS bf FROM b GROUP BY 1)
SELECT model, n, round(dc / n, 6) AS direct_acc, round(oc / n, 6) AS f1_acc, round(mc / n, 6) AS mit_acc, round(rec / nullif(failed, 0), 6) AS recovery, round(ia / nullif(kept, 0), 6) AS iatrogenic, round(pk / nullif(oc, 0), 6) AS preservation,
  round(ng / nullif(bf, 0), 6) AS new_gain_rate, round(mc / n - oc / n, 6) AS net_vs_f1, round(mc / n - dc / n, 6) AS net_vs_direct, failed AS drag_failed_den, kept AS drag_kept_den, bf AS both_failed_den FROM s""")
def derived_rates(spark, sf):
    """AGG15, MTH10."""
    rows = _observations(spark, sf).withColumn("bucket", outcomes.bucket(F.col("direct"), F.col("one"), F.col("mitigated"))).withColumn("model", F.col("id") % 3)
    return outcomes.derived_rates(outcomes.bucket_counts(rows, ["model"]))


@query("WITH " + _RATES + _BUCKET + " SELECT CAST(id % 3 AS VARCHAR) AS model, CAST(id % 2 AS VARCHAR) AS task, " + ", ".join(f"count_if(bucket = '{b}') AS {b}" for b in outcomes.BUCKETS) + " FROM b GROUP BY GROUPING SETS ((id % 3), (id % 2), ())")
def bucket_roll_up(spark, sf):
    """AGG17."""
    rows = _observations(spark, sf).withColumn("bucket", outcomes.bucket(F.col("direct"), F.col("one"), F.col("mitigated"))).withColumn("model", (F.col("id") % 3).cast("string")).withColumn("task", (F.col("id") % 2).cast("string"))
    return outcomes.roll_up(rows, [["model"], ["task"], []])


_CELLS = _RATES + """, x AS (SELECT *, CAST(id % 2 AS DOUBLE) AS b2 FROM obs), r AS (SELECT CASE WHEN direct >= .5 THEN CASE WHEN one >= .5 THEN 'drag_kept' ELSE 'drag_failed' END WHEN one >= .5 THEN 'drag_helps' ELSE 'both_failed' END AS regime,
  count_if(mitigated >= .5 AND b2 >= .5) AS tt, count_if(mitigated >= .5 AND b2 < .5) AS tf, count_if(mitigated < .5 AND b2 >= .5) AS ft, count_if(mitigated < .5 AND b2 < .5) AS ff FROM x GROUP BY 1)"""


def _cells(spark, sf):
    rows = _observations(spark, sf).withColumn("a", F.col("mitigated")).withColumn("b", (F.col("id") % 2).cast("double"))
    return outcomes.contingency(rows)


@query("WITH " + _CELLS + " SELECT * FROM r")
def contingency_by_regime(spark, sf):
    """AGG16, JOI5."""
    return _cells(spark, sf)


@query("WITH " + _CELLS + """, s AS (SELECT CAST(sum(tt) AS DOUBLE) AS a, CAST(sum(tf) AS DOUBLE) AS b, CAST(sum(ft) AS DOUBLE) AS c, CAST(sum(ff) AS DOUBLE) AS d FROM r)
SELECT CAST(a + b + c + d AS BIGINT) AS n, round((a + d) / (a + b + c + d), 6) AS agreement, round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 6) AS phi FROM s""")
def phi_coefficient(spark, sf):
    """AGG16, AGG58."""
    return outcomes.phi(_cells(spark, sf))


@query("WITH " + GEN + """ SELECT source, round(avg(CASE WHEN alias = '1-URGENT' THEN CAST(coalesce(correctness, false) AS INT) END), 6) AS urgent, round(avg(CASE WHEN alias = '2-HIGH' THEN CAST(coalesce(correctness, false) AS INT) END), 6) AS high FROM gen GROUP BY source""")
def delta_matrix(spark, sf):
    """AGG18, AGG28, AGG59."""
    cells = gen(spark, sf).groupBy("source", "alias").agg(F.round(F.avg(F.coalesce("correctness", F.lit(False)).cast("double")), 6).alias("delta"))
    m = outcomes.matrix(cells, "source", "alias", "delta", ["1-URGENT", "2-HIGH"])
    return m.select("source", F.col("`1-URGENT`").alias("urgent"), F.col("`2-HIGH`").alias("high"))


@query("WITH " + PARTS + " SELECT count_if(correctness) AS correct, count(*) AS n, count(DISTINCT id) AS problems FROM direct WHERE id IN (SELECT id FROM onef WHERE finish = 'stop')")
def cohort_accuracy(spark, sf):
    """JOI6."""
    direct, one, _ = parts(spark, sf)
    return outcomes.cohort_accuracy(direct, one.where("finish = 'stop'"))


@query("WITH " + GEN + """, v AS (SELECT alias AS model, CAST(answer AS DOUBLE) AS x FROM gen) SELECT model, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS sem, count(x) AS n FROM v GROUP BY model""")
def model_means_sem(spark, sf):
    """AGG21."""
    return outcomes.mean_sem(gen(spark, sf).select(F.col("alias").alias("model"), F.col("answer").cast("double").alias("x")), "model", "x")


@query("WITH " + GEN + """, v AS (SELECT source, count_if(correctness) / count(*) AS p, count(*) AS n FROM gen GROUP BY source) SELECT round(avg(p), 6) AS mean, round(1.96 * sqrt(sum(p * (1 - p) / n)) / count(*), 6) AS ci95, count(*) AS k FROM v""")
def ci95_of_mean(spark, sf):
    """AGG22, AGG23, FIL18."""
    v = gen(spark, sf).groupBy("source").agg((F.count_if("correctness") / F.count(F.lit(1))).alias("p"), F.count(F.lit(1)).alias("n"))
    return outcomes.ci95(v, "p", "n")


_ITEMS = PARTS + """, it AS (SELECT o.id, o.answer AS anchor, 'anchored' AS side, CAST(levenshtein(o.answer, m.answer) AS DOUBLE) AS d FROM onef o JOIN mit m USING (id) UNION ALL
  SELECT o.id, o.answer, 'init', CAST(levenshtein(o.answer, d.answer) AS DOUBLE) FROM onef o JOIN direct d USING (id) WHERE d.response_id > 0)"""


def _items(spark, sf):
    direct, one, mit = parts(spark, sf)
    a = one.select("id", F.col("answer").alias("anchor"), F.array("answer").alias("drafts"))
    item = lambda other, side: joins.attach_all(a, other.select("id", "answer")).select("id", "anchor", F.lit(side).alias("side"), distances.draft_distances(F.col("drafts"), F.col("answer")).alias("distances"))
    return item(mit, "anchored").union(item(direct.where("response_id > 0"), "init"))


@query("WITH " + _ITEMS + """, a AS (SELECT id, anchor, avg(d) FILTER (side = 'anchored') AS x, avg(d) FILTER (side = 'init') AS y FROM it GROUP BY ALL)
SELECT id, round(avg(x), 6) AS anchored, round(avg(y), 6) AS init FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY id""")
def distance_stats(spark, sf):
    """AGG19, FIL8, JOI7, MTH6, MTH9."""
    return distances.distance_stats(_items(spark, sf)).select("id", F.round("anchored", 6).alias("anchored"), F.round("init", 6).alias("init"))


@query("WITH " + _ITEMS + """, a AS (SELECT id, anchor, avg(d) FILTER (side = 'anchored') AS x, avg(d) FILTER (side = 'init') AS y FROM it GROUP BY ALL),
p AS (SELECT id, avg(x) AS x, avg(y) AS y FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY id)
SELECT round(avg(x), 6) AS anchored, round(avg(y), 6) AS init, count(*) AS both, (SELECT count(DISTINCT id) FROM it WHERE side = 'anchored') AS with_anchored, (SELECT count(DISTINCT id) FROM it WHERE side = 'init') AS with_init FROM p""")
def distance_summary(spark, sf):
    """AGG20, AGG56."""
    return distances.summary(_items(spark, sf))


@query("WITH " + GEN + """ SELECT id, list_sort(list(response_id) FILTER (coalesce(correctness, false)))::VARCHAR AS correct, list_sort(list(response_id) FILTER (NOT coalesce(correctness, false)))::VARCHAR AS incorrect FROM gen GROUP BY id HAVING count_if(correctness) >= 1 AND count_if(NOT coalesce(correctness, false)) >= 2""")
def generation_pools(spark, sf):
    """AGG55, FIL4, FIL5."""
    g = gen(spark, sf)
    kept = generations.having_pools(g, 1, 2)
    shown = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")).alias(c)
    return generations.pools(g).join(kept.select("id"), "id", "left_semi").select("id", shown("correct"), shown("incorrect"))


@query("WITH " + GEN + ", c AS (SELECT count_if(correctness) AS t, count_if(NOT coalesce(correctness, false)) AS f FROM gen GROUP BY id) SELECT CAST(sum(t * (f * (f - 1) / 2)) AS BIGINT) AS combinations FROM c")
def draft_combinations(spark, sf):
    """AGG47."""
    c = generations.pool_flags(gen(spark, sf)).groupBy("id").agg(F.count_if("is_true").alias("t"), F.count_if(~F.col("is_true")).alias("f"))
    return c.agg(F.sum(generations.combinations(F.col("t"), 1) * generations.combinations(F.col("f"), 2)).alias("combinations"))


_DRAFTS = GEN + """, fl AS (SELECT *, coalesce(correctness, false) AS is_true FROM gen), kept AS (SELECT id FROM fl GROUP BY id HAVING count_if(is_true) >= 1 AND count_if(NOT is_true) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id, is_true ORDER BY md5(concat_ws(':', '42', id, response_id)), response_id) AS r FROM fl WHERE id IN (SELECT id FROM kept)),
dr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', '43', id, response_id)), response_id) AS draft_no FROM r WHERE r <= CASE WHEN is_true THEN 1 ELSE 2 END)"""


@query("WITH " + _DRAFTS + " SELECT id, response_id, CAST(draft_no AS INT) AS draft_no FROM dr")
def draft_sample(spark, sf):
    """SMP1, AGG57."""
    return generations.draft_sample(gen(spark, sf), 1, 2, 1, 2).select("id", "response_id", "draft_no")


@query("WITH " + _DRAFTS + " SELECT id, " + ", ".join(f"max(answer) FILTER (draft_no = {k}) AS traj{k}_answer, bool_or(correctness) FILTER (draft_no = {k}) AS traj{k}_correctness" for k in (1, 2, 3)) + " FROM dr GROUP BY id")
def draft_rows(spark, sf):
    """FLT19."""
    return generations.draft_rows(generations.draft_sample(gen(spark, sf), 1, 2, 1, 2), ["answer", "correctness"], 3)


@query("WITH " + _DRAFTS + " SELECT id, CAST(draft_no AS INT) AS draft_no, answer AS traj1_answer, correctness AS traj1_correctness FROM dr")
def unpivot_drafts(spark, sf):
    """FLT8."""
    wide = generations.draft_rows(generations.draft_sample(gen(spark, sf), 1, 2, 1, 2), ["answer", "correctness"], 3)
    return generations.unpivot_drafts(wide, ["id"], 3)


@query("WITH " + GEN + ", r AS (SELECT id, response_id, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', '42', id, response_id)), response_id) AS draft_no FROM gen) SELECT id, response_id, CAST(draft_no AS INT) AS draft_no FROM r WHERE n >= 2 AND draft_no <= 2")
def sample_both_pools(spark, sf):
    """SMP2, FIL6: of every problem that has two generations to draw."""
    g = gen(spark, sf)
    enough = g.groupBy("id").count().where("count >= 2")
    return generations.sample_both_pools(g.join(enough, "id", "left_semi"), 2).select("id", "response_id", "draft_no")


@query("WITH " + GEN + " SELECT id, response_id, answer FROM gen WHERE finish = 'stop' QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', '42', id, response_id)), response_id) = 1")
def pick_one_per_problem(spark, sf):
    """SMP3, FIL1, FIL2."""
    return generations.pick_one(gen(spark, sf).where("finish = 'stop'")).select("id", "response_id", "answer")


@query("WITH " + GEN + ", p AS (SELECT DISTINCT alias FROM gen ORDER BY md5(concat_ws(':', '7', alias)), alias LIMIT 2) SELECT id, response_id, alias FROM gen WHERE alias IN (SELECT alias FROM p)")
def sample_runs(spark, sf):
    """SMP4."""
    return generations.sample_groups(gen(spark, sf), "alias", 2, 7).select("id", "response_id", "alias")


@query("WITH " + GEN + ", p AS (SELECT id % 5 AS run_id, response_id AS step, avg(CAST(coalesce(correctness, false) AS INT)) AS pass_at_1 FROM gen GROUP BY ALL) SELECT step, round(avg(pass_at_1), 6) AS mean, round(stddev_pop(pass_at_1), 6) AS std, count(*) AS n_runs FROM p GROUP BY step")
def trace_per_step(spark, sf):
    """AGG24."""
    return recursion.per_step(_traces(spark, sf))


def _traces(spark, sf):
    return gen(spark, sf).groupBy((F.col("id") % 5).alias("run_id"), F.col("response_id").alias("step")).agg(F.avg(F.coalesce("correctness", F.lit(False)).cast("double")).alias("pass_at_1"))


@query("WITH " + GEN + """, p AS (SELECT id % 5 AS run_id, response_id AS step, avg(CAST(coalesce(correctness, false) AS INT)) AS v FROM gen GROUP BY ALL), s AS (SELECT step, avg(v) AS m, count(*) AS c FROM p GROUP BY step), n AS (SELECT count(DISTINCT run_id) AS t FROM p),
d AS (SELECT coalesce(max(step), 0) AS x FROM s, n WHERE c = t AND step >= 1)
SELECT t AS n_runs_completed, x AS max_step_reached, round((SELECT m FROM s WHERE step = 0), 6) AS acc_round_0, round((SELECT m FROM s WHERE step = x), 6) AS acc_round_max, round((SELECT m FROM s WHERE step = x) - (SELECT m FROM s WHERE step = 0), 6) AS delta, false AS aggregate_failed FROM n, d""")
def trace_summary(spark, sf):
    """AGG24."""
    return recursion.trace_summary(_traces(spark, sf))


@query("WITH " + GEN + ", u AS (SELECT DISTINCT id FROM gen WHERE finish = 'stop' AND correctness IS NOT NULL), e AS (SELECT DISTINCT id FROM gen) SELECT count_if(u.id IS NOT NULL) AS covered, count_if(u.id IS NULL) AS need_makeup FROM e LEFT JOIN u ON e.id = u.id")
def coverage_digest(spark, sf):
    """AGG27, JOI18."""
    g = gen(spark, sf)
    return curves.coverage_digest(g, g, (F.col("finish") == "stop") & F.col("correctness").isNotNull())


@query("WITH " + GEN + " SELECT DISTINCT id FROM gen WHERE id NOT IN (SELECT id FROM gen WHERE finish = 'stop' AND correctness)")
def uncovered_problems(spark, sf):
    """JOI18, STM9: what a makeup attempt would generate for."""
    g = gen(spark, sf)
    return joins.uncovered(g, g, (F.col("finish") == "stop") & F.coalesce("correctness", F.lit(False)))


@query("WITH " + GEN + """, e AS (SELECT 'finish: ' || finish AS src, 'correct: ' || CAST(correctness AS VARCHAR) AS dst FROM gen WHERE correctness IS NOT NULL UNION ALL SELECT 'source: ' || source, 'finish: ' || finish FROM gen) SELECT src, dst, count(*) AS value FROM e GROUP BY ALL""")
def flow_edges(spark, sf):
    """AGG43, SRT11, UDF5."""
    g = gen(spark, sf)
    return flows.edges(g, flows.stage_path(("source", F.col("source")), ("finish", F.col("finish")), ("correct", F.col("correctness")))).select("src", "dst", F.col("value").cast("long").alias("value"))


@query("WITH " + GEN + ", p AS (SELECT id, source, list(answer ORDER BY response_id) AS a FROM gen GROUP BY ALL) SELECT id, source, a[1] AS first_answer, CAST(len(a) AS INT) AS n FROM p")
def first_generation(spark, sf):
    """FLT2, D2."""
    p = generations.pack(gen(spark, sf), ["id", "source"])
    return p.select("id", "source", F.element_at("gens", 1)["answer"].alias("first_answer"), F.size("gens").alias("n"))


@query("WITH " + GEN + " SELECT id, response_id, answer, concat_ws('-', id, alias, response_id) AS unique_id FROM gen")
def flat_generations(spark, sf):
    """FLT1, FLT7, FLT14."""
    p = generations.pack(gen(spark, sf), ["id", "source"])
    flat = generations.expand_list_format(p, "gens")
    return flat.select("id", "response_id", "answer", generations.trajectory_id(F.col("id"), F.col("alias"), F.col("response_id")).alias("unique_id"))


@query("SELECT o_orderkey AS id, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf):
    """JOI1, JOI2."""
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"))
    both = read(spark, sf, "customer").select("c_custkey", F.struct("c_name", "c_mktsegment").alias("s"))
    return joins.lookup(orders, both, "c_custkey", "s", "s").select("id", "s.*")
