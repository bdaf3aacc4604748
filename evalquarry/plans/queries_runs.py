"""Queries over run tables: indexes, inventories, agreement, selection, claims, sets and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalquarry.operators import cards, flows, joins, outcomes, runs, tables
from evalquarry.plans.base import query
from evalquarry.plans.domain_views import STATS, read, stats

_KEY = ["run", "metric", "split", "perturbation"]
_CLASS = "CASE WHEN metric LIKE 'exact\\_match%' ESCAPE '\\' THEN 'core' WHEN metric LIKE 'num\\_%' ESCAPE '\\' THEN 'bookkeeping' ELSE 'untracked' END"
_FAMILY = "CASE WHEN metric LIKE 'air\\_%' ESCAPE '\\' THEN 'air' ELSE split_part(split_part(metric, '_', 1), ':', 1) END"
_INDEX = STATS + f""", ix AS (SELECT *, {_CLASS} AS class, {_FAMILY} AS family FROM stats QUALIFY row_number() OVER (PARTITION BY run, metric, split, perturbation ORDER BY row_ord DESC) = 1)"""


def _index(spark, sf):
    return runs.stat_index(stats(spark, sf), _KEY, "row_ord")


@query("WITH " + _INDEX + " SELECT run, metric, split, perturbation, count, mean, class, family FROM ix")
def stat_index(spark, sf):
    """AGG54, STR21, STR22."""
    return _index(spark, sf).select("run", "metric", "split", "perturbation", "count", "mean", "class", "family")


@query("WITH " + STATS + f""", k AS (SELECT * FROM stats WHERE count <> 0 AND mean IS NOT NULL) SELECT run, metric, split, perturbation, count, mean FROM k QUALIFY row_number() OVER (PARTITION BY run, metric, split, perturbation ORDER BY row_ord DESC) = 1""")
def stat_index_nonzero(spark, sf):
    """FIL16."""
    return runs.stat_index(stats(spark, sf), _KEY, "row_ord", drop_zero=True, need_mean=True).select("run", "metric", "split", "perturbation", "count", "mean")


@query("WITH " + _INDEX + " SELECT class, family, count(*) AS n FROM ix GROUP BY GROUPING SETS ((class), (family), ())")
def stat_inventory(spark, sf):
    """AGG31, AGG53."""
    return runs.inventory(_index(spark, sf))


@query("WITH " + _INDEX + """, c AS (SELECT class, (family <> 'other') AS supported, family, count(*) AS n FROM ix GROUP BY ALL)
SELECT class, supported, CAST(sum(n) AS BIGINT) AS total, string_agg(family || '=' || n, ',' ORDER BY n DESC, family) AS families, substr(sha256(string_agg(family || '=' || n, ',' ORDER BY n DESC, family)), 1, 12) AS signature FROM c GROUP BY class, supported""")
def family_inventory(spark, sf):
    """AGG32, STR23."""
    return runs.family_support(_index(spark, sf), F.col("family") != "other")


@query("WITH " + STATS + """, i AS (SELECT instance_id, count(DISTINCT perturbation) + max(CAST(perturbation IS NULL AS INT)) AS v FROM stats GROUP BY instance_id)
SELECT (SELECT count(*) FROM i) AS bases, CAST((SELECT sum(v) FROM i) AS BIGINT) AS variants, (SELECT max(v) FROM i) AS max_variants, count(*) AS stats, count_if(count <> 0) AS nonzero, count(mean) AS with_mean FROM stats""")
def run_summary(spark, sf):
    """AGG33, AGG49."""
    s = stats(spark, sf)
    return runs.run_summary(s, s.select("instance_id", "perturbation"))


_TWO = _INDEX + """, a AS (SELECT metric, split, perturbation, arg_max(mean, run) AS mean, arg_max(count, run) AS count, any_value(class) AS class FROM ix WHERE run % 2 = 0 GROUP BY metric, split, perturbation),
b AS (SELECT metric, split, perturbation, arg_max(mean, run) AS mean, arg_max(count, run) AS count, any_value(class) AS class FROM ix WHERE run % 2 = 1 GROUP BY metric, split, perturbation)"""
_STAT = ["metric", "split", "perturbation"]


def _two(spark, sf):
    one = lambda k: _index(spark, sf).where(F.col("run") % 2 == k).groupBy(*_STAT).agg(F.max_by("mean", "run").alias("mean"), F.max_by("count", "run").alias("count"), F.first("class").alias("class"))
    return one(0), one(1)


@query("WITH " + _TWO + """, j AS (SELECT a.class, abs(a.mean - b.mean) > greatest(0.5, 0.2 * greatest(abs(a.mean), abs(b.mean))) AS bad FROM a JOIN b ON a.metric = b.metric AND a.split = b.split AND a.perturbation IS NOT DISTINCT FROM b.perturbation),
g AS (SELECT class AS "group", bad FROM j UNION ALL SELECT 'overall', bad FROM j) SELECT "group", count(*) AS comparable, count_if(bad) AS mismatched, round(1 - count_if(bad) / count(*), 6) AS ratio FROM g GROUP BY "group" """)
def value_agreement(spark, sf):
    """AGG34, AGG35, JOI10, JOI11."""
    a, b = _two(spark, sf)
    return runs.value_agreement(a, b, _STAT, 0.5, 0.2)


@query("WITH " + _TWO + """ SELECT a.metric, a.split, a.perturbation, round(abs(a.mean - b.mean), 6) AS delta, CAST(row_number() OVER (PARTITION BY a.class ORDER BY abs(a.mean - b.mean) DESC, a.metric, a.split, a.perturbation) AS INT) AS rank
FROM a JOIN b ON a.metric = b.metric AND a.split = b.split AND a.perturbation = b.perturbation WHERE a.mean <> b.mean QUALIFY row_number() OVER (PARTITION BY a.class ORDER BY abs(a.mean - b.mean) DESC, a.metric, a.split, a.perturbation) <= 3""")
def top_mismatches_per_class(spark, sf):
    """SRT4, SRT5, SNK17."""
    a, b = _two(spark, sf)
    return runs.mismatches(a, b, _STAT, 3, ["class"]).select(*_STAT, F.round("delta", 6).alias("delta"), "rank")


@query("WITH " + _TWO + """, u AS (SELECT coalesce(a.metric, b.metric) AS m, a.metric IS NOT NULL AS ia, b.metric IS NOT NULL AS ib FROM a FULL JOIN b ON a.metric = b.metric AND a.split = b.split AND a.perturbation IS NOT DISTINCT FROM b.perturbation)
SELECT count_if(ia) AS n_a, count_if(ib) AS n_b, count_if(ia AND ib) AS both, count(*) AS either, count_if(ia AND NOT ib) AS only_a, count_if(ib AND NOT ia) AS only_b FROM u""")
def key_coverage(spark, sf):
    """SET2, AGG36."""
    a, b = _two(spark, sf)
    return joins.coverage(a, b, _STAT)


@query("WITH " + _TWO + """, u AS (SELECT a.metric AS x, b.metric AS y FROM a FULL JOIN b ON a.metric = b.metric AND a.split = b.split AND a.perturbation IS NOT DISTINCT FROM b.perturbation), v AS (SELECT a.metric AS x, b.metric AS y FROM a FULL JOIN b ON a.metric = b.metric AND a.split = b.split AND a.perturbation IS NOT DISTINCT FROM b.perturbation AND a.count = b.count)
SELECT false AS identical, (SELECT count(x) FROM u) AS key_n_a, (SELECT count(y) FROM u) AS key_n_b, (SELECT count_if(x IS NOT NULL AND y IS NOT NULL) FROM u) AS key_both, (SELECT count(*) FROM u) AS key_either, (SELECT count_if(y IS NULL) FROM u) AS key_only_a, (SELECT count_if(x IS NULL) FROM u) AS key_only_b,
(SELECT count(x) FROM v) AS count_n_a, (SELECT count(y) FROM v) AS count_n_b, (SELECT count_if(x IS NOT NULL AND y IS NOT NULL) FROM v) AS count_both, (SELECT count(*) FROM v) AS count_either, (SELECT count_if(y IS NULL) FROM v) AS count_only_a, (SELECT count_if(x IS NULL) FROM v) AS count_only_b""")
def run_diff(spark, sf):
    """AGG36."""
    a, b = _two(spark, sf)
    return runs.run_diff(a, b, _STAT)


@query("WITH " + STATS + " SELECT run, metric, CAST(sum(count) AS BIGINT) AS count, round(sum(mean * count) / nullif(sum(count), 0), 6) AS mean FROM stats GROUP BY run, metric")
def weighted_mean_merge(spark, sf):
    """AGG37."""
    return runs.merge_means(stats(spark, sf), ["run", "metric"])


@query("WITH " + STATS + """, m AS (SELECT *, CASE WHEN metric = 'exact_match_click' AND split = 'test' AND perturbation IS NULL THEN 1 WHEN metric LIKE 'num\\_%' ESCAPE '\\' AND split = 'test' AND perturbation IS NULL THEN 2 END AS lvl FROM stats),
g AS (SELECT run, count(DISTINCT metric) AS names, sum(count) AS c, sum(mean * count) AS s FROM m WHERE lvl = (SELECT min(lvl) FROM m m2 WHERE m2.run = m.run) GROUP BY run)
SELECT r.run, CASE WHEN names IS NULL THEN 'no_match' WHEN names > 1 THEN 'ambiguous' WHEN c = 0 THEN 'count_zero' ELSE 'ok' END AS "case", CASE WHEN names = 1 AND c > 0 THEN round(s / c, 6) END AS mean FROM (SELECT DISTINCT run FROM stats) r LEFT JOIN g USING (run)""")
def unique_stat(spark, sf):
    """AGG38, AGG39, FIL10, FIL14."""
    return runs.unique_stat(stats(spark, sf), ["run"], runs.matches("exact_match_click", "test"), runs.matches("num_*", "test"))


@query("WITH " + STATS + """, st AS (SELECT run, instance_id, trial, perturbation, arg_min(row_ord, row_ord) AS p FROM stats WHERE row_ord % 4 <> 0 GROUP BY ALL), lone AS (SELECT run, instance_id, trial, any_value(p) AS p FROM st GROUP BY ALL HAVING count(*) = 1)
SELECT s.row_ord, 'prompt ' || coalesce(st.p, CASE WHEN s.perturbation IS NULL THEN lone.p END) AS prompt, CASE WHEN st.p IS NOT NULL THEN 'exact' WHEN s.perturbation IS NULL AND lone.p IS NOT NULL THEN 'fallback' ELSE 'unmatched' END AS matched
FROM stats s LEFT JOIN st ON s.run = st.run AND s.instance_id = st.instance_id AND s.trial = st.trial AND s.perturbation IS NOT DISTINCT FROM st.perturbation LEFT JOIN lone ON s.run = lone.run AND s.instance_id = lone.instance_id AND s.trial = lone.trial""")
def joined_instance_stats(spark, sf):
    """JOI8, JOI9, WIN2: no request is logged for every fourth row."""
    s = stats(spark, sf).withColumn("instance_id", F.concat_ws("/", F.col("run"), F.col("instance_id")))
    states = s.where("row_ord % 4 <> 0").select("instance_id", "trial", "perturbation", "row_ord", F.concat(F.lit("prompt "), F.col("row_ord").cast("string")).alias("prompt"))
    return runs.joined_instance_stats(s, states, "row_ord").select("row_ord", "prompt", "matched")


@query("WITH " + STATS + """, p AS (SELECT run, perturbation, round(avg(mean), 4) AS predicted FROM stats GROUP BY ALL) SELECT s.row_ord, s.run, s.perturbation, s.mean, p.predicted FROM stats s JOIN p ON s.run = p.run AND s.perturbation IS NOT DISTINCT FROM p.perturbation""")
def predicted_to_actual(spark, sf):
    """JOI12, JOI13, JOI14."""
    s = stats(spark, sf)
    p = s.groupBy("run", "perturbation").agg(F.round(F.avg("mean"), 4).alias("predicted"))
    return joins.null_safe(s.select("row_ord", "run", "perturbation", "mean"), p, [("run", "run"), ("perturbation", "perturbation")])


@query("WITH " + STATS + " SELECT run, round(avg(mean), 6) AS score FROM stats WHERE perturbation IS NULL AND split = 'test' GROUP BY run")
def mean_score_per_run(spark, sf):
    """AGG28, FIL10."""
    return stats(spark, sf).where(F.col("perturbation").isNull() & (F.col("split") == "test")).groupBy("run").agg(F.round(F.avg("mean"), 6).alias("score"))


@query("WITH " + STATS + ", m AS (SELECT metric, run % 3 = 0 AS deprecated, split AS class FROM stats) SELECT metric, count(*) AS n, bool_or(deprecated) AS any_deprecated, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM m GROUP BY metric")
def deployments_by_group(spark, sf):
    """AGG29, SRC23."""
    return runs.deployments_by(stats(spark, sf).select("metric", (F.col("run") % 3 == 0).alias("deprecated"), F.col("split").alias("class")), "metric")


@query("WITH " + STATS + ", c AS (SELECT count(*) AS c FROM stats GROUP BY run) SELECT count(c) AS count, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std FROM c")
def describe_runs(spark, sf):
    """AGG30."""
    return runs.describe(stats(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("c")), "c")


@query("WITH " + STATS + """, l AS (SELECT 'metric' AS "column", metric AS value FROM stats UNION ALL SELECT 'split', split FROM stats UNION ALL SELECT 'perturbation', coalesce(perturbation, 'none') FROM stats) SELECT "column", value, count(*) AS n FROM l GROUP BY ALL""")
def varied_value_counts(spark, sf):
    """AGG40, AGG42, SET10, FIL15."""
    return joins.varied_values(stats(spark, sf).withColumn("one", F.lit("x")), ["metric", "split", "perturbation", "one"], default="none")


@query("WITH " + STATS + """, r AS (SELECT run, 1 - count_if(mean > 100) / count(*) AS ratio FROM stats GROUP BY run) SELECT CASE WHEN ratio = 1 THEN 'exact' WHEN ratio >= .995 THEN 'high' WHEN ratio >= .95 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM r GROUP BY 1""")
def agreement_labels(spark, sf):
    """AGG41, AGG53."""
    r = stats(spark, sf).groupBy("run").agg((1 - F.count_if(F.col("mean") > 100) / F.count(F.lit(1))).alias("ratio"))
    return r.groupBy(runs.ratio_label(F.col("ratio")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + STATS + " SELECT metric, round(regr_slope(mean, CAST(count AS DOUBLE)), 6) AS slope, round(regr_intercept(mean, CAST(count AS DOUBLE)), 6) AS intercept, CAST(regr_count(mean, CAST(count AS DOUBLE)) AS BIGINT) AS n FROM stats GROUP BY metric")
def linear_fit(spark, sf):
    """AGG52, UDF4."""
    return runs.linear_fit(stats(spark, sf).withColumn("x", F.col("count").cast("double")), ["metric"], "x", "mean")


@query("WITH " + STATS + " SELECT row_ord, run, mean FROM stats ORDER BY mean DESC, run, row_ord LIMIT 10")
def extrema_top_k(spark, sf):
    """SRT1, SRT2, SRT3."""
    return tables.extrema(stats(spark, sf).select("row_ord", "run", "mean"), ["mean", "run", "row_ord"], ["max", "min", "min"], 10)


@query("WITH " + STATS + ", r AS (SELECT row_ord, perturbation IS NULL AS plain, CAST(row_number() OVER (PARTITION BY perturbation IS NULL ORDER BY instance_id, trial, perturbation NULLS FIRST, row_ord) AS INT) AS rank FROM stats) SELECT row_ord, plain, rank FROM r WHERE rank <= 3")
def headline_rows(spark, sf):
    """SRT10, SRT9."""
    s = stats(spark, sf).withColumn("plain", F.col("perturbation").isNull())
    return tables.top_per_group(s, ["plain"], [F.col("instance_id"), F.col("trial"), F.col("perturbation"), F.col("row_ord")], 3).select("row_ord", "plain", "rank")


@query("WITH " + STATS + """, g AS (SELECT metric, split, CASE WHEN metric LIKE 'exact%' THEN 0 ELSE 1 END AS class_rank, max(mean) AS max_delta FROM stats GROUP BY ALL), r AS (SELECT *, class_rank = 0 AS is_core, row_number() OVER (PARTITION BY class_rank = 0 ORDER BY class_rank, max_delta DESC, metric, split) AS r FROM g)
SELECT metric, split, class_rank, max_delta, is_core FROM r WHERE is_core OR r <= 2 ORDER BY class_rank, max_delta DESC, metric, split LIMIT 6""")
def ranked_groups(spark, sf):
    """SRT6."""
    s = stats(spark, sf)
    core = F.startswith(F.col("metric"), F.lit("exact"))
    return tables.ranked_groups(s, F.when(core, 0).otherwise(1), F.col("mean"), ["metric", "split"], core, 6, 2)


@query("""WITH v AS (SELECT DISTINCT 'v' || (event_id % 12) || '.' || (event_id % 7) AS version FROM events) SELECT version FROM v ORDER BY CAST(regexp_extract(version, 'v([0-9]+)', 1) AS INT) DESC, CAST(regexp_extract(version, '[.]([0-9]+)', 1) AS INT) DESC LIMIT 1""")
def latest_version(spark, sf):
    """SRT8, SRC20."""
    v = read(spark, sf, "events").select(F.concat(F.lit("v"), (F.col("event_id") % 12).cast("string"), F.lit("."), (F.col("event_id") % 7).cast("string")).alias("version"))
    return tables.latest_version(v)


@query("""WITH n AS (SELECT DISTINCT event_type || ':model=org/m' || user_id % 5 || ',subject=s' || user_id % 3 || CASE WHEN user_id % 2 = 0 THEN ',extra' ELSE '' END AS name FROM events)
SELECT name FROM n WHERE name LIKE 'click:%' AND name LIKE '%model=org/m1,%' AND regexp_matches(name, 'subject=s1(,|$)') ORDER BY length(name), name LIMIT 1""")
def best_run(spark, sf):
    """SRT7, FIL13, STR20."""
    e = read(spark, sf, "events")
    name = F.concat("event_type", F.lit(":model=org/m"), (F.col("user_id") % 5).cast("string"), F.lit(",subject=s"), (F.col("user_id") % 3).cast("string"), F.when(F.col("user_id") % 2 == 0, ",extra").otherwise(""))
    return runs.best_run(e.select(name.alias("name")).distinct(), {"benchmark": "click", "model": "org/m1", "subject": "s1"})


@query("WITH " + STATS + """, s AS (SELECT run, mean >= 20 AS c FROM (SELECT run, avg(mean) AS mean FROM stats GROUP BY run)) SELECT run, CASE WHEN c IS NULL THEN 'INCONCLUSIVE' WHEN c THEN 'VERIFIED' ELSE 'FALSIFIED' END AS status FROM s""")
def claim_per_run(spark, sf):
    """CTL2."""
    return cards.evaluated(stats(spark, sf).groupBy("run").agg(F.avg("mean").alias("mean")), "mean >= 20").select("run", "status")


@query("WITH " + STATS + """, s AS (SELECT avg(mean) >= 20 AS c FROM stats GROUP BY run), k AS (SELECT count_if(c) AS verified, count_if(NOT c) AS falsified, count_if(c IS NULL) AS inconclusive, count(*) AS n FROM s)
SELECT *, CASE WHEN falsified > 0 THEN 'FALSIFIED' WHEN inconclusive > 0 THEN 'INCONCLUSIVE' ELSE 'VERIFIED' END AS status, round(100 * verified / n, 6) AS percent_verified FROM k""")
def verdict_reduction(spark, sf):
    """AGG44, AGG45."""
    return cards.reduce_verdicts(cards.evaluated(stats(spark, sf).groupBy("run").agg(F.avg("mean").alias("mean")), "mean >= 20"))


@query("""WITH a AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS x), b AS (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS y) SELECT CAST(row_number() OVER (ORDER BY x, y) - 1 AS INT) AS point, x, y, x * 10 + length(y) AS z, CASE WHEN x * 10 + length(y) > 30 THEN 'VERIFIED' ELSE 'FALSIFIED' END AS status FROM a, b""")
def card_sweep(spark, sf):
    """JOI20, CTL1, CTL3, CTL4, SNK13."""
    card = cards.Card("sweep", "z > 30", {"z": cards.Symbol(sql="x * 10 + length(y)", depends_on=["x", "y"]), "x": cards.Symbol(sweep=[1]), "y": cards.Symbol(sweep=list("abcdef"))})
    return cards.evaluate(card, spark, overrides={"x": [1, 2, 3, 4, 5, 6]})[0].select("point", "x", "y", "z", "status")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS key, round(c_acctbal, 2) AS value, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL SELECT CAST(s_nationkey AS VARCHAR), round(s_acctbal, 2), s_name FROM supplier""")
def union_of_tables(spark, sf):
    """SET1."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.round("c_acctbal", 2).alias("value"))
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("key"), F.round("s_acctbal", 2).alias("value"), F.col("s_name").alias("extra"))
    return joins.union_by_name([c, s])


@query("WITH " + STATS + """, a AS (SELECT run || '.' || metric AS path, CAST(max(count) AS VARCHAR) AS value FROM stats WHERE split = 'test' GROUP BY 1), b AS (SELECT run || '.' || metric AS path, CAST(max(count) AS VARCHAR) AS value FROM stats WHERE split = 'valid' GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_a' WHEN a.path IS NULL THEN 'only_b' ELSE 'differs' END AS status, a.value AS a, b.value AS b FROM a FULL JOIN b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value""")
def document_diff(spark, sf):
    """SET3."""
    s = stats(spark, sf).withColumn("path", F.concat_ws(".", F.col("run").cast("string"), F.col("metric")))
    side = lambda x: s.where(F.col("split") == x).groupBy("path").agg(F.max("count").cast("string").alias("value"))
    return joins.document_diff(side("test"), side("valid"))


@query("SELECT conv_id, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1")
def first_turn_per_conversation(spark, sf):
    """SET4, SET5, WIN2."""
    return joins.first_per_key(read(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "role", "text")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS body, count(*) AS turns FROM conversations GROUP BY conv_id")
def merge_turns(spark, sf):
    """SET6."""
    c = read(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("ord"), F.array("text").alias("texts"))
    m = joins.merge_ids(c, "conv_id", "texts", "ord")
    return m.select("conv_id", F.array_join("texts", "\n").alias("body"), F.size("texts").cast("long").alias("turns"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def query_string(spark, sf):
    """FIL11, FIL17, AGG42."""
    return tables.query(read(spark, sf, "customer"), "c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT 'segment: ' || c_mktsegment AS src, 'region: ' || r_name AS dst, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), f AS (SELECT src AS node, 0 AS i, v AS o FROM e UNION ALL SELECT dst, v, 0 FROM e) SELECT node, CAST(sum(i) AS BIGINT) AS inflow, CAST(sum(o) AS BIGINT) AS outflow FROM f GROUP BY node""")
def node_flow(spark, sf):
    """AGG43."""
    c, n, r = read(spark, sf, "customer"), read(spark, sf, "nation"), read(spark, sf, "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return flows.node_flow(flows.edges(j, flows.stage_path(("segment", F.col("c_mktsegment")), ("region", F.col("r_name")))))


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY event_type")
def semi_restriction(spark, sf):
    """FIL3, JOI3."""
    e = read(spark, sf, "events").withColumnRenamed("user_id", "id")
    from evalquarry.operators.generations import split_filter

    ids = read(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("id"))
    return split_filter(e, ids).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS region, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' END AS side FROM region")
def dictionary_map(spark, sf):
    """JOI16, SRC25."""
    return joins.mapped(read(spark, sf, "region").select(F.col("r_name").alias("region")), {"ASIA": "east", "EUROPE": "west"}, "region", "side")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'reproduced' ELSE 'missing' END AS status FROM part")
def reproduction_status(spark, sf):
    """JOI21."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return joins.requests(p, read(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id")), "id")


@query("SELECT s_nationkey AS nation, round(avg(s_acctbal), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(s_acctbal) / sqrt(count(*)) ELSE 0 END, 6) AS sem, count(*) AS n FROM supplier GROUP BY 1")
def supplier_mean_sem(spark, sf):
    """AGG21."""
    return outcomes.mean_sem(read(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nation"), "nation", "s_acctbal")
