"""Queries over texts: extraction, verdicts, prompts, hashes and verifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalquarry.functions import text as X
from evalquarry.functions import verify as V
from evalquarry.operators import curves, distances, joins
from evalquarry.plans.base import query
from evalquarry.plans.domain_views import GEN, TEXTS, gen, read, texts


@query("WITH " + TEXTS + r" SELECT doc_id, trim(list_extract(regexp_extract_all(response, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1), -1)) AS boxed FROM texts")
def boxed_answers(spark, sf):
    """STR1."""
    return texts(spark, sf).select("doc_id", X.boxed_answer(F.col("response")).alias("boxed"))


_SPLIT = TEXTS + """, a AS (SELECT doc_id, source, response, list_extract(string_split(response, '</think>'), -1) AS answer, len(string_split(response, '<think>')) AS opened, len(string_split(response, '</think>')) AS closed FROM texts),
s AS (SELECT doc_id, source, CASE WHEN opened = 1 THEN response WHEN opened = closed THEN answer ELSE substr(answer, 1, 16384) END AS final,
  CASE WHEN opened = 1 THEN 'no_thinking' WHEN opened = closed THEN 'parsable_thinking' WHEN length(answer) > 16384 THEN 'truncated_malformed_thinking' ELSE 'malformed_thinking' END AS status FROM a)"""


@query("WITH " + _SPLIT + " SELECT doc_id, final, status FROM s")
def thinking_split(spark, sf):
    """STR2, STR3, FLT23."""
    s = X.thinking_split(F.col("response"))
    return texts(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.final", "s.status")


@query("WITH " + _SPLIT + " SELECT source AS file, status, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS percent FROM s GROUP BY source, status")
def thinking_status_share(spark, sf):
    """AGG8, SRC6."""
    return curves.status_share(texts(spark, sf).select(F.col("source").alias("file"), X.thinking_split(F.col("response"))["status"].alias("status")))


@query("WITH " + TEXTS + """ SELECT doc_id, coalesce(quality = 0, false) AS flagged_1f, coalesce(quality = 0 AND toxic = 0, false) AS flagged_2f, coalesce(quality = 1, false) AS correct FROM texts""")
def verdicts(spark, sf):
    """STR4, STR5, STR6."""
    r = F.col("response")
    return texts(spark, sf).select("doc_id", X.verdict_1f(r).alias("flagged_1f"), X.verdict_2f(r).alias("flagged_2f"), X.verdict_distance(F.concat(F.substring_index(r, "</overall_verdict>", 1), F.lit("</overall_verdict>"))).alias("correct"))


@query("WITH " + TEXTS + " SELECT CASE WHEN quality = 0 THEN 'true' ELSE 'false' END AS verdict, count(*) AS n FROM texts GROUP BY 1")
def verdict_tally(spark, sf):
    """AGG50, STR7."""
    g = texts(spark, sf).select(F.array(F.struct(F.col("response").alias("generated_response"))).alias("gens"))
    return distances.verdict_tally(g.select(F.inline(X.annotate_verdicts(F.col("gens")))))


@query("WITH " + TEXTS + " SELECT doc_id, 'f(' || doc_id % 9 || ')' AS input, CAST(doc_id % 11 AS VARCHAR) AS output FROM texts")
def code_answers(spark, sf):
    """STR8, STR9."""
    return texts(spark, sf).select("doc_id", X.code_answer(F.col("response"), "input").alias("input"), X.code_answer(F.col("response"), "output").alias("output"))


@query("SELECT item_id, 'Q: ' || text || chr(10) || 'Id ' || item_id AS prompt, substr(sha256('Q: ' || text || chr(10) || 'Id ' || item_id), 1, 16) AS hash FROM benchmark")
def prompt_hashes(spark, sf):
    """STR17, STR18, SNK18."""
    b = read(spark, sf, "benchmark")
    p = X.render("Q: {arg_text}\nId {arg_item_id}", b.columns)
    return b.select("item_id", p.alias("prompt"), X.prompt_hash(p).alias("hash"))


@query("SELECT item_id FROM benchmark WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM benchmark WHERE item_id % 3 = 0)")
def resume_anti_join(spark, sf):
    """JOI17, STM6, SET7."""
    b = read(spark, sf, "benchmark").withColumn("hash", X.prompt_hash(F.col("text")))
    return joins.pending(b, b.where("item_id % 3 = 0")).select("item_id")


@query("SELECT count(DISTINCT sha256(text)) AS distinct_hashes, count(*) AS with_hash, count(DISTINCT sha256(text)) >= 20 AS enough, true AS all_filled FROM benchmark")
def hash_completeness(spark, sf):
    """SET7, SET8, SET9."""
    b = read(spark, sf, "benchmark").select(X.prompt_hash(F.col("text")).alias("hash"), F.array("item_id").alias("gens"))
    return joins.hash_completeness(b, "hash", "gens", 20)


_NAMES = "n AS (SELECT page_id, 'bench' || page_id % 4 || ':model=org/m' || page_id % 5 || ',lang=' || CASE page_id % 2 WHEN 0 THEN 'en' ELSE 'de' END || ',flag' AS name FROM pages)"


@query("WITH " + _NAMES + " SELECT page_id, 'bench' || page_id % 4 AS bench, 'org_m' || page_id % 5 AS model, CASE page_id % 2 WHEN 0 THEN 'en' ELSE 'de' END AS lang, 'true' AS flag FROM n")
def run_name_tokens(spark, sf):
    """STR20."""
    p = F.col("page_id")
    name = F.concat(F.lit("bench"), (p % 4).cast("string"), F.lit(":model=org/m"), (p % 5).cast("string"), F.lit(",lang="), F.when(p % 2 == 0, "en").otherwise("de"), F.lit(",flag"))
    t = X.run_tokens(name)
    return read(spark, sf, "pages").select("page_id", X.run_benchmark(name).alias("bench"), t["model"].alias("model"), t["lang"].alias("lang"), t["flag"].alias("flag"))


@query("WITH " + GEN + " SELECT id, response_id, ltrim('00' || answer, '0') AS stripped, md5(answer) AS draft_key, printf('%.1f%%', CAST(answer AS DOUBLE) / 8 * 100) AS share FROM gen")
def answer_formats(spark, sf):
    """STR10, STR19, STR26."""
    a = F.col("answer")
    return gen(spark, sf).select("id", "response_id", X.strip_leading_zero(F.concat(F.lit("00"), a)).alias("stripped"), X.draft_key(a).alias("draft_key"), X.percent(a.cast("double") / 8).alias("share"))


@query("WITH " + GEN + " SELECT id, response_id, CAST(answer AS INT) % 5 = 0 AS equal FROM gen")
def equivalent_answers(spark, sf):
    """MTH1, MTH2, STR12: n/5 in LaTeX against its whole part."""
    a = F.col("answer")
    return gen(spark, sf).select("id", "response_id", V.equivalent_udf(F.concat(F.lit("\\frac{"), a, F.lit("}{5}")), F.floor(a.cast("double") / 5).cast("string")).alias("equal"))


@query("WITH " + GEN + " SELECT id, response_id, CAST(answer AS INT) = 12 AS solved FROM gen")
def game_of_24(spark, sf):
    """MTH3."""
    a = F.col("answer")
    return gen(spark, sf).select("id", "response_id", V.correct_24_udf(F.concat(a, F.lit(" + 6 × 2 = 24")), F.array(a.cast("long"), F.lit(6).cast("long"), F.lit(2).cast("long"))).alias("solved"))


@query("WITH " + GEN + ", m AS (SELECT id, response_id, answer, lead(answer) OVER (PARTITION BY id ORDER BY response_id) AS other FROM gen) SELECT id, response_id, CAST(levenshtein(answer, other) AS DOUBLE) AS levenshtein, CASE WHEN answer = other THEN 0.0 ELSE 1.0 END AS tree, CASE WHEN answer = other THEN 1.0 ELSE 0.0 END AS binary FROM m WHERE other IS NOT NULL")
def edit_distances(spark, sf):
    """MTH6, MTH7, MTH8: trees of ``n + 1`` that differ in one leaf."""
    from pyspark.sql import Window as W

    g = gen(spark, sf).withColumn("other", F.lead("answer").over(W.partitionBy("id").orderBy("response_id"))).where("other IS NOT NULL")
    plus = lambda c: F.concat(F.col(c), F.lit(" + 1"))
    return g.select("id", "response_id", V.distance(F.col("answer"), F.col("other"), "levenshtein").alias("levenshtein"), V.distance(plus("answer"), plus("other"), "tree").alias("tree"), V.distance(F.col("answer"), F.col("other"), "binary").alias("binary"))


@query("SELECT CASE WHEN p_size > 45 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS number, count(*) AS n FROM part GROUP BY 1")
def safe_numbers(spark, sf):
    """MTH11, MTH12."""
    raw = F.when(F.col("p_size") > 45, "n/a").otherwise(F.col("p_size").cast("string"))
    return read(spark, sf, "part").groupBy(V.safe_double(raw).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang AS dataset, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS is_en, 'math' AS verb, 'qwen_math_prompt' AS init FROM documents GROUP BY lang""")
def dataset_dispatch(spark, sf):
    """STR27."""
    d = read(spark, sf, "documents").select(F.col("lang").alias("dataset")).distinct()
    k = X.dataset_dispatch(F.col("dataset"))
    return d.select("dataset", (F.col("dataset") == "en").cast("int").alias("is_en"), k["verb"].alias("verb"), k["init"].alias("init"))


@query("SELECT page_id, CASE WHEN length(html) > 80 THEN substr(html, 1, 80) || '...' || substr(sha256(html), 1, 8) ELSE html END AS short FROM (SELECT page_id, regexp_replace(html, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '?', 'g') AS html FROM pages)")
def smart_truncate(spark, sf):
    """STR25."""
    return read(spark, sf, "pages").select("page_id", X.smart_truncate(F.col("html"), 80).alias("short"))
