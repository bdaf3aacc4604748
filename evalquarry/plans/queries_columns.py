"""Queries over columns: names, ids, answers, distances and lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from evalquarry import schemas
from evalquarry.functions import ids, perturb
from evalquarry.functions import text as X
from evalquarry.functions import verify as V
from evalquarry.operators import cards, distances, flows, generations, joins, outcomes, recursion, tables
from evalquarry.plans.base import query
from evalquarry.plans.domain_views import GEN, STATS, gen, read, stats


def nested(spark, sf):
    """Stats as rows of nested structs."""
    s = stats(spark, sf)
    name = F.struct(F.col("metric").alias("name"), "split", F.when(F.col("perturbation").isNotNull(), F.struct(F.col("perturbation").alias("name"), (F.col("count") / 10).alias("prob"))).alias("perturbation"))
    return s.select("row_ord", F.struct(name.alias("name"), "count", "mean").alias("stats"))


@query("WITH " + STATS + " SELECT row_ord, metric, split, perturbation, mean FROM stats")
def flat_columns(spark, sf):
    """FLT9, JSN1: nested fields as dotted names, columns under a prefix without it, another prefix put before."""
    flat = tables.flatten(nested(spark, sf))
    inner = tables.prefix_columns(tables.reorder(flat, head=["stats.mean"]), "stats", drop=True)
    both = tables.insert_prefix(tables.flatten(nested(spark, sf).select("row_ord")), "k")
    d = tables.dcol
    if tables.suffix_columns(inner, "name").columns != ["name.name", "name.perturbation.name"] or both.columns != ["k.row_ord"]:
        raise ValueError("columns lost")
    return flat.select("row_ord", d("stats.name.name").alias("metric"), d("stats.name.split").alias("split"), d("stats.name.perturbation.name").alias("perturbation"), d("stats.mean").alias("mean"))


@query("""SELECT * FROM (VALUES ('reordered', 'stats.mean,row_ord,stats.name.name,stats.name.split,stats.name.perturbation.name,stats.name.perturbation.prob,stats.count'),
('dropped', 'row_ord,stats.name.name,stats.name.split,stats.name.perturbation.name,stats.name.perturbation.prob,stats.mean'), ('glob', 'stats.name.name,stats.name.split,stats.name.perturbation.name,stats.name.perturbation.prob'),
('regex', 'stats.count'), ('search', 'stats.name.perturbation.prob'), ('short', 'row_ord,name.name,split,perturbation.name,prob,count,mean')) t(what, names)""")
def column_tools(spark, sf):
    """FLT10, FLT11, FLT12, FLT13: columns in another order, dropped, matched three ways, and shortened."""
    flat = tables.flatten(nested(spark, sf))
    found = {
        "reordered": tables.reorder(flat, head=["stats.mean", "nowhere"], missing="drop").columns, "dropped": tables.safe_drop(flat, ["stats.count", "nowhere"]).columns, "glob": tables.match_columns(flat, "stats.name.*"),
        "regex": tables.match_columns(flat, r"stats\.c.*", "regex"), "search": tables.match_columns(flat, "prob", "search"), "short": tables.shorten_columns(flat).columns,
    }
    return spark.createDataFrame([(k, ",".join(v)) for k, v in found.items()], "what string, names string")


@query("SELECT doc_id, substr(text, 1, 100) AS cut FROM documents")
def truncated_texts(spark, sf):
    """FLT15."""
    return read(spark, sf, "documents").select("doc_id", generations.truncate(F.col("text"), 100).alias("cut"))


@query("SELECT p_partkey AS part, p_size AS size, round(p_retailprice, 1) AS price FROM part")
def compact_table(spark, sf):
    """FLT16."""
    return tables.compact(read(spark, sf, "part"), {"p_partkey": "part", "p_size": "size", "p_retailprice": "price"}, 1)


@query("SELECT c_custkey AS k, CAST(c_custkey % 4 AS DOUBLE) / 10 AS low, CAST(c_custkey % 5 AS DOUBLE) / 10 + 0.5 AS high, CAST(c_custkey % 9 AS INT) AS n, CAST(c_custkey % 7 AS INT) AS seed, (c_custkey % 3 + 1) || 'B' AS size FROM customer")
def path_fields(spark, sf):
    """FLT17: what an experiment's path names."""
    k = F.col("c_custkey")
    tenth = lambda m: F.format_string("%.1f", m / 10)
    path = F.concat(F.lit("runs/sr"), tenth(k % 4), F.lit("-"), tenth(k % 5 + 5), F.lit("_n"), (k % 9).cast("string"), F.lit("_seed"), (k % 7).cast("string"), F.lit("/model-"), (k % 3 + 1).cast("string"), F.lit("B/out"))
    return read(spark, sf, "customer").select(k.alias("k"), tables.path_metadata(path).alias("m")).select("k", "m.*")


@query("SELECT 'draft.alias' AS name, 'a,b' AS vals UNION ALL SELECT 'solve.n', '8'")
def task_matrix(spark, sf):
    """FLT20."""
    m = cards.task_matrix({"draft_params": {"alias": ["a", "b"]}, "solve_params": {"n": 8}, "other": {"x": 1}})
    return spark.createDataFrame([(k, ",".join(map(str, v))) for k, v in m.items()], "name string, vals string")


@query("WITH " + GEN + """, a AS (SELECT id, response_id, answer, lag(answer) OVER (PARTITION BY id ORDER BY response_id) AS d1, lag(answer, 2) OVER (PARTITION BY id ORDER BY response_id) AS d2, finish FROM gen)
SELECT id, response_id, coalesce(d1, '') || '|' || coalesce(d2, '') AS drafts, answer FROM a WHERE d1 IS NOT NULL AND finish = 'stop'""")
def anchored_rows(spark, sf):
    """FLT21, SRC11, STR11, STR14: drafts as an array; answers from a field, else from the last line of the text."""
    from pyspark.sql import Window as W

    w = W.partitionBy("id").orderBy("response_id")
    g = gen(spark, sf).select("id", "response_id", "finish", F.lag("answer").over(w).alias("d1"), F.lag("answer", 2).over(w).alias("d2"), F.when(F.col("response_id") % 2 == 0, F.col("answer")).alias("answer"), F.concat(F.lit("so I think\n"), F.col("answer"), F.lit(".\nthank you all")).alias("text"))
    found = distances.anchored_rows(g, ["d1", "d2"])
    return found.select("id", "response_id", F.concat_ws("|", F.coalesce(F.get("drafts", F.lit(0)), F.lit("")), F.coalesce(F.get("drafts", F.lit(1)), F.lit(""))).alias("drafts"), "answer")


@query("WITH " + GEN + """, a AS (SELECT id, answer, lag(answer) OVER (PARTITION BY id ORDER BY response_id) AS d1 FROM gen)
SELECT id, d1 AS draft, count(*) AS n, string_agg(answer, ',' ORDER BY answer) AS answers FROM a WHERE d1 IS NOT NULL GROUP BY id, d1""")
def anchor_groups(spark, sf):
    """AGG51, JSN3: responses by problem and draft list."""
    from pyspark.sql import Window as W

    g = gen(spark, sf).select("id", "answer", F.lag("answer").over(W.partitionBy("id").orderBy("response_id")).alias("d1")).where("d1 IS NOT NULL")
    return distances.anchor_groups(g.withColumn("drafts", F.array("d1"))).select("id", F.element_at("drafts", 1).alias("draft"), "n", F.array_join("answers", ",").alias("answers"))


@query("WITH " + GEN + " SELECT id, answer, arg_max(CASE WHEN correctness THEN 1.0 WHEN NOT correctness THEN 0.0 ELSE 0.5 END, response_id) AS rate FROM gen GROUP BY id, answer")
def last_rates(spark, sf):
    """AGG13: of repeated keys the last counts."""
    g = gen(spark, sf).withColumn("rate", F.when(F.col("correctness"), 1.0).when(~F.col("correctness"), 0.0).otherwise(0.5))
    return outcomes.last_rates(g, ["id", "answer"], "response_id")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 END AS p FROM orders")
def pass_at_1_fallbacks(spark, sf):
    """AGG25: from three places of a document, or nowhere."""
    k = F.col("o_orderkey") % 4
    doc = F.when(k == 0, '{"overall_stats": {"pass_at_1": 0.25}, "pass_at_1": 0.9}').when(k == 1, '{"pass_at_1": 0.5}').when(k == 2, '{"pass_at_k_by_source": {"overall": {"pass_at_k": [0.75, 1]}}}').otherwise("{}")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), recursion.pass_at_1(doc).alias("p"))


@query("WITH " + GEN + """, l AS (SELECT id, list(response_id ORDER BY response_id) AS x FROM gen GROUP BY id)
SELECT id, CASE WHEN len(x) < 3 THEN 1 ELSE len(x) // 3 END AS pools, CASE WHEN len(x) < 3 THEN len(x) ELSE 3 * (len(x) // 3) END AS used FROM l""")
def device_pools(spark, sf):
    """ARR2: whole chunks of three; a shorter list is one."""
    g = gen(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list("response_id")).alias("x"))
    p = recursion.device_pools_column(F.col("x"), 3)
    return g.select("id", F.size(p).alias("pools"), F.size(F.flatten(p)).alias("used"))


@query("SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def node_order(spark, sf):
    """SRT12: a chain of all nations, given backwards."""
    keys = [r[0] for r in read(spark, sf, "nation").select("n_nationkey").orderBy(F.desc("n_nationkey")).collect()]
    order = flows.node_order([(str(b), str(a)) for a, b in zip(keys, keys[1:])])
    return spark.createDataFrame([(int(k), i) for i, k in enumerate(order)], "k long, place long")


@query("WITH " + GEN + r" SELECT id, response_id, '(' || answer || ')/(2)* 3' AS infix, response_id % 3 = 0 AS textual, '3,*,(,' || answer || ',+,2,)' AS tokens, '3,' || answer || ',2' AS numbers FROM gen")
def answer_texts(spark, sf):
    """STR11, STR12, STR13, STR15: LaTeX as infix, tests for text, tokens and numbers."""
    a = F.col("answer")
    latex = F.concat(F.lit("\\displaystyle \\dfrac{"), a, F.lit("}{2}\\times 3 = x"))
    text = F.when(F.col("response_id") % 3 == 0, "\\text{none}").otherwise(a)
    sum_ = F.concat(F.lit("3 × ("), a, F.lit(" + 2)"))
    return gen(spark, sf).select("id", "response_id", X.normalise_answer(latex).alias("infix"), X.textual_latex(text).alias("textual"), F.array_join(X.arithmetic_tokens(sum_), ",").alias("tokens"), F.array_join(X.numbers(sum_), ",").alias("numbers"))


@query("SELECT n_nationkey AS k, '+ ' || n_nationkey || ' 2;* #1 3' AS steps, true AS parses FROM nation")
def operation_lists(spark, sf):
    """STR16: arithmetic as a list of steps."""
    rows = [(r[0], f"({r[0]} + 2) * 3") for r in read(spark, sf, "nation").select("n_nationkey").collect()]
    df = spark.createDataFrame([(k, t, ";".join(" ".join(s) for s in V.operations(t))) for k, t in rows], "k long, t string, steps string")
    return df.select("k", "steps", V.parses(F.col("t")).alias("parses"))


@query("SELECT r_regionkey AS k, length(replace(r_name, ' ', '')) + 2 AS head, 60 AS size, true AS stable, true AS apart FROM region")
def readable_ids(spark, sf):
    """STR23, STR24: base-36 digests that don't depend on the order of fields or on paths of a machine."""
    r = read(spark, sf, "region").withColumn("s", F.struct("r_name", "r_regionkey", F.lit("/tmp/a").alias("name_file_path"))).withColumn("t", F.struct(F.lit("/tmp/b").alias("name_file_path"), "r_regionkey", "r_name"))
    a, b = (ids.stable_hash36(F.col(c), r.schema[c].dataType, ids.MACHINE_KEYS) for c in "st")
    other = ids.stable_hash36(F.col("s"), r.schema["s"].dataType)
    key = ids.prefixed_id(F.col("r_name"), a)
    return r.select(F.col("r_regionkey").alias("k"), F.instr(key, "::").alias("head_"), F.length(a).alias("size"), (a == b).alias("stable"), (other != a).alias("apart"), F.col("r_name")).select("k", (F.col("head_") - 1 + 2).alias("head"), "size", "stable", "apart")


@query("WITH " + STATS + """ SELECT row_ord, metric || ',split=' || split || CASE WHEN perturbation IS NOT NULL THEN ',pert=' || perturbation || ',prob=' || CAST(count / 10.0 AS VARCHAR) ELSE '' END || ',count=' || count AS key_head,
  CASE WHEN perturbation IS NOT NULL THEN perturbation || ',prob=' || CAST(count / 10.0 AS VARCHAR) END AS pert_head, 'row,' AS row_head, 60 AS id_size FROM stats""")
def stat_ids(spark, sf):
    """STR24: keys of stats, perturbations and rows: what stands before the digest."""
    n = nested(spark, sf)
    name, kind = F.col("stats")["name"], n.schema["stats"].dataType["name"].dataType
    head = lambda c: F.substring_index(c, "::", 1)
    return n.select(
        "row_ord", head(ids.stat_key(name, kind, F.col("stats")["count"])).alias("key_head"), head(ids.perturbation_id(name["perturbation"], kind["perturbation"].dataType)).alias("pert_head"),
        F.substring(ids.row_id(F.col("stats"), n.schema["stats"].dataType), 1, 4).alias("row_head"), F.length(ids.stat_name_id(name, kind)).alias("id_size"),
    )


@dataclass
class Price:
    amount: float
    tag: str | None


@dataclass
class Item:
    key: int
    names: list[str]
    price: Price


@query("SELECT p_partkey AS key, p_name AS name, p_retailprice AS amount, true AS same, p_partkey % 10 = 0 AS broken FROM part")
def decoded_structs(spark, sf):
    """JSN2: dataclasses as struct types, JSON decoded and encoded again, equal content with equal digests."""
    p = read(spark, sf, "part")
    doc = F.to_json(F.struct(F.struct(F.col("p_retailprice").alias("amount")).alias("price"), F.array("p_name").alias("names"), F.col("p_partkey").alias("key")))
    torn = F.when(F.col("p_partkey") % 10 == 0, F.substring(doc, 1, 5)).otherwise(doc)
    kind = schemas.struct_of(Item)
    j = p.select(schemas.Registry(Item, Price).decode("Item", doc).alias("i"), schemas.decode(torn, Item)["price"]["amount"].isNull().alias("broken"))
    again = schemas.decode(schemas.encode(F.col("i")), Item)
    return j.select("i.key", F.element_at("i.names", 1).alias("name"), "i.price.amount", (ids.stable_hash36(F.col("i"), kind) == ids.stable_hash36(again, kind)).alias("same"), "broken")


@query("""SELECT item_id, 'lowercase' AS perturbation, lower(text) AS input FROM benchmark UNION ALL SELECT item_id, 'extra_space', replace(text, ' ', '  ') FROM benchmark""")
def perturbed_instances(spark, sf):
    """UDF8, SNK16: every instance under two perturbations."""
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("input"))
    return perturb.perturbed(b, [{"name": n} for n in ("lowercase", "extra_space")])


@query("WITH " + GEN + " SELECT id, response_id, CASE response_id % 3 WHEN 0 THEN CAST(answer AS INT) % 2 = 0 WHEN 1 THEN CAST(answer AS INT) = 12 END AS ok FROM gen")
def verified_by_task(spark, sf):
    """UDF1, ARR1, ARR4: the verifier that each row's task names."""
    k, a = F.col("response_id") % 3, F.col("answer")
    task = F.when(k == 0, "math").when(k == 1, "game_of_24").otherwise("crux")
    answer = F.when(k == 1, F.concat(a, F.lit(" + 6 × 2 = 24"))).otherwise(F.concat(F.lit("\\frac{"), a, F.lit("}{2}")))
    numbers = F.array(a.cast("long"), F.lit(6).cast("long"), F.lit(2).cast("long"))
    return gen(spark, sf).select("id", "response_id", V.verified_by_task(task, answer, F.floor(a.cast("double") / 2).cast("string"), numbers=numbers).alias("ok"))


_ANSWERS = [
    ("\\frac{1}{2}", "0.5", True), ("2x+2", "2(x+1)", True), ("(x+1)^2", "x^2+2x+1", True), ("\\{1,2,3\\}", "\\{3,1,2\\}", True), ("(1,2)", "(2,1)", False), ("[0,1)", "[0, 1)", True), ("[0,1)", "(0,1)", False),
    ("\\sqrt{12}", "2\\sqrt{3}", True), ("\\sqrt{2}", "1.41421356", False), ("x=5", "5", True), ("50\\%", "1/2", True), ("1,000", "1000", True), ("(-\\infty,2)\\cup(3,4]", "(3,4]\\cup(-\\infty,2)", True), ("\\frac{\\pi}{2}", "0.5\\pi", True),
    ("x+1", "x", False), ("Paris", "London", False), ("(((9^64)^64)^64)^32", "1", False), ("9**9**9**9", "1", False), ("1/0", "1", False),
]


@query("SELECT n_nationkey, i, ok FROM nation, (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, _, ok) in enumerate(_ANSWERS)) + ") t(i, ok)")
def mixed_answers(spark, sf):
    """MTH1, MTH2: numbers, expressions, tuples, sets, intervals and hostile powers; every nation asks all."""
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b, _) in enumerate(_ANSWERS)])
    return read(spark, sf, "nation").select("n_nationkey", F.inline(asked)).select("n_nationkey", "i", V.equivalent_udf(F.col("a"), F.col("b")).alias("ok"))


@query("SELECT r_regionkey AS k, r_regionkey % 2 = 0 AS ok FROM region")
def executed_answers(spark, sf):
    """MTH4, MTH5, UDF1: code run in a limited child process, on consent; right for every second region."""
    k = F.col("r_regionkey")
    guess = F.concat(F.lit("f("), (k + k % 2).cast("string"), F.lit(")"))
    code = F.when(k == 4, "import os\nos.system('true') if os.system else None\ndef f(x): return x * 2").otherwise("def f(x): return x * 2")
    return read(spark, sf, "region").select(k.alias("k"), V.execution_verifier(code, guess, (k * 2).cast("string"), allow=True).alias("ok"))


@query("WITH " + STATS + " SELECT DISTINCT instance_id, trial, perturbation FROM stats WHERE instance_id = 3 AND perturbation IS NOT NULL")
def instance_variants(spark, sf):
    """FIL19: the perturbed variants of an instance."""
    return joins.variants(stats(spark, sf), 3, perturbed=True)


@query("WITH " + STATS + " SELECT metric, split, perturbation, mean FROM stats WHERE instance_id = 3 AND trial = 1 AND perturbation IS NULL")
def stats_of_a_variant(spark, sf):
    """FIL19: the stats of one variant, by a prefix of the key."""
    return joins.stats_for(stats(spark, sf), instance_id=3, trial=1, perturbation=None)


@query("WITH " + STATS + " SELECT run, row_ord, mean FROM stats WHERE row_ord = 7")
def row_by_key(spark, sf):
    """FIL19: one row by its exact key, in the older form."""
    s = stats(spark, sf)
    r = s.where("row_ord = 7").first()
    return joins.row_at(s, tuple(r[c] for c in joins.LEGACY_KEY)).select("run", "row_ord", "mean")


@query("WITH " + GEN + ", a AS (SELECT id, list(response_id ORDER BY response_id) AS x, list(answer ORDER BY response_id) AS y FROM gen GROUP BY id) SELECT id, unnest(x) AS left, unnest(y) AS right FROM a")
def zipped_rows(spark, sf):
    """JOI22, SRC30: two arrays by position."""
    p = generations.pack(gen(spark, sf).select("id", "response_id", "answer"), ["id"])
    return joins.zipped(p.select("id", F.col("gens.response_id").alias("x"), F.col("gens.answer").alias("y")), "x", "y")


@query("WITH " + GEN + " SELECT id, count(*) AS n, count(*) AS requested, 'Problem ' || id AS prompt, substr(sha256('Problem ' || id), 1, 16) AS hash FROM gen GROUP BY id")
def built_records(spark, sf):
    """FLT22: packed records with their metadata."""
    p = generations.pack(gen(spark, sf).select("id", "response_id", "answer"), ["id"])
    r = generations.build_record(p, "solve", X.render("Problem {arg_id}", ["id"]), F.col("gens"), 4, "t.yaml", "math", "m")
    m = F.col("solve_generations_metadata")
    return r.select("id", m["num_responses"].alias("n"), F.size("solve_generations").cast("long").alias("requested"), F.col("solve_prompt").alias("prompt"), m["prompt_hash"].alias("hash"))


@query("SELECT n_nationkey AS k, way, true AS inside FROM nation, (SELECT unnest(['pandas', 'dicts', 'frame', 'random']) AS way) t")
def table_inputs(spark, sf):
    """SRC29, SRC34: tables from pandas, from dictionaries, as they are, and made-up ones, whose values lie between 0 and 1."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    given = {"pandas": n.toPandas(), "dicts": [r.asDict() for r in n.collect()], "frame": n}
    out = [tables.ensure_long(spark, v).select("k", F.lit(w).alias("way"), F.lit(True).alias("inside")) for w, v in given.items()]
    made = tables.random_table(spark, n.count(), 2, 1).select(F.col("id").alias("k"), F.lit("random").alias("way"), (F.col("c0").between(0, 1) & (F.col("c0") != F.col("c1"))).alias("inside"))
    return joins.union_by_name([*out, made])
