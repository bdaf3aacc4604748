"""Text functions and verifiers on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalquarry.functions import text as X
from evalquarry.functions import verify as V


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("text, want", [(r"a \boxed{1} \boxed{ \frac{1}{4} }", r"\frac{1}{4}"), (r"\boxed{\sqrt{\frac{1}{2}}}", None), ("none", None)])
def test_boxed(spark, text, want):
    assert one(spark, X.boxed_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("x<|channel|>final<|message|> done <|return|>", ("done", "parsable_thinking")),
        ("<|channel|>analysis<|message|>so", ("<|channel|>analysis<|message|>so", "malformed_thinking")),
        ("analysis of it assistantfinal yes", (" yes", "parsable_thinking")),
        ("analysis of it", ("analysis of it", "malformed_thinking")),
        ("plain", ("plain", "no_thinking")),
        ("<think>a</think>b", ("b", "parsable_thinking")),
        ("<think>abc", ("<think>abc", "malformed_thinking")),
        ("<think>" + "a" * 30, ("<think>aaa", "truncated_malformed_thinking")),
    ],
)
def test_thinking(spark, text, want):
    assert tuple(one(spark, X.thinking_split(F.col("t"), max_length=10 if "truncated" in want[1] else 1000), t=text)) == want


def test_verdict_polarity(spark):
    flagged = "**Draft is incorrect**"
    tagged = "<overall_verdict> Incorrect </overall_verdict>"
    assert one(spark, X.verdict_1f(F.col("t")), t=flagged) is True
    assert one(spark, X.verdict_distance(F.col("t")), t=flagged) is False
    assert one(spark, X.verdict_1f(F.col("t")), t=tagged) is True
    assert one(spark, X.verdict_1f(F.col("t")), t="nothing") is None
    assert one(spark, X.verdict_1f(F.col("t")), t="  ") is None
    two = "<overall_verdict_1>incorrect</overall_verdict_1> <overall_verdict_2> incorrect </overall_verdict_2>"
    assert one(spark, X.verdict_2f(F.col("t")), t=two) is True
    assert one(spark, X.verdict_2f(F.col("t")), t=two.replace("_2>", "_3>").replace("incorrect</overall_verdict_1>", "correct</overall_verdict_1>")) is False
    assert one(spark, X.verdict_2f(F.col("t")), t=None) is False


def test_code_answers(spark):
    t = "<think>[ANSWER]no[/ANSWER]</think>[ANSWER]\nassert f('hi') == \"yo\"\n[/ANSWER]"
    assert one(spark, X.code_answer(F.col("t"), "input"), t=t) == "f('hi')"
    assert one(spark, X.code_answer(F.col("t"), "output"), t=t) == '"yo"'
    assert one(spark, X.code_answer(F.col("t"), "output"), t="so assert f(1) == 2\n") == "2"
    assert one(spark, X.code_answer(F.col("t"), "output"), t="nothing") == X.NO_ANSWER


def test_run_names(spark):
    assert one(spark, X.run_tokens(F.col("t")), t="ifeval:model=amazon/nova:0,flag, a = b") == {"model": "amazon_nova:0", "flag": "true", "a": "b"}
    assert one(spark, X.run_benchmark(F.col("t")), t="ifeval:model=x:0") == "ifeval"
    assert one(spark, X.run_benchmark(F.col("t")), t="none") == ""


def test_metric_names(spark):
    assert [one(spark, X.metric_class(F.col("t")), t=t) for t in ("exact_match@5", "num_x", "odd", "")] == ["core", "bookkeeping", "untracked", "untracked"]
    assert [one(spark, X.metric_family(F.col("t")), t=t) for t in ("air_x", "f1@5", "a_b:c", "bias_metric:x", "")] == ["air", "f1", "a", "bias_metric", "?"]


def test_render_needs_its_columns(spark):
    with pytest.raises(KeyError):
        X.render("{arg_a} {arg_b}", ["a"])


def test_normalised_answers(spark):
    f = X.normalise_answer(F.col("t"))
    assert one(spark, f, t=r"\dfrac{1}{2} = 0.5") == "(1)/(2)"
    assert one(spark, f, t=r"\text{two}") is None
    assert one(spark, f, t="(3 × 4)") == "3 * 4"
    assert one(spark, X.answer_from_lines(F.col("t")), t="so\n3*4 = 12.\nthe end of it all, that is") == "3*4"


@pytest.mark.parametrize("a, b, same", [("1/2", "0.5", True), (r"\frac{1}{2}", "0.5", True), ("x", "x ", True), ("x", "y", False), (None, None, True), (None, "1", False), ("2^3", "8", True), (r"\sqrt{16}", "4", True), ("1,000", "1000", True), ("1/0", "2", False), ("9**999999999", "1", False), ("__import__('os')", "1", False), ("1" * 101, "1" * 101 + " ", True)])
def test_equivalence(a, b, same):
    assert V.equivalent(a, b) is same


def test_24():
    assert V.correct_24("6 × (5 - 1) × 1 = 24", [1, 1, 5, 6]) is True
    assert V.correct_24("6 × 4", [1, 1, 5, 6]) is False
    assert V.correct_24("6 × 4", None) is None


def test_tree_distance():
    d = lambda a, b: V.tree_distance(V.tree(a), V.tree(b))
    assert d("1+2", "1+2") == 0
    assert d("1+2", "1+3") == 1
    assert d("1+2", "1*3") == 2
    assert d("1+2*3", "1") == 4
    assert d("-1", "1") == 1
    with pytest.raises(ValueError):
        V.tree("f(1)")


def test_majority_ties_go_to_the_first():
    assert V.majority(["1", "2", "1/1"], [False, True, False]) is False
    assert V.majority(["2", "1"], [True, False]) is True
    assert V.majority(["1", "2"], [False, None]) is False


def test_code_runs_only_on_request():
    with pytest.raises(PermissionError):
        V.execution_verifier(F, F, F)
    assert V.run_check("def f(x): return x + 1", "f(1)", "2") is True
    assert V.run_check("def f(x): return x + 1", "f(1)", "3") is False
    assert V.run_check("while True: pass", "1", "1", seconds=1) is False


def test_operations():
    assert V.operations("(1+2)*3") == [("+", "1", "2"), ("*", "#1", "3")]
