"""Text functions over response columns, as built-in expressions (no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, keywords, tokens and sentinels that results depend on.
BOXED = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
CORRECT_KEYWORDS = ("draft solution is correct", "draft is correct", "draft correct", r"\boxed{\text{correct}}")
INCORRECT_KEYWORDS = ("draft solution is incorrect", "draft is incorrect", "draft incorrect", r"\boxed{\text{incorrect}}")
VERDICT = r"(?s)<overall_verdict>\s*([^\n<]*?)\s*</overall_verdict>"
VERDICT_LOOSE = r"(?s)<overall_verdict>\s*([^\n]*)</overall_verdict>"
VERDICT_NUMBERED = r"(?s)<overall_verdict_(\d+)>\s*(.*?)\s*</overall_verdict_\1>"
FINAL_CHANNEL = "<|channel|>final<|message|>"
ANALYSIS_CHANNEL = "<|channel|>analysis<|message|>"
END_TOKENS = ("<|return|>", "<|end|>", "<|endoftext|>")
NO_ANSWER = "EMPTYSTRINGWHICHSHOULDNOTMATCHWITHANYTHING"
CORE_METRICS = ("exact_match", "quasi_exact_match", "prefix_exact_match", "quasi_prefix_exact_match", "classification_micro_f1", "classification_macro_f1", "f1_score", "rouge_l", "bleu_", "ifeval_strict_accuracy", "wildbench_score", "wildbench_score_rescaled", "omni_math_accuracy", "chain_of_thought_correctness", "math_equiv", "math_equiv_chain_of_thought", "safety_score", "safety_gpt_score", "safety_llama_score", "air_score", "air_category_")
BOOKKEEPING_METRICS = ("num_", "training_", "inference_", "batch_size", "max_prob", "logprob", "num_perplexity_tokens", "num_bytes", "perplexity", "bits_per_byte", "logprob_per_byte", "finish_reason_", "prompt_truncated", "ece_", "platt_", "selective_", "num_instances", "num_train_", "num_references")
TEXTUAL_LATEX = "text|mathrm|operatorname|textbf|textit"
# LaTeX patterns and what stands for them, in the order in which they apply: marks of
# spacing and size first, so that braces follow their commands; fractions before single braces, which
# they are made of.
LATEX_STEPS = (
    (r"\\[!,;:\s]+", ""),
    (r"\\bigl|\\bigr|\\Bigl|\\Bigr|\\big|\\Big", ""),
    (r"\\left|\\right", ""),
    (r"\\times|\\cdot", "*"),
    (r"\\[dt]frac\s*\{([^}]*)\}\s*\{([^}]*)\}", r"\\frac{$1}{$2}"),
    (r"\\frac\s*\{([^}]*)\}\s*\{([^}]*)\}", "($1)/($2)"),
    (r"\{", "("),
    (r"\}", ")"),
)


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def last(c: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group, null without a match."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def boxed_answer(text: Column) -> Column:
    """STR1: content of the last boxed expression (two brace levels)."""
    return strip(last(text, BOXED))


def strip_end_tokens(c: Column) -> Column:
    """STR3: each trailing special token once, in order."""
    return reduce(lambda x, t: F.when(F.endswith(x, F.lit(t)), F.substring(x, F.lit(1), F.length(x) - len(t))).otherwise(x), END_TOKENS, c)


def thinking_split(response: Column, prompt: Column | None = None, max_length: int = 16384, channels: bool = True) -> Column:
    """STR2: struct(final, status) of a response: channel tokens, bare channel words or think tags.

    ``channels=False`` is the variant of iterated rounds, without the special-token branch.
    """
    prompt = F.coalesce(prompt, F.lit("")) if prompt is not None else F.lit("")
    both = F.concat(prompt, response)
    answer = F.substring_index(response, "</think>", -1)
    balanced = F.regexp_count(both, F.lit("<think>")) == F.regexp_count(both, F.lit("</think>"))
    made = lambda text, status: F.struct(text.alias("final"), (F.lit(status) if isinstance(status, str) else status).alias("status"))
    tagged = F.when(balanced, made(answer, "parsable_thinking")).otherwise(
        F.when(F.length(answer) > max_length, made(F.substring(answer, 1, max_length), "truncated_malformed_thinking")).otherwise(made(answer, "malformed_thinking"))
    )
    bare = F.when(F.contains(response, F.lit("assistantfinal")), made(F.substring_index(response, "assistantfinal", -1), "parsable_thinking")).otherwise(made(response, "malformed_thinking"))
    rest = F.when(F.startswith(response, F.lit("analysis")), bare).when(~F.contains(both, F.lit("<think>")), made(response, "no_thinking")).otherwise(tagged)
    if not channels:
        return rest
    final = strip(strip_end_tokens(F.substring_index(response, FINAL_CHANNEL, -1)))
    return F.when(F.contains(response, F.lit(FINAL_CHANNEL)), made(final, "parsable_thinking")).when(F.contains(response, F.lit(ANALYSIS_CHANNEL)), made(response, "malformed_thinking")).otherwise(rest)


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[*\n]", "")


def _blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def verdict_1f(c: Column) -> Column:
    """STR4: true if the draft was flagged incorrect, false if correct, null if nothing parses."""
    tag = last(F.lower(c), VERDICT)
    return F.when(_blank(c), None).when(contains_any(_flat(c), CORRECT_KEYWORDS), False).when(contains_any(_flat(c), INCORRECT_KEYWORDS), True).when(tag.isNotNull(), strip(tag) == "incorrect")


def verdict_2f(c: Column) -> Column:
    """STR5: true if the first two numbered verdicts are both incorrect."""
    tags = F.regexp_extract_all(_flat(c), F.lit(VERDICT_NUMBERED), F.lit(2))
    two = F.coalesce(F.forall(F.slice(tags, 1, 2), lambda x: strip(x) == "incorrect"), F.lit(False)) & (F.size(tags) >= 2)
    return F.when(_blank(c), False).otherwise(two)


def verdict_distance(c: Column) -> Column:
    """STR6: the opposite polarity: true if correct."""
    tag = last(_flat(c), VERDICT_LOOSE)
    return F.when(_blank(c), None).when(contains_any(_flat(c), CORRECT_KEYWORDS), True).when(contains_any(_flat(c), INCORRECT_KEYWORDS), False).when(tag.isNotNull(), strip(tag) == "correct")


def annotate_verdicts(gens: Column, parse=verdict_1f) -> Column:
    """STR7: each generation struct with its ``verdict``."""
    return F.transform(gens, lambda g: g.withField("verdict", parse(g["generated_response"])))


def code_answer_from_assert(text: Column, mode: str) -> Column:
    """STR9: a side of the first ``assert a == b``."""
    pattern = r"(?s)assert\s+(.*?)\s*==\s*(.*?)\s*(?:\n|$)"
    return F.when(F.regexp_like(text, F.lit(pattern)), strip(F.regexp_extract(text, pattern, 1 if mode == "input" else 2))).otherwise(NO_ANSWER)


def code_answer(text: Column, mode: str) -> Column:
    """STR8: the first answer block's side of ``==``; a sentinel if it has none."""
    tail = F.substring_index(text, "</think>", -1)
    block = r"(?s)\[ANSWER\](.*?)\[/ANSWER\]"
    body = F.regexp_replace(strip(F.regexp_extract(tail, block, 1)), "\n", "")
    sides = F.split(body, "==")
    left = strip(sides[0])
    if mode == "input":
        found = F.when(F.contains(left, F.lit("assert f(")), F.concat(F.lit("f"), strip(F.element_at(F.split(left, "assert f"), 2)))).otherwise(left)
    else:
        found = F.when(F.size(sides) > 1, strip(F.get(sides, F.lit(1)))).otherwise(NO_ANSWER)
    return F.when(F.regexp_like(tail, F.lit(block)), found).otherwise(code_answer_from_assert(tail, mode))


def strip_leading_zero(c: Column) -> Column:
    """STR10."""
    return F.when(F.startswith(c, F.lit("0")) & ~F.contains(c, F.lit(".")) & (c != "0"), F.regexp_replace(c, "^0+", "")).otherwise(c)


def textual_latex(c: Column) -> Column:
    """STR13."""
    return F.regexp_like(c, F.lit(TEXTUAL_LATEX))


def latex_to_infix(c: Column) -> Column:
    """STR12: LaTeX as infix arithmetic; whether it is any is for ``verify.parses`` to say."""
    for pattern, instead in LATEX_STEPS:
        c = F.regexp_replace(c, pattern, instead)
    return c


def normalise_answer(c: Column) -> Column:
    """STR11: an answer as infix arithmetic without letters, null where it is text, long or empty."""
    bare = F.regexp_replace(c, r"\\displaystyle", "")
    inner = F.when(F.startswith(bare, F.lit("(")) & F.endswith(bare, F.lit(")")), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    left = strip(F.split(F.translate(inner, "×÷", "*/"), "=")[0])
    return F.when(_blank(c) | textual_latex(bare) | (F.length(bare) > 50), None).otherwise(F.regexp_replace(latex_to_infix(left), "[a-zA-Z]", ""))


def answer_from_lines(text: Column, parse=normalise_answer) -> Column:
    """STR14: the last line that parses as an answer."""
    lines = F.transform(F.reverse(F.split(text, "\n")), lambda x: F.regexp_replace(F.regexp_replace(strip(x), "`+$", ""), r"\.+$", ""))
    good = F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) <= 80))
    return F.get(F.filter(F.transform(good, parse), lambda x: x.isNotNull() & F.regexp_like(x, F.lit(r"^[-+*/().0-9\s]*[0-9][-+*/().0-9\s]*$"))), F.lit(0))


def arithmetic_tokens(c: Column) -> Column:
    """STR15."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(c, " ", ""), F.lit(r"(\d+\.\d+|\d+|[()+\-*/×÷])"), F.lit(1)), lambda t: F.translate(t, "×÷", "*/"))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def template_fields(template: str) -> list[str]:
    """STR17: the names of ``{arg_x}`` fields in order, once each."""
    import re

    return list(dict.fromkeys(re.findall(r"\{arg_(\w+)\}", template)))


def render(template: str, columns: list[str]) -> Column:
    """STR17: a template with columns put in; a field without a column raises."""
    if missing := [f for f in template_fields(template) if f not in columns]:
        raise KeyError(f"template fields without a column: {missing}")
    return reduce(lambda x, f: F.replace(x, F.lit(f"{{arg_{f}}}"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))), template_fields(template), F.lit(template))


def prompt_hash(c: Column) -> Column:
    """STR18."""
    return F.substring(F.sha2(c, 256), 1, 16)


def draft_key(c: Column) -> Column:
    """STR19."""
    return F.md5(F.coalesce(c, F.lit("")))


def run_benchmark(name: Column) -> Column:
    """STR20: what stands before the first colon, empty without one."""
    return F.when(F.contains(name, F.lit(":")), F.trim(F.substring_index(name, ":", 1))).otherwise("")


def run_tokens(name: Column) -> Column:
    """STR20: map of the key-value parts after the first colon; flags are 'true', slashes of the model '_'."""
    rest = F.when(F.contains(name, F.lit(":")), F.substring(name, F.instr(name, ":") + F.lit(1), F.length(name))).otherwise("")
    parts = F.filter(F.transform(F.split(rest, ","), strip), lambda p: p != "")
    pair = lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), strip(F.substring(p, F.instr(p, "=") + F.lit(1), F.length(p)))).otherwise("true").alias("v"))
    pairs = F.transform(F.transform(parts, pair), lambda s: F.struct(s["k"].alias("key"), F.when(s["k"] == "model", F.replace(s["v"], F.lit("/"), F.lit("_"))).otherwise(s["v"]).alias("value")))
    # The last of repeated keys counts.
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, s: F.map_concat(F.map_filter(m, lambda k, v: k != s["key"]), F.create_map(s["key"], s["value"])))


def metric_class(name: Column) -> Column:
    """STR21: core before bookkeeping, by prefix."""
    starts = lambda ps: reduce(Column.__or__, [F.startswith(name, F.lit(p)) for p in ps])
    return F.when(F.coalesce(name, F.lit("")) == "", "untracked").when(starts(CORE_METRICS), "core").when(starts(BOOKKEEPING_METRICS), "bookkeeping").otherwise("untracked")


def metric_family(name: Column) -> Column:
    """STR22."""
    out = F.when(F.coalesce(name, F.lit("")) == "", "?")
    for prefix, family in (("air_", "air"), ("bias_metric:", "bias_metric"), ("safety_", "safety"), ("bbq_", "bbq")):
        out = out.when(F.startswith(name, F.lit(prefix)), family)
    return out.when(F.contains(name, F.lit("@")), F.substring_index(name, "@", 1)).otherwise(F.substring_index(F.substring_index(name, "_", 1), ":", 1))


def stable_hash(c: Column, length: int = 16) -> Column:
    """A digest of a text; of nested values see ``ids``."""
    return F.substring(F.sha2(c, 256), 1, length)


def smart_truncate(c: Column, n: int) -> Column:
    """STR25: long text cut with a digest as tail; control characters replaced."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f]", "?")
    return F.when(F.length(clean) > n, F.concat(F.substring(clean, 1, n), F.lit("..."), stable_hash(clean, 8))).otherwise(clean)


def percent(c: Column, signed: bool = False) -> Column:
    """STR26: one decimal, an em dash for null."""
    return F.coalesce(F.format_string("%+.1f%%" if signed else "%.1f%%", c * 100), F.lit("—"))


def integer(c: Column) -> Column:
    return F.coalesce(c.cast("long").cast("string"), F.lit("—"))


def dataset_dispatch(dataset: Column) -> Column:
    """STR27: struct of template keys, evaluation verb and aggregate command of a dataset family."""
    crux, choice = dataset.isin("crux-i", "crux-o"), dataset.isin("gpqa", "mmlu")
    tail = F.when(crux, "_crux_input").when(choice, "_qa_mc").otherwise("")
    return F.struct(
        F.concat(F.lit("data/full_data/"), dataset, F.lit("/"), dataset, F.lit(".ds")).alias("data_path"),
        F.when(crux, "question_only_prompt").when(choice, "qa_mc_prompt").otherwise("qwen_math_prompt").alias("init"),
        *[F.concat(F.lit(k), tail).alias(a) for k, a in (("2f", "two"), ("1f", "one"), ("framing", "framing"))],
        F.when(crux, "crux").when(dataset == "24-game", "game_of_24").otherwise("math").alias("verb"),
        F.when(crux, "aggregate-crux").otherwise("aggregate").alias("aggregate"),
    )
