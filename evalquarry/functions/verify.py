"""Answer verification and distances that built-in expressions cannot give, in Arrow batches."""

from __future__ import annotations

import ast
import re
import subprocess
import sys
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalquarry.functions import algebra

#: Pairs of answers that a worker remembers.
REMEMBERED = 1 << 14
_same = lru_cache(REMEMBERED)(algebra.same)


def rational(text: str) -> Fraction:
    """Value of an arithmetic expression in infix or simple LaTeX; raises ValueError beyond that."""
    try:
        return algebra.exact(algebra.parsed(text), {})
    except ZeroDivisionError as e:
        raise ValueError(str(e)) from None


def equivalent(a: str | None, b: str | None) -> bool:
    """MTH1, MTH2: equal as text, else as numbers, expressions, tuples, sets, intervals; long answers as text alone."""
    if a is None or b is None:
        return a is None and b is None
    return a.strip() == b.strip() or (len(a) <= algebra.LONGEST and len(b) <= algebra.LONGEST and _same(a, b))


def correct_24(answer: str | None, truth: list[int] | None) -> bool | None:
    """MTH3: the left side makes 24 from exactly the given numbers."""
    if truth is None or answer is None:
        return None
    s = answer.replace("×", "*").replace("÷", "/").replace(" ", "").split("=")[0].strip()
    used = sorted(float(n) for n in re.findall(r"\d+(?:\.\d+)?", s))
    return used == sorted(float(n) for n in truth) and equivalent(s, "24")


def tree(text: str):
    """(label, children) of an expression's syntax tree."""

    def walk(n):
        if isinstance(n, ast.BinOp):
            return type(n.op).__name__, [walk(n.left), walk(n.right)]
        if isinstance(n, ast.UnaryOp):
            return type(n.op).__name__, [walk(n.operand)]
        if isinstance(n, ast.Constant):
            return str(n.value), []
        if isinstance(n, ast.Name):
            return n.id, []
        raise ValueError(f"no arithmetic: {type(n).__name__}")

    try:
        return walk(ast.parse(text, mode="eval").body)
    except SyntaxError:
        raise ValueError(f"no expression: {text}") from None


def tree_distance(a, b) -> int:
    """MTH7: ordered tree edit distance with unit costs, over keyroots."""

    def order(t):
        labels, first, roots = [], [], {}

        def visit(n):
            own = None
            for c in n[1]:
                f = visit(c)
                own = f if own is None else own
            labels.append(n[0])
            first.append(len(labels) - 1 if own is None else own)
            return first[-1]

        visit(t)
        for i, f in enumerate(first):
            roots[f] = i
        return labels, first, sorted(roots.values())

    la, fa, ra = order(a)
    lb, fb, rb = order(b)
    d = [[0] * len(lb) for _ in la]
    for i in ra:
        for j in rb:
            m, n, p, q = i - fa[i] + 2, j - fb[j] + 2, fa[i] - 1, fb[j] - 1
            g = [[x + y if not x or not y else 0 for y in range(n)] for x in range(m)]
            for x in range(1, m):
                for y in range(1, n):
                    u, v = x + p, y + q
                    step = min(g[x - 1][y], g[x][y - 1]) + 1
                    if fa[u] == fa[i] and fb[v] == fb[j]:
                        g[x][y] = d[u][v] = min(step, g[x - 1][y - 1] + (la[u] != lb[v]))
                    else:
                        g[x][y] = min(step, g[fa[u] - 1 - p][fb[v] - 1 - q] + d[u][v])
    return d[-1][-1]


@F.pandas_udf(T.BooleanType())
def equivalent_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``equivalent`` of two columns; the guards run here too, so nulls and long answers cost nothing."""
    none = lambda x: None if pd.isna(x) else x
    return pd.Series([equivalent(none(x), none(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.BooleanType())
def correct_24_udf(a: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([correct_24(None if pd.isna(x) else x, None if t is None else list(t)) for x, t in zip(a, truth)], dtype=object)


@F.pandas_udf(T.DoubleType())
def tree_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where an expression does not parse."""

    def one(x, y):
        try:
            return float(tree_distance(tree(x), tree(y)))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def parses(a: pd.Series) -> pd.Series:
    """STR11, STR16: whether an expression is arithmetic."""

    def ok(x):
        try:
            return tree(x) is not None
        except (ValueError, TypeError):
            return False

    return pd.Series([ok(x) for x in a])


def operations(text: str) -> list[tuple[str, str, str]]:
    """STR16: (operator, left, right) in the order of evaluation; operands are numbers or #step."""
    out: list[tuple[str, str, str]] = []
    signs = {"Add": "+", "Sub": "-", "Mult": "*", "Div": "/"}

    def walk(n):
        label, kids = n
        if len(kids) == 2:
            a, b = walk(kids[0]), walk(kids[1])
            out.append((signs.get(label, label), a, b))
            return f"#{len(out)}"
        return label if not kids else f"-{walk(kids[0])}"

    walk(tree(text))
    return out


def majority(answers: list[str | None], correct: list[bool | None], same=equivalent) -> bool:
    """AGG3 over one window: greedy clusters under ``same``; the tie goes to the earliest representative."""
    right = sum(c is True for c in correct)
    if right > len(correct) / 2:
        return True
    if not right:
        return False
    heads, counts, last = [], [], {}
    for a, c in zip(answers, correct):
        last[a] = c
        for k, h in enumerate(heads):
            if same(a, h):
                counts[k] += 1
                break
        else:
            heads.append(a)
            counts.append(1)
    return last[heads[counts.index(max(counts))]] is True


def levenshtein(a: Column, b: Column) -> Column:
    """MTH6: built in, on texts without spaces."""
    return F.levenshtein(F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))).cast("double")


def distance(a: Column, b: Column, metric: str) -> Column:
    """MTH6 to MTH8: levenshtein, tree, or binary (1 if equivalent: a similarity)."""
    if metric == "levenshtein":
        return levenshtein(a, b)
    if metric == "tree":
        return tree_distance_udf(a, b)
    if metric == "binary":
        return equivalent_udf(a, b).cast("double")
    raise ValueError(f"unknown metric: {metric}")


_GUARD = "import resource;resource.setrlimit(resource.RLIMIT_CPU,({t},{t}));resource.setrlimit(resource.RLIMIT_AS,(1<<30,1<<30));resource.setrlimit(resource.RLIMIT_FSIZE,(0,0));resource.setrlimit(resource.RLIMIT_NPROC,(0,0));import os,shutil,builtins;os.system=os.kill=os.remove=os.fork=shutil.rmtree=builtins.input=None\n"


def run_check(code: str, guess: str, expected: str, seconds: int = 3) -> bool:
    """MTH4, MTH5: whether ``assert guess == expected`` holds after ``code``, in a limited child process.

    Limits are no sandbox: callers opt in by calling this, no query does.
    """
    program = _GUARD.format(t=seconds) + code + f"\nassert {expected} == {guess}\n"
    try:
        return subprocess.run([sys.executable, "-I", "-S", "-c", program], capture_output=True, timeout=seconds + 2).returncode == 0
    except subprocess.TimeoutExpired:
        return False


def execution_verifier(code: Column, guess: Column, expected: Column, allow: bool = False) -> Column:
    """MTH4 as a column; raises unless ``allow`` is set, since it runs code of the data."""
    if not allow:
        raise PermissionError("running code from data needs allow=True")

    @F.pandas_udf("boolean")
    def check(c: pd.Series, g: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([run_check(*x) for x in zip(c, g, e)])

    return check(code, guess, expected)


VERIFIERS = {"math": equivalent_udf, "game_of_24": correct_24_udf, "crux": execution_verifier}


def verified_by_task(task: Column, answer: Column, truth: Column, *, numbers: Column | None = None, code: Column | None = None, allow: bool = False) -> Column:
    """UDF1, ARR4: the verifier that a row's task names.

    ``numbers`` are the given ones of game_of_24, ``code`` the program of crux; a row whose task has
    no verifier, or lacks its column, is null.
    """
    out = F.when(task == "math", equivalent_udf(answer, truth))
    if numbers is not None:
        out = out.when(task == "game_of_24", correct_24_udf(answer, numbers))
    if code is not None:
        out = out.when(task == "crux", execution_verifier(code, answer, truth, allow))
    return out


def safe_ratio(num: Column, den: Column) -> Column:
    """MTH10: null for a denominator of zero or less."""
    return F.when(den > 0, num.cast("double") / den)


def safe_double(c: Column) -> Column:
    """MTH11: null for text that is no number and for NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_long(c: Column) -> Column:
    """MTH11: whole numbers alone."""
    x = safe_double(c)
    return F.when(x == F.floor(x), x.cast("long"))


def sum_squared(given: Column, value: Column) -> Column:
    """MTH12."""
    return F.coalesce(given, value * value)
