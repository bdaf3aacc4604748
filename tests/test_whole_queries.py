"""Queries over all rows and whole texts, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from statistics import fmean, pstdev

import pytest

from evalquarry.plans.registry import QUERIES


@pytest.fixture
def write(spark, tmp_path):
    def run(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return run


def test_texts_are_read_to_their_end(spark, write):
    late = "word " * 3000
    write("labels", [(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    at = write("documents", [(4, late + "</think> tail", "en", "s"), (5, late + "</think> end", "en", "s"), (6, late, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in QUERIES["thinking_split"](spark, at).collect()}
    assert got[4].final.startswith(" tail ") and got[5].final.startswith(" end ") and got[6].final.startswith(late)
    assert [got[k].status for k in (4, 5, 6)] == ["malformed_thinking", "parsable_thinking", "no_thinking"]
    share = {r.status: r.n for r in QUERIES["thinking_status_share"](spark, at).collect()}
    assert share == {"malformed_thinking": 1, "parsable_thinking": 1, "no_thinking": 1}
    assert {r.doc_id: r.boxed for r in QUERIES["boxed_answers"](spark, at).collect()} == {4: "\\frac{4}{2}", 5: "\\frac{0}{2}", 6: "\\frac{1}{2}"}


def test_stats_of_all_runs_are_joined(spark, write):
    rows = [(i, 30 + i % 21, "click", float(i), f'{{"k": {i // 4 % 6}}}') for i in range(400)]
    at = write("events", rows, "event_id long, user_id long, event_type string, value double, props string")
    got = {r.row_ord: (r.prompt, r.matched) for r in QUERIES["joined_instance_stats"](spark, at).collect()}
    key = lambda i: (30 + i % 21, i % 10, i % 3)
    states = {}
    for i in range(400):
        if i % 4:
            states.setdefault(key(i), {}).setdefault(i // 4 % 6 % 3, i)
    want = {}
    for i in range(400):
        mine = states.get(key(i), {})
        if i // 4 % 6 % 3 in mine:
            want[i] = (f"prompt {mine[i // 4 % 6 % 3]}", "exact")
        elif i // 4 % 6 % 3 == 0 and len(mine) == 1:
            want[i] = (f"prompt {next(iter(mine.values()))}", "fallback")
        else:
            want[i] = (None, "unmatched")
    assert got == want and len({m for _, m in want.values()}) == 3


#: Generations of each problem: quantity and return flag (A is right, R wrong).
GENS = {1: [(12, "A")], 2: [(7, "R"), (7, "R"), (9, "A")], 3: [(k % 3 + 1, "AR"[k % 3 > 0]) for k in range(7)], 4: [(5, "N"), (5, "A")]}


def generations(write):
    of = {1: "F", 2: "F", 3: "O", 4: "O"}
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    write("orders", [(k, of[k], "1") for k in GENS], "o_orderkey long, o_orderstatus string, o_orderpriority string")
    return of, write("lineitem", [(k, j, 1, j, float(q), 1.0, 0.0, 0.0, flag, "F", "d") for k, g in GENS.items() for j, (q, flag) in enumerate(g)], schema)


def majority(window):
    right = sum(f == "A" for _, f in window)
    if right * 2 > len(window) or not right:
        return float(right > 0)
    top, _ = Counter(q for q, _ in window).most_common(1)[0]
    return float([f for q, f in window if q == top][-1] == "A")


def test_curves_of_all_generations(spark, write):
    of, at = generations(write)
    for name, value in (("pass", lambda w: float(any(f == "A" for _, f in w))), ("maj", majority)):
        seen = defaultdict(lambda: defaultdict(list))
        for key, g in GENS.items():
            for k in range(1, len(g) + 1):
                for i in range(len(g)):
                    for source in (of[key], "overall"):
                        seen[source, k][i].append(value((g + g)[i : i + k]))
        means = {at_: [fmean(v) for v in x.values()] for at_, x in seen.items()}
        got = {(r.source, r.k): (r[f"{name}_at_k"], r[f"std_{name}_at_k"]) for r in QUERIES[f"{name}_at_k_by_source"](spark, at).collect()}
        assert got == {x: (pytest.approx(fmean(m), abs=2e-6), pytest.approx(pstdev(m), abs=2e-6)) for x, m in means.items()}
        assert max(k for _, k in got) == 7


def test_samples_of_all_generations(spark, write):
    _, at = generations(write)
    drawn = defaultdict(list)
    for r in QUERIES["sample_both_pools"](spark, at).collect():
        drawn[r.id].append((r.draft_no, r.response_id))
    for key, g in GENS.items():
        order = sorted(range(len(g)), key=lambda j: (hashlib.md5(f"42:{key}:{j}".encode()).hexdigest(), j))
        assert sorted(drawn.get(key, [])) == ([(1, order[0]), (2, order[1])] if len(g) > 1 else [])


def test_all_generations_are_verified(spark, write):
    _, at = generations(write)
    rows = {(k, j): q for k, g in GENS.items() for j, (q, _) in enumerate(g)}
    equal = {(r.id, r.response_id): r.equal for r in QUERIES["equivalent_answers"](spark, at).collect()}
    assert equal == {x: q % 5 == 0 for x, q in rows.items()} and any(v for (_, j), v in equal.items() if j)
    solved = {(r.id, r.response_id): r.solved for r in QUERIES["game_of_24"](spark, at).collect()}
    assert solved == {x: q == 12 for x, q in rows.items()}
