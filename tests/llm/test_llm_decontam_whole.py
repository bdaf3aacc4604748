"""Whole benchmark items of all kinds in documents: repeating, short, and several to a document."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from evalquarry.llm import decontam

PROSE = " ".join(f"{a}{b}" for a in ("ba", "ko", "ti", "re", "lu", "sa") for b in ("mi", "ta", "ro", "ne", "di", "su", "pe"))
PARALLEL = "on Monday the shop sold 12 red apples to the school on Tuesday the shop sold 15 red apples to the school on Friday the shop sold 9 red apples to the school"


def match(item, text):
    return decontam.Document(text).match(decontam.Item(item))


def kinds(items, text):
    return {k: x["kind"] for k, i in enumerate(items) if (x := match(i, text))}


def test_copy_of_an_item_that_repeats_its_own_template():
    got = match(PARALLEL, f"{PROSE} {PARALLEL} {PROSE}")
    assert (got["kind"], got["consistency"], got["matched"]) == ("verbatim", 1.0, got["windows"])
    changed = PARALLEL.replace("12", "31").replace("15", "44").replace("9", "8")
    assert kinds([PARALLEL], f"{PROSE} {changed} {PROSE}") == {0: "reparameterised"}
    second = "on Tuesday the shop sold 15 red apples to the school"
    assert kinds([PARALLEL], f"{PROSE} {second} {PROSE}") == {0: "verbatim"}


def test_edited_copy_is_one_chain_of_alignments():
    words = PROSE.split()[:40]
    edited = " ".join(words[:12] + ["extra"] + words[12:24] + words[25:])
    got = match(" ".join(words), edited)
    assert got["kind"] == "verbatim" and got["matched"] > 15


def test_short_items_and_items_of_values():
    short, values, tiny = "What is the capital of France?", "Anna 12 Bob 13 Carl 14 Dora 15 Emil 16 Fred 17", "Who is Anna Smith?"
    items = [short, values, tiny, "", "?!"]
    assert kinds(items, f"{PROSE}. {short} {PROSE}") == {0: "verbatim"}
    assert kinds(items, f"{PROSE} Question: {short} {PROSE}") == {0: "verbatim"}
    assert kinds(items, f"{PROSE}. What is the capital of Spain? {PROSE}") == {0: "reparameterised"}
    assert kinds(items, f"{PROSE} {values} {PROSE}. {tiny} {PROSE}") == {1: "verbatim", 2: "verbatim"}
    assert kinds(items, f"{PROSE} {values.replace('17', '18')} {PROSE}") == {} and kinds(items, PROSE) == {}
    assert kinds(items, short) == {0: "verbatim"} and kinds(items, "") == {} and kinds(["", "?!"], PROSE) == {}
    assert kinds([values], values + " " + values) == {0: "verbatim"}


def test_exact_copy_far_from_a_look_alike():
    item = "so the baker Alice gave bread to Alice and later Alice took cake from Alice while it was raining a lot outside"
    names = iter(["Ann", "Bea", "Cid", "Dot"])
    alike = " ".join(next(names) if w == "Alice" else w for w in item.split())
    variant = item.replace("Alice", "Ann")
    assert kinds([item], f"{alike} {PROSE} {PROSE}") == {}
    assert kinds([item], f"{variant} {PROSE} {PROSE}") == {0: "reparameterised"}
    for first in (alike, variant):
        assert kinds([item], f"{first} {PROSE} {PROSE} {item} {PROSE}") == {0: "verbatim"}


def test_long_run_of_a_longer_item():
    words = [a + b + c for a in ("ba", "ko", "ti", "re", "lu", "sa", "no") for b in ("mi", "ta", "ro", "ne", "di", "su", "pe") for c in ("x", "y", "z", "q", "v", "w", "k", "f")]
    item = " ".join(words[:380])
    got = match(item, f"{PROSE} {' '.join(words[100:160])} {PROSE}")
    assert (got["kind"], got["matched"], got["windows"]) == ("verbatim", 53, 373)
    assert kinds([item], f"{PROSE} {' '.join(words[100:149])} {PROSE}") == {}


def plain_tokens(text):
    """Canonical tokens by a regular expression, one word at a time."""
    units, numbers = set(decontam.UNITS), set(decontam.NUMBER_WORDS)
    out, opening, joins = [], True, False
    for t in re.findall(r"[.!?\n]|\d+(?:[.,]\d+)*|[^\W\d_]+", text):
        low = t.lower()
        if t in ".!?\n":
            opening, joins = True, False
            continue
        if t[0].isdecimal() or low in numbers:
            out.append(("<num>", low))
        elif low in units and out and out[-1][0] == "<num>" and not opening:
            out.append(("<unit>", low))
        elif t[0] != low[0] and not opening:
            if joins:
                out[-1] = ("<name>", out[-1][1] + " " + low)
            else:
                out.append(("<name>", low))
        else:
            out.append((low, low))
        opening, joins = False, out[-1][0] == "<name>"
    return out


def test_tokens_against_plain_ones():
    r = random.Random(3)
    pieces = ["Alice", "bob", "12", "3.5", "1,000", "km", "KM", "two", ".", "! ", "\n", ", ", " ", " ", " ", "é", "Éa", "½", "٣", "x_y", "\U0001d49c", "日本", "1.", ".5", "a1b"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(400)] + ["", " ", "1", ".", "1,2", ",1,"]
    seen = {}
    for t in texts:
        p, want = decontam.parsed(t), plain_tokens(t)
        assert p.slot.tolist() == [x[0] == "<" for x, _ in want] and p.words.tolist() == [v.count(" ") + 1 for _, v in want]
        for (token, value), h, v in zip(want, p.tokens.tolist(), p.value.tolist()):
            assert seen.setdefault(("t", token), h) == h and seen.setdefault(("v", value), v) == v
    assert len(set(seen.values())) == len(seen)
    whole = decontam.parsed("\n".join(texts))
    assert whole.tokens.tolist() == [h for t in texts for h in decontam.parsed(t).tokens.tolist()]


def test_leaks_against_all_pairs(spark):
    r = random.Random(8)
    words = [a + b for a in ("ba", "ko", "ti", "re") for b in ("mi", "ta", "ro", "ne", "di")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    preamble = "please read what is written below and then choose the one right answer"
    items = [f"{preamble} {prose(25)} 12 {prose(5)}" for _ in range(20)] + ["What is 17 mod 5?", "Compute 12 + 5 * 7 - 3 = ?", "Who?", prose(80), PARALLEL, "", None, items_twice := f"{prose(20)} Anna 5 km"]
    items.append(items_twice)
    texts = [None, "", preamble, *(f"{prose(30)} {i}. {prose(20)}" for i in items if i), *(f"{prose(9)} {i.replace('12', '77')}" for i in items[:5])]
    texts += [" ".join(i for i in items if i), f"{prose(10)} {prose(60)}", "\n".join([preamble] * 50), texts[4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.lit("x")).withColumn("hits", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((x.doc.doc_id, x.item_id, x.matched, x.kind) for x in decontam.leaks(docs, bench).collect())
    often = Counter(h for own in items if own for h in decontam.Item(own).at)
    docs_, items_ = {d: decontam.Document(t) for d, t in enumerate(texts) if t}, {i: decontam.Item(own, often) for i, own in enumerate(items) if own}
    want = sorted((d, i, m["matched"], m["kind"]) for d, t in docs_.items() for i, own in items_.items() if (m := t.match(own)))
    assert got == want and {20, 21, 22} <= {i for _, i, _, _ in got}
    # The preamble of twenty items alone is none of them.
    assert not {(d, i) for d, i, _, _ in got if d in (2, len(texts) - 2) and i < 20}
    slim = decontam.leaks(docs, bench, keep=["doc_id"]).collect()
    assert sorted((x.doc.doc_id, x.item_id, x.matched, x.kind) for x in slim) == want
