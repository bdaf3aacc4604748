"""Perturbations of instance texts, as built-in expressions that need no state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contractions and their long forms, and frequent misspellings.
CONTRACTIONS = {"it is": "it's", "do not": "don't", "does not": "doesn't", "can not": "can't", "is not": "isn't", "are not": "aren't", "I am": "I'm", "you are": "you're", "we are": "we're", "they are": "they're"}
MISSPELLINGS = {"the": "teh", "and": "adn", "because": "becuase", "their": "thier", "receive": "recieve", "which": "wich", "with": "wiht", "from": "form"}


def replaced(c: Column, words: dict[str, str]) -> Column:
    return reduce(lambda x, w: F.regexp_replace(x, rf"\b{w[0]}\b", w[1]), words.items(), c)


def some(c: Column, prob: float, seed: int, change) -> Column:
    """``change`` for a share of the words, chosen by a digest of seed, place and word: the same every time."""
    draw = lambda w, i: F.pmod(F.xxhash64(F.lit(seed), i, w), F.lit(1 << 20)) < int(prob * (1 << 20))
    return F.array_join(F.transform(F.split(c, " "), lambda w, i: F.when(draw(w, i), change(w)).otherwise(w)), " ")


def perturbation(name: str, prob: float = 1.0, seed: int = 0):
    """UDF8: a function of a text column, by name."""
    made = {
        "lowercase": F.lower,
        "uppercase": F.upper,
        "extra_space": lambda c: F.replace(c, F.lit(" "), F.lit("  ")),
        "contraction": lambda c: replaced(c, CONTRACTIONS),
        "expansion": lambda c: replaced(c, {v: k for k, v in CONTRACTIONS.items()}),
        "misspellings": lambda c: some(c, prob, seed, lambda w: reduce(lambda x, m: F.when(w == m[0], m[1]).otherwise(x), MISSPELLINGS.items(), w)),
        "typos": lambda c: some(c, prob, seed, lambda w: F.when(F.length(w) > 3, F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substring(w, F.lit(4), F.length(w)))).otherwise(w)),
    }
    if name not in made:
        raise KeyError(f"unknown perturbation {name}; there are {sorted(made)}")
    return made[name]


def perturbed(instances: DataFrame, specs: list[dict], text: str = "input") -> DataFrame:
    """UDF8: every instance under every perturbation, with the perturbation's name; one scan."""
    each = [F.struct(F.lit(s["name"]).alias("perturbation"), perturbation(**s)(F.col(text)).alias(text)) for s in specs]
    rest = [c for c in instances.columns if c != text]
    return instances.select(*rest, F.inline(F.array(*each)))
