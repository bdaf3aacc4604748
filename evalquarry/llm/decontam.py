"""Benchmark decontamination by templates.

Texts become canonical tokens: numbers, names and units turn into typed placeholders whose values
are kept as slots, other words are lower-cased. Windows of canonical tokens of the benchmark items
are a table of hashes. Documents probe a bounded filter of these hashes with all their windows; what
passes is hash-joined with the table, which gives pairs of a document and an item. For an item with
enough of its windows inside one stretch of a document, the two are aligned and the values of aligned
slots compared: a copy has equal values, a re-parameterised question maps each value of the item to
one value of the document. Short items make windows of their own length; items of hardly anything
but values are found as copies only.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalquarry.llm.common import bit_filter, materialise, packed, passes, portions, table, tidied
from evalquarry.llm.hashing import Substrings, mix

WINDOW = 8
LITERALS = 4
COVERAGE = 0.2
CONSISTENT = 0.8
#: Words in a row that are a copy whatever their share of an item.
RUN_WORDS = 50
#: Parts into which the items that one document may hold are dealt.
PARTS = 4
# Units of measure and number words.
UNITS = "km m cm mm kg g mg lb lbs oz mile miles meter meters metre metres foot feet inch inches hour hours minute minutes second seconds day days week weeks month months year years dollar dollars cent cents euro euros percent l ml liter liters litre litres mph kmh".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
NUM, NAME, UNIT = (mix(np.array([k], np.uint64), 501)[0] for k in range(3))
_U = np.uint64
OTHER, LETTER, DIGIT, END, COMMA = range(5)
#: Code points whose class and lower case are in tables; those above are looked up one by one.
TABLED = 1 << 16


def _class(c: str) -> int:
    return END if c in ".!?\n" else COMMA if c == "," else DIGIT if c.isdecimal() else LETTER if c.isalnum() else OTHER


def _lower(k: int) -> int:
    return ord(chr(k).lower()[0])


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, whether it is a capital, and the hash of its first lower-case code point, for every code point below TABLED."""
    low = np.array([_lower(k) for k in range(TABLED)], np.uint64)
    return np.array([_class(chr(k)) for k in range(TABLED)], np.uint8), low != np.arange(TABLED), mix(low, 100)


def classified(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a text, their classes, which are capitals, and the hashes of their lower case."""
    kinds, capitals, hashes = tables()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp) or cp.max() < TABLED:
        return cp, kinds[cp], capitals[cp], hashes[cp]
    at = np.minimum(cp, TABLED - 1)
    kind, capital, h = kinds[at], capitals[at], hashes[at]
    for k in np.flatnonzero(cp >= TABLED).tolist():
        low = _lower(cp[k])
        kind[k], capital[k], h[k] = _class(chr(cp[k])), low != cp[k], mix(np.array([low], _U), 100)[0]
    return cp, kind, capital, h


@lru_cache(1)
def vocabulary() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of number words and of units."""
    return tuple(np.sort(np.array([word_hash(w) for w in ws], _U)) for ws in (NUMBER_WORDS, UNITS))


def word_hash(word: str) -> int:
    h = classified(word)[3]
    return int(Substrings(h)(np.array([0]), np.array([len(h)]))[0])


def among(h: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


@dataclass
class Parsed:
    """Canonical tokens as hashes, which are slots, their values, numbers of words and places in the text; all words as they are, and their places."""

    tokens: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    words: np.ndarray
    place: np.ndarray
    every: np.ndarray
    every_place: np.ndarray


def parsed(text: str) -> Parsed:
    """Tokens are runs of letters, numbers with points or commas inside, and single sentence marks, which are no canonical tokens.

    A capitalised word inside a sentence is a name, names in a row are one; a unit is one only after
    a number. Nothing is carried over a line feed, so texts can be parsed together, joined by it.
    """
    cp, kind, capital, low = classified(text)
    inner = np.flatnonzero((kind[1:-1] == COMMA) | (cp[1:-1] == 46)) + 1
    kind[inner[(kind[inner - 1] == DIGIT) & (kind[inner + 1] == DIGIT)]] = DIGIT
    kind[kind == COMMA] = OTHER
    fresh = np.ones(len(kind), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(kind))
    some = kind[start] != OTHER
    start, end = start[some], end[some]
    k = kind[start]
    every = Substrings(low)(start, end) if len(start) else np.empty(0, _U)
    word = k == LETTER
    numbers, units = vocabulary()
    number = (k == DIGIT) | (word & among(every, numbers))
    capital = word & capital[start]
    before_end = np.ones(len(k), bool)
    before_end[1:] = k[:-1] == END
    after_number = np.zeros(len(k), bool)
    after_number[1:] = number[:-1]
    unit = word & ~number & after_number & among(every, units)
    name = capital & ~number & ~unit & ~before_end
    more = np.zeros(len(k), bool)
    more[1:] = name[1:] & name[:-1]
    h = every.copy()
    for mask, t in ((number, NUM), (name, NAME), (unit, UNIT)):
        h[mask] = t
    real = k != END
    every, h, more, slot, start = every[real], h[real], more[real], (number | name | unit)[real], start[real]
    first = np.flatnonzero(~more)
    size = np.diff(np.append(first, len(every)))
    step = np.arange(len(every)) - np.repeat(first, size)
    value = np.add.reduceat(mix(every + step.astype(_U) * _U(0xD1342543DE82EF95), 502), first) if len(first) else every
    return Parsed(h[first], slot[first], value, size, start[first], every, start)


def windows(h: np.ndarray, slot: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of each window of ``size`` tokens; 0 where too few of them are words."""
    n = len(h)
    if not 0 < size <= n:
        return np.empty(0, _U)
    out = np.full(n - size + 1, size, _U)
    for j in range(size):
        out = (out ^ (out >> _U(29))) * _U(0x9FB21C651E98DF25) + h[j : n - size + 1 + j]
    out = mix(out, 500)
    sums = np.concatenate([[0], np.cumsum(~slot)])
    out[sums[size:] - sums[:-size] < min(LITERALS, size)] = 0
    return out


def starts(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, whatever they are."""
    return mix(windows(words, np.zeros(len(words), bool), size), 503)


class Item:
    """One benchmark item: its windows, and, without a window behind its first word, its words."""

    def __init__(self, text: str, often: dict[int, int] | None = None) -> None:
        """``often``: how many items of the benchmark have a window; without it, each counts as the item's own."""
        p = self.parsed = parsed(text)
        n = len(p.tokens)
        self.size = min(WINDOW, n)
        self.hashes = windows(p.tokens, p.slot, self.size)
        self.total = len(np.unique(self.hashes[self.hashes != 0]))
        self.long = int(p.words.sum()) >= RUN_WORDS
        # The first word may be a name by what stands before it, so a window that starts with it does not find every copy.
        self.whole = bool(len(p.every)) and not self.hashes[1:].any()
        self.at = defaultdict(list)
        for p_, h in enumerate(self.hashes.tolist()):
            if h:
                self.at[h].append(p_)
        # A window that many items have, as of a preamble, tells little of one of them.
        self.weight = {h: 1.0 / (often or {}).get(h, 1) for h in self.at}
        self.need = COVERAGE * sum(self.weight.values()) * (1 - 1e-9)

    def keys(self) -> list[tuple[int, int, int]]:
        """(kind, size, hash) of all that a document may share with the item: 0 for windows, 1 for first words."""
        size = min(WINDOW, len(self.parsed.every))
        whole = [(1, size, int(starts(self.parsed.every[:size], size)[0]))] if self.whole else []
        return whole + [(0, self.size, h) for h in self.at]

    def gain(self, pairs: list[tuple[int, int]]) -> tuple[int, float]:
        """Different windows among matches, and their weight."""
        hs = {int(self.hashes[p]) for _, p in pairs}
        return len(hs), sum(self.weight[h] for h in hs)


def shared_keys(texts: list[str], sizes: list[tuple[int, int]], filter_: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(text number, different hashes) of the texts with windows that pass the filter; the texts are parsed in one go."""
    p = parsed("\n".join(texts))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    of = np.searchsorted(begin, p.place, "right") - 1
    every_of = np.searchsorted(begin, p.every_place, "right") - 1
    at, hits = [], []
    for kind, size in sizes:
        w, doc = (starts(p.every, size), every_of) if kind else (windows(p.tokens, p.slot, size), of)
        found = passes(filter_, w)
        found = found[(doc[found] == doc[found + size - 1]) & (w[found] != 0)]
        at.append(doc[found])
        hits.append(w[found])
    at, hits = np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*hits, np.empty(0, _U)])
    order = np.argsort(at, kind="stable")
    at, hits = at[order], hits[order]
    cut = np.flatnonzero(np.diff(at)) + 1
    return [(int(a[0]), np.unique(h)) for a, h in zip(np.split(at, cut), np.split(hits, cut)) if len(a)]


class Document:
    """A parsed text with its windows of each size, made when they are asked for."""

    def __init__(self, text: str) -> None:
        self.parsed = parsed(text)
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def keys(self, kind: int, size: int) -> np.ndarray:
        if (kind, size) not in self.made:
            p = self.parsed
            self.made[kind, size] = starts(p.every, size) if kind else windows(p.tokens, p.slot, size)
        return self.made[kind, size]

    def holds(self, words: np.ndarray) -> bool:
        """Whether these words stand in the text in a row."""
        size = min(WINDOW, len(words))
        first = starts(words[:size], size)[0]
        return any(np.array_equal(self.parsed.every[d : d + len(words)], words) for d in np.flatnonzero(self.keys(1, size) == first).tolist())

    def match(self, item: Item) -> dict | None:
        """What is found of an item: None, a copy, or a re-parameterised one."""
        if item.whole and self.holds(item.parsed.every):
            n = max(1, item.total)
            return {"matched": n, "windows": n, "slots": int(item.parsed.slot.sum()), "consistency": 1.0, "kind": "verbatim"}
        w = self.keys(0, item.size)
        pairs = [(d, p) for d in np.flatnonzero(np.isin(w, np.fromiter(item.at, _U, len(item.at)))).tolist() for p in item.at[int(w[d])]] if item.at else []
        return judge(item, pairs, self.parsed) if pairs else None


def judge(item: Item, pairs: list[tuple[int, int]], doc: Parsed) -> dict | None:
    """The best result of an item: verbatim before re-parameterised, then most windows.

    Windows of one offset between document and item are a line. Every line with equal values
    counts. Else the lines with most windows, and of these with most equal values, come first, each
    also with what continues it before and behind; a line over windows that these have taken is a
    wrong alignment of the same words. RUN_WORDS equal words in a row always count.
    """
    if not item.long and item.gain(pairs)[1] < item.need:
        return None
    lines: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, p in sorted(pairs):
        lines[d - p].append((d, p))
    scored = [(*item.gain(line), *slots(item, line, doc), line) for line in lines.values()]
    best, taken = None, set()
    for n, weight, aligned, equal, share, line in sorted(scored, key=lambda x: (-x[0], -x[3], x[5][0])):
        found = [(n, weight, aligned, equal, share)]
        fresh = 2 * sum(d in taken for d, _ in line) <= len(line)
        if fresh and n < item.total:
            chain = chained(item, line, pairs)
            if len(chain) > len(line):
                found.append((*item.gain(chain), *slots(item, chain, doc)))
        for n, weight, aligned, equal, share in found:
            if weight >= item.need and (equal == aligned or (fresh and share >= CONSISTENT)) and (best is None or (equal == aligned, n) > best[:2]):
                best = (equal == aligned, n, aligned, share)
        if item.long and (best is None or not best[0]):
            for a, b in equal_runs(item, line[0][0] - line[0][1], doc):
                part = [(d, p) for d, p in line if a <= p and p + item.size <= b]
                copy = (True, item.gain(part)[0], int(item.parsed.slot[a:b].sum()), 1.0)
                best = copy if best is None or copy[:2] > best[:2] else best
        if best and best[:2] == (True, item.total):
            break
        taken.update(d for d, _ in line)
    return best and {"matched": best[1], "windows": item.total, "slots": best[2], "consistency": best[3], "kind": "verbatim" if best[0] else "reparameterised"}


def equal_runs(item: Item, offset: int, doc: Parsed) -> list[tuple[int, int]]:
    """Where, at this offset of the document, RUN_WORDS or more words of an item are equal in a row."""
    own = item.parsed
    first, stop = max(0, -offset), min(len(own.value), len(doc.value) - offset)
    if stop <= first:
        return []
    equal = np.concatenate([[False], own.value[first:stop] == doc.value[first + offset : stop + offset], [False]])
    edge = np.flatnonzero(equal[1:] != equal[:-1])
    return [(a + first, b + first) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if own.words[a + first : b + first].sum() >= RUN_WORDS]


def chained(item: Item, line: list[tuple[int, int]], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A line and the longest rising runs of matches before and behind it, in a stretch of twice the item's length."""
    reach = 2 * max(WINDOW, len(item.parsed.tokens))
    (d, p), (e, q) = line[0], line[-1]
    before = rising([x for x in pairs if e - reach <= x[0] < d and x[1] < p])
    start = before[0][0] if before else d
    return before + line + rising([x for x in pairs if e < x[0] <= start + reach and x[1] > q])


def slots(item: Item, pairs: list[tuple[int, int]], doc: Parsed) -> tuple[int, int, float]:
    """Aligned slots, those with equal values, and the share that one mapping of values explains."""
    own = item.parsed
    aligned = {(d + j, p + j) for d, p in pairs for j in range(min(item.size, len(own.tokens) - p)) if own.slot[p + j] and doc.slot[d + j]}
    if not aligned:
        return 0, 0, 1.0
    to = defaultdict(Counter)
    for d, p in aligned:
        to[int(own.tokens[p]), int(own.value[p])][int(doc.value[d])] += 1
    return len(aligned), sum(doc.value[d] == own.value[p] for d, p in aligned), sum(c.most_common(1)[0][1] for c in to.values()) / len(aligned)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs in which both numbers grow."""
    order = sorted(pairs, key=lambda x: (x[0], -x[1]))
    ends: list[int] = []
    at: list[int] = []
    links = []
    for j, (_, p) in enumerate(order):
        k = bisect_left(ends, p)
        links.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [p], [j]
    out, j = [], at[-1] if at else -1
    while j >= 0:
        out.append(order[j])
        j = links[j]
    return out[::-1]


KEYS = "item long, kind int, size int, h long, long boolean"
FOUND = "item_id long, matched int, windows int, slots int, consistency double, kind string"


def key_table(items: DataFrame) -> DataFrame:
    """The window table: one row per item (xxhash64 of id and text) and different key; items come as (item, t)."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("item", "kind", "size", "h", "long")}
            for item, t in zip(b.column("item").to_pylist(), b.column("t").to_pylist()):
                x = Item(t)
                for kind, size, h in x.keys():
                    for name, v in zip(out, (item, kind, size, int(np.uint64(h).view(np.int64)), x.long)):
                        out[name].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return items.mapInArrow(tidied(run), KEYS)


def counted_keys(keys: DataFrame) -> DataFrame:
    """The window table with the number of items that have each key."""
    return keys.join(keys.groupBy("kind", "size", "h").agg(F.count(F.lit(1)).alias("often")), ["kind", "size", "h"])


def telling_keys(keys: DataFrame) -> DataFrame:
    """The keys without the lightest ones of each item, whose weights together don't reach COVERAGE: any match has one of the others.

    So a window that many items share, as of a preamble, pairs no document with all of them.
    """
    weight = F.when(F.col("kind") == 0, 1 / F.col("often")).otherwise(0.0)
    lighter = F.sum(weight).over(W.partitionBy("item").orderBy(F.desc("often"), "h").rowsBetween(W.unboundedPreceding, W.currentRow))
    every = F.sum(weight).over(W.partitionBy("item"))
    ranked = keys.select("*", lighter.alias("lighter"), every.alias("every"))
    return ranked.where((F.col("kind") == 1) | F.col("long") | (F.col("lighter") >= COVERAGE * (1 - 1e-6) * F.col("every"))).select("item", "kind", "size", "h")


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc struct of all columns or of ``keep``, item_id, matched, windows, slots, consistency, kind) per document and item.

    An item counts if COVERAGE of its windows, each weighted by one over the number of items that have
    it, lie on one alignment with the document and one mapping of slot values explains CONSISTENT of the
    aligned slots, or if RUN_WORDS of its words in a row are in the document (one window of words among
    them); the best of several alignments is given, and of an item
    that fits in several places the best one. The benchmark stays in tables; the driver and each
    worker hold a bounded filter of it. Null and empty texts and items match nothing; an item of a
    word or two matches wherever they stand; repeated items and documents each give their rows.
    """
    items = benchmark.select(benchmark[item].cast("long").alias("item_id"), benchmark[item_text].alias("t")).where("t IS NOT NULL")
    items = materialise(items.groupBy("item_id", "t").agg(F.count(F.lit(1)).alias("times")).withColumn("item", F.xxhash64("item_id", "t")), "items")
    counted = materialise(counted_keys(key_table(items.select("item", "t"))), "windows")
    keys = materialise(telling_keys(counted), "keys")
    often = counted.where("kind = 0").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("h", "often"))).alias("often"))
    items = materialise(items.join(often, "item", "left"), "items")
    filter_ = bit_filter(keys, "h")
    sizes = sorted((r["kind"], r["size"]) for r in keys.select("kind", "size").distinct().collect())
    rows, texts_of = packed(docs, text, keep)
    names = rows.columns

    def probe(batches):
        mark, n = uuid.uuid4().hex, 0
        for b in batches:
            at, hits, texts = [], [], [t or "" for t in texts_of(b)]
            for lo, hi in portions(texts):
                for k, h in shared_keys(texts[lo:hi], sizes, filter_):
                    at.append(lo + k)
                    hits.append(h.view(np.int64))
            uid = pa.array([f"{mark}-{n + j}" for j in range(len(at))], pa.string())
            n += len(at)
            taken = [b.column(c).take(pa.array(at, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*taken, uid, pa.array(hits, pa.list_(pa.int64()))], names=[*names, "uid", "hits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    # Numbers of rows hold for one attempt of a task, so they are written before they are used.
    candidates = materialise(rows.mapInArrow(tidied(probe), f"{kinds}, uid string, hits array<bigint>"), "candidates")
    pairs = candidates.select("uid", F.explode("hits").alias("h")).join(keys.select("h", "item"), "h").select("uid", "item").distinct()
    asked = pairs.join(items, "item").groupBy("uid", F.pmod("item", F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item", "item_id", "t", "times", "often")).alias("asked")).drop("part")
    both = candidates.drop("hits").join(asked, "uid").drop("uid")

    def settle(batches):
        known: dict[int, Item] = {}
        for b in batches:
            at, out = [], []
            for k, (t, asked) in enumerate(zip(texts_of(b), b.column("asked").to_pylist())):
                doc = Document(t)
                for x in asked:
                    if len(known) > 1000:
                        known.clear()
                    if (own := known.get(x["item"])) is None:
                        own = known[x["item"]] = Item(x["t"], {h & (1 << 64) - 1: n for h, n in x["often"] or ()})
                    if found := doc.match(own):
                        at += [k] * x["times"]
                        out += [found | {"item_id": x["item_id"]}] * x["times"]
            cols = [pa.array([x[c] for x in out], kind) for c, kind in (("item_id", pa.int64()), ("matched", pa.int32()), ("windows", pa.int32()), ("slots", pa.int32()), ("consistency", pa.float64()), ("kind", pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at, pa.int64())), *cols], names=["doc", "item_id", "matched", "windows", "slots", "consistency", "kind"])

    return both.select(*names, "asked").mapInArrow(tidied(settle), f"doc {rows.schema['doc'].dataType.simpleString()}, {FOUND}")


def op1_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that the whole texts of documents hold, verbatim or re-parameterised."""
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), keep=["doc_id"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), "item_id", "matched", "windows", "slots", F.round("consistency", 6).alias("consistency"), "kind")
