"""Removal of byte strings that occur twice, by deep-shallow suffix sorting.

A string is looked at for LENGTH bytes; matches of LEAST bytes or more are found, those of LENGTH
go. In each window of WINDOW positions the least 8-gram hash marks an anchor, which depends on
nothing outside the LEAST bytes that start at the window, so equal strings have equal anchors, and
one suffix per anchor is sorted in place of one per position. The bytes after an anchor that all
its strings share give a print. It only deals anchors to buckets, and an anchor alone with its
print goes. Of anchors whose whole surroundings (their context) are equal one is sorted, with their
number. In a bucket the texts to the right of the anchors are sorted, and those to the left read
backwards: a multikey quicksort on 8-byte words to the depth SHALLOW, then a blind trie for each
group that still shares its prefix. Two strings at one distance before their anchors are equal if
both orders have them together to the depth that the string needs, as the lengths of common
prefixes of neighbours tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm.common import bit_filter, materialise, passes, table, text_of, tidied
from evalquarry.llm.hashing import Substrings

LENGTH = 400
#: Shortest match that is found; passages of it are reported from PASSAGE_WORDS words on.
LEAST = 256
PASSAGE_WORDS = 50
WINDOW = 160
GRAM = 8
SHALLOW = 32
#: Groups of so many suffixes go to a trie at any depth.
TRIE = 48
#: Contexts that are sorted together, on average, and the most that one print may bring (480 bytes each).
SORTED_CONTEXTS = 2000
PRINT_CONTEXTS = 32_768
#: Start positions of a text that are handled at a time, and bytes of contexts in one batch.
SEGMENT = 1 << 18
BATCH_BYTES = 4 << 20
_U = np.uint64


def anchors(data: bytes, length: int = LENGTH, least: int = LEAST, window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, first start, last start, print, context hash) of one text, in order, a segment at a time."""
    n = len(data)
    for base in range(0, n - least + 1, SEGMENT):
        starts = min(SEGMENT, n - least + 1 - base)
        part = data[base : base + starts - 1 + length]
        m = starts + window - 1
        grams = np.ndarray((m,), "<u8", part, strides=(1,))
        order = ((grams * _U(0x9FB21C651E98DF25)) >> _U(32) << _U(32)) | np.arange(m, dtype=_U)
        padded = np.full((-(-m // window) + 1) * window, np.iinfo(_U).max, _U)
        padded[:m] = order
        grid = padded.reshape(-1, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts]) & _U(0xFFFFFFFF)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        hi = np.append(lo[1:] - 1, starts - 1)
        a = at[lo]
        b = np.frombuffer(part, np.uint8)
        end = np.minimum(hi + length, len(part))
        # Where the text ends before the string does, the context differs by that.
        place = (((a - lo) * window + (hi - a + window)) * (length + 1) + (end - hi)).astype(_U)
        yield a + base, lo + base, hi + base, Substrings(b, 0)(a, a + (least - window + 1)), Substrings(b, 1)(lo, end) ^ (place * _U(0xD1342543DE82EF95))


class BlindTrie:
    """Order of byte strings of one length that share a prefix; nodes hold a depth and branches only."""

    def __init__(self, at, length: int) -> None:
        self.at, self.length, self.root = at, length, None

    def common(self, x: bytes, y: bytes) -> int:
        if x == y:
            return self.length
        d = int.from_bytes(x) ^ int.from_bytes(y)
        return self.length - (d.bit_length() + 7) // 8

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [self.length, [i]]
            return
        s, node = self.at(i), self.root
        while node[0] < self.length:  # blind: only the branching bytes are looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = self.common(s, self.at(node[1][0]))
        if depth == self.length:
            node[1].append(i)
            return
        node, up = self.root, None
        while node[0] <= depth:
            if node[0] == depth:
                node[1][s[depth]] = [self.length, [i]]
                return
            up, node = node, node[1][s[node[0]]]
        other = self.at(self.any_leaf(node))
        fork = [depth, {s[depth]: [self.length, [i]], other[depth]: node}]
        if up is None:
            self.root = fork
        else:
            up[1][s[up[0]]] = fork

    def any_leaf(self, node) -> int:
        while node[0] < self.length:
            node = next(iter(node[1].values()))
        return node[1][0]

    def groups(self) -> list[list[int]]:
        """Groups of equal strings in order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == self.length:
                out.append(node[1])
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(data: bytes, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> list[list[int]]:
    """Numbers of the suffixes at ``starts`` in order of their first ``length`` bytes; equal ones share a list."""
    words = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
    at = lambda i: data[starts[i] : starts[i] + length]
    out: list[list[int]] = []
    starts = starts.tolist()
    where = np.array(starts, np.int64)
    stack = [(np.arange(len(starts)), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out.append([int(group[0])])
        elif depth >= shallow or depth + 8 > length or len(group) <= TRIE:
            trie = BlindTrie(at, length)
            for i in group.tolist():
                trie.insert(i)
            out += trie.groups()
        else:
            key = words[where[group] + depth].astype(_U)
            pivot = np.partition(key, len(key) // 2)[len(key) // 2]
            less, more = key < pivot, key > pivot
            for part, d in ((group[more], depth), (group[~(less | more)], depth + 8), (group[less], depth)):
                if len(part):
                    stack.append((part, d))
    return out


def runs(p: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of sorted distinct numbers, ends included."""
    if not len(p):
        return []
    cut = np.flatnonzero(np.diff(p) > 1)
    return list(zip(p[np.concatenate([[0], cut + 1])].tolist(), p[np.append(cut, len(p) - 1)].tolist()))


def sorted_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row of a byte matrix, and for each rank the bytes that it shares with the rank before."""
    n, width = m.shape
    order = np.array([i for g in deep_shallow(m.tobytes(), np.arange(n) * width, width) for i in g], np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    differ = m[order[1:]] != m[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return rank, np.concatenate([[0], shared])


def repeats(bodies: list[bytes], anchor: np.ndarray, last: np.ndarray, number: np.ndarray, length: int, least: int, window: int) -> list[np.ndarray]:
    """For both lengths (rows, window): whether the string that starts so many bytes before a row's anchor occurs twice.

    A body starts at its first start; ``anchor`` and ``last`` are places in it, ``number`` the rows
    that it stands for. Bodies end at ``length`` bytes after their last start or with their text.
    """
    n = len(bodies)
    size = np.array([len(x) for x in bodies])
    room = size - anchor
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, -(-window // 8) * 8), np.uint8)
    for k, (x, a) in enumerate(zip(bodies, anchor.tolist())):
        row = np.frombuffer(x, np.uint8)
        tail = row[a : a + length]
        right[k, : len(tail)] = tail
        left[k, :a] = row[:a][::-1]
    (rank_r, shared_r), (rank_l, shared_l) = sorted_rows(right), sorted_rows(left)
    out = [np.zeros((n, window), bool), np.zeros((n, window), bool)]
    for back in range(window):
        here = (anchor - last <= back) & (back <= anchor)
        behind = np.cumsum(shared_l < back)[rank_l]
        for which, size_ in enumerate((least, length)):
            mine = np.flatnonzero(here & (room >= size_ - back))
            if len(mine):
                ahead = np.cumsum(shared_r < size_ - back)[rank_r[mine]]
                _, same = np.unique(ahead * (n + 1) + behind[mine], return_inverse=True)
                out[which][mine, back] = np.bincount(same, weights=number[mine])[same] > 1
    return out


REPEATS = "f long, c long, doc long, th long, a int, n long, long boolean, x int, y int"


def sort_bucket(bucket: pa.Table, length: int, least: int, window: int) -> pa.Table:
    """Runs of repeated strings in the contexts of a bucket: starts a-x to a-y, for both lengths."""
    bucket = bucket.combine_chunks()
    a, lo, hi, n = (bucket.column(c).to_numpy().astype(np.int64) for c in ("a", "lo", "hi", "n"))
    rows, out = [], []
    for which, hit in enumerate(repeats(bucket.column("bytes").to_pylist(), a - lo, hi - lo, n, length, least, window)):
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        k, y = np.nonzero(edge == 1)
        rows.append(k)
        out.append((np.full(len(k), which == 1), np.nonzero(edge == -1)[1] - 1, y))
    k = np.concatenate(rows)
    found = bucket.select(["f", "c", "doc", "th", "a", "n"]).take(pa.array(k))
    for j, (name, kind) in enumerate((("long", pa.bool_()), ("x", pa.int32()), ("y", pa.int32()))):
        found = found.append_column(name, pa.array(np.concatenate([o[j] for o in out]), kind))
    return found


def hashed_strings(batches, length: int, least: int):
    """The strings of contexts one by one, as hashes, for prints with too many contexts to sort."""
    for batch in batches:
        for k, body in enumerate(batch.column("bytes").to_pylist()):
            b = np.frombuffer(body, np.uint8)
            first = np.arange(batch.column("hi")[k].as_py() - batch.column("lo")[k].as_py() + 1)
            for long, size in ((False, least), (True, length)):
                p = first[first + size <= len(b)]
                if len(p):
                    h = [Substrings(b, w)(p, p + size).view(np.int64) for w in range(2)]
                    back = (batch.column("a")[k].as_py() - batch.column("lo")[k].as_py() - p).astype(np.int32)
                    own = batch.select(["f", "c", "doc", "th", "a", "n"]).take(pa.array(np.full(len(p), k)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(p), long)), pa.array(back), *(pa.array(x) for x in h)], names=[*own.schema.names, "long", "x", "h", "g"])


_zstd = zstandard.ZstdDecompressor()


def unzipped(z: bytes) -> bytes:
    return _zstd.decompress(z)


def zipped(rows: DataFrame, chosen: np.ndarray, inside: bool = True) -> DataFrame:
    """(row, doc, th, size, z): texts ``t`` compressed, of the rows whose ``th`` passes the filter, or of the others."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            mine = np.zeros(batch.num_rows, bool)
            mine[passes(chosen, batch.column("th").to_numpy().view(_U))] = True
            batch = batch.filter(pa.array(mine == inside))
            texts = [t.encode() for t in batch.column("t").to_pylist()]
            z, size = pa.array([squeeze.compress(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), batch.column("th"), size, z], names=["row", "doc", "th", "size", "z"])

    return rows.mapInArrow(tidied(run), f"row {rows.schema['row'].dataType.simpleString()}, doc long, th long, size long, z binary")


def repeated_starts(all_rows: DataFrame, *, length: int, least: int, window: int) -> DataFrame:
    """(doc, th, starts array<struct<long,s,e>>): runs of positions whose LEAST or ``length`` (long) bytes start elsewhere too.

    Rows have (row, doc, th, t).
    """
    rows = all_rows.select("doc", "th", F.col("t").cast("binary").alias("b")).where(F.octet_length("t") >= least)

    def mark(batches):
        for batch in batches:
            found, at = [], []
            for k, x in enumerate(batch.column("b").to_pylist()):
                for s in anchors(x, length, least, window):
                    found.append(s)
                    at.append(np.full(len(s[0]), k))
            if found:
                take = pa.array(np.concatenate(at))
                a, lo, hi, f, c = (np.concatenate([s[j] for s in found]) for j in range(5))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(take), batch.column("th").take(take), *(pa.array(x.astype(np.int32)) for x in (a, lo, hi)), *(pa.array(x.view(np.int64)) for x in (f, c))],
                    names=["doc", "th", "a", "lo", "hi", "f", "c"],
                )

    marked = rows.mapInArrow(tidied(mark), "doc long, th long, a int, lo int, hi int, f long, c long")
    twice = materialise(marked.groupBy("f").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("f"), "prints")
    live = materialise(marked.join(twice, "f"), "anchors")
    firsts = [F.first(x).alias(x) for x in ("doc", "th", "a", "lo", "hi")]
    contexts = materialise(live.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"), *firsts), "contexts")
    many = materialise(contexts.groupBy("f").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > PRINT_CONTEXTS).select("f", F.lit(True).alias("many")), "frequent")
    frequent = not many.isEmpty()
    contexts = contexts.join(many, "f", "left") if frequent else contexts.withColumn("many", F.lit(False))
    buckets = max(1, -(-contexts.count() // SORTED_CONTEXTS))
    by_doc = contexts.groupBy("doc", "th").agg(F.collect_list(F.struct("f", "c", "n", "a", "lo", "hi", F.coalesce("many", F.lit(False)).alias("many"))).alias("cs"))
    # Texts without a context stay where they are.
    texts = zipped(all_rows, bit_filter(contexts.select("th").distinct(), "th")).where(F.col("size") >= least).select("doc", "th", "z")
    bodies = by_doc.join(texts, by_doc["doc"].eqNullSafe(texts["doc"]) & (by_doc["th"] == texts["th"])).select(texts["doc"], texts["th"], "cs", "z")
    names = ["f", "c", "n", "a", "lo", "hi", "many"]
    schema = pa.schema([*zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())), ("doc", pa.int64()), ("th", pa.int64()), ("bytes", pa.binary())])

    def cut(batches):
        held, size, before = [], 0, None
        for batch in batches:
            for doc, th, cs, z in zip(*(batch.column(x) for x in ("doc", "th", "cs", "z"))):
                doc, th = doc.as_py(), th.as_py()
                if (doc, th) != before:  # rows that repeat a text under one id are cut once
                    before, b = (doc, th), unzipped(z.as_py())
                    for c in cs.as_py():
                        held.append(c | {"doc": doc, "th": th, "bytes": b[c["lo"] : c["hi"] + length]})
                        size += len(held[-1]["bytes"])
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    parts = bodies.mapInArrow(tidied(cut), "f long, c long, n long, a int, lo int, hi int, many boolean, doc long, th long, bytes binary")
    if frequent:
        parts = materialise(parts, "bodies")
    ends = parts.where(~F.col("many")).groupBy(F.pmod(F.xxhash64("f"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: sort_bucket(t, length, least, window), REPEATS)
    if frequent:
        # Too many for one call: the strings of these prints meet one by one, spread by their hashes.
        strings = materialise(parts.where("many").mapInArrow(tidied(lambda b: hashed_strings(b, length, least)), "f long, c long, doc long, th long, a int, n long, long boolean, x int, h long, g long"), "strings")
        equal = strings.groupBy("long", "h", "g").agg(F.sum("n").alias("k")).where("k > 1").drop("k")
        ends = ends.union(strings.join(equal, ["long", "h", "g"]).select("f", "c", "doc", "th", "a", "n", "long", "x", F.col("x").alias("y")))
    ends = materialise(ends, "repeats")
    starts = [F.col("long"), (F.col("a") - F.col("x")).alias("s"), (F.col("a") - F.col("y")).alias("e")]
    once = ends.where("n = 1").select("doc", "th", *starts)
    more = ends.where("n > 1").select("f", "c", "long", "x", "y")
    members = live.join(more, ["f", "c"]).select("doc", "th", *starts)
    return once.union(members).groupBy("doc", "th").agg(F.collect_set(F.struct("long", "s", "e")).alias("starts"))


def covered(size: int, starts: list[dict], width: int) -> np.ndarray:
    """Which bytes of a text the strings that start in these runs cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, [x["s"] for x in starts], 1)
    np.add.at(edge, [x["e"] + width for x in starts], -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """(doc struct of all columns or of ``keep``, n_bytes long, n_removed long, spans, passages, kept binary).

    Every byte covered by a string of ``length`` bytes that also starts elsewhere goes, in all its
    places; ``spans`` are these runs of bytes. ``passages`` are the runs covered by strings of
    ``least`` bytes that also start elsewhere, if they hold PASSAGE_WORDS words, removed or not. Null
    text is empty; texts shorter than ``least`` stay whole and have no passages; rows with equal
    texts are each other's copies, so repeated rows of at least ``length`` bytes lose everything. The
    kept bytes can break a character.
    """
    spans = "array<struct<start:long,end:long>>"
    rows = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"), docs[id].cast("long").alias("doc"), text_of(docs[text]).alias("t")).withColumn("th", F.xxhash64("t"))

    kind = rows.schema["row"].dataType.simpleString()
    found = materialise(repeated_starts(rows, length=length, least=least, window=window), "starts")
    # Only texts with a repeat (and the few others that the filter lets through) are moved to where their runs are.
    chosen = bit_filter(found.select("th").distinct(), "th")
    some, rest = zipped(rows, chosen), zipped(rows, chosen, inside=False)
    joined = some.join(found, some["doc"].eqNullSafe(found["doc"]) & (some["th"] == found["th"]), "left").select("row", "z", "starts")
    joined = joined.union(rest.select("row", "z", F.lit(None).cast(found.schema["starts"].dataType)))

    def apply(batches):
        for batch in batches:
            n, gone, cuts, passages, kept = [], [], [], [], []
            for z, starts in zip(batch.column("z"), batch.column("starts").to_pylist()):
                t, out, said = unzipped(z.as_py()), [], []
                if starts:
                    hit = covered(len(t), [x for x in starts if x["long"]], length)
                    out = [(s, e + 1) for s, e in runs(np.flatnonzero(hit))]
                    said = [(s, e + 1) for s, e in runs(np.flatnonzero(covered(len(t), [x for x in starts if not x["long"]], least)))]
                n.append(len(t))
                gone.append(sum(e - s for s, e in out))
                cuts.append([{"start": s, "end": e} for s, e in out])
                passages.append([{"start": s, "end": e} for s, e in said if len(t[s:e].split()) >= PASSAGE_WORDS])
                kept.append(np.frombuffer(t, np.uint8)[~hit].tobytes() if out else t)
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pairs), pa.array(passages, pairs), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "spans", "passages", "kept"],
            )

    return joined.mapInArrow(tidied(apply), f"doc {kind}, n_bytes long, n_removed long, spans {spans}, passages {spans}, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without the 400-byte strings that occur twice.

    After the contract's columns: the removed spans as start:end, and the passages of 50 words or
    more that occur again, which stay if they are shorter than 400 bytes.
    """
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return done.select(
        F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        told("spans"), F.size("passages").cast("long").alias("n_passages"), told("passages"),
    )


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same figures from a dictionary of all strings, for tests."""
    data, seen = [(t or "").encode() for t in texts], {}
    for d in data:
        for p in range(len(d) - length + 1):
            s = d[p : p + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((len(d), int(gone.sum()), len(runs(np.flatnonzero(gone))), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
