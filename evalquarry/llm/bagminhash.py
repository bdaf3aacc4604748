"""Near duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its word shingles; the weight of a shingle is its count, discretised
to unit steps. The levels [0,1), [1,2), [2,4), [4,8) ... each have a Poisson process of the level's
width as rate, seeded by the shingle and the level, whose points carry a time, a register and a
height in the level; a point counts if its height is below the shingle's weight. A register keeps
the earliest time. Two documents agree in a register with their weighted Jaccard similarity as
probability. Processes are followed only until all registers of a document are filled.

Equal texts are one node. Nodes that agree in a band meet in a bucket. Each bucket first compares
its members with one leader; verified links give components; only buckets that still hold several
components go on, and there members of different components are compared in bounded blocks, which
return links that join components, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm.common import materialise, portions, table, tidied
from evalquarry.llm.components import components
from evalquarry.llm.hashing import Substrings, mix

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
BLOCK_MEMBERS = 512
#: Bytes whose running sums are held at once.
STRETCH = 1 << 19
_U = np.uint64


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and each text's offsets.

    A word is a run of ASCII letters and digits and of characters beyond ASCII, lower-cased.
    """
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    word = np.concatenate([[False], _WORD[b], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    begin = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    out = np.empty(len(start), _U)
    at = 0
    while at < len(start):  # the running sums of a stretch of words at a time
        stop = max(at + 1, int(np.searchsorted(end, start[at] + STRETCH, "right")))
        out[at:stop] = Substrings(b[start[at] : end[stop - 1]])(start[at:stop] - start[at], end[at:stop] - start[at])
        at = stop
    return out, np.searchsorted(start, begin)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit shingle) of all documents of a batch; shorter documents are one shingle."""
    n = np.diff(offsets)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), counts)
    start = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    out = np.zeros(len(start), _U)
    length = np.minimum(n, size)[doc]
    padded = np.concatenate([hashes, np.zeros(size, _U)])
    for k in range(size):
        h = padded[start + k]
        h[k >= length] = 0
        out = mix(out * _U(0x9FB21C651E98DF25) + h, k)
    return doc, out


def weighted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) in order, with counts."""
    order = np.lexsort((shingle, doc))
    d, s = doc[order], shingle[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])) if len(d) else np.empty(0, np.int64)
    return d[first], s[first], np.diff(np.append(first, len(d)))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """(docs, registers) earliest times; infinite for documents without shingles."""
    sig = np.full(docs * registers, np.inf)
    total = np.bincount(doc, weights=weight, minlength=docs)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    low, width = np.where(level > 0, 2.0 ** (level - 1), 0.0), np.where(level > 0, 2.0 ** (level - 1), 1.0)
    seed, owner, most = mix(shingle[row], 1) ^ mix(level.astype(_U), 2), doc[row], weight[row]
    live = np.arange(len(row))
    limit = np.zeros(docs)
    limit[total > 0] = registers * (np.log(registers) + 3) / total[total > 0]
    time = np.zeros(len(row))
    step = np.zeros(len(row), np.int64)
    while len(live):
        # Every process advances past its document's limit; then documents with empty registers get more time.
        going = live
        while len(going):
            h = mix(seed[going] + step[going].astype(_U) * _U(0xD1342543DE82EF95), 3)
            t = time[going] - np.log(uniform(h)) / width[going]
            ok = t <= limit[owner[going]]
            going, h, t = going[ok], h[ok], t[ok]
            time[going] = t
            step[going] += 1
            g = mix(h, 4)
            counts = low[going] + uniform(mix(h, 5)) * width[going] < most[going]
            np.minimum.at(sig, (owner[going] * registers + (g % _U(registers)).astype(np.int64))[counts], t[counts])
        open_ = np.isinf(sig.reshape(docs, registers)).any(axis=1) & (total > 0)
        limit[open_] *= 2
        live = live[open_[owner[live]]]
    return sig.reshape(docs, registers)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(docs, bands) hashes of the registers of each band."""
    raw = np.ascontiguousarray(sig).view(_U).reshape(len(sig), bands, -1)
    out = np.tile(mix(np.arange(bands, dtype=_U), 6), (len(sig), 1))
    for k in range(raw.shape[2]):
        out = mix(out * _U(0x9FB21C651E98DF25) + raw[:, :, k], 7)
    return out


def flat(batch: pa.RecordBatch | pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    a = batch.column(column)
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    offsets = a.offsets.to_numpy().astype(np.int64)
    return a.flatten().to_numpy().view(_U), offsets - offsets[0]


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard of two sorted multisets of shingles."""
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    common = int(np.minimum(cx[i], cy[j]).sum())
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 0.0


def verify(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (x, y) whose multisets overlap enough, with the similarity."""
    left, right = (bags.select(F.col("node").alias(c), F.col("words").alias(f"w{c}")) for c in "xy")

    def run(batches):
        for b in batches:
            wx, ox = flat(b, "wx")
            wy, oy = flat(b, "wy")
            (dx, sx), (dy, sy) = shingles(wx, ox), shingles(wy, oy)
            ex, ey = np.searchsorted(dx, np.arange(b.num_rows + 1)), np.searchsorted(dy, np.arange(b.num_rows + 1))
            found = np.array([overlap(sx[ex[k] : ex[k + 1]], sy[ey[k] : ey[k + 1]]) for k in range(b.num_rows)])
            out = pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(found)], names=["x", "y", "similarity"])
            yield out.filter(pa.array(found >= least))

    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "wx", "wy")
    return joined.mapInArrow(tidied(run), "x binary, y binary, similarity double")


def sketch(sig: np.ndarray) -> np.ndarray:
    """(docs, registers) 16 bits of each register, for estimates."""
    return mix(np.ascontiguousarray(sig).view(_U), 8).astype(np.uint16)


def block_links(key, block: pa.Table, least: float) -> pa.Table:
    """Links of different components between the two sides of one block pair, one per joined pair of components.

    Only pairs whose sketches agree within six deviations of ``least`` are compared exactly: of pairs
    of similarity 0.8 and 160 registers, some 15 in a billion are missed (the binomial tail; see the tests).
    """
    block = block.combine_chunks()
    nodes, comps = block.column("node").to_pylist(), block.column("root").to_pylist()
    side = np.array(block.column("side").to_pylist())
    marks = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint16).reshape(len(nodes), -1)
    registers = marks.shape[1]
    need = registers * (least - 6 * np.sqrt(least * (1 - least) / registers))
    words, ends = flat(block, "words")
    bags: dict[int, np.ndarray] = {}
    parent = {c: c for c in comps}

    def bag(d):
        if d not in bags:
            bags[d] = shingles(words[ends[d] : ends[d + 1]], np.array([0, ends[d + 1] - ends[d]]))[1]
        return bags[d]

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = {"x": [], "y": [], "similarity": []}
    same = key[1] == key[2]
    for d in range(len(nodes) - 1):
        close = (marks[d + 1 :] == marks[d]).sum(axis=1) >= need
        if not same:
            close &= side[d + 1 :] != side[d]
        for e in (d + 1 + np.flatnonzero(close)).tolist():
            a, b = find(comps[d]), find(comps[e])
            if a != b and (s := overlap(bag(d), bag(e))) >= least:
                parent[a] = b
                for name, v in zip(out, (nodes[d], nodes[e], s)):
                    out[name].append(v)
    return pa.table(out, schema=pa.schema([("x", pa.binary()), ("y", pa.binary()), ("similarity", pa.float64())]))


def near_duplicates(docs: DataFrame, *, text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Links (x, y, similarity) between nodes and membership (node, root) of the linked nodes.

    A node is the MD5 of a text. Links join different texts whose shingle multisets overlap by
    ``least`` or more; in a bucket of several, one spanning set of them. Null texts have no node,
    texts without words no shingles and so no links.
    """
    own = docs.select(docs[text].alias("t")).where(F.col("t").isNotNull()).select(F.unhex(F.md5("t")).alias("node"), "t")

    def sign(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for lo, hi in portions(texts):
                words, offsets = word_hashes(texts[lo:hi])
                keys = band_keys(signatures(*weighted(*shingles(words, offsets)), hi - lo, bands * rows), bands)[np.diff(offsets) > 0]
                nodes = batch.column("node").slice(lo, hi - lo).filter(pa.array(np.diff(offsets) > 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([nodes, lists], names=["node", "keys"])

    def bag(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for lo, hi in portions(texts):
                words, offsets = word_hashes(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words.view(np.int64)))
                marks = sketch(signatures(*weighted(*shingles(words, offsets)), hi - lo, bands * rows))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), lists, pa.array([m.tobytes() for m in marks], pa.binary())], names=["node", "words", "sketch"])

    signed = own.mapInArrow(tidied(sign), "node binary, keys array<bigint>")
    member = materialise(signed.select("node", F.explode("keys").alias("key")).distinct(), "bands")
    bucket = materialise(member.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("leader")).where("c > 1"), "leaders")
    live = materialise(member.join(bucket, "key"), "buckets")
    named = live.select("node").distinct()
    texts = own.join(named, "node", "left_semi")
    bags = materialise(texts.mapInArrow(tidied(bag), "node binary, words array<bigint>, sketch binary").dropDuplicates(["node"]), "bags")
    star = live.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("x"), F.col("node").alias("y")).distinct()
    links = materialise(verify(star, bags, least), "links")
    roots = components(links)
    # Buckets of three or more that still hold several components.
    owned = live.where("c > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = owned.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("core"), F.max("n").alias("cores"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    at = F.xxhash64("node")
    split = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK_MEMBERS))).cast("int")
    placed = owned.join(mixed, "key").withColumn("is_core", F.col("root") == F.col("core"))
    placed = placed.withColumn("nc", split(F.col("cores"))).withColumn("no", split(F.col("others")))
    placed = placed.withColumn("block", F.when(F.col("is_core"), F.pmod(at, "nc")).otherwise(F.pmod(at, "no") + F.col("nc")).cast("int"))
    # A core block meets each block of others; a block of others meets each core block and each block of others.
    meets = F.when(F.col("is_core"), F.sequence(F.col("nc"), F.col("nc") + F.col("no") - 1)).otherwise(F.sequence(F.lit(0), F.col("nc") + F.col("no") - 1))
    paired = placed.withColumn("with", F.explode(meets)).select("key", "node", "root", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), F.col("block").alias("side"))
    extra = paired.join(bags, "node").groupBy("key", "lo", "hi").applyInArrow(lambda k, t: block_links(k, t, least), "x binary, y binary, similarity double")
    links = materialise(links.union(extra), "links")
    return links, components(links)


def classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc struct of all columns, class_id, class_size): class_id is the smallest id of the class.

    Equal texts and linked texts are one class. A row with a null text is a class of its own, with
    its own id; a class of null ids alone has a null class_id.
    """
    _, roots = near_duplicates(docs, text=text, least=least)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id].alias("id_"), F.unhex(F.md5(docs[text])).alias("node"))
    own = rows.where("node IS NULL").select("doc", F.col("id_").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    rooted = rows.where("node IS NOT NULL").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = materialise(rooted.groupBy("root").agg(F.min("id_").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return rooted.join(least_id, "root").select("doc", "class_id", "class_size").union(own)


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of exact and near copies."""
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "class_id", "class_size")
