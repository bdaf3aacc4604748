"""Line deduplication with a sharded minimal perfect hash.

Every distinct line key is two 64-bit hashes. Keys that reach the document threshold are dealt to
shards by their first hash; each shard builds a minimal perfect hash (bit arrays of falling
collision levels with rank counts) over its keys and stores, at a key's index, a fingerprint,
the document count and the keeping doc_id in plain arrays. Counts come from an aggregate with
partial sums, so that a line of a third of all documents is no task's burden. Documents probe the
arrays and learn the numbers of the lines to drop: where all arrays together are below a bound, every
worker holds them and no line is moved; beyond it, documents send (shard, hashes, line number) to
the shards and get back line numbers. A key below the threshold has no index: its fingerprint
refuses it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm.common import materialise, table, text_of, tidied
from evalquarry.llm.hashing import mix

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 500_000
#: Bytes of all arrays that each worker holds, at most; more stay in their shards.
HELD_BYTES = 64 << 20
#: Probing groups of a shard, at least; more where a group would probe over SHARD_KEYS lines.
SALTS = 24
GAMMA = 2
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: one bit array per collision level."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])[:-1]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.asarray(keys, np.uint64)
        while len(left):
            m = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = (mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            hits = np.bincount(at, minlength=m)
            levels.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            sizes.append(m)
            left = left[hits[at] != 1]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.empty(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0 to n-1 for the keys it was built on, any index or -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (m, start) in enumerate(zip(self.sizes, self.starts)):
            if not len(todo):
                break
            at = (mix(keys[todo], level) % np.uint64(m)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            set_ = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[set_]] = (self.ranks[word] + below)[set_]
            todo = todo[~set_]
        return out


def line_keys(lines: Column) -> Column:
    """array<struct<i,a,b>> of the lines whose key is long enough: line number and two hashes."""
    key = lambda x: F.translate(F.trim(x, F.lit(STRIPPED)), UPPER, LOWER)
    keyed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), key(x).alias("k")))
    long_enough = F.filter(keyed, lambda s: F.length(s["k"]) >= MIN_CHARS)
    return F.transform(long_enough, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["k"]).alias("a"), F.xxhash64(F.lit(7), s["k"]).alias("b")))


def build_index(counted: DataFrame, shards: int) -> DataFrame:
    """One row per shard from (a, b, docs, keeper): level sizes, bits and the arrays, as bytes.

    Keys of one first hash and different second hashes share a slot only if the 64-bit hashes
    collide; such keys stay apart by mixing both hashes into the key that is indexed.
    """

    def build(key, pdf):
        a, b = pdf["a"].to_numpy(np.int64).view(np.uint64), pdf["b"].to_numpy(np.int64).view(np.uint64)
        k = a ^ mix(b, 63)
        h = PerfectHash.build(k)
        at = h.index(k)
        prints, counts, keepers, known = np.empty(len(k), np.uint64), np.empty(len(k), np.int64), np.empty(len(k), np.int64), np.empty(len(k), np.bool_)
        prints[at], counts[at], keepers[at], known[at] = b, pdf["docs"], pdf["keeper"].fillna(0).astype(np.int64), pdf["keeper"].notna()
        import pandas as pd

        return pd.DataFrame([[key[0], *(x.tobytes() for x in (h.sizes, h.bits, prints, counts, keepers, known))]], columns=INDEX_COLUMNS)

    return counted.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, sizes binary, bits binary, prints binary, counts binary, keepers binary, known binary")


INDEX_COLUMNS = ["shard", "sizes", "bits", "prints", "counts", "keepers", "known"]


class Shard:
    """The arrays of one shard, from a row of the index."""

    def __init__(self, row: dict[str, bytes]) -> None:
        of = lambda c, t: np.frombuffer(row[c], t)
        self.hash = PerfectHash(of("sizes", np.int64), of("bits", np.uint64))
        self.prints, self.counts, self.keepers, self.known = of("prints", np.uint64), of("counts", np.int64), of("keepers", np.int64), of("known", np.bool_)

    def drops(self, a: np.ndarray, b: np.ndarray, own: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Whether lines with these hashes go from documents with these ids (``has``: not null)."""
        at = self.hash.index(a ^ mix(b, 63))
        ok = at >= 0
        at[~ok] = 0
        ok &= (self.prints[at] == b) & (self.counts[at] >= MIN_DOCS)
        return ok & ~((has & self.known[at] & (self.keepers[at] == own)) | (~has & ~self.known[at]))


def probe(lines: pa.Table, index: pa.Table) -> pa.Table:
    """The rows of ``lines`` that are to be dropped, looked up in one shard's arrays."""
    if not index.num_rows or not lines.num_rows:
        return lines.slice(0, 0).select(["doc", "th", "i"])
    a, b = (lines.column(c).to_numpy().view(np.uint64) for c in "ab")
    doc = lines.column("doc")
    gone = Shard({c: index.column(c)[0].as_py() for c in INDEX_COLUMNS[1:]}).drops(a, b, doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy())
    return lines.select(["doc", "th", "i"]).filter(pa.array(gone))


def probe_batch(batch: pa.RecordBatch, shards: list[Shard | None]) -> pa.Array:
    """For each document of a batch the numbers of its lines to drop, looked up in all arrays."""
    keys = batch.column("keys")
    offsets = keys.offsets.to_numpy().astype(np.int64)
    flat = keys.flatten()
    i, a, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in "iab")
    a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
    size = np.diff(offsets)
    id_ = batch.column("id_")
    own, has = (np.repeat(x, size) for x in (id_.fill_null(0).to_numpy(), id_.is_valid().to_numpy(zero_copy_only=False)))
    shard = np.mod(a.view(np.int64), len(shards))
    gone = np.zeros(len(a), bool)
    for k in np.unique(shard).tolist():
        if shards[k] is not None:
            mine = np.flatnonzero(shard == k)
            gone[mine] = shards[k].drops(a[mine], b[mine], own[mine], has[mine])
    ends = np.concatenate([[0], np.cumsum(gone)])[offsets - offsets[0]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(i[gone], pa.int32()))


def frequent_lines(keyed: DataFrame) -> DataFrame:
    """(a, b, docs, keeper) of the keys of MIN_DOCS documents or more; rows come as (doc, keys)."""
    once = keyed.select("doc", F.explode(F.array_distinct(F.transform("keys", lambda s: F.struct(s["a"], s["b"])))).alias("k"))
    return once.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= MIN_DOCS)


def drops_by_shard(keyed: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc, th, drop array<int>): lines go to the shards, and the numbers of those to drop come back."""
    (n,) = keyed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    salts = max(SALTS, -(-n // (shards * SHARD_KEYS)))
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = keyed.select("doc", "th", F.explode("keys").alias("k")).select("doc", "th", "k.i", "k.a", "k.b")
    rows = rows.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc", "th", "i"), F.lit(salts)).cast("int"))
    hits = rows.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(probe, "doc long, th long, i int")
    return hits.groupBy("doc", "th").agg(F.collect_set("i").alias("drop"))


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc struct of all columns, n_lines int, n_dropped int, kept string).

    Null and empty texts are one empty line, kept. A row is a document: rows that repeat a doc_id
    count as documents of their own and keep the lines together if theirs is the largest id; a null
    id is below every other. A text of white space and short lines is returned as it is.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keys = line_keys(F.split(text_of(docs[text]), "\n", -1)).alias("keys")
    counted = materialise(frequent_lines(docs.select(docs[id].cast("long").alias("doc"), keys)), "lines")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    index = materialise(build_index(counted, shards), "index")
    size = index.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in INDEX_COLUMNS[2:]), F.octet_length(INDEX_COLUMNS[1]))), F.lit(0))).first()[0]
    if size <= HELD_BYTES:
        rows = docs.select(row, docs[id].cast("long").alias("id_"), keys)
        kind = rows.schema["row"].dataType.simpleString()
        held = docs.sparkSession.sparkContext.broadcast({r["shard"]: {c: bytes(r[c]) for c in INDEX_COLUMNS[1:]} for r in index.collect()})

        def run(batches):
            mine = [Shard(held.value[k]) if k in held.value else None for k in range(shards)]
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("row"), probe_batch(b, mine)], names=["row", "drop"])

        joined = rows.mapInArrow(tidied(run), f"row {kind}, drop array<int>").withColumn("t_", text_of(F.col("row")[text]))
    else:
        hashed = docs.select(row, docs[id].cast("long").alias("id_"), text_of(docs[text]).alias("t_")).withColumn("h_", F.xxhash64("t_"))
        keyed = docs.select(docs[id].cast("long").alias("doc"), F.xxhash64(text_of(docs[text])).alias("th"), keys)
        drops = drops_by_shard(keyed, index, shards)
        joined = hashed.join(drops, hashed["id_"].eqNullSafe(drops["doc"]) & (hashed["h_"] == drops["th"]), "left")
    lines = F.split("t_", "\n", -1)
    none = F.coalesce(F.size("drop"), F.lit(0)) <= 0
    kept = F.when(none, F.col("t_")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n"))
    return joined.select(F.col("row").alias("doc"), F.size(lines).alias("n_lines"), F.when(none, 0).otherwise(F.size("drop")).alias("n_dropped"), kept.alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without its repeated lines."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("doc.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.*, (f.key IS NOT NULL AND f.keeper <> k.doc_id) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
