"""Exact top-k by inner product over a bit-sliced index.

Vectors of integers are dealt to blocks. A block stores, for each attribute, the bits of the
attribute (less the smallest value of the table) as one bitmap per bit: its slices. A query adds the
slices with bitmap arithmetic: each set bit of a weight shifts the attribute's slices, a negative
weight takes their complements, and carry-save adders reduce the bitmaps of each place to one, the
slice of the score. The top rows are then selected from the most significant score slice downward;
rows that tie at the boundary are resolved exactly, by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalquarry.llm.common import materialise, table

BLOCK_ROWS = 32_768
CHUNK_QUERIES = 256
LANES = 64
QUANT = 64
EVERY = 20
TOP = 20


class Block:
    """Slices of up to BLOCK_ROWS vectors in order of id, and their complements."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, slices: np.ndarray, dims: int, least: int) -> None:
        self.rids, self.ids, self.n, self.least = rids, ids, len(ids), least
        self.words = -(-self.n // 64)
        self.bits = slices.shape[0] // dims if dims else 0
        valid = np.zeros(self.words * 64, np.uint8)
        valid[: self.n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        self.both = np.concatenate([slices, ~slices & self.valid])

    @staticmethod
    def slice(values: np.ndarray, bits: int) -> np.ndarray:
        """Bitmaps (attributes * bits, words) of non-negative values (rows, attributes)."""
        n, dims = values.shape
        out = np.zeros((dims, bits, -(-n // 64) * 64), np.uint8)
        for b in range(bits):
            out[:, b, :n] = ((values >> b) & 1).T
        return np.packbits(out.reshape(dims * bits, -1), axis=1, bitorder="little").view(np.uint64)

    def score_slices(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the unsigned score, lowest first, and what to add to it."""
        s, half = self.bits, self.both.shape[0] // 2
        places: dict[int, list[np.ndarray]] = {}
        base = np.arange(s)
        for t in range(int(np.abs(q).max(initial=0)).bit_length()):
            dims = np.flatnonzero((np.abs(q) >> t) & 1)
            rows = (dims * s + np.where(q[dims] < 0, half, 0))[:, None] + base
            for b in range(s):
                places.setdefault(t + b, []).append(self.both[rows[:, b]])
        out, place = [], 0
        while places and place <= max(places):
            x = np.concatenate(places.pop(place)) if place in places else np.zeros((0, self.words), np.uint64)
            while len(x) >= 2:
                t = len(x) // 3
                if t:
                    a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                    ab = a ^ b
                    carry = (a & b) | (c & ab)
                    x = np.concatenate([ab ^ c, x[3 * t :]])
                else:
                    carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
                places.setdefault(place + 1, []).append(carry)
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            place += 1
        below = int(-q[q < 0].sum()) * ((1 << s) - 1)
        return out, self.least * int(q.sum()) - below

    def top(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than that with record number ``own``, ties to the smaller id."""
        slices, offset = self.score_slices(q)
        edge = self.valid.copy()
        for p in np.flatnonzero(self.rids == own):
            edge[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        sure = np.zeros_like(edge)
        if (size := int(np.bitwise_count(edge).sum())) > k:
            have = 0
            for s in reversed(slices):
                up = edge & s
                n = have + int(np.bitwise_count(up).sum())
                if n > k:
                    edge = up
                elif n < k:
                    sure, have, edge = sure | up, n, edge & ~s
                else:
                    sure, have, edge = sure | up, n, np.zeros_like(edge)
                    break
            rest = self.rows(edge)[: k - have]
        else:
            rest = self.rows(edge) if size else np.empty(0, np.int64)
        rows = np.concatenate([self.rows(sure), rest])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        scores = np.full(len(rows), offset, np.int64)
        for i, s in enumerate(slices):
            scores += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << i
        return self.ids[rows], scores

    @staticmethod
    def rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
        w, b = np.nonzero(bits)
        return words[w] * 64 + b


def quantised(vectors: DataFrame, *, id: str, vector: str, scale: int = QUANT) -> DataFrame:
    """(rid, id, q array<long>): floor(scale * x); rows with a null id, vector or component, or one that is not finite, go."""
    v = vectors.select(vectors[id].cast("long").alias("id"), vectors[vector].alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return v.where(finite).select(F.monotonically_increasing_id().alias("rid"), "id", q.alias("q"))


def build_blocks(vectors: DataFrame, *, dims: int, least: int, most: int, n: int) -> DataFrame:
    """The index: (block, n, rids, ids, slices) of bytes, a row per block."""
    blocks, bits = max(1, -(-n // BLOCK_ROWS)), max(1, int(most - least).bit_length())

    def build(key, pdf):
        pdf = pdf.sort_values(["id", "rid"])
        values = np.full((len(pdf), dims), -least, np.int64)
        for row, q in zip(values, pdf["q"]):
            row[: len(q)] = np.asarray(q) - least
        parts = (pdf["rid"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64), Block.slice(values, bits))
        return pd.DataFrame([[key[0], *(x.tobytes() for x in parts)]], columns=["block", "rids", "ids", "slices"])

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(build, "block int, rids binary, ids binary, slices binary")


def top_k(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose id is divisible by ``every``.

    Each row with such an id is a query of its own, also where ids repeat; its own row alone is left
    out. Shorter vectors count as filled up with zeros. An empty table gives an empty result.
    """
    rows = materialise(quantised(vectors, id=id, vector=vector), "vectors")
    n, dims, least, most = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    dims, least, most = dims or 0, min(least or 0, 0), max(most or 0, 0)
    index = materialise(build_blocks(rows, dims=dims, least=least, most=most, n=n), "slices")
    blocks = max(1, -(-n // BLOCK_ROWS))
    queries = rows.where(F.col("id") % every == 0)
    chunks = max(1, -(-n // (every * CHUNK_QUERIES)))
    packed = queries.groupBy(F.pmod(F.xxhash64("rid"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("rid", "id", "q")).alias("queries"))
    # Few blocks are held by several lanes of chunks, so that there are units for LANES tasks.
    lanes = min(chunks, max(1, -(-LANES // blocks)))
    tasks = min(2000, 2 * blocks * lanes)
    lane = F.pmod("chunk", F.lit(lanes)).cast("int")
    pairs = packed.withColumn("lane", lane).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    units = pairs.repartition(tasks, "block", "lane").join(copies.repartition(tasks, "block", "lane"), ["block", "lane"])

    def run(batches):
        held, block = None, None
        for pdf in batches:
            for b, queries, rids, ids, slices in zip(pdf["block"], pdf["queries"], pdf["rids"], pdf["ids"], pdf["slices"]):
                if held != b:
                    ids_ = np.frombuffer(ids, np.int64)
                    held, block = b, Block(np.frombuffer(rids, np.int64), ids_, np.frombuffer(slices, np.uint64).reshape(-1, -(-len(ids_) // 64)), dims, least)
                found = []
                for r in queries:
                    q = np.zeros(dims, np.int64)
                    q[: len(r["q"])] = r["q"]
                    top, scores = block.top(q, k, r["rid"])
                    found.append(pd.DataFrame({"rid": r["rid"], "query_id": r["id"], "vec_id": top, "score": scores}))
                if found:
                    yield pd.concat(found)

    part = units.select("block", "queries", "rids", "ids", "slices").mapInPandas(run, "rid long, query_id long, vec_id long, score long")
    w = W.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other rows of embeddings for every row whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
