"""Work folders and small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a local run makes a
    temporary folder once and sets it for the session, and a cluster raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evalquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: Rows of documents that one Arrow batch holds, at most.
BATCH_ROWS = 2000


def packed(docs: DataFrame, text: str, keep: list[str] | None = None) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[str | None]]]:
    """``docs`` for a map over Arrow batches, and a function that gives a batch's texts.

    Column ``doc`` is a struct of the columns ``keep`` (None: all), safe from names that clash. The
    text travels once: inside the struct, or in a column of its own if it is not kept. Batches hold
    whole documents, so they are made smaller than Spark's default.
    """
    conf, rows = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows, "10000")) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    names = docs.columns if keep is None else list(keep)
    doc = F.struct(*[docs[c] for c in names]).alias("doc")
    if text in names:
        at = names.index(text)
        return docs.select(doc), lambda b: b.column("doc").field(at).to_pylist()
    return docs.select(doc, docs[text].alias("t")), lambda b: b.column("t").to_pylist()


def portions(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about ``most`` characters, at least one text each."""
    at = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > most:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def tidied(run: Callable[[Iterable], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterable], Iterator]:
    """``run``, which maps a partition's batches; at its end caches are dropped and memory is given back.

    Python workers outlive their tasks, so what one stage leaves behind would add to the next.
    """

    def tidy(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return tidy


def give_back() -> None:
    """Return memory that this process's allocators hold unused."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bits of a filter: at least, at most (32 MB, in every worker), and for each key.
FILTER_LEAST, FILTER_MOST, FILTER_EACH = 1 << 22, 1 << 28, 32


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit set of FILTER_LEAST to FILTER_MOST bits, two for each 64-bit hash of a column.

    It lets every key through and few others; too many keys make it let more through, never less.
    Bits are put together by an aggregate, so the driver gets the words of the set and no keys.
    """
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_EACH * keys.count()).bit_length()))
    h = F.col(column)
    at = F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the filter."""
    u = np.uint64
    mask = u((len(filter_) << 6) - 1)
    first, second = h & mask, (h >> u(32)) & mask
    maybe = np.flatnonzero((filter_[first >> u(6)] >> (first & u(63))) & u(1))
    second = second[maybe]
    return maybe[((filter_[second >> u(6)] >> (second & u(63))) & u(1)).astype(bool)]
