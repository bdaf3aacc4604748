"""Language identification by a byte convolutional network.

Lower-cased UTF-8 bytes are embedded, filters of several widths run over fixed-length windows, the
maximum of each filter over a window goes to a softmax layer. The network is trained in numpy on a
bounded sample of labelled texts. A text is cut into windows without remainder; its prediction is
the mean of the windows' probabilities, weighted by their bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalquarry.llm.common import packed, table, tidied

WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
WINDOW = 256
#: Bounds of the training sample: texts of a language, characters of each of three places of a text.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 240
EPOCHS, BATCH, RATE, SEED = 6, 64, 4e-3, 4
BATCH_WINDOWS = 256
UNKNOWN = "und"
_word = re.compile(r"[^\W\d_]+").finditer


@dataclass
class ByteNet:
    """Embedding, filters as one matrix of the largest width, and the softmax layer."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = SEED) -> ByteNet:
        r, w, f = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
        e = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        filters = r.normal(0, 0.25, (w * EMBED, f)).astype(np.float32)
        return cls(langs, e, filters, np.zeros(f, np.float32), r.normal(0, 0.1, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)).masked()

    def masked(self) -> ByteNet:
        """Byte 0 is padding; a narrow filter sees nothing beyond its width."""
        self.embed[0] = 0
        for k, w in enumerate(WIDTHS):
            self.filters[w * EMBED :, k * FILTERS : (k + 1) * FILTERS] = 0
        return self

    def unfold(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, width * EMBED): the embedded bytes that each filter position sees."""
        w = max(WIDTHS)
        x = self.embed[np.pad(windows, ((0, 0), (0, w - 1)))]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), w * EMBED, axis=1)[:, ::EMBED]
        return np.ascontiguousarray(view)

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.unfold(windows)
        y = x.reshape(-1, x.shape[2]) @ self.filters
        return x, y.reshape(len(windows), -1, y.shape[1])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, len(self.langs)), np.float32)]
        for k in range(0, len(windows), BATCH_WINDOWS):
            _, y = self.features(windows[k : k + BATCH_WINDOWS])
            out.append(softmax(np.maximum(y.max(axis=1) + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(out)

    def step(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of ``weights``."""
        x, y = self.features(windows)
        at = y.argmax(axis=1)
        n = np.arange(len(windows))
        top = np.take_along_axis(y, at[:, None], 1)[:, 0] + self.bias
        h = np.maximum(top, 0)
        p = softmax(h @ self.out + self.out_bias)
        p[n, labels] -= 1
        p /= len(n)
        dh = (p @ self.out.T) * (top > 0)
        seen = x[n[:, None], at]
        d_filters = np.einsum("nf,nfk->kf", dh, seen)
        dx = (dh[:, :, None] * self.filters.T).reshape(len(n), at.shape[1], max(WIDTHS), EMBED)
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        d_embed = np.zeros_like(self.embed)
        for j in range(max(WIDTHS)):
            np.add.at(d_embed, padded[n[:, None], at + j], dx[:, :, j])
        return [d_embed, d_filters, dh.sum(0), h.T @ p, p.sum(0)]

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def adam(weights: list[np.ndarray], rate: float):
    """A step function for in-place updates."""
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], [0]

    def step(grads: list[np.ndarray]) -> None:
        t[0] += 1
        for w, g, a, b in zip(weights, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9 ** t[0])) / (np.sqrt(b / (1 - 0.999 ** t[0])) + 1e-8)

    return step


def lettered(text: str) -> bool:
    """Whether the text has a letter; ½ and ² are word characters, but none."""
    return any(any(map(str.isalpha, m[0])) for m in _word(text))


def cut(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text and their bytes."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    n = -(-len(b) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(b)] = b
    size = np.full(n, WINDOW, np.float64)
    if n:
        size[-1] = len(b) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), size


def train(samples: list[tuple[str, str]], *, epochs: int = EPOCHS, seed: int = SEED) -> ByteNet | None:
    """A network from (text, language) pairs; None if there are none."""
    langs = sorted({lang for _, lang in samples})
    parts = [(cut(t)[0], langs.index(lang)) for t, lang in samples if lettered(t)]
    if not parts:
        return None
    x = np.concatenate([w for w, _ in parts])
    y = np.concatenate([np.full(len(w), k) for w, k in parts])
    net, r = ByteNet.fresh(langs, seed), np.random.default_rng(seed)
    step = adam(net.weights(), RATE)
    for _ in range(epochs):
        order = r.permutation(len(x))
        for k in range(0, len(x), BATCH):
            mine = order[k : k + BATCH]
            step(net.step(x[mine], y[mine]))
            net.masked()
    return net


def sample(docs: DataFrame, *, id: str, text: str, label: str, usable: Column) -> list[tuple[str, str]]:
    """The training sample, bounded for each language: texts by a hash of the row, three places of each."""
    rows = docs.where(usable & docs[text].isNotNull() & docs[label].isNotNull())
    counts = rows.groupBy(rows[label].alias("l")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "l").collect()
    if not counts:
        return []
    # Rows are thinned by a hash and then the first by that hash are taken, so that a sample is the same every time.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.lit(min(1.0, 2 * SAMPLE_TEXTS / r["c"])))])
    rank = F.xxhash64(rows[id], rows[text])
    draw = F.pmod(rank, F.lit(1 << 20)) < share[rows[label]] * F.lit(float(1 << 20))
    n, c = F.length(rows[text]), SAMPLE_CHARS
    places = [F.substring(rows[text], F.greatest(F.lit(1), p.cast("int")), F.lit(c)) for p in (F.lit(1), n / 2 - c / 2, n - c)]
    drawn = rows.where(draw).select(F.array_distinct(F.array(*places)).alias("t"), rows[label].alias("l"), F.pmod(rank, F.lit(1 << 20)).alias("r"), rank.alias("h")).distinct()
    first = W.partitionBy("l").orderBy("r", "h", "t")
    held = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_TEXTS).collect()
    return [(t, r["l"]) for r in sorted(held, key=lambda r: (r["l"], r["t"])) for t in r["t"]]


def predict(docs: DataFrame, net: ByteNet | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc struct of all columns or of ``keep``, lang_pred, score) per row.

    ``und`` and 0 for null and empty texts and those without a letter, and for all if there is no
    network. Languages of equal probability: the first by name. Every row is predicted for itself,
    so repeated rows get equal results and an empty table an empty one; a text of any length is
    read whole, in groups of windows; other columns may have any name.
    """
    rows, texts_of = packed(docs, text, keep)

    def run(batches):
        for b in batches:
            texts = [t if t is not None and net and lettered(t) else None for t in texts_of(b)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            group, held = [], 0
            for k, t in enumerate(texts):
                if t is not None:
                    w, s = cut(t)
                    group.append((k, w, s))
                    held += len(w)
                if group and (held >= 8 * BATCH_WINDOWS or k == len(texts) - 1):
                    p = net.probabilities(np.concatenate([w for _, w, _ in group]))
                    at = 0
                    for j, w, s in group:
                        mean = (p[at : at + len(w)] * s[:, None]).sum(0) / s.sum()
                        at += len(w)
                        langs[j], scores[j] = net.langs[int(mean.argmax())], float(min(1.0, mean.max()))
                    group, held = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(langs), pa.array(scores)], names=["doc", "lang_pred", "score"])

    return rows.mapInArrow(tidied(run), f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id: Column) -> Column:
    """Documents whose crc32(id as text) leaves 2 modulo 4; a null id is held out too."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``predict`` with a network trained on the rows of ``docs`` that are not held out.

    Rows without a label or a text teach nothing; without any labelled row all are ``und``. Repeated
    rows count once.
    """
    return predict(docs, train(sample(docs, id=id, text=text, label=label, usable=~held_out(docs[id]))), text=text, keep=keep)


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")
