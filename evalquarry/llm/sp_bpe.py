"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score (higher first, then
further left) and merges the best pair until none is left; symbols that stay outside the
vocabulary become byte pieces, or the unknown piece where the vocabulary has no bytes. Text is
cut beforehand where no piece of the vocabulary can reach across, so each distinct chunk is
encoded once per worker; what an Arrow batch brings in new is checked against the sentencepiece
library in one call, and a difference raises.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm.common import packed, portions, table, tidied

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
SHORT = 48
NEVER = float("inf")
#: Chunks that a worker remembers while it works on a partition (about 200 bytes each), and their length.
CACHE_CHUNKS = 400_000
CACHED_CHARS = 64


class PieceModel:
    """A vocabulary with scores, read through the library from a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.said = {p: str(i) for p, i in self.id_of.items()}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = sp.unk_id()
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.chunks = re.compile(self.cuts([p for p in self.id_of if len(p) > 1])).findall
        #: Comma-joined ids of chunks, and the decoded text of those that don't decode to themselves.
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    @staticmethod
    def cuts(longer: list[str]) -> str:
        """The pattern of chunks between which no piece of several characters can lie.

        A space mark after another character, a line feed on either side, and the end of a run of
        letters are such places if the vocabulary has no piece across them.
        """
        letter, other = f"[{LETTERS}]", f"[^{LETTERS}{SPACE}\n]"
        if any(b == SPACE != a for p in longer for a, b in zip(p, p[1:])) or any("\n" in p for p in longer):
            return "(?s:.+)"
        if any(re.search(rf"{letter}(?!{letter}).", p) for p in longer):
            return rf"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+"
        return rf"{SPACE}+{other}*{letter}*|\n|{other}+{letter}*|{letter}+"

    def agenda_short(self, chunk: str) -> list[str]:
        """Symbols of a short chunk: the agenda is a plain list, its best entry found by ``min``."""
        rank, sym = self.rank.get, list(chunk)
        agenda = [rank(a + b, NEVER) for a, b in zip(sym, chunk[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            sym[i] += sym.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(sym[i] + sym[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(sym[i - 1] + sym[i], NEVER)
        return sym

    def agenda_long(self, chunk: str) -> list[str]:
        """The same merges by a heap, in n log n steps for long chunks."""
        rank, n = self.rank.get, len(chunk)
        sym: list[str | None] = list(chunk)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, i + 1, a + b) for i, (a, b) in enumerate(zip(chunk, chunk[1:])) if (r := rank(a + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, p = heapq.heappop(agenda)
            a, b = sym[i], sym[j]
            if a is None or b is None or right[i] != j or len(a) + len(b) != len(p):
                continue
            sym[i], sym[j] = p, None
            k = right[i] = right[j]
            h = left[i]
            if k < n:
                left[k] = i
                if (r := rank(q := p + sym[k])) is not None:
                    heapq.heappush(agenda, (r, i, k, q))
            if h >= 0 and (r := rank(q := sym[h] + p)) is not None:
                heapq.heappush(agenda, (r, h, i, q))
        return [s for s in sym if s is not None]

    def ids(self, sym: list[str]) -> list[int]:
        """Ids of symbols: of those outside the vocabulary the bytes, or the unknown piece."""
        out: list[int] = []
        for s in sym:
            if (k := self.id_of.get(s)) is not None:
                out.append(k)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def normalise(self, text: str) -> str:
        """Identity normalisation with a dummy prefix; empty text has no symbols."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def forget(self) -> None:
        self.cache, self.older, self.odd = {}, {}, {}

    def encode_batch(self, texts: list[str], *, check: bool = True) -> list[tuple[int, str, str]]:
        """Number of ids, comma-joined ids and the decoded text of each text, through the chunk cache.

        Byte runs never cross a chunk, so the decoded chunks join to the decoded text.
        """
        if len(self.cache) > CACHE_CHUNKS // 2:  # what is not met again while the next half fills goes
            self.cache, self.older = {}, self.cache
        if len(self.odd) > CACHE_CHUNKS // 8:
            self.forget()
        cache, older, said, fresh, out = self.cache, self.older, self.said, {}, []
        for text in texts:
            chunks = self.chunks(self.normalise(text))
            got = list(map(cache.get, chunks))
            if None in got:
                for k, v in enumerate(got):
                    if v is None:
                        c = chunks[k]
                        if (v := older.get(c)) is not None:
                            cache[c] = v
                        elif (v := fresh.get(c)) is None:
                            sym = self.agenda_short(c) if len(c) <= SHORT else self.agenda_long(c)
                            try:  # pieces alone: they decode to the chunk that they make up
                                v = ",".join([said[s] for s in sym])
                            except KeyError:
                                ids = self.ids(sym)
                                v = ",".join(map(str, ids))
                                if (back := self.decode(ids, first=False)) != c.replace(SPACE, " "):
                                    self.odd[c] = back
                            fresh[c] = v
                        got[k] = v
            joined = ",".join(got)
            back = "".join([self.odd.get(c, c) for c in chunks] if self.odd else chunks)
            out.append((joined.count(",") + 1 if joined else 0, joined, back.replace(SPACE, " ").removeprefix(" ")))
        if check and fresh:
            self.check(fresh)
        cache.update((c, v) for c, v in fresh.items() if len(c) <= CACHED_CHARS)
        return out

    def check(self, fresh: dict[str, str]) -> None:
        """Compare chunks with the library, whose own dummy prefix stands for a leading mark.

        A chunk without a leading mark is led by a line feed there, which ends every merge.
        """
        marked = [c for c in fresh if c[0] == SPACE]
        for c, ids in zip(marked, self.library.encode([c[1:].replace(SPACE, " ") or "" for c in marked])):
            if len(c) > 1 and ",".join(map(str, ids)) != fresh[c]:
                raise ValueError(f"agenda and library differ on {c[:80]!r}")
        bare = [c for c in fresh if c[0] != SPACE]
        head = len(self.library.encode("\n"))
        for c, ids in zip(bare, self.library.encode(["\n" + c for c in bare])):
            if ",".join(map(str, ids[head:])) != fresh[c]:
                raise ValueError(f"agenda and library differ on {c[:80]!r}")

    def decode(self, ids: list[int], *, first: bool = True) -> str:
        """Text of ids: byte runs as UTF-8, marks as spaces; ``first`` drops the dummy prefix."""
        parts, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i in self.control:
                continue
            p = self.pieces[i] if i != self.unknown else " ⁇ "
            parts.append(p[1:] if first and p[0] == SPACE else p)
            first = False
        if run:
            parts.append(run.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ")


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """The model of a path, loaded once per worker; a bare name is looked up in the public set."""
    if path not in _MODELS:
        full = path
        if "/" not in path:
            import public_tokenizers

            full = public_tokenizers.path(path)
        _MODELS[path] = PieceModel(full)
    return _MODELS[path]


def encode_documents(docs: DataFrame, *, text: str = "text", model: str = MODEL, check: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``) in struct ``doc``, with ``n_tokens``, ``ids`` (comma-joined) and ``decoded``.

    Null text counts as empty: no ids and an empty decoded text. Rows are independent, so ties,
    repeated rows and an empty table need no rule; extra columns are carried as they are.
    """
    rows, texts_of = packed(docs, text, keep)

    def run(batches):
        m = model_at(model)
        for b in batches:
            texts = [t or "" for t in texts_of(b)]
            found = [x for lo, hi in portions(texts) for x in m.encode_batch(texts[lo:hi], check=check)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                names=["doc", "n_tokens", "ids", "decoded"],
            )

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, n_tokens long, ids string, decoded string"
    return rows.mapInArrow(tidied(run, lambda: model_at(model).forget()), schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every whole text of documents as piece ids and back; digests of both."""
    done = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model=model, keep=["doc_id"])
    return done.select(F.col("doc.doc_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
