"""The registered queries of the subpackage: SQL where there is some, the pipeline stage by stage."""

from __future__ import annotations

import duckdb
import pytest

from evalquarry.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = c.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(str(r[names.index(k)]) for k in cols) for r in rel.fetchall()))
    assert sorted(tuple(str(r[k]) for k in cols) for r in df.collect()) == want


def test_there_are_ten_and_each_row_has_its_document(spark, sf):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for k in (4, 6, 7, 9):
        name = next(q for q in QUERIES if q.startswith(f"op{k}_"))
        assert QUERIES[name](spark, sf).select("doc_id").distinct().count() == n


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    from evalquarry.llm.common import materialise

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(9000, None, "en", None, None), (9001, "?!", "en", None, None), (9002, "", None, None, None)], docs.schema)
    docs = docs.union(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "encode":
            assert docs.columns == columns
    assert not seen["language_id"] & {9000, 9001, 9002}
    assert docs.where(F.col("ids") == "").isEmpty()
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [1 for r in docs.select("text").collect() for b in bench if b in r.text]
    assert docs.count() == docs.select("text").distinct().count()
    empty = docs.select(columns).limit(0)
    assert corpus_pipeline.near_dedup(spark, empty, sf).isEmpty()


ROWS = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, "", "en", None, None), (3, "", "en", None, None), (None, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13), (5, "long " * 200_000, "en", "s", 1), (6, "?!", None, None, None)]


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_dedup", "decontaminate", "encode"])
def test_stage_on_odd_rows(spark, tmp_path, name):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "Who?"), (2, None), (3, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    # Columns whose names the operators use themselves.
    clash = docs.select("*", *[docs["n_chars"].alias(c) for c in ("doc", "t", "node", "row", "uid", "root", "score", "spans")])
    for df in (docs, clash):
        out = stage(spark, df, str(tmp_path))
        if name != "encode":
            assert out.columns == df.columns
        got = sorted((r.doc_id or 0) for r in out.select("doc_id").collect())
        assert stage(spark, df.limit(0), str(tmp_path)).isEmpty()
    # Without a labelled letter-bearing text that is not held out there is no network, and all rows go.
    want = {"line_dedup": [0, 1, 2, 3, 3, 4, 5, 6], "near_dedup": [1, 2, 4, 5, 6], "decontaminate": [1, 2, 3, 3, 5, 6], "encode": [0, 1, 2, 3, 3, 4, 5, 6]}
    assert got == want[name] if name in want else set(got) <= {0, 4, 5}


def test_pipeline_against_its_operators_by_hand(spark, tmp_path):
    """The four stages that need no training, over few documents, beside plain Python."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import random

    r = random.Random(7)
    words = [a + b for a in ("ba", "ko", "ti", "re", "lu") for b in ("mi", "ta", "ro", "ne", "di", "su")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    line, item, base = "this line stands on many of the pages here", prose(30), prose(150)
    texts = [f"{prose(40)}\n{line}", f"{line}\n{prose(40)}", line, f"{prose(20)}\n {line.upper()}\t", base, base.replace(base.split()[70], "zz", 1), f"{prose(20)} {item} {prose(20)}", prose(60), prose(60)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    strip = lambda t, own: "\n".join(x for x in t.split("\n") if own or x.strip().lower() != line)
    kept = {0: strip(texts[0], False), 1: strip(texts[1], False), 3: texts[3], 4: base, 7: texts[7], 8: texts[8]}
    got = {x.doc_id: x for x in docs.collect()}
    assert {i: x.text for i, x in got.items()} == kept and all(x.n_chars == len(x.text) for x in got.values())
    from evalquarry.llm import sp_bpe

    library = sp_bpe.model_at(sp_bpe.MODEL).library
    assert {i: x.ids for i, x in got.items()} == {i: ",".join(map(str, library.encode(t))) for i, t in kept.items()}
