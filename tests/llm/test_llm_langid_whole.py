"""Language identification with more labels than 64."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalquarry.llm import langid


def test_every_label_is_learned(spark):
    # The rarest labels come last by frequency and by name; each has an alphabet of its own.
    rows = [(100 * k + j, " ".join([chr(0x4E00 + 8 * k + j % 3) * 4] * 20), f"l{k:02}") for k in range(80) for j in range(8 if k < 70 else 4)]
    df = spark.createDataFrame([*rows, (9999, "unlabelled words", None)], "doc_id long, text string, lang string")
    drawn = langid.sample(df, id="doc_id", text="text", label="lang", usable=F.lit(True))
    assert {lang for _, lang in drawn} == {f"l{k:02}" for k in range(80)}
    assert langid.train(drawn, epochs=1).langs == [f"l{k:02}" for k in range(80)]
