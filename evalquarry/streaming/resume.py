"""Incremental generation: a stream of records, deduplicated by prompt hash, verified and appended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from evalquarry.functions import text as X
from evalquarry.functions import verify as V


def record_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder; torn lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(folder)


def with_hash(rows: DataFrame, template: str) -> DataFrame:
    """STR17, STR18: rows with their rendered prompt and its hash."""
    return rows.withColumn("prompt", X.render(template, rows.columns)).withColumn("hash", X.prompt_hash(F.col("prompt")))


def once(rows: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """STM6: the first row of each hash; with an event time the state of old hashes goes."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["hash"]) if event_time else rows.dropDuplicates(["hash"])


def generated(rows: DataFrame, generate: Callable[[str, int], str], n: int, base_seed: int = 0) -> DataFrame:
    """STM2: n generations per row with seeds base+i+1; a failing one is left out, the others stay."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            all_gens = []
            for p in pdf["prompt"]:
                gens = []
                for i in range(n):
                    try:
                        gens.append({"response_id": i, "generated_response": generate(p, base_seed + i + 1), "finish_reason": "stop"})
                    except Exception:
                        continue
                all_gens.append(gens)
            yield pdf.assign(gens=all_gens)

    return rows.mapInPandas(run, f"{kinds}, gens array<struct<response_id:bigint,generated_response:string,finish_reason:string>>")


def ask(spark: SparkSession, prompt: str, generate: Callable[[str, int], str], seed: int = 0) -> str | None:
    """UDF7: one prompt to a model; null if the request fails."""
    row = generated(spark.createDataFrame([(prompt,)], "prompt string"), generate, 1, seed).first()
    return row.gens[0].generated_response if row.gens else None


def verified(rows: DataFrame, answer: str = "answer", response: str = "response") -> DataFrame:
    """STM3, STM4: extracted answer and correctness; null where nothing was extracted."""
    out = rows.withColumn("extracted", X.boxed_answer(F.col(response)))
    return out.withColumn("correctness", F.when(F.col("extracted").isNotNull(), V.equivalent_udf(F.col("extracted"), F.col(answer))))


def append(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """STM1, SNK5: exactly once into Parquet; without a trigger interval all that is there, then stop."""
    w = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


class Progress(StreamingQueryListener):
    """STM5, AGG48: rows seen and the rate of each batch."""

    def __init__(self) -> None:
        self.rows, self.batches = 0, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryTerminated(self, event) -> None: ...


def counters(rows: DataFrame, name: str, error: Column) -> DataFrame:
    """AGG48: counts of rows and errors that an action on ``rows`` reports."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(error).alias("errors"))


def cache_action(have: dict | None, want: dict) -> str:
    """STM12: reuse an equal manifest, fall back on one that differs in the number of samples alone, else generate."""
    if have is None:
        return "generate"
    if have == want:
        return "reuse"
    rest = lambda m: {k: v for k, v in m.items() if k != "n"}
    return "fallback" if rest(have) == rest(want) and have.get("n", 0) >= want.get("n", 0) else "generate"


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """STM7, STM13, STM14: read a finished dataset, else build and write it."""
    from evalquarry.sources.sinks import complete, write_dataset

    if not complete(spark, path):
        write_dataset(build(), path)
    return spark.read.parquet(path)
