"""Power samples as a stream: attribution to cases, windows, idempotent sinks and conversational state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def attribute(samples: DataFrame, cases: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Stream-static range join: each sample (ts, watts) with the cases whose time span [begun, ended) holds it.

    Spans are spread over the hours that they touch, so that the join has an equality on the hour and needs no
    broadcast; the exact bounds are checked after it.
    """
    hour = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    spread = cases.withColumn("_hour", F.explode(F.sequence(hour("begun"), hour("ended"))))
    near = samples.withColumn("_hour", hour("ts")).join(spread, "_hour").drop("_hour")
    return near.filter((F.col("ts") >= F.col("begun")) & (F.col("ts") < F.col("ended")))


def windowed(samples: DataFrame, by: str, value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and peak of each key and window; samples later than the watermark are left out."""
    timed = samples.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), by)
    return timed.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak")).select(F.col("w.start").alias("begun"), by, "n", "mean", "peak")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run what is available and write each batch under its own number, so that a batch run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def answer_incidents(stream: DataFrame, cases: DataFrame, path: str, checkpoint: str) -> None:
    """Incoming incidents against the static history: every batch is investigated as in batch and replaces itself when run again."""
    from provena.plans.investigate import investigate

    def put(batch: DataFrame, number: int) -> None:
        investigate(batch, cases).answers.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def conversation_memory(turns: DataFrame, most: int = 10, remembered: int = 2) -> DataFrame:
    """State per run: admits at most ten turns and names the last two valid ones that each admitted turn remembers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, "")
        turns = np.sort(np.concatenate([b["turn_no"].to_numpy() for b in batches]))
        before = [x for x in last.split(",") if x]
        room = max(0, most - n)
        known = [*before, *map(str, turns[:room].tolist())]  # what is remembered, then the turns admitted now
        ends = len(before) + np.minimum(np.arange(len(turns)), room)
        remembers = [",".join(known[max(0, e - remembered) : e]) for e in ends.tolist()]
        state.update((n + min(room, len(turns)), ",".join(known[-remembered:])))
        yield pd.DataFrame({"run_id": key[0], "turn_no": turns, "admitted": np.arange(len(turns)) < room, "remembers": remembers})

    return turns.groupBy("run_id").applyInPandasWithState(
        step, "run_id string, turn_no long, admitted boolean, remembers string", "n int, last string", "append", GroupStateTimeout.NoTimeout
    )
