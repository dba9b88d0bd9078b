"""Structured Streaming: change detection, latest generations, the frontier's state machine, sessions and windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove_at_exit, shared_dir, ship

STATE = "state string, attempts int, available_at long, digest string, generation long, seen long"
OUTPUT = "url string, at long, state string, attempts int, available_at long, changed boolean, generation long"


def advance(state: tuple, at: int, response: str, digest: str | None, retry_after: int, max_attempts: int) -> tuple:
    """``(new state, changed)`` of one answer; the state is (state, attempts, available_at, digest, generation)."""
    name, attempts, available, old, generation = state
    if response == "valid":
        changed = digest != old
        return ("done", 0, at, digest, generation + changed), changed
    if response == "redirect" or response == "unchanged":
        return ("done", 0, at, old, generation), False
    if response == "not_found":
        return ("gone", attempts, at, old, generation), False
    attempts += 1
    return ("blocked" if attempts >= max_attempts else "retry", attempts, at + retry_after * 2 ** (attempts - 1), old, generation), False


def frontier_states(answers: DataFrame, max_attempts: int = 5, retry_after: int = 60) -> DataFrame:
    """The frontier's transitions over a stream of answers ``(url, at, response, digest)``.

    State is kept per URL, in the order of ``at`` within a micro-batch. An answer older than one that the state has
    seen is superseded: its row repeats the state. Blocked and gone URLs stay so.
    """

    ship(answers.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else ("pending", 0, 0, None, 0, None)
        rows = []
        for r in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples():
            changed = False
            at = int(r.at)
            if now[0] not in ("blocked", "gone") and (now[5] is None or at >= now[5]):
                moved, changed = advance(now[:5], at, r.response, r.digest, retry_after, max_attempts)
                now = (*moved, at)
            rows.append((key[0], at, now[0], now[1], now[2], changed, now[4]))
        held.update(now)
        yield pd.DataFrame(rows, columns=["url", "at", "state", "attempts", "available_at", "changed", "generation"])

    return answers.groupBy("url").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def first_versions(pages: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each (url, generation) within the watermark: later copies are dropped."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url", "generation"])


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums of ``value`` per window and key."""
    w = F.window(time, size)
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def follow(source: DataFrame, sink: str, checkpoint: str, transform) -> None:
    """Work off what a streaming source has now, batch by batch, and append ``transform(batch)`` to ``sink``.

    Batches are written under their number, so that a batch repeated after a failure replaces itself.
    """

    def publish(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    source.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a streaming query has to say about what its source holds now, as a table in the shared folder.

    In ``complete`` mode the last batch is the result, in ``append`` mode all batches are.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/quarry-stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, root)

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(publish).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{root}/out").option("recursiveFileLookup", True).parquet(f"{root}/out")
