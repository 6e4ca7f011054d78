"""Calls of a text model on distinct inputs: each different input is sent once, at a bounded rate, with retries.

The inputs of all rows are reduced to their distinct ones (repeats are dropped in each task before the shuffle), dealt to
`parallel` tasks, and answered there; the replies are written once, so that nothing that reads them calls the model again,
and joined back by a hash of the input. A table of up to ``BROADCAST`` replies is broadcast, so an input that a third of all
rows share is no task's burden; beyond, the join is by shuffle, where adaptive execution splits such a key.

Each task keeps its calls `parallel / rate` seconds apart, so all together make at most `rate` a second. A call that fails
is made again up to `attempts` times, after pauses that double; what still fails becomes the error text of its rows, never a
failed job. A null input is not sent, and its reply is null.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from collections.abc import Callable

    from pyspark.sql import DataFrame

BROADCAST = 10_000


@dataclass(frozen=True)
class Limits:
    """Tasks that call at once, calls a second of all together (None: no bound), attempts of a call, and the first pause."""

    parallel: int = 8
    rate: float | None = None
    attempts: int = 3
    pause: float = 0.5


class Pace:
    """Keeps calls at least `gap` seconds apart."""

    def __init__(self, gap: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = gap, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def attempted(call: Callable[[], str], limits: Limits, pace: Pace, sleep=time.sleep) -> tuple[str | None, str | None]:
    """The reply, or None and the error of the last attempt."""
    error = None
    for k in range(max(1, limits.attempts)):
        if k:
            sleep(limits.pause * 2 ** (k - 1))
        pace.wait()
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001  any failure of a model is a row's, not the job's
            error = str(e) or type(e).__name__
    return None, error


def replies(rows: DataFrame, column: str, call: Callable[[str], str], folder: str, limits: Limits = Limits()) -> DataFrame:
    """rows with reply and error, of the call on their column; folder is a new one, which holds the replies."""
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", F.sha2(F.col(column), 256))
    asked = keyed.where(F.col("__key").isNotNull()).select("__key", F.col(column).alias("input")).dropDuplicates(["__key"])

    def run(batches):
        pace = Pace(limits.parallel / limits.rate if limits.rate else 0.0)
        for batch in batches:
            made = [attempted(lambda x=x: call(x), limits, pace) for x in batch["input"]]
            yield pd.DataFrame({"__key": batch["__key"], "reply": [m[0] for m in made], "error": [m[1] for m in made]})

    answered = asked.repartition(limits.parallel, "__key").mapInPandas(run, "__key string, reply string, error string")
    answered.write.parquet(folder)
    stored = spark.read.schema("__key string, reply string, error string").parquet(folder)
    few = stored.count() <= BROADCAST
    return keyed.join(F.broadcast(stored) if few else stored, "__key", "left").drop("__key")
