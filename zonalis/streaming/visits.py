"""Event-time counts and place occupancy over a stream of arrivals.

An arrival is ``place, person_id, ts, stay_minutes``. Counts are windowed aggregates
behind a watermark; occupancy keeps, per place, the minutes at which those present
leave, and forgets what has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "place string, minute long, arrived int, present int"


def counts(arrivals: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``place, start, people, visits``: late rows count until the watermark passes."""
    w = arrivals.withWatermark("ts", late).groupBy(F.window("ts", window), "place")
    return w.agg(F.count("*").alias("visits"), F.approx_count_distinct("person_id").alias("people")).select("place", F.col("window.start").alias("start"), "visits", "people")


def occupancy(arrivals: DataFrame) -> DataFrame:
    """Per place and batch of arrivals: how many came and how many are present then."""
    rows = arrivals.select("place", F.floor(F.unix_timestamp("ts") / 60).alias("minute"), F.col("stay_minutes").cast("long").alias("stay"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        leave = sorted(state.get[0]) if state.exists else []
        arrived, now = 0, 0
        for batch in batches:
            arrived += len(batch)
            now = max(now, int(batch["minute"].max()))
            leave += (batch["minute"] + batch["stay"]).astype(int).tolist()
        leave = [m for m in leave if m > now]
        state.update((leave,))
        yield pd.DataFrame({"place": [key[0]], "minute": [now], "arrived": [arrived], "present": [len(leave)]})

    return rows.groupBy("place").applyInPandasWithState(step, OUTPUT, "leave array<long>", "update", "NoTimeout")
