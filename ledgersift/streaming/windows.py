"""Windowed totals and running baselines over event streams; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, time: str, key: str, value: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(starts, key, n, total) in tumbling or sliding windows. On a stream give `late`: how long late events are waited for."""
    rows = events.withWatermark(time, late) if late else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    got = rows.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("starts"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, starts, ends, n): runs of events of a key with less than `gap` between them."""
    rows = events.withWatermark(time, late) if late else events
    got = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def running_zscores(events: DataFrame, key: str, value: str, least: int = 6, severe: float = 3.0) -> DataFrame:
    """(key, value, zscore) of stream events far from the mean of their key so far, by Welford's running moments as keyed state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def update(group, frames, state):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = []
        for frame in frames:
            for x in frame[value].dropna():
                if n >= least and m2 > 0 and abs(z := (x - mean) / (m2 / (n - 1)) ** 0.5) >= severe:
                    rows.append((group[0], float(x), float(z)))
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame(rows, columns=[key, value, "zscore"])

    return events.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {value} double, zscore double", "n bigint, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)
