"""Review streams: late-tolerant deduplication, running counts, and a sliding-log limiter as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(stream: DataFrame, key: str = "review_id", time: str = "ingested_at", delay: str = "2 days") -> DataFrame:
    """Each key once; state older than the watermark is dropped, so repeats must arrive within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, window: str, delay: str, time: str = "ingested_at", *keys: str) -> DataFrame:
    """Rows and mean rating per time window and key; windows close ``delay`` after their end. Works on batches alike."""
    marked = stream.withWatermark(time, delay) if stream.isStreaming else stream
    return marked.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("rating").alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


_LIMITED = "key string, ts double, allowed boolean"


def _fold(hits: list[float], times: list[float], most: int, span: float) -> tuple[list[float], list[bool]]:
    out = []
    for t in times:
        hits = [h for h in hits if h > t - span]
        ok = len(hits) < most
        if ok:
            hits.append(t)
        out.append(ok)
    return hits, out


def rate_limit(requests: DataFrame, most: int, span: float) -> DataFrame:
    """(key, ts, allowed) of ``requests(key, ts)``: at most ``most`` allowed hits within ``span`` seconds; rejected ones do not count.

    The fold is sequential per key by nature. A batch sorts each key's rows in the exchange; a stream keeps the last allowed hits.
    """
    if not requests.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts", kind="stable")
            return pdf.assign(allowed=_fold([], pdf["ts"].tolist(), most, span)[1])

        return requests.select("key", "ts").groupBy("key").applyInPandas(whole, _LIMITED)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        hits, allowed = _fold(hits, rows["ts"].tolist(), most, span)
        state.update((hits,))
        yield rows[["key", "ts"]].assign(allowed=allowed)

    return requests.select("key", "ts").groupBy("key").applyInPandasWithState(step, _LIMITED, "hits array<double>", "append", GroupStateTimeout.NoTimeout)
