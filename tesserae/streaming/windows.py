"""Extensions for streams (the model has none): windows with watermarks, and relations fed by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: tuple = ()) -> DataFrame:
    """Counts by tumbling or sliding window; works on streams and on tables. Rows later than `late` are left out of streams."""
    w = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: tuple, late: str = "10 minutes") -> DataFrame:
    """Counts by session: runs of a key's events without a gap."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(F.col(time), gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def feed(session, stream: DataFrame, relation: str, checkpoint: str):
    """Put each micro-batch of a stream into a relation, with its triggers and callbacks."""

    def put(batch: DataFrame, _: int) -> None:
        session.register("__batch", batch, list(batch.columns))
        names = ", ".join(batch.columns)
        session.run(f"?[{names}] := *__batch{{{names}}} :put {relation} {{}}".replace(" {}", ""))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
