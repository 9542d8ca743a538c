"""Change events as streams: filtering, debouncing, audits, publication with backoff."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphquarry.sources.inventory import EXCLUDED_DIRS

#: Pause that ends a burst of changes, audit period, longest wait after failures.
DEBOUNCE, AUDIT, LONGEST_WAIT = "600 milliseconds", "5 seconds", 30


def relevant(events: DataFrame, path: str = "path") -> DataFrame:
    """Events outside of directories that are never looked into."""
    return events.where(~F.exists(F.split(path, "/"), lambda p: p.isin(*EXCLUDED_DIRS)))


def debounced(events: DataFrame, gap: str = DEBOUNCE, key: str = "user_id", ts: str = "ts", last: str = "event_id", lateness: str | None = None) -> DataFrame:
    """key, start, end, changes, last_event of each burst of changes; the same for a batch and for a stream (which needs
    `lateness`, how late an event may come)."""
    rows = events.withWatermark(ts, lateness) if lateness else events
    bursts = rows.groupBy(key, F.session_window(ts, gap).alias("burst")).agg(F.count(F.lit(1)).alias("changes"), F.max(last).alias("last_event"))
    return bursts.select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "changes", "last_event")


def coalesced(jobs: DataFrame, key: str = "repository", ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """One job for each repository while another of it may be waiting."""
    return jobs.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def wait_seconds(failures: int) -> int:
    """Seconds to the next try after so many failures in a row."""
    return min(LONGEST_WAIT, 5 * 2 ** min(failures, 3))


def publish_changes(bursts: DataFrame, publish: Callable[[DataFrame], None], checkpoint: str, period: str = AUDIT, once: bool = False, tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Publish once for each batch that has bursts. A failed publication is tried again after wait_seconds(); after `tries` the
    batch fails, and the stream begins again from its checkpoint, so nothing is lost and the active generation stays."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        for failures in range(tries):
            try:
                return publish(batch)
            except Exception:
                if failures == tries - 1:
                    raise
                sleep(wait_seconds(failures))

    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=period)).start()


def file_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of event files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether two one-row digests of the sources agree: what was read in between is valid then."""
    return before.first()["digest"] == after.first()["digest"]
