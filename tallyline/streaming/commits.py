"""Taking commits in as a stream.

The stream keeps no state: a late commit must still be stored, however late, so
repeats are removed against the stored table instead of against a growing state
or a watermark. The table is dealt to buckets by repository (``sources/store.py``),
and a batch opens only those of its own repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import commits as commit_ops
from ..sources import feeds
from ..sources.store import Store

FEW_REPOSITORIES = 1000  # so many are looked for by name within their buckets
KEY = ["repo_id", "sha1"]


def commit_store(spark: SparkSession, path: str, schema: StructType) -> Store:
    return Store(spark, path, schema, by=["repo_id"], bloom="sha1")


def earlier_keys(store: Store, batch: DataFrame) -> DataFrame:
    """Stored keys of the repositories of a batch; files of other buckets are not opened, nor row groups of other repositories."""
    met = store.touched(batch)
    known = store.read(met).select(*KEY)
    some = [row.repo_id for row in batch.select("repo_id").distinct().limit(FEW_REPOSITORIES + 1).collect()]
    if len(some) <= FEW_REPOSITORIES:
        known = known.where(F.col("repo_id").isin([r for r in some if r is not None]))
    return known


def take_in(store: Store, batch: DataFrame, batch_id: int) -> None:
    """Stores the unseen commits of a batch, unless a snapshot says that the batch is in.

    So a batch that runs again after a failure either finds itself stored or
    starts over; what it may have written before is in no snapshot.
    """
    taken = store.snapshot().mark
    if taken is not None and taken >= batch_id:
        return
    fresh = commit_ops.first_sightings(batch)
    # The table grows and the batch does not, so the batch goes to the table.
    repeats = earlier_keys(store, batch).join(fresh.select(*KEY), KEY, "left_semi")
    store.append(feeds.find_new_commits(fresh, repeats), mark=batch_id)


def stream_ingest_commits(feed: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends each unseen (repo_id, sha1) of a streaming feed to a store, one snapshot a batch.

    The feed has a ``seq`` column; the lowest wins within a batch.
    """
    return (
        feed.writeStream.foreachBatch(lambda batch, batch_id: take_in(store, batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drop_repeats(feed: DataFrame, delay: str) -> DataFrame:
    """For a source that repeats only within ``delay``: bounded state in place of the stored table."""
    timed = feed.withColumn("_event_time", F.col("commit_date").cast("timestamp"))
    fresh = timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(KEY)
    return fresh.drop("_event_time")
