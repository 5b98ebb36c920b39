"""Watching a folder of sources, and the debouncing of changes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.code import code_index
from ..sources.tree import read_tree, watch_tree

QUIET_MS, LOST_MS = 2000, 5000


def quiet_sessions(events: DataFrame, key: str, at: str, gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """Changes of a key that follow each other within ``gap`` as one: key, start, end, changes.

    The same plan runs on a batch and, with a watermark of ``late``, on a stream; a session is given out once
    ``gap`` has passed without a change.
    """
    rows = events.withWatermark(at, late) if late else events
    grouped = rows.groupBy(F.session_window(at, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("changes"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def settled(listings: DataFrame, quiet_ms: int = QUIET_MS, lost_ms: int = LOST_MS) -> DataFrame:
    """file, event ('changed' or 'deleted') of a stream of listings (file, stamp), each when it has settled.

    For each path the state has its last stamp, since when it is unsettled (0: settled) and when it was seen.  A new stamp starts the quiet
    period again; at its end the change is given out.  A path that no listing has shown for ``lost_ms`` is gone: its tombstone goes out and
    its state is dropped, whether or not anything else has changed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = int(time.time() * 1000)
        stamp, since, seen = state.get if state.exists else ("", 0, now)
        for rows in batches:
            for new in rows["stamp"]:
                if new != stamp:
                    stamp, since = new, now
                seen = now
        if state.exists and now - seen >= lost_ms:
            state.remove()
            yield pd.DataFrame({"file": [key[0]], "event": ["deleted"]})
            return
        due = bool(since) and now - since >= quiet_ms
        if due:
            since = 0
        state.update((stamp, since, seen))
        wait = seen + lost_ms - now
        state.setTimeoutDuration(max(1, min(wait, since + quiet_ms - now) if since else wait))
        if due:
            yield pd.DataFrame({"file": [key[0]], "event": ["changed"]})

    return listings.groupBy("file").applyInPandasWithState(step, "file string, event string", "stamp string, since long, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def code_watch(
    spark: SparkSession, root: str, on_change: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], None], checkpoint: str, interval: str = "1 second", quiet_ms: int = QUIET_MS, lost_ms: int = LOST_MS
) -> StreamingQuery:
    """Index ``root`` and keep it indexed: ``on_change`` gets symbols, edges and tally of the files changed, and the files deleted.

    The tree is listed at each trigger; changes that have settled are read and parsed in one go.  An edit or a deletion needs no other file
    to arrive.
    """

    def batch(events: DataFrame, _: int) -> None:
        events = events.persist()
        try:
            if events.isEmpty():
                return
            changed = events.filter("event = 'changed'").select("file")
            # names of the files of one settled change, not of the tree
            found, links, tally = code_index(read_tree(spark, root).join(changed, "file", "left_semi"))
            on_change(found, links, tally, events.filter("event = 'deleted'").select("file"))
        finally:
            events.unpersist()

    stream = settled(watch_tree(spark, root), quiet_ms, lost_ms)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
