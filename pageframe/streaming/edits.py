"""The edit log as a stream: bursts, current state, dirty pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageframe.operators.edits import COALESCE_MS, last_write_wins

_BURST = "doc string, first_seq bigint, last_seq bigint, key string, calls bigint"
_STATE = (
    "open boolean, key string, first_seq bigint, last_seq bigint, last_ms bigint, calls bigint, "
    "stamps array<bigint>, seqs array<bigint>, names array<string>"
)


def stream_bursts(events: DataFrame, gap: str = "500 milliseconds", delay: str = "1 minute") -> DataFrame:
    """Bursts per document and key as session windows, when keys do not interleave."""
    marked = events.withWatermark("ts", delay)
    return marked.groupBy("doc", "key", F.session_window("ts", gap)).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("calls"))


def stream_coalesce(events: DataFrame, gap_ms: int = COALESCE_MS, delay: str = "1 minute") -> DataFrame:
    """Exact history entries on a stream of (doc, seq, ts, key): a burst comes out once it can grow no more.

    Events wait in the state of their document until the watermark has passed them, and only then are they taken, in the
    order of (ts, seq). So the entries are the same however the stream is cut into micro-batches, as long as no event is
    later than `delay`; those that are count as dropped rows in the progress of the query (`run_available` adds them up).
    A burst comes out when an event of another key or beyond the gap is taken, or when the watermark is a gap beyond it.
    A document's state is its open burst and the events of the last `delay`.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        doc, out, now = key[0], [], state.getCurrentWatermarkMs()
        current, waiting = [False, None, 0, 0, 0, 0], []
        if state.exists:
            *current, stamps, seqs, names = state.get
            waiting = list(zip(stamps, seqs, names))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += [(int(m), int(s), None if pd.isna(k) else k) for m, s, k in zip(rows["ms"], rows["seq"], rows["key"])]
        waiting.sort(key=lambda e: e[:2])

        def close() -> None:
            if current[0]:
                out.append((doc, current[2], current[3], current[1], current[5]))
            current[0] = False

        taken = 0
        for ms, seq, name in waiting:
            if ms >= now:
                break
            taken += 1
            if current[0] and name is not None and current[1] == name and ms - current[4] < gap_ms:
                current[3], current[4], current[5] = seq, ms, current[5] + 1
            else:
                close()
                current[:] = [True, name, seq, seq, ms, 1]
        waiting = waiting[taken:]
        if current[0] and now >= current[4] + gap_ms:
            close()
        if waiting or current[0]:
            state.update((*current, *([e[i] for e in waiting] for i in range(3))))
            due = min([e[0] for e in waiting[:1]] + [current[4] + gap_ms] * current[0])
            state.setTimeoutTimestamp(max(due, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["doc", "first_seq", "last_seq", "key", "calls"])

    timed = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("doc").applyInPandasWithState(follow, _BURST, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Current value per key, deletes as tombstones; update mode.

    The newest write wins whatever order events come in, so replays and
    duplicates change nothing and the state stays a plain aggregate.
    """
    return last_write_wins(events, keys, F.col("value"), F.col("deleted"))


def stream_dirty_pages(events: DataFrame, every: str = "150 milliseconds", delay: str = "1 minute") -> DataFrame:
    """Pages touched in each interval with the newest generation and how often."""
    marked = events.withWatermark("ts", delay)
    return marked.groupBy(F.window("ts", every), "source_key", "page_index").agg(F.max("seq").alias("generation"), F.count("*").alias("touches"))


def run_available(stream: DataFrame, path: str, mode: str) -> int:
    """Run a stream over what is there and return how many rows came too late for the watermark.

    Each micro-batch replaces its own folder, so a replay writes it once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
