"""Transition counts of a stream of labelled frames.

Counts are additive, so the stream is cut at its batches: what is kept of a
trajectory are its last ``lag`` frames. Frames that come later than the watermark
allows are dropped by Spark; a frame that comes earlier than one already seen
cannot be paired without taking pairs back, and is dropped and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "traj_id string, src string, dst string, n bigint, late bigint"
STATE = "times array<bigint>, labels array<string>"


def transition_stream(frames: DataFrame, traj: str, time: str, state: str, lag: int = 1, delay: str = "1 hour", idle_days: int = 365) -> DataFrame:
    """``traj_id``, ``src``, ``dst``, ``n`` new pairs, and ``late`` frames, as they come (append mode).

    ``time`` is a timestamp; equal times of a trajectory are taken by label. NULL labels
    keep their place and give no pairs. A trajectory without frames for ``idle_days`` is forgotten.
    """
    rows = frames.select(
        F.col(traj).cast("string").alias("traj_id"), F.col(time).cast("timestamp").alias("ts"), F.col(state).cast("string").alias("state")
    ).withWatermark("ts", delay)

    def update(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        new = pd.concat(list(parts))
        new = new.assign(t=new["ts"].astype("int64"), state=new["state"].astype(object).where(new["state"].notna(), None))
        new = new.sort_values(["t", "state"], na_position="first")
        times, labels = kept.get if kept.exists else ([], [])
        times, labels = list(times), list(labels)
        last = times[-1] if times else None
        late = int((new["t"] < last).sum()) if last is not None else 0
        fresh = new if last is None else new[new["t"] >= last]
        before = len(labels)
        times += fresh["t"].tolist()
        labels += fresh["state"].tolist()
        pairs: dict[tuple[str, str], int] = {}
        for i in range(max(before, lag), len(labels)):
            a, b = labels[i - lag], labels[i]
            if a is not None and b is not None:
                pairs[a, b] = pairs.get((a, b), 0) + 1
        kept.update((times[-lag:], labels[-lag:]))
        latest = max(int(new["ts"].max().timestamp() * 1000), kept.getCurrentWatermarkMs())
        kept.setTimeoutTimestamp(latest + idle_days * 86_400_000)
        out = [(key[0], a, b, n, 0) for (a, b), n in sorted(pairs.items())]
        if late:
            out.append((key[0], None, None, 0, late))
        if out:
            yield pd.DataFrame(out, columns=["traj_id", "src", "dst", "n", "late"])

    return rows.groupBy("traj_id").applyInPandasWithState(update, PAIRS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_states(frames: DataFrame, time: str, state: str, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``start``, ``state``, ``n``: frames by time window and state, of a stream or a table."""
    rows = frames.select(F.col(time).cast("timestamp").alias("ts"), F.col(state).alias("state")).withWatermark("ts", delay)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "state", "n")
