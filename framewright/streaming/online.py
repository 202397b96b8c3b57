"""Online sessions, consensus and budgets: state by stream, in bounded memory, late rows told apart by a watermark."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SESSION = "stream long, first long, last long, samples long, value string"
_STATE = "key string, first long, last long, n long, at double"


def online_sessions(samples: DataFrame, max_gap: int, late: str = "1 hour") -> DataFrame:
    """(stream, first, last, samples, value): a session of rows (stream, ts, position, value) ends when the value changes or the
    position jumps by more than ``max_gap``; the last one when the watermark has passed its last row by ``late``.

    A micro-batch's rows of a stream are taken in order of position; a row behind the state's last position is dropped.
    """

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], current[1], current[2], current[3], current[0]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("position")
            for position, value, at in zip(rows["position"].tolist(), rows["value"].tolist(), rows["ts"].map(pd.Timestamp.timestamp).tolist(), strict=True):
                if current and position <= current[2]:
                    continue
                if current and (value != current[0] or position - current[2] > max_gap):
                    out.append((key[0], current[1], current[2], current[3], current[0]))
                    current = None
                current = [value, position, position, 1, at] if current is None else [current[0], current[1], position, current[3] + 1, at]
            if current:
                state.update(tuple(current))
                state.setTimeoutTimestamp(max(int(current[4] * 1_000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["stream", "first", "last", "samples", "value"])

    marked = samples.select("stream", F.col("ts").cast("timestamp").alias("ts"), "position", "value").withWatermark("ts", late)
    return marked.groupBy("stream").applyInPandasWithState(run, _SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def online_consensus(samples: DataFrame, window: str, late: str) -> DataFrame:
    """(start, field, value, votes): the votes for each value in tumbling windows, late rows up to ``late`` counted."""
    marked = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    votes = marked.groupBy(F.window("ts", window).alias("w"), "field", "value").agg(F.count("*").alias("votes"))
    return votes.select(F.col("w.start").alias("start"), "field", "value", "votes")


def online_ledger(requests: DataFrame, a_frame: int) -> DataFrame:
    """(stream, frame, asked, granted): requests (stream, frame, amount) of a frame are granted up to what ``a_frame`` units a
    frame have earned so far; what is not spent carries over.

    Frames come in order within a stream, one frame's requests maybe in several micro-batches: a frame is granted, once, when a
    later one has come, so results do not depend on where batches are cut. (The last frame of a stream waits; a request of
    any amount for a frame behind it ends it.) A row of a frame already granted is an error.
    """

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, granted_to, open_frame, open_amount = state.get if state.exists else (0, -1, -1, 0)
        asked: Counter = Counter({open_frame: open_amount} if open_frame >= 0 else {})
        for pdf in batches:
            for frame, amount in zip(pdf["frame"].tolist(), pdf["amount"].tolist(), strict=True):
                if frame <= granted_to:
                    raise ValueError(f"stream {key[0]}: frame {frame} came after frame {granted_to} was granted")
                asked[frame] += amount
        out, frames = [], sorted(asked)
        for frame in frames[:-1]:
            granted = max(0, min(asked[frame], (frame + 1) * a_frame - spent))
            spent += granted
            granted_to = frame
            out.append((key[0], frame, asked[frame], granted))
        state.update((spent, granted_to, frames[-1], asked[frames[-1]]) if frames else (spent, granted_to, -1, 0))
        yield pd.DataFrame(out, columns=["stream", "frame", "asked", "granted"])

    state = "spent long, granted_to long, open_frame long, open_amount long"
    return requests.groupBy("stream").applyInPandasWithState(run, "stream long, frame long, asked long, granted long", state, "append", GroupStateTimeout.NoTimeout)
