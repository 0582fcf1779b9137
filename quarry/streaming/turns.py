"""State of conversations as their turns arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scheduled_turns(turns: DataFrame, key: str = "conv_id", most: int = 5) -> DataFrame:
    """key, steps, finished for each key with new turns: assistant turns so far, and whether `most` of them or a turn
    without a tool call has ended the conversation. Turns after that are not counted.

    For streams; the state is two numbers a key.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("turn")
        for role, text in zip(rows["role"], rows["text"], strict=True):
            if done or role != "assistant":
                continue
            steps += 1
            done = steps >= most or "Action:" not in (text or "")
        state.update((steps, done))
        yield pd.DataFrame({key: [k[0]], "steps": [steps], "finished": [done]})

    rows = turns.select(key, "turn", "role", "text")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, steps int, finished boolean", "steps int, done boolean", "update", GroupStateTimeout.NoTimeout)
