"""The bounded chat history as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "turns array<bigint>, roles array<string>, texts array<string>"
_OUT = "conv_id bigint, turn bigint, role string, text string"


def rolling_history(turns: DataFrame, n: int = 4) -> DataFrame:
    """After each batch, the n newest turns of every conversation that got a new one.

    The state of a conversation is those n turns, whatever its length. A turn that arrives late
    takes its place by turn number.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += list(zip(batch["turn"].tolist(), batch["role"].tolist(), batch["text"].tolist()))
            held = sorted(held, key=lambda t: t[0])[-n:]
        state.update(tuple(list(column) for column in zip(*held)))
        frame = pd.DataFrame(held, columns=["turn", "role", "text"])
        frame.insert(0, "conv_id", key[0])
        yield frame

    return turns.groupBy("conv_id").applyInPandasWithState(
        update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
