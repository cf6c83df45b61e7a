"""The write log as a stream: each block's last content is kept as state, so repeated writes are told apart as they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def outcomes(writes: DataFrame) -> DataFrame:
    """seq, volume_id, lba, outcome (write, noop, zero or late) of a stream of block writes.

    State is one hash and one sequence number for a block, by (volume_id, lba). Rows of a batch are taken in order of seq; a
    row that isn't above the block's last seq is late and changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (-1, "")
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")  # one block's rows of one batch
        on_time = (rows["seq"] > last) & ~rows["seq"].duplicated()
        taken = rows[on_time]
        before = taken["hash"].shift(fill_value=held)
        outcome = pd.Series("late", index=range(len(rows)))
        outcome[on_time.to_numpy()] = np.where(taken["op"] == "zero", "zero", np.where(taken["hash"] == before, "noop", "write"))
        if len(taken):
            state.update((int(taken["seq"].iloc[-1]), taken["hash"].iloc[-1]))
        yield pd.DataFrame({"seq": rows["seq"].to_numpy(), "volume_id": key[0], "lba": key[1], "outcome": outcome})

    blocks = writes.where("op <> 'flush'").select("seq", "volume_id", "lba", "op", "hash")
    return blocks.groupBy("volume_id", "lba").applyInPandasWithState(step, "seq long, volume_id string, lba long, outcome string", "last long, held string", "append", "NoTimeout")
