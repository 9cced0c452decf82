"""Dense intervals over a stream of occurrences.

An extra: batch mining is the standard it is tested against. Occurrences come in
the order of ``t`` for each pattern. State holds the last ``theta - 1`` times of
a pattern and the run that is open; a run is emitted when the next segment no
longer touches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from tideline.durable import ship
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "pattern string, s long, e long"
STATE = "times array<long>, s long, e long"


def advance(times: list[int], run: tuple[int, int] | None, t: int, window: int, theta: int) -> tuple[list[int], tuple[int, int] | None, tuple[int, int] | None]:
    """Take in one occurrence: the times to keep, the open run, and the run that closed, if any."""
    held = [*times, t]
    closed = None
    if len(held) >= theta and t - held[-theta] <= window:
        s, e = t - window, held[-theta]
        if run is not None and s <= run[1] + 1:
            run = (run[0], max(run[1], e))
        else:
            closed, run = run, (s, e)
    return held[-(theta - 1) :] if theta > 1 else [], run, closed


def dense_runs(stream: DataFrame, window: int, theta: int) -> DataFrame:
    """Runs of ``(pattern string, t long)`` as they close; an occurrence at the special time -1 closes the pattern's run."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, s, e = state.get if state.exists else ([], None, None)
        times, run, out = list(times), None if s is None else (s, e), []
        for t in sorted((int(x) for b in batches for x in b["t"]), key=lambda x: (x == -1, x)):
            if t == -1:
                if run is not None:
                    out.append(run)
                times, run = [], None
                continue
            times, run, closed = advance(times, run, t, window, theta)
            if closed is not None:
                out.append(closed)
        state.update((times, *(run or (None, None))))
        yield pd.DataFrame({"pattern": [key[0]] * len(out), "s": [x[0] for x in out], "e": [x[1] for x in out]})

    ship(stream.sparkSession)
    return stream.groupBy("pattern").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
