"""The driver's loop: a state table, a step, and a test when to stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .checkpoint import materialise


def run(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], max_iter: int | None, until: Callable[[DataFrame, int], bool] | None = None) -> tuple[DataFrame, int]:
    """Apply step(state, round) until until(state, round) holds or max_iter rounds (None: no limit) are done. The state is
    written to the shared folder each round, so that plans do not grow and nothing is computed twice. Returns the last
    state and the number of rounds."""
    state, round_ = materialise(state, "state"), 0
    while max_iter is None or round_ < max_iter:
        round_ += 1
        state = materialise(step(state, round_), "state")
        if until and until(state, round_):
            break
    return state, round_
