"""Counts that a job gives beside its result, from the same pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: States of a document.
STATES = ("ok", "error", "empty", "missing")


class Counts:
    """Counts by state of one DataFrame, taken while an action on it runs; no job of their own.

    Other states count as ``other``. Reading them before an action would wait, so it is an error.
    """

    def __init__(self, name: str):
        self.observation, self.observed = Observation(name), False

    def of(self, df: DataFrame, status: str = "status", text: str | None = None) -> DataFrame:
        """``df``, with its rows counted when they pass."""
        state = F.col(status)
        known = [F.count_if(state == x).alias(x) for x in STATES]
        more = [F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")] if text else []
        self.observed = True
        return df.observe(self.observation, F.count("*").alias("rows"), *known, F.count_if(state.isNull() | ~state.isin(*STATES)).alias("other"), *more)

    def get(self) -> dict[str, int]:
        if not self.observed:
            raise ValueError("nothing has been counted")
        return dict(self.observation.get)

    def by_state(self) -> dict[str, int]:
        """The states that occur."""
        found = self.get()
        return {x: found[x] for x in sorted((*STATES, "other")) if found[x]}
