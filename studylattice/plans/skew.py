"""Joining totals back to the rows they were taken from, with hot keys kept spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from studylattice.session import checkpointed


def join_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with ``totals``, which has one row per key.

    The totals are checkpointed, so both sides of the join are plain shuffles and AQE can split a
    hot key over several tasks; straight out of an aggregation on the key it could not. Runs a job.
    """
    return rows.join(checkpointed(totals), list(keys))
