"""Counts that ride along with a job: how many lines a reader left out, how many people or pairs an operator kept."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Watch:
    """Readers and operators that are given a watch count what they see in whatever job runs them first; nothing is scanned for it.

    ``values`` waits for these jobs, so it is asked after an action on the results; the first action must read all rows, not
    a few. Counts of a stage that lost executors make run again can be too high.
    """

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def over(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        """``df``, of whose rows ``counts`` (aggregates by name) are taken under the name ``step``."""
        if step in self.seen:
            raise ValueError(f"{step} is watched already")
        self.seen[step] = Observation(f"{step}-{uuid.uuid4().hex}")
        return df.observe(self.seen[step], *(c.alias(name) for name, c in counts.items()))

    def values(self) -> dict[str, dict[str, int]]:
        out = {}
        for step, x in self.seen.items():
            try:
                out[step] = {k: v or 0 for k, v in x.get.items()}
            except Py4JJavaError as error:
                raise RuntimeError(f"{step} was not counted: the first job over it did not run to its end") from error
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """step, name and value of all counts."""
        return spark.createDataFrame([(step, name, int(v)) for step, x in self.values().items() for name, v in x.items()], "step string, name string, value long")


def watched(watch: Watch | None, df: DataFrame, step: str, **counts: Column) -> DataFrame:
    return df if watch is None else watch.over(df, step, **counts)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))
