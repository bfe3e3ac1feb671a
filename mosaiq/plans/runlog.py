"""Experiment runs as an append-only log of values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class RunLog:
    """Settings of an experiment, values of each run, and the keys that are results."""

    settings: dict = field(default_factory=dict)
    runs: list[dict] = field(default_factory=list)
    results: list[str] = field(default_factory=list)

    def new_run(self) -> None:
        self.runs.append({})

    def store(self, key: str, value) -> None:
        if key in self.runs[-1]:
            raise ValueError(f"{key} is stored already")
        self.runs[-1][key] = value

    def store_global(self, key: str, value) -> None:
        if key in self.settings:
            raise ValueError(f"{key} is stored already")
        self.settings[key] = value

    def store_result(self, key: str, value: float) -> None:
        self.store(key, value)
        if key not in self.results:
            self.results.append(key)

    def values(self, key: str) -> list:
        return [r.get(key) for r in self.runs]

    def last(self, key: str):
        return self.runs[-1].get(key)

    def merged(self, other: RunLog) -> RunLog:
        """Runs of both; their keys must be the same."""
        keys = [{k for r in x.runs for k in r} for x in (self, other)]
        if keys[0] != keys[1]:
            raise ValueError("logs with different keys")
        return RunLog(self.settings, self.runs + other.runs, list(dict.fromkeys(self.results + other.results)))

    def table(self, spark: SparkSession) -> DataFrame:
        """``run_id, key, score`` of the results."""
        return spark.createDataFrame([(n, k, float(r[k])) for n, r in enumerate(self.runs) for k in self.results if k in r], "run_id long, key string, score double")

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self)))

    @classmethod
    def load(cls, path: str) -> RunLog:
        return cls(**json.loads(Path(path).read_text()))


def statistics(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of each key."""
    return scores.groupBy("key").agg(F.avg("score").alias("avg"), F.stddev_pop("score").alias("std"))


def result_table(scores: DataFrame, rows: str, columns: str) -> DataFrame:
    return scores.groupBy(rows).pivot(columns).agg(F.avg("score"))
