"""Session defaults and typed settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class NoSettingError(KeyError):
    """A setting that was asked for and isn't there."""


@dataclass
class Settings:
    values: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, key: str) -> str:
        if key not in self.values:
            raise NoSettingError(key)
        return self.values[key]


def session(app: str = "mosaiq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC times; ``conf`` overrides, with _ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
