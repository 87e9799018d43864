"""Settings of the library: the session's own, under blockwright., before environment variables of the bare name."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

PREFIX = "blockwright."
TRUE, FALSE = ("y", "yes", "t", "true", "on", "1"), ("n", "no", "f", "false", "off", "0")


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    found = spark.conf.get(PREFIX + name, None)
    return found if found is not None else os.environ.get(name, default)


def put_setting(spark: SparkSession, name: str, value: str | int | bool) -> None:
    spark.conf.set(PREFIX + name, str(value))


def listed(spark: SparkSession, name: str, default: tuple[str, ...] = ()) -> list[str]:
    """A setting's parts between commas."""
    found = setting(spark, name)
    return list(default) if found is None else found.split(",")


def number(spark: SparkSession, name: str, default: int | None = None) -> int:
    return int(setting(spark, name, None if default is None else str(default)))


def switch(spark: SparkSession, name: str, default: bool = False) -> bool:
    """A setting that says yes or no; anything else is an error."""
    found = (setting(spark, name, "on" if default else "off") or "").lower()
    if found not in TRUE + FALSE:
        raise ValueError(f"{name} is neither yes nor no: {found}")
    return found in TRUE


def log_level(spark: SparkSession) -> str:
    """The level in LOG_LEVEL (INFO by default), which the session's log is set to."""
    level = (setting(spark, "LOG_LEVEL", "INFO") or "INFO").upper()
    spark.sparkContext.setLogLevel(level)
    return level
