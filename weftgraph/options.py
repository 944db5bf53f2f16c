"""Options of a job, from ``key = value`` lines (comments start with # or !)."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Literal

from pyspark.sql import SparkSession


def parse(text: str) -> dict[str, str]:
    """The last value of each key; blanks around both are left out."""
    found = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            cut = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
            found[line[:cut].strip()] = line[cut + 1 :].strip()
    return found


def read(spark: SparkSession, path: str) -> dict[str, str]:
    """Of a small file that only Spark may be able to open."""
    return parse("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def value(options: dict[str, str], key: str, default, kind: type | None = None):
    """A typed value; a key that isn't there gives the default, a value that can't be read raises."""
    if key not in options:
        return default
    kind = kind or type(default)
    text = options[key]
    if kind is bool:
        if text.lower() not in ("true", "false"):
            raise ValueError(f"{key} = {text} is neither true nor false")
        return text.lower() == "true"
    if kind in (list, tuple):
        return kind(x.strip() for x in text.split(",") if x.strip())
    return kind(text)


@dataclass(frozen=True)
class Options:
    """What a partitioned job can be told."""

    strategy: Literal["range", "multilevel", "hash"] = "hash"
    parts: int = 3
    imbalance: float = 0.03
    passes: int = 6
    seed: int = 1
    rounds: int = 10_000
    assemble: bool = True

    @staticmethod
    def of(options: dict[str, str]) -> Options:
        return Options(**{f.name: value(options, f.name, f.default) for f in fields(Options) if f.name in options})
