"""Numbered steps between versions of the stored tables, up and down, applied to what is read.

Files carry the version that they were written in, as metadata of their first column, and are never rewritten for a new one: a reader asks for
a version, and gets each file's rows by the steps from the file's version to that. Files without a version are of the first.
Steps up may be taken again; a step down gives what a reader of the older version can understand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "schema_version"


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Step:
    """From the version before to ``version``: what changes in one table, and how to go back."""

    version: int
    table: str
    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame]


def _with_flag(df: DataFrame) -> DataFrame:
    return df if "bulk_validated" in df.columns else df.withColumn("bulk_validated", F.lit(False))


def _without_preprocessed(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("status") == "preprocessed", "preprocessing").otherwise(F.col("status")))


STEPS = (
    # A document may be preprocessed; without that status it goes back to the one it came from.
    Step(2, "documents", _same, _without_preprocessed),
    # Revisions say whether they were validated in bulk; older ones weren't.
    Step(3, "revisions", _with_flag, lambda df: df.drop("bulk_validated")),
    # Revisions may be normalised ones. Without that origin they go, for they are nobody's reading; numbers keep the gap.
    Step(4, "revisions", _same, lambda df: df.filter(F.col("origin") != "normalized")),
)
VERSION = max(s.version for s in STEPS)


def stamped(df: DataFrame, version: int = VERSION) -> DataFrame:
    """``df`` as it is written: with its version."""
    first = df.columns[0]
    return df.withMetadata(first, df.schema[first].metadata | {KEY: version})


def version_of(df: DataFrame) -> int:
    return df.schema.fields[0].metadata.get(KEY, 1) if df.columns else 1


def at_version(df: DataFrame, table: str, version: int = VERSION) -> DataFrame:
    """Rows of a table by the steps from their own version to ``version``."""
    if not 1 <= version <= VERSION:
        raise ValueError(f"versions are from 1 to {VERSION}")
    have = version_of(df)
    up = [s.up for s in STEPS if s.table == table and have < s.version <= version]
    down = [s.down for s in reversed(STEPS) if s.table == table and version < s.version <= have]
    return reduce(lambda rows, step: step(rows), [*up, *down], df)

