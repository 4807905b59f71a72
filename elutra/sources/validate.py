"""Checks of input tables. Each gives a DataFrame or raises one of the typed errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InputError(Exception):
    """The input can't be used."""


class MissingColumnError(InputError):
    pass


class EmptyColumnError(InputError):
    pass


class DuplicateIdentifierError(InputError):
    pass


class NaInMatrixError(InputError):
    pass


#: The columns that each kind of table must have, and those that must be unique together.
REQUIRED = {
    "ids": (["Sample", "cond", "group", "short_id", "repl", "fr"], ["repl", "short_id"]),
    "db": (["ComplexID", "ComplexName", "subunits(Gene name)"], ["ComplexName", "ComplexID"]),
    "pairs": (["protA", "protB"], []),
    "in": (["GN"], ["GN"]),
}


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, nulls) in one pass."""
    columns = columns or df.columns
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in columns])).alias("x")).select("x.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_in_profile(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.exists("vals", lambda x: x.isNull() | F.isnan(x)))


def check(df: DataFrame, kind: str) -> None:
    """Raises unless ``df`` can be used as a table of its kind."""
    required, unique = REQUIRED[kind]
    if kind == "db" and missing_columns(df, required):
        required, unique = REQUIRED["pairs"]
    if lacking := missing_columns(df, required):
        raise MissingColumnError(f"columns are missing: {', '.join(lacking)}")
    if empty := [r["column"] for r in null_counts(df, required).where("nulls > 0").collect()]:
        raise EmptyColumnError(f"empty values in {', '.join(empty)}")
    if unique and (found := duplicate_keys(df, unique).first()):
        raise DuplicateIdentifierError(f"rows share {', '.join(f'{c} {found[c]}' for c in unique)}")
    if kind == "in" and any(r["nulls"] for r in null_counts(df).collect()):
        raise NaInMatrixError("the matrix has empty cells")
