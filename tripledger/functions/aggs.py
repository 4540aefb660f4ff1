"""Aggregates with the null and tie rules the operators need; all combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_or_null(value: Column, where: Column) -> Column:
    """Sum over rows where ``where`` holds; null as soon as one of those values is null."""
    kept = F.count_if(where)
    known = F.count(F.when(where, value))
    return F.when((kept > 0) & (kept == known), F.sum(F.when(where, value)))


def only_value(value: Column, where: Column | None = None) -> Column:
    """The single distinct non-empty value, else null. min/max need constant memory per group."""
    present = F.when(value.cast("string") != "", value)
    if where is not None:
        present = F.when(where, present)
    return F.when(F.min(present) == F.max(present), F.min(present))


def one_or_mixed(value: Column, where: Column) -> Column:
    present = F.when(where & (value != ""), value)
    return (
        F.when(F.min(present).isNull(), F.lit(""))
        .when(F.min(present) == F.max(present), F.min(present))
        .otherwise(F.lit("mixed"))
    )


def first_by(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def first_row_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key by ``order``.

    An aggregate of structs instead of a window: it is combined before the shuffle, so a key
    that holds a large part of the rows sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*[F.col(k) for k in keys]).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("_row")
    )
    return packed.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def append_note(existing: Column, note: Column) -> Column:
    """Join two notes with a blank, treating null and '' as absent."""
    return F.concat_ws(" ", F.nullif(existing, F.lit("")), F.nullif(note, F.lit("")))
