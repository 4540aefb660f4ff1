"""Text similarity. The only scalar Python function of the matching path."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = pd.DataFrame({"a": left, "b": right})
    uniq = pairs.dropna().drop_duplicates()
    score = {
        (a, b): SequenceMatcher(None, a, b).ratio() for a, b in uniq.itertuples(index=False)
    }
    return pd.Series(
        [score.get((a, b)) for a, b in zip(pairs["a"], pairs["b"], strict=True)], dtype="float64"
    )


# Otherwise the optimizer copies the call into the filters above it and runs it again for each pair.
_ratio = _ratio.asNondeterministic()


def text_similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of two lower-cased texts, 0 when either is empty.

    Equal texts (1) and texts without a common character (0) are decided natively; only the
    remaining pairs carry data to Python.
    """
    a, b = F.lower(F.coalesce(left, F.lit(""))), F.lower(F.coalesce(right, F.lit("")))
    empty = (a == "") | (b == "")
    disjoint = F.call_function("translate", b, a, F.lit("")) == b
    hard = ~empty & ~disjoint & (a != b)
    return (
        F.when(empty, F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(disjoint, F.lit(0.0))
        .otherwise(_ratio(F.when(hard, a), F.when(hard, b)))
    )


def similarity_ceiling(left: Column, right: Column) -> Column:
    """Cheap native upper bound of the ratio from the lengths, 0 without a common character."""
    a, b = F.lower(left), F.lower(right)
    la, lb = F.length(a), F.length(b)
    return (
        F.when((la == 0) | (lb == 0), F.lit(0.0))
        .when(F.call_function("translate", b, a, F.lit("")) == b, F.lit(0.0))
        .otherwise(F.lit(2.0) * F.least(la, lb) / (la + lb))
    )


def token_hit(vendor: Column, description: Column) -> Column:
    """Some vendor word longer than two characters occurs inside the description."""
    text = F.lower(description)
    return F.coalesce(
        F.exists(
            F.split(F.trim(F.lower(vendor)), r"\s+"),
            lambda word: (F.length(word) > 2) & text.contains(word),
        ),
        F.lit(False),
    )
