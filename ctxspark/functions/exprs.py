"""Native column expressions (no Python UDFs) for labelling, metrics and formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxspark.functions.columns import q

NAN = float("nan")


def argmax_label(label_columns: Sequence[str]) -> Column:
    """0-based index of the largest value among ``label_columns``.

    The first maximum wins; a missing value (null or NaN) counts as larger than any number and the first missing
    one wins; a row of zeros gives 0.
    """
    values = F.transform(F.array(*[q(c).cast("double") for c in label_columns]), lambda x: F.coalesce(x, F.lit(NAN)))
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def label_name(label: Column, names: Sequence[str]) -> Column:
    """Class index -> name, from a literal array (no join)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), label + 1)


def nan_to_null(c: Column) -> Column:
    """NaN -> null, so that aggregates skip it the way pandas skips NaN."""
    return F.nanvl(c, F.lit(None).cast("double"))


def nan_div(num: Column, den: Column) -> Column:
    """num / den, NaN when den is 0 (NumPy 0/0 and x/0 semantics for the report metrics)."""
    return F.when(den == 0, F.lit(NAN)).otherwise(num.cast("double") / den)


def zero_div(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (scorer semantics)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def epoch_to_utc_string(seconds: Column) -> Column:
    """Epoch seconds -> ``yyyy-MM-dd HH:mm:ss`` in UTC, fraction truncated."""
    ts = F.timestamp_seconds(F.floor(seconds.cast("double")))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
