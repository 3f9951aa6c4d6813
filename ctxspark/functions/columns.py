"""Column quoting and column roles.

The table schema is dynamic: label columns, features and discrete features are recognised by name at run time.
Role detection is a pure function over column names; nothing here touches data.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six main activities, in class order 0..5, and the name prefixes that give columns their role.
ACTIVITY_LABELS = (
    "label:LYING_DOWN",
    "label:SITTING",
    "label:OR_standing",
    "label:FIX_walking",
    "label:FIX_running",
    "label:BICYCLING",
)
LABEL_PREFIX = "label"
DISCRETE_PREFIX = "discrete"
NON_FEATURE_COLUMNS = ("label_source", "timestamp", "label_name", "uuid")


def q(name: str) -> Column:
    """Column by exact name; names may hold ``:``, ``.`` or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def _names(cols: DataFrame | Iterable[str]) -> list[str]:
    return list(cols.columns) if isinstance(cols, DataFrame) else list(cols)


def columns_with_prefix(cols: DataFrame | Iterable[str], prefix: str | None = None) -> list[str]:
    """All names, or those starting with ``prefix`` (case-sensitive), in table order."""
    names = _names(cols)
    return names if not prefix else [c for c in names if c.startswith(prefix)]


def feature_columns(cols: DataFrame | Iterable[str], label_columns: Sequence[str] = ()) -> list[str]:
    """Feature names: every column that is not a label, not a key and does not start with ``label``."""
    excluded = set(label_columns) | set(NON_FEATURE_COLUMNS)
    return [c for c in _names(cols) if c not in excluded and not c.startswith(LABEL_PREFIX)]


def split_discrete_numeric(features: Iterable[str]) -> tuple[list[str], list[str]]:
    """(discrete, numeric) by the ``discrete`` name prefix, each in the given order."""
    feats = list(features)
    discrete = [c for c in feats if c.startswith(DISCRETE_PREFIX)]
    numeric = [c for c in feats if not c.startswith(DISCRETE_PREFIX)]
    return discrete, numeric


def sorted_columns(df: DataFrame) -> DataFrame:
    """Columns reordered by code point, case-sensitive (upper case before lower case)."""
    return df.select(*[q(c) for c in sorted(df.columns)])
