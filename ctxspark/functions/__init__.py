from ctxspark.functions.columns import (
    ACTIVITY_LABELS,
    DISCRETE_PREFIX,
    LABEL_PREFIX,
    columns_with_prefix,
    feature_columns,
    q,
    sorted_columns,
    split_discrete_numeric,
)
from ctxspark.functions.exprs import (
    argmax_label,
    epoch_to_utc_string,
    label_name,
    nan_div,
    nan_to_null,
    zero_div,
)

__all__ = [
    "ACTIVITY_LABELS", "DISCRETE_PREFIX", "LABEL_PREFIX", "columns_with_prefix", "feature_columns", "q",
    "sorted_columns", "split_discrete_numeric", "argmax_label", "epoch_to_utc_string", "label_name", "nan_div",
    "nan_to_null", "zero_div",
]
