"""ctxspark — human-context activity classification as Spark DataFrame / Spark ML jobs.

Layout
------
functions/  column expressions and column-role helpers (quoting, argmax label, NaN-aware division, epoch format)
sources/    readers and writers (per-user CSV directories, fold lists, datasets, models, result tables) and the
            ``samples`` fixture view over the provided tables
operators/  table operators: labelling join, folds, column statistics, ANOVA selection, mixed preprocessing,
            models, evaluation, model comparison, grid search
plans/      end-to-end flows: preprocess -> train per fold -> evaluate, grid search, notebook comparison
"""

from ctxspark.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
